"""Order MinHash fingerprints of texts, with DataFrame functions only.

The k-mers of a text are its runs of k words, each numbered by how often it has
occurred before. A hash of (k-mer, occurrence) deals them into bins; of each bin
the l with the least hashes are selected, put back in text order, and hashed as a
tuple. Equal tuples need the same k-mers in the same order, which makes the
signature sensitive to edits and moves where a set signature is not. One hash
per k-mer serves all bins.

A fingerprint is one string: four hexadecimal digits a bin, "...." for an empty
one. Its likeness to another is the share of equal bins among those that are not
empty in both; two fingerprints without any bin are alike (1.0).

Defined results: null and empty texts have the fingerprint of no k-mers; a text
of fewer than k words has one k-mer, all of it; any text that Spark can hold (2 ** 31
words at most). Ids may be of any type that can be ordered, null ids come first, and
rows of one id follow each other by the hash of their text; an empty table gives an
empty result; other columns than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, documents

#: Bits of a packed selection key: bin, hash, position. An array has fewer than 2 ** 31 members.
BIN_BITS, HASH_BITS, PLACE_BITS = 6, 26, 31
BINS = 1 << BIN_BITS
EMPTY = "...."
#: Repeated k-mers of a text that are counted one by one.
FEW = 32
#: Ranges of ids of about equal row counts, and rows and number of the pieces into which they are cut.
RANGES, PIECE, PIECES = 256, 2000, 200_000


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = 3, select: int = 2) -> DataFrame:
    """df and the fingerprint of a text column."""
    own = df.columns
    t = "_omh_"
    while any(c.startswith(t) for c in own):
        t = "_" + t
    df = df.withColumn(t + "w", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda x: x != ""))
    w = F.col(t + "w")
    last = F.greatest(F.size(w) - k + 1, F.least(F.size(w), F.lit(1)))
    kmers = F.transform(F.slice(w, 1, last), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
    df = df.withColumn(t + "h", kmers)
    h = F.col(t + "h")
    # Occurrence numbers: few repeats are counted one by one, many by sorted runs.
    df = df.withColumn(t + "n", F.size(h) - F.size(F.array_distinct(h)))
    few = F.col(t + "n") <= FEW
    df = df.withColumn(t + "a", F.when((F.col(t + "n") > 0) & few, F.sort_array(h)))
    a = F.col(t + "a")
    df = df.withColumn(t + "d", F.when(a.isNotNull(), F.array_distinct(F.filter(a, lambda x, i: (i > 0) & (x == F.get(a, i - 1))))))
    again = F.col(t + "d")
    df = df.withColumn(t + "o", F.when(~few, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    o = F.col(t + "o")
    starts = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i)["h"] != F.get(o, i - 1)["h"]))
    df = df.withColumn(t + "r", F.when(o.isNotNull(), starts))
    r = F.col(t + "r")
    numbered = F.flatten(F.transform(r, lambda a, j: F.transform(F.slice(o, a + 1, F.coalesce(F.get(r, j + 1), F.size(o)) - a), lambda x, n: F.struct(F.xxhash64(x["h"], n).alias("h"), x["i"].alias("i")))))
    key = lambda x, i: F.shiftrightunsigned(x, 64 - BIN_BITS - HASH_BITS).bitwiseOR(_long(0)) * _long(1 << PLACE_BITS) + i
    before = lambda x, i: F.when(F.array_contains(again, x), F.size(F.filter(F.slice(h, 1, i), lambda y: y == x))).otherwise(F.lit(0))
    counted = F.transform(h, lambda x, i: key(F.xxhash64(x, before(x, i)), i))
    plain = F.transform(h, lambda x, i: key(F.xxhash64(x, F.lit(0)), i))
    packed = F.when(again.isNotNull(), counted).when(o.isNull(), plain).otherwise(F.transform(numbered, lambda x: key(x["h"], x["i"])))
    df = df.withColumn(t + "s", F.sort_array(packed))
    s = F.col(t + "s")
    bin_of = lambda x: F.shiftright(x, HASH_BITS + PLACE_BITS)
    least = F.filter(s, lambda x, i: (i < select) | (bin_of(F.get(s, i - select)) != bin_of(x)))
    place = lambda x: x.bitwiseAND(_long((1 << PLACE_BITS) - 1))
    kmer = lambda x: F.shiftright(x, PLACE_BITS).bitwiseAND(_long((1 << HASH_BITS) - 1))
    # what is selected, by bin and then place in the text
    by_place = F.transform(least, lambda x: (bin_of(x) * _long(1 << PLACE_BITS) + place(x)) * _long(1 << HASH_BITS) + kmer(x))
    df = df.withColumn(t + "l", F.sort_array(by_place))
    s = F.col(t + "l")
    tuple_of = lambda x, i: F.xxhash64(*[F.when(bin_of(F.get(s, i + j)) == bin_of(x), F.get(s, i + j).bitwiseAND(_long((1 << HASH_BITS) - 1))) for j in range(select)])
    head = lambda x, i: (i == 0) | (bin_of(F.get(s, i - 1)) != bin_of(x))
    # bin and 16 bits of the tuple's hash, of the first of each bin
    heads = F.filter(F.transform(s, lambda x, i: F.when(head(x, i), bin_of(x) * _long(1 << 16) + tuple_of(x, i).bitwiseAND(_long(0xFFFF)))), lambda x: x.isNotNull())
    df = df.withColumn(t + "g", heads)
    g = F.col(t + "g")
    bin_at = lambda i: F.shiftright(F.get(g, i), 16)
    # Bins ascend, so the gap before each is known from the one before it.
    gap = lambda n: F.repeat(F.lit(EMPTY), n.cast("int"))
    digits = lambda x: F.substring(F.hex(x.bitwiseAND(_long(0xFFFF)) + _long(1 << 16)), 2, 4)
    body = F.array_join(F.transform(g, lambda x, i: F.concat(gap(F.shiftright(x, 16) - F.coalesce(bin_at(i - 1), _long(-1)) - 1), digits(x))), "")
    tail = gap(_long(BINS - 1) - F.coalesce(bin_at(F.size(g) - 1), _long(-1)))
    return df.select(*own, F.lower(F.concat(body, tail)).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that are not empty in both."""
    bins = lambda x: F.regexp_extract_all(x, F.lit(".{4}"), F.lit(0))
    # 0: empty in both, 1: different, 2: equal
    state = F.zip_with(bins(a), bins(b), lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, 2).otherwise(1))
    used, equal = F.size(F.filter(state, lambda x: x > 0)), F.size(F.filter(state, lambda x: x == 2))
    return F.when(used == 0, F.lit(1.0)).otherwise(equal / used)


def _ranges(ids: DataFrame, rows: int) -> tuple[Column, Column]:
    """(range, piece in it) of an id and its hash (columns id, h), from RANGES ranges of about equal row counts.

    Ranges come from Spark's sample of the ids alone; what they hold is counted. A range
    of many rows is cut by even steps of its ids, or of the hash if it has one id only.
    """
    kind = ids.schema["id"].dataType
    found = ids.filter("id IS NOT NULL").repartitionByRange(RANGES, "id").groupBy(F.spark_partition_id().alias("p"))
    found = sorted(found.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["p"])
    size = max(PIECE, -(-rows // PIECES))
    row = [(None, None, rows - sum(r["n"] for r in found)), *[(r["low"], r["high"], r["n"]) for r in found]]
    lows = F.array(*[F.lit(x[0]).cast(kind) for x in row[1:]]) if found else F.array().cast(f"array<{kind.simpleString()}>")
    # binary search: the number of ranges that begin at or before the id
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(found).bit_length())))])

    def step(place: Column, power: Column) -> Column:
        there = F.get(lows, place + power - 1)
        return place + F.when(there.isNotNull() & (there <= F.col("id")), power).otherwise(0)

    steps = F.aggregate(powers, F.lit(0), step)
    at = F.when(F.col("id").isNull(), 0).otherwise(F.greatest(steps, F.lit(1)))
    number = lambda values, t: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{t}>"), F.col("range"))
    parts = number([max(1, -(-x[2] // size)) for x in row], "double")
    share = F.shiftrightunsigned("h", 1) / F.lit(2.0**63)
    if not isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType)):
        numeric = "long" if isinstance(kind, T.DateType) else "double"
        as_number = lambda c: (F.unix_date(c) if numeric == "long" else c.cast("double")).cast("double")
        edges = [number([x[i] for x in row], kind.simpleString()) for i in (0, 1)]
        low, high = (as_number(e) for e in edges)
        share = F.when(edges[0] == edges[1], share).when(low.isNotNull(), F.try_divide(as_number(F.col("id")) - low, high - low)).otherwise(share)
    else:
        one = number([x[0] == x[1] for x in row], "boolean")
        share = F.when(one, share).otherwise(F.lit(0.0))
    part = F.least(F.floor(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)) * parts), parts - 1).cast("long")
    return at, part


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text) -> id, text, _next: the text that follows by id, after the last that of the first; with _piece, _sent and _h.

    No task sorts the whole table: ids are cut into pieces of about PIECE rows, PIECES of
    them at most; the first row of each piece is also sent, as _sent = 1, to the end of the
    piece before it.
    """
    docs = docs.withColumn("h", F.xxhash64("text"))
    slim = docs.select("id", "h")
    at, part = _ranges(docs.select("id"), docs.count())
    placed = lambda df: df.withColumn("range", at).withColumn("piece", F.col("range") * F.lit(1 << 32) + part).drop("range")
    firsts = placed(slim).groupBy("piece").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "h")).alias("f"))
    # one row a piece
    ring = Window.orderBy("piece")
    every = Window.partitionBy()
    firsts = firsts.withColumn("to", F.coalesce(F.lag("piece").over(ring), F.max("piece").over(every))).select(F.col("piece").alias("of"), "to", F.col("f.id").alias("first"), F.col("f.h").alias("first_h"))
    dealt = placed(docs)
    heads = dealt.join(F.broadcast(firsts), (F.col("piece") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h")))
    heads = heads.withColumn("i", F.row_number().over(Window.partitionBy("of").orderBy("text"))).filter("i = 1").select("id", "text", "h", F.col("to").alias("piece"), F.lit(1).alias("sent"))
    both = dealt.withColumn("sent", F.lit(0)).unionByName(heads)
    return both.withColumn("next", F.lead("text").over(_run()))


def _run():
    """Rows of a piece, the one sent by the next piece last."""
    return Window.partitionBy("piece").orderBy("sent", F.col("id").asc_nulls_first(), "h", "text")


def fingerprints(docs: DataFrame, k: int = 3, select: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n_chars, edited (the text edited by the next one's start), fingerprint, edited_fingerprint, next_fingerprint. Each text is fingerprinted once, where its piece is sorted."""
    full = with_next(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    full = with_fingerprint(full, "text", "fingerprint", k, select)
    full = full.withColumn("next_fingerprint", F.lead("fingerprint").over(_run())).filter("sent = 0")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    full = full.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut)))
    full = with_fingerprint(full, "edited", "edited_fingerprint", k, select)
    return full.select(F.col("id").alias(id_col), "text", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = fingerprints(documents(spark, sf_dir))
    return full.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
