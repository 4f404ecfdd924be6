"""Secret scanning over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams. One pass over
the texts writes the inverted index: (trigram, text key) postings of the trigrams
that some query names. Queries are answered by intersecting and uniting postings;
only texts that satisfy a rule's query are verified with its expression. A rule
without a mandatory trigram (a run of hexadecimal digits) scans all texts.

Spans are in code points, end exclusive. Defined results: null or empty text has
no spans; equal texts have equal results, whatever their ids; a rule's matches
are leftmost and do not overlap, and those shorter than its least length are
dropped after they have used up their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lower_ascii, materialize
from .trigrams import trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """kind: name in reports. least: least length of the group. any_case: letters in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The three base rules, then those that the method adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
)
RULES = BASE + ADDED

#: Up to this many candidate keys (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def text_key(text: Column) -> Column:
    """Texts are posted under their hash: copies share postings, and a collision only adds a candidate to verify."""
    return F.xxhash64(text)


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The postings (trigram, key) of the rules' trigrams, written in the shared folder, and the vocabulary."""
    vocabulary = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    text = F.col(text_col)
    folded = docs.select(text_key(text).alias("key"), lower_ascii(text).alias("_t"))
    found = F.array(*[F.when(F.contains("_t", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)])
    postings = folded.select("key", F.explode(F.array_compact(found)).alias("trigram"))
    return materialize(postings.select("trigram", "key"), "trigram-index"), vocabulary


def _holds(query, vocabulary: list[str]) -> Column:
    """Whether the postings of a key (bits by trigram, 62 a column) satisfy a query."""
    if isinstance(query, str):
        i = vocabulary.index(query)
        return F.col(f"_m{i // 62}").bitwiseAND(F.lit(1 << (i % 62))) != 0
    parts = [_holds(q, vocabulary) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def candidates(index: DataFrame, vocabulary: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, hits): keys whose postings satisfy the query of a rule; bit i of hits is rule i. Rules without trigrams have no candidates here."""
    words = range(-(-len(vocabulary) // 62))
    bit = lambda w: F.get(F.array(*[F.lit(1 << (i % 62) if i // 62 == w else 0).cast("long") for i in range(len(vocabulary))]), F.col("trigram"))
    masks = index.groupBy("key").agg(*[F.bit_or(bit(w)).alias(f"_m{w}") for w in words])
    hits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query is not True:
            hits = hits + F.when(_holds(query, vocabulary), F.lit(1 << i)).otherwise(F.lit(0))
    return masks.select("key", hits.alias("hits")).filter("hits != 0")


def with_candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs and _hits: which rules' queries the index says that a text satisfies."""
    index, vocabulary = build_index(docs, rules, text_col)
    found = materialize(candidates(index, vocabulary, rules), "secret-candidates")
    side = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    joined = docs.withColumn("_key", text_key(F.col(text_col))).join(side.withColumnRenamed("key", "_key").withColumnRenamed("hits", "_hits"), "_key", "left")
    return joined.drop("_key").withColumn("_hits", F.coalesce("_hits", F.lit(0).cast("long")))


def _pieces(df: DataFrame, rule: Rule, i: int, text: Column) -> DataFrame:
    """+ _m: the rule's matches, _p: what lies before, between and after them, _v: lengths of the group, null without a match."""
    scan = F.lit(True) if trigram_query(rule.pattern) is True else F.col("_hits").bitwiseAND(F.lit(1 << i)) != 0
    pattern = F.lit(rule.java)
    df = df.withColumn(f"_m{i}", F.when(scan, F.regexp_extract_all(text, pattern, F.lit(0))))
    some = F.size(f"_m{i}") > 0
    df = df.withColumn(f"_p{i}", F.when(some, F.split(text, rule.java, -1)))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else F.col(f"_m{i}")
    return df.withColumn(f"_v{i}", F.when(some, group))


def _spans(df: DataFrame, rule: Rule, i: int) -> DataFrame:
    """+ _s: array of (start, kind, end).

    A match starts where all pieces and matches before it end. The running sum goes
    by blocks of about sqrt(n) matches, so that a text full of matches takes
    n ** 1.5 steps and not n ** 2.
    """
    n = F.size(f"_m{i}")
    df = df.withColumn(f"_a{i}", F.when(F.col(f"_p{i}").isNotNull(), F.transform(f"_m{i}", lambda m, k: (F.char_length(m) + F.char_length(F.get(F.col(f"_p{i}"), k))).cast("long"))))
    df = df.withColumn(f"_c{i}", F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int")))
    add = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.col(f"_c{i}")).cast("int")), lambda b: add(F.slice(F.col(f"_a{i}"), b * F.col(f"_c{i}") + 1, F.col(f"_c{i}"))))
    df = df.withColumn(f"_b{i}", F.when(F.col(f"_a{i}").isNotNull(), blocks))
    df = df.withColumn(f"_o{i}", F.when(F.col(f"_b{i}").isNotNull(), F.transform(F.col(f"_b{i}"), lambda _, k: add(F.slice(F.col(f"_b{i}"), F.lit(1), k)))))

    def span(m: Column, k: Column) -> Column:
        block = F.floor(k / F.col(f"_c{i}")).cast("int")
        before = F.get(F.col(f"_o{i}"), block) + add(F.slice(F.col(f"_a{i}"), block * F.col(f"_c{i}") + 1, k - block * F.col(f"_c{i}")))
        start = before + F.char_length(F.get(F.col(f"_p{i}"), k))
        return F.struct(start.alias("start"), F.lit(i).alias("kind"), (start + F.char_length(m)).alias("end"), F.char_length(F.get(F.col(f"_v{i}"), k)).alias("size"))

    kept = F.filter(F.transform(F.col(f"_m{i}"), span), lambda s: s["size"] >= rule.least)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,size:int>>")
    return df.withColumn(f"_s{i}", F.when(F.col(f"_o{i}").isNotNull(), kept).otherwise(none))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs (but a column spans) and spans: array of (start, kind, end, size) of all rules, by start, then kind as listed."""
    own = docs.columns
    # the other columns travel as one, so that their names can't clash
    df = with_candidates(docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_text")), rules, "_text")
    for i, rule in enumerate(rules):
        df = _spans(_pieces(df, rule, i, F.col("_text")), rule, i)
    return df.select(*[F.col("_row")[c].alias(c) for c in own if c != "spans"], F.array_sort(F.concat(*[F.col(f"_s{i}") for i in range(len(rules))])).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with each secret replaced by mark: rule after rule, so that a span of two kinds is replaced once. A null text stays null."""
    own = docs.columns
    # the other columns travel as one, so that their names can't clash
    df = with_candidates(docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_text")), rules, "_text")
    for i, rule in enumerate(rules):
        df = _pieces(df, rule, i, F.col("_text"))
        pieces, values, least = F.col(f"_p{i}"), F.col(f"_v{i}"), rule.least
        put = lambda m, k: F.concat(F.get(pieces, k), F.when(F.char_length(F.get(values, k)) >= least, F.lit(mark)).otherwise(m))  # noqa: B023, E731
        done = F.concat(F.array_join(F.transform(F.col(f"_m{i}"), put), ""), F.element_at(pieces, -1))
        df = df.withColumn("_text", F.when(pieces.isNotNull(), done).otherwise(F.col("_text")))
    return df.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in own])


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text")).withColumn("_base", F.filter("spans", lambda s: s["kind"] < len(BASE)))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(_joined(F.col("_base"), RULES), 256).alias("base_sha256"), _joined(F.col("spans"), RULES).alias("spans"),
    )


def _sql_rule(i: int, rule: Rule) -> str:
    re = rule.pattern.replace("'", "''")
    flag = "'i'" if rule.any_case else "''"
    fold = f"'(?i){re}'" if rule.any_case else f"'{re}'"
    return f"""
  SELECT doc_id, {i} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda k: struct_pack(
    s := coalesce(list_sum(list_transform(p[:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0), e := length(m[k]), v := length(g[k])))) AS x
  FROM (SELECT doc_id, regexp_extract_all(t, '{re}', 0, {flag}) AS m, regexp_extract_all(t, '{re}', {rule.group}, {flag}) AS g, string_split_regex(t, {fold}) AS p FROM d) WHERE len(m) > 0"""


def oracle() -> str:
    names = "['" + "', '".join(r.kind for r in RULES) + "']"
    least = "[" + ", ".join(str(r.least) for r in RULES) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate(RULES))}),
s AS (SELECT doc_id, kind, x.s AS s, {names}[kind + 1] || ':' || x.s::BIGINT || ':' || (x.s + x.e)::BIGINT AS span FROM r WHERE x.v >= {least}[kind + 1]),
g AS (
  SELECT doc_id, string_agg(span, ',' ORDER BY s, kind) AS spans, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
         count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
