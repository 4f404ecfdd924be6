"""Language-model scores from an Elias-Fano n-gram trie of order three.

Training documents are those whose crc32(id as text) mod FOLDS is not HELD. Tokens
are a text's words in lower case and one end. The unigram base of a text is the
sum of log10((c + 0.5) / (N + 0.5 (V + 1))). The model is

    p(w | u v) = (c(u v w) + M[3] p(w | v)) / (c(u v) + M[3]),
    p(w | v)   = (c(v w) + M[2] p(w)) / (c(v) + M[2]),   p(w) as in the base,

with two starts before each text. The weights M do not depend on the corpus.

train() writes the model: n-grams are dealt to shards by their hash, and a shard of
an order is one trie of contexts, pointers and successors with quantised log10
counts (a shard of words also has their exact counts). An n-gram's probability is
its count's share, and the total of a context is the entry of the order below, so
that smoothing needs no shard but those of the n-gram itself.

score() reads that model. Documents are taken in chunks of about CHUNK bytes of
text. A chunk asks each shard for its distinct n-grams, once each however often
they occur, so that no frequent word or pair makes a shard large; the shard's trie
is opened where its requests arrive and answers by successor search, many requests at
once; the answers meet the chunk's documents again, and the chunk is scored. No vocabulary is handed
to tasks: words are asked for like pairs and triples. Requests are Elias-Fano coded.

A shard knows n-grams by 2 * HALF bits: of a million that the model has not, two
or so are taken for ones that it has, at the most rows that a shard is planned for.

docs must give the same rows in the same partitions each time it is read, as a
table does; score() raises if a chunk has other texts than when it asked. Defined
results: null or empty text is the end alone; a null id counts as the empty text
for the fold; rows with the same id are scored one by one; ids of any type; other
columns are not looked at; without training documents all counts are 0.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import documents, materialize
from .ngram_trie import HALF, NONE, STEPS, EliasFano, NgramTrie, quantise

U = np.uint64
FOLDS, HELD = 5, 1
ORDER = 3
#: Weight of the lower order, by order.
M = {2: 32.0, 3: 16.0}
#: Bytes of text of a chunk: about 15 bytes each in a task.
CHUNK = 8 << 20
#: N-grams of a shard, about: 50 bytes each in a task.
SHARD = 2_000_000
#: Keys that a shard is asked for at once, about (one request may have more): 250 bytes each in a task.
ASK = 1 << 18
#: Bytes of text that make a token, at least about.
TOKEN_BYTES = 6
END = U(0xE17B5EC0A9D3F241)
START = U(0x51C6D3A7F0E2B98D)


def held_out(doc_id):
    """Column: whether a document is kept from training."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == HELD


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some rows, each with its end, and offsets by row."""
    starts, ends, row, folded = W.words(data, offsets)
    h = W.word_hashes(starts, ends, folded)
    rows = len(offsets) - 1
    at = np.searchsorted(row, np.arange(rows + 1)) + np.arange(rows + 1)
    out = np.full(len(h) + rows, END, U)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = h
    return out, at


def before(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each, START at the start of a row."""
    out = np.empty_like(h)
    out[1:], out[at[:-1]] = h[:-1], START
    return out


def places(h: np.ndarray, at: np.ndarray, shards: int):
    """For each order, shard << 2 * HALF | context << HALF | successor of the n-gram that ends at each token."""
    successor = W.mix(h ^ U(0xA24BAED4963EE407)) >> U(64 - HALF)
    v = before(h, at)
    # the second word before: that of the word before, START twice at a row's start
    u = before(v, at)
    contexts = (h, W.mix(v + U(0x9E3779B97F4A7C15)), W.mix(W.mix(u) * U(0x9FB21C651E98DF25) + v))
    for n, context in enumerate(contexts):
        name = W.mix(W.mix(context * U(0xC2B2AE3D27D4EB4F) + h) + U(n))
        shard = (name >> U(32)) * U(shards) >> U(32)
        yield (shard << U(2 * HALF)) | (W.mix(context ^ U(0x165667B19E3779F9)) >> U(64 - HALF) << U(HALF)) | successor


def chunks(batches, size: int):
    """(chunk, batch of its rows, bytes, offsets). The name of a chunk is a digest of its texts."""
    for batch in batches:
        for row, data, offsets in W.pieces(batch.column("text"), size):
            name = xxhash.xxh64(data)
            name.update(offsets)
            yield name.intdigest() >> 1, batch.slice(row, len(offsets) - 1), data, offsets


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and their counts."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _cut(values: np.ndarray, shards: int, order: int):
    """(number of shard and order, first, last) of the runs of ascending places that lie in one shard."""
    shard = (values >> U(2 * HALF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    for a, b in zip(first.tolist(), np.append(first[1:], len(values)).tolist()):
        yield order * shards + int(shard[a]), a, b


KEY = U((1 << 2 * HALF) - 1)


def _coded(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending keys, and their counts in as few bytes as hold them."""
    out = EliasFano.build(keys & KEY, 1 << 2 * HALF).to_bytes()
    if counts is None:
        return out
    kind = np.min_scalar_type(int(counts.max()))
    return out + counts.astype(kind).tobytes()


def _decoded(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    sequence, end = EliasFano.view(raw)
    keys = sequence.all()
    width = (len(raw) - end) // max(1, len(keys))
    return keys, raw[end:].view(f"<u{width}").astype(np.int64) if width else np.empty(0, np.int64)


@dataclass
class Model:
    """table: (sid, trie, counts), a row for each shard and order. total, distinct: training tokens; starts: training documents."""

    table: DataFrame
    shards: int
    total: int
    distinct: int
    starts: int


def _count(shards: int, size: int):
    def run(batches):
        for _, rows, data, offsets in chunks(batches, size):
            h, at = token_hashes(data, offsets)
            keep = np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False), np.diff(at))
            for n, place in enumerate(places(h, at, shards)):
                found, counts = _distinct(place[keep])
                sids, data = [], []
                for sid, a, b in _cut(found, shards, n):
                    sids.append(sid)
                    data.append(_coded(found[a:b], counts[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(data, pa.large_binary()).cast(pa.binary())], names=["sid", "data"])

    return run


def _tries(shards: int):
    """Rows sorted by sid -> the trie of each."""

    def build(sid: int, held: list):
        keys, counts = (np.concatenate(x) for x in zip(*map(_decoded, held)))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        trie = NgramTrie.build(keys, quantise(np.log10(counts))).to_bytes()
        exact = counts.astype("<i8").tobytes() if sid < shards else None
        row = [pa.array([sid], pa.int64()), pa.array([trie], pa.binary()), pa.array([exact], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(row, names=["sid", "trie", "counts", "distinct", "total"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for sid, data in zip(batch.column("sid").to_pylist(), batch.column("data")):
                if sid != now and held:
                    yield build(now, held)
                    held = []
                now = sid
                held.append(data.as_buffer())
        if held:
            yield build(now, held)

    return run


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts all training documents and writes the model in the shared folder."""
    spark = docs.sparkSession
    docs = _named(docs, id_col, text_col)
    size, starts = docs.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-tasks // ORDER), -(-(size or 0) // TOKEN_BYTES // SHARD), 1)
    found = docs.select("text", "held_out").mapInArrow(_count(shards, CHUNK), "sid bigint, data binary")
    dealt = found.repartitionById(max(tasks, ORDER * shards), F.col("sid").cast("int")).sortWithinPartitions("sid")
    table = materialize(dealt.mapInArrow(_tries(shards), "sid bigint, trie binary, counts binary, distinct bigint, total bigint"), "lm-model")
    total, distinct = table.filter(F.col("sid") < shards).agg(F.sum("total"), F.sum("distinct")).first()
    return Model(table, shards, total or 0, distinct or 0, starts)


def _ask(shards: int, size: int):
    def run(batches):
        for name, _, data, offsets in chunks(batches, size):
            h, at = token_hashes(data, offsets)
            for n, place in enumerate(places(h, at, shards)):
                found, _ = _distinct(place)
                sids, data = [], []
                for sid, a, b in _cut(found, shards, n):
                    sids.append(sid)
                    data.append(_coded(found[a:b]))
                empty = pa.nulls(len(sids), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array([name] * len(sids), pa.int64()), pa.array(data, pa.large_binary()).cast(pa.binary()), empty], names=["sid", "chunk", "data", "counts"])

    return run


def _answer(shards: int):
    """Rows sorted by sid, the trie first -> (chunk, sid, values): codes of the keys asked for, exact counts for words."""

    def values(trie: NgramTrie | None, exact: np.ndarray | None, sid: int, keys: np.ndarray) -> np.ndarray:
        if trie is None:
            return np.zeros(len(keys), "<i8") if sid < shards else np.full(len(keys), NONE, "<i2")
        if sid >= shards:
            return trie.lookup(keys)
        # words: the code's place is that of the count
        at = trie.find(keys)
        return np.where(at >= 0, exact[at], 0).astype("<i8")

    def answers(trie, exact, sid: int, names: list[int], asked: list[np.ndarray]):
        """A row for each of some requests to one shard, which is searched for all of them at once."""
        found = values(trie, exact, sid, np.concatenate(asked))
        at = np.cumsum([0, *map(len, asked)]).tolist()
        data = [found[a:b].tobytes() for a, b in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([sid] * len(names), pa.int64()), pa.array(data, pa.binary())], names=["chunk", "sid", "data"])

    def run(batches):
        now, trie, exact, names, asked, size = None, None, None, [], [], 0
        for batch in batches:
            for sid, name, data, counts in zip(batch.column("sid").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data"), batch.column("counts")):
                if names and (sid != now or size >= ASK):
                    yield answers(trie, exact, now, names, asked)
                    names, asked, size = [], [], 0
                if name is None:
                    now, trie = sid, NgramTrie.view(np.frombuffer(data.as_buffer(), np.uint8))
                    exact = np.frombuffer(counts.as_buffer(), "<i8") if counts.is_valid else None
                    continue
                if sid != now:
                    now, trie, exact = sid, None, None
                names.append(name)
                asked.append(_decoded(data.as_buffer())[0])
                size += len(asked[-1])
        if names:
            yield answers(trie, exact, now, names, asked)

    return run


def _ship(kind, size: int):
    """Chunks of documents as rows: (chunk, sid null, data: texts, compressed, ids, held_out)."""

    def run(batches):
        for name, rows, raw, at in chunks(batches, size):
            n = len(rows)
            body = at.astype("<i8").tobytes() + raw.tobytes()
            data = struct.pack("<qq", n, len(body)) + pa.compress(body, "zstd", asbytes=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([rows.column(c)])) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.nulls(1, pa.int64()), pa.array([data], pa.binary()), *lists], names=["chunk", "sid", "data", "ids", "held"])

    return run


def _shipped(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n, size = struct.unpack("<qq", data[:16])
    body = np.frombuffer(pa.decompress(data[16:], size, "zstd"), np.uint8)
    return body[8 * (n + 1) :], body[: 8 * (n + 1)].view("<i8")


def _order(place: np.ndarray) -> np.ndarray:
    """Indices that sort some places: these are sorted with the index in place of their last bits, which is several times as fast as argsort; what those bits decide comes after."""
    bits = len(place).bit_length()
    less = max(0, int(place.max()).bit_length() + bits - 64)
    order = (np.sort((place >> U(less) << U(bits)) | np.arange(len(place), dtype=U)) & U((1 << bits) - 1)).astype(np.int64)
    ordered = place[order]
    return order if less == 0 or (ordered[1:] >= ordered[:-1]).all() else order[np.argsort(ordered, kind="stable")]


def chunk_scores(h: np.ndarray, at: np.ndarray, shards: int, answers: list[np.ndarray], model: tuple[int, int, int]):
    """(known tokens, base, score) by row. answers: by order, values of its distinct n-grams in ascending order of their places."""
    total, distinct, starts = model
    counts = []
    for n, place in enumerate(places(h, at, shards)):
        order = _order(place)
        ordered = place[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        if int(new.sum()) != len(answers[n]):
            raise ValueError("documents have changed between two readings; write them to a table first")
        values = answers[n].astype(np.float64) if n == 0 else np.where(answers[n] == NONE, 0.0, 10.0 ** (answers[n] / STEPS))
        out = np.empty(len(h))
        out[order] = values[np.cumsum(new) - 1]
        counts.append(out)

    def context(c):
        """Count of what stands before each token: starts before the first."""
        out = np.empty_like(c)
        out[1:], out[at[:-1]] = c[:-1], starts
        return out

    c1, c2, c3 = counts
    p1 = (c1 + 0.5) / (total + 0.5 * (distinct + 1))
    p2 = (c2 + M[2] * p1) / (context(c1) + M[2])
    p3 = (c3 + M[3] * p2) / (context(c2) + M[3])
    sums = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.empty(0)
    return sums((c1 > 0).astype(np.int64)), sums(np.log10(p1)), sums(np.log10(p3))


def _score(shards: int, model: tuple[int, int, int], kind):
    """Rows sorted by chunk, documents first, then answers by sid -> scores."""

    def finish(rows, answers):
        """Rows are several where chunks have the same texts."""
        if not rows:
            raise ValueError("documents have changed between two readings; write them to a table first")
        data = rows[0][2]
        h, at = token_hashes(*_shipped(data))
        lists = [np.concatenate([np.frombuffer(a, "<i8" if n == 0 else "<i2") for a in part]) if part else np.empty(0, "<i2") for n, part in enumerate(answers)]
        known, base, value = chunk_scores(h, at, shards, lists, model)
        for ids, held, _ in rows:
            yield result(ids, held, at, known, base, value)

    def result(ids, held, at, known, base, value):
        arrays = [ids, held, pa.array(np.diff(at)), pa.array(known, pa.int64()), pa.array(np.full(len(known), model[0], np.int64)), pa.array(base), pa.array(value)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        now, last, rows, answers = None, None, [], [[] for _ in range(ORDER)]
        for batch in batches:
            for name, sid, data, ids, held in zip(batch.column("chunk").to_pylist(), batch.column("sid").to_pylist(), batch.column("data"), batch.column("ids"), batch.column("held")):
                if name != now:
                    if now is not None:
                        yield from finish(rows, answers)
                    now, last, rows, answers = name, None, [], [[] for _ in range(ORDER)]
                if sid is None:
                    rows.append((ids.values, held.values, data.as_buffer()))
                elif sid != last:
                    answers[sid // shards].append(data.as_buffer())
                    last = sid
        if now is not None:
            yield from finish(rows, answers)

    return run


def score(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Without a model, docs are trained on first."""
    model = model or train(docs, id_col, text_col)
    spark, shards = docs.sparkSession, model.shards
    docs = _named(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ORDER * shards)
    # the same columns as below, so that batches and chunks are the same
    asked = docs.mapInArrow(_ask(shards, CHUNK), "sid bigint, chunk bigint, data binary, counts binary")
    tries = model.table.select("sid", F.lit(None).cast("long").alias("chunk"), F.col("trie").alias("data"), "counts")
    met = tries.unionByName(asked).repartitionById(tasks, F.col("sid").cast("int")).sortWithinPartitions("sid", F.col("chunk").asc_nulls_first())
    answers = materialize(met.mapInArrow(_answer(shards), "chunk bigint, sid bigint, data binary"), "lm-answers")
    lists = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType()))])
    shipped = docs.mapInArrow(_ship(kind, CHUNK), lists)
    both = shipped.unionByName(answers, allowMissingColumns=True).repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("sid").asc_nulls_first())
    fields = [T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    out = both.mapInArrow(_score(shards, (model.total, model.distinct, model.starts), kind), T.StructType(fields))
    return out.withColumnRenamed("doc_id", id_col)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
