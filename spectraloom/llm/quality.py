"""Quality classifier by co-training of a text view and a metadata view.

The text view sees which letter runs and sign runs a text has; the metadata view
sees source, language, length and layout. Both learn from a bounded sample of
labelled rows. In each round, each view scores all rows without a label on the
executors, and the other view learns from those that it is surest of. At last both
are calibrated on labelled rows that neither learned from, and their log-odds are
combined. One head tells bad quality, one toxic text; a document is kept if both
stay under their threshold. All documents are scored, whole, in one pass.

Bounds of what the driver sees: LABELLED labelled rows, chosen by the hash of their
id; FEATURES letter and sign runs; a histogram of SURE_STEPS buckets a unit of
log-odds, and EXCHANGE rows, for each head and view in a round. Every source and
language among these rows has an indicator. Defined results: null text is the empty
one; a null id is a row without a label; rows of equal id and text are one row to
learn from; a head without two classes in its sample scores everything 0.0; without
labels all is kept; columns of the input pass through, and added ones get the names
score, toxic and keep, with as many "_" before as a clash needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import documents, hash60, materialize

LABELLED = 8_000
FEATURES = 3_000
ROUNDS = 3
#: Rows that a view labels for the other in a round, by class as in the sample.
EXCHANGE = 400
#: Columns of layout_features().
LAYOUT = 13
SURE = 0.95
#: Buckets by which the executors count how sure a view is: a unit of log-odds, and all of them.
SURE_STEPS, SURE_BUCKETS = 64, 4096
CALIBRATION = 0.25
THRESHOLD = 0.5


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row): runs of letters, and runs of signs."""
    low = W.folded(data)
    letter = ((low - np.uint8(97)) < 26) | (low >= 128)
    digit = (low - np.uint8(48)) < 10
    space = (low == 32) | ((low - np.uint8(9)) < 5)
    out, rows = [], []
    for k, mask in enumerate((letter, ~(letter | digit | space))):
        starts, ends, row = W.runs(mask, offsets)
        out.append(W.mix(W.word_hashes(starts, ends, low) + np.uint64(k)))
        rows.append(row)
    return np.concatenate(out), np.concatenate(rows)


def layout_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: log sizes, and shares of lines, capitals, digits, signs, white space and bytes beyond ASCII."""
    size = np.diff(offsets)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    upper, digit = (data - np.uint8(65)) < 26, (data - np.uint8(48)) < 10
    lower, high = (data - np.uint8(97)) < 26, data >= 128
    space, line = (data == 32) | ((data - np.uint8(9)) < 5), data == 10
    sign = ~(upper | digit | lower | high | space)
    plain = (data == 46) | (data == 44)
    n = np.maximum(size, 1)
    lines = total(line)
    share = [total(m) / n for m in (upper, digit, sign, sign & ~plain, space, high)]
    return np.column_stack([np.log1p(size), np.log1p(lines), np.log1p(size / (lines + 1)), *share, *[np.sqrt(s) for s in share[:4]]])


@dataclass
class Linear:
    """A logistic model over a view, with its calibration."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x) -> np.ndarray:
        return x.dot(self.weights) + self.bias

    def odds(self, x) -> np.ndarray:
        return self.raw(x) * self.slope + self.shift


class Sparse:
    """Rows of marked columns."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.shape = rows, cols, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.shape[1])

    def take(self, idx: np.ndarray) -> Sparse:
        new = np.full(self.shape[0], -1)
        new[idx] = np.arange(len(idx))
        keep = new[self.rows] >= 0
        return Sparse(new[self.rows[keep]], self.cols[keep], (len(idx), self.shape[1]))


class Mixed:
    """Dense columns, then marked ones."""

    def __init__(self, dense: np.ndarray, marks: Sparse):
        self.dense, self.marks, self.shape = dense, marks, (len(dense), dense.shape[1] + marks.shape[1])

    def dot(self, w: np.ndarray) -> np.ndarray:
        k = self.dense.shape[1]
        return self.dense.dot(w[:k]) + self.marks.dot(w[k:])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([self.dense.T.dot(g), self.marks.back(g)])

    def take(self, idx: np.ndarray) -> Mixed:
        return Mixed(self.dense[idx], self.marks.take(idx))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x, y: np.ndarray, rate: float = 0.05, steps: int = 200, shrink: float = 1e-4) -> Linear:
    """Logistic regression with balanced classes, by Adam over all rows."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = (_sigmoid(x.dot(w) + b) - y) * weight
        grad = np.append(x.back(g) + shrink * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Linear(w, float(b))


def calibrate(model: Linear, x, y: np.ndarray) -> Linear:
    """Platt scaling with smoothed targets."""
    raw = model.raw(x)
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    scale = max(raw.std(), 1e-9)
    for _ in range(300):
        d = _sigmoid(a * raw + b) - target
        a, b = a - 2 * (d * raw).mean() / scale**2, b - 2 * d.mean()
    model.slope, model.shift = float(max(a, 0.0)), float(b)
    return model


VIEWS = {"text": "meta", "meta": "text"}  # each with the one that it labels for


@dataclass
class Head:
    text: Linear
    meta: Linear
    mix: tuple[float, float, float]

    def probability(self, text, meta) -> np.ndarray:
        a, b, c = self.mix
        return _sigmoid(a * self.text.odds(text) + b * self.meta.odds(meta) + c)


class Pupil:
    """A head while it learns: the rows that each view knows, with their class."""

    def __init__(self, y: np.ndarray):
        """y: 1 or 0 by row, -1 without a label. able: whether both classes are there to learn from and to calibrate on."""
        own = np.flatnonzero(y >= 0)
        self.y, self.hold = y, own[np.arange(len(own)) % round(1 / CALIBRATION) == 0]
        train = np.setdiff1d(own, self.hold)
        self.able = len(own) >= 20 and all(0 < y[rows].mean() < 1 for rows in (train, self.hold))
        self.rate = y[train].mean() if self.able else 0.0
        self.known = {name: dict(zip(train.tolist(), y[train].tolist())) for name in VIEWS}

    def learn(self, views: dict) -> dict[str, Linear]:
        out = {}
        for name, x in views.items():
            rows = np.array(sorted(self.known[name]))
            out[name] = calibrate(fit(x.take(rows), np.array([self.known[name][r] for r in rows.tolist()])), x.take(self.hold), self.y[self.hold])
        return out

    def head(self, views: dict) -> Head:
        models = self.learn(views)
        odds = np.column_stack([models[name].odds(x.take(self.hold)) for name, x in views.items()])
        return Head(models["text"], models["meta"], calibrate_mix(odds, self.y[self.hold]))

    def most(self, label: int) -> int:
        """Rows of a class that a view labels in a round."""
        return max(1, round(EXCHANGE * (self.rate if label else 1 - self.rate)))


def calibrate_mix(odds: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Non-negative weights of the views' log-odds."""
    w = np.array([0.5, 0.5, 0.0])
    x = np.column_stack([np.clip(odds, -12, 12), np.ones(len(y))])
    for _ in range(500):
        w = w - 0.02 * x.T.dot(_sigmoid(x.dot(w)) - y) / len(y)
        w[:2] = np.maximum(w[:2], 0)
    return tuple(float(v) for v in w)


@dataclass
class Model:
    """All that scoring needs; a few hundred KB, whatever the corpus."""

    hashes: np.ndarray
    sources: dict
    langs: dict
    centre: np.ndarray
    scale: np.ndarray
    heads: dict[str, Head | None]

    def text(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> Sparse:
        return marked(self.hashes, hashes, rows, n)

    def meta(self, layout: np.ndarray, source: list, lang: list) -> Mixed:
        rows, cols, first = [], [], 0
        for places, values in ((self.sources, source), (self.langs, lang)):
            at = np.array([places.get(v, -1) for v in values], np.int64)
            rows.append(np.flatnonzero(at >= 0))
            cols.append(at[rows[-1]] + first)
            first += len(places)
        return Mixed((layout - self.centre) / self.scale, Sparse(np.concatenate(rows), np.concatenate(cols), (len(layout), first)))


def marked(names: np.ndarray, hashes: np.ndarray, rows: np.ndarray, n: int) -> Sparse:
    """Which of names each of n rows has."""
    if not len(names):
        return Sparse(np.empty(0, int), np.empty(0, int), (n, 0))
    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    hit = names[at] == hashes
    cell = np.unique(rows[hit].astype(np.int64) * len(names) + at[hit])
    return Sparse(cell // len(names), cell % len(names), (n, len(names)))


def _sample(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Written labelled rows with their text and marks."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().join(marks, "doc_id")
    ids = ids.select("doc_id", "bad", "toxic", hash60(F.lit("quality"), F.col("doc_id")).alias("h"))
    chosen = materialize(ids.orderBy("h", "doc_id").limit(LABELLED), "quality-sample")
    rows = docs.join(F.broadcast(chosen), "doc_id")
    # an id may have any number of texts: the bound is on rows
    some = rows.select("key").distinct().orderBy("key").limit(LABELLED)
    rows = rows.join(F.broadcast(some), "key").dropDuplicates(["key"])
    return materialize(rows.select("doc_id", "key", "text", "source", "lang", "bad", "toxic"), "quality-rows")


def _vocabulary(rows: DataFrame) -> np.ndarray:
    """Ascending hashes of the FEATURES runs that tell the classes of the sample best."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in W.pieces(batch.column("text")):
                h, of = text_features(data, offsets)
                pair = np.unique(np.column_stack([of.astype(np.int64), h.view(np.int64)]), axis=0)
                marks = [pa.compute.take(batch.column(c).slice(row, len(offsets) - 1), pa.array(pair[:, 0])) for c in ("bad", "toxic")]
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1]), *marks], names=["h", "bad", "toxic"])

    rows = rows.select("text", "bad", "toxic")
    totals = rows.agg(*[F.count_if(F.col(c) == v).alias(f"{c}{v}") for c in ("bad", "toxic") for v in (1, 0)]).first()
    seen = rows.mapInArrow(run, "h bigint, bad int, toxic int").groupBy("h").agg(*[F.count_if(F.col(c) == v).alias(f"{c}{v}") for c in ("bad", "toxic") for v in (1, 0)])

    def strength(c: str):
        # log-odds of presence by class, over its standard deviation
        p, q = F.col(f"{c}1"), F.col(f"{c}0")
        a, b = (max(totals[f"{c}{v}"], 1) for v in (1, 0))
        z = F.log((p + 0.5) / (a - p + 0.5)) - F.log((q + 0.5) / (b - q + 0.5))
        return F.when(p + q >= 4, F.abs(z) / F.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))).otherwise(0.0)

    best = seen.select("h", F.greatest(strength("bad"), strength("toxic")).alias("z")).filter("z > 0").orderBy(F.desc("z"), "h").limit(FEATURES)
    return np.sort(best.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def featured(rows: DataFrame, names: np.ndarray) -> DataFrame:
    """The text of rows replaced by which of names it has (cols), and its layout."""
    own = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(names)
    schema = T.StructType([*[rows.schema[c] for c in own], T.StructField("cols", T.ArrayType(T.IntegerType())), T.StructField("layout", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for row, data, offsets in W.pieces(batch.column("text")):
                n = len(offsets) - 1
                x, layout = marked(shared.value, *text_features(data, offsets), n), layout_features(data, offsets)
                part = batch.slice(row, n)
                lists = (np.searchsorted(x.rows, np.arange(n + 1)), x.cols.astype(np.int32)), (np.arange(n + 1) * layout.shape[1], layout.ravel())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *[pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v)) for at, v in lists]], names=[*own, "cols", "layout"])

    return rows.mapInArrow(run, schema)


class Rows:
    """Rows that came from featured()."""

    def __init__(self, table, width: int):
        self.n, self.width = table.num_rows, width
        lists = {c: table[c].combine_chunks() if isinstance(table, pa.Table) else table.column(c) for c in ("cols", "layout")}
        self.cols = lists["cols"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.of = np.repeat(np.arange(self.n), lists["cols"].value_lengths().to_numpy(zero_copy_only=False))
        self.layout = lists["layout"].flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1) if self.n else np.zeros((0, LAYOUT))
        self.source, self.lang = table["source"].to_pylist(), table["lang"].to_pylist()

    def add(self, more: Rows) -> None:
        self.cols, self.of = np.concatenate([self.cols, more.cols]), np.concatenate([self.of, more.of + self.n])
        self.layout = np.vstack([self.layout, more.layout])
        self.source, self.lang, self.n = self.source + more.source, self.lang + more.lang, self.n + more.n

    def views(self, model: Model) -> dict:
        return {"text": Sparse(self.of, self.cols, (self.n, self.width)), "meta": model.meta(self.layout, self.source, self.lang)}


def _surest(free: DataFrame, model: Model, pupils: dict, linear: dict, taken: dict) -> pa.Table:
    """Of all rows without a label, those that a view is surest of: head, view, label, and the row. linear, taken: by head and view, its model and the keys that the other view knows."""
    keys = [(h, v, label) for h, v in linear for label in (1, 0)]
    shared = free.sparkSession.sparkContext.broadcast((model, linear, taken))
    least = float(np.log(SURE / (1 - SURE)))

    def odds_of(batch):
        """By key, log-odds of the label; below 0 for rows that are not to be labelled."""
        m, linear, taken = shared.value
        views = Rows(batch, len(m.hashes)).views(m)
        key, out = batch.column("key").to_numpy(), {}
        for (h, v), line in linear.items():
            odds = line.odds(views[v])
            open_ = batch.column(h).is_null().to_numpy(zero_copy_only=False) & ~np.isin(key, taken[h, v])
            for label in (1, 0):
                out[h, v, label] = np.where(open_, odds if label else -odds, -1.0)
        return out

    def bucket(odds):
        return np.minimum(odds * SURE_STEPS, SURE_BUCKETS - 1).astype(np.int64)

    def count(batches):
        total = np.zeros((len(keys), SURE_BUCKETS), np.int64)
        for batch in batches:
            for i, odds in enumerate(odds_of(batch).values()):
                total[i] += np.bincount(bucket(odds[odds >= least]), minlength=SURE_BUCKETS)
        i, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), pa.array(total[i, b])], names=["i", "b", "n"])

    found = free.mapInArrow(count, "i bigint, b bigint, n bigint").groupBy("i", "b").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(keys), SURE_BUCKETS), np.int64)
    total[found["i"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    most = [pupils[h].most(label) for h, _, label in keys]
    above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
    floors = [int(np.flatnonzero(a >= k).max()) if a[0] >= k else 0 for a, k in zip(above, most)]

    def pick(batches):
        for batch in batches:
            odds = odds_of(batch)
            for i, k in enumerate(keys):
                hit = pa.array(np.flatnonzero((odds[k] >= least) & (bucket(odds[k]) >= floors[i])))
                if len(hit):
                    part = batch.take(hit)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i)), pa.array(odds[k][hit.to_numpy()]), *part.columns], names=["i", "odds", *part.schema.names])

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("odds", T.DoubleType()), *free.schema.fields])
    near = materialize(free.mapInArrow(pick, schema), "quality-surest")
    parts = [near.filter(F.col("i") == i).orderBy(F.desc("odds"), "key").limit(k) for i, k in enumerate(most)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("i", F.desc("odds"), "key").toArrow()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns both heads from the sample, and from what their views say of all other rows."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text", F.col("source").cast("string"), F.col("lang").cast("string"))
    one = lambda c: F.when(c <= 0, 0).when(c > 0, 1)
    marks = labels.groupBy("doc_id").agg((1 - one(F.min("quality"))).alias("bad"), one(F.max("toxic")).alias("toxic")).filter("doc_id IS NOT NULL AND (bad IS NOT NULL OR toxic IS NOT NULL)")
    some = _sample(docs, marks)
    names = _vocabulary(some)
    table = featured(some, names).orderBy("doc_id", "key").toArrow()
    rows = Rows(table, len(names))
    mark = lambda c: table[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(float) if rows.n else np.empty(0)
    pupils = {h: Pupil(mark(h)) for h in ("bad", "toxic")}
    centre, scale = (rows.layout.mean(axis=0), np.maximum(rows.layout.std(axis=0), 1e-6)) if rows.n else (np.zeros(LAYOUT), np.ones(LAYOUT))

    def model() -> Model:
        every = lambda values: {v: i for i, v in enumerate(sorted({x for x in values if x is not None}))}
        return Model(names, every(rows.source), every(rows.lang), centre, scale, {})

    able = {h: p for h, p in pupils.items() if p.able}
    taken = {(h, v): np.empty(0, np.int64) for h in able for v in VIEWS}
    free = None
    for _ in range(ROUNDS if able else 0):
        now = model()
        views = rows.views(now)
        linear = {(h, v): m for h, p in able.items() for v, m in p.learn(views).items()}
        free = _free(docs, marks, names) if free is None else free
        found = _surest(free, now, able, linear, taken)
        if not found.num_rows:
            break
        keys = [(h, v, label) for h, v in linear for label in (1, 0)]
        told = found["key"].to_numpy()
        for r, i in enumerate(found["i"].to_pylist()):
            h, v, label = keys[i]
            if told[r] not in taken[h, v]:
                able[h].known[VIEWS[v]][rows.n + r] = label
                taken[h, v] = np.append(taken[h, v], told[r])
        rows.add(Rows(found, len(names)))
    out = model()
    out.heads = {name: pupils[h].head(rows.views(out)) if pupils[h].able else None for name, h in (("score", "bad"), ("toxic", "toxic"))}
    return out


def _free(docs: DataFrame, marks: DataFrame, names: np.ndarray) -> DataFrame:
    """Written features of all rows that lack a label of some head."""
    rows = featured(docs, names)
    known = rows.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    nameless = rows.filter("doc_id IS NULL").withColumns({c: F.lit(None).cast("int") for c in ("bad", "toxic")})
    return materialize(known.unionByName(nameless).filter("bad IS NULL OR toxic IS NULL").drop("doc_id"), "quality-free")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs and score (probability of good quality), toxic (probability) and keep."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    own = docs.columns
    added = ["score", "toxic", "keep"]
    while set(added) & set(own):
        added = ["_" + a for a in added]
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])

    def run(batches):
        m = model.value
        for batch in batches:
            for row, data, offsets in W.pieces(batch.column("text")):
                n = len(offsets) - 1
                part = batch.slice(row, n)
                text = m.text(*text_features(data, offsets), n)
                meta = m.meta(layout_features(data, offsets), part.column("source").to_pylist(), part.column("lang").to_pylist())
                bad = m.heads["score"].probability(text, meta) if m.heads["score"] else np.zeros(n)
                toxic = m.heads["toxic"].probability(text, meta) if m.heads["toxic"] else np.zeros(n)
                keep = (bad < threshold) & (toxic < threshold)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 - bad), pa.array(toxic), pa.array(keep)], names=[*own, *added])

    out = docs.mapInArrow(run, schema)
    out._added = added
    return out


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "score", "toxic", "keep")
