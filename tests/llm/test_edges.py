"""One table of edge cases through all operators, and cases that each of them must hold."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import jaccard, lm, media, mixing, order_minhash, packing, quality, secrets, tokens

#: Names that operators use inside, and a map, which has no order.
SCHEMA = "doc_id {kind}, text string, lang string, source string, n_chars bigint, _hits bigint, _m0 string, _piece int, sent int, piece int, row string, spans string, node bigint, h bigint, tags map<string,int>"
LONG = " ".join(f"w{i % 7919}" for i in range(60_000))


def edge_rows(kind):
    texts = [None, "", " \n", "one", LONG, LONG + " x", "password: abcdefgh12", "é ß 日本 \U0001f600", "a b c d e f", "a b c d e f"]
    ids = [i if kind != "string" else f"id-{i}" for i in range(len(texts))]
    rows = [(i, t, None if j % 3 == 0 else "en", None if j % 4 == 0 else f"s{j % 2}", None, j, "m", j, 1, 2, "r", "s", 5, 6, {"a": j}) for j, (i, t) in enumerate(zip(ids, texts))]
    return [*rows, rows[8], rows[8], (None, "a b c d e f", *rows[0][2:]), (None, None, *rows[0][2:]), (ids[1], "other text of one id", *rows[1][2:])]


@pytest.fixture(scope="module", params=["string", "smallint"])
def edges(spark, request):
    return spark.createDataFrame(edge_rows(request.param), SCHEMA.format(kind=request.param)).repartition(3).cache()


def test_all_operators_take_edge_rows(spark, edges):
    import public_tokenizers

    n = edges.count()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int").withColumn("doc_id", F.col("doc_id").cast(edges.schema["doc_id"].dataType))
    assert packing.pack(edges).count() == n
    scanned = secrets.scan(edges)
    assert scanned.count() == n and scanned.columns == [*[c for c in edges.columns if c != "spans"], "spans"]
    files, lengths = tokens.encode_corpus(edges, public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.read_files(files, lengths).count() == n
    assert jaccard.jaccard_components(edges).count() == n
    kept = quality.classify(edges, labels)
    assert kept.filter("keep").count() == n and kept.columns == [*edges.columns, "score", "toxic", "keep"]
    assert mixing.mix(edges).count() == n
    assert order_minhash.fingerprints(edges).count() == n
    assert media.media_features(media.store_texts(edges)).count() == n
    assert lm.score(edges).count() == n


def test_mixing_rows_without_an_id_come_near_the_target(spark):
    rows = [(None, f"word {i} " + "w " * (i % 30), "a" if i % 2 else "b") for i in range(2000)] + [(7, "same row here", "c")] * 3000
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=True)
    got = out.groupBy("row.source").agg(F.sum("taken").alias("k"), F.max("target").alias("t"), F.max("copies").alias("c")).collect()
    assert len(got) == 3 and all(abs(r.k - r.t) <= 40 and r.c <= 3 for r in got)


def test_packing_repeated_rows_are_split(spark):
    rows = [(7, "same row here")] * 500 + [(i, f"text {i}") for i in range(300)] + [(None, f"other words {i} x") for i in range(200)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=1, token_budget=30, shard_rows=50).collect()
    assert sorted((r.batch, r.place) for r in out) == [(i // 7, i % 7) for i in range(1000)]


def test_jaccard_names_that_sets_share(spark, monkeypatch):
    plain = jaccard.nodes
    # eight names for all sets: different sets share them
    monkeypatch.setattr(jaccard, "nodes", lambda v, at, seed=0x8CB92BA72F3D8DD7: plain(v, at, seed) if seed != 0x8CB92BA72F3D8DD7 else np.where(np.diff(at) > 0, plain(v, at) & 7 | 8, 0))
    values, at = np.sort(np.random.default_rng(0).integers(1, 2**60, 200).astype(np.uint64)), np.arange(0, 201, 4)
    shared = np.arange(8, 16)
    assert len(np.unique(jaccard.nodes(values, at))) <= 8 and len(np.unique(jaccard.named(values, at, shared))) == 50


def test_tile_columns(spark):
    pixels = np.arange(3 * 5 * 3, dtype=np.uint8).reshape(3, 5, 3)
    rows = [(1, bytearray(media.encode_ppm(pixels)), "x"), (2, bytearray(media.encode_bmp(pixels)), "y"), (3, None, None), (4, bytearray(b"GIF89a"), "z"), (5, bytearray(b"P6 9 9 255\n"), None), (6, bytearray(b""), None)]
    df = spark.createDataFrame(rows, "id long, media binary, error string")
    out = {r.id: r for r in media.tile_columns(df, height=2, width=2).collect()}
    want = media.to_npy(media.area_resize(pixels, 2, 2))
    assert bytes(out[1]._tile) == bytes(out[2]._tile) == want and (out[1]._height, out[1]._width) == (3, 5) and out[1]._dhash == media.difference_hash(pixels) and out[1]._error is None
    assert out[1].error == "x" and out[3]._tile is None and out[3]._error is None
    assert all(out[i]._tile is None and out[i]._error for i in (4, 5, 6))
    assert media.tile_columns(df.limit(0)).count() == 0


def test_media_values_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "x" * 191, "x" * 193, "é" * 5000, "some text " * 400])]
    out = {r.doc_id: r for r in media.media_features(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        height = len(payload) // 192
        if zlib.crc32(payload) & 1:  # 24-bit BMP: rows from the bottom, blue first
            lines = [payload[k * 192 : k * 192 + 192] for k in reversed(range(height))]
            body = b"".join(bytes(x for p in range(0, 192, 3) for x in line[p : p + 3][::-1]) for line in lines)
            stored = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (64).to_bytes(4, "little") + height.to_bytes(4, "little") + b"\x01\0\x18\0" + bytes(4) + len(body).to_bytes(4, "little") + (2835).to_bytes(4, "little") * 2 + bytes(8) + body
        else:
            stored = b"P6\n64 %d\n255\n" % height + payload
        # difference hash: means of exact areas of luma, 8 rows of 9 cells
        grey = [[(299 * r + 587 * g + 114 * b + 500) // 1000 for r, g, b in zip(*[iter(payload[k * 192 : k * 192 + 192])] * 3)] for k in range(height)]
        cell = np.repeat(np.repeat(np.array(grey), 8, 0), 9, 1).reshape(8, height, 9, 64).mean(axis=(1, 3))
        cell = np.floor(cell + 0.5 + 1e-9)
        bits = (cell[:, 1:] > cell[:, :-1]).ravel()
        dhash = f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.media_sha256) == (len(raw), len(payload), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.split(":")[0] == dhash


def test_token_files_against_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(5, "Don't stop <|endoftext|> now"), (1, LONG), (3, None), (2, "é 日本 x1"), (2, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        assert tokens.splits_into_pieces(plain.to_str()) == (name == "word_bpe_49k.json")
        files, lengths = tokens.encode_corpus(df, path)
        out = sorted(tokens.read_files(files, lengths).withColumn("crc", F.crc32("ids")).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in out] == [1, 2, 2, 3, 5]
        start = 0
        texts = collections.defaultdict(list)
        for i, t in rows:
            texts[i].append([*plain.encode(t or "", add_special_tokens=False).ids, tokens.END])
        for r in out:
            ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert ids in texts[r.doc_id] and (r.start, r.n_tokens) == (start, len(ids)) and r.crc == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)


def test_token_ids_beyond_16_bits():
    assert tokens.id_type(65_536) is np.uint16 and tokens.id_type(65_537) is np.uint32


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 50)
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(400)] + [(2, "x")], "doc_id long, text string").selectExpr("doc_id", "xxhash64(doc_id, text) AS key", "text", "'s' AS source", "'en' AS lang")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, bad int, toxic int")
    assert quality._sample(docs, marks).count() == 50


def test_quality_scores_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(str(x) for x in rng.choice([f"word{c}" for c in "abcdefgh"], 30)) + (" | junk" if i % 5 == 0 else ""), "en", f"s{i % 2}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int")
    made = []
    plain = quality.train
    quality.train, keep = lambda *a: made.append(plain(*a)) or made[-1], quality.train
    try:
        out = {r.doc_id: r for r in quality.classify(table, labels).collect()}
    finally:
        quality.train = keep
    m = made[0]
    head = m.heads["score"]
    for i, text, lang, source in rows[:40]:
        # the text view: sum of the weights of the letter and sign runs it has
        names = set()
        for k, p in enumerate((r"[a-z]+", r"[^a-z0-9\s]+")):
            for run in re.findall(p, text.lower()):
                data = np.frombuffer(run.encode(), np.uint8)
                h = quality.W.mix(quality.W.word_hashes(np.array([0]), np.array([len(data)]), data) + np.uint64(k))
                names |= set(np.flatnonzero(m.hashes == h[0]).tolist())
        x = sum(head.text.weights[j] for j in names) + head.text.bias
        layout = quality.layout_features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
        marks = [m.sources[source]] + [len(m.sources) + m.langs[lang]]
        y = ((layout - m.centre) / m.scale) @ head.meta.weights[: quality.LAYOUT] + sum(head.meta.weights[quality.LAYOUT + j] for j in marks) + head.meta.bias
        a, b, c = head.mix
        z = a * (x * head.text.slope + head.text.shift) + b * (y * head.meta.slope + head.meta.shift) + c
        assert out[i].score == pytest.approx(1 - 1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)
        assert out[i].toxic == 0.0 and out[i].keep == (out[i].score > 0.5)


def test_pipeline_passes_maps_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(edge_rows("bigint"), SCHEMA.format(kind="bigint"))
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, str(tmp_path))
    got = sorted(((r.doc_id, r.text and r.text[:20]) for r in kept.collect()), key=repr)
    # of the copies of "a b c d e f" one stays, of LONG and its near copy one; texts without shingles stay, those of one id once each
    assert kept.columns == docs.columns
    assert got == sorted([(0, None), (1, ""), (2, " \n"), (3, "one"), (4, LONG[:20]), (6, "password: abcdefgh12"), (7, "é ß 日本 \U0001f600"), (8, "a b c d e f"), (None, None), (1, "other text of one id")], key=repr)
    mixed = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.filter("tags IS NULL").count() == 0
