"""Token ids of documents in Huffman-coded files.

Texts are encoded once and their ids kept in a written table. The ids' global
counts give one canonical code of at most 18 bits. Documents are dealt out by
ranges of their id, sorted, and coded in blocks of about BLOCK tokens that are
decoded independently; a block knows how many ids come before it in its part,
and the parts' totals give where a part begins.

A tokenizer whose file says that it splits at white space and then as PIECES do has
equal ids for equal pieces anywhere: pieces of a batch are encoded once. Words with
characters beyond Latin-1 (where normal forms matter) or with the start of a special
token are left to it whole. Any other tokenizer gets whole texts.

Ids are held in 16 bits where the vocabulary allows it, else in 32. Defined results: a
null text is the empty one and has the end id alone; rows with the same id follow each
other; rows with a null id come first; an empty table gives empty files; a text of more
than MOST ids, which no binary value holds, raises ValueError; other columns than id and
text are not looked at.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman as H
from .common import documents, drop_scratch, materialize
from .words import pieces

END = 2
#: Tokens of a coded block.
BLOCK = 1 << 20
#: Pieces that a worker remembers (about 200 bytes each).
REMEMBER = 700_000
#: Bytes of text whose distinct words are encoded together.
TOGETHER = 24 << 20
#: Fixed value: how the tokenizer cuts a word.
PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
#: What a tokenizer's file says where that is so.
SPLITS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
#: Ids of a text, and bytes of ids that are passed on together, at most.
MOST, PASSED = 1 << 28, 64 << 20
PLAIN = "^[\x21-\x7e¡-ÿ]+$"

_loaded: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded.clear()
        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = (tokenizer, {}, splits_into_pieces(tokenizer.to_str()), id_type(tokenizer.get_vocab_size()))
    return _loaded[path]


def splits_into_pieces(definition: str) -> bool:
    """Whether a tokenizer's file says that words and PIECES are encoded on their own."""
    parts = json.loads(definition)
    before = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return parts.get("normalizer") == SPLITS[0] and before[0].get("type") == "Split" and before[0].get("pattern") == {"Regex": SPLITS[1]} and before[0].get("behavior") == "Removed" and before[0].get("invert") is True


def id_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _gather(flat: np.ndarray, at: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows idx of a ragged array, and their offsets."""
    n = at[idx + 1] - at[idx]
    off = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(at[idx] - off[:-1], n) + np.arange(off[-1])], off


def _ragged(rows: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))]) // kind().itemsize
    return np.frombuffer(b"".join(rows), kind), at


def _encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, ragged."""
    tokenizer, known, _, kind = _tokenizer(path)
    code = "H" if kind is np.uint16 else "I"
    # without the offsets of tokens, which nobody asks for
    whole = lambda texts: [array(code, e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
    lower = pc.utf8_lower(pc.if_else(plain, words, ""))
    # a word of letters is one piece
    mixed = pc.match_substring_regex(lower, "[^a-z]")
    marked = pc.replace_substring_regex(pc.if_else(mixed, lower, ""), PIECES, r"\1 ")
    parts = pc.ascii_split_whitespace(pc.if_else(mixed, marked, lower))
    coded = parts.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    fresh = [x for x in names if x not in known]
    if len(known) + len(fresh) > REMEMBER:
        known.clear()
        fresh = names
    known.update(zip(fresh, whole(fresh)))
    flat, at = _gather(*_ragged([known[x] for x in names], kind), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    at = at[parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()]
    odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    if len(odd):
        extra, extra_at = _ragged(whole(words.take(pa.array(odd)).to_pylist()), kind)
        both = np.concatenate([flat, extra])
        start, n = at[:-1].copy(), np.diff(at)
        start[odd], n[odd] = extra_at[:-1] + len(flat), np.diff(extra_at)
        off = np.concatenate([[0], np.cumsum(n)])
        return both[np.repeat(start - off[:-1], n) + np.arange(off[-1])], off
    return flat, at


def encode_texts(texts: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, ragged, each with the end id."""
    tokenizer, _, pieces_alike, kind = _tokenizer(path)
    if not pieces_alike:
        return _ragged([np.array([*e.ids, end], kind).tobytes() for e in tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)], kind)
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = split.flatten().dictionary_encode()
    flat, at = _encode_words(coded.dictionary.cast(pa.string()), path)
    ids, off = _gather(flat, at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    text_at = off[split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()]
    rows = len(texts)
    out = np.empty(len(ids) + rows, kind)
    ends = text_at[1:] + np.arange(rows)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = ids, end
    return out, text_at + np.arange(rows + 1)


def token_table(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, text) -> written (doc_id, ids as little-endian bytes of the vocabulary's id_type)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row, data, offsets in pieces(batch.column("text"), TOGETHER):
                n = len(offsets) - 1
                ids, at = encode_texts(batch.column("text").slice(row, n), path, end)
                if len(ids) > MOST and int(np.diff(at).max()) > MOST:
                    raise ValueError(f"a text has more than {MOST} ids")
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), raw], names=["doc_id", "ids"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary"), "token-ids")


def id_counts(tokens: DataFrame, vocabulary: int = 65_536) -> np.ndarray:
    """Counts of all ids, of a vocabulary of so many; a task sends at most one row per id of it."""
    kind = np.dtype(id_type(vocabulary))

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            column = batch.column("ids")
            off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            if len(off) and off[-1] > off[0]:
                total += np.bincount(np.frombuffer(column.buffers()[2], kind, (off[-1] - off[0]) // kind.itemsize, off[0]), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[found["id"].to_numpy(int)] = found["n"].to_numpy(np.int64)
    return out


def write_files(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Written (part, block, n_tokens, doc_ids, data): coded blocks in ascending order of ids."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    shared = tokens.sparkSession.sparkContext.broadcast(lengths.tobytes())
    wide = np.dtype(id_type(len(lengths)))

    def run(batches):
        size = np.frombuffer(shared.value, np.uint8)
        codes = H.canonical(size)
        part = TaskContext.get().partitionId()
        names, sizes, held, count, base, block = [], [], [], 0, 0, 0

        def flush():
            nonlocal names, sizes, held, count, base, block
            ids = np.concatenate(held) if held else np.empty(0, wide)
            data = H.encode_block(ids, np.array(sizes, np.int64), base, codes, size)
            row = [pa.array([x], k) for x, k in ((part, pa.int64()), (block, pa.int64()), (count, pa.int64()))]
            row += [pa.array([names], pa.list_(id_type)), pa.array([data], pa.binary())]
            base, block = base + count, block + 1
            names, sizes, held, count = [], [], [], 0
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "n_tokens", "doc_ids", "data"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(x.as_buffer(), wide)
                names.append(name)
                sizes.append(len(ids))
                held.append(ids)
                count += len(ids)
                if count >= BLOCK:
                    yield flush()
        if names:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(run, f"part bigint, block bigint, n_tokens bigint, doc_ids array<{kind}>, data binary"), "token-files")


def read_files(files: DataFrame, lengths: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as 32-bit little-endian bytes, decoded from the files; start counts all ids before the document."""
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    shared = files.sparkSession.sparkContext.broadcast(lengths.tobytes())

    def run(batches):
        table = H.decode_table(np.frombuffer(shared.value, np.uint8))
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, base = H.decode_block(batch.column("data")[row].as_py(), table)
                at = np.concatenate([[0], np.cumsum(sizes)])
                names = batch.column("doc_ids")[row].values
                i = 0
                while i < len(sizes):
                    # 1000 documents, or as many as PASSED bytes hold
                    j = min(i + 1000, len(sizes), max(i + 1, int(np.searchsorted(at, at[i] + PASSED // 4, side="right")) - 1))
                    some = ids[at[i] : at[j]].astype("<u4")
                    raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((at[i : j + 1] - at[i]) * 4).astype(np.int32)), pa.py_buffer(some)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(j - i, batch.column("part")[row].as_py())), names.slice(i, j - i), pa.array(at[i:j] + base), pa.array(sizes[i:j]), raw],
                        names=["part", "doc_id", "start", "n_tokens", "ids"],
                    )
                    i = j

    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    decoded = files.select("part", "doc_ids", "data").mapInArrow(run, f"part bigint, doc_id {kind}, start bigint, n_tokens bigint, ids binary")
    # one row per part of the files: as many as there are shuffle partitions
    return decoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids")


def encode_corpus(docs: DataFrame, tokenizer_path: str, end: int = END) -> tuple[DataFrame, np.ndarray]:
    """The coded files of (doc_id, text) and the code's lengths by id."""
    tokens = token_table(docs, tokenizer_path, end)
    size = _tokenizer(tokenizer_path)[0].get_vocab_size()
    lengths = H.code_lengths(id_counts(tokens, max(size, end + 1, 65_536)))
    files = write_files(tokens, lengths)
    drop_scratch(docs.sparkSession, tokens._scratch)
    return files, lengths


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files, lengths = encode_corpus(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    back = read_files(files, lengths)
    # zlib's checksum of the bytes read back
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
