"""Words and shingles of Arrow text columns as numpy hashes, a few MB of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE = 4 << 20
#: Words of more bytes are hashed one by one.
LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about `size` bytes; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string()) if texts.type != pa.large_string() else texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of marked bytes; a run never crosses the end of a row."""
    n = len(inside)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, side="right") - 1


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data - np.uint8(65)) < 26, data | np.uint8(32), data) if len(data) else data


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word, bytes in lower case). Words are runs of bytes other than 9-13 and 32."""
    data = folded(data)
    return *runs(~((data == 32) | ((data - np.uint8(9)) < 5)), offsets), data


def word_hashes(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, equal for equal words: eight bytes at a time."""
    size = ends - starts
    # a view that reads eight bytes from any place
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left = np.minimum(size, 8).astype(U) << U(3)
    h = mix((lanes[starts] << (U(64) - left)) ^ (size.astype(U) * U(0x9E3779B97F4A7C15)))
    rest = np.flatnonzero(size > 8)
    at = 8
    while len(rest) and at < LONG:
        left = np.minimum(size[rest] - at, 8).astype(U) << U(3)
        h[rest] = mix(h[rest] * U(0x100000001B3) + (lanes[starts[rest] + at] << (U(64) - left)))
        at += 8
        rest = rest[size[rest] > at]
    for k in rest:
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    return h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row): the distinct n-word shingles of each row, ascending; a row of fewer words has its whole sequence as one."""
    starts, ends, row, data = words(data, offsets)
    h = word_hashes(starts, ends, data)
    rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    count = np.diff(first)
    power = U(0x9FB21C651E98DF25)
    total = np.zeros(max(0, len(h) - n + 1), U)
    for j in range(n):
        total = total * power + h[j : j + len(total)]
    full = np.maximum(count - n + 1, 0)
    keep = np.repeat(first[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    values = mix(total[keep])
    short = np.flatnonzero((count > 0) & (count < n))
    size = full.copy()
    size[short] = 1
    out_at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(out_at[-1], U)
    out[np.repeat(out_at[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)] = values
    for r in short:
        whole = U(int(count[r]))
        with np.errstate(over="ignore"):
            for x in h[first[r] : first[r + 1]]:
                whole = whole * power + x
        out[out_at[r]] = mix(np.array([whole ^ U(0x5851F42D4C957F2D)]))[0]
    for r in np.flatnonzero(size > 1):
        out[out_at[r] : out_at[r + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[out_at[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[out_at]
