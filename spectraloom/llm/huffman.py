"""Canonical length-limited Huffman codes for token ids, as numpy tables.

A coded block is a stream of tokens, most significant bit first in 32-bit words,
with a bit offset for every INTERVAL tokens. Decoding looks LIMIT bits up in a
table for all offsets at once, so a block is decoded in INTERVAL steps, and any
part of it can be read from the offset before it.
"""

from __future__ import annotations

import struct

import numpy as np

LIMIT = 18
INTERVAL = 256
MAGIC = b"HUF1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.float64 if counts.sum() > 1 << 52 else np.int64)
    level, leaves = leaf, []
    flags = [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        packs = level[: len(level) // 2 * 2 : 2] + level[1::2]
        both = np.concatenate([leaf, packs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        flags.append(order < len(leaf))
    take = 2 * len(leaf) - 2
    for flag in reversed(flags):
        n = int(flag[:take].sum())
        leaves.append(n)
        take = 2 * (take - n)
    for n in leaves:
        out[used[:n]] += 1
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    # left-aligned, each code follows the one before it
    step = np.int64(1) << (LIMIT - size)
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = (np.cumsum(step) - step) >> (LIMIT - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) by the next LIMIT bits."""
    ids, bits = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (LIMIT - lengths[order].astype(np.int64))
    n = int(span.sum())
    ids[:n], bits[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, bits


def encode_block(ids: np.ndarray, sizes: np.ndarray, base: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Tokens of some documents, with their sizes and the tokens before them."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    total = int(end[-1]) if len(end) else 0
    shifted = codes[ids].astype(np.uint64) << (np.uint64(64) - (at & 31).astype(np.uint64) - size.astype(np.uint64))
    word = at >> 5
    n = total // 32 + 2
    stream = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n + 1) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)
    marks = at[::INTERVAL].astype("<u8")
    head = MAGIC + struct.pack("<IIQQ", len(sizes), INTERVAL, base, len(ids))
    return head + sizes.astype("<u4").tobytes() + marks.tobytes() + stream.astype(np.uint32).astype(">u4").tobytes()


def decode_block(data: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, sizes, base)"""
    if data[:4] != MAGIC:
        raise ValueError("not a block of Huffman codes")
    docs, interval, base, n = struct.unpack_from("<IIQQ", data, 4)
    at = 4 + struct.calcsize("<IIQQ")
    sizes = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    marks = -(-n // interval)
    bit = np.frombuffer(data, "<u8", marks, at).astype(np.int64)
    words = np.frombuffer(data, ">u4", offset=at + 8 * marks).astype(np.uint64)
    window = np.zeros(len(words), np.uint64)
    window[:-1] = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.zeros((marks, interval), np.uint32)
    symbols, bits = table
    last = n - (marks - 1) * interval if marks else 0
    for step in range(min(interval, n)):
        live = marks if step < last else marks - 1
        b = bit[:live]
        key = (window[b >> 5] >> (np.uint64(64 - LIMIT) - (b & 31).astype(np.uint64))) & np.uint64((1 << LIMIT) - 1)
        out[:live, step] = symbols[key]
        bit[:live] += bits[key]
    return out.ravel()[:n], sizes, base
