"""Exact n-gram Jaccard join by PartEnum signatures.

Texts become sets of word shingles, held as 64-bit hashes. Sizes are cut into
bands; two sets of similarity s or more lie in one band or, the smaller being
close to the next band, both sign for that band. A band cuts the domain of
shingles into m parts. Two similar sets differ in at most k shingles, so of all
parts at most k can differ, and with more than k parts that are not empty they
agree on one that holds something. A set therefore signs with the content of its
first k + 1 parts that hold anything, in one order of the parts for all: the
prefix principle over parts. The few sets with too many empty parts also sign
with single shingles. No pair can be missed, whatever the data.

Sets that share a signature form a group; groups are never expanded into pairs.
Each member is compared with the group's first; the components so found are then
closed by comparing only members of a group that still lie in different
components and whose parity bitmaps leave a similarity of s possible.

Copies (equal sets) are one node throughout. Defined results: null, empty or
blank text has no shingles, links with nothing and is its own component; fewer
words than a shingle make one shingle; rows with the same id count one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import documents, materialize
from .components import connected_components

U = np.uint64
#: Up to this many keys are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 2_000_000
#: Members of a group that are compared at once; larger groups are cut into blocks.
BLOCK = 2048
#: Group keys and pairs that a task remembers in order not to send them again; beyond, it forgets.
REMEMBER = 1_000_000
#: Open groups, by key, that a member knows of itself.
KNOWN = 16
#: Rows after which a group of equal signatures is passed on in parts.
RUN = 1 << 16


def _difference(a, b, percent: int):
    """The most elements in which sets of sizes a and b of similarity percent / 100 or more can differ."""
    return ((a + b) * (100 - percent)) // (100 + percent)


def band(size: np.ndarray) -> np.ndarray:
    """Band i has the sizes 2 ** i up to 2 ** (i + 1) - 1."""
    return np.frexp(size.astype(np.float64))[1] - 1


def parts(i: np.ndarray) -> np.ndarray:
    """Parts of the domain in band i: some more than the most shingles by which its sets can differ."""
    most = (2 << i.astype(np.int64)) - 1
    return (0.4 * most + 2 * np.sqrt(most)).astype(np.int64) + 1


def signatures(values: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) for sets given by ascending hashes and offsets."""
    size = np.diff(at)
    rows = np.flatnonzero(size)
    own = band(size[rows])
    near = rows[100 * size[rows] >= percent * (2 << own.astype(np.int64))]
    out = []
    for chosen, i in ((rows, own), (near, band(size[near]) + 1)):
        if not len(chosen):
            continue
        n = size[chosen]
        most = np.minimum((2 << i.astype(np.int64)) - 1, n * 100 // percent)
        k = _difference(n, most, percent)
        take = np.repeat(at[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x, of = values[take], np.repeat(np.arange(len(chosen)), n)
        m = parts(i).astype(U)
        part = ((x >> U(32)) * m[of]) >> U(32)
        new = np.ones(len(x), bool)
        new[1:] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        of, part = of[first], part[first]
        sums = np.add.reduceat(W.mix(x ^ U(0xD6E8FEB86659FD93)), first)
        start = np.searchsorted(of, np.arange(len(chosen) + 1))
        rank = np.arange(len(of)) - start[of]
        keep = rank <= k[of]
        out.append((W.mix(sums + part * U(0x9E3779B97F4A7C15) + m[of]), chosen[of], keep))
        few = np.flatnonzero(np.diff(start) <= k)
        if len(few):
            c, n, k = chosen[few], n[few], k[few]
            take = np.minimum(k + 1, n)
            idx = np.repeat(at[c] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            out.append((W.mix(values[idx] ^ U(0x2545F4914F6CDD1D)), np.repeat(c, take), np.ones(take.sum(), bool)))
    if not out:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate([s[k] for s, _, k in out]), np.concatenate([r[k] for _, r, k in out])


def nodes(values: np.ndarray, at: np.ndarray, seed: int = 0x8CB92BA72F3D8DD7) -> np.ndarray:
    """One hash per set, equal for equal sets; 0 for empty ones."""
    size = np.diff(at)
    out = np.zeros(len(size), U)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = W.mix(np.add.reduceat(W.mix(values ^ U(seed)), at[some]) + size[some].astype(U))
    return out.view(np.int64)


def checks(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A second hash per set, independent of the first."""
    return nodes(values, at, 0xD1B54A32D192ED03)


def named(values: np.ndarray, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Nodes; of those that different sets share, by both hashes."""
    out = nodes(values, at)
    if len(shared):
        hit = np.isin(out, shared)
        out = np.where(hit, W.mix(out.view(U) * U(3) ^ checks(values, at).view(U)).view(np.int64), out)
    return out


def bitmaps(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bitmaps: a bit tells whether an odd number of elements fall on it. Sets differ in at least as many elements as bits; about two to four bits an element, by band."""
    size = np.diff(at)
    out = []
    for r in range(len(size)):
        if not size[r]:
            out.append(b"")
            continue
        out.append(parity(values[at[r] : at[r + 1]], bits_of(int(size[r]))))
    return out


def bits_of(size: int) -> int:
    return max(64, 4 << (size.bit_length() - 1))


def parity(x: np.ndarray, bits: int) -> bytes:
    # low bits of x: the parts of a band are cut by its high bits
    hits = np.bincount((x & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap at half its bits, which is that of the band below."""
    x = np.frombuffer(bitmap, np.uint64)
    while len(x) * 64 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offsets in W.pieces(batch.column("text")):
        yield row, *W.shingle_sets(data, offsets, n)


def text_key(text="text"):
    """Hash of a text, which with the id tells rows apart."""
    return F.xxhash64(text)


def profile(docs: DataFrame, n: int, shared: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, key, n_shingles, node, check, bitmap); key is the hash of the text."""

    def run(batches):
        for batch in batches:
            for row, values, at in _sets(batch, n):
                rows = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(row, rows) for c in ("doc_id", "key")], pa.array(np.diff(at), pa.int64()), pa.array(named(values, at, shared), pa.int64()), pa.array(checks(values, at), pa.int64()), pa.array(bitmaps(values, at), pa.binary())],
                    names=["doc_id", "key", "n_shingles", "node", "check", "bitmap"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key bigint, n_shingles bigint, node bigint, check bigint, bitmap binary")


def signed(docs: DataFrame, n: int, percent: int, shared: np.ndarray) -> DataFrame:
    """(text) -> (sig, node), once for equal sets of a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, values, at in _sets(batch, n):
                node = named(values, at, shared)
                fresh = np.zeros(len(node), bool)
                if len(seen) > REMEMBER:
                    seen.clear()
                for r, x in enumerate(node.tolist()):
                    if at[r + 1] > at[r] and x not in seen:
                        seen.add(x)
                        fresh[r] = True
                sig, row = signatures(values, at, percent)
                keep = fresh[row]
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(node[row[keep]])], names=["sig", "node"])

    return docs.select("text").mapInArrow(run, "sig bigint, node bigint")


def _group_runs(batches):
    """Rows sorted by (sig, node) -> (gkey, leader, node, size) of groups of two nodes or more; equal groups of a task once.

    A group longer than RUN rows is passed on as it comes, under the key of its
    signature, so that memory does not grow with it.
    """
    seen: set[int] = set()
    left_sig, left_node = np.empty(0, np.int64), np.empty(0, np.int64)
    flowing: tuple[int, int] | None = None

    def out(gkey, leader, node, size):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (gkey, leader, node, size)], names=["gkey", "leader", "node", "size"])

    def groups(sig, node):
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, int)
        size = np.diff(np.append(first, len(sig)))
        key = np.add.reduceat(W.mix(node.view(U)), first).view(np.int64) if len(first) else np.empty(0, np.int64)
        many = np.flatnonzero(size > 1)
        _, pick = np.unique(key[many], return_index=True)
        many = [g for g in many[pick] if int(key[g]) not in seen]
        if len(seen) > REMEMBER:
            seen.clear()
        seen.update(int(key[g]) for g in many)
        if not len(many):
            return None
        many = np.array(many)
        n = size[many]
        idx = np.repeat(first[many] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return out(np.repeat(key[many], n), np.repeat(node[first[many]], n), node[idx], np.repeat(n, n))

    for batch in batches:
        sig, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "node"))
        sig, node = np.concatenate([left_sig, sig]), np.concatenate([left_node, node])
        if not len(sig):
            continue
        if flowing:
            stop = int(np.searchsorted(sig, flowing[0], side="right"))
            if stop:
                yield out(np.full(stop, flowing[0]), np.full(stop, flowing[1]), node[:stop], np.full(stop, BLOCK + 1))
            if stop < len(sig):
                flowing = None
            sig, node = sig[stop:], node[stop:]
            if flowing or not len(sig):
                left_sig, left_node = np.empty(0, np.int64), np.empty(0, np.int64)
                continue
        cut = int(np.searchsorted(sig, sig[-1], side="left"))
        if (found := groups(sig[:cut], node[:cut])) is not None:
            yield found
        left_sig, left_node = sig[cut:], node[cut:]
        if len(left_sig) > RUN:
            flowing = (int(left_sig[0]), int(left_node[0]))
            yield out(np.full(len(left_sig), flowing[0]), np.full(len(left_sig), flowing[1]), left_node, np.full(len(left_sig), BLOCK + 1))
            left_sig, left_node = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(left_sig) and (found := groups(left_sig, left_node)) is not None:
        yield found


def _open_pairs(percent: int, nearest: bool):
    """Rows (gkey, block, node, component, n_shingles, bitmap, side, lowest) sorted by gkey and block -> pairs in different components that may be similar.

    nearest: only between the largest component of a group and each other one, the pair whose bitmaps differ least.
    lowest: the least keys of a node's open groups. Two nodes that share one of these below gkey are compared there, so this group is silent about them; the least group of a pair never is.
    """

    def elsewhere(gkey, lowest):
        """Whether the members at two places share a known group before this one."""
        lists, below = [], {}

        def before(r):
            if not lists:
                lists.extend(x for part in lowest for x in part.to_pylist())
            if r not in below:
                below[r] = {k for k in lists[r] if k < gkey}
            return below[r]

        return lambda r, x: not before(r).isdisjoint(before(x))

    def compare(node, comp, size, bitmap, side, met):
        order = np.argsort(size, kind="stable")
        node, comp, size, side = node[order], comp[order], size[order], side[order]
        bitmap = [bitmap[o] for o in order]
        place = order.tolist()
        a_out, b_out, near = [], [], {}
        ids, many = np.unique(comp, return_counts=True)
        centre = comp == ids[many.argmax()]
        bits = np.maximum(64, 4 << (np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1))
        for width in np.unique(bits):
            # sets of the band, and those of the next by folding them down
            low = np.flatnonzero(bits == width)
            up = np.flatnonzero((bits == width) | (bits == 2 * width))
            maps_low = np.stack([np.frombuffer(bitmap[r], np.uint64) for r in low])
            maps_up = np.stack([fold(bitmap[r], int(width)) for r in up])
            for j, r in enumerate(low):
                may = (up > r) & (comp[up] != comp[r]) & (100 * size[r] >= percent * size[up])
                if side[r] >= 0:
                    may &= side[up] != side[r]
                if nearest and not centre[r]:
                    may &= centre[up]
                c = np.flatnonzero(may)
                if len(c):
                    differ = np.bitwise_count(maps_up[c] ^ maps_low[j]).sum(axis=1)
                    close = differ <= _difference(size[up[c]], size[r], percent)
                    c, differ = c[close], differ[close]
                    if nearest:
                        for x, d in zip(up[c].tolist(), differ.tolist()):
                            key = comp[x] if centre[r] else comp[r]
                            if key not in near or d < near[key][0]:
                                near[key] = (d, node[r], node[x], place[r], place[x])
                        continue
                    c = np.array([o for o in c.tolist() if not met(place[r], place[up[o]])], np.int64)
                    a_out.append(np.full(len(c), node[r]))
                    b_out.append(node[up[c]])
        if near:
            fresh = [x for x in near.values() if not met(*x[3:])]
            return tuple(np.array([x[i] for x in fresh], np.int64) for i in (1, 2))
        return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.empty(0, np.int64),) * 2

    def run(batches):
        now, held = None, []
        told: set[tuple[int, int]] = set()

        def flush():
            node, comp, size, side = (np.concatenate(x) for x in zip(*[h[:4] for h in held]))
            if len(node) > 1 and (comp != comp[0]).any():
                met = elsewhere(now[0], [h[5] for h in held])
                a, b = compare(node, comp, size, [m for h in held for m in h[4].to_pylist()], side, met)
                if len(told) > REMEMBER:
                    told.clear()
                new = [p for p in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()) if not (p in told or told.add(p))]
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new)], names=["a", "b"])

        for batch in batches:
            gkey, block, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gkey", "block", "node", "component", "n_shingles", "side"))
            cut = [0, *(np.flatnonzero((gkey[1:] != gkey[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(gkey)]
            for i, j in zip(cut, cut[1:]):
                if i == j:
                    continue
                if now != (gkey[i], block[i]):
                    if held:
                        yield from flush()
                    now, held = (gkey[i], block[i]), []
                held.append((*(x[i:j] for x in rest), batch.column("bitmap").slice(i, j - i), batch.column("lowest").slice(i, j - i)))
        if held:
            yield from flush()

    return run


def _few(df: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it has few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def node_sets(docs: DataFrame, wanted: DataFrame, n: int, shared: np.ndarray) -> DataFrame:
    """(node, shingles) of the wanted (doc_id, key, node): by the id, or where it is null by the text's hash."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for row, values, at in _sets(batch, n):
                node = named(values, at, shared)
                want = batch.column("node").slice(row, len(node)).to_numpy(zero_copy_only=False)
                keep = [r for r in np.flatnonzero(node == want).tolist() if not (int(node[r]) in seen or seen.add(int(node[r])))]
                if keep:
                    sizes = np.diff(at)[keep]
                    flat = np.concatenate([values[at[r] : at[r + 1]] for r in keep]).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(node[keep]), lists], names=["node", "shingles"])

    rows = docs.select("doc_id", "text")
    found = rows.join(_few(wanted.filter("doc_id IS NOT NULL").select("doc_id", "node")), "doc_id").select("text", "node")
    nameless = wanted.filter("doc_id IS NULL").select("key", "node")
    if not nameless.isEmpty():
        # copies of a text without an id are one here
        own = rows.filter("doc_id IS NULL").withColumn("key", text_key()).join(_few(nameless), "key").dropDuplicates(["node"])
        found = found.unionByName(own.select("text", "node"))
    return found.mapInArrow(run, "node bigint, shingles array<bigint>")


def _sets_of(pairs: DataFrame, seen: DataFrame, docs: DataFrame, n: int, shared: np.ndarray) -> DataFrame:
    """Written (node, shingles) of the nodes in pairs, from the first document that has each."""
    members = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    owners = seen.filter("n_shingles > 0").join(members, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    return materialize(node_sets(docs, materialize(owners.select("doc_id", "key", "node"), "set-owners"), n, shared), "sets")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    full = right.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")
    same = F.size(F.array_intersect("_a", "_b"))
    return full.filter(100 * same >= percent * (F.size("_a") + F.size("_b") - same)).select("a", "b").distinct()


def _possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps leave the similarity possible."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            keep = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            for r in np.flatnonzero(keep):
                bits = min(bits_of(int(na[r])), bits_of(int(nb[r])))
                differ = np.bitwise_count(fold(batch.column("ma")[r].as_py(), bits) ^ fold(batch.column("mb")[r].as_py(), bits)).sum()
                keep[r] = differ <= _difference(int(na[r]), int(nb[r]), percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), F.col("n_shingles").alias("n" + side), F.col("bitmap").alias("m" + side)), side)
    return pairs.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a bigint, b bigint")


def _unsettled(groups: DataFrame, comps: DataFrame, facts: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Possible pairs (a, b) in groups whose members lie in several components. Groups of more than BLOCK members are dealt out by pairs of blocks."""
    placed = groups.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_groups = placed.groupBy("gkey").agg(F.min("component").alias("_l"), F.max("component").alias("_h"), F.count(F.lit(1)).alias("_c")).filter("_l != _h")
    blocks = F.ceil(F.col("_c") / BLOCK).cast("int")
    inside = placed.select("gkey", "node", "component").join(open_groups, "gkey")
    # as many keys as a set has signatures at most, of which the first are kept
    lowest = inside.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("gkey")), 1, KNOWN).alias("lowest"))
    dealt = (
        inside.withColumn("_k", blocks).withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("block", F.least("_i", "_j") * F.col("_k") + F.greatest("_i", "_j"))
        # in a block of pairs of two blocks, only rows of different sides are compared
        .withColumn("side", F.when(F.pmod("block", F.col("_k")) == F.floor(F.col("block") / F.col("_k")), F.lit(-1)).otherwise(F.col("_i")))
        .join(facts.join(lowest, "node"), "node")
        .select("gkey", "block", "node", "component", "n_shingles", "bitmap", "side", "lowest")
    )
    # a key has two blocks at most, however large its group is
    return dealt.repartition("gkey", "block").sortWithinPartitions("gkey", "block").mapInArrow(_open_pairs(percent, nearest), "a bigint, b bigint").distinct()


def placed_rows(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, text) -> one row per input row: doc_id, key, n_shingles, _c (the component's node, null without shingles)."""
    twins = np.empty(0, np.int64)
    seen = materialize(profile(docs, n, twins), "shingle-sets")
    # a few in 10 ** 10 sets have the 64 bits of another one: these are named by 128
    found = seen.groupBy("node").agg((F.min("check") != F.max("check")).alias("_d")).filter("_d").select("node").toArrow()
    if found.num_rows:
        twins = np.sort(found["node"].to_numpy())
        seen = materialize(profile(docs, n, twins), "shingle-sets")
    rows = signed(docs, n, percent, twins)
    grouped = rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_group_runs, "gkey bigint, leader bigint, node bigint, size bigint")
    groups = materialize(grouped.dropDuplicates(["gkey", "node"]), "signature-groups")
    members = groups.select("node").distinct()
    facts = seen.filter("n_shingles > 0").join(members, "node", "left_semi").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.max("bitmap").alias("bitmap"))
    facts = materialize(facts, "set-facts")
    # each member with the hub of groups with which it shares most: an original has more in common with its copies than they with each other
    weight = groups.groupBy("node").agg(F.sum("size").alias("_w"))
    hubs = groups.join(weight, "node").groupBy("gkey").agg(F.max_by("node", F.struct("_w", "node")).alias("leader"))
    shared = groups.select("gkey", "node").join(hubs, "gkey").filter("node != leader").groupBy("leader", "node").agg(F.count(F.lit(1)).alias("_n"))
    stars = shared.groupBy("node").agg(F.max_by("leader", F.struct("_n", "leader")).alias("leader"))
    tried = materialize(_possible(stars.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")), facts, percent), "pairs")
    edges = materialize(links(tried, _sets_of(tried, seen, docs, n, twins), percent), "links")
    whole = materialize(connected_components(edges), "components")
    for nearest in (True, False):
        rest = _unsettled(groups, whole, facts, percent, nearest).join(tried, ["a", "b"], "left_anti")
        rest = materialize(rest, "pairs")
        if rest.isEmpty():
            continue
        tried = tried.unionByName(rest)
        more = materialize(links(rest, _sets_of(rest, seen, docs, n, twins), percent), "links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            whole = materialize(connected_components(edges), "components")
    placed = seen.select("doc_id", "key", "n_shingles", "node").join(whole, "node", "left").withColumn("_c", F.coalesce("component", "node"))
    return placed.select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_c")).alias("_c"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id that links reach)."""
    placed = placed_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), n, percent)
    first = placed.filter("_c IS NOT NULL").groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(first, "_c", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
