"""Peak lists against each other and against theory: matches, similarities and quality."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import band_pairs

#: Edges of the m/z bins over which peaks are counted, the last bin closed.
MZ_EDGES = (0, 50, 2500, 3000, 3500, 4000, 4500, 5000)


def binned_cosine(peaks: DataFrame, pairs: DataFrame, key: str, a: str, b: str, mz: str, intensity: str, width: float) -> DataFrame:
    """(a, b) pairs of spectra -> cosine of their binned intensities and spectral angle; 0 for spectra without peaks in common."""
    cells = peaks.groupBy(key, F.floor(F.col(mz) / width).alias("_bin")).agg(F.sum(intensity).alias("_i"))
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("_i") * F.col("_i"))).alias("_n"))
    side = lambda c, i: pairs.select(a, b).join(cells.select(F.col(key).alias(c), "_bin", F.col("_i").alias(i)), c)
    both = side(a, "_x").join(side(b, "_y"), [a, b, "_bin"]).groupBy(a, b).agg(F.sum(F.col("_x") * F.col("_y")).alias("_d"))
    out = pairs.select(a, b).join(both, [a, b], "left")
    for c, n in ((a, "_na"), (b, "_nb")):
        out = out.join(norms.select(F.col(key).alias(c), F.col("_n").alias(n)), c, "left")
    cosine = F.coalesce(F.try_divide("_d", F.col("_na") * F.col("_nb")), F.lit(0.0))
    bounded = F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0))
    return out.select(a, b, cosine.alias("cosine"), (1 - 2 * F.acos(bounded) / math.pi).alias("angle"))


def uniformity(peaks: DataFrame, key: str, mz: str) -> DataFrame:
    """Entropy of peak counts over MZ_EDGES as a share of that of the bins in use, and peaks per m/z; 0 for fewer than two peaks."""
    i = F.lit(None).cast("int")
    for k in reversed(range(len(MZ_EDGES) - 1)):
        last = k == len(MZ_EDGES) - 2
        inside = (F.col(mz) >= MZ_EDGES[k]) & ((F.col(mz) <= MZ_EDGES[k + 1]) if last else (F.col(mz) < MZ_EDGES[k + 1]))
        i = F.when(inside, k).otherwise(i)
    cells = peaks.withColumn("_b", i).groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min(mz).alias("_l"), F.max(mz).alias("_h"))
    used = F.when(F.col("_b").isNotNull(), F.col("_c"))
    sums = cells.groupBy(key).agg(F.sum("_c").alias("n"), F.sum(used).alias("_t"), F.sum(used * F.log(used)).alias("_s"), F.count(used).alias("_k"), (F.max("_h") - F.min("_l")).alias("_span"))
    entropy = F.log("_t") - F.col("_s") / F.col("_t")
    even = F.when((F.col("n") < 2) | (F.col("_k") == 0), 0.0).when(F.col("_k") == 1, entropy).otherwise(entropy / F.log("_k"))
    return sums.select(key, "n", F.coalesce(even, F.lit(0.0)).alias("uniformity"), F.when(F.col("_span") > 0, F.col("n") / F.col("_span")).otherwise(0.0).alias("density"))


def intensity_quality(peaks: DataFrame, key: str, intensity: str, matched: Column) -> DataFrame:
    """Share of intensity that is matched, ratio of the medians of matched and other peaks, dynamic range. One spectrum's peaks meet in a task."""
    i, hit = F.col(intensity), matched
    sums = peaks.groupBy(key).agg(
        F.coalesce(F.try_divide(F.sum(F.when(hit, i)), F.sum(i)), F.lit(0.0)).alias("explained"),
        F.coalesce(F.percentile(F.when(hit, i), 0.5), F.lit(0.0)).alias("_m"), F.coalesce(F.percentile(F.when(~hit, i), 0.5), F.lit(1e-6)).alias("_u"),
        F.min(i).alias("_l"), F.max(i).alias("_h"),
    )
    return sums.select(key, "explained", F.when(F.col("_u") > 0, F.col("_m") / F.col("_u")).otherwise(0.0).alias("snr"), F.when(F.col("_l") > 0, F.col("_h") / F.col("_l")).otherwise(0.0).alias("dynamic_range"))


def cleavage_coverage(ions: DataFrame, key: str, series: str, position: str, length: str) -> DataFrame:
    """Distinct cleavage sites seen by a, b, c ions (position) and x, y, z ions (length - position) over all sites."""
    site = F.when(F.col(series).isin("a", "b", "c"), F.col(position)).when(F.col(series).isin("x", "y", "z"), F.col(length) - F.col(position))
    inside = F.when((site > 0) & (site < F.col(length)), site)
    groups = ions.groupBy(key).agg(F.countDistinct(inside).alias("sites"), F.countDistinct(F.struct(series, position)).alias("groups"), F.max(length).alias("_n"))
    return groups.select(key, "sites", "groups", F.when(F.col("_n") > 1, F.col("sites") / (F.col("_n") - 1)).otherwise(0.0).alias("coverage"))


def sequencing(ions: DataFrame, key: str, series: str, position: str, length: str) -> DataFrame:
    """Longest run of positions of any series, bias of N- to C-terminal ions, share of residues that some ion covers."""
    kinds = ions.groupBy(key).agg(F.count_if(F.col(series).isin("a", "b", "c")).alias("_a"), F.count_if(F.col(series).isin("x", "y", "z")).alias("_z"), F.max(length).alias("_n"))
    distinct = ions.select(key, series, position).distinct()
    runs = distinct.withColumn("_i", F.col(position) - F.row_number().over(Window.partitionBy(key, series).orderBy(position))).groupBy(key, series, "_i").agg(F.count(F.lit(1)).alias("_r"))
    longest = runs.groupBy(key).agg(F.max("_r").alias("longest"))
    residue = F.when(F.col(series).isin("a", "b", "c"), F.col(position)).otherwise(F.col(length) - F.col(position) + 1)
    covered = ions.select(key, length, residue.alias("_p")).filter((F.col("_p") >= 1) & (F.col("_p") <= F.col(length))).groupBy(key).agg(F.countDistinct("_p").alias("_c"))
    out = kinds.join(longest, key).join(covered, key, "left")
    return out.select(key, "longest", (F.col("_a") / (F.col("_z") + 1e-6)).alias("bias"), F.coalesce(F.try_divide("_c", "_n"), F.lit(0.0)).alias("coverage"))


def charge_variants(ions: DataFrame, peaks: DataFrame, by: list[str], mz: str, charge: str, peak_mz: str, tolerance: float, most: int, proton: float) -> DataFrame:
    """Peaks at which an ion would lie with another charge from 1 to most: + other, the charge."""
    other = ions.withColumn("other", F.explode(F.sequence(F.lit(1), F.lit(most)))).filter(F.col("other") != F.col(charge))
    expected = other.withColumn("_e", ((F.col(mz) - proton) * F.col(charge) + F.col("other") * proton) / F.col("other"))
    return band_pairs(expected, peaks, by, "_e", peak_mz, tolerance).drop("_e")


def match_most_intense_first(pairs: DataFrame, by: list[str], left: str, right: str, intensity: str, distance: str) -> DataFrame:
    """One-to-one peaks: left peaks by falling intensity, each with the nearest right peak that is free. Ties by left, then right."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            order = sorted(range(len(rows)), key=lambda i: (-rows[i][intensity], rows[i][left], rows[i][distance], rows[i][right]))
            used_l, used_r, keep = set(), set(), []
            for i in order:
                a, b = rows[i][left], rows[i][right]
                if a not in used_l and b not in used_r:
                    used_l.add(a)
                    used_r.add(b)
                    keep.append(i)
            yield batch.take(pa.array(sorted(keep), pa.int64()))

    def group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(table.combine_chunks().to_batches(max_chunksize=max(1, table.num_rows)))), table.schema)

    return pairs.groupBy(*by).applyInArrow(group, pairs.schema)


def hyperplane_hashes(spectra: DataFrame, key: str, mz: str, intensity: str, top: float, step: float, planes: int = 16, seed: int = 3) -> DataFrame:
    """(key, lsh_hash): SHA-256 of the signs (as bytes 0 and 1) of the binned spectrum on normal hyperplanes drawn by the Mersenne Twister of the seed."""
    cells = round(top / step)
    if abs(cells * step - top) > 1e-9:
        raise ValueError("the largest m/z must be a whole number of steps")
    shared = spectra.sparkSession.sparkContext.broadcast(np.random.RandomState(seed).randn(planes, cells))

    def run(batches):
        normal = shared.value
        for batch in batches:
            out = []
            for m, i in zip(batch.column(mz).to_pylist(), batch.column(intensity).to_pylist()):
                place = (np.array(m or [], np.float64) / step).astype(np.int64)
                inside = (place >= 0) & (place < cells)
                vector = np.bincount(place[inside], np.array(i or [], np.float64)[inside], cells)
                out.append(hashlib.sha256((normal @ vector >= 0).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.string())], names=[key, "lsh_hash"])

    kind = spectra.schema[key].dataType.simpleString()
    return spectra.select(key, mz, intensity).mapInArrow(run, f"{key} {kind}, lsh_hash string")


def normalised_confidence(df: DataFrame, by: list[str], c: str, how: str = "percentile") -> DataFrame:
    """+ normalised: (c - median) / IQR, z-score with the sample deviation, or min-max - 0.5; scales are at least 1e-6."""
    if how == "percentile":
        p = df.groupBy(*by).agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"))
        return df.join(p, by).withColumn("normalised", (F.col(c) - F.col("_p")[1]) / F.greatest(F.col("_p")[2] - F.col("_p")[0], F.lit(1e-6))).drop("_p")
    w = Window.partitionBy(*by)
    if how == "zscore":
        return df.withColumn("normalised", (F.col(c) - F.avg(c).over(w)) / F.greatest(F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(1e-6)))
    return df.withColumn("normalised", (F.col(c) - F.min(c).over(w)) / F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(1e-6)) - 0.5)
