"""Sequence and identifier functions over sequences spelled from part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from .catalog import register, table

#: A sequence of 24 residues from a hash, with modifications on C, M and the start.
SEQ = """(SELECT p_partkey, p_size % 4 + 1 AS charge, CASE WHEN p_partkey % 3 = 0 THEN '[UNIMOD:1]-' ELSE '' END ||
  replace(replace(translate(substr(md5(p_name), 1, 24), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 'M', CASE WHEN p_partkey % 2 = 0 THEN 'M[UNIMOD:35]' ELSE 'M' END), 'C', 'C[UNIMOD:4]') AS seq FROM part)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.translate(F.substring(F.md5("p_name"), 1, 24), "0123456789abcdef", "ACDEFGHIKLMNPQRS")
    word = F.replace(word, F.lit("M"), F.when(F.col("p_partkey") % 2 == 0, F.lit("M[UNIMOD:35]")).otherwise(F.lit("M")))
    word = F.replace(word, F.lit("C"), F.lit("C[UNIMOD:4]"))
    start = F.when(F.col("p_partkey") % 3 == 0, F.lit("[UNIMOD:1]-")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("charge"), F.concat(start, word).alias("seq"))


BARE = "replace(regexp_replace(regexp_replace(seq, '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '-', '')"


def masses(values: dict[str, float]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in values.items()) + "}"


@register("j1_strip_modifications", f"SELECT p_partkey, {BARE} AS peptide FROM {SEQ}")
def j1(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", S.strip_modifications(F.col("seq")).alias("peptide"))


@register("j3_registry_key", f"SELECT DISTINCT replace({BARE}, 'I', 'L') AS registry_key FROM {SEQ}")
def j3(spark, sf_dir):
    return sequences(spark, sf_dir).select(S.plain_residues(F.col("seq"), True).alias("registry_key")).distinct()


@register("j9_label_bare", f"SELECT p_partkey, replace(seq, 'K', 'K[UNIMOD:737]') AS labelled FROM {SEQ}")
def j9(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", S.label_bare(F.col("seq"), "K", "[UNIMOD:737]").alias("labelled"))


@register("j10_usi", f"SELECT p_partkey, 'mzspec:PXD' || lpad((p_partkey % 97)::VARCHAR, 6, '0') || ':run' || (p_partkey % 11)::VARCHAR || ':scan:' || p_partkey::VARCHAR || ':' || seq || '/' || charge::VARCHAR AS usi FROM {SEQ}")
def j10(spark, sf_dir):
    key = F.col("p_partkey")
    project = F.concat(F.lit("PXD"), F.lpad((key % 97).cast("string"), 6, "0"))
    return sequences(spark, sf_dir).select("p_partkey", S.usi(project, F.concat(F.lit("run"), (key % 11).cast("string")), key.cast("string"), F.col("seq"), F.col("charge")).alias("usi"))


@register("j11_stems", "SELECT s AS stem, max(k) AS shard, max(t) AS total, count(*) AS n FROM (SELECT 'exp' || (p_partkey % 50)::VARCHAR AS s, (p_partkey % 4)::INT AS k, 4 AS t FROM part) GROUP BY 1")
def j11(spark, sf_dir):
    path = F.concat(F.lit("/data/PXD1/exp"), (F.col("p_partkey") % 50).cast("string"), F.lit(".mzML_"), F.lpad((F.col("p_partkey") % 4).cast("string"), 4, "0"), F.lit("-0004.parquet"))
    k, t = S.shard(path)
    return table(spark, sf_dir, "part").groupBy(S.stem(path).alias("stem")).agg(F.max(k).alias("shard"), F.max(t).alias("total"), F.count(F.lit(1)).alias("n"))


@register("j13_accession", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'PXD' ELSE 'MSV' END || (p_partkey % 13)::VARCHAR AS accession, count(*) AS n FROM part GROUP BY 1")
def j13(spark, sf_dir):
    path = F.concat(F.lit("s3a://x/"), F.when(F.col("p_partkey") % 2 == 0, "PXD").otherwise("MSV"), (F.col("p_partkey") % 13).cast("string"), F.lit("/a.parquet"))
    return table(spark, sf_dir, "part").groupBy(S.accession(path).alias("accession")).agg(F.count(F.lit(1)).alias("n"))


@register("j14_usi_parts", "SELECT 'PXD' || (p_partkey % 5)::VARCHAR AS project, count(DISTINCT 'run' || (p_partkey % 7)::VARCHAR) AS runs, 0::BIGINT AS beyond FROM part GROUP BY 1")
def j14(spark, sf_dir):
    value = S.usi(F.concat(F.lit("PXD"), (F.col("p_partkey") % 5).cast("string")), F.concat(F.lit("run"), (F.col("p_partkey") % 7).cast("string")), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(S.usi_part(value, 1).alias("project"), S.usi_part(value, 2).alias("run"), S.usi_part(value, 9).alias("none"))
    return rows.groupBy("project").agg(F.countDistinct("run").alias("runs"), F.count("none").alias("beyond"))


@register("j15_canonical_tokens", f"SELECT p_partkey, len(t)::INT AS n_tokens, array_to_string(list_transform(t, lambda x: CASE WHEN x = 'I' THEN 'L' ELSE x END), '') AS canonical FROM (SELECT p_partkey, regexp_extract_all(seq, '\\[[^\\]]*\\]|[A-Z]') AS t FROM {SEQ})")
def j15(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", F.size(S.tokens(F.col("seq"))).alias("n_tokens"), S.canonical(F.col("seq")).alias("canonical"))


@register("j17_edit_distance", f"SELECT a.p_partkey, levenshtein(replace(a.s, 'I', 'L'), replace(b.s, 'I', 'L'))::INT AS distance FROM (SELECT p_partkey, {BARE} AS s FROM {SEQ}) a JOIN (SELECT p_partkey, {BARE} AS s FROM {SEQ}) b ON b.p_partkey = a.p_partkey + 1")
def j17(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("p_partkey", S.tokens(S.registry_key(S.strip_modifications(F.col("seq")))).alias("t"))
    other = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return rows.join(other, "p_partkey").select("p_partkey", S.token_distance(F.col("t"), F.col("u")).alias("distance"))


@register("j20_distance_bins", "SELECT CASE d WHEN 0 THEN 'd=0' WHEN 1 THEN 'd=1' WHEN 2 THEN 'd=2' WHEN 3 THEN 'd=3' ELSE 'd>=5' END AS bin, count(*) AS n FROM (SELECT l_linenumber - 1 AS d FROM lineitem) GROUP BY 1")
def j20(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(S.distance_bin(F.col("l_linenumber") - 1, [0, 1, 2, 3, 5]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("j23_hydrophobicity", f"SELECT p_partkey, round(list_sum(list_transform(string_split(p, ''), lambda x: coalesce({masses(S.HYDROPATHY)}[x], 0))) / length(p), 9) AS gravy FROM (SELECT p_partkey, {BARE} AS p FROM {SEQ})")
def j23(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", F.round(S.hydrophobicity(S.strip_modifications(F.col("seq"))), 9).alias("gravy"))


@register("j24_header_target", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(value, 2) END AS target FROM (SELECT event_id, (event_id % 900 + 0.25)::DOUBLE AS value FROM events)")
def j24(spark, sf_dir):
    header = F.when(F.col("event_id") % 4 == 0, "MS1 scan").otherwise(F.concat(F.lit("MS2 scan "), (F.col("event_id") % 900).cast("string"), F.lit(".25@30.0")))
    return table(spark, sf_dir, "events").select("event_id", S.isolation_from_header(header).alias("target"))


@register("j25_ion_annotations", "SELECT t AS ion, p AS position, c AS charge, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'y' END AS t, (event_id % 9 + 1)::INT AS p, (CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END)::INT AS c FROM events) GROUP BY 1, 2, 3")
def j25(spark, sf_dir):
    key = F.col("event_id")
    note = F.concat(F.when(key % 2 == 0, "b").otherwise("y"), (key % 9 + 1).cast("string"), F.when(key % 3 == 0, F.when(key % 2 == 0, "^2").otherwise("++")).otherwise(""))
    rows = table(spark, sf_dir, "events").select(S.ion_type(note).alias("ion"), S.ion_position(note).alias("position"), S.ion_charge(note).cast("int").alias("charge"))
    return rows.groupBy("ion", "position", "charge").agg(F.count(F.lit(1)).alias("n"))


@register("f10_token_inventory", f"SELECT token, count(*) AS n, count(DISTINCT p_partkey) AS sequences FROM (SELECT p_partkey, unnest(regexp_extract_all(seq, '\\[[^\\]]*\\]')) AS token FROM {SEQ}) GROUP BY 1")
def f10(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("p_partkey", F.explode(S.modification_tokens(F.col("seq"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("sequences"))


@register("k11_precursor_mz", f"SELECT p_partkey, round(m / charge + {S.PROTON}, 6) AS mz FROM (SELECT p_partkey, charge, list_sum(list_transform(regexp_extract_all(seq, '\\[[^\\]]*\\]|[A-Z]'), lambda x: {masses(S.RESIDUES | {f'[{k}]': v for k, v in S.MODIFICATIONS.items()})}[x])) + {S.WATER} AS m FROM {SEQ})")
def k11(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", F.round(S.precursor_mz(F.col("seq"), F.col("charge")), 6).alias("mz"))
