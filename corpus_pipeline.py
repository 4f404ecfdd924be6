"""The corpus pipeline: quality, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last keep the columns
of documents. Rows are kept or dropped whole; only the secret scan changes texts.

Defined results: null texts are empty; null ids, sources and languages are values
of their own; of a group of near duplicates the row with the least id stays (a null one
last), and of rows with that same id the one with the least text; an empty table gives an empty
result; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import jaccard, mixing, packing, quality, secrets
from spectraloom.llm.common import WORD, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained classifier rejects."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(F.col(scored._added[2])).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each component of the Jaccard join.

    Without shingles a text links with nothing, and stays. Rows that repeat one id
    are told apart by their text; rows that repeat an id and a text are one document.
    """
    blank = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    nameless = docs.filter(blank & F.col("doc_id").isNull())
    found = jaccard.placed_rows(docs.select("doc_id", "text")).filter("_c IS NOT NULL OR doc_id IS NOT NULL")
    # texts without shingles are components of their own, by id and text
    found = materialize(found.select("doc_id", "key", F.coalesce("_c", F.xxhash64(F.lit("blank"), "doc_id", "key")).alias("_c")), "placed-rows")
    least = found.groupBy("_c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("_l")).select(F.col("_c").alias("_of"), F.col("_l.doc_id").alias("_id"))
    first = found.join(least, (F.col("_c") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    first = materialize(first.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_c").agg(F.count(F.lit(1)).alias("_n")), "first-rows")
    # several rows of a component have its least id
    several = materialize(first.groupBy("_c").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_c"), "repeated-ids")
    own = [docs[c] for c in docs.columns]

    def rows(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (jaccard.text_key(docs["text"]) == wanted["_key"]))

    if several.isEmpty():
        return rows(first).select(*own).unionByName(nameless)
    kept = rows(first.join(several, "_c", "left_anti")).select(*own)
    row = F.struct(*own)
    # of rows with that id the one with the least text, then the least as JSON: a map has no order
    order = F.struct(docs["text"].isNotNull().alias("some"), docs["text"].alias("text"), F.to_json(row).alias("all"))
    repeated = rows(first.join(several, "_c", "left_semi")).select("_c", row.alias("_r"), order.alias("_o"))
    one = repeated.groupBy("_c").agg(F.min_by("_r", "_o").alias("_r")).select("_r.*").select(*docs.columns)
    return kept.unionByName(one).unionByName(nameless)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; n_chars follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture says: 0 to 3 times."""
    taken = mixing.mix(docs, carry=True).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all rows, repeats included, in batches of length buckets."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
