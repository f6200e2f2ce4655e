"""The corpus pipeline: rules, classifier, near-copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs; all but the last return the columns of documents.
Verdicts hold for rows: ids may be null or repeated, so stages carry the columns along or
give each row of their input a number of its own. Every stage gives an empty result for an
empty table, and takes nulls in any column; columns beyond those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.jaccard_join import jaccard_join
from marketloom.llm.mixing import mix_sources
from marketloom.llm.packing import pack
from marketloom.llm.quality_classifier import quality_classifier
from marketloom.llm.quality_rules import quality_rules
from marketloom.llm.scratch import Scratch, freed, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the verdicts are made row by row, texts are not shuffled.

    Null and empty texts fail the base rules and go; equal rows all stay or all go.
    """
    return quality_rules(docs, keep=COLUMNS[1:]).where("kept").select(*[F.col(c) for c in COLUMNS])


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, trained on those of its input whose id has a label, does not reject; verdicts are made row by row.

    Null texts are judged as empty ones; equal texts all stay or all go; without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier(docs, labels, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-copies the row with the smallest id (null last), of equal ids the one least by hashes of its columns.

    Texts without words, null ones too, are no copies of each other; rows that repeat an id with
    other texts stay; of equal rows one stays.
    """
    scratch = Scratch(spark, "copies")
    docs = _numbered(scratch, docs)
    with freed(spark):
        groups = scratch.save(jaccard_join(docs, key="_row").select(F.col("_row").alias("_r"), "component_id"), "groups")
    # only rows of groups of two and more
    heads = scratch.save(groups.where("component_id <> _r").select("component_id").distinct(), "heads")
    members = scratch.save(groups.join(small(heads), "component_id", "left_semi"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_content", "_row")
    ranked = docs.select("doc_id", "_content", "_row").join(small(members), F.col("_row") == F.col("_r"))
    first = scratch.save(ranked.groupBy("component_id").agg(F.min(order)["_row"].alias("_row")), "first").select("_row")
    gone = scratch.save(members.select(F.col("_r").alias("_row")).join(small(first), "_row", "left_anti"), "copies")
    return docs.join(small(gone), "_row", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0 to 2 times. Rows without words are not taken; rows that repeat an id or have none are queued by their content, equal rows one after the other."""
    scratch = Scratch(spark, "mixed")
    own = F.coalesce(F.col("doc_id"), F.col("_content"))  # rows without an id go by their content
    docs = _numbered(scratch, docs)
    with freed(spark):
        times = mix_sources(docs.withColumn("_id", own), key="_id", keep=("_content", "_row")).where("taken > 0")
        times = scratch.save(times.select("_row", (F.col("taken") / F.col("size")).cast("int").alias("times")), "times")
    return docs.join(small(times), "_row").withColumn("_again", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left; a null text is its end mark alone, equal rows are packed like any other."""
    return pack(docs)


def _numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` written with a number of each row (_row) and a hash of its columns but the id (_content)."""
    numbered = docs.select(*COLUMNS, F.xxhash64("text", "source", "lang", "n_chars").alias("_content"), F.monotonically_increasing_id().alias("_row"))
    return scratch.save(numbered, "numbered")


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("jaccard_join", near_copies), ("mixing", mixing), ("packing", packing)]

#: SQL has no form of the classifier, the join or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written in the shared folder for the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with freed(spark):
            before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
