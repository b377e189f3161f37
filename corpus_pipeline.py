"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and
read again as the next one's docs.  Each begins with a collection of garbage, as one stage's leavings count against the next one's memory.  All but the last return the columns of documents.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import scratch
from ledgerlens.llm.decontaminate import decontaminated
from ledgerlens.llm.line_dedup import dedup_lines
from ledgerlens.llm.near_dedup import near_duplicates
from ledgerlens.llm.quality_classifier import THRESHOLD, quality_score, train_quality
from ledgerlens.llm.queries import WEIGHTS
from ledgerlens.llm.source_mix import mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go.

    A null or empty text is scored like any other; repeated rows and rows without an id are judged one by one.  Without labelled rows nothing is known and all
    documents stay.
    """
    scratch.tune(spark)
    scratch.collect_garbage(spark)
    net = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (docs.filter(quality_score(net)(F.col("text")) >= THRESHOLD) if net else docs).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds too are cut out of the text; a document that loses lines and has no word left goes.

    Null texts become empty ones; they and empty texts stay.  Rows of one id never cut each other's lines, and rows without an id keep theirs.
    """
    scratch.collect_garbage(spark)
    out = dedup_lines(docs).filter(r"n_dropped = 0 OR kept_text RLIKE '[^\\x20\\x09-\\x0D]'")
    return out.select("doc_id", F.col("kept_text").alias("text"), "rest.lang", "rest.source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    What line dedup leaves of a near copy are the lines in which it differs, which no longer resemble anything.  So documents are compared by their texts
    in the documents table first, and those that stay by their present texts.  A document that the table doesn't hold has only its
    present text.  Null and empty texts stay, as do rows without an id; rows that repeat an id must repeat its text, and stay or go together.
    """
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = lambda table, ids: scratch.keep(near_duplicates(table, only=ids).filter("component_id != doc_id").select("doc_id").distinct(), "copies")
    ids = docs.select("doc_id")
    scratch.collect_garbage(spark)
    gone = copies(whole, ids)
    scratch.collect_garbage(spark)
    gone = gone.unionAll(copies(docs, ids.join(gone, "doc_id", "left_anti")))
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts overlap with none, and each row is judged by itself."""
    scratch.collect_garbage(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix of sources; all rows stay, repeated ones and those without an id, a text or a source too."""
    scratch.collect_garbage(spark)
    return mix_sources(docs, WEIGHTS)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("benchmark_decontamination", benchmark), ("source_mix", mixing)]

#: SQL can't express the classifier or the tolerant overlap; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Once a stage's result is written, what it was made from is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(scratch.kept())
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            scratch.release(spark, [p for p in scratch.kept()[:-1] if p not in before])
    return docs
