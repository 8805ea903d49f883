"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing. Counted as part of velotrace.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. No stage needs its predecessor to be anything but a table with those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotrace.llm import common as C
from velotrace.llm.decontamination import find_contamination
from velotrace.llm.line_dedup import dedup_lines, kept_text
from velotrace.llm.packing import pack_documents
from velotrace.llm.quality import judge
from velotrace.llm.simhash import keep_one
from velotrace.llm.tokens import byte_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps, unchanged; null and empty texts go; repeated rows are judged alike."""
    return judge(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line chunks that occur earlier elsewhere; n_chars follows the text where lines went."""
    found = dedup_lines(docs)
    text = kept_text(F.col("row.text"), F.col("chunks"), F.col("cut"))
    changed = {"text": text, "n_chars": F.when(F.size("cut") == 0, F.col("row.n_chars")).otherwise(F.length(text).cast("long"))}
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; copies less alike stay."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: those whose spans from benchmark items reach the coverage limit go whole; from others with spans the spans are cut and n_chars follows; documents without a hit stay as they are."""
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[*kept, "n_chars"], cut=True).where("not __contaminated")
    n_chars = F.when(F.col("__n_hit") > 0, F.length("__text").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[{"text": F.col("__text"), "n_chars": n_chars}.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack_documents(docs, byte_bpe())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packing),
]
#: A fitted posterior, verified near copies and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one is written, and a stage's own folders with it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        uri = C.shared_dir(spark, name)
        with C.scratch():
            docs = C.materialize(stage(spark, docs, sf_dir), name, uri)
        if before:
            C.remove(before)
        before = uri
    return STAGES[-1][1](spark, docs, sf_dir)
