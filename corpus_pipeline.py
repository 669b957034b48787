"""The corpus pipeline: score, filter, deduplicate, strip repeats and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the
shared folder and reads it back as the next stage's ``docs``.  A stage works on all that
the one before it kept; all but the last return the columns of ``documents``.  A stage's
result has been written when the next stage begins, so that stage first deletes the
intermediate tables of the one before.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm import jaccard, line_rules, packing, quality, repeats
from ticklake.llm.common import drop, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage that ran last.
_LEFT: list[str] = []


def _stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _LEFT)
        before = set(written())
        result = work(spark, docs, sf_dir)
        # what the last stage returns is still to be read
        _LEFT[:] = [p for p in written() if p not in before] if result.columns == list(COLUMNS) else []
        return result

    return run_stage


def _keep(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id the verdict keeps; a null doc_id matches a null."""
    kept = verdict.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; of rows that repeat a doc_id, all
    stay if one is kept."""
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keep(docs, judged.where("predicted = 1"))


@_stage
def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go; of rows that repeat a
    doc_id, all stay if one is kept."""
    field = line_rules.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keep(docs, line_rules.judge(docs, field).where("kept"))


@_stage
def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, and then text hash,
    stays (a null doc_id comes last); rows without a word are in no group and all stay, and
    so do rows that merely share a doc_id.  Other columns of ``docs`` go; an empty table
    gives no rows."""
    given = docs.select(*COLUMNS).withColumn("text_hash", F.unhex(F.sha2("text", 256)))
    # a letter, mark or number somewhere: the documents that are in a group
    worded = F.coalesce(F.col("text").rlike(r"[\p{L}\p{M}\p{N}]"), F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    # rows left with one doc_id and one text are copies of one class
    kept = given.where(worded).join(jaccard.firsts(docs), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.unionByName(given.where(~worded)).select(*COLUMNS)


#: Bytes of a repeated string that the pipeline cuts: a passage of 50 words is seldom shorter.
REPEAT, GRAM = 240, 60


@_stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEAT`` bytes or more that occur elsewhere are cut out of the texts; a
    character that a cut splits goes with it, n_chars follows the text, and documents of no
    text left stay empty.  Null texts stay null; rows that share a doc_id are separate
    documents; other columns of ``docs`` go; an empty table gives no rows."""
    got = repeats.remove_repeats(docs, REPEAT, GRAM, more=("lang", "source", "n_chars"))
    n_chars = F.when(F.size("spans") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars").cast("long"))
    return got.select("doc_id", F.col("kept_text").alias("text"), F.col("rest.lang").alias("lang"), F.col("rest.source").alias("source"), n_chars.alias("n_chars"))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.digest(packing.pack_documents(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("rules", rules_stage),
    ("duplicates", duplicates_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]

#: Learned scores, connected components and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        kept = table(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(spark, held)
        docs, held = kept, written()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
