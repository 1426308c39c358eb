"""Corpus pipeline over the text operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
``docs``.  All but the last return the columns of ``docs``.

1. quality classifier: rows scored below the threshold go,
2. quality rules: rows outside the limits of their language and source go,
3. MinHash near-dedup: one row of each class stays,
4. benchmark decontamination: rows that hold a benchmark item go,
5. mixing: the rows that are left, with rates that meet the target weights.

The whole cannot be expressed in SQL (two stages learn a model), so there is no
oracle; the tests compare the stages with their operators, mixing with its targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common as C
from tidewater.llm import decontaminate, mixing, near_dedup, quality_classifier, quality_rules
from tidewater.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores at or above its threshold."""
    model = quality_classifier.fit(docs, C.table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, docs.columns, "__score")
    return scored.where(F.col("__score") >= quality_classifier.CUT).drop("__score")


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the limits of their language and source."""
    rows = docs.select(F.struct("*").alias("__row"), "text", "lang", "source")
    return quality_rules.judge(rows, carry=["__row"]).where("kept").select("__row.*")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.remove(docs, C.table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their rate and copies for the target weights."""
    labelled = mixing.labelled_languages(docs, C.table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, mixing.TARGETS, docs.columns)


STAGES = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_by_rules),
    ("near_dedup", keep_one_copy),
    ("decontaminate", remove_benchmark),
    ("mixing", mix_languages),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
