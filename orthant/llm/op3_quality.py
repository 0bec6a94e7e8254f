"""Quality classifier: expected rating and tail probability from a cumulative-link ordinal regression.

Ratings of the labels table: 0 low quality, 1 good but toxic, 2 good. The
table's two columns have two values each; only together do they give the three
grades in order of use for training that an ordinal model needs. Words and
style features share one weight vector over both cuts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ordinal
from .common import table

GRADES = [0, 1, 2]


def rating():
    """The rating of a row of labels; null where quality is null."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, F.when(F.col("toxic") > 0, 1).otherwise(2))


def fit(docs: DataFrame, labels: DataFrame) -> ordinal.OrdinalModel:
    return ordinal.fit(docs, labels, rating(), GRADES, style=True)


def score(docs: DataFrame, model: ordinal.OrdinalModel, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good, p_best, kept for each row: P(rating >= 1), P(rating >= 2); kept if P(rating >= 1) is at least `least`.

    Null and empty texts are scored by their size and ratios alone. Whole
    texts are read; equal rows get equal scores; other columns are not read.
    Without labels nothing is learned: all tails are one half and all is kept.
    """

    def make(model, tails):
        return {"expected_grade": pa.array(model.expected(tails)), "p_good": pa.array(tails[:, 0]), "p_best": pa.array(tails[:, 1]), "kept": pa.array(tails[:, 0] >= least)}

    return ordinal.score(docs, model, make, "expected_grade double, p_good double, p_best double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
