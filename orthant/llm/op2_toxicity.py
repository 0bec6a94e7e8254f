"""Toxicity: expected severity from a cumulative-link ordinal regression on hashed words.

Severity grades are the integers of the column `toxic` of the labels, 0 for
clean. There is a cut between each two grades that occur, the 16 most frequent
ones at most, whatever their values; all cuts share the weights. The synthetic
labels have the grades 0 and 1, so one cut. A document is toxic if
P(severity > 0) is more than one half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ordinal
from .common import table


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = ordinal.TRAIN_ROWS) -> ordinal.OrdinalModel:
    """Labels whose grade is null or negative are left out."""
    return ordinal.fit(docs, labels, F.when(F.col("toxic") >= 0, F.col("toxic")), None, style=False, train_rows=train_rows)


def p_toxic(model: ordinal.OrdinalModel, tails: np.ndarray) -> np.ndarray:
    """P(severity > 0): the tail above the cut between 0 and the first grade above it; 1 where the labels have no 0."""
    above = sum(g <= 0 for g in model.grades)
    return tails[:, above - 1] if above else np.ones(len(tails))


def score(docs: DataFrame, model: ordinal.OrdinalModel, least: float = 0.5) -> DataFrame:
    """doc_id, expected_severity, p_toxic, toxic, kept for each row.

    Null and empty texts have no features and get the score of the cuts
    alone, which is the rate of the labels. Whole texts are read; equal rows
    get equal scores; other columns are not read. Without labels nothing is
    learned: p_toxic is one half and no document is toxic.
    """

    def make(model, tails):
        p = p_toxic(model, tails)
        return {"expected_severity": pa.array(model.expected(tails)), "p_toxic": pa.array(p), "toxic": pa.array(p > least), "kept": pa.array(p <= least)}

    return ordinal.score(docs, model, make, "expected_severity double, p_toxic double, toxic boolean, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Drops toxic documents; the model is fitted on the labelled ones among these."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return ordinal.keep_rows(docs, model, lambda model, tails: p_toxic(model, tails) <= least)
