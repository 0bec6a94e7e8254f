"""Point tables: Parquet in and out, and two synthetic distributions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "x double, y double"
#: Rows that one seed makes.
ROWS = 1 << 20
#: Fixed values of the cluster distribution.
CLUSTERS, SEED, CENTRES, SPREADS, NOISE, EXTENT = 1000, 42, (5.0, 95.0), (0.5, 2.5), 0.02, (0.0, 100.0)
#: Fixed values of the normal distribution.
MEAN, COVARIANCE = (0.0, 0.0), ((1.0, 0.5), (0.5, 1.0))
_CHUNK = 1 << 16


def read_points(spark: SparkSession, path: str, variables: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, with the named columns only if any; the scan reads no others."""
    df = spark.read.parquet(path)
    return df if variables is None else df.select(*[F.col(f"`{v}`") for v in dict.fromkeys(variables)])


def write_points(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def _generate(spark: SparkSession, power: int, rows: int, draw, partitions: int | None, named: bool) -> DataFrame:
    seeds = spark.range(0, 1 << power, 1, partitions or min(1 << power, 4096))

    def run(batches):
        for batch in batches:
            for seed in batch.column("id").to_pylist():
                points = draw(seed, rows)
                for lo in range(0, rows, _CHUNK):
                    part = points[lo : lo + _CHUNK]
                    own = {"seed": pa.array(np.full(len(part), seed))} if named else {}
                    yield pa.RecordBatch.from_pydict(own | {"x": pa.array(part[:, 0]), "y": pa.array(part[:, 1])})

    return seeds.mapInArrow(run, ("seed long, " if named else "") + SCHEMA)


def blob_layout() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, spreads and weights of the clusters, the same for all seeds."""
    rng = np.random.default_rng(SEED)
    centres = rng.uniform(*CENTRES, (CLUSTERS, 2))
    spreads = rng.uniform(*SPREADS, CLUSTERS)
    weights = rng.exponential(1.0, CLUSTERS)
    return centres, spreads, weights / weights.sum()


def blobs(spark: SparkSession, power: int = 0, rows: int = ROWS, partitions: int | None = None, seeds: bool = False) -> DataFrame:
    """2**power seeds of `rows` points each: isotropic clusters clipped to the extent, the last two in a hundred, one at least, uniform noise; with `seeds` also the seed."""

    def draw(seed: int, n: int) -> np.ndarray:
        centres, spreads, weights = blob_layout()
        rng = np.random.default_rng(seed)
        noise = min(n, max(1, int(n * NOISE)))
        at = rng.choice(CLUSTERS, n - noise, p=weights)
        # one variable after the other: this order of draws fixes the points of a seed
        clustered = [np.clip(rng.normal(centres[at, v], spreads[at]), *EXTENT) for v in (0, 1)]
        spread = [rng.uniform(*EXTENT, noise) for _ in (0, 1)]
        return np.concatenate([np.stack(clustered, 1), np.stack(spread, 1)])

    return _generate(spark, power, rows, draw, partitions, seeds)


def normal(spark: SparkSession, power: int = 0, rows: int = ROWS, partitions: int | None = None, seeds: bool = False) -> DataFrame:
    """2**power seeds of `rows` points each of the correlated bivariate normal distribution; with `seeds` also the seed."""

    def draw(seed: int, n: int) -> np.ndarray:
        return np.random.RandomState(seed).multivariate_normal(MEAN, COVARIANCE, n)

    return _generate(spark, power, rows, draw, partitions, seeds)
