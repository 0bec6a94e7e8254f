"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_batches, share, small_batches, table
from .textvec import LETTER, char_classes, code_points

BITS = 16
ORDERS = (1, 2, 3)
SMOOTH = 0.5
#: Expected number of labelled rows that the model is fitted on, at any size of the input.
TRAIN_ROWS = 20_000
#: Languages learned, the most frequent of the sample; the model has 2**BITS floats for each, 32 MB at most.
LANGS = 128
UND = "und"
_BLOCK = 1 << 19


def _segments(texts: list[str | None]):
    """(document, a part of it in lower case, how many characters grams may begin at): long texts in parts of _BLOCK that overlap by the longest gram."""
    for i, t in enumerate(texts):
        padded = " " + (t or "").lower() + " "  # a blank before each document keeps its grams apart from its neighbours'
        for at in range(0, len(padded), _BLOCK):
            part = padded[at : at + _BLOCK + max(ORDERS) - 1]
            yield i, part, min(_BLOCK, len(part))


def _grams(texts: list[str | None]):
    """For blocks of characters and each order: first document, gram buckets, document offsets of the grams."""
    held, size = [], 0

    def told():
        docs = np.array([i for i, _, _ in held])
        points, offsets = code_points([part for _, part, _ in held])
        limits = offsets[:-1] + np.array([n for _, _, n in held])
        letters = char_classes()[points] == LETTER
        chars = np.where(letters, points, 32).astype(np.uint64)
        for order in ORDERS:
            n = len(chars) - order + 1
            if n <= 0:
                continue
            h = np.full(n, np.uint64(order * 0x51ED2701))
            useful = np.zeros(n, bool)
            for k in range(order):
                h = h * np.uint64(0x100000001B3) + chars[k : k + n]
                useful |= letters[k : k + n]
            # grams begin within their part's limit and end within it
            ends = np.minimum(np.minimum(offsets[1:] - order + 1, limits), n)
            inside = np.zeros(n + 1, np.int32)
            np.add.at(inside, np.minimum(offsets[:-1], n), 1)
            np.add.at(inside, np.maximum(ends, np.minimum(offsets[:-1], n)), -1)
            at = np.flatnonzero(useful & (np.cumsum(inside[:n]) > 0))
            bucket = ((h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
            begin = offsets[:-1][np.searchsorted(docs, np.arange(docs[0], docs[-1] + 1))]
            yield int(docs[0]), bucket, np.searchsorted(at, np.append(begin, len(chars)))

    for part in _segments(texts):
        if held and size + len(part[1]) > _BLOCK:
            yield from told()
            held, size = [], 0
        held.append(part)
        size += len(part[1])
    if held:
        yield from told()


class LanguageModel:
    """Class names, and the log probability of each bucket in each class (2**BITS by classes)."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, log_prior: np.ndarray) -> None:
        self.langs, self.log_prob, self.log_prior = langs, log_prob, log_prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; `und` and 0 where there is no letter."""
        scores = np.tile(self.log_prior, (len(texts), 1))
        seen = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        for lo, bucket, offsets in _grams(texts):
            full = np.flatnonzero(offsets[:-1] < offsets[1:])
            for k in range(len(self.langs) if len(full) else 0):
                scores[lo + full, k] += np.add.reduceat(self.log_prob[k][bucket], offsets[full], dtype=np.float64)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        best = scores.argmax(1)
        share = np.exp(scores - scores.max(1, keepdims=True))
        score = share[np.arange(len(texts)), best] / share.sum(1)
        return [self.langs[b] if s else UND for b, s in zip(best, seen, strict=True)], np.where(seen, score, 0.0)


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on rows with a language whose crc32(doc_id) mod 4 is not 2.

    About `train_rows` of them are taken, chosen by a hash of doc_id: the
    bound does not grow with the input. Of their languages the LANGS most
    frequent are learned. Counts are summed on the executors and only buckets
    by classes reach the driver.
    """
    small_batches(docs)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(_held_out(), F.lit(False))).select("doc_id", "text", "lang")
    n = rows.count()
    if n > train_rows:
        rows = rows.where(share("doc_id") < train_rows / n)

    docs_by = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    langs = sorted(docs_by)
    rows = rows.where(F.col("lang").isin(langs))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            order = sorted(range(len(langs)), key=langs.__getitem__)
            for lang, group in itertools.groupby(order, key=langs.__getitem__):
                total = sums.setdefault(lang, np.zeros(1 << BITS))
                for _, bucket, _ in _grams([texts[i] for i in group]):
                    total += np.bincount(bucket, minlength=1 << BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), 1 << BITS))
    at = {lang: k for k, lang in enumerate(langs)}
    np.add.at(counts, (np.array([at[x] for x in counted.column("lang").to_pylist()], int), counted.column("bucket").to_numpy()), counted.column("n").to_numpy())
    log_prob = (np.log(counts + SMOOTH) - np.log(counts.sum(1, keepdims=True) + SMOOTH * (1 << BITS))).astype(np.float32)
    prior = np.array([docs_by[x] + 1.0 for x in langs])
    return LanguageModel(langs, log_prob, np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row; one pass without a shuffle.

    A text that is null or has no letter gives `und` with score 0, as does a
    model without classes. Rows with the same doc_id or text each get a row;
    ties go to the first language by name; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats a language

    @over_batches
    def score(batch):
        lang, p = shared.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(p, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Drops documents without a letter and those whose best language has a posterior below `least`; where no language is labelled, the former only."""
    model = fit(docs)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    @over_batches
    def keep(batch):
        texts = batch.column(at).to_pylist()
        if not shared.value.langs:
            return batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))
        lang, p = shared.value.predict(texts)
        return batch.filter(pa.array([x != UND and s >= least for x, s in zip(lang, p, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
