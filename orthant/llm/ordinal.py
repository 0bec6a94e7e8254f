"""Cumulative-link ordinal regression on hashed text features, shared by the toxicity and quality operators.

Grades 0 < 1 < ... < K-1 share one weight vector; P(grade > k) is
logistic(score - cut[k]) with increasing cuts. A text's features are the set
of its hashed lower-case words and word beginnings and, with `style`, of its
symbol runs, of words in capitals and of coarse ratios of capitals, symbols, digits and repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, list_column, share, small_batches
from .textvec import blocks, byte_tables, mix, run_hashes, runs, utf8

#: Expected number of labelled rows that a model is fitted on at most, at any size of the input, and expected bytes of their features that reach the driver.
TRAIN_ROWS, TRAIN_BYTES = 8_000, 1 << 27
#: Grades told apart at most, the most frequent ones; a rarer grade counts as the next lower one of these, or the lowest.
MOST_GRADES = 16
#: Not used: features that fewer labelled texts have, or that shift the mean grade by fewer standard errors or by less than a share of the strongest's. Of the others, the ones that shift it most.
#: The share keeps chance features out, so a model may rest on some hundred features, and a cue less than about a sixteenth as frequent as the commonest one has no weight.
LEAST_TEXTS, LEAST_Z, LEAST_SHARE, FEATURES = 10, 6.0, 0.25, 2048
#: Bytes of the word beginnings that are features beside whole words: stems with many endings.
PREFIXES = (4, 5, 6, 7)
_STYLE = {name: np.uint64((k + 1) << 40) for k, name in enumerate(("capital", "capitals", "symbols", "digits", "repeats", "size"))}


def _bins(name: str, value: np.ndarray, most: int) -> np.ndarray:
    return mix(_STYLE[name] + np.clip(value, 0, most).astype(np.uint64))


class Wanted:
    """Finds the place of a feature's hash among the few that a model uses; a bit table sorts out most others first."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, self.bits = np.sort(hashes), np.zeros(1 << 20, bool)
        self.bits[hashes >> np.uint64(44)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the sorted hashes, -1 where absent."""
        out = np.full(len(hashes), -1)
        near = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        at = np.searchsorted(self.hashes, hashes[near])
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes[near] if len(self.hashes) else np.zeros(0, bool)
        out[near[hit]] = at[hit]
        return out


def features(column: pa.Array, style: bool, wanted: Wanted | None = None):
    """For blocks of documents: first document, distinct features in order of documents, and their offsets.

    Features are 64-bit hashes or, where `wanted` is given, the places there
    of those it has.
    """
    t, (data, offsets) = byte_tables(), utf8(column)
    for lo, hi in blocks(offsets):
        flat, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        n = hi - lo
        starts, ends = runs(t["word"][flat], offs)
        docs = np.searchsorted(offs, starts, "right") - 1
        lower = t["lower"][flat]
        hashes = run_hashes(lower, starts, ends)
        parts = [(docs, hashes)]
        for size in PREFIXES:
            long = ends - starts > size
            parts.append((docs[long], run_hashes(lower, starts[long], starts[long] + size) ^ np.uint64(size)))
        if style:
            caps = np.concatenate([[0], np.cumsum(t["capital"][flat])])
            loud = (ends - starts >= 2) & (caps[ends] - caps[starts] == ends - starts)
            s, e = runs(t["symbol"][flat], offs)
            parts.append((np.searchsorted(offs, s, "right") - 1, run_hashes(flat, s, e)))
            words = np.maximum(np.bincount(docs, minlength=n), 1)
            sizes = np.maximum(np.diff(offs), 1)
            part = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offs]) / sizes
            order = np.lexsort((hashes, docs))
            first = np.ones(len(order), bool)
            first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (docs[order][1:] != docs[order][:-1])
            distinct = np.bincount(docs[order][first], minlength=n)
            row = np.arange(n)
            parts += [
                (docs[loud], _bins("capital", np.zeros(loud.sum()), 1)),
                (row, _bins("capitals", np.bincount(docs[loud], minlength=n) * 8 // words, 8)),
                (row, _bins("symbols", part(t["symbol"][flat]) * 50, 15)),
                (row, _bins("digits", part((flat >= 48) & (flat <= 57)) * 50, 15)),
                (row, _bins("repeats", distinct * 10 // words, 10)),
                (row, _bins("size", np.log2(sizes), 12)),
            ]
        doc, found = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        if wanted is not None:
            found = wanted(found)
            doc, found = doc[found >= 0], found[found >= 0]
        order = np.lexsort((found, doc))
        doc, found = doc[order], found[order]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
        yield lo, found[first], np.searchsorted(doc[first], np.arange(n + 1))


class OrdinalModel:
    """Hashes and weights of the features used, increasing cuts, one fewer than grades, and the grades themselves."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, cuts: np.ndarray, style: bool, grades: list[int] | None = None) -> None:
        order = np.argsort(hashes)
        self.wanted, self.weights, self.cuts, self.style = Wanted(hashes), weights[order], cuts, style
        self.grades = list(range(len(cuts) + 1)) if grades is None else grades

    def expected(self, tails: np.ndarray) -> np.ndarray:
        """The expected grade from the tail probabilities."""
        return self.grades[0] + tails @ np.diff(self.grades)

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) by text and k."""
        score = np.zeros(len(column))
        for lo, found, offs in features(column, self.style, self.wanted):
            full = np.flatnonzero(offs[:-1] < offs[1:])
            if len(full):
                score[lo + full] = np.add.reduceat(self.weights[found], offs[full])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))


def _distinct(doc: np.ndarray, hashes: np.ndarray, have: np.ndarray, n: int) -> np.ndarray:
    """Texts that share less than a quarter of their rarer features with each earlier one; else a group of copies could pass off its own words as evidence.

    Earlier texts to compare with are found by minima of six hashes.
    """
    rare = have <= max(2.0, 0.02 * n)
    doc, hashes, keep = doc[rare], hashes[rare], np.ones(n, bool)
    edges = np.searchsorted(doc, np.arange(n + 1))
    seen: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        own = hashes[edges[i] : edges[i + 1]]
        if len(own) < 4:
            continue
        keys = [(k, int(mix(own + np.uint64((k + 1) << 32)).min())) for k in range(6)]
        for j in {j for key in keys for j in seen.get(key, ())}:
            common = len(np.intersect1d(own, hashes[edges[j] : edges[j + 1]], assume_unique=True))
            if 4 * common >= len(own) + edges[j + 1] - edges[j] - common:
                keep[i] = False
                break
        else:
            for key in keys:
                seen.setdefault(key, []).append(i)
    return keep


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def solve(doc: np.ndarray, hashes: np.ndarray, grade: np.ndarray, grades: int, style: bool, l2: float = 1e-6, steps: int = 500) -> OrdinalModel:
    """Penalised maximum likelihood by Adam on the features that separate the grades best.

    doc, hashes: one entry for each text's distinct feature.
    """
    col, names = pd.factorize(hashes)
    order = np.argsort(names)
    place = np.empty(len(names), np.int32)
    place[order] = np.arange(len(names))
    names, col = names[order], place[col]  # in 32 bits: there are millions
    keep = _distinct(doc, hashes, np.bincount(col, minlength=len(names)).astype(np.int32)[col], len(grade))
    use, place = keep[doc], (np.cumsum(keep) - 1).astype(np.int32)
    doc, col, grade = place[doc[use]], col[use], grade[keep]
    n = len(grade)
    have = np.bincount(col, minlength=len(names))
    pull = np.bincount(col, (grade - grade.mean())[doc] if n else None, minlength=len(names))
    worth = np.abs(pull) / np.sqrt(np.maximum(have * (1 - have / max(n, 1)), 0.5)) / max(grade.std() if n else 0, 1e-9)
    worth[have < LEAST_TEXTS] = 0
    worth[worth < max(LEAST_Z, LEAST_SHARE * worth.max(initial=0))] = 0
    chosen = np.flatnonzero(worth)
    chosen = chosen[np.argsort(-worth[chosen], kind="stable")[:FEATURES]]
    place = np.full(len(names), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    use = place[col] >= 0
    doc, col = doc[use], place[col[use]]
    above = np.clip([(grade > k).mean() if n else 0.5 for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    cuts = np.log((1 - above) / above)
    p = np.concatenate([np.zeros(len(chosen)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    f = len(chosen)
    for step in range(1, steps + 1 if n else 1):
        w, cut = p[:f], np.cumsum(np.concatenate([p[f : f + 1], np.exp(p[f + 1 :])]))
        s = np.bincount(doc, w[col], minlength=n)
        # below[:, k] = P(grade < k), with 0 and 1 at the ends
        below = np.concatenate([np.zeros((n, 1)), _logistic(cut[None, :] - s[:, None]), np.ones((n, 1))], 1)
        lo, hi = below[np.arange(n), grade], below[np.arange(n), grade + 1]
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g_s = (d_hi - d_lo) / n  # of the negative log likelihood
        g_cut = np.array([(d_lo[grade == k + 1].sum() - d_hi[grade == k].sum()) / n for k in range(grades - 1)])
        g = np.concatenate([np.bincount(col, g_s[doc], minlength=f) + l2 * w, [g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(p[f + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return OrdinalModel(names[chosen], p[:f], np.cumsum(np.concatenate([p[f : f + 1], np.exp(p[f + 1 :])])), style)


def fit(docs: DataFrame, labels: DataFrame, grade: Column, grades: list[int] | None, style: bool, train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on labelled documents; `grade` is an expression on the labels, rows where it is null are left out; grades: those there are, else those that occur, MOST_GRADES at most.

    About `train_rows` labels are taken by a hash of doc_id, fewer if their
    features would be more than TRAIN_BYTES, so what reaches the driver is
    bounded. Documents whose id is null have no label; several labels of a
    document each count.
    """
    small_batches(docs)
    rows = labels.select("doc_id", grade.cast("long").alias("grade")).where("doc_id is not null and grade is not null")
    n = rows.count()
    if n > train_rows:
        rows = rows.where(share("doc_id") < train_rows / n)
    if grades is None:
        often = rows.groupBy("grade").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grade").limit(MOST_GRADES)
        grades = sorted(r["grade"] for r in often.collect())
        grades = [0, 1] if not grades else grades if len(grades) > 1 else sorted({0, 1, *grades})

    def gather(batches):
        for batch in batches:
            ids, grades_, column = batch.column("doc_id"), batch.column("grade"), batch.column("text")
            for lo, found, offs in features(column, style):
                rows = len(offs) - 1
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(lo, rows), "grade": grades_.slice(lo, rows), "hashes": list_column(found.view(np.int64), offs, pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").select("doc_id", "text", "grade")
    scratch = Scratch(docs.sparkSession, "labels")
    got = scratch.save(texts.mapInArrow(gather, "doc_id long, grade long, hashes array<bigint>"), "features")
    size = 8 * (got.agg(F.sum(F.size("hashes"))).first()[0] or 0)
    if size > TRAIN_BYTES:
        got = got.where(share("doc_id") < TRAIN_BYTES / size * min(1.0, train_rows / n))
    got = got.select("grade", "hashes").toArrow().combine_chunks()
    scratch.drop("features")
    level = np.maximum(np.searchsorted(grades, got.column("grade").to_numpy(), "right") - 1, 0)
    lists = got.column("hashes").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    del got, lists
    model = solve(np.repeat(np.arange(len(level), dtype=np.int32), sizes), hashes, level, len(grades), style)
    model.grades = grades
    return model


def score(docs: DataFrame, model: OrdinalModel, make: Callable[[OrdinalModel, np.ndarray], dict], schema: str) -> DataFrame:
    """doc_id and what `make` gets from the tail probabilities of each row; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64())} | make(shared.value, shared.value.tails(batch.column("text"))))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + schema)


def keep_rows(docs: DataFrame, model: OrdinalModel, keep: Callable[[OrdinalModel, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose tail probabilities `keep` accepts."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(shared.value, shared.value.tails(batch.column(at)))))

    return docs.mapInArrow(run, docs.schema)
