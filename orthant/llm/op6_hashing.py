"""Approximate nearest neighbours: multi-index hashing of learned binary codes, reranked on the vectors.

Codes are signs under learned rotations: principal axes of a bounded sample,
turned so that signs lose least (iterative quantisation). A code of BITS bits
is cut into PARTS substrings of 16 bits, and the index has an entry for every
row and substring, dealt to shards by the leading bits of its value; a shard
that would hold too many rows is split by a hash. Two codes within Hamming
radius r agree in one of the substrings to within r // PARTS bits (the
pigeonhole principle), so a query goes to those shards only that hold such
values, probes each value by flipped bits, checks whole codes, and ranks what
is left by exact distance.

The radius is the query's own. First, its substrings are probed to a depth of
one bit, with codes alone: the code distance of the k-th nearest code so found,
and a slack that covers the true neighbours of sampled queries, bound the
radius, as does the code distance that covers these neighbours as such. So
queries among close neighbours read few rows; where the vectors have no
structure, the radius makes them read a large share, whatever the index.
A query that finds too few rows is repeated without a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, list_column, small_batches, table
from .vectors import matrix, usable

#: Rows that the rotations are fitted on and queries that the radii are learned from, at most.
FIT_ROWS, FIT_QUERIES = 8192, 64
BITS, PARTS, TURNS = 128, 8, 25
#: Share of the true neighbours of the sampled queries that each bound of the radius covers.
COVER = 0.99
#: Rows of a shard at most, and bytes of their vectors.
SHARD, SHARD_BYTES = 16_384, 1 << 25
#: Vector lengths that have codes: the most frequent ones, of so many rows at least. Vectors of other lengths are compared in blocks.
MODELS, LEAST = 64, 64
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), kind="stable")
_UPTO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))))  # how many masks have so many bits at most


class Codes:
    """Learned rotations of one vector length; codes are PARTS uint16 substrings."""

    def __init__(self, sample: np.ndarray) -> None:
        self.mean = sample.mean(0)
        x = sample - self.mean
        axes = np.linalg.svd(x, full_matrices=True)[2] if len(x) < x.shape[1] else np.linalg.eigh(x.T @ x)[1][:, ::-1].T
        axes = axes[:BITS]
        y, size = x @ axes.T, len(axes)
        turned = []
        for k in range(-(-BITS // size)):
            r = np.linalg.qr(np.random.default_rng(k).normal(size=(size, size)))[0]
            for _ in range(TURNS):
                u, _, v = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (u @ v).T
            turned.append(axes.T @ r)
        self.turn = np.concatenate(turned, 1)[:, :BITS]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1).view(np.uint16)


class Model:
    """Codes of one vector length, the bounds of its radii, and how many leading bits of a substring deal it to shards."""

    def __init__(self, codes: Codes, most: int, slack: int, lead: int) -> None:
        self.codes, self.most, self.slack, self.lead = codes, most, slack, lead


def depths(radius: int) -> np.ndarray:
    """Bits that may differ in each substring, -1 where it needs no probing: some substring of two codes within the radius keeps to its depth."""
    deep, more = divmod(radius, PARTS)
    return np.where(np.arange(PARTS) <= more, deep, deep - 1)


def away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of codes."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k nearest to q, ties to smaller ids, and their distances."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    rows = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > 4 * k else np.arange(len(d))  # ties of the k-th included
    rows = rows[np.lexsort((ids[rows], d[rows]))][:k]
    return rows, d[rows]


class Shard:
    """One substring's table: the rows of each value."""

    def __init__(self, codes: np.ndarray, part: int) -> None:
        self.codes, self.part = codes, part
        value = codes[:, part]
        self.order = np.argsort(value, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << 16))])

    def probe(self, code: np.ndarray, depth: int) -> np.ndarray:
        """Rows whose substring differs from the code's in at most `depth` bits; none below a depth of 0."""
        values = code[self.part] ^ _MASKS[: _UPTO[min(depth, 16)] if depth >= 0 else 0]
        lo = self.first[values]
        size = self.first[values + 1] - lo
        hit = np.flatnonzero(size)
        size = size[hit]
        ends = np.cumsum(size)
        return self.order[np.repeat(lo[hit] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Of the rows that this substring's probes find, those whose whole code is within the radius."""
        rows = self.probe(code, int(depths(radius)[self.part]))
        return rows[away(self.codes[rows], code) <= radius]


def _shard_rows(size: int) -> int:
    return max(256, min(SHARD, SHARD_BYTES // (8 * size)))


def _sample(rows: DataFrame, most: int, seed: int) -> pa.Table:
    return rows.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(most).select("row", "vec_id", "v").toArrow()


def _bounds(rows: DataFrame, codes: Codes, k: int) -> tuple[int, int]:
    """Code distance, and code distance beyond that of the k-th nearest code, that cover COVER of the true neighbours of sampled queries, which are compared with all rows."""
    sample = _sample(rows.where("asked"), FIT_QUERIES, 2)
    own, q = sample.column("row").to_numpy(), matrix(sample.column("v"))
    shared = rows.sparkSession.sparkContext.broadcast((codes, own, q, codes(q) if len(q) else None))  # FIT_QUERIES vectors

    def run(batches):
        model, own, q, code = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, row, ids = matrix(batch.column("v")), batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
            c = model(x)
            for i in range(len(q)):
                others = np.flatnonzero(row != own[i])
                far = away(c[others], code[i])
                at, d = nearest(x[others], ids[others], q[i], k)
                low = np.sort(far)[:k]
                yield pa.RecordBatch.from_pydict({"i": pa.array([i] * (len(at) + len(low)), pa.int32()), "d": pa.array([*d, *[-1.0] * len(low)], pa.float64()), "away": pa.array([*far[at], *low], pa.int64())})

    told = rows.mapInArrow(run, "i int, d double, away long").withColumn("code", F.col("d") < 0)
    rank = F.row_number().over(Window.partitionBy("i", "code").orderBy("d", "away"))
    told = told.withColumn("k", rank).where(F.col("k") <= k).toPandas()  # FIT_QUERIES times 2k rows
    if not len(told):
        return BITS, BITS
    kth = told[told.code].groupby("i")["away"].max()
    true = told[~told.code]
    cover = lambda x: int(np.quantile(x, COVER, method="higher"))
    return cover(true["away"]), max(0, cover(true["away"].to_numpy() - kth.loc[true["i"]].to_numpy()))


def models_of(rows: DataFrame, k: int) -> dict[int, Model]:
    """A model for each of the most frequent vector lengths; rows: row, vec_id, asked, v."""
    frequent = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "d").limit(MODELS)
    out = {}
    for r in frequent.collect():
        size, n = r["d"], r["n"]
        own = rows.where(F.size("v") == size)
        codes = Codes(matrix(_sample(own, FIT_ROWS, 1).column("v")))
        lead = int(np.clip(np.ceil(np.log2(n / _shard_rows(size))), 0, 16))
        out[size] = Model(codes, *_bounds(own, codes, k), lead)
    return out


def _coded(rows: DataFrame, models) -> DataFrame:
    """The rows with size, lead and parts: the substrings of the code, one 0 where there is no model."""

    def run(batches):
        for batch in batches:
            size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            parts, lead, known = np.zeros((len(size), PARTS), np.int32), np.zeros(len(size), np.int32), np.zeros(len(size), bool)
            for d, model in models.value.items():
                at = np.flatnonzero(size == d)
                if len(at):
                    parts[at], lead[at], known[at] = model.codes(matrix(batch.column("v").take(pa.array(at)))), model.lead, True
            sizes = np.where(known, PARTS, 1)
            keep = np.arange(PARTS)[None] < sizes[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(lead), list_column(parts[keep], np.concatenate([[0], np.cumsum(sizes)]), pa.int32())], names=[*batch.schema.names, "size", "lead", "parts"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, vec_id long, asked boolean, v {kind}, size int, lead int, parts array<int>")


_KEYS = ["size", "part", "prefix", "sub"]


def _entries(coded: DataFrame, *columns: str) -> DataFrame:
    """An entry for every row and substring: size, part, prefix, row and the columns."""
    out = coded.select("row", "size", "lead", *columns, F.posexplode("parts").alias("part", "value"))
    return out.select("size", "part", F.expr("shiftright(value, 16 - lead)").alias("prefix"), "row", *columns)


def _reach(queries: DataFrame, models) -> DataFrame:
    """The queries with `reach`: the parts and prefixes of the shards that may hold a code within their radius."""

    def run(batches):
        for batch in batches:
            size, radius = batch.column("size").to_numpy(), batch.column("radius").to_numpy()
            for i in range(batch.num_rows):
                model, row = models.value.get(int(size[i])), batch.slice(i, 1)
                if model is None:
                    part, prefix = np.zeros(1, np.int32), np.zeros(1, np.int32)
                else:
                    code = row.column("parts").flatten().to_numpy().astype(np.int64) >> (16 - model.lead)
                    masks = np.arange(1 << model.lead)
                    bits = np.bitwise_count(masks)
                    near = [code[p] ^ masks[bits <= deep] for p, deep in enumerate(depths(int(radius[i])).tolist())]
                    part, prefix = np.repeat(np.arange(PARTS), [len(x) for x in near]).astype(np.int32), np.concatenate(near).astype(np.int32)
                both = pa.StructArray.from_arrays([pa.array(part), pa.array(prefix)], ["part", "prefix"])
                yield row.append_column("reach", pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), both))

    inner = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{inner}, reach array<struct<part: int, prefix: int>>")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table, pa.RecordBatch]]:
    """Key, all rows and some queries at a time of each shard, from a stream sorted by shard and side; only one shard's rows are held."""
    now, held, whole = None, [], None
    for batch in batches:
        cols = np.stack([batch.column(c).to_numpy() for c in [*_KEYS, "side"]]) if batch.num_rows else np.empty((5, 0))
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            key = tuple(cols[:4, lo].tolist())
            if key != now:
                now, held, whole = key, [], None
            if cols[4, lo] == 0:
                held.append(batch.slice(lo, hi - lo))
            elif held or whole is not None:
                if whole is None:
                    whole, held = pa.Table.from_batches(held), []
                yield key, whole, batch.slice(lo, hi - lo)


def _found(coded: DataFrame, shards: DataFrame, queries: DataFrame, models, k: int, exact: bool) -> DataFrame:
    """asker, row, vec_id, score: for each query (its row) the k best rows of each shard it reaches, by distance or by code distance; queries: coded rows with radius."""
    columns = ["vec_id", "parts", *(["v"] if exact else [])]
    sub = lambda: F.pmod(F.xxhash64("row"), F.col("subs")).cast("int")
    rows = _entries(coded, *columns).join(shards, ["size", "part", "prefix"])
    rows = rows.select("size", "part", "prefix", sub().alias("sub"), F.lit(0).alias("side"), "row", F.lit(0).alias("radius"), *columns)
    asked = _reach(queries.select("row", "size", "radius", *columns), models).select("row", "size", "radius", *columns, F.inline("reach"))
    asked = asked.join(shards, ["size", "part", "prefix"]).select("size", "part", "prefix", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(1).alias("side"), "row", "radius", *columns)
    both = rows.unionByName(asked).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "side", "row")

    def run(batches):
        last, shard = None, None
        for key, whole, ask in _by_shard(batches):
            coded_ = key[0] in models.value
            if whole is not last:
                last = whole
                row, ids = whole.column("row").to_numpy(), whole.column("vec_id").to_numpy()
                x = matrix(whole.column("v")) if exact else None
                shard = Shard(_codes(whole.column("parts")), key[1]) if coded_ else None
            codes = _codes(ask.column("parts")) if coded_ else None
            q = matrix(ask.column("v")) if exact else None
            askers, hits, score = [], [], []
            for i, (own, radius) in enumerate(zip(ask.column("row").to_pylist(), ask.column("radius").to_pylist(), strict=True)):
                at = shard.within(codes[i], radius) if coded_ else np.arange(len(row))
                at = at[row[at] != own]
                if not len(at):
                    continue
                if exact:
                    best, s = nearest(x[at], ids[at], q[i], k)
                else:
                    s = away(shard.codes[at], codes[i]) if coded_ else np.zeros(len(at))
                    best = np.argsort(s, kind="stable")[:k]
                    s = s[best]
                askers.append(np.full(len(best), own)), hits.append(at[best]), score.append(s)
            if hits:
                at = np.concatenate(hits)
                yield pa.RecordBatch.from_pydict({"asker": pa.array(np.concatenate(askers), pa.int64()), "row": pa.array(row[at], pa.int64()), "vec_id": pa.array(ids[at], pa.int64()), "score": pa.array(np.concatenate(score), pa.float64())})

    # a row may be found by several substrings
    found = both.mapInArrow(run, "asker long, row long, vec_id long, score double").dropDuplicates(["asker", "row"])
    best = Window.partitionBy("asker").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.uint16).reshape(len(column), PARTS)


def search(rows: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where `asked` is true, other than itself.

    rows: vec_id, embedding. Nearness is Euclidean distance in double
    precision, ties go to the smaller vec_id, and then to either row. A row is
    a row, whatever its vec_id: repeated ids are candidates of each other, and
    two queries of one id are ranked each by itself. Rows without vec_id and
    null, zero or non-finite vectors take no part, and vectors are compared
    with those of their length only. Fewer than k candidates are all returned;
    an empty table gives no rows; other columns are not read. Every row is
    indexed and every query is asked.
    """
    small_batches(rows)
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "neighbours")
    used = rows.where(usable("embedding") & F.col("vec_id").isNotNull())
    used = used.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col("embedding").alias("v"))
    used = scratch.save(used, "rows")  # so that a row keeps its number
    models = models_of(used, k)
    shared = spark.sparkContext.broadcast(models)  # MODELS rotations at most
    coded = scratch.save(_coded(used, shared), "coded")
    scratch.drop("rows")
    limit = F.lit(SHARD_BYTES) / (8 * F.col("size"))
    most = F.greatest(F.lit(256), F.least(F.lit(SHARD), limit.cast("int")))
    shards = scratch.save(_entries(coded).groupBy("size", "part", "prefix").agg(F.ceil(F.count("*") / F.first(most)).cast("int").alias("subs")), "shards")
    queries = coded.where("asked")
    bound = lambda name: F.coalesce(F.create_map(*[F.lit(x) for d, m in models.items() for x in (d, getattr(m, name))])[F.col("size")], F.lit(BITS)) if models else F.lit(BITS)
    if models:
        near = _found(coded, shards, queries.where(F.col("size").isin(list(models))).withColumn("radius", F.lit(2 * PARTS - 1)), shared, k, exact=False)
        kth = near.groupBy("asker").agg(F.when(F.count("*") >= k, F.max("score")).cast("int").alias("kth"))
        queries = queries.join(kth, F.col("row") == F.col("asker"), "left").drop("asker")
        queries = queries.withColumn("radius", F.least(bound("most"), F.col("kth") + bound("slack"), F.lit(BITS)).cast("int")).drop("kth")
    else:
        queries = queries.withColumn("radius", F.lit(BITS))
    queries = scratch.save(queries, "queries")
    found = scratch.save(_found(coded, shards, queries, shared, k, exact=True), "found")
    enough = found.groupBy("asker").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = queries.where(F.col("radius") < BITS).join(enough, F.col("row") == F.col("asker"), "left_anti")
    if models and short.limit(1).count():
        again = _found(coded, shards, short.withColumn("radius", F.lit(BITS)), shared, k, exact=True)
        found = found.join(short.select(F.col("row").alias("asker")), "asker", "left_anti").unionByName(again)
    names = queries.select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"))
    return found.join(names, "asker").select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
