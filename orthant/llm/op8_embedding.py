"""Near-duplicate vectors: NN-descent on the vectors of each label, audited, with exact link counts.

1. Equal vectors of a label become one class.
2. ORDERS sorted orders by random-hyperplane codes give each class its first
   neighbours: those beside it that reach FLOOR, the cosine of three times the
   threshold's angle. Pairs below that can't be two steps of links apart.
3. NN-descent: the neighbours of every vector, both ways, are compared with
   each other, and what improves a list of K neighbours is joined in, until
   few lists change.
4. Lists that hold K links are saturated. They are enlarged to all other
   saturated vectors of the label, compared in blocks, which finds the links
   between components, and to their whole component: its members are counted
   by shells round its smallest one, without reading pairs that a bound of the
   cosine decides, and in tiles where it doesn't. So counts of links are exact
   there and pairs are never written out.
5. An audit compares a bounded sample with all vectors; below RECALL, more
   orders are added and the descent goes on. If the last order leaves it below,
   all vectors of a label are compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, sorted_groups, table
from .components import SCHEMA, components, forest
from .meetings import meetings
from .vectors import matrix, usable

ORDERS, MOST_ORDERS, BITS, BESIDE, K = 16, 64, 62, 3, 8
ROUNDS, CHANGED = 8, 0.005
TILE = 128
#: Steps of the threshold's angle in which members are told apart by their angle to the centre of their component.
SHELLS = 64
#: Saturated vectors of a label in a tile, where those of different components meet.
BLOCK = 1024
#: Vectors of the audit, and the share of them whose links are all to be found.
AUDIT, RECALL = 512, 0.99
_EDGE = "a long, b long, cosine double"


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(order: int, size: int) -> np.ndarray:
    return np.random.default_rng((order, size)).normal(size=(size, BITS))


def _edges(a: list, b: list, c: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64()), "cosine": pa.array(np.concatenate(c), pa.float64())})


def first_neighbours(classes: DataFrame, floor: float, orders: range) -> DataFrame:
    """Edges (a < b, cosine) between vectors that stand close in a sorted order; classes: id, space, v."""
    planes = F.explode(F.array(*[F.lit(t) for t in orders])).alias("t")

    def code(batches):
        for batch in batches:
            t, size = batch.column("t").to_numpy(), batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            codes = np.zeros(len(t), np.int64)
            for d in np.unique(size).tolist():  # vectors of one length at a time
                of = np.flatnonzero(size == d)
                x = _unit(matrix(batch.column("v").take(pa.array(of))))
                for order in np.unique(t[of]).tolist():
                    rows = t[of] == order
                    codes[of[rows]] = ((x[rows] @ _planes(order, d)) > 0) @ (1 << np.arange(BITS, dtype=np.int64))
            yield batch.append_column("code", pa.array(codes))

    kind = classes.schema["v"].dataType.simpleString()
    rows = classes.select("id", "space", "v", planes).mapInArrow(code, f"id long, space long, v {kind}, t int, code long")
    rows = rows.repartitionByRange("space", "t", "code", "id").sortWithinPartitions("space", "t", "code", "id")

    def beside(batches):
        for group in sorted_groups(batches, ["space", "t"]):
            ids, x = group.column("id").to_numpy(), _unit(matrix(group.column("v")))
            a, b, c = [], [], []
            for step in range(1, min(BESIDE, len(ids) - 1) + 1):
                cosine = np.einsum("ij,ij->i", x[:-step], x[step:])
                near = cosine >= floor
                a.append(np.minimum(ids[:-step], ids[step:])[near]), b.append(np.maximum(ids[:-step], ids[step:])[near]), c.append(cosine[near])
            if a:
                yield _edges(a, b, c)

    return rows.mapInArrow(beside, _EDGE).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _lists(edges: DataFrame) -> DataFrame:
    """v, u, cosine, worst: the K nearest known neighbours of each vector, and the least cosine of a full list (else null)."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "cosine").union(edges.select("b", "a", "cosine"))
    # first within parts of a list, so that a vector with very many neighbours isn't ranked in one task
    part = Window.partitionBy("v", F.pmod(F.xxhash64("u"), F.lit(16))).orderBy(F.desc("cosine"), "u")
    both = both.withColumn("k", F.row_number().over(part)).where(F.col("k") <= K)
    whole = Window.partitionBy("v").orderBy(F.desc("cosine"), "u")
    ranked = both.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= K)
    return ranked.withColumn("worst", F.min(F.when(F.col("k") == K, F.col("cosine"))).over(Window.partitionBy("v"))).select("v", "u", "cosine", "worst")


def descend(classes: DataFrame, edges: DataFrame, floor: float) -> DataFrame:
    """Edges that neighbours of neighbours add: those that are better than the worst of a list, or that find it not full."""
    lists = _lists(edges)
    worst = lists.groupBy("v").agg(F.max("worst").alias("worst"))
    ways = lists.select(F.col("v").alias("pivot"), "u").union(lists.select("u", "v")).distinct()
    sizes = ways.groupBy("pivot").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    ways = ways.join(sizes, "pivot").withColumn("tile", F.pmod(F.xxhash64("u"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    ways = ways.select("pivot", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "u")
    rows = ways.join(worst, F.col("u") == F.col("v"), "left").select("pivot", "p", "q", "u", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
    rows = rows.join(classes.select("id", F.col("v").alias("x")), F.col("u") == F.col("id")).select("pivot", "p", "q", "u", "worst", "x")
    rows = rows.repartition("pivot", "p", "q").sortWithinPartitions("pivot", "p", "q", "u")

    def compare(batches):
        a, b, c, size = [], [], [], 0
        for group in sorted_groups(batches, ["pivot", "p", "q"]):
            if group.num_rows < 2:
                continue
            ids, bad, x = group.column("u").to_numpy(), group.column("worst").to_numpy(), _unit(matrix(group.column("x")))
            cosine = x @ x.T
            i, j = np.nonzero(np.triu((cosine >= floor) & (cosine > np.minimum(bad[:, None], bad[None])), 1))
            if len(i):
                a.append(ids[i]), b.append(ids[j]), c.append(cosine[i, j])
                size += len(i)
            if size > 50_000:
                yield _edges(a, b, c)
                a, b, c, size = [], [], [], 0
        if size:
            yield _edges(a, b, c)

    found = rows.mapInArrow(compare, _EDGE).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return found.join(edges.select("a", "b"), ["a", "b"], "left_anti")


def saturated(edges: DataFrame, least: float) -> DataFrame:
    """id of the vectors with K known links or more, whose lists may have left out others."""
    near = edges.where(F.col("cosine") >= least)
    return near.select(F.col("a").alias("id")).union(near.select("b")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= K).select("id")


def links_between(classes: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """Links (a, b), as forests of pairs of tiles, that connect the components of the given classes; parts: id, component."""
    rows = classes.select("id", "space", "v").join(parts, "id", "left").select(F.col("id").alias("doc_id"), F.col("space").alias("grp"), F.coalesce("component", "id").alias("root"), "v")
    roots = rows.groupBy("grp", "root").agg(F.count("*").alias("n"), F.lit(0).alias("bytes"))
    several = roots.groupBy("grp").agg(F.count("*").alias("m")).where("m > 1").select("grp")
    keys = ["grp", "x", "y"]
    rows = meetings(rows, roots.join(several, "grp", "left_semi"), lambda n, _: F.ceil(n / BLOCK).cast("int"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "doc_id")

    def run(batches):
        for group in sorted_groups(batches, keys):
            side, part = group.column("side").to_numpy(), group.column("root").to_numpy()
            one = group.column("x")[0].as_py() == group.column("y")[0].as_py()
            cut = 0 if one else int(np.searchsorted(side, 1))
            x = _unit(matrix(group.column("v")))
            a, b = [], []
            for lo in range(0, len(x) if one else cut, TILE):
                rows = slice(lo, min(lo + TILE, len(x) if one else cut))
                i, j = np.nonzero((x[rows] @ x[cut:].T >= least) & (part[rows, None] != part[None, cut:]))
                if len(i):
                    a.append(part[rows][i]), b.append(part[cut:][j])
            if a:
                a, b = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.mapInArrow(run, SCHEMA)


def count_links(classes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """id, n: how many rows of other classes each member of a component links with; groups: id, component, without the smallest member.

    Members of a component of more than TILE are told apart by their angle to
    its smallest member, in SHELLS steps of the threshold's angle. By the
    triangle inequality, members of two shells whose outer angles add up to
    the threshold's at most are all linked, and are counted without being
    read; those of shells further apart than it are not. Tiles of the other
    pairs of shells are compared.
    """
    theta = float(np.arccos(min(1.0, least)))
    step = theta * (1 - 1e-9) / SHELLS
    sizes = groups.groupBy("component").agg((F.count("*") + 1).alias("size"))
    members = groups.union(sizes.select("component", "component")).join(sizes, "component").join(classes.select("id", "copies", "v"), "id")
    centres = sizes.where(F.col("size") > TILE).select("component").join(classes.select("id", F.col("v").alias("c")), F.col("component") == F.col("id")).select(F.col("component").alias("k"), "c")
    kind = classes.schema["v"].dataType.simpleString()

    def shells(batches):
        for batch in batches:
            far = batch.column("c").is_valid().to_numpy(zero_copy_only=False)
            shell = np.zeros(batch.num_rows, np.int32)
            at = pa.array(np.flatnonzero(far))
            part = batch.take(at)
            size = part.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                own = part.take(pa.array(rows))
                away = np.linalg.norm(_unit(matrix(own.column("v"))) - _unit(matrix(own.column("c"))), axis=1)
                shell[at.to_numpy()[rows]] = (2 * np.arcsin(np.minimum(away / 2, 1)) / step).astype(np.int32) if step else 0
            yield batch.drop_columns(["c"]).append_column("shell", pa.array(shell))

    members = members.join(centres, F.col("component") == F.col("k"), "left").select("component", "size", "id", "copies", "v", "c")
    members = members.mapInArrow(shells, f"component long, size long, id long, copies long, v {kind}, shell int")
    by = members.groupBy("component", "shell").agg(F.first("size").alias("size"), F.sum("copies").alias("rows"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    pairs = by.join(by.select(F.col("component").alias("k"), F.col("shell").alias("other"), F.col("rows").alias("more"), F.col("tiles").alias("wide")), F.col("component") == F.col("k"))
    sure = (F.col("size") > TILE) & (F.col("shell") + F.col("other") + 2 <= SHELLS)
    never = (F.col("size") > TILE) & (F.abs(F.col("shell") - F.col("other")) > SHELLS + 1)
    tiles = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda t: F.struct(F.col("other").alias("shell"), t.alias("tile")))
    plan = pairs.groupBy("component", "shell").agg(
        F.first("tiles").alias("tiles"),
        F.sum(F.when(sure, F.col("more")).otherwise(0)).alias("sure"),
        F.max(sure & (F.col("other") == F.col("shell"))).alias("own"),
        F.flatten(F.collect_list(F.when(~sure & ~never, tiles))).alias("open"),
    )
    plan = plan.withColumnsRenamed({"component": "k", "shell": "s"})
    rows = members.join(plan, (F.col("component") == F.col("k")) & (F.col("shell") == F.col("s")))
    counted = rows.select("id", (F.col("sure") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("n"))
    tile = F.struct("shell", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"))
    rows = rows.withColumn("tile", tile).withColumn("other", F.explode("open"))
    rows = rows.select("component", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "id", "copies", "v")
    rows = rows.select("component", F.col("p.shell").alias("p"), F.col("p.tile").alias("p1"), F.col("q.shell").alias("q"), F.col("q.tile").alias("q1"), (F.col("tile") == F.col("p")).alias("first"), "id", "copies", "v")
    keys = ["component", "p", "p1", "q", "q1"]
    rows = rows.withColumn("first", F.col("first").cast("int")).repartition(*keys).sortWithinPartitions(*keys, "first", "id")

    def run(batches):
        ids, counts, size = [], [], 0

        def told():
            return pa.RecordBatch.from_pydict({"id": pa.array(np.concatenate(ids), pa.int64()), "n": pa.array(np.concatenate(counts), pa.int64())})

        for group in sorted_groups(batches, keys):
            x, copies, first = _unit(matrix(group.column("v"))), group.column("copies").to_numpy(), group.column("first").to_numpy()
            link = x @ x.T >= least
            np.fill_diagonal(link, False)
            if group.column("p")[0] != group.column("q")[0] or group.column("p1")[0] != group.column("q1")[0]:
                link &= first[:, None] != first[None]
            ids.append(group.column("id").to_numpy()), counts.append(link @ copies)
            size += len(x)
            if size > 50_000:
                yield told()
                ids, counts, size = [], [], 0
        if size:
            yield told()

    return rows.mapInArrow(run, "id long, n long").union(counted).groupBy("id").agg(F.sum("n").alias("n"))


def _audit(classes: DataFrame, counted: DataFrame, least: float) -> float:
    """Share of a bounded sample of classes whose links were all found; the lesser of those with few and with many links."""
    sample = classes.orderBy(F.xxhash64("id")).limit(AUDIT).toArrow()
    if not sample.num_rows:
        return 1.0
    groups: dict[tuple, tuple] = {}
    space, size = sample.column("space").to_pylist(), sample.column("v").combine_chunks().value_lengths().to_pylist()
    for key in set(zip(space, size, strict=True)):
        rows = pa.array([i for i, k in enumerate(zip(space, size, strict=True)) if k == key])
        part = sample.take(rows)
        groups[key] = part.column("id").to_numpy(), _unit(matrix(part.column("v")))
    shared = classes.sparkSession.sparkContext.broadcast(groups)  # AUDIT vectors

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            space, size = batch.column("space").to_numpy(), batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for key, (ids, y) in shared.value.items():
                rows = np.flatnonzero((space == key[0]) & (size == key[1]))
                if len(rows):
                    part = batch.take(pa.array(rows))
                    other = part.column("id").to_numpy()
                    link = (_unit(matrix(part.column("v"))) @ y.T >= least) & (other[:, None] != ids[None])
                    for i, n in zip(ids.tolist(), (link * part.column("copies").to_numpy()[:, None]).sum(0).tolist(), strict=True):
                        total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_pydict({"id": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    true = classes.select("id", "space", "copies", "v").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("t")).where("t > 0")
    whole = (F.coalesce("n", F.lit(0)) >= F.col("t")).cast("double")
    shares = true.join(counted, "id", "left").groupBy(F.col("t") > K).agg(F.avg(whole).alias("share")).collect()
    return min((r["share"] for r in shares), default=1.0)


def near_duplicates(vectors: DataFrame, least: float = 0.98, label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row; vectors: vec_id, embedding and the label column.

    Rows are compared only where the label is equal and not null and the
    vectors have one length. Null, zero and non-finite vectors link with
    nothing, nor do rows without vec_id, whose component is null and which are
    kept. Each row counts as a vector of its own, so a repeated row links with
    its copies; rows with the same vec_id and vector get the same result. Other
    columns are not read; an empty table gives no rows.
    """
    small_batches(vectors)
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    usable_row = usable("embedding") & F.col(label).isNotNull() & F.col("vec_id").isNotNull()
    every = vectors.select("vec_id", F.when(usable_row, F.xxhash64(label, F.size("embedding"))).alias("space"), F.when(usable_row, F.col("embedding")).alias("v"))
    classes = every.where("v is not null").groupBy("space", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = scratch.save(classes.select("id", "space", "copies", "v"), "classes")
    floor = max(0.0, 4 * least**3 - 3 * least)
    orders, edges, step = 0, None, 0
    while True:
        fresh = first_neighbours(classes, floor, range(orders, orders + ORDERS))
        orders += ORDERS
        edges = scratch.save(fresh if edges is None else edges.union(fresh.join(edges.select("a", "b"), ["a", "b"], "left_anti")), f"edges-{(step := step + 1)}")
        for _ in range(ROUNDS):
            had = edges.count()
            more = scratch.save(descend(classes, edges, floor), f"more-{step}")
            new = more.count()
            if new:
                edges = scratch.save(edges.union(more), f"edges-{step + 1}")
                scratch.drop(f"edges-{step}")
                step += 1
            if new <= CHANGED * had:
                break
        links = edges.where(F.col("cosine") >= least).select("a", "b")
        parts = components(links, scratch, f"parts-{step}")
        full = classes.join(saturated(edges, least), "id", "left_semi")
        between = scratch.save(links_between(full, parts, least), f"between-{step}")
        if between.limit(1).count():
            parts = components(links.union(between), scratch, f"joined-{step}")
        counted = scratch.save(count_links(classes, parts, least), f"counts-{step}")
        if _audit(classes, counted, least) >= RECALL:
            break
        if orders >= MOST_ORDERS:
            rest = scratch.save(links_between(classes, parts, least), "rest")
            parts = components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(rest), scratch, "whole-parts")
            counted = scratch.save(count_links(classes, parts, least), "whole-counts")
            break
    named = classes.select("id", "space", "copies", "v").join(counted, "id", "left").join(parts, "id", "left")
    named = named.select(F.col("space").alias("s"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("root"))
    out = every.join(named, (F.col("space") == F.col("s")) & (F.col("v") == F.col("w")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, [x::DOUBLE FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS (
  SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, r, count(*) AS n FROM l GROUP BY a, r),
o AS (SELECT e.vec_id, max(coalesce(n.n, 0)) AS n FROM embeddings e LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id)
SELECT e.vec_id, coalesce(o.n, 0) AS n_links, c.b AS component_id, coalesce(e.vec_id = c.b, true) AS kept
FROM embeddings e LEFT JOIN o ON o.vec_id = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
