"""Trees, routing, builders and consumers on small and awkward tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant import frames
from orthant.functions import moments
from orthant.operators import consume, quantile
from orthant.operators.harmonic import harmonic_tree
from orthant.operators.quantile import canonical_tree, exact_tree, normalize
from orthant.operators.routing import INLINE, assign
from orthant.operators.sampled import sampled_tree, stratified_sample, subtree
from orthant.plans.tree import SplitTree, batches, from_splits, rounds, schedule
from orthant.sources import points, report

BUILDERS = {
    "canonical": lambda df, v, depth: canonical_tree(df, v, depth, 1000),
    "exact": exact_tree,
    "harmonic": lambda df, v, depth: harmonic_tree(df, v, (2, 3), depth),
    "batched": lambda df, v, depth: harmonic_tree(df, v, (2, 3), depth, batch_size=1),
    "sampled": lambda df, v, depth: sampled_tree(df, v, depth, step=2, sigma=64),
}


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.permutation(256 * 2).reshape(256, 2))]
    return spark.createDataFrame(rows, "id long, x double, y double").cache()


def test_schedules():
    assert schedule(["a", "b"], 3) == ["a", "b", "a"] and schedule([], 0) == []
    assert batches(["a", "b", "a"], 2) == [["a", "b"], ["a"]] and batches(["a"], None) == [["a"]]
    assert rounds(8, 4) == [4, 4] and rounds(5, 4) == [4, 1]
    with pytest.raises(ValueError):
        schedule([], 1)


@pytest.mark.parametrize("name", BUILDERS)
def test_builders_keep_rows_and_balance(name, grid):
    tree = BUILDERS[name](grid, ["x", "y"], 4)
    counts = consume.leaf_counts(grid, tree).collect()
    assert [len(p) for p in tree.points] == [1, 2, 4, 8]
    assert sum(r["count"] for r in counts) == 256 and all(0 <= r["leaf"] < 16 for r in counts)
    assert consume.precision(grid, tree) > (1 if name in ("harmonic", "batched") else 2)


def test_exact_medians_balance_perfectly(grid):
    assert consume.precision(grid, exact_tree(grid, ["x", "y"], 4)) == math.inf


def test_precision_with_expected_leaves(grid, spark):
    half = SplitTree(("x",), ((1e9,),))
    assert consume.precision(grid, half) == math.inf
    assert consume.precision(grid, half, expected_leaves=2) == pytest.approx(-math.log((256 - 128 + 128) / 256))


@pytest.mark.parametrize("name", BUILDERS)
@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(3.0, float(i)) for i in range(9)], [(5.0, 5.0)] * 7, [(-1.0, -2.0), (0.0, 4.0), (2.0, 1.0)], [(None, 1.0), (1.0, None), (2.0, 3.0), (4.0, 1.0)]])
def test_awkward_tables(name, rows, spark):
    df = spark.createDataFrame(rows, "x double, y double")
    tree = BUILDERS[name](df, ["x", "y"], 3)
    whole = [r for r in rows if None not in r]
    assert tree.depth == 3
    assert sum(r["count"] for r in consume.leaf_counts(df, tree).collect()) == len(whole)
    assert consume.balanced_cells(df, tree).count() <= len(whole)


def test_nan_goes_right(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert [r["leaf"] for r in assign(df, SplitTree(("x",), ((1.0,),))).orderBy("x").collect()] == [0, 1]


@pytest.mark.parametrize("name", BUILDERS)
def test_one_variable_integers_and_defaults(name, spark):
    df = spark.range(64).select(F.col("id").cast("int").alias("leaf"), F.lit("z").alias("extra"))
    tree = BUILDERS[name](df, ["leaf"], None)
    assert tree.depth == 1 and consume.leaf_counts(df, tree).count() == 2


def test_depth_zero(grid):
    for build in BUILDERS.values():
        tree = build(grid, ["x", "y"], 0)
        assert [tuple(r) for r in consume.leaf_counts(grid, tree).collect()] == [(0, 256)]


def test_deep_trees_are_joined(spark):
    depth = INLINE + 2
    df = spark.range(1 << 15).select((F.col("id") / 7).alias("x"))
    tree = SplitTree()
    top = ((1 << 15) - 1) / 7
    for d in range(depth):
        n = 1 << d
        tree = tree.grown("x", {k: top * (2 * k + 1) / (2 * n) for k in range(n)})
    got = assign(df, tree).select("x", "leaf").collect()
    assert all(r["leaf"] == min((1 << depth) - 1, math.ceil(r["x"] / top * (1 << depth)) - 1 if r["x"] > 0 else 0) for r in got[:: 1 << 9])


def test_views(grid, spark):
    tree = canonical_tree(grid, ["x", "y"], 3, 1000)
    nodes = {r["node_id"]: r for r in tree.to_nodes(spark).collect()}
    assert len(nodes) == 15 and nodes[0]["parent_id"] is None and nodes[4]["parent_id"] == 1 and nodes[14]["left_id"] is None
    assert from_splits([tuple(r) for r in tree.to_splits(spark).collect()]).points == tree.points
    boxes = tree.boxes()
    assert len(boxes) == 8 and boxes[0]["x"][0] == dict(tree.lower)["x"] and boxes[7]["x"][1] == dict(tree.upper)["x"]
    inside = assign(grid, tree).collect()
    assert all(boxes[r["leaf"]][v][0] <= r[v] <= boxes[r["leaf"]][v][1] for r in inside for v in "xy")


def test_samples(grid):
    tree = exact_tree(grid, ["x", "y"], 3)
    cells = consume.balanced_cells(grid, tree, ["id"])
    assert {r["count"] for r in cells.groupBy("leaf").count().collect()} == {32}
    samples = consume.representative_samples(grid, tree, 3)
    assert "leaf" not in samples.columns and {r["count"] for r in samples.groupBy("sample").count().collect()} == {8}
    draws = consume.random_samples(grid, 10, 3)
    assert draws.count() == 256 and 10 <= draws.agg(F.max("sample")).first()[0] + 1 <= 11
    assert consume.random_samples(grid, 1000).agg(F.max("sample")).first()[0] == 255
    assert consume.random_samples(grid, 10, 3, ["id"]).exceptAll(consume.random_samples(grid.repartition(7), 10, 3, ["id"])).count() == 0


def test_stratified_sample_caps(grid):
    df = assign(grid, exact_tree(grid, ["x"], 2))
    assert {r["count"] for r in stratified_sample(df, 10, 0, key=["id"]).groupBy("leaf").count().collect()} == {10}
    assert all(r["count"] <= 10 for r in stratified_sample(df, 10, 20).groupBy("leaf").count().collect())


def test_plans_stay_linear_in_depth(grid):
    sizes = []
    for depth in (4, 8):
        tree = SplitTree()
        for d in range(depth):
            tree = tree.grown("xy"[d % 2], dict.fromkeys(range(1 << d), 1.0))
        sizes.append(consume.leaf_counts(grid, tree)._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN"))
    assert sizes == [8, 16]


def test_boxes(grid):
    tree, box = exact_tree(grid, ["x", "y"], 4), {"x": (10.0, 90.0), "y": (100.0, 300.0)}
    rows = consume.in_box(grid, tree, box).collect()
    assert len(rows) == grid.where("x between 10 and 90 and y between 100 and 300").count()
    assert {r["leaf"] for r in rows} <= set(consume.leaves_of_box(tree, box)) < set(range(16))


def test_subtree_of_nothing():
    assert subtree(np.empty((0, 1)), 2, [0, 0]) == [[None], [None, None]]


def test_normalize_constant(spark):
    assert [r["x_unit"] for r in normalize(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), ["x"]).collect()] == [0.0, 0.0, None]


def test_generators_repeat_and_round_trip(spark, tmp_path):
    a = points.blobs(spark, 1, 500)
    assert a.count() == 1000 and a.exceptAll(points.blobs(spark, 1, 500)).count() == 0
    assert a.agg(F.min("x") >= 0, F.max("x") <= 100).first()[:] == (True, True)
    points.write_points(points.normal(spark, 0, 2000), str(tmp_path / "n"))
    back = points.read_points(spark, str(tmp_path / "n"), ["x", "y"])
    assert abs(back.corr("x", "y") - 0.5) < 0.06


def test_results(spark, tmp_path):
    df = points.normal(spark, 0, 512)
    got = report.benchmark(spark, {("normal", "2^9"): df}, "exact", {"-": lambda x, d: exact_tree(x, ["x", "y"], d)}, [1, 2])
    report.write_results(got, str(tmp_path / "r"))
    back = report.read_results(spark, str(tmp_path / "r"))
    assert back.count() == 2 and report.panel(back, depth=2).count() == 1 and report.labelled(back, {}).columns[-1] == "label"
    made = spark.createDataFrame([("p", float(n), 3e-6 * n * math.log(n) + 2) for n in (1e3, 1e4, 1e5)] + [("q", 10.0, 1.0)], "parameter string, n double, runtime double")
    model = report.fit(made).collect()
    assert len(model) == 1 and model[0]["a"] == pytest.approx(3e-6) and model[0]["b"] == pytest.approx(2)


@pytest.mark.parametrize("few", [1, 4, 1 << 20])
def test_exact_points_equal_sorted_medians(spark, few):
    rng = np.random.default_rng(7)
    groups = [rng.normal(size=101), rng.lognormal(0, 9, 60), np.repeat([1.0, 2.0, 3.0], [50, 1, 49]), np.array([5.0]), np.array([1.0, 4.0]), np.full(40, -2.5), rng.integers(0, 4, 77).astype(float), np.array([-1.7e308, 1.7e308, 0.0, 1e-320, 2e-320, 3e-320])]
    rows = [(float(2 * g), float(v)) for g, x in enumerate(groups) for v in x]
    df = spark.createDataFrame(rows, "g double, x double").repartition(3)
    tree = SplitTree(("g", "g", "g"), ((7.0,), (3.0, 11.0), (1.0, 5.0, 9.0, 13.0)))
    got = quantile.exact_points(df, tree, "x", few)
    assert {k: v for k, v in got.items()} == {g: float(np.median(x)) for g, x in enumerate(groups)}


def test_exact_points_of_nan_and_null(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (nan, 1.0, None, 2.0, inf, -inf, 3.0)], "x double")
    assert quantile.exact_points(df, SplitTree(), "x", 1) == {0: 2.5}
    assert quantile.exact_points(df.where("isnan(x) or x > 2.5"), SplitTree(), "x") == {0: math.inf}
    assert math.isnan(quantile.exact_points(df.where("isnan(x)"), SplitTree(), "x")[0])
    assert quantile.exact_points(df.where("x > 3 and not isnan(x)"), SplitTree(), "x") == {0: math.inf}


def test_ranks_in_buckets_equal_plain_ranks(grid, monkeypatch):
    tree = exact_tree(grid, ["x"], 2)
    plain = {(r["id"], r["sample"]) for r in consume.representative_samples(grid, tree, 1, ["id"]).collect()}
    cells = {(r["id"], r["leaf"]) for r in consume.balanced_cells(grid, tree, ["id"], 1).collect()}
    monkeypatch.setattr(consume, "RANKED", 1)
    assert {(r["id"], r["sample"]) for r in consume.representative_samples(grid, tree, 1, ["id"]).collect()} == plain
    assert {(r["id"], r["leaf"]) for r in consume.balanced_cells(grid, tree, ["id"], 1).collect()} == cells
    assert {r["count"] for r in consume.representative_samples(grid, tree, 1).groupBy("sample").count().collect()} == {4}


def test_moments_add_up_by_chunks(grid, monkeypatch):
    whole = moments.moments(grid, ["x", "y"], 5, [0, 0], [512, 512])
    monkeypatch.setattr(moments, "CHUNK", 7)
    assert np.allclose(whole, moments.moments(grid.repartition(9), ["x", "y"], 5, [0, 0], [512, 512]), atol=1e-12)
    x = np.array([[r["x"], r["y"]] for r in grid.collect()]) / 512
    assert np.allclose(whole, moments.tensor_sum(x, 5) / len(x))
    leaves = moments.moments_by_leaf(grid.select((F.col("id") % 3).alias("leaf"), F.col("x").alias("x0")), 4, {k: (np.array([0.0]), np.array([512.0])) for k in range(3)}).collect()
    assert sorted(r["count"] for r in leaves) == [85, 85, 86] and all(len(r["moments"]) == 9 for r in leaves)


def test_precision_does_not_sort(grid):
    plan = consume.precision_of(consume.counts_by_leaf(grid, exact_tree(grid, ["x"], 2)))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()


def test_method_form(grid):
    frames.attach(type(grid))
    tree = grid.exact_tree(["x", "y"], 3)
    assert grid.tree_precision(tree) == math.inf and grid.leaf_counts(tree).count() == 8 and grid.assign_leaf(tree).columns[-1] == "leaf"
    assert {r["count"] for r in grid.representative_samples(["x", "y"], (2, 3), 2, seed=3).groupBy("sample").count().collect()} == {4}


def test_blobs_have_a_noise_point(spark):
    assert points.blobs(spark, 0, 10, seeds=True).agg(F.count("*"), F.max("seed")).first()[:] == (10, 0)
    assert points.blobs(spark, 0, 1).count() == 1


@pytest.mark.parametrize("few", [1, 1 << 20])
@pytest.mark.parametrize("accuracy", [1, 3, 20, 1000])
def test_lower_points_are_exact_whatever_the_sketch(spark, accuracy, few):
    rng = np.random.default_rng(11)
    groups = [rng.normal(size=1001), rng.normal(size=1000), np.repeat([1.0, 2.0, 3.0], [50, 1, 49]), np.array([5.0]), np.array([1.0, 4.0]), np.full(40, -2.5), np.repeat([-math.inf, 0.0, math.inf, math.nan], [5, 1, 9, 2]), np.repeat([7.0, math.nan], [2, 9])]
    rows = [(float(2 * g), float(v)) for g, x in enumerate(groups) for v in x]
    df = spark.createDataFrame(rows, "g double, x double").repartition(3)
    tree = SplitTree(("g", "g", "g"), ((7.0,), (3.0, 11.0), (1.0, 5.0, 9.0, 13.0)))
    got = quantile.lower_points(df, tree, "x", accuracy, few)
    assert {k: str(v) for k, v in got.items()} == {g: str(float(np.sort(x)[(len(x) - 1) // 2])) for g, x in enumerate(groups)}


def test_exact_canonical_tree_of_a_coarse_sketch(spark):
    df = spark.createDataFrame([(float(v), float(w)) for v, w in np.random.default_rng(5).normal(size=(4000, 2))], "x double, y double")
    coarse, exact = canonical_tree(df, ["x", "y"], 4, 20), canonical_tree(df, ["x", "y"], 4, 20, exact=True)
    assert consume.precision(df, exact) == math.inf > consume.precision(df, coarse)
