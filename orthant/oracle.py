"""SQL of the engine's queries for DuckDB, generated from the same parameters."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

#: A small table of benchmark results: algorithm, distribution, size, parameter, depth, precision, runtime.
RESULTS = [
    (algorithm, distribution, f"2^{k}", parameter, depth, round(p + depth / 8, 3), round(scale * k * 2**k / 1000 + depth / 10 + shift, 4))
    for algorithm, parameter, p, scale, shift in (("canonical", "accuracy = 10", 2.5, 0.4, 1.0), ("canonical", "accuracy = 100", 3.5, 0.5, 1.5), ("harmonic", "J = [2, 3, 3]", 3.0, 0.2, 2.0))
    for distribution in ("blobs", "normal")
    for k in (10, 11, 12)
    for depth in (4, 6)
    if (parameter, k) != ("J = [2, 3, 3]", 12)
]
#: Entries of the kernel queries, and odd frequencies of those with products.
KERNEL, KERNEL_ORDER = 5, 4
#: What all points of a seed give, as seed, points, points at the edge of the extent, means of x, y and xy, least and greatest coordinate.
SEEDS: dict[str, list[tuple]] = {
    "generate_blobs": [(0, 1048576, 52, 49.674865, 49.608652, 2505.330915, 0.0, 100.0), (1, 1048576, 42, 49.655003, 49.610885, 2506.279804, 0.0, 100.0)],
    "generate_normal": [(0, 1048576, 0, -0.00076, 0.000848, 0.498503, -4.844881, 5.173453), (1, 1048576, 0, 6.5e-05, -0.000671, 0.500635, -4.872264, 4.860898)],
}
LABELS = (("accuracy = 10", "coarse"), ("accuracy = 100", "fine"))
_VALUES = "r(algorithm, distribution, size, parameter, depth, precision, runtime) AS (VALUES " + ", ".join(f"('{a}', '{d}', '{s}', '{p}', {n}::INT, {x}::DOUBLE, {t}::DOUBLE)" for a, d, s, p, n, x, t in RESULTS) + ")"


def tree_ctes(rows: str, key: str, axes: Sequence[str], depth: int, median: str) -> str:
    """CTEs: l0..l<depth> (the rows with their node at each level) and s0..s<depth-1> (node, point)."""
    out = [f"l0 AS (SELECT *, 0::BIGINT AS node FROM ({rows}))"]
    for d in range(depth):
        x = axes[d % len(axes)]
        out.append(f"s{d} AS (SELECT node, {median.format(x=f'{x}::DOUBLE')} AS point FROM l{d} GROUP BY node)")
        out.append(f"l{d + 1} AS (SELECT l.* EXCLUDE (node), l.node * 2 + (l.{x}::DOUBLE > s.point)::BIGINT AS node FROM l{d} l JOIN s{d} s ON l.node = s.node)")
    return ",\n".join(out)


def union_splits(axes: Sequence[str], depth: int) -> str:
    return " UNION ALL ".join(f"SELECT {d}::INT AS depth, '{axes[d % len(axes)]}' AS variable, node, point FROM s{d}" for d in range(depth))


def _g(w: str, k: str, a: str, b: str) -> str:
    """A coefficient of the indicator of (a, b) for frequency w and kind k."""
    w = f"greatest({w}, 1)"
    return (
        f"CASE {k} WHEN '1' THEN 1 - 0.5 * (({a} > 0)::INT + ({b} < 1)::INT)"
        f" WHEN 'c' THEN 2 / (pi() * {w}) * (CASE WHEN {b} < 1 THEN sin({w} * {b}) ELSE 0 END - CASE WHEN {a} > 0 THEN sin({w} * {a}) ELSE 0 END)"
        f" ELSE 2 / (pi() * {w}) * (CASE WHEN {a} > 0 THEN cos({w} * {a}) ELSE 0 END - CASE WHEN {b} < 1 THEN cos({w} * {b}) ELSE 0 END) END"
    )


def _harmonics(order: int) -> str:
    return f"h AS (SELECT 0 AS w, '1' AS k UNION ALL SELECT 2 * i + 1, x FROM range({order}) t(i), (VALUES ('c'), ('s')) y(x))"


def _basis(x: str) -> str:
    return f"CASE k WHEN '1' THEN 1 WHEN 'c' THEN cos(w * {x}) ELSE sin(w * {x}) END"


def _bisect(name: str, moments: str, nodes: str, steps: int = 50) -> str:
    """A recursive CTE that halves each node's interval; moments: node, w, k, m; nodes: node, a, c."""
    f = f"sum(m.m * ({_g('m.w', 'm.k', 'q.a', 'q.mid')} - ({_g('m.w', 'm.k', 'q.mid', 'q.c')})))"
    return (
        f"{name}(i, node, lo, hi, a, c) AS (SELECT 0, node, a, c, a, c FROM {nodes} UNION ALL "
        f"SELECT i + 1, node, CASE WHEN f < 0 THEN mid ELSE lo END, CASE WHEN f < 0 THEN hi ELSE mid END, a, c FROM ("
        f"SELECT q.i, q.node, q.lo, q.hi, q.a, q.c, q.mid, {f} AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name} WHERE i < {steps}) q JOIN {moments} m ON m.node = q.node GROUP BY ALL))"
    )


def harmonic_ctes(rows: str, key: str, axes: Sequence[str], order: int, depth: int) -> str:
    """CTEs of a tree from one tensor: b (bounds), p<d> (node, unit point), l<depth> (rows with nodes), s<d> (node, point)."""
    dims = range(len(axes))
    each = lambda form: ", ".join(form.format(i=i, a=axes[i]) for i in dims)
    joins = " ".join(f"JOIN e{i} USING (id)" for i in dims[1:])
    out = [
        f"o AS (SELECT {key} AS id, {each('{a}::DOUBLE AS x{i}')} FROM ({rows}))",
        f"b AS (SELECT {each('min(x{i}) AS lo{i}, max(x{i}) AS hi{i}')} FROM o)",
        f"z AS MATERIALIZED (SELECT id, {each('(x{i} - lo{i}) / (hi{i} - lo{i}) AS z{i}')} FROM o, b)",
        _harmonics(order),
        *[f"e{i} AS MATERIALIZED (SELECT id, w, k, {_basis(f'z{i}')} AS e FROM z, h)" for i in dims],
        f"t AS MATERIALIZED (SELECT {each('e{i}.w AS w{i}, e{i}.k AS k{i}')}, avg({' * '.join(f'e{i}.e' for i in dims)}) AS t FROM e0 {joins} GROUP BY ALL)",
        f"c0 AS (SELECT 0::BIGINT AS node, {each('0::DOUBLE AS a{i}, 1::DOUBLE AS c{i}')})",
        "l0 AS (SELECT *, 0::BIGINT AS node FROM o)",
    ]
    for d in range(depth):
        i = d % len(axes)
        weights = " * ".join(["t", *(f"({_g(f'w{j}', f'k{j}', f'a{j}', f'c{j}')})" for j in dims if j != i)])
        half = lambda side, i=i: ", ".join(f"unit AS {e}" if e == f"{side}{i}" else e for j in dims for e in (f"a{j}", f"c{j}"))
        out += [
            f"m{d} AS MATERIALIZED (SELECT node, w{i} AS w, k{i} AS k, sum({weights}) AS m FROM t, c{d} GROUP BY ALL)",
            f"n{d} AS (SELECT node, a{i} AS a, c{i} AS c FROM c{d})",
            _bisect(f"r{d}", f"m{d}", f"n{d}"),
            f"p{d} AS MATERIALIZED (SELECT node, (lo + hi) / 2 AS unit FROM r{d} WHERE i = 50)",
            f"s{d} AS (SELECT node, lo{i} + unit * (hi{i} - lo{i}) AS point FROM p{d}, b)",
            f"c{d + 1} AS (SELECT node * 2 AS node, {half('c')} FROM c{d} JOIN p{d} USING (node) UNION ALL SELECT node * 2 + 1, {half('a')} FROM c{d} JOIN p{d} USING (node))",
            f"l{d + 1} AS MATERIALIZED (SELECT l.* EXCLUDE (node), l.node * 2 + (x{i} > point)::BIGINT AS node FROM l{d} l JOIN s{d} s ON l.node = s.node)",
        ]
    return ",\n".join(out)


def batched_ctes(rows: str, key: str, axes: Sequence[str], order: int, depth: int) -> str:
    """As harmonic_ctes, with a batch of its own for each level: every node has moments of one variable within its cell."""
    out = [
        f"o AS (SELECT {key}, {axes[0]}::DOUBLE AS x, {axes[1]}::DOUBLE AS y FROM ({rows}))",
        _harmonics(order),
        f"l0 AS (SELECT {key}, x, y, 0::BIGINT AS node FROM o)",
        "c0 AS (SELECT 0::BIGINT AS node, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM o)",
    ]
    for d in range(depth):
        e = "xy"[d % 2]
        out += [
            f"m{d} AS MATERIALIZED (SELECT node, w, k, avg({_basis('z')}) AS m FROM (SELECT l.node, ({e} - {e}0) / ({e}1 - {e}0) AS z FROM l{d} l JOIN c{d} c ON l.node = c.node), h GROUP BY ALL)",
            f"n{d} AS (SELECT DISTINCT node, 0::DOUBLE AS a, 1::DOUBLE AS c FROM m{d})",
            _bisect(f"r{d}", f"m{d}", f"n{d}"),
            f"s{d} AS MATERIALIZED (SELECT node, {e}0 + (lo + hi) / 2 * ({e}1 - {e}0) AS point FROM r{d} JOIN c{d} USING (node) WHERE i = 50)",
            f"c{d + 1} AS (SELECT node * 2 AS node, " + ", ".join("point AS " + q if q == f"{e}1" else q for q in ("x0", "x1", "y0", "y1")) + f" FROM c{d} JOIN s{d} USING (node) UNION ALL SELECT node * 2 + 1, " + ", ".join("point" if q == f"{e}0" else q for q in ("x0", "x1", "y0", "y1")) + f" FROM c{d} JOIN s{d} USING (node))",
            f"l{d + 1} AS MATERIALIZED (SELECT {key}, x, y, l.node * 2 + ({e} > point)::BIGINT AS node FROM l{d} l JOIN s{d} s ON l.node = s.node)",
        ]
    return ",\n".join(out)


def _counts(depth: int) -> str:
    return f"SELECT node AS leaf, count(*) AS count FROM l{depth} GROUP BY node"


def _precision(depth: int) -> str:
    return f"SELECT CASE WHEN off = 0 THEN 'inf'::DOUBLE ELSE round(-ln(off / total), 9) END AS precision FROM (SELECT sum(abs(n - mean)) AS off, sum(n) AS total FROM (SELECT n, avg(n) OVER () AS mean FROM (SELECT count(*) AS n FROM l{depth} GROUP BY node)))"


def _balance(most: str = "orders") -> str:
    return f"SELECT count(*)::BIGINT AS rows, true AS balanced FROM {most}"


def queries(axes: Sequence[str], key: str, depth: int, j: Sequence[int], j3: Sequence[int], harmonic_depth: int) -> dict[str, str]:
    x, y = axes
    rows, order = f"SELECT {key}, {x}, {y} FROM orders", prod(j)
    sketch = "quantile_disc({x}, 0.5)"
    canonical = lambda d, r=rows: tree_ctes(r, key, axes, d, sketch)
    unit = lambda c: f"({c} - (SELECT min({c}) FROM orders)) / ((SELECT max({c}) - min({c}) FROM orders))::DOUBLE"
    out = {
        "bounds": "SELECT " + ", ".join(f"{f}({c})::DOUBLE AS {side}_{c}" for c in axes for side, f in (("lower", "min"), ("upper", "max"))) + " FROM orders",
        "normalize": f"SELECT {key}, " + ", ".join(f"round({unit(c)}, 9) AS {c}_unit" for c in axes) + " FROM orders",
        "moments_1d": f"WITH {_harmonics(18)} SELECT w::INT AS w0, k AS k0, round(avg({_basis('z')}), 8) + 0.0 AS moment FROM (SELECT {unit(x)} AS z FROM orders), h GROUP BY ALL",
        "moments_2d": f"WITH {_harmonics(6)} SELECT a.w::INT AS w0, a.k AS k0, c.w::INT AS w1, c.k AS k1, round(avg(({_basis('u').replace('w *', 'a.w *').replace('CASE k', 'CASE a.k')}) * ({_basis('v').replace('w *', 'c.w *').replace('CASE k', 'CASE c.k')})), 8) + 0.0 AS moment FROM (SELECT {unit(x)} AS u, {unit(y)} AS v FROM orders), h a, h c GROUP BY ALL",
        "harmonic_root_split": f"WITH RECURSIVE {_harmonics(18)}, b AS (SELECT min({x}) AS x0, max({x}) AS x1 FROM orders), m AS MATERIALIZED (SELECT 0 AS node, w, k, avg({_basis('z')}) AS m FROM (SELECT ({x} - x0) / (x1 - x0) AS z FROM orders, b), h GROUP BY ALL), n AS (SELECT 0 AS node, 0::DOUBLE AS a, 1::DOUBLE AS c), {_bisect('r', 'm', 'n')} SELECT round(x0 + (lo + hi) / 2 * (x1 - x0), 4) AS point FROM r, b WHERE i = 50",
        "canonical_splits": f"WITH {canonical(depth)} SELECT depth, variable, node, round(point, 4) AS point FROM ({union_splits(axes, depth)})",
        "canonical_leaf_counts": f"WITH {canonical(depth)} {_counts(depth)}",
        "leaf_assign": f"WITH {canonical(depth)} SELECT {key}, node AS leaf FROM l{depth}",
        "tied_leaf_counts": "WITH " + tree_ctes("SELECT l_extendedprice, l_discount FROM lineitem", "", ("l_extendedprice", "l_discount"), depth, sketch) + " " + _counts(depth),
        "exact_local_splits": f"WITH {tree_ctes(rows, key, axes, 4, 'median({x})')} SELECT depth, variable, node, round(point, 4) AS point FROM ({union_splits(axes, 4)})",
        "precision": f"WITH {canonical(depth)} {_precision(depth)}",
        "precision_by_depth": f"WITH {canonical(4)} " + " UNION ALL ".join(f"SELECT {d}::INT AS depth, precision FROM ({_precision(d)})" for d in (2, 3, 4)),
        "harmonic_tree_splits": f"WITH RECURSIVE {harmonic_ctes(rows, key, axes, order, harmonic_depth)} SELECT depth, variable, node, round(point, 4) AS point FROM ({union_splits(axes, harmonic_depth)})",
        "harmonic_leaf_counts": f"WITH RECURSIVE {harmonic_ctes(rows, key, axes, order, harmonic_depth)} {_counts(harmonic_depth)}",
        "harmonic_batched_leaf_counts": f"WITH RECURSIVE {batched_ctes(rows, key, axes, order, harmonic_depth)} {_counts(harmonic_depth)}",
    }
    local = [f"s{d} AS (SELECT node, median({e}) AS point FROM l{d} GROUP BY node), l{d + 1} AS (SELECT l.* EXCLUDE (node), l.node * 2 + ({e} > point)::BIGINT AS node FROM l{d} l JOIN s{d} s ON l.node = s.node)" for d, e in ((harmonic_depth, "x0"), (harmonic_depth + 1, "x1"))]
    out["harmonic_local_depth"] = f"WITH RECURSIVE {harmonic_ctes(rows, key, axes, order, harmonic_depth)}, {', '.join(local)} {_counts(harmonic_depth + 2)}"
    # cells by walking down the levels
    cells = [f"c0 AS (SELECT 0::BIGINT AS node, min({x})::DOUBLE AS x0, max({x})::DOUBLE AS x1, min({y})::DOUBLE AS y0, max({y})::DOUBLE AS y1 FROM orders)"]
    for d in range(4):
        e = "xy"[d % 2]
        cells.append(f"c{d + 1} AS (SELECT node * 2 AS node, " + ", ".join("point AS " + q if q == f"{e}1" else q for q in ("x0", "x1", "y0", "y1")) + f" FROM c{d} JOIN s{d} USING (node) UNION ALL SELECT node * 2 + 1, " + ", ".join("point" if q == f"{e}0" else q for q in ("x0", "x1", "y0", "y1")) + f" FROM c{d} JOIN s{d} USING (node))")
    out["cell_boxes"] = f"WITH {canonical(4)}, {', '.join(cells)} SELECT node AS leaf, '{x}' AS variable, round(x0, 4) AS lower, round(x1, 4) AS upper FROM c4 UNION ALL SELECT node, '{y}', round(y0, 4), round(y1, 4) FROM c4"
    boxes = (1 << d for d in range(5))
    out["tree_nodes"] = (
        f"WITH {canonical(4)}, a AS (SELECT level, leaf FROM (VALUES " + ", ".join(f"({d}, {n}::BIGINT)" for d, size in enumerate(boxes) for n in range(size)) + ") v(level, leaf)), i AS (SELECT level, leaf, (1::BIGINT << level) - 1 + leaf AS node_id FROM a) "
        f"SELECT node_id, level::INT AS level, coalesce(s.variable, '-') AS axis, leaf, round(coalesce(s.point, -1), 4) AS median, CASE WHEN node_id > 0 THEN (node_id - 1) // 2 ELSE -1 END AS parent_id, CASE WHEN level < 4 THEN 2 * node_id + 1 ELSE -1 END AS left_id, CASE WHEN level < 4 THEN 2 * node_id + 2 ELSE -1 END AS right_id FROM i LEFT JOIN ({union_splits(axes, 4)}) s ON s.depth = i.level AND s.node = i.leaf"
    )
    hash_ = lambda seed: f"md5({key} || '|{seed}')"
    cut = f"b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {hash_(1)}) AS k FROM l4), e AS (SELECT * FROM b WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM l4 GROUP BY node)))"
    out["balanced_cells"] = f"WITH {canonical(4)}, {cut} SELECT {key}, node AS leaf FROM e"
    out["representative_samples"] = f"WITH {canonical(4)}, {cut} SELECT {key}, k - 1 AS sample FROM e"
    out["random_samples"] = f"WITH n AS (SELECT greatest(1, count(*) // 50) AS n FROM orders), r AS (SELECT {key}, row_number() OVER (ORDER BY {hash_(1)}) % n AS i FROM orders, n) SELECT {key}, row_number() OVER (PARTITION BY i ORDER BY {hash_(2)}) - 1 AS sample FROM r"
    out["stratified_sample"] = f"WITH {canonical(4)} SELECT {key}, leaf FROM (SELECT {key}, node AS leaf, row_number() OVER (PARTITION BY node ORDER BY {hash_(1)}) AS k FROM l4) WHERE k <= 100"
    sampled = [f"l0 AS (SELECT *, 0::BIGINT AS node FROM ({rows}))"]
    for d in range(4):
        e = axes[d % 2]
        if d % 2 == 0:
            sampled.append(f"q{d} AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {hash_(1)}) AS k FROM l{d}) WHERE k <= 128)")
        sampled.append(f"s{d} AS (SELECT node, median({e}::DOUBLE) AS point FROM q{d} GROUP BY node)")
        for t in ("l", "q") if d % 2 == 0 else ("l",):
            sampled.append(f"{t}{d + 1} AS (SELECT a.* EXCLUDE (node), a.node * 2 + (a.{e} > s.point)::BIGINT AS node FROM {t}{d} a JOIN s{d} s ON a.node = s.node)")
    out["sampled_tree_counts"] = f"WITH {', '.join(sampled)} {_counts(4)}"
    z = f"({x} - lo) / (hi - lo)"
    leaf_box = "w AS (SELECT node AS leaf, x0 AS lo, x1 AS hi FROM c2)"
    out["moments_by_leaf"] = (
        f"WITH {canonical(2)}, {', '.join(cells[:3])}, {leaf_box}, h AS (SELECT 0 AS pos, 0 AS w, '1' AS k UNION ALL SELECT 2 * i + 1, 2 * i + 1, 'c' FROM range(4) t(i) UNION ALL SELECT 2 * i + 2, 2 * i + 1, 's' FROM range(4) t(i)) "
        f"SELECT leaf, count(*) AS count, pos::INT AS pos, round(avg({_basis('z')}), 8) + 0.0 AS moment FROM (SELECT w.leaf, {z} AS z FROM l2 JOIN w ON l2.node = w.leaf), h GROUP BY leaf, pos"
    )
    out["box_filter"] = f"SELECT {key} FROM orders WHERE {x} BETWEEN 100000 AND 200000 AND {y} BETWEEN 100 AND 700"
    out["leaves_of_box"] = f"WITH {canonical(4)}, {', '.join(cells)} SELECT node AS leaf FROM c4 WHERE x0 <= 200000 AND x1 >= 100000 AND y0 <= 700 AND y1 >= 100"
    out["stream_leaf_counts"] = f"WITH {canonical(2).replace(rows, f'SELECT {key}, {x}, {y}, o_orderdate FROM orders', 1)} SELECT (epoch(o_orderdate)::BIGINT // 2592000) * 2592000 AS start, node AS leaf, count(*) AS count FROM l2 GROUP BY ALL"
    out["stream_moments"] = f"WITH {_harmonics(6)} SELECT 0::BIGINT AS leaf, count(*) AS count, (w - 1 + (k = 's')::INT)::INT AS pos, round(avg({_basis('z')}), 6) + 0.0 AS moment FROM (SELECT {unit(x)} AS z FROM orders), h WHERE w > 0 GROUP BY w, k"
    default = prod((2, 4, 4))
    out["harmonic_default_splits"] = f"WITH RECURSIVE {harmonic_ctes(rows, key, axes, default, 2)} SELECT depth, variable, node, round(point, 4) AS point FROM ({union_splits(axes, 2)})"
    out["harmonic_default_counts"] = f"WITH RECURSIVE {harmonic_ctes(rows, key, axes, default, 2)} {_counts(2)}"
    out["harmonic_default_batched"] = f"WITH RECURSIVE {batched_ctes(rows, key, axes, default, 4)} {_counts(4)}"
    three = (*axes, key)
    out["harmonic_three_variables"] = f"WITH RECURSIVE {harmonic_ctes(rows, key, three, prod(j3), 3)} SELECT depth, variable, node, round(point, 4) AS point FROM ({union_splits(three, 3)})"
    out |= {name: _balance() for name in ("harmonic_deep_balance", "canonical_sketch_balance", "sampled_tree_random")}
    out["canonical_sketch_error"] = "SELECT accuracy::INT AS accuracy, variable, true AS within FROM (VALUES (100), (1000)) a(accuracy), (VALUES " + ", ".join(f"('{a}')" for a in axes) + ") v(variable)"
    out["sampled_by_leaf"] = f"WITH {canonical(4)} SELECT node AS leaf, least(count(*), 40) AS count FROM l4 GROUP BY node"
    out["random_representatives"] = f"WITH {canonical(4)}, n AS (SELECT count(*) AS n FROM l4 GROUP BY node) SELECT unnest(range(min(n))) AS sample, count(*) AS rows FROM n"
    out["random_sample_sizes"] = "WITH n AS (SELECT count(*) AS c, greatest(1, count(*) // 50) AS n FROM orders) SELECT sample, least(n, c - sample * n) AS rows FROM (SELECT n, c, unnest(range((c + n - 1) // n)) AS sample FROM n)"
    out["points_round_trip"] = f"SELECT {key}, {x} FROM orders"
    out["results_round_trip"] = f"WITH {_VALUES} SELECT *, 1::INT AS fold FROM r"
    grid = " UNION ALL ".join(f"SELECT {d}::INT AS depth, precision FROM ({_precision(d)})" for d in (2, 3))
    out["bench_run"] = f"WITH {canonical(3)} SELECT 'canonical' AS algorithm, 'orders' AS distribution, (SELECT '2^' || floor(log2(count(*)))::INT FROM orders) AS size, parameter, depth, precision, fold::INT AS fold, true AS timed FROM ({grid}), (VALUES ('accuracy = 1000000'), ('accuracy = 10000000')) p(parameter), (VALUES (1), (2)) f(fold)"
    out |= {name: "SELECT seed::BIGINT AS seed, points::BIGINT AS points, at_edge::BIGINT AS at_edge, mean_x::DOUBLE AS mean_x, mean_y::DOUBLE AS mean_y, mean_xy::DOUBLE AS mean_xy, least::DOUBLE AS least, greatest::DOUBLE AS greatest FROM (VALUES " + ", ".join(map(str, values)) + ") v(seed, points, at_edge, mean_x, mean_y, mean_xy, least, greatest)" for name, values in SEEDS.items()}
    angles = lambda n, form: f"SELECT {key}, j::INT AS j, round({form}, 4) + 0.0 AS value FROM (SELECT {key}, o_custkey / 1000 AS x FROM orders), range({n}) r(j)"
    wide = prod(j3)
    out |= {
        "kernel_odd_powers": angles(KERNEL, "cos((2 * j + 1) * x)"),
        "kernel_powers": angles(KERNEL, "cos(j * x)"),
        "kernel_sine_products": angles(KERNEL, "pow(sin(x), 2 * j + 1)"),
        "kernel_signs": angles(KERNEL, "sin((2 * j + 1) * x)"),
        "kernel_cosine_tensor": angles(wide, "cos((2 * j + 1) * x)"),
        "kernel_sine_tensor": angles(wide, "sin((2 * j + 1) * x)"),
        "kernel_power_tensor": angles(2 * wide, "CASE WHEN j % 2 = 0 THEN cos((j + 1) * x) ELSE sin(j * x) END"),
        "kernel_moments": f"WITH {_harmonics(KERNEL_ORDER)} SELECT a.w::INT AS w0, a.k AS k0, c.w::INT AS w1, c.k AS k1, round(avg(({_basis('u').replace('w *', 'a.w *').replace('CASE k', 'CASE a.k')}) * ({_basis('v').replace('w *', 'c.w *').replace('CASE k', 'CASE c.k')})), 6) + 0.0 AS moment FROM (SELECT {unit(x)} AS u, {unit(y)} AS v FROM orders), h a, h c GROUP BY ALL",
    }
    means = f"WITH {_VALUES}, g AS (SELECT parameter, pow(2, substr(size, 3)::DOUBLE) AS n, avg(runtime) AS runtime FROM r GROUP BY ALL)"
    model = f"{means}, f AS (SELECT parameter, regr_slope(runtime, n * ln(n)) AS a, regr_intercept(runtime, n * ln(n)) AS b FROM g GROUP BY parameter HAVING count(*) >= 3)"
    out |= {
        "bench_union_filter": f"WITH {_VALUES} SELECT * FROM r WHERE algorithm = 'canonical' AND size IN ('2^10', '2^12')",
        "bench_mean_runtime": f"{means} SELECT parameter, n, round(runtime, 9) AS runtime FROM g",
        "bench_fit": f"{model} SELECT parameter, round(a * 1e6, 6) AS a_micro, round(b, 6) AS b FROM f",
        "bench_extrapolate": f"{model} SELECT parameter, n, round(a * n * ln(n) + b, 2) AS runtime FROM f, (VALUES ({2**32}::DOUBLE), ({2**34}::DOUBLE), ({2**36}::DOUBLE)) v(n)",
        "bench_labels": f"WITH {_VALUES} SELECT algorithm, size, parameter, CASE parameter " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LABELS) + " ELSE parameter END AS label, depth, distribution FROM r",
    }
    return out
