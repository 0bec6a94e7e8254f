"""Operators on pairs, groups and neighbours, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant.llm import op5_chat as op5
from orthant.llm import op6_hashing as op6
from orthant.llm import op7_minhash as op7
from orthant.llm import op8_embedding as op8
from orthant.llm import queries
from orthant.llm.common import Scratch, shared_dir
from orthant.llm.components import components, forest

pytest.importorskip("public_tokenizers")


def roots(n, links):
    """Smallest member of each node's component."""
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_forest():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.integers(0, 30, (2, 25))
        x, y = forest(a, b)
        got = dict(zip(x.tolist(), y.tolist(), strict=True))
        want = roots(30, zip(a.tolist(), b.tolist(), strict=True))
        assert all(got.get(i, i) == want[i] for i in range(30))


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 150)] + [(300, 301), (301, 302), (302, 300)], [(i, 500 - i) for i in range(250)] + [(i, i + 2) for i in range(0, 100, 2)]])
def test_components(links, spark):
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r["id"]: r["component"] for r in components(df, Scratch(spark, "test"), "c").collect()}
    want = roots(501, links)
    assert all(got.get(i, i) == want[i] for i in range(501))


def brute_documents(texts, words, percent):
    """(set sizes, roots) by the contract's words."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return [len(s) for s in sets], roots(len(texts), links)


def near_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [None, "", " \n", "One", "one", "one two", "ONE TWO", "one  two\tthree", "ÉCOLE x y z", "école x y z", "É", "é"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    centre = [rng.choice(vocabulary) for _ in range(100)]  # copies like it, not like each other
    for _ in range(40):
        copy = list(centre)
        for k in rng.sample(range(100), 2):
            copy[k] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(centre)] * 5 + [" ".join(rng.choice(vocabulary) for _ in range(30_000))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicate_documents(words, percent, spark, monkeypatch):
    monkeypatch.setattr(op7, "TILE", 16)
    texts = near_texts(words)
    docs = spark.createDataFrame([(i, t, 1, "c", 3) for i, t in enumerate(texts)], "doc_id long, text string, component long, id string, tile int").repartition(3)
    got = {r["doc_id"]: r for r in op7.near_duplicates(docs, words, percent).collect()}
    sizes, want = brute_documents(texts, words, percent)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def families(rng):
    """Texts of groups far larger than a tile: near copies of one text, and texts that share boilerplate but are no copies but for a few pairs."""
    vocabulary = [f"v{i}" for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts = []
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(80)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    shared = [rng.choice(vocabulary) for _ in range(80)]
    own = [[rng.choice(vocabulary) for _ in range(26)] for _ in range(120)]
    for k in (20, 40, 60):
        own[k] = [*own[k + 1][:-1], "x"]
    texts += [" ".join(shared + x) for x in own]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("budget", [(8, 1 << 22), (128, 4000)])
def test_large_groups(spark, monkeypatch, budget):
    monkeypatch.setattr(op7, "TILE", budget[0])
    monkeypatch.setattr(op7, "TILE_BYTES", budget[1])
    monkeypatch.setattr(op7, "REGION", 20)
    monkeypatch.setattr(op7, "BLOCK", 20)
    monkeypatch.setattr(op7, "MARGIN", 0.45)  # boilerplate joins loosely
    texts = families(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in op7.near_duplicates(docs, 3, 85).collect()}
    want = brute_documents(texts, 3, 85)[1]
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) == 118


def test_exact_sets():
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(200)] + [None, "A b\tc", "a  b c"]
    for words in (1, 3, 5):
        sets, offs = op7.exact_sets(pa.array(texts), words)
        own = [frozenset(sets[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        plain = []
        for t in texts:
            w = (t or "").lower().split()
            plain.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
        for i in range(0, len(texts), 7):
            assert [len(own[i] & x) for x in own] == [len(plain[i] & x) for x in plain]


def test_structured_documents(spark):
    from .test_text_operators import STRUCTURED

    texts = [f"{x} {y} end {x}" for x in STRUCTURED for y in STRUCTURED] + [f"{STRUCTURED[0]} {STRUCTURED[1]}  END {STRUCTURED[0]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7.near_duplicates(docs, 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(*brute_documents(texts, 3, 85), strict=True))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, "x y z u v w"), (3, "p q r s t u"), (4, "p q r s t u"), (5, "x y z u v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in op7.near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 3, False), (5, 3, False)}
    kept = op7.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3, 3]
    assert op7.near_duplicates(docs.limit(0)).count() == 0


def test_pairs_of_a_large_region_are_found_wherever_their_ids_are(spark):
    rng = np.random.default_rng(7)
    sig = rng.integers(0, 1 << 16, (3000, op7.HASHES)).astype(np.uint16)
    sig[:, :64] = sig[0, :64]  # all trees' keys agree, the estimate of 0.67 stays below 0.85 - MARGIN
    pairs = [(i, 2900 - 7 * i) for i in range(12)]
    for a, b in pairs:
        sig[b, 88:90], sig[b, 92:] = sig[a, 88:90], sig[a, 92:]
    rows = [(i, 100, x) for i, x in enumerate(sig.view(np.int64).tolist())]
    reps = spark.createDataFrame(rows, "doc_id long, n_shingles long, sig array<long>").repartition(3)
    got = {(min(r), max(r)) for r in op7.loose_links(reps, 85, Scratch(spark, "test")).collect()}
    assert got == set(pairs)


def test_search_of_a_region_connects_what_all_pairs_connect():
    rng = np.random.default_rng(8)
    for two in (False, True):
        base = rng.integers(0, 1 << 16, (30, op7.HASHES))
        sig = np.where(rng.random((300, op7.HASHES)) < 0.85, base[rng.integers(0, 30, 300)], rng.integers(0, 1 << 16, (300, op7.HASHES))).astype(np.uint16)
        side, sizes = np.repeat([0, int(two)], 150), rng.integers(80, 120, 300)
        i, j = op7._loose(sig, sizes, 0.7, 85)
        if two:
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
        x, y = op7._reached(sig, sizes, side, 0.7, 85)
        assert len(i) and roots(300, zip(x.tolist(), y.tolist(), strict=True)) == roots(300, zip(i.tolist(), j.tolist(), strict=True))


def vectors_of(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        for _ in range(60):
            rows.append((rng.normal(size=16), label))
        for _ in range(6):
            base = rng.normal(size=16)
            rows += [(base + rng.normal(size=16) * s, label) for s in (0, 0.05, 0.1, 0.15, 0.2)]
        base = rng.normal(size=16)
        rows += [(base + rng.normal(size=16) * 0.12, label) for _ in range(70)]
    rng.shuffle(rows)
    rows = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    rows += [(rows[0][0], rows[0][1]), (rows[0][0], rows[0][1]), (rows[0][0], None), (None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), ([float("inf")] * 16, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    return [(i, v, label, 9, "z", 1.5) for i, (v, label) in enumerate(rows)]


SCHEMA = "vec_id long, embedding array<float>, label int, id int, space string, v double"


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(op8, "TILE", 16)
    rows = vectors_of(spark)
    got = {r["vec_id"]: r for r in op8.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    links = []
    for j, (_, b, lb, *_) in enumerate(rows):
        for i, (_, a, la, *_) in enumerate(rows[:j]):
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((i, j))
    counts = np.bincount([k for p in links for k in p], minlength=len(rows))
    want = roots(len(rows), links)
    assert counts.max() > op8.K and [got[i]["n_links"] for i in range(len(rows))] == counts.tolist()
    assert [got[i]["component_id"] for i in range(len(rows))] == want and all(got[i]["kept"] == (want[i] == i) for i in got)


def dense_groups(apart):
    """Two dense groups, whose nearest members alone are linked, in unit vectors."""
    rng = np.random.default_rng(5)
    x = []
    for side in (-1, 1):
        angle = side * (apart / 2 + np.linspace(0, 0.03, 40))
        x += [np.concatenate([[np.cos(t), np.sin(t)], rng.normal(size=6) * 0.002]) for t in angle]
    return [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]


def linked(rows):
    """(links of each row, roots) by all pairs."""
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.98
    np.fill_diagonal(link, False)
    return link.sum(1).tolist(), roots(len(rows), zip(*np.nonzero(link), strict=True))


def test_links_between_saturated_groups(spark, monkeypatch):
    monkeypatch.setattr(op8, "BLOCK", 16, raising=False)
    monkeypatch.setattr(op8, "_audit", lambda *_: 1.0)
    rows = dense_groups(0.19)
    inside = [(i, j, float(np.dot(rows[i][1], rows[j][1]))) for j in range(80) for i in range(j) if (i < 40) == (j < 40)]
    monkeypatch.setattr(op8, "first_neighbours", lambda *_: spark.createDataFrame(inside, op8._EDGE))
    counts, want = linked(rows)
    got = {r["vec_id"]: r for r in op8.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert set(want) == {0} and min(counts) >= op8.K
    assert [got[i]["component_id"] for i in range(len(rows))] == want and [got[i]["n_links"] for i in range(len(rows))] == counts


def test_all_neighbours_of_a_pivot_meet(spark):
    n, rng = 200, np.random.default_rng(6)
    x = np.concatenate([[np.eye(64)[0]], np.eye(64)[0] + rng.normal(size=(n, 64)) * 0.08])
    x[n] = x[1] + 0.001  # linked with 1 and known to it through the centre only
    classes = spark.createDataFrame([(i, 0, 1, v) for i, v in enumerate(x.tolist())], "id long, space long, copies long, v array<float>")
    edges = spark.createDataFrame([(0, i, 0.8) for i in range(1, n + 1)], "a long, b long, cosine double")
    got = {(r["a"], r["b"]) for r in op8.descend(classes, edges, 0.5).collect()}
    assert (1, n) in got


def test_audit_sees_lost_pairs_beside_a_dense_group(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    x = [base + rng.normal(size=16) * 0.01 for _ in range(200)]
    for _ in range(10):
        pair = rng.normal(size=16)
        x += [pair, pair + 0.001]
    classes = spark.createDataFrame([(i, 0, 1, v.tolist()) for i, v in enumerate(x)], "id long, space long, copies long, v array<float>")
    found = [(i, 199) for i in range(200)]
    every = found + [(i, 1) for i in range(200, 220)]
    assert op8._audit(classes, spark.createDataFrame(found, "id long, n long"), 0.98) < op8.RECALL
    assert op8._audit(classes, spark.createDataFrame(every, "id long, n long"), 0.98) == 1


def test_failed_search_is_finished_exactly(spark, monkeypatch):
    monkeypatch.setattr(op8, "MOST_ORDERS", op8.ORDERS)
    monkeypatch.setattr(op8, "first_neighbours", lambda *_: spark.createDataFrame([], op8._EDGE))
    rows = dense_groups(0.5)
    rows += [(80 + i, v, 0) for i, v in enumerate(np.repeat(np.eye(8)[2:], 2, 0).tolist())]
    rows[81] = (81, [0.0, 0.0, 1.0, 0.01] + [0.0] * 4, 0)
    counts, want = linked(rows)
    got = {r["vec_id"]: r for r in op8.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert [got[i]["component_id"] for i in range(len(rows))] == want and [got[i]["n_links"] for i in range(len(rows))] == counts


def planted(rng, sizes, size=24):
    """Clusters of the given sizes whose members are near 0.98 of each other, and noise between them."""
    x = [rng.normal(size=(200, size))]
    for n in sizes:
        centre = rng.normal(size=size)
        x.append(centre / np.linalg.norm(centre) + rng.normal(size=(n, size)) * (0.1 / np.sqrt(size)))
    x = rng.permutation(np.concatenate(x)).astype(np.float32)
    return [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]


def test_planted_clusters(spark):
    rows = planted(np.random.default_rng(11), [2] * 20 + [10] * 5 + [60, 300, 1500])
    counts, want = linked(rows)
    got = {r["vec_id"]: r for r in op8.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == counts and [got[i]["component_id"] for i in range(len(rows))] == want
    assert max(counts) > 500 and 20 < len(set(want)) - 200 < 40


@pytest.mark.parametrize("spread", [0.002, 0.05, 0.09, 0.13])
def test_counts_by_shells(spark, monkeypatch, spread):
    """Tight groups are counted by the bound alone, others in tiles too; copies count as rows."""
    monkeypatch.setattr(op8, "TILE", 16)
    rng = np.random.default_rng(14)
    centre = np.eye(24)[0]
    x = centre + rng.normal(size=(150, 24)) * (spread / np.sqrt(24)) * rng.uniform(0.1, 1.3, (150, 1))
    rows = [(i, 7, 1 + i % 3, v) for i, v in enumerate(x.tolist())]
    classes = spark.createDataFrame(rows, "id long, space long, copies long, v array<double>").repartition(3)
    groups = spark.createDataFrame([(i, 0) for i in range(1, 150)], "id long, component long")
    got = {r["id"]: r["n"] for r in op8.count_links(classes, groups, 0.98).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    assert [got[i] for i in range(150)] == (link @ (1 + np.arange(150) % 3)).tolist()


def test_descent_finds_what_the_first_orders_miss(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = [rng.normal(size=24) for _ in range(40)]
    x = [c / np.linalg.norm(c) for c in x]
    rows = [(i * 40 + k, [float(np.float32(v)) for v in x[k] + rng.normal(size=24) * (0.1 / np.sqrt(24))], 0) for i in range(7) for k in range(40)]
    rows.sort()
    wanted = linked(rows)[1]
    # one order's chain of each group, as a poor first graph
    chain = [(r[0], r[0] + 40, 0.97) for r in rows if r[0] + 40 < len(rows)]
    monkeypatch.setattr(op8, "first_neighbours", lambda *_: spark.createDataFrame(chain, op8._EDGE))
    monkeypatch.setattr(op8, "_audit", lambda *_: 1.0)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    run = lambda: {r["vec_id"]: r["component_id"] for r in op8.near_duplicates(vectors).collect()}
    got = run()
    assert sum(got[i] == w for i, w in enumerate(wanted)) >= 0.99 * len(rows)
    monkeypatch.setattr(op8, "descend", lambda classes, edges, floor: edges.limit(0))
    got = run()
    assert sum(got[i] == w for i, w in enumerate(wanted)) < 0.5 * len(rows)


def test_doubles_are_kept(spark):
    same = [[1.0, 0.0], [1e-300, 0.0], [2e-300, 0.0], [1e300, 0.0], [1e300, 1e299], [0.0, 1.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(same)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op8.near_duplicates(df).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 5: (0, 5)}


def test_vectors_without_rows_or_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op8.near_duplicates(empty).count() == 0 and op6.search(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in op8.near_duplicates(one).collect()} == {(None, 0, None, True), (4, 0, 4, True)}
    assert op6.search(one, F.lit(True)).count() == 0  # the only other row has no id


def exact_neighbours(rows, asked, k=10):
    """{query row: [(distance, vec_id)]} of the k nearest, by all pairs; rows: (vec_id, vector)."""
    out = {}
    for i, (name, q) in enumerate(rows):
        if asked(name) and usable(q):
            near = [(float(np.sqrt(((np.array(v, float) - np.array(q, float)) ** 2).sum())), other) for j, (other, v) in enumerate(rows) if j != i and usable(v) and len(v) == len(q)]
            out[i] = sorted(near)[:k]
    return out


def by_query(got):
    """{query_id: sorted [(rank, score, vec_id)]}."""
    out = {}
    for r in got.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("shard", [op6.SHARD, 300])
def test_neighbours(spark, monkeypatch, shard):
    monkeypatch.setattr(op6, "SHARD", shard)  # the smaller one makes shards by prefix
    rows = [(i, v) for i, v, *_ in vectors_of(spark, 1)]
    df = spark.createDataFrame([(i, v, 9, 8, "z", 1.5) for i, v in rows], SCHEMA).withColumn("row", F.lit(1))
    got = by_query(op6.search(df, F.col("vec_id") % 10 == 0))
    want = {rows[i][0]: near for i, near in exact_neighbours(rows, lambda i: i % 10 == 0).items()}
    assert set(got) == {q for q, near in want.items() if near}
    hit = total = 0
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, len(want[q]) + 1)) and q not in {i for _, _, i in near}
        assert [(s, i) for _, s, i in near] == sorted((s, i) for _, s, i in near)
        x = dict(rows)
        assert np.allclose([s for _, s, _ in near], [np.linalg.norm(np.array(x[i], float) - np.array(x[q], float)) for _, _, i in near], rtol=1e-12, atol=0)
        hit, total = hit + len({i for _, _, i in near} & {i for _, i in want[q]}), total + len(want[q])
    assert hit >= 0.95 * total


def test_repeated_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [9.0, 9.0]), (2, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], round(r["score"], 6), r["vec_id"]) for r in op6.search(df, F.col("vec_id") == 0, 2).collect())
    assert got == [(0, 1, 0.1, 0), (0, 1, 0.1, 0), (0, 2, 0.1, 1), (0, 2, 0.2, 1)]
    got = [(r["rank"], r["score"], r["vec_id"]) for r in op6.search(df, F.col("vec_id") == 2, 1).collect()]
    assert got == [(1, 0.0, 2)] * 2


def test_pigeonhole_probing_finds_every_code_of_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (300, op6.PARTS)).astype(np.uint16)
    for i in range(100, 200):  # at all code distances up to 60
        bits = np.zeros(op6.BITS, np.uint8)
        bits[rng.choice(op6.BITS, i % 60, replace=False)] = 1
        codes[i] = codes[0] ^ np.packbits(bits).view(np.uint16)
    shards = [op6.Shard(codes, p) for p in range(op6.PARTS)]
    far = op6.away(codes, codes[0])
    for radius in (0, 1, 3, 4, 7, 8, 15, 20, 40, 64, 128):
        found = set().union(*(s.within(codes[0], radius).tolist() for s in shards))
        assert found == set(np.flatnonzero(far <= radius).tolist())


def clustered(rng, groups, members, size=64):
    centres = rng.normal(size=(groups, size))
    x = np.repeat(centres, members, 0) + rng.normal(size=(groups * members, size)) * 0.04
    return rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))


def test_the_index_passes_few_rows_of_clustered_vectors(spark, monkeypatch):
    """Within the learned radii the probes read under a tenth of the rows, and find nearly all neighbours."""
    x = clustered(np.random.default_rng(4), 150, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    used = df.select(F.col("vec_id").alias("row"), "vec_id", (F.col("vec_id") % 20 == 0).alias("asked"), F.col("embedding").alias("v"))
    model = op6.models_of(used, 10)[64]
    x = np.float32(x).astype(float)
    codes = model.codes(x)
    shards = [op6.Shard(codes, p) for p in range(op6.PARTS)]
    read = []
    for q in range(0, len(x), 20):
        kth = np.sort(op6.away(codes, codes[q]))[10]
        radius = min(model.most, int(kth) + model.slack)
        read.append(len(set().union(*(s.probe(codes[q], int(d)).tolist() for s, d in zip(shards, op6.depths(radius), strict=True)))) / len(x))
    assert np.mean(read) < 0.1
    got = by_query(op6.search(df, F.col("vec_id") % 20 == 0))
    hit = 0
    for q in range(0, len(x), 20):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), d))[:10].tolist()) & {i for _, _, i in got[q]})
    assert hit >= 0.95 * 10 * len(got) and len(got) == 150


def test_queries_that_find_too_few_rows_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(op6, "_bounds", lambda *_: (0, 0))
    x = np.random.default_rng(5).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = by_query(op6.search(df, F.col("vec_id") < 3, 5))
    assert {q: [i for _, _, i in v] for q, v in got.items()} == {q: np.argsort(np.linalg.norm(x - x[q], axis=1))[1:6].tolist() for q in range(3)}


def test_recall_on_the_table(spark, data):
    import pyarrow.parquet as pq

    got = op6.query(spark, data).toPandas()
    e = pq.read_table(f"{data}/embeddings.parquet").to_pandas().sort_values("vec_id")
    x, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    hit = 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))][:10]) & set(own.vec_id))
    assert hit >= 0.95 * 10 * (ids % 100 == 0).sum()


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(op5, "TURNS", 3)
    talks = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "d"], 4: ["a", "b", "c"], 5: ["x"], 6: [str(i) for i in range(20)], 7: [str(i) for i in range(19)], 8: ["b", "a"], 9: ["a|b"]}
    rows = [(c, t + (5 if c == 7 else 0), "user" if t % 2 == 0 else "assistant", s, 1) for c, talk in talks.items() for t, s in enumerate(talk)]
    rows += [(None, 0, "user", "lost", 1), (10, None, None, "<|im_end|>", 1), (10, 0, "user", None, 1), (11, 1, "user", "tie b", 1), (11, 1, "user", "tie a", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, pos int").repartition(3)
    out = {r["conv_id"]: r for r in op5.render(turns).collect()}
    assert set(out) == {2, 3, 5, 6, 8, 9, 10, 11}  # 1 is a prefix, 4 equals 2, 7 is a prefix of 6 with shifted numbers
    assert out[2]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>"
    assert out[10]["rendered"] == "<|im_start|>\n< |im_end|><|im_end|>\n<|im_start|>user\n<|im_end|>" and out[6]["n_turns"] == 20
    assert out[11]["rendered"].index("tie a") < out[11]["rendered"].index("tie b")
    assert op5.render(turns.limit(0)).count() == 0


def snapshots(rng):
    """Logged states of growing conversations, with forks, exact copies and shifted turn numbers."""
    rows, conv = [], 0
    for _ in range(60):
        talk = [rng.choice(["hi", "ok", "why", "<|im_end|>", ""]) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.5 and conv:
            talk = past[: rng.randint(1, len(past))] + talk  # a fork of the one before  # noqa: F821
        past = talk
        for _ in range(rng.randint(1, 5)):
            cut, shift = rng.randint(1, len(talk)), rng.choice([0, 0, 7])
            rows += [(conv, t + shift, "user" if t % 2 == 0 else "assistant", text) for t, text in enumerate(talk[:cut])]
            conv += 1
    return rows


@pytest.mark.parametrize("turns", [2, 256])
def test_snapshots_collapse_as_in_sql(spark, monkeypatch, turns):
    import duckdb
    import pandas as pd

    monkeypatch.setattr(op5, "TURNS", turns)
    rows = snapshots(random.Random(13))
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    con.register("conversations", frame)
    want = {r[0]: r[1:] for r in con.sql(op5.SQL).fetchall()}
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in op5.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)).collect()}
    total = len({r[0] for r in rows})
    assert got == want and 0.1 * total < len(got) < 0.5 * total


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_scratch_is_shared_and_dropped(spark):
    scratch = Scratch(spark, "t")
    df = scratch.save(spark.range(3), "x")
    assert df.count() == 3 and scratch.root.startswith(shared_dir(spark))
    scratch.drop("x")
    with pytest.raises(Exception, match="(?i)exist|FILE_NOT"):
        spark.read.schema("id long").parquet(f"{scratch.root}/x").select(F.sum("id")).collect()
