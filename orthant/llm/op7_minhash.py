"""Near-duplicate documents: an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. One pass over the texts gives each document its number of shingles, a
   128-bit BLAKE2b digest of its words in order and a signature of 96 minima.
   Documents with equal digests become one class.
2. TREES keys of DEPTH minima each are the forest. All documents that agree on
   a key are a region, and what may reach the threshold (less MARGIN) in it is
   joined loosely.
3. Loosely joined groups are confirmed on the texts of their members, whose
   words and shingles are numbered exactly, without hashes.
4. Connected components of the confirmed links give the result.

Regions and groups of any size are compared whole, so that no link within one
is lost: in tiles of bounded size first, then by one document for all that is
joined by then, and at last in pairs of tiles of what is still apart. So the
cost of a large group of copies grows with its size, not with its square.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, list_column, small_batches, sorted_groups, table
from .components import SCHEMA, components, forest
from .meetings import meetings
from .textvec import blocks, byte_tables, distinct_runs, mix, run_hashes, runs, utf8

HASHES, TREES, DEPTH = 96, 16, 4
#: Documents compared with each other at once in a region of an order, and in a tile of a loose group; bytes of such a tile.
REGION, TILE, TILE_BYTES = 256, 128, 1 << 22
#: Documents of a larger region that meet those of another block in one group, and how many are searched from at once.
BLOCK, AT_ONCE = 1024, 64
#: How far an estimate from 96 minima may fall below the threshold (four standard errors).
MARGIN = 0.15
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)


def shingle_sets(column: pa.Array, words: int):
    """For blocks of documents: first document, the hashes of each one's distinct shingles in ascending order, their offsets, and digests of the words.

    Words are runs of characters other than blanks (0x20, 0x09-0x0D) after
    A-Z became lower case. A document with fewer words has its whole sequence
    as one shingle; one without words has none.
    """
    t, (data, offsets) = byte_tables(), utf8(column)
    for lo, hi in blocks(offsets):
        flat, offs = t["lower"][data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends = runs(t["solid"][flat], offs)
        h = run_hashes(flat, starts, ends)
        at = np.searchsorted(starts, offs)

        def chain(first: np.ndarray, count: int, h: np.ndarray = h) -> np.ndarray:
            x = np.full(len(first), np.uint64(count))
            for k in range(count):
                x = mix(x * np.uint64(0xA0761D6478BD642F) + h[first + k])
            return x

        whole = chain(np.arange(max(0, len(h) - words + 1)), words)
        counts = np.diff(at)
        short = {int(i): x for c in range(1, words) for i, x in zip(np.flatnonzero(counts == c), chain(at[:-1][counts == c], c), strict=True)}
        sets = []
        for i, (a, n) in enumerate(zip(at[:-1].tolist(), counts.tolist(), strict=True)):
            if n >= words:
                s = np.sort(whole[a : a + n - words + 1])
                sets.append(s[np.append(True, s[1:] != s[:-1])])
            else:
                sets.append(np.array([short[i]], np.uint64) if n else np.empty(0, np.uint64))
        # the words of each document with one blank between
        keep = t["solid"][flat]
        gaps = ends[:-1][np.searchsorted(offs, starts[:-1], "right") == np.searchsorted(offs, starts[1:], "right")]
        keep[gaps] = True
        plain = flat[keep].copy()
        cuts = np.concatenate([[0], np.cumsum(keep)])
        plain[cuts[gaps]] = 32
        cuts, raw = cuts[offs].tolist(), plain.tobytes()
        digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        yield lo, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.frombuffer(digests, np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, size (bytes), f1, f2 (digest of the words) and sig (HASHES 16-bit minima, four to a number); the last three null without shingles."""

    def run(batches):
        for batch in batches:
            length = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            for lo, sets, offs, digests in shingle_sets(batch.column("text"), words):
                sizes = np.diff(offs)
                full = np.flatnonzero(sizes)
                first = offs[:-1][full]
                sig = np.empty((len(full), HASHES), np.uint16)
                f1, f2 = digests[full].T
                if len(full):
                    narrow = (sets >> np.uint64(32)).astype(np.uint32)
                    for k in range(HASHES):
                        low = np.minimum.reduceat(narrow * _A[k] + _B[k], first)
                        sig[:, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
                place = np.full(len(sizes), -1)
                place[full] = np.arange(len(full))
                take = pa.array(place, mask=place < 0)
                longs = list_column(sig.view(np.int64).ravel(), np.arange(len(full) + 1) * (HASHES // 4), pa.int64())
                out = {"doc_id": batch.column("doc_id").slice(lo, len(sizes)).cast(pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "size": length.slice(lo, len(sizes))}
                yield pa.RecordBatch.from_pydict(out | {"f1": pa.array(np.ascontiguousarray(f1)).take(take), "f2": pa.array(np.ascontiguousarray(f2)).take(take), "sig": longs.take(take)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, size long, f1 long, f2 long, sig array<long>")


def _flat(column: pa.ChunkedArray, kind) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(kind)


def _loose(sig: np.ndarray, sizes: np.ndarray, least: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) whose sizes allow the threshold and whose estimate is at least `least`."""
    n = len(sig)
    agree = np.zeros((n, n), np.uint8)
    for k in range(HASHES):
        agree += sig[:, k, None] == sig[None, :, k]
    fit = 100 * np.minimum(sizes[:, None], sizes[None]) >= percent * np.maximum(sizes[:, None], sizes[None])
    return np.nonzero(np.triu((agree >= least * HASHES) & fit, 1))


def _reached(sig: np.ndarray, sizes: np.ndarray, side: np.ndarray, least: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs of `_loose` connect; with two sides, what pairs across them connect.

    Each row is compared with the rows not reached yet, so that the cost is at
    most that of all pairs, and little where most rows are joined.
    """
    columns = np.ascontiguousarray(sig.T)
    across = side[0] != side[-1]
    open_ = np.ones(len(sig), bool)
    a, b = [], []
    for seed in range(len(sig)):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [np.array([seed])]
        while queue:
            rows = queue.pop()
            if len(rows) > AT_ONCE:
                queue.append(rows[AT_ONCE:])
                rows = rows[:AT_ONCE]
            for own in (rows[side[rows] == s] for s in (side[0], side[-1])) if across else (rows,):
                rest = np.flatnonzero(open_ & (side != side[own[0]])) if across and len(own) else np.flatnonzero(open_)
                if not len(own) or not len(rest):
                    continue
                if len(own) == 1:
                    agree = (sig[rest] == sig[own[0]]).sum(1)[None]
                else:
                    agree = np.zeros((len(own), len(rest)), np.uint8)
                    for c in columns:
                        agree += c[own][:, None] == c[rest][None]
                x, y = sizes[own][:, None], sizes[rest][None]
                near = (agree >= least * HASHES) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
                hit = np.flatnonzero(near.any(0))
                if len(hit):
                    a.append(own[near[:, hit].argmax(0)]), b.append(rest[hit])
                    open_[rest[hit]] = False
                    queue.append(rest[hit])
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _told(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k, c in enumerate("ab")})


def _forests(rows: DataFrame, keys: list[str], pairs) -> DataFrame:
    """Links (a, b), as forests, of each group of rows; pairs: places of linked rows of a group."""

    def run(batches):
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for group in sorted_groups(batches, keys):
            root = group.column("root").to_numpy()
            if (root == root[0]).all():
                continue
            i, j = pairs(group)
            apart = root[i] != root[j]
            if apart.any():
                ids = group.column("doc_id").to_numpy()
                out.append(forest(ids[i[apart]], ids[j[apart]]))
            if len(out) == 1000:
                yield _told(out)
                out = []
        if out:
            yield _told(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", "doc_id").mapInArrow(run, SCHEMA)


def _joined(rows: DataFrame, tiles_of, pairs, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) that connect, in every group, what all its pairs connect; rows: doc_id, grp, size, tiles and what `pairs` reads.

    tiles: of the row's group; tiles_of: tiles for a number of rows and their size. A group is dealt to
    tiles, and within a tile all pairs are compared. Of what is joined by then,
    one row stands for all of a group's, and these are compared in tiles again,
    as long as that joins much. At last, rows of a group that are still apart
    meet in pairs of tiles, where a root with many rows has tiles of its own;
    two tiles of one root do not meet.
    """
    tile = lambda tiles, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), tiles).cast("int")
    own = lambda df: df.withColumns({"root": F.col("doc_id"), "side": F.lit(0)})
    rows = rows.withColumn("tile", tile(F.col("tiles"), 0))
    links = scratch.save(_forests(own(rows), ["grp", "tile"], pairs), f"{name}-links-0")
    big = scratch.save(rows.where("tiles > 1").drop("tiles", "tile"), f"{name}-big")
    if not big.limit(1).count():
        return links
    had, step = None, 0
    while True:
        step += 1
        parts = components(links, scratch, f"{name}-parts-{step}")
        named = big.join(parts, F.col("doc_id") == F.col("id"), "left").withColumn("root", F.coalesce("component", "doc_id")).drop("id", "component")
        stand_in = F.min(F.struct("doc_id", "size")).alias("r")
        roots = scratch.save(named.groupBy("grp", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), stand_in), f"{name}-roots-{step}")
        open_ = roots.groupBy("grp").agg(F.count("*").alias("m"), tiles_of(F.count("*"), F.sum("r.size")).alias("tiles")).where("m > 1")
        left = open_.agg(F.sum("m")).first()[0]
        if not left:
            return links
        if had is not None and left > 0.7 * had:
            break
        had = left
        reps = roots.join(open_, "grp").select(F.col("grp").alias("g"), F.col("r.doc_id").alias("d"), "tiles")
        reps = own(big.join(reps, (F.col("grp") == F.col("g")) & (F.col("doc_id") == F.col("d")))).drop("g", "d").withColumn("tile", tile(F.col("tiles"), step))
        links = scratch.save(links.union(_forests(reps, ["grp", "tile"], pairs)), f"{name}-links-{step}")
    met = meetings(named, roots.join(open_.select("grp"), "grp", "left_semi"), tiles_of)
    return links.union(scratch.save(_forests(met, ["grp", "x", "y"], pairs), f"{name}-links-rest"))


def loose_links(reps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what may reach the threshold in some region; reps: doc_id, n_shingles, sig."""
    least = percent / 100 - MARGIN
    keys = reps.select(F.col("doc_id").alias("d"), F.posexplode(F.slice("sig", 1, TREES)).alias("t", "k1")).select("d", F.xxhash64("t", "k1").alias("grp"))
    tiles_of = lambda n, size: F.when(n <= REGION, 1).otherwise(F.ceil(n / BLOCK)).cast("int")
    shared = keys.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp", tiles_of(F.col("n"), None).alias("tiles"))
    members = scratch.save(keys.join(shared, "grp"), "regions")
    rows = reps.select("doc_id", "n_shingles", "sig").join(members, F.col("doc_id") == F.col("d")).drop("d").withColumn("size", F.lit(0))

    def pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n, sizes, side = group.num_rows, group.column("n_shingles").to_numpy(), group.column("side").to_numpy()
        sig = _flat(group.column("sig"), np.uint16).reshape(n, HASHES)
        return _loose(sig, sizes, least, percent) if n <= REGION else _reached(sig, sizes, side, least, percent)

    return _joined(rows, tiles_of, pairs, scratch, "loose")


def _confirm(sets: np.ndarray, offs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of sets with 100 * intersection >= percent * union, by products of shared-shingle matrices."""
    n, sizes = len(offs) - 1, np.diff(offs)
    if n == 2:
        common = np.array([[0, len(np.intersect1d(sets[: offs[1]], sets[offs[1] :], assume_unique=True))], [0, 0]])
    else:
        _, at, count = np.unique(sets, return_inverse=True, return_counts=True)
        use = count[at] > 1
        owner, place = np.repeat(np.arange(n), sizes)[use], (np.cumsum(count > 1) - 1)[at[use]]
        common = np.zeros((n, n))
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        width = 4096
        for lo in range(0, int((count > 1).sum()), width):
            a, b = np.searchsorted(place, [lo, lo + width])
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], place[a:b] - lo] = 1
            common += m @ m.T
    return np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes[None] - common), 1))


def exact_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each text's distinct shingles, equal for equal shingles only, in ascending order, and their offsets."""
    t, (data, offs) = byte_tables(), utf8(column)
    flat = t["lower"][data]
    starts, ends = runs(t["solid"][flat], offs)
    word = distinct_runs(flat, starts, ends)[1].astype(np.int64)
    doc, n = np.searchsorted(offs, starts, "right") - 1, len(offs) - 1
    count = np.bincount(doc, minlength=n)
    last = np.cumsum(count)[doc]  # place after the last word of the same text
    place, code = np.arange(len(word)), word
    different = int(word.max(initial=-1)) + 1
    for k in range(1, words):  # the number of a run of k + 1 words, from that of its first k and its last word
        on = place + k < last[place]
        place, code = place[on], np.unique(code[on] * different + word[place[on] + k], return_inverse=True)[1].astype(np.int64)
    owner = doc[place]
    if words > 1:
        names: dict[bytes, int] = {}
        few = np.flatnonzero((count > 0) & (count < words))  # the whole text is one shingle
        first = np.cumsum(count) - count
        extra = [-1 - names.setdefault(word[first[i] : first[i] + count[i]].tobytes(), len(names)) for i in few.tolist()]
        owner, code = np.concatenate([owner, few]), np.concatenate([code, np.array(extra, np.int64)])
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    return code[new], np.searchsorted(owner[new], np.arange(n + 1))


def confirmed_links(docs: DataFrame, groups: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect the members of each group whose full sets reach the threshold; groups: doc_id, grp, size."""
    tiles_of = lambda n, size: F.greatest(F.ceil(n / TILE), F.ceil(size / TILE_BYTES)).cast("int")
    groups = groups.join(groups.groupBy("grp").agg(tiles_of(F.count("*"), F.sum("size")).alias("tiles")), "grp")
    texts = scratch.save(docs.where("doc_id is not null").select("doc_id", "text").join(groups, "doc_id"), "texts")
    return _joined(texts, tiles_of, lambda group: _confirm(*exact_sets(group.column("text"), words), percent), scratch, "confirmed")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of `words`-word shingles. Null and empty texts have no shingles and
    are linked with nothing. Rows with the same doc_id are one node, so equal
    rows agree; a null doc_id is linked with nothing, has no component and is
    kept. Other columns are not read; an empty table gives no rows.
    """
    small_batches(docs)
    scratch = Scratch(docs.sparkSession, "minhash")
    every = scratch.save(signatures(docs, words), "signatures")
    first = F.min(F.struct("doc_id", "n_shingles", "size", "sig")).alias("r")
    classes = every.where("doc_id is not null and n_shingles > 0").groupBy("f1", "f2").agg(first)
    classes = scratch.save(classes.select("f1", "f2", "r.doc_id", "r.n_shingles", "r.size", "r.sig"), "classes")
    loose = components(loose_links(classes, percent, scratch), scratch, "loose-parts")
    # the smallest member of a group is not among the ids of `loose`
    groups = loose.withColumnRenamed("component", "grp").union(loose.select("component", "component").distinct())
    groups = classes.select("doc_id", "size").join(groups, F.col("doc_id") == F.col("id")).groupBy("doc_id", "grp").agg(F.max("size").alias("size"))
    links = confirmed_links(docs, groups, words, percent, scratch)
    ids = every.where("doc_id is not null and n_shingles > 0").select("f1", "f2", "doc_id")
    # equal ids with different texts tie their classes together
    same = ids.groupBy("doc_id").agg(F.count_distinct("f1", "f2").alias("n")).where("n > 1").select("doc_id")
    tied = ids.join(same, "doc_id").join(classes.select("f1", "f2", F.col("doc_id").alias("b")), ["f1", "f2"]).select(F.col("doc_id").alias("a"), "b")
    found = components(links.union(tied), scratch, "parts")
    named = classes.select("f1", "f2", "doc_id").join(found, F.col("doc_id") == F.col("id"), "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "doc_id").alias("root"))
    out = every.select("doc_id", "n_shingles", "f1", "f2").join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest doc_id. Of rows with the same doc_id all stay or go."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id, coalesce(d.doc_id = m.b, true) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
