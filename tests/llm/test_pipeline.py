"""The pipeline: each stage against what it must keep, and the whole against its stages."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from orthant.llm import op9_secrets  # noqa: E402

from .test_group_operators import brute_documents  # noqa: E402


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(0)
    vocabulary = [f"{a}{b}" for a in ("kor", "lim", "pex", "tul") for b in ("an", "is", "ou", "er", "ad")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60))) for _ in range(200)]
    flags = [rng.random() < 0.25 for _ in texts]
    texts = [t + " vilezz scumzz" if f else t for t, f in zip(texts, flags, strict=True)]
    clean = next(t for t, f in zip(texts, flags, strict=True) if not f and len(t.split()) > 30)
    texts += [clean, clean + " tulad", "1234 5678", None, "", 'pexan limou password = "Zx9!kLm2#qRt" tuler']
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(f)) for i, f in enumerate(flags)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "packing":
            assert now.columns == docs.columns
    clean_ids = {i for i in range(len(texts)) if not (i < 200 and flags[i])}
    assert set(seen["toxicity"]) == clean_ids
    assert set(seen["language_id"]) == clean_ids - {202, 203, 204}
    left = sorted(seen["language_id"])
    want = brute_documents([texts[i] for i in left], 5, 80)[1]
    assert set(seen["minhash_near_dedup"]) == {i for k, i in enumerate(left) if want[k] == k}
    assert {i: r["text"] for i, r in seen["secret_scan"].items()} == {i: op9_secrets.redact(r["text"]) for i, r in seen["minhash_near_dedup"].items()}
    assert "Zx9" not in seen["secret_scan"][205]["text"] and set(seen["packing"]) == set(seen["secret_scan"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    ids = lambda df: sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in df.collect())
    joined = lambda rows: {d: b"".join(x[2] for x in rows if x[0] == d) for d in {x[0] for x in rows}}
    assert joined(ids(whole)) == joined(ids(now)) and np.all([r["length"] <= 1024 for r in whole.collect()])


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, tile int, grade long, root long, component_id long, id string, n_shingles int, grp long, lang_pred string, kept boolean, start long"


def piped(spark, tmp_path, rows, labels):
    """The last stage's rows, after checks that hold for any input."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, "x", 5, 6, "y", False, 7) for i, t in rows], CLASHING)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.schema == docs.schema
    kept = now.collect()
    assert all((r["tile"], r["grp"], r["lang_pred"], r["kept"], r["start"]) == (1, 6, "y", False, 7) for r in kept)
    return kept, corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_empty_tables(spark, tmp_path):
    assert piped(spark, tmp_path, [], []) == ([], [])


def test_awkward_rows(spark, tmp_path):
    """Nulls, repeated ids and rows, very long texts, a text of one letter; no labels."""
    long = " ".join(f"word{i * i % 99_991}" for i in range(150_000))
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "One two three four five SIX"), (None, "one two three four five six"), (3, None), (None, None), (4, ""), (5, "12 34 !!"), (6, long), (7, long + " x"), (8, "q" * 300_000), (9, "a")]
    kept, packed = piped(spark, tmp_path, rows, [])
    ids = sorted((r["doc_id"] or -1 for r in kept))
    assert ids == [-1, 1, 1, 6, 8, 9]  # what has a letter, one of each group; a null id is in no group, equal ids go together
    assert {r["doc_id"] for r in packed} == {None, 1, 6, 8, 9}
    assert sum(r["length"] for r in packed if r["doc_id"] == 6) == next(r["doc_tokens"] for r in packed if r["doc_id"] == 6) > 400_000
    texts = {r["doc_id"]: r["text"] for r in kept}
    assert texts[6] == long and texts[8] == "q" * 300_000
