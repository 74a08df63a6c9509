"""The registered queries and the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlake.llm import queries
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), queries.SQL[name], SMALL)


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"op5_decontamination"}))
def test_a_row_per_row(spark, name):
    table = {"op7_embedding_dedup": "embeddings", "op8_url_filter": "pages"}.get(name, "documents")
    assert queries.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_digests(spark):
    docs = {r["doc_id"]: (r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op6_suffix_dedup(spark, SMALL).collect():
        if not r["n_removed"]:
            assert r["kept_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    for r in queries.op4_secret_scan(spark, SMALL).collect():
        base = ",".join(s for s in r["spans"].split(",") if not s.startswith("novel"))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_pipeline(spark, tmp_path):
    """Each stage on what the one before kept, held against the operators' own brute-force tests' functions."""
    from tests.llm.test_operators import jaccard_labels, removed_lines

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        steps[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]

    before, after = steps["quality"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("quality = 0").count() > gone.where("quality = 1").count()
    before, after = steps["line_dedup"]
    want = removed_lines(rows(before))
    assert dict(rows(after)) == {i: t for i, (_, _, t) in want.items()}
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = steps["jaccard_join"]
    assert {i for i, _ in rows(after)} == {i for i, (_, c) in jaccard_labels(rows(before), 80, 5).items() if i == c}
    before, after = steps["decontamination"]
    split = lambda t: (t or "").lower().split()
    sets = lambda t: {tuple(split(t)[k : k + 5]) for k in range(len(split(t)) - 4)}
    items = [s for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if (s := sets(r["text"]))]
    assert {i for i, _ in rows(after)} == {i for i, t in rows(before) if not any(len(sets(t) & s) >= 0.8 * len(s) for s in items)}
    before, after = steps["mixing"]
    texts = {i: " ".join((t or "").split()) for i, t in rows(before)}
    assert all(r["text"] in texts[r["doc_id"]] for r in after.collect())


@pytest.mark.parametrize("which", ["doc_id < 0", "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"])
def test_quality_stage_without_usable_labels(spark, tmp_path, which):
    """No labels, or held-out ones only: nothing is trained, so nothing is rejected."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").where(which).write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count() > 0


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[2]
    shutil.copytree(root / "spanlake", tmp_path / "spanlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, timeout=60)
