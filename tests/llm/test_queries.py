from __future__ import annotations

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from basketwise.llm.queries import ORACLES, REGISTERED
from checks.compare import difference, duckdb_connection
from tests.conftest import DATA
from tests.llm.helpers import shingles


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    frame = REGISTERED[name](spark, DATA)
    result = duckdb_connection(DATA).execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert difference([tuple(r) for r in frame.collect()], frame.columns, result.fetchall(), columns) is None


def test_all_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in REGISTERED) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, step(spark, kept, DATA).cache()
        assert kept.columns == columns
        assert kept.subtract(before).count() == 0
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[3] < counts[2]
    rows = [(r.doc_id, shingles(r.text)) for r in kept.collect()]
    for k, (_, left) in enumerate(rows):
        for _, right in rows[:k]:
            shared = len(left & right)
            assert not shared or 100 * shared < 80 * len(left | right)
    items = [shingles(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(100 * len(item & own) >= 80 * len(item) for item in items for _, own in rows)
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {p.doc_id for p in packed} == {i for i, _ in rows}


def test_entry_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py", "checks"):
        (tmp_path / name).symlink_to(os.path.join(root, name))
    (tmp_path / "basketwise").mkdir()
    for name in os.listdir(os.path.join(root, "basketwise")):
        if name != "llm":
            (tmp_path / "basketwise" / name).symlink_to(os.path.join(root, "basketwise", name))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and not any(n.startswith('op8_') for n in q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    shadow = f"import sys; sys.path[:] = [p for p in sys.path if p not in ('', {root!r})]; sys.path.insert(0, {str(tmp_path)!r}); "
    run = subprocess.run([sys.executable, "-c", shadow + code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
