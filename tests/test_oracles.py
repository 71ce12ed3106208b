"""Every query of the library that SQL can state, against DuckDB on the same tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from plumbline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_has_the_rows_of_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    assert got == want


def test_the_rest_runs_without_the_llm_folders(tmp_path):
    """A copy without them imports, and registers the other queries; a broken import inside them isn't hidden."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    show = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    run = lambda at: subprocess.run([sys.executable, "-c", show], cwd=at, capture_output=True, text=True)
    out = run(copy)
    assert out.returncode == 0, out.stderr
    n, some, known = out.stdout.split()
    assert int(n) == len(QUERIES) and (some, known) == ("False", "True")
    if (root / "plumbline/llm").exists():
        shutil.copytree(root / "plumbline/llm", copy / "plumbline/llm")
        shutil.copy(root / "corpus_pipeline.py", copy)
        (copy / "plumbline/llm/queries.py").write_text("import no_such_module\n")
        assert "no_such_module" in run(copy).stderr
