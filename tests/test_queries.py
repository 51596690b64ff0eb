"""Every query of the engine on the smallest tables, against its SQL where it has one."""

import math

import duckdb
import pytest

from gridlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(row):
    return tuple(None if isinstance(x, float) and math.isnan(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(cols).collect()), key=repr)
    assert got
    if name in catalog.ORACLE_SQL:
        want = oracle.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
        assert got == sorted((plain(r) for r in want), key=repr)


def test_entry_points(spark):
    import __spark_entry__ as entry_points

    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


def test_the_rest_stands_without_the_training_data_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gridlens", tmp_path / "gridlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and not any(n.startswith('op1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
