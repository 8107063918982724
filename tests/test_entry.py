import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from cellforge.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["rows", "n", "min", "max", "mean", "std"] and df.count() > 0


def test_registries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "cellforge"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE)), "False"]


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ["algebra_iif", "percentile_2_98", "mosaic_last", "aspect", "d8_accumulation", "zonal_layer", "bilinear_profile", "contour_segments", "swiss_relief", "colour_continuous", "viewshed_corner", "grade_trace", "local_relief"])
def test_queries_equal_their_sql(spark, views, name):
    df = catalog.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    found = views.sql(catalog.ORACLE[name])
    want = sorted((tuple(r[found.columns.index(c)] for c in order) for r in found.fetchall()), key=key)
    assert got == want
