"""The driver contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "solve_periodic" in e.queries()


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
@pytest.mark.parametrize("name", ["solve_periodic", "solve_filtered", "solve_rotational_fd4", "embedding_dst3", "embedding_dct2_columns", "green_spectral_mehr_6f", "solve_hourly", "vortex_velocity", "axis_plans", "green_table_mixed_hej_6", "lattice_line_mehr_4f", "solve_wall_waves_fd4", "green_table_plane_lgf_4"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    got = e.queries()[name](spark, DATA).toPandas()
    c = duckdb.connect()
    for t in ("lineitem", "events", "embeddings"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(e.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    key = lambda df: sorted(tuple(round(float(x), 4) + 0.0 for x in r) for r in df[cols].itertuples(index=False))
    assert all(abs(x - y) < 2e-4 for a, b in zip(key(got), key(want)) for x, y in zip(a, b))


def test_every_query_reads_the_given_tables(spark):
    from gridloom import queries

    for name, run in queries.queries().items():
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            run(spark, "/nowhere")
            pytest.fail(f"{name} reads no table")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 512
