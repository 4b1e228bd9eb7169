"""Every registered query against its SQL, at the smallest scale."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandworks.plans import queries as read_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def test_every_read_query_has_sql():
    assert read_queries.queries().keys() == read_queries.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", read_queries.queries())
def test_equals_sql(spark, duck, name, tmp_path):
    read_queries.queries()[name](spark, SF).write.parquet(f"file://{tmp_path}/out")
    columns = ", ".join(f'"{r[0]}"' for r in duck.execute(f"SELECT column_name FROM (DESCRIBE {read_queries.oracle_sql()[name]}) ORDER BY 1").fetchall())
    want, got = f"(SELECT {columns} FROM ({read_queries.oracle_sql()[name]}))", f"(SELECT {columns} FROM '{tmp_path}/out/*.parquet')"
    assert duck.execute(f"SELECT count(*) FROM {got}").fetchone() == duck.execute(f"SELECT count(*) FROM {want}").fetchone() != (0,)
    assert duck.execute(f"SELECT count(*) FROM ({want} EXCEPT ALL {got})").fetchone() == (0,)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_training_data_part(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    (tmp_path / "strandworks").mkdir()
    for p in (root / "strandworks").iterdir():
        if p.name != "llm":
            (tmp_path / "strandworks" / p.name).symlink_to(p)
    n = len(read_queries.queries())
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(n), str(n)]
    # nor does a library that only that part needs take the others down
    hidden = "import sys; sys.modules['xxhash'] = sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", hidden], cwd=root, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(n)]


def test_runs_from_elsewhere_with_nothing_set(tmp_path):
    """Workers get the package from Spark, and a plain local session a temporary folder."""
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
import sys
sys.path.insert(0, {str(Path(entry.__file__).parent)!r})
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(e.queries()["score_chunks"](spark, {SF!r}).count() > 0, e.queries()["read_fastq"](spark, {SF!r}).count() > 0)
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert out.stdout.split() == ["True", "True"], out.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from strandworks.functions.paths import fresh_path

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="yarn", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        fresh_path(session, "x")


def test_intermediate_files_can_be_removed(spark):
    from pathlib import Path as Local

    from strandworks.functions import paths

    before, paths_of = paths.written(spark.range(5), "kept"), paths.fresh_path(spark, "x").rsplit("/", 1)[0]
    assert before.count() == 5 and any(Local(paths_of.removeprefix("file://")).iterdir())
    held = paths.own_folder, paths.folder
    try:
        paths.folder = lambda s: "strandworks-another"  # what other applications have stays
        other = paths.written(spark.range(3), "gone")
        paths.clean_up(spark)
        assert before.count() == 5
        with pytest.raises(Exception, match="(?i)exist|not found"):
            other.count()
    finally:
        paths.own_folder, paths.folder = held
