"""The registered queries, the guard around the subpackage, and shared expressions."""

import os
import subprocess
import sys
import zlib

import pytest
from check import compare, connect
from pyspark.sql import functions as F

from cartwave.llm.common import held_out, training_labels
from cartwave.llm.queries import register
from cartwave.registry.base import Registry

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
R = Registry()
register(R)


def test_all_are_registered():
    import corpus_pipeline

    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]


def test_entry_works_without_the_subpackage(tmp_path):
    for part in ("cartwave", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{part}", tmp_path / part) if part != "cartwave" else None
    (tmp_path / "cartwave").mkdir()
    for part in os.listdir(f"{ROOT}/cartwave"):
        if part != "llm":
            os.symlink(f"{ROOT}/cartwave/{part}", tmp_path / "cartwave" / part)
    # the entry file is copied: a link would lead back to the whole tree
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(f"{ROOT}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith(('op', 'pipeline')) for n in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env).returncode == 0


@pytest.mark.parametrize("name", [n for n in R.queries if n in R.sql])
def test_same_as_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, R.queries[name], R.sql[name]) == ""


def test_held_out_is_crc32_of_the_id_as_text(spark):
    got = {r[0]: r[1] for r in spark.range(-50, 500).select("id", held_out("id")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(-50, 500)}
    assert spark.sql("select cast(null as long) as doc_id").select(held_out()).first()[0] is False


def test_labels_that_disagree_or_are_odd_are_left_out(spark):
    rows = [(1, 1), (1, 1), (3, 0), (3, 1), (4, None), (5, 7), (None, 1), (8, 0)]
    df = spark.createDataFrame(rows, "doc_id long, toxic int").withColumn("label", F.lit("clash"))
    got = {tuple(r) for r in training_labels(df, "toxic").collect()}
    assert got == {(i, v) for i, v in ((1, 1), (8, 0)) if zlib.crc32(str(i).encode()) % 4 != 2}
