"""Upload batches at size: files of the history, and a forest of every batch without a shuffle a tree."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from tarpit.operators import isolation_forest as IF
from tarpit.sources import sinks as S


def test_a_batch_is_one_file_highest_risk_first(spark, tmp_path):
    df = spark.range(600).select((F.col("id") % 7).alias("batch_id"), F.col("id"), ((F.col("id") * 37) % 101 / 100.0).alias("risk_score"))
    df = df.withColumn("risk_score", F.when(F.col("id") % 50 != 0, F.col("risk_score"))).repartition(6)
    for path, write in ((f"{tmp_path}/history", lambda d, p: S.write_sessions(d, p, mode="overwrite_batches")), (f"{tmp_path}/archive", S.archive_batch)):
        write(df, path)
        write(df.where("batch_id = 3"), path)  # a retried batch replaces itself alone
        files = glob.glob(f"{path}/batch_id=*/*.parquet")
        assert len(files) == 7
        assert spark.read.parquet(path).count() == 600
        for f in files:
            risks = [r.risk_score for r in spark.read.parquet(f).collect()]
            assert risks == sorted(risks, key=lambda r: (r is None, -(r or 0)))


def test_history_without_risk_keeps_all_rows(spark, tmp_path):
    df = spark.range(40).select(F.when(F.col("id") % 4 != 0, F.col("id") % 4).alias("batch_id"), "id").repartition(3)
    S.write_sessions(df, f"{tmp_path}/history", mode="overwrite_batches")
    assert spark.read.parquet(f"{tmp_path}/history").groupBy("batch_id").count().count() == 4


def rows_of(sizes, seed=1):
    draw, odd = random.Random(seed), (None, -0.0, 0.0)
    return [(f"s{g}-{i}", 0, g, draw.choice(odd) if i % 9 == 0 else float(draw.randrange(4)), draw.random() if g != 2 else 1.0)
            for g, n in sizes.items() for i in range(n)]


def test_forests_of_groups_are_those_of_each_group_alone(spark, monkeypatch):
    """Also for a group larger than a tree's samples, a group of one row, one of equal
    vectors and one without a name; without the rows of each tree being shuffled."""
    sizes = {None: 30, 1: 90, 2: 20, 3: 1, 4: 40}
    df = spark.createDataFrame(rows_of(sizes), "session string, seg long, batch long, a double, b double").repartition(4).cache()
    how = dict(cols=["a", "b"], n_trees=12, max_samples=32)
    columns = ["session", "anomaly_score", "is_anomaly", "dbscan_label"]
    alone = [tuple(r) for g in sizes for r in IF.isolation_forest(df.where(F.col("batch").eqNullSafe(g)), **how).select(*columns).collect()]

    def boom(*a, **k):
        raise AssertionError("samples drawn row by row")
    monkeypatch.setattr(IF, "draw_samples", boom)
    together = [tuple(r) for r in IF.isolation_forest(df, group_cols=["batch"], **how).select(*columns).collect()]
    assert len(together) == sum(sizes.values())
    assert {t[0]: t[2:] for t in together} == {t[0]: t[2:] for t in alone}
    assert {t[0]: t[1] for t in together} == pytest.approx({t[0]: t[1] for t in alone}, abs=1e-12)


def test_no_rows_no_forests(spark):
    df = spark.createDataFrame([], "session string, seg long, batch long, a double, b double")
    assert IF.isolation_forest(df, ["a", "b"], group_cols=["batch"]).count() == 0
