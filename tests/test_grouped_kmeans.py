"""K-means of its own for every group: planted clusters, odd groups, no dependence on partitions."""

import random

from pyspark.sql import functions as F

from tarpit.operators import grouped_kmeans as GK
from tarpit.operators.grouped_kmeans import cluster_by_group

SCHEMA = "session string, seg long, batch long, a double, b double, behavioral_risk_score int"


def rows_around(batch, centres, n, seed):
    """``n`` rows near each of ``centres``; the score of a row is the number of its centre."""
    draw = random.Random(seed)
    return [(f"{batch}-{i}-{j}", 0, batch, x + draw.choice((-0.1, 0.0, 0.1)), y + draw.choice((-0.1, 0.0, 0.1)), i)
            for i, (x, y) in enumerate(centres) for j in range(n)]


def clusters(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = cluster_by_group(df, ["batch"], ["a", "b"])
    return {r.session: (r.batch, r.behavior_cluster, r.cluster_stability, r.behavioral_risk_score) for r in out.collect()}


def test_planted_clusters_of_each_group_are_found(spark):
    rows = (rows_around(1, [(0, 0), (9, 0)], 40, 1) + rows_around(2, [(0, 0), (9, 0), (0, 9)], 30, 2)
            + rows_around(3, [(5, 5), (-5, 5), (5, -5), (-5, -5)], 300, 3))
    got = clusters(spark, rows)
    assert len(got) == len(rows)
    # ids follow the mean score, which is the number of the planted centre
    assert all(cluster == score for _, cluster, _, score in got.values())
    assert got["2-0-0"][2] == 1.0  # three clusters, whatever the start
    assert got == clusters(spark, list(reversed(rows)), parts=1)


def test_groups_with_little_to_cluster(spark):
    same = [(f"s{i}", 0, 1, 2.0, 3.0, 1) for i in range(5)]
    two = [("t0", 0, 2, 0.0, 0.0, 0), ("t1", 0, 2, 0.0, 0.0, 0), ("t2", 0, 2, 4.0, None, 2)]
    nowhere = [("n0", 0, None, 1.0, 1.0, 0), ("n1", 0, None, 7.0, 7.0, 0)]
    got = clusters(spark, same + two + nowhere + [("one", 0, 3, 1.0, 1.0, 0)])
    assert {got[f"s{i}"][1:3] for i in range(5)} == {(0, 0.0)}
    assert [got[k][1] for k in ("t0", "t1", "t2")] == [0, 0, 1]
    assert got["n0"][1:3] == got["n1"][1:3] == got["one"][1:3] == (0, 0.0)
    assert clusters(spark, []) == {}


def test_every_row_has_the_nearest_mean(spark):
    draw = random.Random(7)
    rows = [(str(i), 0, i % 2, float(draw.randint(0, 30)), float(draw.randint(0, 6)), draw.randint(0, 3)) for i in range(400)]
    out = cluster_by_group(spark.createDataFrame(rows, SCHEMA), ["batch"], ["a", "b"])
    found = [(r.batch, r.behavior_cluster, r.a, r.b) for r in out.select("batch", "behavior_cluster", "a", "b").collect()]
    means = {}
    for key in {f[:2] for f in found}:
        own = [f[2:] for f in found if f[:2] == key]
        means[key] = tuple(sum(v) / len(own) for v in zip(*own))
    far = lambda x, m: sum((p - q) ** 2 for p, q in zip(x, m))
    for batch, cluster, *x in found:
        assert far(x, means[batch, cluster]) <= min(far(x, m) for (g, _), m in means.items() if g == batch) + 1e-6
    assert out.where(F.col("cluster_stability").between(-1, 1)).count() == len(rows)


def test_groups_that_fit_a_task_are_not_joined_step_by_step(spark, monkeypatch):
    """Whole groups and groups split over tasks follow the same rules; only the latter join
    vectors and models."""
    draw = random.Random(3)
    rows = [(f"{g}-{i}", 0, g, draw.gauss(0, 1), draw.choice((0.0, 1.0, 2.5, None)), draw.choice((0, 1, 2, 3, None)))
            for g, n in {1: 60, 2: 25, 3: 3, 4: 2, 5: 1, None: 7}.items() for i in range(n)]
    rows += [(f"same-{i}", 0, 6, 1.0, 1.0, 1) for i in range(4)] + [(f"few-{i}", 0, 7, float(i % 3), 0.0, None) for i in range(12)]
    split = GK.models_by_group
    monkeypatch.setattr(GK, "WHOLE", 24)  # groups 1 and 2 are split
    mixed = clusters(spark, rows)

    def boom(*a, **k):
        raise AssertionError("vectors and models joined")
    monkeypatch.setattr(GK, "models_by_group", boom)
    monkeypatch.setattr(GK, "WHOLE", 60)
    whole = clusters(spark, rows)
    assert len(whole) == len(rows)
    assert whole == mixed
    monkeypatch.setattr(GK, "models_by_group", split)
    monkeypatch.setattr(GK, "WHOLE", 1)
    assert clusters(spark, rows) == whole
