"""Property and brute-force tests for the distributed operators."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarpit.operators import clustering as C
from tarpit.operators import features as FE
from tarpit.operators import geo as G
from tarpit.operators import ml as M
from tarpit.operators.ids import with_batch_ids, with_sequence_number
from tarpit.operators.ranges import cut_points, disjoint_intervals, lookup_by_sweep
from tarpit.operators.select import order_statistics, quantile
from tarpit.plans import dashboard as D
from tarpit.plans import reports as R
from tarpit.sources import sinks as S


def ari_brute(a, b):
    n = len(a)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    tp = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    fp = sum(a[i] != a[j] and b[i] == b[j] for i, j in pairs)
    fn = sum(a[i] == a[j] and b[i] != b[j] for i, j in pairs)
    tn = len(pairs) - tp - fp - fn
    if fn == 0 and fp == 0:
        return 1.0
    return 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))


def test_adjusted_rand(spark):
    rnd = random.Random(3)
    a = [rnd.randrange(3) for _ in range(60)]
    b = [rnd.randrange(4) for _ in range(60)]
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    got = C.adjusted_rand(df, "a", "b").first().ari
    assert abs(got - ari_brute(a, b)) < 1e-9
    assert abs(C.adjusted_rand(df, "b", "a").first().ari - got) < 1e-12
    relabel = spark.createDataFrame([(x, (x + 1) % 3) for x in a], "a int, b int")
    assert C.adjusted_rand(relabel, "a", "b").first().ari == pytest.approx(1.0)


def test_silhouette_matches_pairwise(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (15, 3)), rng.normal(-4, 1, (1, 3))])
    lab = [0] * 20 + [1] * 15 + [2]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if lab[j] == lab[i] and j != i]
        if not own:
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(len(x)) if lab[j] == c]].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    df = spark.createDataFrame([(int(l), *map(float, r)) for l, r in zip(lab, x)], "c int, x0 double, x1 double, x2 double")
    got = C.silhouette(df, "c", ["x0", "x1", "x2"]).first().silhouette
    assert got == pytest.approx(float(np.mean(s)), abs=1e-9)


def test_best_threshold_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.random() < 0.3 and 1 or 0, round(rnd.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, score double")
    npos = sum(y for y, _ in rows)
    best = None
    for t in sorted({s for _, s in rows}):
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y == 0)
        f1 = 2 * tp / (tp + fp + npos)
        if best is None or f1 > best[1]:
            best = (t, f1)
    got = M.best_threshold(df, "y", "score").first()
    assert got.best_score == best[0] and got.best_f1 == pytest.approx(best[1])
    assert got.threshold == min(max(best[0], 0.2), 0.55)


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    r = M.binary_metrics(df).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 0.0, 0.0, 0.0)


def test_exact_quantiles(spark):
    rnd = random.Random(1)
    vals = [rnd.choice([1, 2, 2, 3, 5, 8]) + rnd.random() * (i % 2) for i in range(501)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "k long, v double")
    for q in (0.1, 0.5, 0.9):
        got = quantile(df, "v", q)
        assert got == pytest.approx(float(np.percentile(vals, q * 100)), abs=1e-12)
    med = FE.exact_median(df, "v", "m").first().m
    assert med == pytest.approx(float(np.median(vals)))


def test_order_statistics_by_refined_histograms(spark, monkeypatch):
    from tarpit.operators import select
    monkeypatch.setattr(select, "FEW", 3)
    monkeypatch.setattr(select, "BUCKETS", 4)
    rnd = random.Random(2)
    vals = [rnd.choice([-1e308, 1e308, 0.0, -0.0, 5.0]) if rnd.random() < .4 else rnd.random() * 10 ** rnd.randint(-300, 300) for _ in range(300)]
    df = spark.createDataFrame([(v, rnd.randint(0, 3)) for v in vals] + [(None, 9)], "v double, w int")
    assert order_statistics(df, "v", [0, 17, 150, 299]) == [sorted(vals)[k] for k in (0, 17, 150, 299)]
    every = sorted(r.v for r in df.collect() for _ in range(r.w) if r.v is not None)
    ranks = [0, 100, len(every) - 1]
    assert order_statistics(df, "v", ranks, "w") == [every[k] for k in ranks]
    assert quantile(df.where("v is null"), "v", 0.5) is None
    with pytest.raises(ValueError):
        order_statistics(df, "v", [300])
    with pytest.raises(ValueError):
        order_statistics(spark.createDataFrame([(float("inf"),)], "v double"), "v", [0])


def test_sequence_numbers_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1009).alias("v"), F.col("id").alias("k"))
    out = with_sequence_number(df, ["v", "k"], "i", start=5, num_partitions=6).collect()
    by_i = sorted(out, key=lambda r: r.i)
    assert [r.i for r in by_i] == list(range(5, 1005))
    assert [(r.v, r.k) for r in by_i] == sorted((r.v, r.k) for r in out)


def test_batch_ids_and_session_ids(spark):
    df = spark.range(0, 25).select(F.col("id").alias("o"))
    out = {r.o: (r.batch_id, r.session_id) for r in with_batch_ids(df, ["o"], batch_size=10, id_start=99998, order_cols=("o",)).collect()}
    assert out[0] == (0, "SESS-99998") and out[9] == (0, "SESS-100007") and out[10] == (1, "SESS-100008")


def test_prefix_sums(spark):
    vals = [(i, (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(vals, "k long, x long")
    got = {r.k: r.cum_x for r in M.prefix_sums(df, [F.col("k").desc()], ["x"], num_partitions=5).collect()}
    run = 0
    for k, x in sorted(vals, reverse=True):
        run += x
        assert got[k] == run


def test_range_lookup_narrowest_and_miss(spark):
    ranges = spark.createDataFrame([
        (167772160, 184549375, "A", "AA", "ca", 1.0, 2.0, "AS1 Big"),      # 10.0.0.0/8
        (167837696, 167903231, "B", "BB", "cb", 3.0, 4.0, "AS2 Small"),    # 10.1.0.0/16
    ], "ip_start long, ip_end long, country string, country_iso string, city string, latitude double, longitude double, as_text string")
    ips = spark.createDataFrame([("10.1.2.3",), ("10.9.9.9",), ("11.0.0.1",)], "ip string")
    got = {r.ip: r.country for r in G.lookup_ips(ips, ranges, "ip").collect()}
    assert got == {"10.1.2.3": "B", "10.9.9.9": "A"}


def test_sweep_lookup_equals_every_range_tried(spark):
    rnd = random.Random(19)
    text = lambda v: ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    base = 50 << 24
    ranges = []
    for k in range(400):
        lo = base + rnd.randrange(3_000)
        ranges.append((lo, lo + rnd.choice((0, 3, 50, 700, 5_000)), f"r{k % 350}"))
    ranges += [(base, base + 9_000, "wide"), (base + 5, base + 1, "turned"), (None, base, "open"), ranges[0], (0, 4294967295, "all")]
    asked = [base + rnd.randrange(9_500) for _ in range(300)] + [0, 4294967295]
    ips = spark.createDataFrame([(text(v),) for v in asked] + [("no address",), (None,)], "ip string")
    want = {}
    for v in asked:
        over = [(-a, b, n) for a, b, n in ranges if a is not None and a <= v <= b]
        want[text(v)] = min(over)[2]
    for table, parts in ((ranges, 1), (ranges, 7), (ranges, 60)):
        df = spark.createDataFrame(table, "ip_start long, ip_end long, name string")
        rows = lookup_by_sweep(ips, df, "ip", parts).collect()
        assert len(rows) == len(want) and {r.ip: r.name for r in rows} == want
    few = spark.createDataFrame([r for r in ranges if r[2] not in ("all", "wide")], "ip_start long, ip_end long, name string")
    got = {r.ip for r in lookup_by_sweep(ips, few, "ip", 5).collect()}
    assert got == {text(v) for v in asked if any(a is not None and a <= v <= b for a, b, n in ranges if n not in ("all", "wide"))}
    none = spark.createDataFrame([], "ip_start long, ip_end long, name string")
    assert lookup_by_sweep(ips, none).count() == 0 and lookup_by_sweep(ips.limit(0), few).count() == 0


def test_deeply_nested_ranges_fill_no_part(spark):
    n, parts = 200_000, 16
    ranges = spark.range(n).select(F.col("id").alias("ip_start"), (F.lit(3 * n) - F.col("id")).alias("ip_end"))
    ends = ranges.select(F.explode(F.array("ip_start", F.col("ip_end") + 1)).alias("at"))
    cuts = cut_points(ends, "at", parts)
    got = disjoint_intervals(ranges, cuts)
    size = got.groupBy("part").count().collect()
    assert max(r["count"] for r in size) < 4 * 2 * n / parts
    seen = got.agg(F.sum(F.col("stop") - F.col("start") + 1).alias("n"), F.min("start").alias("lo"), F.max("stop").alias("hi")).first()
    assert (seen.n, seen.lo, seen.hi) == (3 * n + 1, 0, 3 * n)
    # before the middle the range that starts there wins, after it the one that ends there
    assert got.where((F.col("start") < n - 1) & (F.col("ip_start") != F.col("start"))).count() == 0
    assert got.where((F.col("stop") > 2 * n + 1) & (F.col("ip_end") != F.col("stop"))).count() == 0


def test_euclidean_silhouette_by_definition(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (20, 2)), rng.normal(4, 1, (15, 2)), rng.normal(-4, 1, (1, 2))])
    lab = [0] * 20 + [1] * 15 + [2]
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if lab[j] == lab[i] and j != i]
        a = d[i, own].mean() if own else 0.0
        b = min(d[i, [j for j in range(len(x)) if lab[j] == c]].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b) if own else 0.0)
    df = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(lab, x))], "id int, c int, x0 double, x1 double")
    euclid = lambda rows, **how: C.silhouette_euclidean(rows, "c", ["x0", "x1"], key_cols=["id"], **how).first().silhouette
    assert euclid(df) == pytest.approx(float(np.mean(s)), abs=1e-9)
    assert euclid(df.where("c = 0")) == 0.0 and euclid(df.limit(0)) is None
    assert euclid(df, n=10) == euclid(df.repartition(5), n=10)
    assert C.sample_n(df, 7, 1, ["id"]).count() == 7


def test_histogram_and_shares(spark):
    vals = [0.0, 4.99, 5.0, 50.0, 99.99, 100.0, 100.0]
    d = spark.createDataFrame([(v,) for v in vals], "risk_score double")
    h = R.risk_histogram(d).orderBy("bin").collect()
    assert len(h) == 20 and sum(r.sessions for r in h) == len(vals)
    assert h[0].sessions == 2 and h[1].sessions == 1 and h[19].sessions == 3 and h[19].label == "95-100"
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "k string, sessions long")
    assert sum(r.share for r in R.with_share(counts).collect()) == pytest.approx(100.0, abs=0.11)


def test_daily_activity_zero_fill(spark):
    from datetime import datetime
    rows = [(datetime(2024, 1, 1, 5), "High Risk"), (datetime(2024, 1, 3, 1), "Low Risk"), (datetime(2024, 1, 3, 9), "high")]
    d = spark.createDataFrame(rows, "timestamp timestamp, predicted_risk_level string")
    got = [(r.day, r.total, r.high_risk) for r in R.daily_activity(d).orderBy("day").collect()]
    assert got == [("2024-01-01", 1, 1), ("2024-01-02", 0, 0), ("2024-01-03", 2, 1)]


def test_zscores_mean_zero_and_constant(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (6, 5.0)], "event_count long, c double")
    z = FE.zscore(df, cols=("event_count", "c")).collect()
    assert sum(r.event_count_norm for r in z) == pytest.approx(0.0, abs=1e-12)
    assert all(r.c_norm == 0.0 for r in z)
    s = FE.standardize(df, ["event_count"]).collect()
    assert sorted(round(r.event_count_z, 6) for r in s) == sorted(round(x, 6) for x in ((np.array([1, 2, 6]) - 3) / np.std([1, 2, 6])))


def test_label_clusters_single_and_many(spark):
    one = spark.createDataFrame([(0, 2), (0, 2)], "behavior_cluster int, behavioral_risk_score int")
    r = C.label_clusters(one).first()
    assert (r.behavior_label, r.cluster_weight) == ("High Risk", 2.0)
    many = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 2), (4, 0)], "behavior_cluster int, behavioral_risk_score int")
    got = {r.behavior_cluster: (r.behavior_label, r.cluster_weight) for r in C.label_clusters(many).collect()}
    assert got == {2: ("High Risk", 2.0), 3: ("Medium Risk", 1.0), 1: ("Medium Risk", 0.0),
                   0: ("Low Risk", -0.5), 4: ("Medium Risk", -0.5)}


def test_merge_keeps_in_batch_duplicates(spark):
    hist = spark.createDataFrame([("s1", 1)], "session string, v long")
    new = spark.createDataFrame([("s1", 2), ("s2", 3), ("s2", 4)], "session string, v long")
    assert sorted(r.v for r in S.merge_new_sessions(new, hist).collect()) == [1, 3, 4]
    assert S.merge_new_sessions(new, hist, dedupe_within=True, only_new=True).count() == 1


def test_dashboard_fallbacks(spark):
    df = spark.createDataFrame([("SESS-1", "10.0.0.1", 3, 1.5, "x", None)],
                               "session_id string, src_ip string, event_count long, risk_score double, latitude string, behavior_label string")
    d = D.prepare_dashboard(df).first()
    assert d.ip_address == "10.0.0.1" and d.lat == 0.0 and d.predicted_risk_level == "Unknown"
    assert d.is_anomaly is False and d.pca_x == 1.5 and str(d.timestamp) == "2024-01-01 00:00:00"
    assert D.resolve_metrics(df).first().accuracy == 0.0
