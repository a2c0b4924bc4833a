"""Model stages (properties, not bit-equality) and streaming = batch."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarpit.operators import clustering as C
from tarpit.operators import features as FE
from tarpit.operators import ml as M
from tarpit.operators.isolation_forest import isolation_forest
from tarpit.operators.sessionize import sessionize
from tarpit.sources import fixtures
from tarpit.sources.events import read_events, stream_events
from tarpit.streaming.runner import write_ndjson
from tarpit.streaming.sessionizer import stream_sessions

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sess(spark):
    return FE.behavior_flags(sessionize(fixtures.raw_events(spark, SF))).cache()


def test_isolation_forest_contamination(spark, sess):
    z = FE.standardize(sess, list(FE.AUTH_FEATURES), suffix="_if")
    out = isolation_forest(z, [f"{c}_if" for c in FE.AUTH_FEATURES], seed=42)
    n, k = out.count(), out.where("is_anomaly").count()
    assert 0.05 * n <= k <= 0.11 * n
    assert out.where("is_anomaly").agg(F.max("anomaly_score")).first()[0] < \
        out.where("not is_anomaly").agg(F.min("anomaly_score")).first()[0] + 1e-12
    again = isolation_forest(z, [f"{c}_if" for c in FE.AUTH_FEATURES], seed=42).where("is_anomaly").count()
    assert again == k


def test_kmeans_canonical_ids(spark, sess):
    f = FE.standardize(sess, FE.CLUSTER_FEATURES)
    a = C.cluster_sessions(f, 3).groupBy("behavior_cluster").agg(F.avg("behavioral_risk_score").alias("m")).orderBy("behavior_cluster").collect()
    assert [r.behavior_cluster for r in a] == [0, 1, 2]
    assert [r.m for r in a] == sorted(r.m for r in a)


def test_pca_orthogonal_and_signed(spark, sess):
    p = M.pca2(sess).select("pca_x", "pca_y").toPandas().to_numpy()
    assert abs(np.corrcoef(p[:, 0], p[:, 1])[0, 1]) < 1e-6
    assert p[:, 0].var() >= p[:, 1].var()


def test_stratified_split_counts(spark, sess):
    sc = fixtures.scored(sess)
    sp = M.stratified_split(sc, "y", 0.3, 42)
    for r in sp.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r.t == int(np.ceil(r.n * 0.3))


def test_risk_model_fallback_and_scores(spark, sess):
    one_class = sess.withColumn("is_anomaly", F.lit(False))
    out, m = M.ml_risk(one_class.limit(50))
    assert out.where(F.col("ml_risk_score") != 0).count() == 0 or "error" in m


COLS = ["session", "seg", "src_ip", "event_count", "unique_commands", "failed_logins", "successful_login",
        "unique_usernames", "session_duration"]


def _rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(*COLS).collect())


def _run(spark, feed, base, gap=None, flush=True):
    def sink(found, batch):
        found.write.mode("overwrite").parquet(os.path.join(base, "out", f"batch={batch}"))
    stream_sessions(stream_events(spark, feed, max_files_per_trigger=1), os.path.join(base, "ckpt"), sink, gap=gap, flush=flush)
    return spark.read.parquet(os.path.join(base, "out"))


def _land(feed, i, events):
    import json
    os.makedirs(feed, exist_ok=True)
    path = os.path.join(feed, f"log{i}.json")
    with open(path, "w") as f:
        f.write("".join(json.dumps(e) + "\n" for e in events))
    os.utime(path, (2000 + i, 2000 + i))


def _event(key, kind, at, **more):
    return {"session": key, "src_ip": "1.1.1.1", "eventid": f"cowrie.{kind}", **({"timestamp": at} if at else {}), **more}


def test_stream_equals_batch_with_restart(spark, scratch):
    """Two runs over a growing folder, a trigger per file: with the open sessions flushed
    at the end, exactly the batch result over the whole log."""
    logs, feed = os.path.join(scratch, "logs"), os.path.join(scratch, "feed")
    write_ndjson(fixtures.raw_events(spark, "/root/testdata/sf0.001"), logs, files=6)
    names = sorted((n for n in os.listdir(logs) if n.endswith(".txt")),
                   key=lambda n: os.path.getmtime(os.path.join(logs, n)))
    os.makedirs(feed)
    for part, last in ((names[:3], False), (names[3:], True)):
        for n in part:
            os.link(os.path.join(logs, n), os.path.join(feed, n))
        out = _run(spark, feed, scratch, flush=last)
    assert _rows(out) == _rows(sessionize(read_events(spark, logs), seq="arrival", chunk="split"))


def test_stream_keeps_late_and_untimed_events_in_arrival_order(spark, scratch):
    feed = os.path.join(scratch, "feed")
    _land(feed, 0, [_event("a", "session.connect", "2024-01-01T10:00:00Z"), _event("a", "login.failed", None, username="root")])
    _land(feed, 1, [_event("b", "session.connect", "2024-01-01T12:00:00Z"), _event("b", "session.closed", "2024-01-01T12:01:00Z")])
    _land(feed, 2, [_event("late", "session.connect", "2024-01-01T01:00:00Z"), _event("late", "session.closed", "2024-01-01T01:00:30Z"),
                    _event("a", "session.closed", "2024-01-01T10:00:30Z")])
    out = _run(spark, feed, scratch)
    assert _rows(out) == _rows(sessionize(read_events(spark, feed), seq="arrival", chunk="split"))
    assert out.where("failed_logins = 1 and seg = 0 and event_count = 3").count() == 1


def test_stream_timeout_then_reopen_keeps_counting_segments(spark, scratch):
    """Close, idle timeout, reopen: segments 0, 1 and 2."""
    feed = os.path.join(scratch, "feed")
    _land(feed, 0, [_event("k", "session.connect", "2024-01-01T00:00:00Z"), _event("k", "session.closed", "2024-01-01T00:00:10Z")])
    _land(feed, 1, [_event("k", "login.failed", "2024-01-01T00:01:00Z", username="x")])
    _land(feed, 2, [_event("other", "session.connect", "2024-01-01T03:00:00Z")])
    _land(feed, 3, [_event("k", "login.failed", "2024-01-01T03:00:10Z", username="y"), _event("k", "session.closed", "2024-01-01T03:00:20Z")])
    rows = _run(spark, feed, scratch, gap="10 minutes").where("src_ip = '1.1.1.1'").collect()
    import hashlib
    k = hashlib.md5(b"k").hexdigest()[:12]
    assert sorted((r.seg, r.event_count, r.closed) for r in rows if r.session == k) == [(0, 2, True), (1, 1, False), (2, 2, True)]


def test_retried_batch_gives_the_same_rows_and_state(spark, scratch):
    from tarpit.streaming.sessionizer import SessionState, flush_open, session_batch
    feed, state = os.path.join(scratch, "feed"), SessionState(spark, os.path.join(scratch, "state"))
    _land(feed, 0, [_event("k", "session.connect", None), _event("k", "session.closed", None), _event("k", "session.connect", None)])
    first = _rows(session_batch(read_events(spark, feed).drop("arrival"), 0, state))
    assert _rows(session_batch(read_events(spark, feed).drop("arrival"), 0, state)) == first
    flushed = flush_open(state, 0).collect()
    assert [(r.seg, r.event_count, r.closed) for r in flushed] == [(1, 1, False)]
    again = session_batch(read_events(spark, feed).drop("arrival"), 1, state).collect()
    assert [r.seg for r in again] == [2]  # what was flushed isn't emitted again


def test_read_events_orders_rotated_files(spark, scratch):
    """Small rotated files are packed by size; arrival must still follow
    modification time, then line order."""
    import time
    for i, n in enumerate((1, 50, 3)):
        with open(os.path.join(scratch, f"log{i}.json"), "w") as f:
            for j in range(n):
                f.write('{"session": "k", "eventid": "e%d_%d"}\n' % (i, j))
        time.sleep(0.05)
        os.utime(os.path.join(scratch, f"log{i}.json"), (1000 + i, 1000 + i))
    got = [r.eventid for r in read_events(spark, scratch).orderBy("arrival").collect()]
    assert got == [f"e{i}_{j}" for i, n in enumerate((1, 50, 3)) for j in range(n)]


def test_choose_k_and_stability_repeatable(spark, sess):
    f = FE.standardize(sess, FE.CLUSTER_FEATURES)
    zc = [f"{c}_z" for c in FE.CLUSTER_FEATURES]
    k, trials = C.choose_k(f, zc)
    assert 2 <= k <= 5 and [t["k"] for t in trials] == [2, 3, 4, 5]
    assert C.choose_k(f, zc) == (k, trials)
    st = C.cluster_stability(f, zc)
    assert -1.0 <= st <= 1.0 and st == C.cluster_stability(f, zc)


def test_silhouette_and_rand_index_by_definition(spark):
    rng = np.random.default_rng(5)
    x, a, b = rng.normal(size=(60, 3)), rng.integers(0, 3, 60), rng.integers(0, 2, 60)
    df = spark.createDataFrame([(int(i), int(j), *map(float, r)) for i, j, r in zip(a, b, x)],
                               "c int, d int, x0 double, x1 double, x2 double")
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i in range(60):
        mean = {c: dist[i, (a == c) & (np.arange(60) != i)].mean() for c in range(3)}
        inside, outside = mean.pop(a[i]), min(mean[c] for c in range(3) if c != a[i])
        scores.append((outside - inside) / max(inside, outside))
    assert C.silhouette(df, "c", ["x0", "x1", "x2"]).first().silhouette == pytest.approx(np.mean(scores))
    pairs = [(a[i] == a[j], b[i] == b[j]) for i in range(60) for j in range(i)]
    both, one, two, n = (sum(v) for v in (((p and q) for p, q in pairs), (p for p, _ in pairs), (q for _, q in pairs), (1 for _ in pairs)))
    chance = one * two / n
    assert C.adjusted_rand(df, "c", "d").first().ari == pytest.approx((both - chance) / ((one + two) / 2 - chance))


def test_edges_that_divide_by_zero(spark):
    same = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "c int, x double")
    assert C.silhouette(same, "c", ["x"]).first().silhouette == 0.0
    assert C.adjusted_rand(same.limit(1), "c", "c").first().ari == 1.0
    from tarpit.plans import dashboard as D
    from tarpit.plans import reports as R
    flat = spark.createDataFrame([(5,), (5,)], "events_count int")
    assert [r.pca_y for r in D.pca_fallback_y(flat).collect()] == [None, None]
    none = spark.createDataFrame([], "is_anomaly boolean")
    assert R.anomaly_summary(none).first().anomaly_rate == 0.0


def test_failures_are_raised_and_nothing_to_cluster_falls_back(spark, sess, monkeypatch):
    out, info = C.behavioral_clustering(sess.limit(1))
    assert "error" in info and {r.behavior_label for r in out.collect()} == {"Unknown"}
    monkeypatch.setattr(C, "fit_kmeans", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        C.behavioral_clustering(sess)


def test_saved_model_scores_like_the_fitted_one(spark, sess, scratch):
    labelled = sess.withColumn("is_anomaly", F.col("failed_logins") > 1)
    out, _ = M.ml_risk(labelled, model_path=os.path.join(scratch, "m"))
    key = lambda df: sorted((r.session, r.seg, round(r.ml_risk_score, 9)) for r in df.select("session", "seg", "ml_risk_score").collect())
    assert key(M.score_with_saved(labelled, os.path.join(scratch, "m"))) == key(out)
