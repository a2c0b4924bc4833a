"""Per-batch statistics (the reference's behaviour), dashboard parsing, O3."""
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarpit.functions import labels as L
from tarpit.operators import features as FE
from tarpit.plans import reports as R


def test_zscore_per_batch_scope(spark):
    rows = [(0, 1), (0, 2), (0, 6), (1, 10), (1, 30)]
    df = spark.createDataFrame(rows, "batch_id long, event_count long")
    got = {(r.batch_id, r.event_count): r.event_count_norm
           for r in FE.zscore(df, cols=("event_count",), scope_cols=["batch_id"]).collect()}
    for b in (0, 1):
        xs = np.array([x for bb, x in rows if bb == b], dtype=float)
        for x in xs:
            assert got[(b, int(x))] == pytest.approx((x - xs.mean()) / xs.std(ddof=1))


def test_median_flags_global_and_scoped(spark):
    rows = [(0, "a", 0, 1, 10.0), (0, "b", 0, 2, 20.0), (0, "c", 0, 3, 30.0), (0, "d", 0, 10, 40.0),
            (1, "e", 0, 5, 1.0), (1, "f", 0, 7, 2.0)]
    df = spark.createDataFrame(rows, "batch_id long, session string, seg long, event_count long, session_duration double")
    g = {r.session: (r.median_high_event_activity, r.median_long_session) for r in FE.median_flags(df).collect()}
    med_e, med_d = np.median([r[3] for r in rows]), np.median([r[4] for r in rows])
    for r in rows:
        assert g[r[1]] == (r[3] > med_e, r[4] > med_d)
    s = {r.session: r.median_high_event_activity for r in FE.median_flags(df, scope_cols=["batch_id"]).collect()}
    assert s == {"a": False, "b": False, "c": True, "d": True, "e": False, "f": True}


def test_dashboard_ts_formats(spark):
    df = spark.createDataFrame([("2024-01-05 10:00:00",), ("05-01-2024 10:00",), ("garbage",)], "t string")
    got = [r.ts for r in df.select(L.dashboard_ts("t").alias("ts")).collect()]
    assert got[0] == datetime(2024, 1, 5, 10, 0) and got[1] == datetime(2024, 1, 5, 10, 0) and got[2] is None


def test_first_anomalies_in_stored_order(spark):
    """By batch, highest risk first, then the id's number (100000 after 99999)."""
    rows = [(f"SESS-{i:05d}", i % 3 == 0, i % 2, float(i // 30000)) for i in range(99_900, 100_100)]
    d = spark.createDataFrame(rows, "session_id string, is_anomaly boolean, batch_id long, risk_score double")
    got = [r.session_id for r in R.first_anomalies(d).collect()]
    want = sorted((r for r in rows if r[1]), key=lambda r: (r[2], -r[3], int(r[0][5:])))
    assert got == [r[0] for r in want][:20]
    same = d.withColumn("risk_score", F.lit(50.0)).withColumn("predicted_risk_level", F.lit("High Risk"))
    assert R.top_risk(same.where("session_id >= 'SESS-99999' or session_id < 'SESS-2'"), 2).first().session_id == "SESS-99999"


def test_report_bundles_build(spark):
    d = spark.createDataFrame(
        [("SESS-1", "1.2.3.4", 5, 70.0, 1.0, 0.5, "High Risk", True, "C1", "AS1", 1.0, 2.0, 2, 1, 1, 1,
          datetime(2024, 1, 1), "Scanner", "x", "low", 0, 0.9)],
        "session_id string, ip_address string, events_count long, risk_score double, risk_score_raw double, "
        "pca_x double, predicted_risk_level string, is_anomaly boolean, country string, asn string, lat double, "
        "lon double, failed_logins long, unique_commands long, unique_usernames long, duration long, "
        "timestamp timestamp, attacker_type string, threat_archetype string, campaign_severity string, "
        "cluster int, cluster_stability double").withColumn("pca_y", F.lit(0.0)).withColumn("behavior_label", F.lit("High Risk"))
    m = spark.createDataFrame([(0.9, 0.8, 0.7)], "accuracy double, precision double, recall double")
    for bundle in (R.overview_report(d, m), R.risk_report(d, m), R.behavioral_report(d), R.geo_report(d)):
        for name, frame in bundle.items():
            frame.collect()


def test_batch_scoped_enrichment_equals_separate_batches(spark):
    """scope_cols=['batch_id'] must equal enriching every batch on its own."""
    from tarpit.operators.sessionize import sessionize
    from tarpit.plans.enrich import enrich
    from tarpit.sources import fixtures
    sf = "/root/testdata/sf0.001"
    s = sessionize(fixtures.raw_events(spark, sf), keep_order_cols=True)
    ranges = fixtures.geo_ranges(spark, sf)
    cols = ["session_id", "event_count_norm", "behavior_label", "risk_score", "campaign_total_sessions",
            "campaign_severity", "risk_level"]
    scoped = enrich(s, ranges, clusterer=fixtures.rule_clusters, with_ml=False, with_pca=False,
                    scope_cols=["batch_id"], batch_size=80)
    got = {r.session_id: r for r in scoped.select(*cols, "batch_id").collect()}
    assert len({r.batch_id for r in got.values()}) == 3
    for b in range(3):
        ids = {k for k, r in got.items() if r.batch_id == b}
        lo = min(int(k[5:]) for k in ids)
        part = enrich(s, ranges, clusterer=fixtures.rule_clusters, with_ml=False, with_pca=False,
                      batch_size=10 ** 9, id_start=9786)
        # Re-enrich only this batch's sessions (ids continue from the batch start).
        keep = part.where(F.col("session_id").isin(sorted(ids))).select("session", "seg")
        sub = s.join(keep, ["session", "seg"])
        alone = enrich(sub, ranges, clusterer=fixtures.rule_clusters, with_ml=False, with_pca=False,
                       id_start=lo).select(*cols).collect()
        for r in alone:
            g = got[r.session_id]
            for c in cols:
                a, e = getattr(g, c), getattr(r, c)
                assert (a == pytest.approx(e)) if isinstance(e, float) else a == e, (c, a, e)


def test_enrich_raises_failures_and_falls_back_without_data(spark, monkeypatch):
    """A failing job is raised; a table that can't be clustered gets the reference's
    fallback values for the whole clustering block and later stages still run."""
    from tarpit.operators import clustering as C
    from tarpit.operators.sessionize import sessionize
    from tarpit.plans.enrich import enrich
    from tarpit.sources import fixtures

    sf, info = "/root/testdata/sf0.001", {}
    s = sessionize(fixtures.raw_events(spark, sf), keep_order_cols=True)
    one = s.orderBy("session", "seg").limit(1)
    rows = enrich(one, fixtures.geo_ranges(spark, sf), with_ml=False, with_pca=False, info=info).collect()
    assert "error" in info["clustering"]
    assert [(r.behavior_cluster, r.behavior_label, r.is_anomaly, r.dbscan_label, r.cluster_stability, r.attacker_type) for r in rows] == [
        (0, "Unknown", False, 0, 0.0, "Unclassified")]

    def boom(*a, **k):
        raise RuntimeError("forced")
    monkeypatch.setattr(C, "choose_k", boom)
    with pytest.raises(RuntimeError, match="forced"):
        enrich(s, fixtures.geo_ranges(spark, sf), with_ml=False, with_pca=False)
