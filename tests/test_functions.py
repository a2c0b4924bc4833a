"""Golden micro-fixtures for the scalar rules."""
import hashlib
import ipaddress


from tarpit.functions import ip as I
from tarpit.functions import keys as K
from tarpit.functions import labels as L

# Addresses and the scope the rule gives them; the rule looks at the first two octets only.
SCOPES = {
    "10.1.2.3": "private", "172.15.0.1": "public", "172.16.0.1": "private", "172.31.9.9": "private",
    "172.32.0.1": "public", "192.168.1.1": "private", "127.0.0.1": "private", "169.254.1.1": "public",
    "100.64.0.1": "public", "198.18.0.1": "public", "203.0.113.9": "public", "8.8.8.8": "public",
    "999.1.1.1": "public", "1.2.3": "unknown", "a.b.c.d": "unknown", "": "unknown", None: "unknown",
    "::1": "unknown", "01.2.3.4": "public", "192.0.0.9": "public", "192.0.0.8": "public",
    "255.255.255.255": "public", "fe80::1": "unknown", "2001:db8::1": "unknown", "2a00:1450::1": "unknown",
    "0.0.0.0": "public", "240.1.1.1": "public", "fd12:3456::1": "unknown",
}
IP_EDGE = list(SCOPES)


def stdlib_private(ip):
    try:
        return ipaddress.ip_address(ip).is_private
    except Exception:  # noqa: BLE001
        return False


def test_ip_scope_matches_octet_rule(spark):
    df = spark.createDataFrame([(x,) for x in IP_EDGE], "ip string")
    got = {r.ip: r.s for r in df.select("ip", I.ip_scope("ip").alias("s")).collect()}
    assert got == SCOPES


def test_is_private_matches_stdlib(spark):
    df = spark.createDataFrame([(x,) for x in IP_EDGE], "ip string")
    got = {r.ip: r.p for r in df.select("ip", I.is_private_ip("ip").alias("p")).collect()}
    for ip in IP_EDGE:
        assert got[ip] == stdlib_private(ip), ip


def test_asn_split(spark):
    df = spark.createDataFrame([("AS64500 Example Net",), ("AS1",), (None,)], "a string")
    rows = df.select(I.asn_number("a").alias("n"), I.asn_org("a").alias("o")).collect()
    assert [(r.n, r.o) for r in rows] == [("AS64500", "Example Net"), ("AS1", "unknown"), ("unknown", "unknown")]


def test_session_hash_is_md5_prefix(spark):
    keys = ["abc", "s1", "10.0.0.1", "unknown"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r.h for r in df.select(K.session_hash("k").alias("h")).collect()]
    assert got == [hashlib.md5(k.encode()).hexdigest()[:12] for k in keys]


def test_session_key_fallbacks(spark):
    df = spark.createDataFrame([("a", "1.1.1.1"), ("", "2.2.2.2"), (None, "3.3.3.3"), (None, None)], "session string, src_ip string")
    assert [r.k for r in df.select(K.session_key().alias("k")).collect()] == ["a", "2.2.2.2", "3.3.3.3", "unknown"]


def test_threat_level_all_flag_combinations(spark):
    rows = []
    for e in (5, 11):
        for d in (100.0, 301.0):
            for c in (1, 6):
                rows.append((e, d, c, "Low Risk", False))
    rows += [(1, 1.0, 0, "High Risk", False), (1, 1.0, 0, "Low Risk", True), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "e long, d double, c long, lab string, an boolean")
    got = [r.t for r in df.select(L.threat_level("e", "d", "c", "lab", "an").alias("t")).collect()]
    expect = []
    for e, d, c, lab, an in rows:
        s = sum(bool(x is not None and x > k) for x, k in ((e, 10), (d, 300), (c, 5)))
        base = "high" if s >= 3 else "medium" if s == 2 else "low"
        expect.append("high" if lab == "High Risk" or an is True else base)
    assert got == expect


def test_risk_to_100_and_bands(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.0,), (5.0,), (9.0,), (float("nan"),)], "x double")
    got = [r.y for r in df.select(L.risk_to_100("x").alias("y")).collect()]
    assert got[0] == 0 and got[1] == 0 and abs(got[2] - 200 / 7) < 1e-12 and got[3] == 100 and got[4] == 100
    assert got[5] == 0
    b = spark.createDataFrame([(None,), (0.3,), (0.31,), (0.7,), (0.71,), (1.5,), (-1.0,)], "s double")
    assert [r.b for r in b.select(L.ml_risk_band("s").alias("b")).collect()] == [
        "Low Risk", "Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk", "Low Risk"]


def test_coerce_bool_and_levels(spark):
    df = spark.createDataFrame([("TRUE",), ("true",), ("False",), ("FALSE",), ("yes",), ("",), (None,)], "v string")
    assert [r.b for r in df.select(L.coerce_bool("v").alias("b")).collect()] == [True, True, False, False, False, False, False]
    lv = spark.createDataFrame([(0.0,), (10.0,), (33.0,), (50.0,), (66.5,), (100.0,)], "r double")
    assert [r.l for r in lv.select(L.level_from_100("r").alias("l")).collect()] == [
        "Unknown", "Low Risk", "Low Risk", "Medium Risk", "High Risk", "High Risk"]
    z = spark.createDataFrame([(2.5,), (2.0,), (0.1,), (0.0,), (None,)], "r double")
    assert [r.l for r in z.select(L.zscore_label("r").alias("l")).collect()] == [
        "High Risk", "Medium Risk", "Medium Risk", "Low Risk", "Low Risk"]


def test_marker_and_stability_bands(spark):
    df = spark.createDataFrame([(81.0, 0.81), (80.0, 0.8), (51.0, 0.51), (50.0, 0.5), (None, None)], "r double, s double")
    rows = df.select(L.risk_band3("r").alias("m"), L.stability_band("s").alias("b")).collect()
    assert [(r.m, r.b) for r in rows] == [("red", "high"), ("amber", "medium"), ("amber", "medium"), ("teal", "low"), ("teal", "low")]


def test_cluster_threat_map_default(spark):
    df = spark.createDataFrame([(0,), (4,), (7,), (None,)], "c int")
    rows = df.select(*[v.alias(k) for k, v in L.cluster_threat_cols("c").items()]).collect()
    assert rows[0].attacker_type == "Low Automation" and rows[1].threat_archetype == "Anomalous Behavior"
    assert rows[2].attacker_type == "Unclassified" and rows[3].confidence_level == "Low"


def test_parse_and_format_ts(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00.5Z",), ("2024-01-01T10:00:00+02:00",), ("garbage",)], "t string")
    got = [r.f for r in df.select(K.fmt_ts(K.parse_ts("t")).alias("f")).collect()]
    assert got == ["2024-01-01 10:00:00", "2024-01-01 08:00:00", None]
