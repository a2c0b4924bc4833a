"""DuckDB twins of the catalog queries (the correctness oracle).

Every oracle starts from the same driver tables as the Spark query and
recomputes the whole chain in plain SQL: the stand-in raw events, the
close-marker segmentation with a window, the session aggregate and then the
operator under test. Shared steps are CTE fragments below. Lists of
networks and threat names are written out here, apart from the engine's.
"""

from __future__ import annotations

# Written out here on purpose: a wrong entry of the engine's tables must show.
PRIVATE_NETS = """0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.170/31 192.0.2.0/24
  192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 255.255.255.255/32"""
NOT_PRIVATE = "192.0.0.9/32 192.0.0.10/32"
_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
STRICT_IPV4 = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
THREATS = {
    0: ("Low Automation", "Reconnaissance / Noise", "Medium"), 1: ("Brute Force Bot", "Credential Stuffing", "High"),
    2: ("Manual Attacker", "Interactive Exploration", "High"), 3: ("Scanner", "Wide Network Scan", "Medium"),
    4: ("Unknown Pattern", "Anomalous Behavior", "Low"),
}
NO_THREAT = ("Unclassified", "Unknown", "Low")

ANCHOR_US = 1704067200000000


def raw_cte(name: str = "raw", where: str = "") -> str:
    return f"""{name} AS (
  SELECT event_id AS event_seq,
    's' || CAST(user_id AS VARCHAR) AS session,
    CASE WHEN user_id % 5 = 0
      THEN '10.0.' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR)
      ELSE CAST(20 + user_id % 150 AS VARCHAR) || '.' || CAST(user_id % 200 AS VARCHAR) || '.1.'
           || CAST(user_id % 250 AS VARCHAR) END AS src_ip,
    CASE event_type WHEN 'error' THEN 'cowrie.login.failed' WHEN 'signup' THEN 'cowrie.login.success'
      WHEN 'click' THEN 'cowrie.command.input' WHEN 'view' THEN 'cowrie.session.connect'
      ELSE 'cowrie.session.closed' END AS eventid,
    {ANCHOR_US} + (epoch_us(ts) - {ANCHOR_US}) // 600 AS cus,
    CASE WHEN event_type = 'click'
      THEN 'cmd' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS VARCHAR) END AS input,
    CASE WHEN event_type IN ('error', 'signup')
      THEN 'user' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) END AS username
  FROM events {where})"""


def segmented_cte(src: str = "raw", name: str = "ev") -> str:
    return f"""{name} AS (
  SELECT *, COALESCE(NULLIF(session, ''), src_ip, 'unknown') AS skey,
    COALESCE(SUM(CASE WHEN eventid = 'cowrie.session.closed' THEN 1 ELSE 0 END) OVER (
      PARTITION BY COALESCE(NULLIF(session, ''), src_ip, 'unknown') ORDER BY event_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM {src})"""


def sessions_cte(src: str = "ev", name: str = "sess") -> str:
    return f"""{name} AS (
  SELECT substr(md5(skey), 1, 12) AS session, CAST(seg AS BIGINT) AS seg,
    arg_min(src_ip, event_seq) AS src_ip,
    COUNT(*) AS event_count,
    COUNT(DISTINCT CASE WHEN regexp_matches(input, '\\S') THEN input END) AS unique_commands,
    CASE WHEN MAX(cus) IS NULL OR MAX(cus) - MIN(cus) = 0 THEN CAST(5 * COUNT(*) AS DOUBLE)
         ELSE (MAX(cus) - MIN(cus)) / 1e6 END AS session_duration,
    CAST(SUM(CASE WHEN eventid = 'cowrie.login.failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed_logins,
    CAST(SUM(CASE WHEN eventid = 'cowrie.login.success' THEN 1 ELSE 0 END) AS BIGINT) AS successful_login,
    COUNT(DISTINCT username) AS unique_usernames,
    make_timestamp(MIN(cus)) AS session_start, make_timestamp(MAX(cus)) AS session_end,
    MIN(event_seq) AS first_seq, MAX(event_seq) AS last_seq,
    MAX(CASE WHEN eventid = 'cowrie.session.closed' THEN 1 ELSE 0 END) = 1 AS closed
  FROM {src} GROUP BY skey, seg)"""


RAW, SEGMENTED, SESSIONS = raw_cte(), segmented_cte(), sessions_cte()


def _b(expr: str) -> str:
    return f"CAST(COALESCE({expr}, false) AS INTEGER)"


# Fixed flags and the 0-3 score.
FLAGS = f"""flg AS (
  SELECT *, COALESCE(event_count > 10, false) AS high_event_activity,
    COALESCE(session_duration > 60, false) AS long_session,
    COALESCE(unique_commands > 5, false) AS command_heavy,
    COALESCE(failed_logins > 0, false) AS credential_guessing,
    CAST({_b('event_count > 10')} + {_b('session_duration > 60')} + {_b('unique_commands > 5')} AS INTEGER)
      AS behavioral_risk_score
  FROM sess)"""


def zcol(c: str, pop: bool = False, fill: bool = False, suffix: str = "_norm") -> str:
    x = f"COALESCE(CAST({c} AS DOUBLE), 0.0)" if fill else f"CAST({c} AS DOUBLE)"
    sd = "STDDEV_POP" if pop else "STDDEV_SAMP"
    return (f"({x} - AVG({x}) OVER ()) / CASE WHEN {sd}({x}) OVER () > 0 THEN {sd}({x}) OVER () "
            f"ELSE 1.0 END AS {c}{suffix}")


ZS = f"""zs AS (
  SELECT *, {zcol('event_count')}, {zcol('unique_commands')}, {zcol('session_duration')} FROM flg)"""

RULE_CLUSTER = ("CAST(CASE WHEN event_count > 10 THEN 2 WHEN session_duration > 60 THEN 1 ELSE 0 END AS INTEGER)"
                " AS behavior_cluster")
RC = f"rc AS (SELECT *, {RULE_CLUSTER} FROM zs)"

LAB = """lab AS (
  SELECT behavior_cluster, mean_score,
    CASE WHEN n = 1 THEN (CASE WHEN mean_score >= 2 THEN 'High Risk' WHEN mean_score >= 1 THEN 'Medium Risk'
                               ELSE 'Low Risk' END)
         WHEN ra = 1 THEN 'Low Risk' WHEN ra = n THEN 'High Risk' ELSE 'Medium Risk' END AS behavior_label,
    CAST(CASE WHEN rd = 1 THEN 2.0 WHEN rd = 2 THEN 1.0 WHEN rd = 3 THEN 0.0 ELSE -0.5 END AS DOUBLE) AS cluster_weight
  FROM (SELECT behavior_cluster, mean_score, COUNT(*) OVER () AS n,
          ROW_NUMBER() OVER (ORDER BY mean_score ASC, behavior_cluster ASC) AS ra,
          ROW_NUMBER() OVER (ORDER BY mean_score DESC, behavior_cluster ASC) AS rd
        FROM (SELECT behavior_cluster, AVG(CAST(behavioral_risk_score AS DOUBLE)) AS mean_score
              FROM rc GROUP BY behavior_cluster) m) r)"""

RL = """rl AS (
  SELECT rc.*, lab.behavior_label, lab.cluster_weight,
    event_count_norm * CAST(0.4 AS DOUBLE) + unique_commands_norm * CAST(0.3 AS DOUBLE)
      + session_duration_norm * CAST(0.2 AS DOUBLE) + COALESCE(lab.cluster_weight, CAST(0.0 AS DOUBLE)) AS risk_score
  FROM rc LEFT JOIN lab USING (behavior_cluster))"""


def ip_scope_sql(c: str) -> str:
    p1 = f"TRY_CAST(string_split({c}, '.')[1] AS INTEGER)"
    p2 = f"TRY_CAST(string_split({c}, '.')[2] AS INTEGER)"
    return (f"CASE WHEN {c} IS NULL OR len(string_split({c}, '.')) <> 4 THEN 'unknown' "
            f"WHEN {p1} IS NULL OR {p2} IS NULL THEN 'unknown' "
            f"WHEN {p1} = 10 THEN 'private' WHEN {p1} = 172 AND {p2} BETWEEN 16 AND 31 THEN 'private' "
            f"WHEN {p1} = 192 AND {p2} = 168 THEN 'private' WHEN {p1} = 127 THEN 'private' ELSE 'public' END")


def ipv4_long_sql(c: str) -> str:
    parts = [f"CAST(string_split({c}, '.')[{i}] AS BIGINT)" for i in (1, 2, 3, 4)]
    return (f"CASE WHEN regexp_full_match({c}, '{STRICT_IPV4}') THEN "
            f"{parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]} END")


def is_private_sql(c: str) -> str:
    v = ipv4_long_sql(c)

    def inside_of(nets):
        parts = [n.split("/") for n in nets.split()]
        bases = [(sum(int(o) << s for o, s in zip(a.split("."), (24, 16, 8, 0))), 1 << (32 - int(bits))) for a, bits in parts]
        return " OR ".join(f"(v >= {base} AND v < {base + size})" for base, size in bases)
    inside, exc = inside_of(PRIVATE_NETS), inside_of(NOT_PRIVATE)
    v6 = (f"(contains({c}, ':') AND (lower({c}) IN ('::1', '::', '0:0:0:0:0:0:0:1', '0:0:0:0:0:0:0:0') "
          f"OR regexp_matches(lower({c}), '^f[cd][0-9a-f]{{0,2}}:') OR regexp_matches(lower({c}), '^fe[89ab][0-9a-f]:') "
          f"OR starts_with(lower({c}), '2001:db8:') OR lower({c}) = '2001:db8::') "
          f"AND regexp_matches(lower({c}), '^[0-9a-f:]+$') AND length(string_split(lower({c}), ':')[1]) <= 4)")
    return (f"COALESCE((SELECT CASE WHEN v IS NOT NULL THEN (({inside}) AND NOT ({exc})) ELSE {v6} END "
            f"FROM (SELECT {v} AS v)), false)")


SC = f"sc AS (SELECT *, {ip_scope_sql('src_ip')} AS ip_scope FROM rl)"

GEO = """geo AS (
  SELECT o * 16777216 AS ip_start, o * 16777216 + 16777215 AS ip_end, n_name AS country,
    'C' || lpad(CAST(o % 25 AS VARCHAR), 2, '0') AS country_iso, 'City-' || CAST(o AS VARCHAR) AS city,
    CAST(o % 90 AS DOUBLE) AS latitude, CAST(o % 180 AS DOUBLE) AS longitude,
    'AS' || CAST(64500 + o % 40 AS VARCHAR) || ' Net ' || CAST(o AS VARCHAR) AS as_text
  FROM (SELECT range AS o FROM range(20, 170)) r JOIN nation ON n_nationkey = o % 25 WHERE o % 11 <> 0)"""


def geo_join_cte(src: str, name: str = "gj") -> str:
    return f"""ipl_{name} AS (SELECT DISTINCT src_ip AS gip, {ipv4_long_sql('src_ip')} AS ip_long
    FROM {src} WHERE ip_scope = 'public'),
  hit_{name} AS (SELECT gip, g.country AS h_country, g.country_iso AS h_iso, g.city AS h_city,
    g.latitude AS h_lat, g.longitude AS h_lon, COALESCE(g.as_text, 'unknown unknown') AS h_as
    FROM ipl_{name} JOIN geo g ON ip_long BETWEEN g.ip_start AND g.ip_end),
  {name} AS (SELECT s.*,
    CASE WHEN ip_scope = 'private' THEN 'Internal' WHEN gip IS NOT NULL THEN COALESCE(h_country, 'unknown') ELSE 'unknown' END AS country,
    CASE WHEN ip_scope = 'private' THEN 'INT' WHEN gip IS NOT NULL THEN COALESCE(h_iso, 'unknown') ELSE 'unknown' END AS country_iso,
    CASE WHEN ip_scope = 'private' THEN 'Internal' WHEN gip IS NOT NULL THEN COALESCE(h_city, 'unknown') ELSE 'unknown' END AS city,
    CASE WHEN ip_scope <> 'private' AND gip IS NOT NULL THEN h_lat END AS latitude,
    CASE WHEN ip_scope <> 'private' AND gip IS NOT NULL THEN h_lon END AS longitude,
    CASE WHEN ip_scope = 'private' THEN 'unknown' WHEN gip IS NOT NULL THEN split_part(h_as, ' ', 1) ELSE 'unknown' END AS asn,
    CASE WHEN ip_scope = 'private' THEN 'unknown' WHEN gip IS NOT NULL THEN
      (CASE WHEN strpos(h_as, ' ') > 0 THEN substr(h_as, strpos(h_as, ' ') + 1) ELSE 'unknown' END) ELSE 'unknown' END AS asn_org
    FROM {src} s LEFT JOIN hit_{name} ON s.src_ip = hit_{name}.gip)"""


THREAT_SCORE = (f"({_b('event_count > 10')} + {_b('session_duration > 300')} + {_b('unique_commands > 5')})")
TL = f"""tl AS (SELECT *, CASE WHEN COALESCE(behavior_label = 'High Risk', false) OR event_count % 7 = 0 THEN 'high'
    WHEN {THREAT_SCORE} >= 3 THEN 'high' WHEN {THREAT_SCORE} = 2 THEN 'medium' ELSE 'low' END AS risk_level FROM gj)"""


def campaign_ctes(src: str) -> str:
    return f"""ck AS (SELECT *, COALESCE(country_iso, 'None') || '_' || COALESCE(asn, 'None') AS campaign_key FROM {src}),
  camp AS (SELECT campaign_key, COUNT(session) AS campaign_total_sessions,
    AVG(CAST(event_count AS DOUBLE)) AS campaign_avg_event_count,
    AVG(CAST(unique_commands AS DOUBLE)) AS campaign_avg_unique_cmds,
    CAST(SUM(CAST(high_event_activity AS INTEGER)) AS BIGINT) AS campaign_high_activity,
    CAST(SUM(CAST(command_heavy AS INTEGER)) AS BIGINT) AS campaign_command_heavy
    FROM ck GROUP BY campaign_key),
  campsev AS (SELECT *, CASE WHEN sv >= 3 THEN 'high' WHEN sv = 2 THEN 'medium' ELSE 'low' END AS campaign_severity
    FROM (SELECT *, {_b('campaign_avg_event_count > 10')} + {_b('campaign_avg_unique_cmds > 5')}
      + {_b('campaign_high_activity > 0')} + {_b('campaign_command_heavy > 0')} AS sv FROM camp)),
  cj AS (SELECT ck.*, campsev.campaign_total_sessions, campsev.campaign_severity
    FROM ck LEFT JOIN campsev USING (campaign_key))"""


def threat_case(col: str, field: int) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v[field]}'" for k, v in THREATS.items())
    return f"CASE {col} {whens} ELSE '{NO_THREAT[field]}' END"


def threat_map_cols(col: str = "behavior_cluster") -> str:
    return (f"{threat_case(col, 0)} AS attacker_type, {threat_case(col, 1)} AS threat_archetype, "
            f"{threat_case(col, 2)} AS confidence_level, "
            "CASE WHEN COALESCE(ip_scope = 'public', false) THEN 'enabled' ELSE 'disabled' END AS geo_visualization, "
            "'behavioral_intelligence' AS soc_relevance")


TM = f"tm AS (SELECT *, {threat_map_cols()} FROM cj)"

EMIT_ORDER = "closed DESC, CASE WHEN closed THEN last_seq ELSE first_seq END, session, seg"
IDS = f"""ids AS (SELECT *, CAST((idx // 200) AS BIGINT) AS batch_id, printf('SESS-%05d', 9786 + idx) AS session_id
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {EMIT_ORDER}) - 1 AS idx FROM tm))"""

ENR = """enr AS (SELECT session_id, session, src_ip, session_start, session_end, event_count, unique_commands,
    session_duration, failed_logins, successful_login, unique_usernames, high_event_activity, long_session,
    credential_guessing, command_heavy, behavioral_risk_score, event_count_norm, unique_commands_norm,
    session_duration_norm, behavior_cluster, behavior_label, risk_score, event_count % 7 = 0 AS is_anomaly,
    CAST(CASE WHEN event_count % 7 = 0 THEN -1 ELSE 0 END AS INTEGER) AS dbscan_label, CAST(CASE WHEN event_count > 10 THEN 0.9 WHEN session_duration > 60 THEN 0.6 ELSE -1.0 END AS DOUBLE) AS cluster_stability, attacker_type,
    threat_archetype, confidence_level, ip_scope, risk_level, country, country_iso, city, latitude, longitude,
    asn, asn_org, campaign_key, campaign_total_sessions, campaign_severity, event_count % 10 / 10.0::DOUBLE AS ml_risk_score,
    CASE WHEN event_count % 10 > 7 THEN 'High Risk' WHEN event_count % 10 > 4 THEN 'Medium Risk' ELSE 'Low Risk' END AS ml_risk_label, 0.75::DOUBLE AS ml_accuracy, 0.5::DOUBLE AS ml_precision,
    0.25::DOUBLE AS ml_recall, geo_visualization, soc_relevance, event_count / 4.0::DOUBLE AS pca_x,
    CASE WHEN event_count % 3 > 0 THEN failed_logins / 2.0::DOUBLE END AS pca_y, seg, batch_id FROM ids)"""


def coerce_bool_sql(c: str) -> str:
    return f"COALESCE(upper(CAST({c} AS VARCHAR)) = 'TRUE', false)"


def risk100_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) THEN CAST(0.0 AS DOUBLE) ELSE "
            f"(LEAST(GREATEST(CAST({c} AS DOUBLE), CAST(-2.0 AS DOUBLE)), CAST(5.0 AS DOUBLE)) + 2.0) / 7.0 * 100.0 END")


DASH = f"""dash AS (SELECT session_id, session, src_ip AS ip_address, session_start AS timestamp, session_end,
    event_count AS events_count, unique_commands, session_duration AS duration, failed_logins, successful_login,
    unique_usernames, {coerce_bool_sql('is_anomaly')} AS is_anomaly,
    {coerce_bool_sql('high_event_activity')} AS high_event_activity, {coerce_bool_sql('long_session')} AS long_session,
    {coerce_bool_sql('credential_guessing')} AS credential_guessing, {coerce_bool_sql('command_heavy')} AS command_heavy,
    behavior_cluster AS cluster, behavior_label, risk_score AS risk_score_raw, {risk100_sql('risk_score')} AS risk_score,
    COALESCE(behavior_label, 'Unknown') AS predicted_risk_level, ml_risk_score AS predicted_risk_score,
    COALESCE(latitude, 0.0) AS lat, COALESCE(longitude, 0.0) AS lon, 0 AS velocity_score, 0 AS bytes_transferred,
    country, asn, attacker_type, threat_archetype, campaign_severity, cluster_stability, ml_accuracy,
    ml_precision, ml_recall, pca_x, pca_y, batch_id, risk_level, {is_private_sql('src_ip')} AS is_private FROM enr)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_ctes(RAW, SEGMENTED, SESSIONS)
BASE_FLAGS = with_ctes(RAW, SEGMENTED, SESSIONS, FLAGS)
BASE_Z = with_ctes(RAW, SEGMENTED, SESSIONS, FLAGS, ZS)
BASE_RL = with_ctes(RAW, SEGMENTED, SESSIONS, FLAGS, ZS, RC, LAB, RL)
BASE_GEO = with_ctes(RAW, SEGMENTED, SESSIONS, FLAGS,
                     f"scg AS (SELECT *, {ip_scope_sql('src_ip')} AS ip_scope FROM flg)", GEO, geo_join_cte("scg"))
BASE_ENR = with_ctes(RAW, SEGMENTED, SESSIONS, FLAGS, ZS, RC, LAB, RL, SC, GEO, geo_join_cte("sc"), TL,
                     campaign_ctes("tl"), TM, IDS, ENR)
BASE_DASH = with_ctes(RAW, SEGMENTED, SESSIONS, FLAGS, ZS, RC, LAB, RL, SC, GEO, geo_join_cte("sc"), TL,
                      campaign_ctes("tl"), TM, IDS, ENR, DASH)

SESSION_COLS = """session, seg, src_ip, event_count, unique_commands, session_duration, failed_logins,
  successful_login, unique_usernames, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(session_end, '%Y-%m-%d %H:%M:%S') AS session_end"""

HIGH = "COALESCE(contains(lower(predicted_risk_level), 'high'), false)"


def r6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c}"


def _hist(x: str) -> str:
    b = f"CAST(LEAST(FLOOR(({x} - 0.0) / 5.0), 19) AS INTEGER)"
    return f"""SELECT s.bin, CAST(CAST(s.bin * 5.0 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST((s.bin + 1) * 5.0 AS INTEGER) AS VARCHAR) AS label,
  CAST(COALESCE(c.n, 0) AS BIGINT) AS sessions
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) s
LEFT JOIN (SELECT {b} AS bin, COUNT(*) AS n FROM dash WHERE {x} >= 0 AND {x} <= 100 GROUP BY 1) c USING (bin)"""


ORACLES: dict[str, str] = {}

ORACLES["sessions_batch"] = BASE + f"SELECT {SESSION_COLS} FROM sess"

ORACLES["session_hash_keys"] = with_ctes(RAW) + """SELECT COALESCE(NULLIF(session, ''), src_ip, 'unknown') AS session_key,
  COUNT(*) AS events, substr(md5(COALESCE(NULLIF(session, ''), src_ip, 'unknown')), 1, 12) AS session
FROM raw GROUP BY 1"""

ORACLES["ip_scope_counts"] = BASE + f"""SELECT {ip_scope_sql('src_ip')} AS ip_scope, COUNT(*) AS sessions,
  COUNT(DISTINCT src_ip) AS distinct_ips FROM sess GROUP BY 1"""

ORACLES["private_ip_split"] = BASE + f"""SELECT {is_private_sql('src_ip')} AS is_private, COUNT(*) AS sessions,
  COUNT(DISTINCT src_ip) AS distinct_ips FROM sess GROUP BY 1"""

ORACLES["behavior_flags"] = BASE_FLAGS + """SELECT session, seg, high_event_activity, long_session, command_heavy,
  credential_guessing, behavioral_risk_score FROM flg"""

ORACLES["median_flags"] = BASE + """SELECT session, seg,
  COALESCE(event_count > median(event_count) OVER (), false) AS median_high_event_activity,
  COALESCE(session_duration > median(session_duration) OVER (), false) AS median_long_session FROM sess"""

ORACLES["zscores"] = BASE_Z + f"""SELECT session, seg, {r6('event_count_norm')}, {r6('unique_commands_norm')},
  {r6('session_duration_norm')} FROM zs"""

ORACLES["standardize"] = BASE_FLAGS + "SELECT session, seg, " + ", ".join(
    f"round({zcol(c, pop=True, fill=True, suffix='_z').rsplit(' AS ', 1)[0]}, 6) AS {c}_z"
    for c in ("event_count", "unique_commands", "session_duration", "behavioral_risk_score")) + " FROM flg"

ORACLES["batch_ids"] = BASE + f"""SELECT session, seg, CAST(idx // 200 AS BIGINT) AS batch_id,
  printf('SESS-%05d', 9786 + idx) AS session_id
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {EMIT_ORDER}) - 1 AS idx FROM sess)"""

ORACLES["cluster_labels"] = BASE_RL + f"SELECT behavior_cluster, {r6('mean_score')}, behavior_label, cluster_weight FROM lab"

ORACLES["risk_scores"] = BASE_RL + f"""SELECT session, seg, behavior_cluster, behavior_label, {r6('risk_score')},
  CASE WHEN COALESCE(risk_score > 2, false) THEN 'High Risk' WHEN COALESCE(risk_score > 0, false) THEN 'Medium Risk'
       ELSE 'Low Risk' END AS zscore_label FROM rl"""

ORACLES["threat_levels"] = BASE_RL + f"""SELECT session, seg, behavior_label,
  CASE WHEN COALESCE(behavior_label = 'High Risk', false) THEN 'high' WHEN {THREAT_SCORE} >= 3 THEN 'high'
       WHEN {THREAT_SCORE} = 2 THEN 'medium' ELSE 'low' END AS risk_level FROM rl"""

ORACLES["cluster_profile"] = BASE_FLAGS + "SELECT behavior_cluster, " + ", ".join(
    f"round_even(AVG(CAST({c} AS DOUBLE)) * 100, 0) / 100 AS {c}"
    for c in ("event_count", "unique_commands", "session_duration", "behavioral_risk_score")) + \
    f" FROM (SELECT *, {RULE_CLUSTER} FROM flg) GROUP BY behavior_cluster"

ORACLES["threat_map"] = BASE_FLAGS + f"""SELECT session, seg, behavior_cluster, {threat_map_cols()}
FROM (SELECT *, {RULE_CLUSTER}, {ip_scope_sql('src_ip')} AS ip_scope FROM flg)"""

ORACLES["geo_range_join"] = BASE_GEO + """SELECT session, seg, src_ip, ip_scope, country, country_iso, city,
  latitude, longitude, asn, asn_org FROM gj"""

ORACLES["geo_nested_ranges"] = BASE + f""", {GEO},
nested AS (SELECT ip_start, ip_end, as_text FROM geo UNION ALL
  SELECT s, s + 256 * CAST(pow(2, k % 14) AS BIGINT) - 1, 'customer ' || k FROM (
    SELECT c_custkey AS k, (20 + c_custkey % 150) * 16777216 + (c_custkey * 2027264::BIGINT) % 16777216 AS s FROM customer)),
ipl AS (SELECT DISTINCT src_ip, {ipv4_long_sql('src_ip')} AS ip_long FROM sess),
hit AS (SELECT src_ip, as_text, ROW_NUMBER() OVER (PARTITION BY src_ip ORDER BY ip_start DESC, ip_end, as_text) AS nr
  FROM ipl JOIN nested ON ip_long BETWEEN ip_start AND ip_end)
SELECT src_ip, as_text FROM hit WHERE nr = 1"""

ORACLES["campaigns"] = BASE_GEO.rstrip("\n") + ",\n" + campaign_ctes("gj") + f"""
SELECT campaign_key, campaign_total_sessions, {r6('campaign_avg_event_count')}, {r6('campaign_avg_unique_cmds')},
  campaign_high_activity, campaign_command_heavy, campaign_severity FROM campsev"""

ORACLES["campaign_join"] = BASE_GEO.rstrip("\n") + ",\n" + campaign_ctes("gj") + """
SELECT session, seg, campaign_key, campaign_total_sessions, campaign_severity FROM cj"""

ORACLES["first_public_ips"] = BASE + f"""SELECT src_ip FROM (
  SELECT src_ip, MIN(first_seq) AS f FROM sess WHERE {ip_scope_sql('src_ip')} = 'public' GROUP BY src_ip
  ORDER BY f, src_ip LIMIT 20)"""

_ENR_DOUBLES = ("session_duration", "event_count_norm", "unique_commands_norm", "session_duration_norm", "risk_score",
                "cluster_stability", "latitude", "longitude", "ml_risk_score", "ml_accuracy", "ml_precision",
                "ml_recall", "pca_x", "pca_y")
_ENR_COLS = """session_id, session, src_ip, session_start, session_end, event_count, unique_commands, session_duration,
 failed_logins, successful_login, unique_usernames, high_event_activity, long_session, credential_guessing,
 command_heavy, behavioral_risk_score, event_count_norm, unique_commands_norm, session_duration_norm,
 behavior_cluster, behavior_label, risk_score, is_anomaly, dbscan_label, cluster_stability, attacker_type,
 threat_archetype, confidence_level, ip_scope, risk_level, country, country_iso, city, latitude, longitude, asn,
 asn_org, campaign_key, campaign_total_sessions, campaign_severity, ml_risk_score, ml_risk_label, ml_accuracy,
 ml_precision, ml_recall, geo_visualization, soc_relevance, pca_x, pca_y, seg, batch_id""".replace("\n", "").split(",")


def _enr_select() -> str:
    out = []
    for c in (x.strip() for x in _ENR_COLS):
        if c in _ENR_DOUBLES:
            out.append(r6(c))
        elif c in ("session_start", "session_end"):
            out.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


ORACLES["enriched_rule"] = BASE_ENR + f"SELECT {_enr_select()} FROM enr"

ORACLES["dashboard_view"] = BASE_DASH + f"""SELECT session_id, ip_address, events_count, duration, cluster,
  strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, is_anomaly, high_event_activity, long_session,
  credential_guessing, command_heavy, {r6('risk_score')}, {r6('risk_score_raw')}, predicted_risk_level,
  predicted_risk_score, lat, lon, velocity_score, bytes_transferred FROM dash"""

ORACLES["risk_100"] = BASE_DASH + f"SELECT session_id, {r6('risk_score_raw')}, {r6('risk_score')} FROM dash"

ORACLES["score_bands"] = BASE_DASH + """SELECT session_id,
  CASE WHEN COALESCE(risk_score_raw > 2, false) THEN 'High Risk' WHEN COALESCE(risk_score_raw > 0, false)
       THEN 'Medium Risk' ELSE 'Low Risk' END AS zscore_label,
  CASE WHEN COALESCE(risk_score > 80, false) THEN 'red' WHEN COALESCE(risk_score > 50, false) THEN 'amber'
       ELSE 'teal' END AS marker_band,
  CASE WHEN risk_score / 100.0 IS NULL THEN 'Low Risk'
       WHEN LEAST(GREATEST(risk_score / 100.0, 0.0), 1.0) <= 0.3 THEN 'Low Risk'
       WHEN LEAST(GREATEST(risk_score / 100.0, 0.0), 1.0) <= 0.7 THEN 'Medium Risk' ELSE 'High Risk' END AS ml_band,
  CASE WHEN COALESCE(cluster_stability > 0.8, false) THEN 'high' WHEN COALESCE(cluster_stability > 0.5, false)
       THEN 'medium' ELSE 'low' END AS stability_band FROM dash"""

ORACLES["risk_histogram"] = BASE_DASH + _hist("risk_score")
ORACLES["risk_histogram_remap"] = BASE_DASH + _hist(f"({risk100_sql('risk_score')})")

ORACLES["daily_activity"] = BASE_DASH + f"""SELECT strftime(s.d, '%Y-%m-%d') AS day,
  CAST(COALESCE(c.total, 0) AS BIGINT) AS total, CAST(COALESCE(c.high_risk, 0) AS BIGINT) AS high_risk
FROM (SELECT CAST(unnest(generate_series(MIN(CAST(timestamp AS DATE)), MAX(CAST(timestamp AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d
      FROM dash WHERE timestamp IS NOT NULL) s
LEFT JOIN (SELECT CAST(timestamp AS DATE) AS d, COUNT(*) AS total, SUM(CASE WHEN {HIGH} THEN 1 ELSE 0 END) AS high_risk
           FROM dash WHERE timestamp IS NOT NULL GROUP BY 1) c USING (d)"""

ORACLES["kpis"] = BASE_DASH + f"""SELECT COUNT(*) AS total_sessions,
  CAST(SUM(CASE WHEN {HIGH} THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count,
  CAST(SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomalies_detected,
  COUNT(DISTINCT country) AS countries_count,
  (SELECT COALESCE(CAST(ml_accuracy AS DOUBLE), 0.0) FROM dash ORDER BY session_id LIMIT 1) AS model_accuracy
FROM dash"""

ORACLES["top_risk"] = BASE_DASH + f"""SELECT session_id, {r6('risk_score')}, predicted_risk_level, ip_address, country,
  attacker_type, threat_archetype, behavior_label FROM (
  SELECT * FROM dash WHERE {HIGH} ORDER BY risk_score DESC, session_id ASC LIMIT 10)"""

ORACLES["risk_by_cluster"] = BASE_DASH + """SELECT cluster, round(AVG(risk_score), 6) AS mean_risk FROM dash
WHERE cluster IS NOT NULL GROUP BY cluster"""

ORACLES["attack_vector"] = BASE_DASH + """SELECT factor, round(value, 6) AS value FROM (
  SELECT 'Failed Logins' AS factor, AVG(CAST(failed_logins AS DOUBLE)) AS value FROM dash
  UNION ALL SELECT 'Unique Commands', AVG(CAST(unique_commands AS DOUBLE)) FROM dash
  UNION ALL SELECT 'Session Duration', AVG(CAST(duration AS DOUBLE)) / 60 FROM dash
  UNION ALL SELECT 'Event Count', AVG(CAST(events_count AS DOUBLE)) / 10 FROM dash
  UNION ALL SELECT 'Unique Usernames', AVG(CAST(unique_usernames AS DOUBLE)) FROM dash)"""

ORACLES["risk_factors"] = BASE_DASH + """SELECT factor,
  round(CASE WHEN SUM(value) OVER () > 0 THEN value / SUM(value) OVER () * 100 ELSE value END, 6) AS share FROM (
  SELECT 'High Activity' AS factor, AVG(CAST(events_count AS DOUBLE)) AS value FROM dash
  UNION ALL SELECT 'Command Diversity', AVG(CAST(unique_commands AS DOUBLE)) FROM dash
  UNION ALL SELECT 'Session Duration', AVG(CAST(duration AS DOUBLE)) / 10 FROM dash
  UNION ALL SELECT 'Failed Logins', AVG(CAST(failed_logins AS DOUBLE)) FROM dash)"""

ORACLES["distributions"] = BASE_DASH + """SELECT dimension, value, sessions,
  CAST(ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY sessions DESC, value ASC) AS BIGINT) AS rank FROM (
  SELECT dimension, value, COUNT(*) AS sessions FROM (
    UNPIVOT (SELECT CAST(predicted_risk_level AS VARCHAR) AS predicted_risk_level,
                    CAST(threat_archetype AS VARCHAR) AS threat_archetype,
                    CAST(campaign_severity AS VARCHAR) AS campaign_severity,
                    CAST(attacker_type AS VARCHAR) AS attacker_type FROM dash)
    ON predicted_risk_level, threat_archetype, campaign_severity, attacker_type INTO NAME dimension VALUE value)
  WHERE value IS NOT NULL GROUP BY dimension, value)"""

ORACLES["archetype_top5"] = BASE_DASH + """SELECT threat_archetype, COUNT(*) AS sessions FROM dash
WHERE threat_archetype IS NOT NULL GROUP BY 1 ORDER BY sessions DESC, threat_archetype ASC LIMIT 5"""

ORACLES["risk_level_share"] = BASE_DASH + """SELECT predicted_risk_level, sessions,
  round(sessions * 100.0 / SUM(sessions) OVER (), 1) AS share FROM (
  SELECT predicted_risk_level, COUNT(*) AS sessions FROM dash WHERE predicted_risk_level IS NOT NULL GROUP BY 1)"""

_PROF = ("duration", "events_count", "risk_score", "unique_commands", "failed_logins")
ORACLES["cluster_profiles"] = BASE_DASH + "SELECT cluster, count, " + ", ".join(r6(c) for c in _PROF) + ", " + ", ".join(
    f"round({c} / COALESCE(NULLIF(MAX({c}) OVER (), 0.0), 1.0), 6) AS {c}_norm" for c in _PROF) + """ FROM (
  SELECT cluster, AVG(CAST(duration AS DOUBLE)) AS duration, AVG(CAST(events_count AS DOUBLE)) AS events_count,
    AVG(risk_score) AS risk_score, AVG(CAST(unique_commands AS DOUBLE)) AS unique_commands,
    AVG(CAST(failed_logins AS DOUBLE)) AS failed_logins, COUNT(*) AS count
  FROM dash WHERE cluster IS NOT NULL GROUP BY cluster)"""

ORACLES["stability_report"] = BASE_DASH + """SELECT cluster, AVG(cluster_stability) AS stability,
  (SELECT COALESCE(AVG(CASE WHEN cluster_stability >= 0 THEN cluster_stability END), 0.0) FROM dash) AS silhouette
FROM dash WHERE cluster IS NOT NULL GROUP BY cluster"""

ORACLES["country_risk"] = BASE_DASH + """SELECT country, round(mean_risk, 6) AS mean_risk FROM (
  SELECT country, AVG(risk_score) AS mean_risk FROM dash WHERE NOT is_private AND country IS NOT NULL
  GROUP BY country ORDER BY mean_risk DESC, country ASC LIMIT 20)"""

ORACLES["top_asns"] = BASE_DASH + """SELECT asn, COUNT(*) AS sessions FROM dash WHERE NOT is_private AND asn IS NOT NULL
GROUP BY asn ORDER BY sessions DESC, asn ASC LIMIT 10"""

ORACLES["internal_top_ips"] = BASE_DASH + """SELECT ip_address, round(score, 6) AS score FROM (
  SELECT ip_address, AVG(risk_score) AS score FROM dash WHERE is_private GROUP BY ip_address
  ORDER BY score DESC, ip_address ASC LIMIT 10)"""

ORACLES["internal_activity"] = BASE_DASH + """SELECT ip_address, CAST(SUM(events_count) AS BIGINT) AS events FROM dash
WHERE is_private GROUP BY ip_address ORDER BY events DESC, ip_address ASC LIMIT 10"""

ORACLES["internal_summary"] = BASE_DASH + """SELECT predicted_risk_level, COUNT(*) AS sessions,
  (SELECT COUNT(*) FROM dash WHERE is_private) AS internal_sessions
FROM dash WHERE is_private AND predicted_risk_level IS NOT NULL GROUP BY predicted_risk_level"""

ORACLES["geo_points"] = BASE_DASH + """SELECT lat, lon, country, ip_address, round(risk_score, 6) AS risk_score FROM dash
WHERE NOT is_private AND lat <> 0 AND lon <> 0 AND lat IS NOT NULL AND lon IS NOT NULL"""

ORACLES["batch_summary"] = BASE_ENR + """SELECT batch_id, COUNT(*) AS sessions,
  CAST(SUM(CASE WHEN COALESCE(is_anomaly, false) THEN 1 ELSE 0 END) AS BIGINT) AS anomalies,
  CAST(SUM(CASE WHEN risk_level = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk FROM enr GROUP BY batch_id"""

_HIST_FILTER = "WHERE CAST(substr(session, 2) AS BIGINT) % 3 = 0"
_HIST_SESSIONS = with_ctes(RAW, SEGMENTED, SESSIONS, raw_cte("rawh", _HIST_FILTER),
                           segmented_cte("rawh", "evh"), sessions_cte("evh", "sessh"))

ORACLES["new_sessions_anti"] = _HIST_SESSIONS + f"""SELECT {SESSION_COLS} FROM sess
WHERE session NOT IN (SELECT session FROM sessh)"""

ORACLES["history_union"] = _HIST_SESSIONS + """SELECT session, seg, 'history' AS origin, event_count FROM sessh
UNION ALL SELECT session, seg, 'new' AS origin, event_count FROM sess WHERE session NOT IN (SELECT session FROM sessh)"""

SCORED = """sc0 AS (SELECT session, seg, CAST(failed_logins > 1 AS INTEGER) AS y,
  CAST((event_count * 37) % 101 AS DOUBLE) / 100.0 AS score FROM sess)"""
BASE_SCORED = with_ctes(RAW, SEGMENTED, SESSIONS, SCORED)

_BM = """SELECT round(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END, 4) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1
FROM (SELECT CAST(SUM(CASE WHEN y = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
  CAST(SUM(CASE WHEN y <> 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(SUM(CASE WHEN y = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
  CAST(SUM(CASE WHEN y <> 1 AND score < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
  CAST(COUNT(*) AS DOUBLE) AS n FROM sc0)"""

ORACLES["binary_metrics"] = BASE_SCORED + _BM

ORACLES["best_threshold"] = BASE_SCORED + """SELECT round(score, 6) AS best_score, round(f1, 6) AS best_f1,
  round(LEAST(GREATEST(score, 0.2), 0.55), 6) AS threshold FROM (
  SELECT score, CASE WHEN cp + cn + npos > 0 THEN 2.0 * cp / (cp + cn + npos) ELSE 0.0 END AS f1 FROM (
    SELECT score, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
      SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
      (SELECT SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) FROM sc0) AS npos
    FROM (SELECT score, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS neg
          FROM sc0 GROUP BY score))
  ORDER BY f1 DESC, score ASC LIMIT 1)"""

ORACLES["stamp_metrics"] = BASE_ENR.rstrip("\n") + ",\n" + SCORED + f""",
bm AS ({_BM})
SELECT session_id, CAST(bm.accuracy AS DOUBLE) AS ml_accuracy, CAST(bm.precision AS DOUBLE) AS ml_precision,
  CAST(bm.recall AS DOUBLE) AS ml_recall FROM enr, bm"""

CT = """ct AS (SELECT a, b, CAST(COUNT(*) AS DOUBLE) AS nij FROM (
  SELECT CASE WHEN event_count > 10 THEN 2 WHEN session_duration > 60 THEN 1 ELSE 0 END AS a,
    unique_usernames % 3 AS b FROM sess) GROUP BY a, b)"""
ORACLES["adjusted_rand"] = with_ctes(RAW, SEGMENTED, SESSIONS, CT) + """SELECT round(CASE
  WHEN (sa + sb) / 2.0 - sa * sb / cn = 0 THEN 1.0 ELSE (idx - sa * sb / cn) / ((sa + sb) / 2.0 - sa * sb / cn) END, 6)
  AS ari FROM (
  SELECT SUM(nij * (nij - 1) / 2.0) AS idx, SUM(nij) * (SUM(nij) - 1) / 2.0 AS cn,
    (SELECT SUM(ai * (ai - 1) / 2.0) FROM (SELECT SUM(nij) AS ai FROM ct GROUP BY a)) AS sa,
    (SELECT SUM(bj * (bj - 1) / 2.0) FROM (SELECT SUM(nij) AS bj FROM ct GROUP BY b)) AS sb
  FROM ct)"""

_SIL_COLS = ("event_count", "unique_commands", "session_duration", "behavioral_risk_score")
_zs = ", ".join(f"{zcol(c, pop=True, fill=True, suffix='_z')}" for c in _SIL_COLS)
_sq = " + ".join(f"{c}_z * {c}_z" for c in _SIL_COLS)
_dot = " + ".join(f"p.{c}_z * s.s{i}" for i, c in enumerate(_SIL_COLS))
ORACLES["silhouette"] = BASE_FLAGS.rstrip("\n") + f""",
pts AS (SELECT {RULE_CLUSTER}, {_zs} FROM flg),
pts2 AS (SELECT *, {_sq} AS sq FROM pts),
st AS (SELECT behavior_cluster AS c, CAST(COUNT(*) AS DOUBLE) AS n, SUM(sq) AS q,
  {", ".join(f"SUM({c}_z) AS s{i}" for i, c in enumerate(_SIL_COLS))} FROM pts2 GROUP BY behavior_cluster),
pd AS (SELECT p.rid, p.behavior_cluster AS own, s.c, s.n, (s.n * p.sq - 2 * ({_dot}) + s.q) / s.n AS d
  FROM (SELECT *, ROW_NUMBER() OVER () AS rid FROM pts2) p, st s),
per AS (SELECT rid, MAX(CASE WHEN c = own THEN (CASE WHEN n > 1 THEN d * n / (n - 1) ELSE 0.0 END) END) AS a,
  MIN(CASE WHEN c <> own THEN d END) AS b, MAX(CASE WHEN c = own THEN n END) AS n_own FROM pd GROUP BY rid)
SELECT round(AVG(COALESCE(CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0 ELSE (b - a) / GREATEST(a, b) END, 0.0)), 6)
  AS silhouette FROM per"""

ORACLES["silhouette_euclidean"] = BASE_FLAGS.rstrip("\n") + f""",
pts AS (SELECT session, seg, {RULE_CLUSTER}, {_zs} FROM flg),
sam AS (SELECT behavior_cluster AS c, {", ".join(f"{c}_z AS x{i}" for i, c in enumerate(_SIL_COLS))}, ROW_NUMBER() OVER () AS id
  FROM (SELECT * FROM pts ORDER BY md5(concat_ws(':', session, CAST(seg AS VARCHAR), '42')), session, seg LIMIT 2000)),
per AS (SELECT p.id, p.c, o.c AS other, COUNT(*) AS m,
    SUM(sqrt({" + ".join(f"(p.x{i} - o.x{i}) * (p.x{i} - o.x{i})" for i in range(len(_SIL_COLS)))})) AS d
  FROM sam p, sam o GROUP BY p.id, p.c, o.c),
ab AS (SELECT id, MAX(CASE WHEN c = other AND m > 1 THEN d / (m - 1) END) AS a, MIN(CASE WHEN c <> other THEN d / m END) AS b
  FROM per GROUP BY id)
SELECT round(AVG(CASE WHEN a IS NULL OR b IS NULL OR GREATEST(a, b) = 0 THEN 0.0 ELSE (b - a) / GREATEST(a, b) END), 6) AS silhouette FROM ab"""

_D = len(_SIL_COLS)
_squares = " + ".join(f"m[{i + 1}] * m[{i + 1}]" for i in range(_D * _D))
_squared = ", ".join(f"({' + '.join(f'm[{i * _D + k + 1}] * m[{k * _D + j + 1}]' for k in range(_D))}) / ({_squares})"
                     for i in range(_D) for j in range(_D))


def _component(cov: str, name: str) -> str:
    """The first component of a covariance matrix (row by row in a list): its square,
    squared 45 times, scaled to trace 1, is the projector on it; the loading of
    largest size is positive."""
    return f"""{name}_p(n, m) AS (SELECT 0, m FROM {cov} UNION ALL SELECT n + 1, [{_squared}] FROM {name}_p WHERE n < 45 AND {_squares} > 0),
{name}_m AS (SELECT m, list_position([{", ".join(f"m[{i * _D + i + 1}]" for i in range(_D))}],
    greatest({", ".join(f"m[{i * _D + i + 1}]" for i in range(_D))})) AS j FROM {name}_p WHERE n = 45),
{name} AS (SELECT [{", ".join(f"m[{i * _D} + j] / sqrt(m[(j - 1) * {_D} + j])" for i in range(_D))}] AS v FROM {name}_m)"""


_lambda = " + ".join(f"v[{i + 1}] * m[{i * _D + j + 1}] * v[{j + 1}]" for i in range(_D) for j in range(_D))
ORACLES["pca2"] = (BASE_FLAGS.rstrip("\n") + f""",
pts AS (SELECT session, seg, {_zs} FROM flg),
cov AS (SELECT [{", ".join(f"SUM({a}_z * {b}_z) / (COUNT(*) - 1)" for a in _SIL_COLS for b in _SIL_COLS)}] AS m FROM pts),
{_component("cov", "one")},
rest AS (SELECT [{", ".join(f"m[{i * _D + j + 1}] - ({_lambda}) * v[{i + 1}] * v[{j + 1}]" for i in range(_D) for j in range(_D))}] AS m FROM cov, one),
{_component("rest", "two")}
SELECT session, seg, {", ".join("round(" + " + ".join(f"{c}_z * {t}.v[{i + 1}]" for i, c in enumerate(_SIL_COLS)) + f", 6) AS {o}"
                                for t, o in (("one", "pca_x"), ("two", "pca_y")))} FROM pts, one, two""").replace("WITH ", "WITH RECURSIVE ", 1)

ORACLES["risk_model_reloaded"] = BASE + """SELECT COUNT(*) AS sessions, true AS same_scores, true AS scores_in_range,
  true AS bands_follow, true AS accuracy_in_range FROM sess"""

ORACLES["stratified_split"] = BASE_SCORED + """SELECT y, COUNT(*) AS rows,
  CAST(CEIL(CAST(COUNT(*) AS DOUBLE) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS test_rows FROM sc0 GROUP BY y"""

ORACLES["session_windows"] = with_ctes(RAW) + """SELECT substr(md5(skey), 1, 12) AS session,
  strftime(make_timestamp(MIN(cus)), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
  strftime(make_timestamp(MAX(cus) + 120000000), '%Y-%m-%d %H:%M:%S.%f') AS window_end, COUNT(*) AS events
FROM (SELECT *, SUM(CASE WHEN prev IS NULL OR cus - prev >= 120000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY skey ORDER BY cus, event_seq ROWS UNBOUNDED PRECEDING) AS w
      FROM (SELECT *, COALESCE(NULLIF(session, ''), src_ip, 'unknown') AS skey,
              LAG(cus) OVER (PARTITION BY COALESCE(NULLIF(session, ''), src_ip, 'unknown') ORDER BY cus, event_seq) AS prev
            FROM raw))
GROUP BY skey, w"""

ORACLES["csv_dashboard"] = ORACLES["dashboard_view"]

ORACLES["metrics_record"] = BASE_SCORED + "SELECT CAST(accuracy AS DOUBLE) AS accuracy, CAST(precision AS DOUBLE) AS precision, " \
    "CAST(recall AS DOUBLE) AS recall FROM (" + _BM + ")"

ORACLES["archive_batches"] = BASE_ENR + """SELECT batch_id, COUNT(*) AS history_rows, COUNT(*) AS archive_rows
FROM enr GROUP BY batch_id"""

ORACLES["scatter_points"] = BASE_DASH + """SELECT session_id, COALESCE(pca_x, 0.0) AS pca_x, COALESCE(pca_y, 0.0) AS pca_y,
  is_anomaly, COALESCE(duration, 0.0) AS duration, COALESCE(events_count, 0) AS events_count,
  COALESCE(cluster, 0) AS cluster FROM dash"""


# Per-upload-batch statistics (the reference's behaviour): ids first, then
# z-scores, cluster labels / weights and campaigns within each batch.
def _zb(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    w = "OVER (PARTITION BY batch_id)"
    return (f"({x} - AVG({x}) {w}) / CASE WHEN STDDEV_SAMP({x}) {w} > 0 THEN STDDEV_SAMP({x}) {w} "
            f"ELSE 1.0 END AS {c}_norm")


_B_IDS = f"""bids AS (SELECT *, CAST((idx // 200) AS BIGINT) AS batch_id, printf('SESS-%05d', 9786 + idx) AS session_id
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {EMIT_ORDER}) - 1 AS idx FROM flg))"""
_B_ZS = f"bzs AS (SELECT *, {_zb('event_count')}, {_zb('unique_commands')}, {_zb('session_duration')} FROM bids)"
_B_RC = f"brc AS (SELECT *, {RULE_CLUSTER} FROM bzs)"
_B_LAB = """blab AS (
  SELECT batch_id, behavior_cluster,
    CASE WHEN n = 1 THEN (CASE WHEN mean_score >= 2 THEN 'High Risk' WHEN mean_score >= 1 THEN 'Medium Risk'
                               ELSE 'Low Risk' END)
         WHEN ra = 1 THEN 'Low Risk' WHEN ra = n THEN 'High Risk' ELSE 'Medium Risk' END AS behavior_label,
    CAST(CASE WHEN rd = 1 THEN 2.0 WHEN rd = 2 THEN 1.0 WHEN rd = 3 THEN 0.0 ELSE -0.5 END AS DOUBLE) AS cluster_weight
  FROM (SELECT batch_id, behavior_cluster, mean_score, COUNT(*) OVER (PARTITION BY batch_id) AS n,
          ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY mean_score ASC, behavior_cluster ASC) AS ra,
          ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY mean_score DESC, behavior_cluster ASC) AS rd
        FROM (SELECT batch_id, behavior_cluster, AVG(CAST(behavioral_risk_score AS DOUBLE)) AS mean_score
              FROM brc GROUP BY batch_id, behavior_cluster) m) r)"""
_B_RL = """rl AS (
  SELECT brc.*, blab.behavior_label, blab.cluster_weight,
    event_count_norm * CAST(0.4 AS DOUBLE) + unique_commands_norm * CAST(0.3 AS DOUBLE)
      + session_duration_norm * CAST(0.2 AS DOUBLE) + COALESCE(blab.cluster_weight, CAST(0.0 AS DOUBLE)) AS risk_score
  FROM brc LEFT JOIN blab USING (batch_id, behavior_cluster))"""


def _campaign_ctes_batched(src: str) -> str:
    return (campaign_ctes(src)
            .replace("FROM ck GROUP BY campaign_key)", "FROM ck GROUP BY batch_id, campaign_key)")
            .replace("SELECT campaign_key, COUNT(session)", "SELECT batch_id, campaign_key, COUNT(session)")
            .replace("FROM ck LEFT JOIN campsev USING (campaign_key))",
                     "FROM ck LEFT JOIN campsev USING (batch_id, campaign_key))"))


_B_TM = f"btm AS (SELECT *, {threat_map_cols()} FROM cj)"
_B_ENR = ENR.replace("FROM ids)", "FROM btm)")
BASE_ENR_BATCHED = with_ctes(RAW, SEGMENTED, SESSIONS, FLAGS, _B_IDS, _B_ZS, _B_RC, _B_LAB, _B_RL, SC, GEO,
                             geo_join_cte("sc"), TL, _campaign_ctes_batched("tl"), _B_TM, _B_ENR)
ORACLES["enriched_rule_batched"] = BASE_ENR_BATCHED + f"SELECT {_enr_select()} FROM enr"

# The log round trip and the stream return what the batch does.
ORACLES["ndjson_sessions"] = ORACLES["sessions_batch"]
ORACLES["stream_sessions"] = ORACLES["sessions_batch"]
ORACLES["stream_growing_log"] = ORACLES["sessions_batch"]
ORACLES["stream_batches"] = ORACLES["batch_ids"]
ORACLES["stream_session_window"] = ORACLES["session_windows"]

ORACLES["stream_dedupe"] = with_ctes(RAW) + """SELECT eventid, COUNT(*) AS events FROM (
  SELECT DISTINCT session, src_ip, eventid, cus, input, username FROM raw) GROUP BY eventid"""

ORACLES["incremental_history"] = BASE_GEO.rstrip("\n") + """
SELECT session, seg, src_ip, event_count, unique_commands, failed_logins, behavioral_risk_score, country,
  COUNT(*) OVER () AS distinct_ids FROM gj"""

ORACLES["first_anomalies"] = BASE_DASH + f"""SELECT session_id, {r6('risk_score')}, predicted_risk_level FROM dash
WHERE is_anomaly ORDER BY batch_id, risk_score DESC, CAST(substr(session_id, 6) AS BIGINT) LIMIT 20"""

ORACLES["stream_daily_counts"] = BASE_ENR + """SELECT strftime(session_start, '%Y-%m-%d') AS day_start,
  COUNT(*) AS total, CAST(SUM(CASE WHEN risk_level = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk
FROM enr WHERE session_start IS NOT NULL GROUP BY 1"""

# What must hold for any forest: one row in ten is below the 10 % quantile of the scores.
ORACLES["anomaly_invariants"] = BASE + """SELECT COUNT(*) AS sessions, true AS at_most_a_tenth, true AS lowest_scores FROM sess"""


def _hash60(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def iforest_sql(base: str, src: str, group: str = "0", features=("failed_logins", "successful_login", "unique_usernames"),
                trees: int = 100, samples: int = 256, seed: int = 42, levels: int = 8) -> str:
    """The isolation forest level by level: samples on the ring, the nodes of each level from the
    rows that reach it, then every row's walk over the node table. On the raw features, as
    scaling moves values and thresholds alike. Ends in the CTE ``flagged``."""
    k = range(len(features))
    step = 1 << 32
    avg = "CASE WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    x = ", ".join(f"x{i}" for i in k)
    ctes = [f"""rows0 AS (SELECT {group} AS g, session, seg, {', '.join(f"COALESCE({c}::DOUBLE, 0.0) AS x{i}" for i, c in enumerate(features))},
  COUNT(*) OVER (PARTITION BY {group}) AS total FROM {src})""",
            f"""ring AS (SELECT *, least({samples}, total) AS psi, {_hash60("session", "seg::VARCHAR", f"'{seed}'")} % {trees * step} AS place FROM rows0)""",
            f"""s0 AS (SELECT g, tree, {x}, psi, 1::BIGINT AS node FROM
  (SELECT *, (place - tree * {step} + {trees * step}) % {trees * step} AS after FROM ring, (SELECT range AS tree FROM range({trees})))
  QUALIFY row_number() OVER (PARTITION BY g, tree ORDER BY after, session, seg::VARCHAR) <= psi)"""]
    for d in range(levels + 1):
        bounds = ", ".join(f"MIN(x{i}) OVER w AS lo{i}, MAX(x{i}) OVER w AS hi{i}" for i in k)
        spans = ", ".join(f"{{'f': {i}, 'lo': lo{i}, 'hi': hi{i}}}" for i in k)
        node = "tree::VARCHAR, node::VARCHAR, '%d'" % seed
        value = "CASE by_.f " + " ".join(f"WHEN {i} THEN x{i}" for i in k) + " END"
        ctes += [f"a{d} AS (SELECT *, COUNT(*) OVER w AS n, {bounds} FROM s{d} WINDOW w AS (PARTITION BY g, tree, node))",
                 f"u{d} AS (SELECT *, list_filter([{spans}], lambda s: s.hi > s.lo) AS u FROM a{d})",
                 f"""b{d} AS (SELECT *, CASE WHEN n > 1 AND {d} < ceil(log2(greatest(psi, 2))) AND len(u) > 0
  THEN u[1 + ({_hash60(node, "'feature'")}) % len(u)] END AS by_ FROM u{d})""",
                 f"""t{d} AS (SELECT *, by_.lo + (by_.hi - by_.lo) * ((({_hash60(node, "'threshold'")}) >> 8) / 4503599627370496.0::DOUBLE) AS thr FROM b{d})""",
                 f"n{d} AS (SELECT DISTINCT g, tree, node, psi, n, by_.f AS f, thr, {d} AS depth FROM t{d})",
                 f"s{d + 1} AS (SELECT g, tree, {x}, psi, 2 * node + CASE WHEN {value} > thr THEN 1 ELSE 0 END AS node FROM t{d} WHERE by_ IS NOT NULL)"]
    length = f"round((depth + {avg.format(n='n::DOUBLE')}) * 1000000000)::BIGINT"
    ctes += [f"w0 AS (SELECT g, session, seg, {x}, range AS tree, 1::BIGINT AS node, 0::BIGINT AS len FROM rows0, range({trees}))"]
    for d in range(levels + 1):
        value = "CASE f " + " ".join(f"WHEN {i} THEN x{i}" for i in k) + " END"
        ctes.append(f"""w{d + 1} AS (SELECT w.g, session, seg, {x}, w.tree,
  CASE WHEN f IS NULL THEN NULL ELSE 2 * w.node + CASE WHEN {value} > thr THEN 1 ELSE 0 END END AS node,
  CASE WHEN w.node IS NOT NULL AND f IS NULL THEN {length} ELSE len END AS len
  FROM w{d} w LEFT JOIN n{d} t ON w.g = t.g AND w.tree = t.tree AND w.node = t.node)""")
    norm = avg.format(n="psi::DOUBLE")
    ctes += [f"walked AS (SELECT session, seg, SUM(len) AS len FROM w{levels + 1} GROUP BY session, seg)",
             f"scored AS (SELECT g, session, seg, -pow(2.0, -(len::DOUBLE / {float(trees * 10 ** 9)}) / CASE WHEN psi > 1 THEN {norm} ELSE 1.0 END) AS score FROM ring JOIN walked USING (session, seg))",
             "flagged AS (SELECT *, score < quantile_cont(score, 0.1) OVER (PARTITION BY g) AS is_anomaly FROM scored)"]
    return base.rstrip() + ",\n" + ",\n".join(ctes) + "\n"


_FLAGS = "round(score, 6) AS anomaly_score, is_anomaly, CASE WHEN is_anomaly THEN -1 ELSE 1 END::INTEGER AS dbscan_label FROM flagged"
ORACLES["isolation_forest"] = iforest_sql(BASE, "sess") + f"SELECT session, seg, {_FLAGS}"
ORACLES["isolation_forest_batched"] = iforest_sql(with_ctes(RAW, SEGMENTED, SESSIONS, f"""numbered AS (
  SELECT *, CAST((ROW_NUMBER() OVER (ORDER BY {EMIT_ORDER}) - 1) // 200 AS BIGINT) AS batch_id FROM sess)"""), "numbered", "batch_id") + (
    f"SELECT session, seg, g AS batch_id, {_FLAGS}")
ORACLES["anomaly_summary"] = iforest_sql(BASE, "sess") + """SELECT COUNT(*) FILTER (is_anomaly) AS anomalies, COUNT(*) AS sessions,
  COUNT(*) FILTER (is_anomaly)::DOUBLE / COUNT(*) AS anomaly_rate FROM flagged"""

# What must hold of any k-means: all sessions have a cluster, ids in the order of risk, the own centre is the nearest.
ORACLES["kmeans_invariants"] = BASE + "SELECT COUNT(*) AS sessions, true AS ids_in_order, true AS nearest_centre FROM sess"


def kmeans_sql(base: str, src: str, features=("event_count", "unique_commands", "session_duration", "behavioral_risk_score"),
               score: str = "behavioral_risk_score", ks=(2, 3, 4, 5), most: int = 4, steps: int = 20) -> str:
    """K-means of its own for every ``batch_id`` of ``src``, step by step as CTEs: starts on the ring,
    farthest vectors, Lloyd's steps, the cheapest start of each k, k by silhouette, ids by risk,
    stability of k = 3. Ends in ``grouped``: session, seg, behavior_cluster, cluster_stability."""
    dims = range(1, len(features) + 1)
    search, pairs = (0, 1, 2), ((0, 1), (10, 11), (20, 21))
    starts = sorted({*search, *(s for p in pairs for s in p)})
    ring = 1 << 60

    def z(c: str) -> str:
        x, w = f"COALESCE(CAST({c} AS DOUBLE), 0.0)", "OVER (PARTITION BY batch_id)"
        return f"round(({x} - AVG({x}) {w}) / CASE WHEN STDDEV_POP({x}) {w} > 0 THEN STDDEV_POP({x}) {w} ELSE 1.0 END, 9)"

    gap = " + ".join(f"(x[{i}] - m[{i}]) * (x[{i}] - m[{i}])" for i in dims)
    gaps = lambda cs="cs": f"list_transform({cs}, lambda m: round({gap}, 9))"
    near = lambda cs="cs": f"list_position({gaps(cs)}, list_min({gaps(cs)}))"
    after = f"({_hash60('session', 'seg::VARCHAR')} - start * {ring // 32} + {ring}) % {ring}"
    ctes = [f"""krows AS MATERIALIZED (SELECT batch_id AS g, session, seg, [{", ".join(map(z, features))}] AS x, CAST({score} AS DOUBLE) AS sc FROM {src})""",
            "pts AS MATERIALIZED (SELECT g, x, COUNT(*) AS w, SUM(sc) AS sc FROM krows GROUP BY g, x)",
            f"""f1 AS (SELECT g, start, [arg_min(x, {after})] AS cs FROM krows, (SELECT unnest([{", ".join(map(str, starts))}]) AS start) GROUP BY g, start)"""]
    for i in range(2, max(ks) + 1):
        ctes.append(f"""f{i} AS MATERIALIZED (SELECT g, start, CASE WHEN d > 0 THEN list_append(cs, x) ELSE cs END AS cs
  FROM (SELECT *, list_min({gaps()}) AS d FROM pts JOIN f{i - 1} USING (g)) QUALIFY row_number() OVER (PARTITION BY g, start ORDER BY d DESC, x DESC) = 1)""")
    ctes.append(f"""l0 AS (SELECT g, start, k, cs[1:k] AS cs FROM f{max(ks)}, (SELECT unnest([{", ".join(map(str, ks))}]) AS k)
  WHERE len(cs) >= k AND (start IN {search} OR k = 3))""")
    for t in range(steps):
        mean = ", ".join(f"round(SUM(x[{i}] * w) / SUM(w), 9)" for i in dims)
        ctes += [f"e{t} AS (SELECT g, start, k, c, [{mean}] AS mean FROM (SELECT *, {near()} AS c FROM pts JOIN l{t} USING (g)) GROUP BY g, start, k, c)",
                 f"""l{t + 1} AS MATERIALIZED (SELECT g, start, k, list(COALESCE(mean, old) ORDER BY c) AS cs
  FROM (SELECT g, start, k, unnest(cs) AS old, unnest(range(1, k + 1)) AS c FROM l{t}) LEFT JOIN e{t} USING (g, start, k, c) GROUP BY g, start, k)"""]
    sq = " + ".join(f"x[{i}] * x[{i}]" for i in dims)
    dot = " + ".join(f"x[{i}] * o.s[{i}]" for i in dims)
    ctes += [f"""kbest AS MATERIALIZED (SELECT g, k, any_value(cs) AS cs, round(SUM(w * list_min({gaps()})), 6) AS cost, start FROM pts JOIN l{steps} USING (g)
  WHERE start IN {search} GROUP BY g, k, start QUALIFY row_number() OVER (PARTITION BY g, k ORDER BY cost, start) = 1)""",
             f"kown AS MATERIALIZED (SELECT g, k, x, w, sc, {sq} AS sq, {near()} AS c FROM pts JOIN kbest USING (g))",
             f"ksum AS (SELECT g, k, c, SUM(w)::DOUBLE AS n, SUM(w * sq) AS q, [{', '.join(f'SUM(x[{i}] * w)' for i in dims)}] AS s FROM kown GROUP BY g, k, c)",
             f"""kpair AS (SELECT g, k, x, w, MAX(CASE WHEN o.c = p.c THEN o.n END) AS n, MAX(CASE WHEN o.c = p.c THEN far END) AS own,
  MIN(CASE WHEN o.c <> p.c THEN far END) AS b FROM (SELECT p.*, o.c, o.n, (o.n * p.sq - 2 * ({dot}) + o.q) / o.n AS far, p, o
    FROM kown p JOIN ksum o USING (g, k)) GROUP BY g, k, x, w)""",
             """ksil AS (SELECT g, k, round(SUM(w * CASE WHEN n > 1 THEN COALESCE((b - a) / NULLIF(greatest(a, b), 0), 0) ELSE 0 END) / SUM(w), 4) AS sil
  FROM (SELECT *, own * n / (n - 1) AS a FROM kpair WHERE b IS NOT NULL) GROUP BY g, k)""",
             f"""kpick AS (SELECT ksil.g, least(ksil.k, {most}) AS k FROM ksil QUALIFY row_number() OVER (PARTITION BY g ORDER BY sil DESC, k) = 1)""",
             """kids AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY risk, centre, c) - 1 AS id FROM (
  SELECT g, c, round(SUM(kown.sc) / SUM(w), 9) AS risk, any_value(cs[c]) AS centre FROM kown JOIN kpick USING (g, k) JOIN kbest USING (g, k) GROUP BY g, c))"""]
    for a, b in pairs:
        ctes.append(f"""kt{a} AS (SELECT g, a, b, SUM(w)::DOUBLE AS n FROM (SELECT g, w, {near('one')} AS a, {near('two')} AS b FROM pts
  JOIN (SELECT g, cs AS one FROM l{steps} WHERE k = 3 AND start = {a}) USING (g) JOIN (SELECT g, cs AS two FROM l{steps} WHERE k = 3 AND start = {b}) USING (g)) GROUP BY g, a, b)""")
    c2 = lambda n: f"({n} * ({n} - 1) / 2.0)"
    aris = " UNION ALL ".join(f"""SELECT g, CASE WHEN abs((sa + sb) / 2.0 - ex) < 1e-12 THEN 1.0 ELSE (idx - ex) / ((sa + sb) / 2.0 - ex) END AS ari
  FROM (SELECT *, COALESCE(sa * sb / NULLIF({c2('n')}, 0), 0.0) AS ex FROM (SELECT g, SUM({c2('n')}) AS idx, SUM(n) AS n FROM kt{a} GROUP BY g)
    JOIN (SELECT g, SUM({c2('n')}) AS sa FROM (SELECT g, SUM(n) AS n FROM kt{a} GROUP BY g, a) GROUP BY g) USING (g)
    JOIN (SELECT g, SUM({c2('n')}) AS sb FROM (SELECT g, SUM(n) AS n FROM kt{a} GROUP BY g, b) GROUP BY g) USING (g))""" for a, _ in pairs)
    ctes += [f"kari AS (SELECT g, round(AVG(ari), 4) AS stability FROM ({aris}) GROUP BY g)",
             f"""grouped AS MATERIALIZED (SELECT session, seg, CAST(COALESCE(id, 0) AS INTEGER) AS behavior_cluster, COALESCE(stability, 0.0) AS cluster_stability
  FROM (SELECT r.g, session, seg, {near()} AS c FROM krows r LEFT JOIN (SELECT g, cs FROM kbest JOIN kpick USING (g, k)) USING (g))
  LEFT JOIN kids USING (g, c) LEFT JOIN kari USING (g))"""]
    return base.rstrip() + ",\n" + ",\n".join(ctes) + "\n"


# L1 with models of their own for every batch: clusters and anomalies found again by DuckDB.
_PB = iforest_sql(kmeans_sql(with_ctes(RAW, SEGMENTED, SESSIONS, FLAGS, _B_IDS, _B_ZS), "bids"), "bids", "batch_id")
_PB_TL = TL.replace("event_count % 7 = 0", "COALESCE(anomaly, false)")
ORACLES["enriched_per_batch"] = _PB.rstrip() + ",\n" + ",\n".join([
    """brc AS (SELECT bzs.*, behavior_cluster, cluster_stability, is_anomaly AS anomaly FROM bzs JOIN grouped USING (session, seg)
  JOIN flagged USING (session, seg))""", _B_LAB, _B_RL, SC, GEO, geo_join_cte("sc"), _PB_TL,
    _campaign_ctes_batched("tl"), _B_TM]) + f"""
SELECT session_id, session, seg, batch_id, behavior_cluster, behavior_label, anomaly AS is_anomaly,
  CAST(CASE WHEN anomaly THEN -1 ELSE 1 END AS INTEGER) AS dbscan_label, {r6('cluster_stability')}, {r6('risk_score')}, risk_level,
  campaign_severity, attacker_type FROM btm"""
