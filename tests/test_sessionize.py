"""Sessionization against an independent brute-force model, on a fixture with every bad-row kind from FIXTURES.md."""
import hashlib
import json
import os
from datetime import datetime, timezone

from pyspark.sql import Window, functions as F

from tarpit.operators.sessionize import sessionize
from tarpit.sources.events import read_events

LINES = [
    '{"session": "a", "src_ip": "1.2.3.4", "eventid": "cowrie.session.connect", "timestamp": "2024-01-01T00:00:00Z"}',
    '',
    '   ',
    '{"session": "a", "src_ip": "1.2.3.4", "eventid": "cowrie.login.failed", "username": "root", "timestamp": "2024-01-01T00:00:10Z"}',
    '{"session": "a", "eventid": "cowrie.login.failed", "username": "admin", "timestamp": "2024-01-01T00:00:20Z"',
    '{"session": "a", "src_ip": "1.2.3.4", "eventid": "cowrie.command.input", "input": "ls", "timestamp": "2024-01-01T00:00:30Z"}',
    '{"session": "a", "src_ip": "1.2.3.4", "eventid": "cowrie.command.input", "input": "  ", "timestamp": "2024-01-01T00:00:31Z"}',
    '{"session": "a", "src_ip": "1.2.3.4", "eventid": "cowrie.client.kex", "kexAlgs": ["x", "y"], "timestamp": "bad-time"}',
    '{"session": "a", "src_ip": "1.2.3.4", "eventid": "cowrie.session.closed", "timestamp": "2024-01-01T00:01:40Z"}',
    '{"session": "a", "src_ip": "1.2.3.4", "eventid": "cowrie.command.input", "input": "ls", "timestamp": "2024-01-01T00:02:00Z"}',
    '{"src_ip": "5.6.7.8", "eventid": "cowrie.session.connect", "timestamp": "2024-01-01T00:00:05Z"}',
    '{"session": "", "src_ip": "5.6.7.8", "eventid": "cowrie.login.success", "username": "pi", "timestamp": "2024-01-01T00:00:05Z"}',
    '{"eventid": "cowrie.session.connect", "timestamp": "2024-01-01T00:00:07Z"}',
    '{"session": "b", "src_ip": "9.9.9.9", "eventid": "cowrie.session.connect", "timestamp": "not-a-time"}',
    '{"session": "b", "src_ip": "9.9.9.9", "eventid": "cowrie.session.closed"}',
    '{"session": "c", "src_ip": "10.0.0.1", "eventid": "cowrie.session.closed", "timestamp": "2024-01-01T00:03:00Z"}',
    'not json at all',
]


def _instant(text):
    try:
        t = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def _summary(key, seg, piece):
    """What the contract says about the events of one session."""
    times = sorted(t for t in (_instant(e.get("timestamp")) for e in piece) if t)
    span = (times[-1] - times[0]).total_seconds() if times else 0
    kinds = [e.get("eventid") for e in piece]
    return {"session": hashlib.md5(key.encode()).hexdigest()[:12], "seg": seg,
            "src_ip": piece[0].get("src_ip") if any("src_ip" in e for e in piece) else "unknown",
            "event_count": len(piece), "session_duration": span if span else 5.0 * len(piece),
            "unique_commands": len({e["input"] for e in piece if (e.get("input") or "").strip()}),
            "unique_usernames": len({e["username"] for e in piece if e.get("username") is not None}),
            "failed_logins": kinds.count("cowrie.login.failed"), "successful_login": kinds.count("cowrie.login.success")}


def brute_force(lines):
    """Independent model: all events of a key, cut after each close marker, piece by piece."""
    events = []
    for line in lines:
        try:
            events.append(json.loads(line))
        except ValueError:
            continue
    key_of = lambda e: e.get("session") or e.get("src_ip") or "unknown"
    out = []
    for key in dict.fromkeys(map(key_of, events)):
        own = [e for e in events if key_of(e) == key]
        cuts = [i + 1 for i, e in enumerate(own) if e.get("eventid") == "cowrie.session.closed"]
        pieces = [own[a:b] for a, b in zip([0, *cuts], [*cuts, len(own)])]
        out += [_summary(key, seg, piece) for seg, piece in enumerate(p for p in pieces if p)]
    return out


def _write(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "log.json"), "w") as f:
        f.write("\n".join(lines) + "\n")


COLS = ["session", "seg", "src_ip", "event_count", "unique_commands", "session_duration", "failed_logins",
        "successful_login", "unique_usernames"]


def _rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.select(*COLS).collect())


def test_read_events_drops_blank_and_malformed(spark, scratch):
    _write(scratch, LINES)
    ev = read_events(spark, scratch)
    assert ev.count() == 13  # 17 lines - 2 blank - 1 truncated - 1 not json
    kex = ev.where(F.col("eventid") == "cowrie.client.kex").first()
    assert kex.timestamp == "bad-time"


def test_sessionize_matches_brute_force(spark, scratch):
    _write(scratch, LINES)
    got = _rows(sessionize(read_events(spark, scratch), seq="arrival", chunk="split"))
    exp = sorted(tuple(r[c] for c in COLS) for r in brute_force(LINES))
    assert got == exp


def test_chunked_segmentation_is_exact(spark, scratch):
    """A tiny chunk size forces every key across many chunks (the hot-key
    path); results must equal one big chunk."""
    _write(scratch, LINES * 7)
    ev = read_events(spark, scratch).withColumn("event_seq", F.row_number().over(Window.orderBy("arrival")))
    a = _rows(sessionize(ev, chunk_size=3))
    b = _rows(sessionize(ev))
    exp = sorted(tuple(r[c] for c in COLS) for r in brute_force(LINES * 7))
    assert a == b == exp


def test_sessionize_invariant_under_repartition(spark):
    from tarpit.sources import fixtures
    raw = fixtures.raw_events(spark, "/root/testdata/sf0.001")
    a = _rows(sessionize(raw))
    b = _rows(sessionize(raw.repartition(7, "src_ip")))
    assert a == b
    assert sum(r[3] for r in a) == raw.count()  # events are conserved
