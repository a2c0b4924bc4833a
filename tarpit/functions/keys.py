"""Session keys, pseudonyms and time parsing/formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values the reference uses.
EVENT_LOGIN_FAILED = "cowrie.login.failed"
EVENT_LOGIN_SUCCESS = "cowrie.login.success"
EVENT_SESSION_CLOSED = "cowrie.session.closed"
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def session_key(session="session", src_ip="src_ip") -> Column:
    """Session id, if null/empty the source IP, else 'unknown'."""
    return F.coalesce(F.nullif(_c(session), F.lit("")), _c(src_ip), F.lit("unknown"))


def session_hash(key) -> Column:
    """12-hex-digit pseudonym (md5 prefix) of a session key."""
    return F.substring(F.md5(_c(key).cast("string")), 1, 12)


def stringify(c) -> Column:
    """Make any value comparable as text (arrays/maps/structs to JSON)."""
    return F.to_json(_c(c))


def parse_ts(c) -> Column:
    """ISO-8601 text to TIMESTAMP; unparsable text gives NULL."""
    return F.try_to_timestamp(_c(c))


def fmt_ts(c) -> Column:
    """P5: timestamp as 'yyyy-MM-dd HH:mm:ss' text (session time zone, UTC)."""
    return F.date_format(_c(c), TS_TEXT_FORMAT)


def has_command(c="input") -> Column:
    """command present and not blank (any non-whitespace character)."""
    return _c(c).isNotNull() & _c(c).rlike(r"\S")


def session_id_text(n) -> Column:
    """P20 text form: SESS-%05d, never truncated above five digits."""
    return F.format_string("SESS-%05d", _c(n))


def session_number(c="session_id") -> Column:
    """The number in a SESS-%05d id, to order by: as text, 100000 would come before 99999."""
    return F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"(\d+)$", 1).try_cast("bigint")
