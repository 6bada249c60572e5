"""Time stamps are bigint milliseconds; every rule takes the moment it is judged at. No clock is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LEASE_TTL_MS, MAX_SKEW_MS, RECORD_TTL_MS, STALE_SECONDS

_LOW, _HIGH = -(2**63), 2**63 - 1


def millis(ts: Column) -> Column:
    """Of a timestamp, with or without zone (read as UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def seconds(ms: Column) -> Column:
    """Truncated towards zero."""
    return F.when(ms >= 0, F.floor(ms / 1000)).otherwise(F.ceil(ms / 1000)).cast("bigint")


def skew(ts: Column, as_of: Column, most: int = MAX_SKEW_MS) -> Column:
    """struct(ok, skew): the distance may reach ``most``, either way."""
    away = F.abs(ts - as_of)
    return F.struct((away <= most).alias("ok"), away.alias("skew"))


def within_skew(ts: Column, as_of: Column, most: int = MAX_SKEW_MS) -> Column:
    return F.abs(ts - as_of) <= most


def expired(expires_at: Column, as_of: Column) -> Column:
    return as_of > expires_at


def live(expires_at: Column, as_of: Column) -> Column:
    """At the very moment of its expiry a lease is neither live nor expired."""
    return expires_at > as_of


def before(a: Column, b: Column) -> Column:
    return a < b


def after(a: Column, b: Column) -> Column:
    return a > b


def kept(stored_at: Column, as_of: Column, ttl: int = RECORD_TTL_MS) -> Column:
    return as_of - stored_at < ttl


def stale(last_seen: Column, as_of: Column, timeout: int = STALE_SECONDS) -> Column:
    return F.floor((as_of - last_seen) / 1000) > timeout


def plus(ts: Column, ms: Column) -> Column:
    """Saturating sum."""
    return F.coalesce(F.try_add(ts, ms), F.when(ms >= 0, F.lit(_HIGH)).otherwise(F.lit(_LOW)))


def minus(ts: Column, ms: Column) -> Column:
    """Saturating difference."""
    return F.coalesce(F.try_subtract(ts, ms), F.when(ms >= 0, F.lit(_LOW)).otherwise(F.lit(_HIGH)))


def since(ts: Column, earlier: Column) -> Column:
    """Null if negative."""
    return F.when(ts >= earlier, ts - earlier)


def remaining(expires_at: Column, as_of: Column) -> Column:
    return since(expires_at, as_of)


def needs_renewal(expires_at: Column, as_of: Column, ttl: Column | int = LEASE_TTL_MS) -> Column:
    """Less than a quarter of the lease time is left, or none."""
    ttl = F.lit(ttl) if isinstance(ttl, int) else ttl
    return expires_at - as_of < F.floor(ttl / 4)


def renewal_time(issued_at: Column, ttl: Column | int = LEASE_TTL_MS) -> Column:
    ttl = F.lit(ttl) if isinstance(ttl, int) else ttl
    return (issued_at + (ttl - F.floor(ttl / 4))).cast("bigint")
