"""Predicates of access, retries, leases and sessions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grant_is_live(status: Column, expires: Column, now: Column) -> Column:
    """Not disabled, and without an expiry or before it. Times without a zone are UTC; an unreadable one has expired."""
    open_end = expires.isNull() | (F.trim(expires) == "")
    return (F.coalesce(status, F.lit("")) != "disabled") & (open_end | F.coalesce(now < F.try_to_timestamp(expires), F.lit(False)))


def access_decision(action: Column, role: Column, user: Column, tenant: Column, owner: Column, dossier_tenant: Column, scope: Column, grants: Column, now: Column) -> Column:
    """Whether a user may act on a dossier.

    Tenants must agree. The owner may do all; an administrator manages but doesn't read; scope "mine" shuts shares out; else a
    live grant of the user with the action. grants: array<struct<user, action, status, expires>>.
    """
    held = F.exists(grants, lambda g: (F.lower(g["user"]) == F.lower(user)) & (g["action"] == action) & grant_is_live(g["status"], g["expires"], now))
    granted = (F.coalesce(scope, F.lit("")) != "mine") & F.coalesce(held, F.lit(False))
    return F.coalesce((tenant == dossier_tenant) & ((user == owner) | F.when(role == "ADMINISTRATOR", action == "manage").otherwise(granted)), F.lit(False))


# HTTP statuses after which a call is tried again.
RETRY_STATUSES = (408, 425, 429, 500, 502, 503, 504)


def is_retryable(kind: Column, status: Column, flagged: Column) -> Column:
    """Timeouts, connection failures, flagged errors and the statuses of RETRY_STATUSES."""
    return F.coalesce(F.lower(kind).rlike("timeout|connection"), F.lit(False)) | F.coalesce(flagged, F.lit(False)) | F.coalesce(status.isin(*RETRY_STATUSES), F.lit(False))


def is_stale(state: Column, lease_until: Column, updated: Column, now: Column, grace_ms: int) -> Column:
    """A running job whose lease is over, or a queued one whose lease, or else its grace after the last update, is over."""
    return F.when(state == "RUNNING", lease_until <= now).when(state == "QUEUED", F.coalesce(lease_until, updated + grace_ms) <= now).otherwise(F.lit(False))


def outbox_is_due(state: Column, lease_until: Column, now: Column) -> Column:
    return (state == "PENDING") | ((state == "CLAIMED") & F.coalesce(lease_until <= now, F.lit(True)))


def session_is_expired(state: Column, expires: Column, touched: Column, now: Column, stale_ms: int, keep_ms: int) -> Column:
    """Open or cancelled past the expiry; completing past it and untouched; completed after the time that it is kept."""
    return F.coalesce(
        F.when(state.isin("OPEN", "CANCELLED"), expires <= now).when(state == "COMPLETING", (expires <= now) & (touched <= now - stale_ms)).when(state == "COMPLETED", touched <= now - keep_ms),
        F.lit(False),
    )


def event_key(event_id: Column, topic: Column, partition: Column, offset: Column) -> Column:
    """The event's own id, else its place in the log."""
    return F.coalesce(F.nullif(event_id, F.lit("")), F.concat_ws(":", topic, partition.cast("string"), offset.cast("string")))


def search_structured(key: Column, wanted: str) -> Column:
    return F.lower(key) == wanted.lower()


def fact_confidence(grounding: Column, line_confidences: Column, review_passed: Column, cap: float = 0.7) -> Column:
    """The least of the grounding and the known line confidences, capped where the review hasn't passed."""
    least = F.least(grounding, F.array_min(F.filter(line_confidences, lambda x: x.isNotNull())))
    return F.when(F.coalesce(review_passed, F.lit(False)), least).otherwise(F.least(least, F.lit(cap)))


def grounding_level(value: Column, quote: Column) -> Column:
    """EXACT for a substring, SEPARATORS for one without spaces, points and commas, else NOT_FOUND; near matches need `sequence.near`."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s., -]", ""))
    blank = F.coalesce(F.trim(value) == "", F.lit(True)) | quote.isNull()
    return F.when(blank, "NOT_FOUND").when(F.lower(quote).contains(F.lower(F.trim(value))), "EXACT").when(bare(quote).contains(bare(value)) & (bare(value) != ""), "SEPARATORS").otherwise("NOT_FOUND")
