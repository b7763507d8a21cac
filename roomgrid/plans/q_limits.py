"""Registered rate-limiter queries (batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgrid.operators import ratelimit as RL
from roomgrid.plans.registry import register
from roomgrid.sources import views as V

# The driver's events have median per-user gaps of hours, so the reference's 15 s
# window would make almost every request its own session; these parameters exercise
# both allowed and denied requests.
GAP_SECONDS = 6 * 3600
MAX_REQUESTS = 2
GAP_US = GAP_SECONDS * 1_000_000

SESSIONS_SQL = f"""
e AS (SELECT event_id, user_id, epoch_us(ts) AS t,
             lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS prev
      FROM events),
s AS (SELECT *, CASE WHEN prev IS NULL OR t >= prev + {GAP_US} THEN 1 ELSE 0 END AS st FROM e),
n AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY t, event_id
                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM s),
o AS (SELECT event_id, user_id, session_no,
             row_number() OVER (PARTITION BY user_id, session_no ORDER BY t, event_id) AS ordinal
      FROM n)"""


def _sessions(spark, d):
    return RL.sessions(V.requests(spark, d), GAP_SECONDS, MAX_REQUESTS)


@register("rate_limit_sessions", sql=f"""
WITH {SESSIONS_SQL}
SELECT event_id, user_id, session_no, ordinal, ordinal <= {MAX_REQUESTS} AS allowed FROM o
""")
def rate_limit_sessions(spark, d):
    return _sessions(spark, d).select("event_id", "user_id", "session_no", "ordinal", "allowed")


@register("rate_limit_denied", sql=f"""
WITH {SESSIONS_SQL}
SELECT user_id, count(*) AS n_requests,
       CAST(sum(CASE WHEN ordinal > {MAX_REQUESTS} THEN 1 ELSE 0 END) AS BIGINT) AS n_denied,
       max(session_no) AS n_sessions
FROM o GROUP BY user_id
""")
def rate_limit_denied(spark, d):
    return RL.denied_per_user(_sessions(spark, d))


@register("rate_limit_reset", sql=f"""
WITH a AS (SELECT max(epoch_us(ts)) AS asof FROM events)
SELECT user_id, greatest(0.0, CAST(max(epoch_us(ts)) + {GAP_US} - a.asof AS DOUBLE) / 1e6) AS reset_in_seconds
FROM events CROSS JOIN a GROUP BY user_id, a.asof
""")
def rate_limit_reset(spark, d):
    """Time until each user's counter expires, as of the last request in the log."""
    ev = V.requests(spark, d)
    as_of = ev.agg(F.max(F.unix_micros("ts"))).first()[0]  # one scalar
    return RL.time_until_reset(ev, as_of, GAP_SECONDS)
