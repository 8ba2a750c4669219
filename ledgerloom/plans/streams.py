"""Keyed state machines over the events, as batches and as streams that are run to the end of the table."""

from __future__ import annotations

from ..sources.binding import read
from ..streaming import keyed
from .catalogue import query

DAY = 86_400

EVENTS_SQL = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL)"

BREAKER_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, b AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'closed' AS state, 0 AS failures, 0 AS wins, NULL::BIGINT AS last, true AS admitted, NULL::BIGINT AS us FROM e
 UNION ALL SELECT user_id, k, event_id,
  CASE WHEN NOT admitted THEN 'open' WHEN bad THEN CASE WHEN mode = 'half_open' OR failures + 1 >= 3 THEN 'open' ELSE 'closed' END WHEN mode = 'half_open' AND wins + 1 < 2 THEN 'half_open' ELSE 'closed' END,
  CASE WHEN NOT admitted THEN failures WHEN bad THEN failures + 1 WHEN mode = 'half_open' AND wins + 1 < 2 THEN failures ELSE 0 END, CASE WHEN admitted AND NOT bad AND mode = 'half_open' THEN wins + 1 ELSE wins END, CASE WHEN admitted AND bad THEN us ELSE last END, admitted, us
  FROM (SELECT e.user_id, e.k, e.event_id, e.us AS us, b.failures, b.last, e.event_type = 'error' AS bad, NOT (b.state = 'open' AND e.us - b.last < {DAY * 1_000_000}) AS admitted, CASE b.state WHEN 'open' THEN 'half_open' ELSE b.state END AS mode, CASE b.state WHEN 'open' THEN 0 ELSE b.wins END AS wins
   FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1))
 SELECT user_id, event_id, state, admitted FROM b WHERE k > 0"""

SNAPSHOTS_SQL = f"""WITH {EVENTS_SQL}, w AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN us WHEN event_type = 'error' THEN -1 END IGNORE NULLS) OVER w AS put, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN value END IGNORE NULLS) OVER w AS v FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 h AS (SELECT *, event_type IN ('view', 'click') AND coalesce(put, -1) >= 0 AND us - put <= 900 * 1000000 AS hit FROM w) SELECT user_id, event_id, hit, CASE WHEN hit THEN v END AS held FROM h"""

PASSED_SQL = "(SELECT max(us) // 1000 * 1000 FROM e) - {late}"


@query(BREAKER_SQL)
def breaker_states(spark, sf):
    """State of each user's circuit breaker after every event: three failures in a row open it for a day, two successes close it again."""
    return keyed.answers(read(spark, sf, "events"), keyed.breaker(retry=DAY))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, c AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS began, 0 AS hits, true AS allowed FROM e
 UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN c.began IS NULL OR e.us - c.began >= {DAY * 1_000_000} THEN e.us ELSE c.began END, CASE WHEN c.began IS NULL OR e.us - c.began >= {DAY * 1_000_000} THEN 1 WHEN c.hits < 3 THEN c.hits + 1 ELSE c.hits END, c.began IS NULL OR e.us - c.began >= {DAY * 1_000_000} OR c.hits < 3
  FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1) SELECT user_id, event_id, hits, allowed FROM c WHERE k > 0""")
def first_hit_limits(spark, sf):
    """Hits of each user against a counter that lives for a day from its first hit and takes three."""
    return keyed.answers(read(spark, sf, "events"), keyed.first_hit_counter(3, DAY))


@query(SNAPSHOTS_SQL)
def snapshot_reads(spark, sf):
    """Reads of each user's last snapshot, which lives for 900 seconds or until an error drops it."""
    return keyed.answers(read(spark, sf, "events"), keyed.snapshots(900))


def streamed(spark, sf, machine, late):
    """What a stream over the events has answered when it has read them all: everything the watermark has passed."""
    schema = read(spark, sf, "events").schema
    return keyed.drained(spark, f"{sf}/[e]vents.parquet", schema, lambda e: keyed.streamed_answers(e, machine, late), keyed.new_folder(spark, "stream"))


@query(BREAKER_SQL + " AND us <= " + PASSED_SQL.format(late=DAY * 1_000_000))
def streamed_breaker_states(spark, sf):
    """The breaker as keyed state of a stream, rows up to a day late: answers wait for the watermark."""
    return streamed(spark, sf, keyed.breaker(retry=DAY), "1 day")


@query(SNAPSHOTS_SQL + " WHERE us <= " + PASSED_SQL.format(late=3600 * 1_000_000))
def streamed_snapshot_reads(spark, sf):
    """The snapshots as keyed state of a stream, rows up to an hour late."""
    return streamed(spark, sf, keyed.snapshots(900), "1 hour")

