"""Queries of event streams, ledgers and queues, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import ledger as L
from tamis.operators import state as S

from .base import bound, sql

KEY = b"a key of the tests"
#: Events of cases: actions by type and value, actors in turn, a detail that is empty for some.
CASES = """
SELECT user_id AS case_id, event_id, CAST('actor' || CAST(event_id % 3 AS VARCHAR(9)) AS VARCHAR(20)) AS actor, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'team' || CAST(event_id % 4 AS VARCHAR(9)) END AS detail,
  CASE event_type WHEN 'view' THEN CASE WHEN value < 20 THEN 'assign' ELSE 'start_investigation' END WHEN 'click' THEN CASE WHEN value < 20 THEN 'request_evidence' ELSE 'submit_evidence' END
    WHEN 'signup' THEN 'propose_decision' WHEN 'purchase' THEN CASE WHEN value < 30 THEN 'approve_decision' ELSE 'reject_decision' END
    ELSE CASE WHEN value < 10 THEN 'link_rescreen' WHEN value < 12 THEN 'other' ELSE 'reopen' END END AS action
FROM {events}
"""
QUEUE = """
SELECT user_id * 1000 + CAST(event_id % 40 AS INT) AS message, event_id,
  CASE event_type WHEN 'view' THEN 'leased' WHEN 'click' THEN 'retry_scheduled' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN CASE WHEN value < 5 THEN 'dead' ELSE 'recovered' END ELSE 'enqueued' END AS action
FROM {events}
"""
LEASES = "SELECT user_id AS message, event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') AND value < 12 THEN 'complete' ELSE 'claim' END AS action FROM {events}"
LEDGER = "SELECT user_id AS stream, event_id, event_type || ':' || props AS payload, ts, value FROM {events}"


def case_replay(spark, sf_dir):
    """State of each case after its events, with how many were taken and refused."""
    return S.case_states(bound(spark, sf_dir, CASES), "case_id", "event_id")


def queue_projection(spark, sf_dir):
    return S.queue_states(bound(spark, sf_dir, QUEUE), "message", "event_id")


def queue_status(spark, sf_dir):
    """Messages by state, and the first pending one that a worker would claim."""
    states = queue_projection(spark, sf_dir)
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("first_message"), F.sum("attempts").alias("attempts"))


def queue_leases(spark, sf_dir):
    """Outcome of each claim and completion: leases of six hours, twelve attempts."""
    return S.leases(bound(spark, sf_dir, LEASES), "message", "event_id", "ts", 6 * 3600, 12)


def rate_limit(spark, sf_dir):
    """Events that buckets of two tokens, with one more a minute, let pass."""
    return S.admitted(bound(spark, sf_dir, "SELECT user_id % 7 AS k, event_id, ts FROM {events}"), "k", "event_id", "ts", 1, 2)


def concurrency(spark, sf_dir):
    """Most sessions of a user open at once; a session lasts as many hours as its event's value."""
    spans = bound(spark, sf_dir, "SELECT user_id, unix_micros(CAST(ts AS TIMESTAMP)) AS a, unix_micros(CAST(ts AS TIMESTAMP)) + CAST(floor(value * 100) AS BIGINT) * 36000000 AS b FROM {events}")
    return S.busiest(spans, ["user_id"], F.col("a"), F.col("b")).select("user_id", F.col("most").cast("long").alias("most"))


def chain(spark, sf_dir):
    return L.chained(bound(spark, sf_dir, LEDGER), "stream", "event_id", "payload")


def ledger_chain(spark, sf_dir):
    """Hashes of each user's events, each over the one before."""
    return chain(spark, sf_dir)


def ledger_verification(spark, sf_dir):
    """Faults found after some payloads, links and numbers were changed."""
    events = bound(spark, sf_dir, LEDGER)
    made = events.join(chain(spark, sf_dir).withColumnRenamed("o", "event_id"), ["stream", "event_id"])
    bad = made.withColumns(
        {
            "payload": F.when(F.col("event_id") % 97 == 5, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")),
            "previous": F.when((F.col("event_id") % 89 == 7) & (F.col("sequence") > 1), F.lit("x")).otherwise(F.col("previous")),
        }
    )
    return L.chain_faults(bad, "stream", "payload").where("fault is not null").select("stream", "event_id", "fault")


def keyed_digests(spark, sf_dir):
    """Content ids and keyed digests of events."""
    rows = bound(spark, sf_dir, LEDGER)
    return rows.select("event_id", L.content_id("event_", F.col("stream").cast("string"), F.col("payload")).alias("content_id"), L.hmac_sha256(KEY, F.col("payload")).alias("mac"))


def idempotent_receipts(spark, sf_dir):
    """Requests by their key: the first is new, the same again replays it, another conflicts."""
    rows = bound(spark, sf_dir, "SELECT event_id, user_id, event_type, CAST(event_id % 50 AS BIGINT) AS k, CAST(floor(value) AS INT) % 3 AS body FROM {events}")
    out = L.receipts(rows, ["user_id", "event_type", "k"], "event_id", F.col("body").cast("string"))
    return out.select("event_id", "verdict")


REFS = "SELECT CAST(event_id * 7 % 3000 AS BIGINT) AS snapshot, event_id AS event, CAST(ts AS DATE) + 20 AS expires, value FROM {events}"


def purge_eligible(spark, sf_dir):
    """Snapshots all of whose events have expired, without a hold."""
    refs = bound(spark, sf_dir, REFS)
    return L.purgeable(refs, refs.where("value < 0.2"), F.lit("2024-02-14").cast("date"))


def purge_claims(spark, sf_dir):
    """Claims of purges against the anchored audit and the independent record."""
    refs = bound(spark, sf_dir, REFS)
    claims = refs.where("value < 30").select("snapshot").distinct()
    audit = refs.where("value < 25").select("snapshot", F.col("event").alias("sequence"))
    return L.adjudicated(claims, audit, refs.where("value > 3"), 8000)


def redaction(spark, sf_dir):
    """Event properties as JSON: one key replaced, one hashed, others kept."""
    rows = bound(spark, sf_dir, "SELECT event_id, user_id, event_type, props FROM {events}")
    doc = F.concat(F.lit('{"id": '), "user_id", F.lit(', "in": {"p": '), "props", F.lit(', "name": [{"name": 1}, 2]}, "who": "'), "event_type", F.lit('"}'))
    rows = rows.select("event_id", doc.alias("doc"))
    return rows.select("event_id", L.redacted(F.col("doc"), ["name"], ["who"], KEY).alias("doc"))


QUERIES = {
    f.__name__: f
    for f in (
        case_replay, queue_projection, queue_status, queue_leases, rate_limit, concurrency, ledger_chain, ledger_verification, keyed_digests, idempotent_receipts,
        purge_eligible, purge_claims, redaction,
    )
}


def _blob(pad: int) -> str:
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in KEY.ljust(64, b"\0")) + "'::BLOB"


def _mac(v: str) -> str:
    return f"sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode({v}))))"


_LEGAL = " OR ".join(f"(action = '{a}' AND state IN ({', '.join(repr(x) for x in states)}))" for a, (states, _) in S.CASE_ACTIONS.items())
_THEN = "CASE action " + " ".join(f"WHEN '{a}' THEN '{to}'" for a, (_, to) in S.CASE_ACTIONS.items() if to) + " ELSE state END"
_QUEUE = f"""
SELECT message, CASE last WHEN 'leased' THEN 'leased' WHEN 'completed' THEN 'completed' WHEN 'dead' THEN 'dead' ELSE 'pending' END AS state, attempts
FROM (SELECT message, arg_max(action, event_id) AS last, count(*) FILTER (action = 'leased') AS attempts FROM ({sql(QUEUE)}) GROUP BY 1)
"""
_CHAIN = f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY event_id) AS n FROM ({sql(LEDGER)})),
c AS (SELECT stream, event_id, n, '' AS previous, sha256('|' || payload) AS hash FROM e WHERE n = 1
  UNION ALL SELECT e.stream, e.event_id, e.n, c.hash, sha256(c.hash || '|' || e.payload) FROM c JOIN e ON e.stream = c.stream AND e.n = c.n + 1)
"""
ORACLE = {
    "case_replay": f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY event_id) AS n FROM ({sql(CASES)})),
f AS (SELECT DISTINCT case_id, 0::BIGINT AS n, 'open' AS state, NULL::VARCHAR AS assignee, NULL::VARCHAR AS proposer, 0 AS revision, 0 AS refused FROM e
  UNION ALL SELECT case_id, n, CASE WHEN ok THEN {_THEN} ELSE state END, CASE WHEN ok AND action = 'assign' THEN detail ELSE assignee END,
    CASE WHEN NOT ok THEN proposer WHEN action = 'propose_decision' THEN actor WHEN action IN ('reject_decision', 'reopen') THEN NULL ELSE proposer END, revision + ok::INT, refused + (NOT ok)::INT
  FROM (SELECT f.case_id, e.n, f.state, f.assignee, f.proposer, f.revision, f.refused, e.action, e.actor, e.detail,
    ({_LEGAL}) AND NOT (action IN ('approve_decision', 'reject_decision') AND (proposer IS NULL OR proposer = actor)) AND NOT (action = 'assign' AND trim(detail) = '') AS ok
    FROM f JOIN e ON e.case_id = f.case_id AND e.n = f.n + 1))
SELECT case_id, state, assignee, proposer, revision, refused FROM f QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC) = 1
""",
    "queue_projection": _QUEUE,
    "queue_status": f"SELECT state, count(*) AS n, min(message) AS first_message, sum(attempts)::BIGINT AS attempts FROM ({_QUEUE}) GROUP BY 1",
    "queue_leases": f"""
WITH RECURSIVE e AS (SELECT message, event_id, epoch_us(ts) AS t, action, row_number() OVER (PARTITION BY message ORDER BY event_id) AS n FROM ({sql(LEASES)})),
f AS (SELECT DISTINCT message, 0::BIGINT AS n, 0::BIGINT AS o, 'pending' AS state, 0::BIGINT AS until_us, 0 AS attempts, '' AS outcome FROM e
  UNION ALL SELECT message, n, event_id, CASE WHEN outcome IN ('leased', 'dead', 'completed') THEN outcome ELSE state END, CASE outcome WHEN 'leased' THEN t + 21600000000 ELSE until_us END,
    attempts + (outcome = 'leased')::INT, outcome FROM (
  SELECT f.message, e.n, e.event_id, e.t, f.state, f.until_us, f.attempts, CASE WHEN f.state IN ('completed', 'dead') THEN 'ignored_' || f.state
    WHEN e.action = 'claim' THEN CASE WHEN f.state = 'leased' AND e.t < f.until_us THEN 'busy' WHEN f.attempts >= 12 THEN 'dead' ELSE 'leased' END
    WHEN f.state = 'leased' AND e.t < f.until_us THEN 'completed' ELSE 'no_lease' END AS outcome FROM f JOIN e ON e.message = f.message AND e.n = f.n + 1))
SELECT message, o, outcome FROM f WHERE n > 0
""",
    "rate_limit": f"""
WITH RECURSIVE e AS (SELECT user_id % 7 AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT DISTINCT k, 0::BIGINT AS n, 0::BIGINT AS o, 2.0::DOUBLE AS tokens, NULL::BIGINT AS last_us, false AS allowed FROM e
  UNION ALL SELECT k, n, event_id, CASE WHEN have >= 1 THEN have - 1.0 ELSE have END, t, have >= 1 FROM (
  SELECT f.k, e.n, e.event_id, e.t, least(2.0::DOUBLE, f.tokens + ((e.t - coalesce(f.last_us, e.t)) // 60000000 + ((e.t - coalesce(f.last_us, e.t)) % 60000000) / 60000000.0::DOUBLE)) AS have
  FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1))
SELECT k, o, allowed FROM f WHERE n > 0
""",
    "concurrency": """
WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value * 100) AS BIGINT) * 36000000 AS b FROM events),
m AS (SELECT user_id, t, sum(d) AS d FROM (SELECT user_id, a AS t, 1 AS d FROM s UNION ALL SELECT user_id, b, -1 FROM s) GROUP BY ALL)
SELECT user_id, CAST(max(n) AS BIGINT) AS most FROM (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM m) GROUP BY 1
""",
    "ledger_chain": f"{_CHAIN} SELECT stream, event_id AS o, n AS sequence, previous, hash FROM c",
    "ledger_verification": f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY event_id) AS n FROM ({sql(LEDGER)}))
SELECT stream, event_id, CASE WHEN event_id % 89 = 7 AND n > 1 THEN 'broken_link' ELSE 'hash_mismatch' END AS fault FROM e WHERE (event_id % 89 = 7 AND n > 1) OR event_id % 97 = 5
""",
    "keyed_digests": f"SELECT event_id, 'event_' || left(sha256(stream || chr(31) || payload), 24) AS content_id, {_mac('payload')} AS mac FROM ({sql(LEDGER)})",
    "idempotent_receipts": """
SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN b = first_value(b) OVER w THEN 'replay' ELSE 'conflict' END AS verdict
FROM (SELECT *, CAST(floor(value) AS INT) % 3 AS b, event_id % 50 AS k FROM events) WINDOW w AS (PARTITION BY user_id, event_type, k ORDER BY event_id)
""",
    "purge_eligible": f"SELECT snapshot FROM ({sql(REFS)}) GROUP BY 1 HAVING bool_and(expires <= DATE '2024-02-14') AND NOT bool_or(value < 0.2)",
    "purge_claims": f"""
WITH r AS ({sql(REFS)}) SELECT snapshot, CASE WHEN snapshot NOT IN (SELECT snapshot FROM r WHERE value < 25 AND event <= 8000) THEN 'not_anchored'
  WHEN snapshot NOT IN (SELECT snapshot FROM r WHERE value > 3) THEN 'not_recorded' ELSE 'accepted' END AS verdict FROM (SELECT DISTINCT snapshot FROM r WHERE value < 30)
""",
    "redaction": f"""
SELECT event_id, '{{"id":' || user_id || ',"in":{{"name":"[REDACTED]","p":' || replace(props, ' ', '') || '}},"who":"hmac-sha256:' || {_mac("'\"' || event_type || '\"'")} || '"}}' AS doc FROM events
""",
}
