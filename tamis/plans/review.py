"""Queries of review runs and checks over stored state, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.similarity import PARTY
from tamis.functions.text import name_tokens
from tamis.operators import review as R
from tamis.operators.ledger import hmac_sha256, sha

from . import decision as D
from . import names as P
from . import state as S
from .base import bound, table


def review_run(spark, sf_dir):
    """Observations to decisions to notes, counted by outcome."""
    decided = D.D.disposed(D.D.classified(D.observations(spark, sf_dir)))
    out = R.run_status(decided, F.size("patterns") + F.size("requires"), F.col("id") % 13 != 0)
    return out.groupBy("disposition", "retrieval_status", "note_status").agg(F.count(F.lit(1)).alias("n"))


def observation_batch(spark, sf_dir):
    """Observations of scored candidates and of those with another kind."""
    rows = P.evidence_score(spark, sf_dir).select(F.col("request_id").alias("id"), F.col("candidate_id").cast("string").alias("value"), F.lit("normalized_name").alias("route"), "score", "evidence")
    return R.observed_by_codes(rows, F.col("score") >= 400, F.contains("evidence", F.lit("entity_type_conflict")), "entity_type_mismatch")


def case_membership(spark, sf_dir):
    """Cases of orders: their lines are alerts, of the supplier's tenant; some aren't known.

    Lines of different orders may share an alert: the one that stands first in the table gives its tenant.
    """
    rows = bound(spark, sf_dir, "SELECT l_orderkey AS case_id, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS alert_id, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey % 2 END AS tenant, l_quantity, place FROM {lineitem}", places="lineitem")
    alerts = rows.where("l_quantity < 49").groupBy("alert_id").agg(F.min_by("tenant", "place").alias("tenant"))
    return R.memberships(rows.select("case_id", "alert_id"), alerts)


def registrations(spark, sf_dir):
    """Parts registered against the versions of smaller ones."""
    rows = bound(spark, sf_dir, "SELECT p_partkey, p_name, p_brand, p_size FROM {part}")
    existing = rows.where("p_size <= 25").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("c"))
    new = rows.where("p_size >= 20").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") == 22, "p").otherwise(F.col("p_name")).alias("c"))
    return R.registered(existing, new, "k", "c").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def mapping_impact(spark, sf_dir):
    """Suppliers' components against an inventory, by the line items that use them."""
    components = bound(spark, sf_dir, "SELECT s_suppkey AS component FROM {supplier}")
    inventory = bound(spark, sf_dir, "SELECT s_suppkey AS component, CASE WHEN s_acctbal < 0 THEN 'retired' ELSE 'active' END AS status FROM {supplier} WHERE s_nationkey > 2")
    return R.impact(components, inventory, bound(spark, sf_dir, "SELECT l_suppkey AS component FROM {lineitem} WHERE l_quantity > 25"))


def genesis_boundary(spark, sf_dir):
    """Faults of chains that go from plain to keyed digests at their eleventh event."""
    made = S.chain(spark, sf_dir).withColumnRenamed("o", "event_id").join(bound(spark, sf_dir, S.LEDGER), ["stream", "event_id"])
    keyed = hmac_sha256(S.KEY, F.concat_ws("|", "previous", "payload"))
    made = made.withColumn("hash", F.when((F.col("sequence") >= 11) & (F.col("event_id") % 37 != 0), keyed).otherwise(F.col("hash")))
    pinned = F.when(F.col("stream") % 10 == 0, F.lit("other")).otherwise(F.col("previous"))
    out = R.boundary_faults(made, "stream", F.lit(11), pinned, S.KEY)
    return out.where("fault is not null").select("stream", "event_id", "fault")


def anchor_verification(spark, sf_dir):
    """Heads of users' chains against anchors; some are forged, some beyond the head, some of another hash."""
    made = S.chain(spark, sf_dir)
    heads = made.groupBy("stream").agg(F.max("sequence").alias("sequence"), F.max_by("hash", "sequence").alias("hash"))
    k = F.col("stream") % 5
    at = F.when(k == 1, F.col("sequence") + 1).otherwise(F.col("sequence"))
    digest = F.when(k == 2, sha(F.col("hash"))).otherwise(F.col("hash"))
    anchors = heads.where("stream % 7 <> 0").select("stream", at.alias("sequence"), digest.alias("hash"))
    mac = hmac_sha256(S.KEY, F.concat_ws("|", F.col("sequence").cast("string"), "hash"))
    anchors = anchors.withColumn("mac", F.when(k == 3, F.lit("x")).otherwise(mac))
    return R.anchored(heads, anchors, S.KEY).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def snapshot_check(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("snapshot"), "props", "value")
    here = rows.where("value > 2").select("snapshot", F.when(F.col("snapshot") % 41 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")).alias("content"))
    return R.snapshot_state(rows.select("snapshot", F.sha2("props", 256).alias("sha256")), here, rows.where("value < 1")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def response_extraction(spark, sf_dir):
    """Candidates of single and batch responses."""
    rows = bound(spark, sf_dir, "SELECT o_orderkey AS k, CAST(o_totalprice AS INT) % 1000 AS s FROM {orders}")
    one = F.concat(F.lit('{"candidates": [{"candidate_id": "a'), F.col("k").cast("string"), F.lit('", "score": '), F.col("s").cast("string"), F.lit("}]}"))
    raw = F.when(F.col("k") % 2 == 0, one).otherwise(F.concat(F.lit('{"items": [{"response": {"candidates": []}}, {"response": '), one, F.lit("}]}")))
    out = R.response_items(rows.select("k", raw.alias("raw")), "k", "raw")
    return out.select("k", F.col("position").cast("long").alias("position"), "candidate_id", F.col("score").cast("long").alias("score"))


def readiness(spark, sf_dir):
    """Checks of each supplier's lines that all hold, or the names of those that don't."""
    rows = bound(spark, sf_dir, "SELECT l_suppkey AS worker, max(l_quantity) AS q, min(l_tax) AS t, count(*) AS n FROM {lineitem} GROUP BY l_suppkey")
    held = {"count": F.col("n") > 590, "quantity": F.col("q") >= 50, "tax": F.col("t") < 0.001}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), ok.alias("ok")) for k, ok in held.items()]))
    checks = rows.select("worker", each.alias("c")).select("worker", "c.*")
    return R.ready(checks, "worker", "name", "ok").withColumn("failed", F.array_join("failed", ","))


def tenant_rows(spark, sf_dir):
    """Customers of one segment, through the tenant guard."""
    return R.of_tenant(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tenant")), "MACHINERY")


def name_penalty():
    """What the name score takes off: for a single token, unless the folded names are equal, and for a weak alias."""
    single = (F.col("asked") != F.col("found")) & ((F.size(name_tokens(F.col("asked"))) == 1) | (F.size(name_tokens(F.col("found"))) == 1))
    return F.when(single, PARTY.single_token_penalty).otherwise(0) + F.when(F.col("weak"), PARTY.weak_alias_penalty).otherwise(0)


def evidence_arithmetic(spark, sf_dir):
    """Fuzzy matches whose stated score isn't what their features add up to; some are altered."""
    rows = P.fuzzy_matches(spark, sf_dir).withColumn("stated", F.when(F.col("record_id") % 5 == 0, F.col("score") + 1).otherwise(F.col("score")))
    weights = {k: getattr(PARTY, k) for k in ("edit", "length", "ordered", "phonetic", "alignment")}
    return R.score_arithmetic(rows.where("score > 8000 and ordered = 10000"), "record_id", weights, "stated", name_penalty()).groupBy((F.col("record_id") % 5 == 0).alias("altered")).agg(F.count_distinct("record_id").alias("records"))


QUERIES = {
    f.__name__: f
    for f in (
        review_run, observation_batch, case_membership, registrations, mapping_impact, genesis_boundary, anchor_verification, snapshot_check, response_extraction, readiness, tenant_rows, evidence_arithmetic,
    )
}

ORACLE = {
    "review_run": f"""
SELECT disposition, CASE WHEN c > 0 THEN 'completed' ELSE 'no_citations' END AS retrieval_status,
  CASE WHEN review_route = 'auto_release' THEN 'skipped_auto_clear' WHEN c = 0 THEN 'retrieval_failed' WHEN id % 13 <> 0 THEN 'draft' ELSE 'generation_failed' END AS note_status, count(*) AS n
FROM (SELECT *, len(p) + len(requires) AS c FROM ({D._decisions(4500, 8500, True)})) GROUP BY ALL
""",
    "observation_batch": f"""
SELECT codes, count(*) AS n, count(DISTINCT (request_id, candidate_id)) AS ids FROM (SELECT request_id, candidate_id, CASE WHEN score >= 400 THEN '' ELSE 'entity_type_mismatch' END AS codes
  FROM ({P.ORACLE['evidence_score']}) WHERE score >= 400 OR contains(evidence, 'entity_type_conflict')) GROUP BY 1
""",
    "case_membership": """
WITH r AS (SELECT l_orderkey AS case_id, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS alert_id, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey % 2 END AS tenant, l_quantity FROM lineitem),
a AS (SELECT DISTINCT ON (alert_id) alert_id, tenant FROM r WHERE l_quantity < 49)
SELECT case_id, count(DISTINCT r.alert_id) AS alerts, CASE WHEN bool_or(a.alert_id IS NULL) THEN 'alert_missing' WHEN count(DISTINCT a.tenant) > 1 THEN 'tenant_mismatch' END AS fault FROM r LEFT JOIN a ON r.alert_id = a.alert_id GROUP BY 1
""",
    "registrations": "SELECT CASE WHEN p_size > 25 THEN 'added' WHEN p_size = 22 THEN 'conflict' ELSE 'unchanged' END AS outcome, count(*) AS n FROM part WHERE p_size >= 20 GROUP BY 1",
    "mapping_impact": """
SELECT s_suppkey AS component, coalesce(n, 0) AS active, CASE WHEN coalesce(n, 0) = 0 THEN NULL WHEN s_nationkey <= 2 THEN 'mapped_component_missing' WHEN s_acctbal < 0 THEN 'mapped_component_retired' END AS blocker
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON l_suppkey = s_suppkey
""",
    "genesis_boundary": f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY event_id) AS n FROM ({S.sql(S.LEDGER)}))
SELECT stream, event_id, CASE WHEN n >= 11 AND event_id % 37 = 0 THEN 'hash_mismatch' ELSE 'genesis_mismatch' END AS fault FROM e WHERE (n >= 11 AND event_id % 37 = 0) OR (n = 11 AND stream % 10 = 0)
""",
    "anchor_verification": """
SELECT CASE WHEN user_id % 7 = 0 THEN 'unanchored' ELSE CASE CAST(user_id % 5 AS INT) WHEN 1 THEN 'truncated' WHEN 2 THEN 'rewritten' WHEN 3 THEN 'anchor_forged' ELSE 'verified' END END AS verdict, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1
""",
    "snapshot_check": "SELECT CASE WHEN value > 2 THEN CASE WHEN event_id % 41 = 0 THEN 'corrupt' ELSE 'verified' END WHEN value < 1 THEN 'purged' ELSE 'missing' END AS state, count(*) AS n FROM events GROUP BY 1",
    "response_extraction": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS position, 'a' || o_orderkey AS candidate_id, CAST(trunc(o_totalprice) AS BIGINT) % 1000 AS score FROM orders",
    "readiness": """
SELECT worker, f AS failed, f = '' AS ready FROM (SELECT l_suppkey AS worker, concat_ws(',', CASE WHEN count(*) <= 590 THEN 'count' END, CASE WHEN max(l_quantity) < 50 THEN 'quantity' END, CASE WHEN min(l_tax) >= 0.001 THEN 'tax' END) AS f FROM lineitem GROUP BY 1)
""",
    "tenant_rows": "SELECT c_custkey, c_mktsegment AS tenant FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "evidence_arithmetic": f"SELECT true AS altered, count(DISTINCT record_id) AS records FROM ({P.ORACLE['fuzzy_name_search']}) WHERE score > 8000 AND ordered_bp = 10000 AND record_id % 5 = 0 HAVING count(*) > 0",
}
