"""Queries of requests, provider runs, projections and stored state, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import registry as R

from . import governance as G
from .base import bound, table


def request_validation(spark, sf_dir):
    """What is wrong with requests made of orders."""
    rows = bound(spark, sf_dir, "SELECT o_orderkey AS id, o_orderpriority AS p, CAST(o_orderkey % 14 AS INT) AS k FROM {orders}")
    k = F.col("k")
    asked = rows.select(
        "id", F.when(k == 0, "other").when(k.isin(1, 2, 3), "identifier").otherwise("name").alias("kind"),
        F.when(k == 4, " ").when(k == 5, F.repeat(F.lit("é"), 300)).when(k == 6, F.concat("p", F.lit("\n"))).otherwise(F.col("p")).alias("value"),
        F.when(k.isin(1, 2), "lei").when(k == 7, "bic").alias("identifier_type"), (k.isin(2, 8)).alias("prefix"), F.when(k == 9, 101).when(k == 10, 5).alias("limit"),
        F.when(k == 11, F.array(F.lit("vessel"), F.lit("cat"))).when(k == 12, F.array(F.lit("vessel"), F.lit("vessel"))).otherwise(F.array(F.lit("vessel"))).alias("targets"),
    )
    return R.request_faults(asked, "id", 100)


def provider_ranking(spark, sf_dir):
    """Suppliers of each part as candidates: the best line of each, ranked."""
    rows = bound(spark, sf_dir, "SELECT l_partkey AS request, l_suppkey AS record_id, l_returnflag AS route, l_linestatus AS value, CAST(l_quantity AS INT) AS score, l_tax < 0.02 AS exact FROM {lineitem}")
    return R.provider_run(rows, "request", 1_000_000)


def provider_summary(spark, sf_dir):
    asked = bound(spark, sf_dir, "SELECT p_partkey AS request FROM {part} UNION ALL SELECT -1 - s_suppkey FROM {supplier}")
    return R.run_summary(provider_ranking(spark, sf_dir), asked, "request")


def scoring_projection(spark, sf_dir):
    rows = bound(spark, sf_dir, "SELECT p_partkey AS record_id, p_name, p_brand, p_type, p_size FROM {part}")
    pairs = [("brand code", F.col("p_brand")), ("Brand-Code", F.lower("p_brand")), ("x", F.lit("--"))]
    ids = F.array(*[F.struct(F.lit(t).alias("type"), v.alias("value")) for t, v in pairs])
    made = rows.select("record_id", (F.col("p_size") % 3 > 0).alias("retrievable"), F.array(F.col("p_name"), F.upper("p_name"), F.lit("  ")).alias("names"), ids.alias("identifiers"), F.array(F.lit("u-s"), F.lit("gb"), F.lit("US")).alias("countries"), F.when(F.col("p_size") > 25, "ship").otherwise("natural person").alias("type"))
    out = R.scoring_projection(made)
    pair = F.array_join(F.transform("identifiers", lambda i: F.concat_ws("=", i["type"], i["value"])), ",")
    return out.select("record_id", F.array_join("names", "|").alias("names"), pair.alias("identifiers"), F.array_join("countries", ",").alias("countries"), "type")


def projection_coverage(spark, sf_dir):
    """Whether the projection covers exactly the retrievable records, and all of them."""
    made = R.id_digest(scoring_projection(spark, sf_dir), "record_id")
    every = bound(spark, sf_dir, "SELECT p_partkey AS record_id, p_size FROM {part}")
    some, whole = R.id_digest(every.where("p_size % 3 > 0"), "record_id"), R.id_digest(every, "record_id")
    both = made.crossJoin(some.select(F.col("digest").alias("s"))).crossJoin(whole.select(F.col("digest").alias("w")))  # one row each
    return both.select("records", (F.col("digest") == F.col("s")).alias("retrievable"), (F.col("digest") == F.col("w")).alias("complete"))


def map_cleaning(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    made = F.create_map(F.lit(" segment "), F.concat(F.lit(" "), "c_mktsegment"), F.lit("segment"), F.lit("AAA"), F.lit("blank"), F.lit(" "), F.lit(" "), F.lit("x"))
    clean = R.normalised_map(made)
    return rows.select("c_custkey", F.array_join(F.transform(F.map_entries(clean), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("attributes"))


def bounded_metadata(spark, sf_dir):
    """Responses with two keys of each candidate left."""
    rows = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{"candidates": [{"score": "'), F.col("user_id").cast("string"), F.lit('", "name": "secret", "candidate_id": "c'), F.col("event_id").cast("string"), F.lit('"}], "other": 1}'))
    raw = F.when(F.col("event_id") % 3 == 0, F.lit('{"candidates": []}')).otherwise(raw)
    return rows.select("event_id", R.metadata(raw, ["candidate_id", "score"]).alias("summary"))


def token_states(spark, sf_dir):
    """States of tokens issued at events, on a day."""
    rows = table(spark, sf_dir, "events")
    life = F.when(F.col("event_id") % 7 == 0, 0).when(F.col("event_id") % 7 == 1, 31 * 24).otherwise(24 * 10)
    issued = F.col("ts").cast("timestamp")
    state = R.token_state(issued, F.timestamp_add("HOUR", life, issued), F.col("user_id") % 3, F.lit(1), F.lit("2024-01-20 00:00:00").cast("timestamp"), 30 * 24 * 3600)
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def source_index(spark, sf_dir):
    """Entities by the key of their active memberships."""
    rows = bound(spark, sf_dir, "SELECT s_suppkey AS entity_id, s_nationkey AS n FROM {supplier}")
    one = F.struct(F.lit("a").alias("source"), F.lit("l").alias("list"), F.col("n").cast("string").alias("record"), (F.col("entity_id") % 4 > 0).alias("active"))
    two = F.struct(F.lit("b").alias("source"), F.lit("m").alias("list"), F.col("entity_id").cast("string").alias("record"), F.lit(True).alias("active"))
    return R.source_index(rows.select("entity_id", F.array(one, two).alias("memberships")))


def acknowledgements(spark, sf_dir):
    """Outcomes of instances' acknowledgements in the phases that their intents are in."""
    phases = G.promotion_phases(spark, sf_dir).select("intent", "phase")
    acks = bound(spark, sf_dir, "SELECT user_id * 10 + CAST(event_id % 9 AS INT) AS intent, CAST(event_id % 4 AS INT) AS instance, event_id, CASE WHEN value > 5 THEN 'ready' ELSE 'not_ready' END AS status FROM {events}")
    return R.acknowledged(acks, phases, "intent", "instance", "event_id").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def purged_snapshots(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props", "event_type")
    return R.purged(rows, rows.where("event_id % 10 = 3"), "event_id", ["props"])


def activation_check(spark, sf_dir):
    """What disagrees in an activation whose projection is of another version."""
    part = lambda v, p: spark.createDataFrame([("c", v, p)], "component string, version string, profile string")
    return R.activation_faults(part("1", "n"), part("2", "n"), part("1", "n"))


def assistance(spark, sf_dir):
    """Statuses of conversations as requests: canned answers for some of their prompts."""
    asked = G.note_prompts(spark, sf_dir).withColumnRenamed("conv_id", "request_id")
    answers = asked.where("request_id % 4 > 0").select("prompt_sha256", F.when(F.col("request_id") % 5 == 0, "please Clear this alert").otherwise("ok").alias("answer"))
    found = table(spark, sf_dir, "conversations").where("conv_id % 6 > 0").select(F.col("conv_id").alias("request_id"))
    return R.assisted(asked, found, answers.dropDuplicates(["prompt_sha256"]), ["clear this"])


QUERIES = {
    f.__name__: f
    for f in (
        request_validation, provider_ranking, provider_summary, scoring_projection, projection_coverage, map_cleaning, bounded_metadata, token_states, source_index, acknowledgements,
        purged_snapshots, activation_check, assistance,
    )
}

_RANKED = """
SELECT * EXCLUDE (b), row_number() OVER (PARTITION BY request ORDER BY score DESC, exact DESC, record_id, route, value) AS rank FROM (SELECT l_partkey AS request, l_suppkey AS record_id, l_returnflag AS route, l_linestatus AS value,
  CAST(l_quantity AS INT) AS score, l_tax < 0.02 AS exact, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CAST(l_quantity AS INT) DESC, l_tax < 0.02 DESC, l_returnflag, l_linestatus) AS b FROM lineitem) WHERE b = 1
"""
ORACLE = {
    "request_validation": """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 14 AS INT) WHEN 0 THEN 'unknown_kind' WHEN 2 THEN 'prefix_not_allowed' WHEN 3 THEN 'identifier_type_required' WHEN 4 THEN 'value_required' WHEN 5 THEN 'value_too_long' WHEN 6 THEN 'control_character'
  WHEN 7 THEN 'identifier_type_not_allowed' WHEN 9 THEN 'limit_out_of_range' WHEN 11 THEN 'unknown_target' WHEN 12 THEN 'repeated_target' END AS fault FROM orders WHERE o_orderkey % 14 NOT IN (1, 8, 10, 13)
""",
    "provider_ranking": _RANKED,
    "provider_summary": f"""
WITH r AS ({_RANKED}), q AS (SELECT p_partkey AS request FROM part UNION ALL SELECT -1 - s_suppkey FROM supplier), n AS (SELECT request, count(*) AS n, count(*) FILTER (exact) AS e FROM r GROUP BY 1)
SELECT count(*) FILTER (n > 0) AS matched, count(*) FILTER (n IS NULL) AS no_candidates, sum(n)::BIGINT AS candidates, sum(e)::BIGINT AS exact FROM q LEFT JOIN n USING (request)
""",
    "scoring_projection": "SELECT p_partkey AS record_id, upper(p_name) AS names, 'BRAND_CODE=' || replace(upper(p_brand), '#', '') AS identifiers, 'GB,US' AS countries, CASE WHEN p_size > 25 THEN 'VESSEL' ELSE 'PERSON' END AS type FROM part WHERE p_size % 3 > 0",
    "projection_coverage": "SELECT count(*) AS records, true AS retrievable, false AS complete FROM part WHERE p_size % 3 > 0",
    "map_cleaning": "SELECT c_custkey, 'segment=' || greatest(c_mktsegment, 'AAA') AS attributes FROM customer",
    "bounded_metadata": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '[{"candidate_id":"c' || event_id || '","score":"' || user_id || '"}]' END AS summary FROM events""",
    "token_states": """
SELECT CASE WHEN event_id % 7 IN (0, 1) THEN 'invalid_lifetime' WHEN TIMESTAMP '2024-01-20' < ts THEN 'not_yet_valid' WHEN TIMESTAMP '2024-01-20' >= ts + INTERVAL 240 HOUR THEN 'expired' WHEN user_id % 3 <> 1 THEN 'session_revoked' ELSE 'valid' END AS state,
  count(*) AS n FROM events GROUP BY 1
""",
    "source_index": "SELECT 'a' AS source, 'l' AS list, s_nationkey::VARCHAR AS record, max(s_suppkey) AS entity_id FROM supplier WHERE s_suppkey % 4 > 0 GROUP BY s_nationkey UNION ALL SELECT 'b', 'm', s_suppkey::VARCHAR, s_suppkey FROM supplier",
    "acknowledgements": f"""
WITH p AS ({G.ORACLE['promotion_phases']}), a AS (SELECT user_id * 10 + event_id % 9 AS intent, event_id % 4 AS instance, event_id, value > 5 AS s FROM events),
o AS (SELECT CASE WHEN phase NOT IN ('validated', 'canary') THEN 'wrong_phase' WHEN row_number() OVER w = 1 THEN 'recorded' WHEN s = first_value(s) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM a JOIN p USING (intent) WINDOW w AS (PARTITION BY intent, instance ORDER BY event_id))
SELECT outcome, count(*) AS n FROM o GROUP BY 1
""",
    "purged_snapshots": "SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN props END AS props, event_type, event_id % 10 = 3 AS purged FROM events",
    "activation_check": "SELECT 'version' AS fault",
    "assistance": """
SELECT DISTINCT conv_id AS request_id, CASE WHEN conv_id % 6 = 0 THEN 'insufficient_context' WHEN conv_id % 4 = 0 THEN 'generation_failed' WHEN conv_id % 5 = 0 THEN 'guardian_blocked' ELSE 'completed' END AS status FROM conversations
""",
}
