"""Queries of catalog versions and sources, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import catalog as C

from .base import bound, sql

BASE = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size FROM {part} WHERE p_size <> 7"
#: The next version: size 7 is added, size 50 removed, brands change for size 11, name and brand for size 12.
TARGET = """
SELECT p_partkey AS id, CASE WHEN p_size = 12 THEN p_name || ' II' ELSE p_name END AS name,
       CASE WHEN p_size IN (11, 12) THEN 'Brand#0' ELSE p_brand END AS brand, p_size AS size FROM {part} WHERE p_size <> 50
"""


def catalog_changes(spark, sf_dir):
    diff = C.differences(bound(spark, sf_dir, BASE), bound(spark, sf_dir, TARGET), "id")
    return diff.select("id", "change", F.array_join("changed", ",").alias("changed"))


def catalog_metrics(spark, sf_dir):
    """Totals, ratios and what becomes of the delta."""
    diff = C.differences(bound(spark, sf_dir, BASE), bound(spark, sf_dir, TARGET), "id")
    return C.promotion(C.metrics(diff), C.PromotionPolicy(max_operations=100, max_change_bp=900, max_deletion_bp=200)).withColumn("reasons", F.array_join("reasons", ","))


def catalog_delta(spark, sf_dir):
    diff = C.differences(bound(spark, sf_dir, BASE), bound(spark, sf_dir, TARGET), "id")
    return C.delta(diff, "id").select("id", "operation", F.col("after.name").alias("name"), F.col("after.brand").alias("brand"))


def catalog_applied(spark, sf_dir):
    """The base with its delta applied, which must be the target."""
    base = bound(spark, sf_dir, BASE)
    return C.applied(base, C.delta(C.differences(base, bound(spark, sf_dir, TARGET), "id"), "id"), "id")


def catalog_digest_equal(spark, sf_dir):
    """Digests of the target and of the base with the delta applied."""
    base, target = bound(spark, sf_dir, BASE), bound(spark, sf_dir, TARGET)
    made = C.digest(C.applied(base, C.delta(C.differences(base, target, "id"), "id"), "id"), "id")
    other = C.digest(base, "id").select(F.col("digest").alias("base_digest"))
    both = C.digest(target, "id").crossJoin(made.select(F.col("digest").alias("made"))).crossJoin(other)  # three rows of one digest each
    return both.select("records", (F.col("digest") == F.col("made")).alias("rebuilt"), (F.col("digest") == F.col("base_digest")).alias("same_as_base"))


def source_comparison(spark, sf_dir):
    left = bound(spark, sf_dir, "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM {customer} WHERE c_nationkey <> 3")
    right = bound(spark, sf_dir, "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_nationkey = 5 THEN 'X' ELSE c_mktsegment END AS segment, CASE WHEN c_nationkey IN (5, 6) THEN 99 ELSE c_nationkey END AS nation FROM {customer} WHERE c_nationkey <> 4")
    return C.compared(left, right, "id", ["name", "segment", "nation"]).withColumn("differs", F.array_join("differs", ","))


def comparison_summary(spark, sf_dir):
    return source_comparison(spark, sf_dir).groupBy("state", "differs").agg(F.count(F.lit(1)).alias("n"))


OVERLAY = """
SELECT s_suppkey AS id, CAST(9000 + {k} * (s_suppkey % 3) AS INT) AS score, s_suppkey % 2 = {m} AS exact, '{r}' AS route, s_name AS value, s_nationkey AS nation
FROM {supplier} WHERE s_nationkey % 3 <> {m}
"""


def overlay(spark, sf_dir):
    """Candidates of a source and of the official one: the better, with merged sources and attributes."""

    def side(k, m, r, label):
        df = bound(spark, sf_dir, OVERLAY.replace("{k}", k).replace("{m}", m).replace("{r}", r))
        attrs = F.create_map(F.lit("origin"), F.lit(label), F.lit(label), F.col("nation").cast("string"))
        return df.withColumns({"sources": F.array(F.lit(label), F.lit("shared")), "attributes": attrs})

    out = C.overlaid(side("100", "0", "alias", "provider"), side("-100", "1", "name", "official"), "id")
    return out.select("id", "score", "exact", "route", F.array_join("sources", ",").alias("sources"), F.element_at("attributes", "origin").alias("origin"), F.size("attributes").cast("long").alias("n_attributes"))


def membership_merge(spark, sf_dir):
    """Programmes and activity of suppliers, merged over line items."""
    rows = bound(spark, sf_dir, "SELECT l_suppkey AS supplier, l_returnflag AS list, l_linestatus AS status, l_quantity > 49 AS active FROM {lineitem}")
    return C.memberships(rows.withColumn("programs", F.array("status")), ["supplier", "list"]).withColumn("programs", F.array_join("programs", ","))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_changes, catalog_metrics, catalog_delta, catalog_applied, catalog_digest_equal, source_comparison, comparison_summary, overlay, membership_merge,
    )
}

_CHANGES = f"""
SELECT id, CASE WHEN t.name IS NULL THEN 'removed' WHEN b.name IS NULL THEN 'added' WHEN b.name <> t.name OR b.brand <> t.brand THEN 'modified' ELSE 'unchanged' END AS change,
  CASE WHEN b.name IS NULL OR t.name IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.brand <> t.brand THEN 'brand' END, CASE WHEN b.name <> t.name THEN 'name' END) END AS changed,
  t.name, t.brand
FROM ({sql(BASE)}) b FULL JOIN ({sql(TARGET)}) t USING (id)
"""
_COUNTS = f"SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged FROM ({_CHANGES})"
_SOURCES = """
SELECT id, CASE WHEN c_nationkey = 3 THEN 'right_only' WHEN c_nationkey = 4 THEN 'left_only' WHEN c_nationkey IN (5, 6) THEN 'linked_different' ELSE 'linked_equal' END AS state,
  CASE WHEN c_nationkey = 5 THEN 'nation,segment' WHEN c_nationkey = 6 THEN 'nation' ELSE '' END AS differs FROM (SELECT c_custkey AS id, c_nationkey FROM customer)
"""
ORACLE = {
    "catalog_changes": f"SELECT id, change, changed FROM ({_CHANGES})",
    "catalog_metrics": f"""
SELECT *, CASE WHEN r = '' THEN 'promote_delta' ELSE 'force_full_rebuild' END AS outcome, CASE WHEN r = '' THEN 'delta_within_policy' ELSE r END AS reasons FROM (
  SELECT *, concat_ws(',', CASE WHEN added + removed + modified > 100 THEN 'operation_limit_exceeded' END, CASE WHEN change_bp >= 900 THEN 'change_ratio_threshold' END,
    CASE WHEN deletion_bp >= 200 THEN 'deletion_ratio_threshold' END) AS r FROM (
  SELECT *, removed + modified + unchanged AS base_records, added + modified + unchanged AS target_records,
    (added + removed + modified) * 10000 // greatest(removed, added) // 1 AS x,
    (added + removed + modified) * 10000 // (greatest(removed, added) + modified + unchanged) AS change_bp, removed * 10000 // (removed + modified + unchanged) AS deletion_bp
  FROM ({_COUNTS})))
""".replace("    (added + removed + modified) * 10000 // greatest(removed, added) // 1 AS x,\n", "").replace("SELECT *, CASE WHEN r = ''", "SELECT * EXCLUDE (r), CASE WHEN r = ''"),
    "catalog_delta": f"SELECT id, CASE change WHEN 'added' THEN 'add' WHEN 'removed' THEN 'remove' ELSE 'replace' END AS operation, name, brand FROM ({_CHANGES}) WHERE change <> 'unchanged'",
    "catalog_applied": sql(TARGET),
    "catalog_digest_equal": f"SELECT count(*) AS records, true AS rebuilt, false AS same_as_base FROM ({sql(TARGET)})",
    "source_comparison": _SOURCES,
    "comparison_summary": f"SELECT state, differs, count(*) AS n FROM ({_SOURCES}) GROUP BY ALL",
    "overlay": """
WITH b AS (SELECT s_suppkey AS id, CAST(9000 + 100 * (s_suppkey % 3) AS INT) AS score, s_suppkey % 2 = 0 AS exact, 'alias' AS route FROM supplier WHERE s_nationkey % 3 <> 0),
o AS (SELECT s_suppkey AS id, CAST(9000 - 100 * (s_suppkey % 3) AS INT) AS score, s_suppkey % 2 = 1 AS exact, 'name' AS route FROM supplier WHERE s_nationkey % 3 <> 1),
j AS (SELECT id, b.score AS bs, o.score AS os, b.exact AS be, o.exact AS oe, b.route AS br, o.route AS r2 FROM b FULL JOIN o USING (id)),
w AS (SELECT *, os IS NULL OR (bs IS NOT NULL AND (bs > os OR (bs = os AND (be AND NOT oe OR be = oe)))) AS bw FROM j)
SELECT id, CASE WHEN bw THEN bs ELSE os END AS score, CASE WHEN bw THEN be ELSE oe END AS exact, CASE WHEN bw THEN br ELSE r2 END AS route,
  CASE WHEN bs IS NULL THEN 'official,shared' WHEN os IS NULL THEN 'provider,shared' ELSE 'official,provider,shared' END AS sources,
  CASE WHEN os IS NULL THEN 'provider' ELSE 'official' END AS origin, CAST(CASE WHEN bs IS NULL OR os IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n_attributes FROM w
""",
    "membership_merge": "SELECT l_suppkey AS supplier, l_returnflag AS list, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS programs, bool_or(l_quantity > 49) AS active FROM lineitem GROUP BY ALL",
}
