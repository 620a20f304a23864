"""Queries of patterns, policy and mappings, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import decision as D
from tamis.operators import mapping as M

from .base import bound, sql

#: An observation for each order: texts, kinds and routes by the order's key, lists joined with commas.
OBSERVATIONS = """
SELECT o_orderkey AS id,
  CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN 'payment to ACMEBANKING ltd' WHEN 1 THEN 'Acme Bank, London' WHEN 2 THEN 'do not pay acme bank' WHEN 3 THEN 'XACMEXX9'
    WHEN 4 THEN 'bankruptcy trustee for Acme' WHEN 5 THEN 'legacy padding 12' WHEN 6 THEN 'ref 0000000000-1' WHEN 7 THEN 'acme' WHEN 8 THEN 'Receiver' WHEN 9 THEN 'DEUT ACME FF' ELSE o_orderpriority END AS input_value,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'Acme Bank' WHEN 1 THEN 'ACME' ELSE 'Acme-Shipping Trust' END AS watchlist_value,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'bic' WHEN 1 THEN 'party_name' WHEN 2 THEN 'payment_reference' WHEN 3 THEN 'iban' ELSE 'narrative' END AS value_type,
  CASE CAST(o_custkey % 6 AS INT) WHEN 0 THEN 'exact_bic' WHEN 1 THEN 'exact_lei' WHEN 2 THEN 'exact_account' WHEN 3 THEN 'normalized_name' WHEN 4 THEN 'alias' ELSE 'exact_date' END AS route,
  CASE WHEN o_custkey % 4 = 0 THEN 'supporting_evidence' ELSE 'candidate_alert' END AS trigger,
  CASE WHEN o_custkey % 9 = 0 THEN 'vessel' ELSE 'organization' END AS candidate_type,
  o_custkey % 2 = 0 AS exact, CAST(7000 + o_custkey % 3001 AS INT) AS score,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'organization,person' END AS target_types,
  CASE WHEN o_orderkey % 17 = 0 THEN 'plc,bank' ELSE '' END AS required, CASE WHEN o_orderkey % 8 = 0 THEN 'Bank,shipping,Trust' ELSE '' END AS present,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'transliteration_only' WHEN 1 THEN 'name_fuzzy_edit,name_fuzzy_phonetic' WHEN 2 THEN 'name_fuzzy_phonetic' ELSE '' END AS reasons,
  CASE WHEN o_orderkey % 19 = 0 THEN 'entity_type_mismatch' WHEN o_orderkey % 23 = 0 THEN 'narrative_denial_context' ELSE '' END AS diagnostics,
  CASE WHEN o_orderkey % 10 = 3 THEN 'passport' ELSE '' END AS secondary, CASE WHEN o_orderkey % 29 = 0 THEN 'batch' ELSE '' END AS technical,
  CASE WHEN o_orderkey % 31 = 0 THEN 'for x' ELSE '' END AS context
FROM {orders}
"""
LISTS = [c for c, t in D.COLUMNS.items() if t.startswith("array")]


def observations(spark, sf_dir):
    rows = bound(spark, sf_dir, OBSERVATIONS)
    return rows.withColumns({c: F.filter(F.split(c, ","), lambda x: x != "") for c in LISTS})


def pattern_classification(spark, sf_dir):
    """Patterns, support, route and blockers of each observation."""
    out = D.classified(observations(spark, sf_dir))
    joined = [F.array_join(c, ",").alias(c) for c in ("patterns", "blockers", "requires")]
    return out.select("id", *joined, *[F.col(c).cast("long").alias(c) for c in ("strongest", "release", "countervailing")], "route_hint")


def pattern_summary(spark, sf_dir):
    """How often each pattern meets each route."""
    out = D.classified(observations(spark, sf_dir))
    return out.select("route_hint", F.explode("patterns").alias("pattern")).groupBy("route_hint", "pattern").agg(F.count(F.lit(1)).alias("n"))


def policy_decision(spark, sf_dir):
    out = D.disposed(D.classified(observations(spark, sf_dir)))
    return out.select("id", "policy_score", "disposition", "review_route", F.array_join("policy_reasons", ",").alias("reasons"))


def policy_overlay_summary(spark, sf_dir):
    """Dispositions under a tenant's policy, which clears nothing by itself and weighs screening more."""
    out = D.disposed(D.classified(observations(spark, sf_dir)), {"auto_clear": 0, "screening": 6000, "escalate_least": 8000})
    return out.groupBy("disposition", "review_route").agg(F.count(F.lit(1)).alias("n"), F.sum("policy_score").alias("score"))


#: Mapping versions: a customer's segment is bound from each order on, a day a version; some end, some retire.
VERSIONS = """
SELECT o_custkey AS mapping, CAST(o_orderdate AS DATE) AS effective_from, max(o_orderkey) AS version_id,
       CASE WHEN max(o_orderkey) % 3 = 0 THEN max(CAST(o_orderdate AS DATE)) + 90 END AS effective_to,
       CASE WHEN max(o_orderkey) % 7 = 0 THEN 'retire' ELSE 'bind' END AS action, max(o_orderkey) % 50 AS component
FROM {orders} GROUP BY o_custkey, CAST(o_orderdate AS DATE)
"""
ASKED = "SELECT l_orderkey * 10 + l_linenumber AS request_id, l_suppkey * 17 + l_linenumber * 100 AS mapping, CAST(l_shipdate AS DATE) AS asked_on FROM {lineitem}"
COMPONENTS = "SELECT s_suppkey AS component, CASE WHEN s_suppkey % 5 = 0 THEN 'retired' ELSE 'active' END AS status, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey * 10 END AS pointer FROM {supplier} WHERE s_suppkey < 45"


def mapping_resolution(spark, sf_dir):
    """Status of each request: the mapping in force at its date, its component and that one's active version."""
    asked, versions = bound(spark, sf_dir, ASKED), bound(spark, sf_dir, VERSIONS)
    known = versions.select("mapping").distinct().withColumn("known", F.lit(True))
    found = M.latest_at(asked, versions, "mapping", "asked_on", "effective_from").join(known, "mapping", "left")
    components = bound(spark, sf_dir, COMPONENTS).withColumnRenamed("component", "c")
    both = found.join(components, F.col("version.component") == F.col("c"), "left")
    status = M.resolution(F.coalesce("known", F.lit(False)), F.col("version"), F.col("asked_on"), F.col("status"), F.col("pointer"))
    return both.select("request_id", status.alias("resolution"), F.when(F.col("known"), F.col("version.version_id")).alias("version_id"), F.when(status == "resolved", F.col("pointer")).alias("pointer"))


def mapping_summary(spark, sf_dir):
    return mapping_resolution(spark, sf_dir).groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


TIMELINE = "SELECT o_custkey AS mapping, o_orderkey AS number, o_orderdate AS effective_from, o_orderkey AS ident, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, o_totalprice FROM {orders}"


def mapping_timeline(spark, sf_dir):
    """Faults of timelines; some versions name no predecessor."""
    rows = bound(spark, sf_dir, TIMELINE).withColumn("supersedes", F.when(F.col("o_totalprice") < 450000, F.col("prev")))
    out = M.timeline_faults(rows, "mapping", "number", "effective_from", "ident", "supersedes")
    return out.where("fault is not null").select("mapping", "number", "fault")


def activation_sequence(spark, sf_dir):
    """Epochs of each customer's activations, and those that expected another active version."""
    rows = bound(spark, sf_dir, TIMELINE).withColumn("expected", F.when(F.col("o_totalprice") > 400000, F.lit(-1)).otherwise(F.col("prev")))
    return M.activations(rows, "mapping", "number", "ident", "expected").select("mapping", "ident", "epoch", "verdict")


OLD = "SELECT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR(9)) AS ref, count(*) AS n FROM {customer} WHERE c_nationkey <> 9 GROUP BY c_mktsegment, c_nationkey"
NEW = "SELECT CASE WHEN c_nationkey = 2 THEN 'new-' || c_mktsegment ELSE c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR(9)) END AS ref, count(*) AS n FROM {customer} WHERE c_nationkey <> 4 AND c_acctbal > 0 GROUP BY c_mktsegment, c_nationkey"
RENAMES = "SELECT DISTINCT c_mktsegment || '-2' AS old_ref, 'new-' || c_mktsegment AS new_ref FROM {customer}"


def inventory_changes(spark, sf_dir):
    return M.inventory_changes(bound(spark, sf_dir, OLD), bound(spark, sf_dir, NEW), bound(spark, sf_dir, RENAMES), "ref", "n")


QUERIES = {
    f.__name__: f
    for f in (
        pattern_classification, pattern_summary, policy_decision, policy_overlay_summary, mapping_resolution, mapping_summary, mapping_timeline, activation_sequence, inventory_changes,
    )
}

_K = r"trim(regexp_replace(upper({0}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
_L = r"list_filter(string_split({0}, ','), lambda t: t <> '')"
_q = "[" + ", ".join(f"'{q}'" for q in D.QUALIFIERS) + "]"
_any = lambda v, ps: "(" + " OR ".join(f"contains({v}, '{p}')" for p in ps) + ")"
_in = lambda ps: "(" + ", ".join(f"'{p}'" for p in ps) + ")"


def _case(table: dict, at: int, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v[at] if isinstance(v[at], int) else repr(v[at])}" for k, v in table.items()) + " END"


def _classes() -> str:
    keyed = f"""
SELECT *, {_K.format('input_value')} AS k, {_K.format('watchlist_value')} AS w, replace({_K.format('input_value')}, ' ', '') AS kc, replace({_K.format('watchlist_value')}, ' ', '') AS wc,
  list_transform({_L.format('required')}, lambda t: upper(t)) AS rq, list_transform({_L.format('present')}, lambda t: upper(t)) AS pr, {_L.format('reasons')} AS rs
FROM ({sql(OBSERVATIONS)})"""
    asked = f"CASE WHEN len(rq) > 0 THEN rq ELSE list_filter(string_split(w, ' '), lambda t: list_contains({_q}, t)) END"
    tests = {
        "acronym_collision": "length(wc) BETWEEN 2 AND 5 AND NOT (exact AND route = 'exact_bic') AND value_type IN ('payment_reference', 'account_identifier', 'iban', 'uetr') AND contains(kc, wc)",
        "entity_type_mismatch": "diagnostics = 'entity_type_mismatch' OR (target_types <> '' AND NOT list_contains(string_split(target_types, ','), candidate_type))",
        "legal_control_context": _any("trim(k || ' ' || upper(context))", D.LEGAL),
        "missing_qualifier": f"len(list_filter({asked}, lambda t: NOT list_contains(list_concat(string_split(k, ' '), pr), t))) > 0",
        "narrative_denial_context": f"diagnostics = 'narrative_denial_context' OR {_any('k', D.DENIALS)}",
        "phonetic_transliteration_only": f"NOT exact AND secondary = '' AND len(rs) > 0 AND len(list_filter(rs, lambda t: t NOT IN {_in(D.FOLD_REASONS)})) = 0",
        "routing_bic_collision": "value_type = 'bic' AND route <> 'exact_bic' AND length(wc) BETWEEN 2 AND 5 AND contains(kc, wc)",
        "substring_containment": "length(wc) >= 3 AND kc <> wc AND contains(kc, wc) AND NOT contains(' ' || k || ' ', ' ' || w || ' ')",
        "technical_system_artifact": f"technical <> '' OR {_any('k', D.ARTEFACTS)} OR {_any('kc', ['0' * 10, 'X' * 10])}",
        "wrong_field_data_type": f"value_type IN {_in(D.DATA_TYPES)} AND route IN {_in(D.NAME_ROUTES)}",
    }
    found = ", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, t in tests.items())
    eligible = "exact AND route IN ('exact_bic', 'exact_lei')"
    return f"""
SELECT id, score, trigger, p, sig, CASE WHEN len(p) = 0 THEN 0 ELSE list_max(list_transform(p, lambda x: {_case(D.PATTERNS, 0, 'x')})) END AS strongest,
  least(10000, coalesce(list_sum(list_transform(list_filter(p, lambda x: {_case(D.PATTERNS, 1, 'x')} = '{D.CLEAR}'), lambda x: {_case(D.PATTERNS, 0, 'x')})), 0)) AS release,
  least(10000, coalesce(list_sum(sig), 0)) AS countervailing,
  CASE WHEN len(sig) > 0 THEN CASE WHEN len(p) > 0 THEN 'investigate' WHEN trigger = 'candidate_alert' AND {eligible} THEN 'escalation_candidate' ELSE 'investigate' END
    WHEN list_contains(p, 'legal_control_context') THEN 'manual_review'
    WHEN len(list_filter(p, lambda x: {_case(D.PATTERNS, 1, 'x')} = '{D.CLEAR}')) > 0 THEN '{D.CLEAR}' ELSE 'investigate' END AS route_hint,
  list_sort(list_filter(list_concat(list_transform(p, lambda x: {_case(D.PATTERNS, 2, 'x')}), [CASE WHEN len(sig) > 0 AND trigger <> 'candidate_alert' THEN 'supporting_evidence_cannot_escalate'
    WHEN len(sig) > 0 AND NOT ({eligible}) THEN 'primary_identifier_required' END]), lambda x: x IS NOT NULL)) AS blockers,
  list_sort(list_filter([CASE WHEN list_contains(p, 'phonetic_transliteration_only') THEN 'secondary_identifier' END, CASE WHEN list_contains(p, 'legal_control_context') THEN 'legal_control_documentation' END,
    CASE WHEN len(sig) > 0 AND trigger <> 'candidate_alert' THEN 'qualifying_candidate_alert' WHEN len(sig) > 0 AND NOT ({eligible}) THEN 'primary_identifier' END], lambda x: x IS NOT NULL)) AS requires
FROM (SELECT *, list_filter([{found}], lambda x: x IS NOT NULL) AS p,
  list_filter([CASE WHEN exact THEN {_case(D.EXACT_ROUTES, 0, 'route')} END, CASE WHEN secondary <> '' THEN 9000 END], lambda x: x IS NOT NULL) AS sig FROM ({keyed}))"""


def _decisions(screening: int, escalate: int, auto_clear: bool) -> str:
    rank = "CASE {0} WHEN 'clear' THEN 0 WHEN 'investigate' THEN 1 ELSE 2 END"
    pattern = "list_min(list_transform(p, lambda x: " + rank.format("(" + _case(D.PATTERNS, 4, "x") + ")") + "))"
    blocker = "list_min(list_transform(blockers, lambda x: CASE x " + " ".join(f"WHEN '{b}' THEN {0 if m == 'clear' else 1}" for b, m in D.BLOCKERS.items()) + " END))"
    scored = f"""
SELECT *, least(10000, greatest(0, score * {screening} // 10000 + countervailing * 4000 // 10000 - release * 5000 // 10000 + coalesce(list_sum(list_transform(p, lambda x: {_case(D.PATTERNS, 3, 'x')})), 0)))::BIGINT AS policy_score,
  least(coalesce({pattern}, 2), coalesce({blocker}, 2), CASE WHEN route_hint IN ('{D.CLEAR}', 'escalation_candidate') THEN 2 ELSE 1 END) AS lim FROM ({_classes()})"""
    return f"""
SELECT *, CASE disposition WHEN 'escalate' THEN 'escalation_review' WHEN 'clear' THEN 'auto_release' ELSE CASE WHEN route_hint = 'manual_review' THEN 'manual_review' ELSE 'standard_review' END END AS review_route FROM (
SELECT *, CASE WHEN policy_score >= {escalate} AND trigger = 'candidate_alert' AND countervailing >= 9000 AND len(blockers) = 0 AND lim >= 2 THEN 'escalate'
  WHEN {str(auto_clear).lower()} AND route_hint = '{D.CLEAR}' AND release >= 7000 AND policy_score <= 2500 THEN 'clear' ELSE 'investigate' END AS disposition FROM ({scored}))"""


_RESOLVED = f"""
WITH v AS ({sql(VERSIONS)}), a AS ({sql(ASKED)}), c AS ({sql(COMPONENTS)}), k AS (SELECT DISTINCT mapping FROM v),
j AS (SELECT a.request_id, a.asked_on, k.mapping IS NOT NULL AS known, v.* EXCLUDE (mapping) FROM a LEFT JOIN k ON a.mapping = k.mapping
  LEFT JOIN v ON v.mapping = a.mapping AND v.effective_from <= a.asked_on QUALIFY row_number() OVER (PARTITION BY a.request_id, a.mapping, a.asked_on ORDER BY v.effective_from DESC NULLS LAST) = 1),
r AS (SELECT j.*, c.status, c.pointer FROM j LEFT JOIN c USING (component))
SELECT request_id, resolution, version_id, CASE WHEN resolution = 'resolved' THEN pointer END AS pointer FROM (
SELECT *, CASE WHEN NOT known THEN 'unmapped' WHEN version_id IS NULL THEN 'not_effective' WHEN effective_to IS NOT NULL AND asked_on >= effective_to THEN 'expired' WHEN action = 'retire' THEN 'retired'
  WHEN status IS NULL THEN 'component_missing' WHEN status <> 'active' THEN 'component_retired' WHEN pointer IS NULL THEN 'catalog_not_active' ELSE 'resolved' END AS resolution FROM r)
"""
ORACLE = {
    "pattern_classification": f"SELECT id, array_to_string(p, ',') AS patterns, array_to_string(blockers, ',') AS blockers, array_to_string(requires, ',') AS requires, strongest::BIGINT AS strongest, release::BIGINT AS release, countervailing::BIGINT AS countervailing, route_hint FROM ({_classes()})",
    "pattern_summary": f"SELECT route_hint, pattern, count(*) AS n FROM (SELECT route_hint, unnest(p) AS pattern FROM ({_classes()})) GROUP BY ALL",
    "policy_decision": f"""
SELECT id, policy_score, disposition, review_route, array_to_string(list_sort(list_filter(list_concat(list_transform(p, lambda x: 'fp_' || x), [
  CASE route_hint WHEN '{D.CLEAR}' THEN 'route_clear_eligible' ELSE 'route_' || route_hint END,
  CASE disposition WHEN 'escalate' THEN 'policy_escalate_primary_identifier' WHEN 'clear' THEN 'policy_clear_release_support' ELSE 'policy_investigate' END,
  CASE disposition WHEN 'investigate' THEN 'policy_threshold_evaluation' END, CASE WHEN trigger = 'supporting_evidence' THEN 'policy_supporting_evidence_non_escalation' END]), lambda x: x IS NOT NULL)), ',') AS reasons
FROM ({_decisions(4500, 8500, True)})""",
    "policy_overlay_summary": f"SELECT disposition, review_route, count(*) AS n, sum(policy_score)::BIGINT AS score FROM ({_decisions(6000, 8000, False)}) GROUP BY ALL",
    "mapping_resolution": _RESOLVED,
    "mapping_summary": f"SELECT resolution, count(*) AS n FROM ({_RESOLVED}) GROUP BY 1",
    "mapping_timeline": f"""
SELECT mapping, number, fault FROM (SELECT *, CASE WHEN effective_from <= lag(effective_from) OVER w THEN 'start_not_advancing'
  WHEN (CASE WHEN o_totalprice < 450000 THEN prev END) IS DISTINCT FROM prev THEN 'supersedes_mismatch' END AS fault FROM ({sql(TIMELINE)}) WINDOW w AS (PARTITION BY mapping ORDER BY number)) WHERE fault IS NOT NULL
""",
    "activation_sequence": f"SELECT mapping, ident, row_number() OVER (PARTITION BY mapping ORDER BY number) AS epoch, CASE WHEN o_totalprice > 400000 THEN 'conflict' ELSE 'ok' END AS verdict FROM ({sql(TIMELINE)})",
    "inventory_changes": f"""
WITH o AS (SELECT coalesce(new_ref, o.ref) AS ref, o.ref AS old_ref, n AS b FROM ({sql(OLD)}) o LEFT JOIN ({sql(RENAMES)}) r ON o.ref = r.old_ref), n AS ({sql(NEW)})
SELECT ref, CASE WHEN n.n IS NULL THEN 'removed' WHEN b IS NULL THEN 'added' WHEN old_ref <> ref THEN 'renamed' ELSE 'unchanged' END AS change,
  CASE WHEN n.n IS NOT NULL AND b IS NOT NULL AND old_ref <> ref THEN old_ref END AS renamed_from, round(abs(n.n - b) / b::DOUBLE * 1e6) / 1e4 AS delta_percent
FROM o FULL JOIN n USING (ref)
""",
}
