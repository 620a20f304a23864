"""False-positive patterns of an observation, countervailing signals, the route, and the policy's disposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.similarity import div
from tamis.functions.text import compact, fields, text_key

CLEAR, INVESTIGATE, MANUAL, ESCALATE = "clear_or_auto_release_eligible", "investigate", "manual_review", "escalation_candidate"
ALERT = "candidate_alert"
# fixed values: strength, route, blocker, score adjustment and highest disposition of each pattern
PATTERNS = {
    "acronym_collision": (8500, CLEAR, "acronym_field_collision", -1500, "clear"),
    "entity_type_mismatch": (9000, INVESTIGATE, "entity_type_conflict", -1500, "investigate"),
    "legal_control_context": (8500, MANUAL, "legal_control_evidence_required", 0, "investigate"),
    "missing_qualifier": (7000, INVESTIGATE, "missing_critical_watchlist_terms", -1000, "investigate"),
    "narrative_denial_context": (10000, CLEAR, "denial_context", -2500, "clear"),
    "phonetic_transliteration_only": (7500, INVESTIGATE, "secondary_identifier_missing", -500, "investigate"),
    "routing_bic_collision": (9000, CLEAR, "routing_code_collision", -1500, "clear"),
    "substring_containment": (9500, CLEAR, "substring_only_match", -1500, "clear"),
    "technical_system_artifact": (10000, CLEAR, "technical_artifact", -2500, "clear"),
    "wrong_field_data_type": (9500, CLEAR, "wrong_field_context", -1500, "clear"),
}
# fixed values: highest disposition under each blocker, and under each route with its review
BLOCKERS = {blocker: most for _, _, blocker, _, most in PATTERNS.values()} | {
    "primary_identifier_required": "investigate",
    "supporting_evidence_cannot_escalate": "investigate",
}
ROUTES = {CLEAR: ("auto_release", "escalate"), ESCALATE: ("escalation_review", "escalate"), INVESTIGATE: ("standard_review", "investigate"), MANUAL: ("manual_review", "investigate")}
# fixed values: strength and whether it may escalate, of exact matches by route
EXACT_ROUTES = {"exact_account": (8000, False), "exact_bic": (10000, True), "exact_date": (7000, False), "exact_lei": (10000, True)}
SECONDARY = 9000
# fixed values: words that make a watchlist name special, and phrases of each context
QUALIFIERS = "BANK MINISTRY SHIPPING AIRWAYS FOUNDATION CORPORATION HOLDINGS TRUST AUTHORITY".split()
DENIALS = ["NO BUSINESS RELATIONSHIP", "NOT RELATED TO", "DO NOT PAY", "NO DEALINGS WITH", "REJECTED DUE TO"]
ARTEFACTS = ["MIGRATION", "TEST RECORD", "DUMMY", "SYSTEM GENERATED", "LEGACY PADDING"]
LEGAL = ["BANKRUPTCY TRUSTEE", "COURT APPOINTED RECEIVER", "LIQUIDATOR", "INSOLVENCY ADMINISTRATOR", "RECEIVER FOR"]
NAME_ROUTES = ["normalized_name", "alias", "transliteration", "contextual_phrase"]
DATA_TYPES = ["account_identifier", "iban", "payment_reference", "uetr", "amount", "count", "datetime"]
FOLD_REASONS = ["name_fuzzy_phonetic", "transliteration_fold_exact", "transliteration_only"]
#: Columns of an observation; lists may be empty but not null.
COLUMNS = {
    "input_value": "string", "watchlist_value": "string", "value_type": "string", "route": "string", "trigger": "string",
    "candidate_type": "string", "exact": "boolean", "score": "int", "target_types": "array<string>",
    "required": "array<string>", "present": "array<string>", "reasons": "array<string>", "diagnostics": "array<string>",
    "secondary": "array<string>", "technical": "array<string>", "context": "array<string>",
}
# fixed values: the policy's weights and thresholds
POLICY = {"screening": 4500, "countervailing": 4000, "release": 5000, "clear_most": 2500, "escalate_least": 8500, "release_least": 7000, "countervailing_least": 9000, "auto_clear": 1, "escalation": 1}


def substring_only(value: Column, needle: Column) -> Column:
    """The needle is inside the value, but not as words of it."""
    a, b = compact(value), compact(needle)
    whole = F.contains(F.concat(F.lit(" "), text_key(value), F.lit(" ")), F.concat(F.lit(" "), text_key(needle), F.lit(" ")))
    return (F.octet_length(b) >= 3) & (a != b) & F.contains(a, b) & ~whole


def missing_qualifiers(value: Column, needle: Column, required: Column, present: Column) -> Column:
    own = F.array_intersect(fields(text_key(needle)), F.array(*map(F.lit, QUALIFIERS)))
    asked = F.when(F.size(required) > 0, F.transform(required, text_key)).otherwise(own)
    have = F.concat(fields(text_key(value)), F.transform(present, text_key))
    return F.array_sort(F.array_except(F.filter(asked, lambda q: q != ""), have))


def any_of(value: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(value, p))


def patterns() -> dict[str, Column]:
    """Whether each pattern holds, over the columns of an observation."""
    c = {k: F.col(k) for k in COLUMNS}
    value, key = c["input_value"], text_key(F.col("input_value"))
    needle, size = compact(c["watchlist_value"]), F.octet_length(compact(c["watchlist_value"]))
    short = (size >= 2) & (size <= 5)
    inside = F.contains(compact(value), needle)
    in_context = text_key(F.concat(value, F.lit(" "), F.array_join(c["context"], " ")))
    return {
        "acronym_collision": short & ~(c["exact"] & (c["route"] == "exact_bic")) & c["value_type"].isin("payment_reference", "account_identifier", "iban", "uetr") & inside,
        "entity_type_mismatch": F.array_contains(c["diagnostics"], "entity_type_mismatch") | ((F.size(c["target_types"]) > 0) & ~F.array_contains(c["target_types"], c["candidate_type"])),
        "legal_control_context": any_of(in_context, LEGAL),
        "missing_qualifier": F.size(missing_qualifiers(value, c["watchlist_value"], c["required"], c["present"])) > 0,
        "narrative_denial_context": F.array_contains(c["diagnostics"], "narrative_denial_context") | any_of(key, DENIALS),
        "phonetic_transliteration_only": ~c["exact"] & (F.size(c["secondary"]) == 0) & (F.size(c["reasons"]) > 0) & F.forall(c["reasons"], lambda r: r.isin(*FOLD_REASONS)),
        "routing_bic_collision": (c["value_type"] == "bic") & (c["route"] != "exact_bic") & short & inside,
        "substring_containment": substring_only(value, c["watchlist_value"]),
        "technical_system_artifact": (F.size(c["technical"]) > 0) | any_of(key, ARTEFACTS) | any_of(compact(value), ["0" * 10, "X" * 10]),
        "wrong_field_data_type": c["value_type"].isin(*DATA_TYPES) & c["route"].isin(*NAME_ROUTES),
    }


def lookup(table: dict, at: int | None, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v if at is None else v[at])]), key)


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def classified(observations: DataFrame) -> DataFrame:
    """observations with patterns, strongest, release, countervailing, route_hint, blockers and requires."""
    found = F.array_compact(F.array(*[F.when(p, F.lit(code)) for code, p in sorted(patterns().items())]))
    out = observations.withColumn("patterns", found)

    def of(at):
        return F.transform("patterns", lambda p: lookup(PATTERNS, at, p))

    exact = F.col("exact") & F.col("route").isin(*EXACT_ROUTES)
    signals = F.array_compact(F.array(F.when(exact, lookup(EXACT_ROUTES, 0, F.col("route"))), F.when(F.size("secondary") > 0, F.lit(SECONDARY))))
    primary = exact & lookup(EXACT_ROUTES, 1, F.col("route"))
    out = out.withColumns({"strengths": of(0), "hints": of(1), "signals": signals, "primary": F.coalesce(primary, F.lit(False))})
    release = F.zip_with("strengths", "hints", lambda s, h: F.when(h == CLEAR, s).otherwise(0))
    against = F.size("signals") > 0
    alert = F.col("trigger") == ALERT
    raised = F.array_compact(F.array(F.when(against & ~alert, F.lit("supporting_evidence_cannot_escalate")), F.when(against & alert & ~F.col("primary"), F.lit("primary_identifier_required"))))
    wants = F.array(
        F.when(F.array_contains("patterns", "phonetic_transliteration_only"), F.lit("secondary_identifier")),
        F.when(F.array_contains("patterns", "legal_control_context"), F.lit("legal_control_documentation")),
        F.when(against & ~alert, F.lit("qualifying_candidate_alert")),
        F.when(against & alert & ~F.col("primary"), F.lit("primary_identifier")),
    )
    hint = (
        F.when(against & (F.size("patterns") > 0), INVESTIGATE)
        .when(against & alert & F.col("primary"), ESCALATE)
        .when(against, INVESTIGATE)
        .when(F.array_contains("hints", MANUAL), MANUAL)
        .when(F.array_contains("hints", CLEAR), CLEAR)
        .otherwise(INVESTIGATE)
    )
    out = out.withColumns(
        {
            "strongest": F.coalesce(F.array_max("strengths"), F.lit(0)),
            "release": F.least(F.lit(10000), total(release)),
            "countervailing": F.least(F.lit(10000), total(F.col("signals"))),
            "route_hint": hint,
            "blockers": sorted_set(F.concat(of(2), raised)),
            "requires": sorted_set(F.array_compact(wants)),
        }
    )
    return out.drop("strengths", "hints", "signals", "primary")


def disposed(classes: DataFrame, overrides: dict[str, int] | None = None) -> DataFrame:
    """classes with policy_score, disposition, review_route and policy_reasons; overrides replace the policy's numbers for a tenant."""
    p = POLICY | (overrides or {})
    rank = {"clear": 0, "investigate": 1, "escalate": 2}

    def most(values, table, at):
        ranks = F.transform(values, lambda v: lookup({k: rank[v if at is None else v[at]] for k, v in table.items()}, None, v))
        return F.coalesce(F.array_min(ranks), F.lit(2))

    limit = F.least(most(F.col("patterns"), PATTERNS, 4), most(F.col("blockers"), BLOCKERS, None), lookup({k: rank[v[1]] for k, v in ROUTES.items()}, None, F.col("route_hint")))
    raw = (
        div(F.col("score") * p["screening"], 10000)
        + div(F.col("countervailing") * p["countervailing"], 10000)
        - div(F.col("release") * p["release"], 10000)
        + total(F.transform("patterns", lambda x: lookup(PATTERNS, 3, x)))
    )
    out = classes.withColumns({"policy_score": F.least(F.lit(10000).cast("long"), F.greatest(F.lit(0).cast("long"), raw)), "limit": limit})
    escalate = (
        F.lit(bool(p["escalation"]))
        & (F.col("policy_score") >= p["escalate_least"])
        & (F.col("trigger") == ALERT)
        & (F.col("countervailing") >= p["countervailing_least"])
        & (F.size("blockers") == 0)
        & (F.col("limit") >= 2)
    )
    clear = F.lit(bool(p["auto_clear"])) & (F.col("route_hint") == CLEAR) & (F.col("release") >= p["release_least"]) & (F.col("policy_score") <= p["clear_most"])
    out = out.withColumn("disposition", F.when(escalate, "escalate").when(clear, "clear").otherwise("investigate"))
    d = F.col("disposition")
    review = F.when(d == "escalate", "escalation_review").when(d == "clear", "auto_release").when(F.col("route_hint") == MANUAL, MANUAL).otherwise("standard_review")
    off_clear = (d == "investigate") & (F.col("route_hint") == CLEAR) & F.lit(not p["auto_clear"])
    said = F.concat(
        F.transform("patterns", lambda x: F.concat(F.lit("fp_"), x)),
        F.array(lookup({CLEAR: "route_clear_eligible", ESCALATE: "route_escalation_candidate", INVESTIGATE: "route_investigate", MANUAL: "route_manual_review"}, None, F.col("route_hint"))),
        F.array_compact(
            F.array(
                F.when(d == "escalate", F.lit("policy_escalate_primary_identifier")),
                F.when((d != "escalate") & F.lit(not p["escalation"]), F.lit("policy_escalation_disabled")),
                F.when(d == "clear", F.lit("policy_clear_release_support")),
                F.when(d == "investigate", F.lit("policy_investigate")),
                F.when(d == "investigate", F.lit("policy_threshold_evaluation")),
                F.when(off_clear, F.lit("policy_auto_clear_disabled")),
                F.when(F.col("trigger") == "supporting_evidence", F.lit("policy_supporting_evidence_non_escalation")),
            )
        ),
    )
    return out.withColumns({"review_route": review, "policy_reasons": sorted_set(said)}).drop("limit")
