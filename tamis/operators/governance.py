"""Permissions, quotas, notes, promotion phases, encrypted snapshots and other checks around the matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: permissions that a resource's wildcard stands for, and the permission of each action on a case
RESOURCES = {
    "alert": ["alert.read"],
    "assistance": ["assistance.read", "assistance.request", "assistance.review"],
    "case": ["case.assign_any", "case.assign_self", "case.create", "case.investigate", "case.read", "case.reopen", "case.rescreen"],
    "decision": ["decision.approve", "decision.propose"],
    "evidence": ["evidence.request", "evidence.submit"],
    "security": ["security.audit.read"],
}
ACTIONS = {
    "start_investigation": "case.investigate", "request_evidence": "evidence.request", "submit_evidence": "evidence.submit", "propose_decision": "decision.propose",
    "approve_decision": "decision.approve", "reject_decision": "decision.approve", "reopen": "case.reopen", "link_rescreen": "case.rescreen",
}
# fixed values: from which phase a promotion's action may come, and where it leads
PHASES = {
    "validate": (["prepared", "blocked"], "validated"), "block": (["prepared", "validated"], "blocked"), "canary": (["validated"], "canary"),
    "promote": (["canary"], "promoted"), "rollback": (["canary", "promoted"], "rolled_back"),
}


def granted(bindings: DataFrame, roles: DataFrame) -> DataFrame:
    """(user, tenant, permission): what bindings (user, tenant, role) and roles (role, permission) give; wildcards of resources are spelt out."""
    table = F.create_map(*[x for r, ps in RESOURCES.items() for x in (F.lit(f"{r}.*"), F.array(*map(F.lit, ps)))])
    wide = roles.withColumn("permission", F.explode(F.coalesce(F.try_element_at(table, F.col("permission")), F.array("permission"))))
    return bindings.join(F.broadcast(wide), "role").select("user", "tenant", "permission").distinct()


def decided(asked: DataFrame, grants: DataFrame) -> DataFrame:
    """asked (user, tenant, need) with `allowed`: a grant of the tenant or of all, of the permission or of all."""
    held = grants.select(F.col("user").alias("u"), F.col("tenant").alias("t"), F.col("permission").alias("p"))
    asks = asked.withColumn("__a", F.struct("user", "tenant", "need"))
    fits = (F.col("user") == F.col("u")) & (F.col("t").isin("*") | (F.col("t") == F.col("tenant"))) & (F.col("p").isin("*") | (F.col("p") == F.col("need")))
    hit = asks.select("user", "tenant", "need").distinct().join(held, fits, "left_semi").withColumn("allowed", F.lit(True))
    return asked.join(hit, ["user", "tenant", "need"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def needed(action: Column, assignee: Column, subject: Column) -> Column:
    """Permission that an action needs; null for one that isn't known."""
    own = F.when(assignee == subject, "case.assign_self").otherwise("case.assign_any")
    return F.when(action == "assign", own).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p]), action))


def with_default(rows: DataFrame, settings: DataFrame, key: str, default: dict) -> DataFrame:
    """rows with their key's settings, or the default ones where it has none."""
    out = rows.join(settings, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})


def latest(rows: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """Fields of the row with the greatest order of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), order).alias("v")).select(*key, "v.*")


def tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def phases(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, phase, taken, refused) after a promotion's actions in their order; those that a phase doesn't allow change nothing."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "action")))
    zero = F.struct(F.lit("prepared").alias("phase"), F.lit(0).alias("taken"), F.lit(0).alias("refused"))

    def step(acc, e):
        to = F.lit(None).cast("string")
        for action, (states, then) in PHASES.items():
            to = F.when((e["action"] == action) & acc["phase"].isin(*states), then).otherwise(to)
        ok = to.isNotNull()
        return F.struct(F.coalesce(to, acc["phase"]).alias("phase"), (acc["taken"] + ok.cast("int")).alias("taken"), (acc["refused"] + (~ok).cast("int")).alias("refused"))

    return events.groupBy(key).agg(F.aggregate(held, zero, step).alias("s")).select(key, "s.*")


def note_faults(claims: DataFrame, allowed: DataFrame, note: str, prohibited: list[str]) -> DataFrame:
    """(note, fault) of notes whose claims (text, citations) cite what isn't allowed, cite nothing, are blank, or hold a prohibited phrase."""
    flat = claims.select(note, F.explode_outer("citations").alias("citation"))
    unknown = flat.where("citation is not null").join(allowed.select(note, "citation"), [note, "citation"], "left_anti").select(note, F.lit("unknown_citation").alias("fault"))
    blank = claims.where((F.size("citations") == 0) | (F.trim("text") == "")).select(note, F.lit("invalid_claim"))
    said = claims.where(F.exists(F.array(*map(F.lit, prohibited)), lambda p: F.contains(F.upper("text"), F.upper(p)))).select(note, F.lit("prohibited_phrase"))
    return unknown.union(blank).union(said).distinct()


def prompts(facts: DataFrame, key: str, order: str, name: str, value: str) -> DataFrame:
    """(key, prompt_sha256): facts of each key in order, one a line, and their digest."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws(": ", name, value).alias("l")))), lambda x: x["l"])
    return facts.groupBy(key).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("prompt_sha256"))


def rfc3339(value: Column) -> Column:
    """A time with its zone, in UTC; null if it isn't one."""
    form = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    at = F.when(value.rlike(form), F.try_to_timestamp(value))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def expires(at: Column, days: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(24 * days), at)


def sealed(value: Column, key: Column, context: Column) -> Column:
    """Encrypted with AES-GCM under a fresh nonce, bound to its context."""
    return F.base64(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), context.cast("binary")))


def opened(value: Column, key: Column, context: Column) -> Column:
    """What `sealed` hid; null if key or context are others."""
    return F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM"), F.lit("DEFAULT"), context.cast("binary")).cast("string")


def unknown_fields(value: Column, known: list[str]) -> Column:
    """Keys of a JSON object that a strict reader refuses."""
    return F.array_sort(F.array_except(F.json_object_keys(value), F.array(*map(F.lit, known))))


def capped(candidates: DataFrame, request: str, most: int) -> DataFrame:
    """candidates; a request with more than `most` is an error that stops the job, not a shorter list."""
    n = F.count(F.lit(1)).over(Window.partitionBy(request))
    over = F.raise_error(F.concat(F.lit("too many candidates for "), F.col(request).cast("string")))
    return candidates.withColumn("__n", n).where(F.when(F.col("__n") > most, over.cast("boolean")).otherwise(True)).drop("__n")
