"""Requests, provider runs, projections, pointers, acknowledgements and assistance, as plain steps over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import compact, entity_type, identifier_type, text_key

# fixed values: kinds of queries, of entities that may be asked for, and of candidate routes
QUERY_KINDS = ["name", "identifier", "record_id"]
TARGETS = ["individual", "organization", "vessel", "aircraft", "government_entity", "jurisdiction"]


def request_faults(requests: DataFrame, ident: str, most: int, max_value: int = 512) -> DataFrame:
    """(id, fault) of requests (kind, value, identifier_type, prefix, limit, targets): the first rule that each breaks."""
    value = F.coalesce("value", F.lit(""))
    fault = (
        F.when(~F.coalesce(F.col("kind"), F.lit("")).isin(*QUERY_KINDS), "unknown_kind")
        .when(F.trim(value) == "", "value_required")
        .when(F.octet_length(value) > max_value, "value_too_long")
        .when(value.rlike(r"[\x00-\x1F\x7F]"), "control_character")
        .when((F.col("kind") == "identifier") & (F.coalesce(F.trim("identifier_type"), F.lit("")) == ""), "identifier_type_required")
        .when((F.col("kind") != "identifier") & (F.coalesce(F.trim("identifier_type"), F.lit("")) != ""), "identifier_type_not_allowed")
        .when((F.col("kind") != "name") & F.coalesce("prefix", F.lit(False)), "prefix_not_allowed")
        .when(~F.coalesce("limit", F.lit(0)).between(0, most), "limit_out_of_range")
        .when(F.size(F.array_except("targets", F.array(*map(F.lit, TARGETS)))) > 0, "unknown_target")
        .when(F.size(F.array_distinct("targets")) < F.size("targets"), "repeated_target")
    )
    return requests.select(F.col(ident).alias("id"), fault.alias("fault")).where("fault is not null")


def compatible(routes: Column, types: Column, own_routes: list[str], own_types: list[str]) -> Column:
    """Whether a provider serves a request: a route and a type in common."""
    return F.arrays_overlap(routes, F.array(*map(F.lit, own_routes))) & F.arrays_overlap(types, F.array(*map(F.lit, own_types)))


def provider_run(candidates: DataFrame, request: str, most: int) -> DataFrame:
    """Candidates (record_id, route, value, score, exact) of each request, the best of each record, in the run's order.

    More than `most` records for a request is an error that stops the job.
    """
    best = Window.partitionBy(request, "record_id").orderBy(F.desc("score"), F.desc("exact"), "route", "value")
    one = candidates.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    order = Window.partitionBy(request).orderBy(F.desc("score"), F.desc("exact"), "record_id", "route", "value")
    rank = one.withColumn("rank", F.row_number().over(order).cast("long"))
    over = F.raise_error(F.concat(F.lit("too many candidates for "), F.col(request).cast("string"))).cast("boolean")
    return rank.where(F.when(F.col("rank") > most, over).otherwise(True))


def run_summary(ranked: DataFrame, requests: DataFrame, request: str) -> DataFrame:
    """Requests with and without candidates, candidates by route."""
    n = ranked.groupBy(request).agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("e"))
    both = requests.select(request).distinct().join(n, request, "left")
    return both.agg(F.count_if(F.col("n") > 0).alias("matched"), F.count_if(F.col("n").isNull()).alias("no_candidates"), F.sum("n").alias("candidates"), F.sum("e").alias("exact"))


def scoring_projection(records: DataFrame) -> DataFrame:
    """Retrievable records (record_id, retrievable, names, identifiers, countries, type) with all attributes normalised, each once, sorted; identifiers need type and value."""

    def unique(values, make):
        return F.array_sort(F.array_distinct(F.filter(F.transform(values, make), lambda v: v != "")))

    pair = F.transform("identifiers", lambda i: F.struct(identifier_type(i["type"]).alias("type"), compact(i["value"]).alias("value")))
    pairs = F.array_sort(F.array_distinct(F.filter(pair, lambda i: (i["type"] != "") & (i["value"] != ""))))
    kept = records.where("retrievable")
    return kept.select("record_id", unique(F.col("names"), lambda v: text_key(v)).alias("names"), pairs.alias("identifiers"), unique(F.col("countries"), lambda v: compact(v)).alias("countries"), entity_type(F.col("type")).alias("type"))


def id_digest(rows: DataFrame, key: str) -> DataFrame:
    """(records, digest) of a set of ids in any order, by two sums of their digests: one distributed aggregation."""
    h = F.sha2(F.col(key).cast("string"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(2)]
    return rows.agg(F.count(F.lit(1)).alias("records"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts), 256).alias("digest"))


def normalised_map(value: Column) -> Column:
    """Keys and values trimmed, blank ones left out; of keys that become equal the greater value stays."""
    pairs = F.transform(F.map_entries(value), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    kept = F.array_sort(F.filter(pairs, lambda e: (e["key"] != "") & (F.coalesce(e["value"], F.lit("")) != "")))
    last = F.filter(kept, lambda e, i: F.coalesce(F.get(kept, i + 1)["key"] != e["key"], F.lit(True)))
    return F.map_from_entries(last)


def metadata(raw: Column, keys: list[str]) -> Column:
    """Of a response's candidates only the named keys, as JSON; null if there are none."""
    items = F.from_json(raw, "candidates array<map<string,string>>")["candidates"]
    kept = F.transform(items, lambda m: F.map_from_entries(F.filter(F.array_sort(F.map_entries(m)), lambda e: e["key"].isin(*keys))))
    return F.when(F.size(items) > 0, F.to_json(kept))


def token_state(issued: Column, expires: Column, epoch: Column, current_epoch: Column, now: Column, max_ttl_s: int) -> Column:
    life = F.unix_micros(expires.cast("timestamp")) - F.unix_micros(issued.cast("timestamp"))
    return (
        F.when((life <= 0) | (life > max_ttl_s * 1_000_000), "invalid_lifetime")
        .when(now < issued, "not_yet_valid")
        .when(now >= expires, "expired")
        .when(epoch != current_epoch, "session_revoked")
        .otherwise("valid")
    )


def source_index(entities: DataFrame) -> DataFrame:
    """(source, list, record, entity_id) of active memberships; of several entities with one key the last id stays."""
    flat = entities.select("entity_id", F.explode("memberships").alias("m")).where("m.active")
    return flat.groupBy("m.source", "m.list", "m.record").agg(F.max("entity_id").alias("entity_id"))


def acknowledged(acks: DataFrame, phases: DataFrame, intent: str, instance: str, order: str) -> DataFrame:
    """acks with outcome: the first of an instance counts, in the phases that take them; the same again is a replay, another a conflict."""
    by = Window.partitionBy(intent, instance).orderBy(order)
    both = acks.join(phases, intent, "left")
    first = F.first("status").over(by)
    outcome = (
        F.when(~F.coalesce(F.col("phase").isin("validated", "canary"), F.lit(False)), "wrong_phase")
        .when(F.row_number().over(by) == 1, "recorded")
        .when(F.col("status") == first, "replay")
        .otherwise("conflict")
    )
    return both.withColumn("outcome", outcome)


def purged(snapshots: DataFrame, gone: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """snapshots with payloads of purged ones emptied and a mark of it."""
    marks = gone.select(F.col(key).alias("__k")).distinct()
    both = snapshots.join(marks, F.col(key) == F.col("__k"), "left").withColumn("purged", F.col("__k").isNotNull())
    return both.withColumns({c: F.when(~F.col("purged"), F.col(c)) for c in payload}).drop("__k")


def activation_faults(catalog: DataFrame, projection: DataFrame, policy: DataFrame) -> DataFrame:
    """(fault) of an activation's three parts (one row each: component, version, profile): what must agree and doesn't."""
    c, p, s = (df.select(F.struct("component", "version", "profile").alias(n)) for df, n in ((catalog, "c"), (projection, "p"), (policy, "s")))
    both = c.crossJoin(p).crossJoin(s)  # one row each
    rules = {"component": F.col("c.component") == F.col("p.component"), "version": F.col("c.version") == F.col("p.version"), "profile": (F.col("p.profile") == F.col("s.profile")) & (F.col("c.profile") == F.col("s.profile"))}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()]))
    return both.select(F.explode(broken).alias("fault"))


def assisted(requests: DataFrame, passages: DataFrame, responses: DataFrame, prohibited: list[str]) -> DataFrame:
    """(request_id, status) of requests (request_id, prompt_sha256): canned responses (prompt_sha256, answer) stand in for a model.

    Without passages nothing is asked; without an answer generation failed; one with a prohibited phrase is blocked.
    """
    n = passages.groupBy("request_id").agg(F.count(F.lit(1)).alias("passages"))
    both = requests.join(n, "request_id", "left").join(responses, "prompt_sha256", "left")
    bad = F.exists(F.array(*map(F.lit, prohibited)), lambda p: F.contains(F.upper("answer"), F.upper(p)))
    status = F.when(F.coalesce("passages", F.lit(0)) == 0, "insufficient_context").when(F.col("answer").isNull(), "generation_failed").when(bad, "guardian_blocked").otherwise("completed")
    return both.select("request_id", status.alias("status"))
