"""Review runs, observations, case membership, registries, anchors and other checks over stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import hmac_sha256, sha


def observed(candidates: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Observations of candidates and of diagnostics (id, value, route, score, code), one row each, sorted ids of their content."""
    one = candidates.select("id", "value", "route", "score", F.array().cast("array<string>").alias("codes"))
    two = diagnostics.select("id", "value", "route", "score", F.array("code").alias("codes"))
    return one.unionByName(two).withColumn("observation_id", observation_id())


def observation_id() -> Column:
    ident = F.substring(F.sha2(F.concat_ws("\u001f", F.col("id").cast("string"), "value", "route", F.array_join("codes", ",")), 256), 1, 24)
    return F.concat(F.lit("observation_"), ident)


def observed_by_codes(rows: DataFrame, good: Column, odd: Column, code: str) -> DataFrame:
    """(codes, n, ids): `observed` of the good rows and, with the code, of the odd ones among the rest, counted by codes.

    rows (id, value, route, score and what the conditions need) are gone
    through once: no filter stands over them, which would compute them anew.
    """
    none = F.array().cast("array<string>")
    codes = F.when(good, none).when(odd, F.array(F.lit(code)))
    marked = rows.select("id", "value", "route", codes.alias("codes"))
    marked = marked.select(F.array_join("codes", ",").alias("codes"), F.when(F.col("codes").isNotNull(), observation_id()).alias("observation_id"))
    counted = marked.groupBy("codes").agg(F.count("codes").alias("n"), F.count_distinct("observation_id").alias("ids"))
    return counted.where("n > 0")


def run_status(decided: DataFrame, citations: Column, drafted: Column) -> DataFrame:
    """decided with retrieval_status and note_status: nothing is drafted for what is released by itself, nor without citations."""
    retrieval = F.when(citations > 0, "completed").otherwise("no_citations")
    note = (
        F.when(F.col("review_route") == "auto_release", "skipped_auto_clear")
        .when(citations == 0, "retrieval_failed")
        .when(drafted, "draft")
        .otherwise("generation_failed")
    )
    return decided.withColumns({"retrieval_status": retrieval, "note_status": note})


def memberships(links: DataFrame, alerts: DataFrame) -> DataFrame:
    """(case_id, alerts, fault) of links (case_id, alert_id): all alerts must exist and be of one tenant."""
    known = alerts.select(F.col("alert_id").alias("a"), "tenant")
    both = links.join(known, F.col("alert_id") == F.col("a"), "left")
    out = both.groupBy("case_id").agg(F.count_distinct("alert_id").alias("alerts"), F.bool_or(F.col("a").isNull()).alias("lost"), F.count_distinct("tenant").alias("tenants"))
    fault = F.when(F.col("lost"), "alert_missing").when(F.col("tenants") > 1, "tenant_mismatch")
    return out.select("case_id", "alerts", fault.alias("fault"))


def registered(existing: DataFrame, new: DataFrame, key: str, checksum: str) -> DataFrame:
    """new with `outcome`: added, unchanged (same checksum) or conflict; the first of a key inside new counts."""
    held = existing.select(F.col(key).alias("__k"), F.col(checksum).alias("__c")).dropDuplicates(["__k"])
    first = F.first(checksum).over(Window.partitionBy(key).orderBy(checksum))
    both = new.join(held, F.col(key) == F.col("__k"), "left").withColumn("__c", F.coalesce("__c", first))
    outcome = F.when(F.col("__k").isNull() & (F.col(checksum) == F.col("__c")), "added").when(F.col(checksum) == F.col("__c"), "unchanged").otherwise("conflict")
    return both.withColumn("outcome", outcome).drop("__k", "__c")


def impact(components: DataFrame, inventory: DataFrame, mappings: DataFrame) -> DataFrame:
    """(component, active, blocker): components that mappings in force use but the candidate inventory lacks, or has retired."""
    used = mappings.groupBy("component").agg(F.count(F.lit(1)).alias("active"))
    both = components.join(used, "component", "left").join(inventory.select(F.col("component").alias("c"), "status"), F.col("component") == F.col("c"), "left")
    n = F.coalesce("active", F.lit(0))
    blocker = F.when((n > 0) & F.col("c").isNull(), "mapped_component_missing").when((n > 0) & (F.col("status") != "active"), "mapped_component_retired")
    return both.select("component", n.cast("long").alias("active"), blocker.alias("blocker"))


def boundary_faults(chain: DataFrame, stream: str, genesis: Column, pinned: Column, key: bytes) -> DataFrame:
    """chain (sequence, previous, payload, hash) with `fault`: plain digests before the genesis sequence, keyed ones from it on, and the hash before it is the pinned one."""
    keyed = hmac_sha256(key, F.concat_ws("|", "previous", "payload"))
    wanted = F.when(F.col("sequence") < genesis, sha(F.col("previous"), F.col("payload"))).otherwise(keyed)
    fault = F.when(F.col("hash") != wanted, "hash_mismatch").when((F.col("sequence") == genesis) & (F.col("previous") != pinned), "genesis_mismatch")
    return chain.withColumn("fault", fault)


def anchored(heads: DataFrame, anchors: DataFrame, key: bytes) -> DataFrame:
    """heads (stream, sequence, hash) with `verdict` against the last anchor (stream, sequence, hash, mac) of each."""
    last = anchors.groupBy("stream").agg(F.max_by(F.struct("sequence", "hash", "mac"), "sequence").alias("a"))
    both = heads.join(last, "stream", "left")
    mac = hmac_sha256(key, F.concat_ws("|", F.col("a.sequence").cast("string"), F.col("a.hash")))
    verdict = (
        F.when(F.col("a").isNull(), "unanchored")
        .when(F.col("a.mac") != mac, "anchor_forged")
        .when(F.col("a.sequence") > F.col("sequence"), "truncated")
        .when((F.col("a.sequence") == F.col("sequence")) & (F.col("a.hash") != F.col("hash")), "rewritten")
        .otherwise("verified")
    )
    return both.select("stream", verdict.alias("verdict"))


def snapshot_state(refs: DataFrame, snapshots: DataFrame, purged: DataFrame) -> DataFrame:
    """refs (snapshot, sha256) with state: verified, corrupt, purged (claimed) or missing."""
    here = snapshots.select(F.col("snapshot").alias("s"), F.sha2("content", 256).alias("d"))
    gone = purged.select(F.col("snapshot").alias("p")).distinct()
    both = refs.join(here, F.col("snapshot") == F.col("s"), "left").join(gone, F.col("snapshot") == F.col("p"), "left")
    state = F.when(F.col("s").isNull() & F.col("p").isNotNull(), "purged").when(F.col("s").isNull(), "missing").when(F.col("d") == F.col("sha256"), "verified").otherwise("corrupt")
    return both.select("snapshot", state.alias("state"))


def response_items(responses: DataFrame, id_col: str, raw_col: str, batch: str = "items", inner: str = "response") -> DataFrame:
    """(id, position, candidate_id, score) of single and batch responses; the names of fields are parameters, as two shapes exist."""
    one = "struct<candidates:array<struct<candidate_id:string,score:int>>>"
    doc = F.from_json(raw_col, f"{batch} array<struct<{inner}:{one}>>, candidates array<struct<candidate_id:string,score:int>>")
    single = F.array(F.struct(doc["candidates"].alias("candidates")))
    many = F.transform(doc[batch], lambda i: F.struct(i[inner]["candidates"].alias("candidates")))
    flat = responses.select(id_col, F.posexplode(F.coalesce(many, single)).alias("position", "r"))
    return flat.select(id_col, "position", F.explode("r.candidates").alias("c")).select(id_col, "position", "c.candidate_id", "c.score")


def ready(checks: DataFrame, by: str, name: str, passed: str) -> DataFrame:
    """(by, ready, failed): whether all checks of each hold, and the names of those that don't."""
    failed = F.array_sort(F.collect_set(F.when(~F.coalesce(F.col(passed), F.lit(False)), F.col(name))))
    return checks.groupBy(by).agg(failed.alias("failed")).withColumn("ready", F.size("failed") == 0)


def of_tenant(rows: DataFrame, tenant: str, column: str = "tenant") -> DataFrame:
    """Rows of one tenant: every read of tenants' data goes through it."""
    if not tenant or tenant == "*":
        raise ValueError("a tenant is required")
    return rows.where(F.col(column) == tenant)


def score_arithmetic(rows: DataFrame, ident: str, features: dict[str, int], score: str, penalty: Column) -> DataFrame:
    """Rows whose score isn't the sum of their features' contributions, each cut off, less the penalty."""
    total = sum((F.call_function("div", F.col(c).cast("long") * w, F.lit(10000).cast("long")) for c, w in features.items()), F.lit(0).cast("long"))
    return rows.where(F.col(score) != F.greatest(F.lit(0).cast("long"), total - penalty)).select(ident)
