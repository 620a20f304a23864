"""Vendor alerts as JSON by a mapping profile, and compiler input as lines of hex fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Which path of a vendor's JSON gives which field."""

    required: tuple[str, ...]
    mappings: dict[str, str]
    constants: dict[str, str] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)
    evidence: dict[str, str] = field(default_factory=dict)
    max_bytes: int = 4 << 20


GENERIC = Profile(
    required=("tenant_id", "alert_id", "system", "list_name", "occurred_at", "correlation_id", "idempotency_key"),
    mappings={
        "source_system_id": "system", "source_alert_id": "alert_id", "raw_list_name": "list_name", "occurred_at": "occurred_at", "external_score": "score",
        "correlation_id": "correlation_id", "idempotency_key": "idempotency_key",
    },
    constants={"tenant_id": "tenant-a"},
    lists={"OFAC SDN": "ofac-sdn", "OFAC": "ofac-sdn"},
    evidence={"matched_name": "evidence.matched_name", "screened_name": "evidence.screened_name", "vendor_status": "status"},
)


def converted(alerts: DataFrame, profile: Profile = GENERIC, raw_col: str = "raw") -> DataFrame:
    """alerts with the profile's fields, list_id, evidence, and `rejected`: the first reason not to take it, or null.

    One JSON object each; duplicate keys, other values and more than
    max_bytes are rejected.  A score must be a whole number of 0 to 100; none is 0.
    """
    raw = F.col(raw_col)
    # as the only item of a list: what follows an object makes the list another, or none
    doc = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    alone = F.startswith(F.schema_of_variant(doc), F.lit("ARRAY<OBJECT")) & F.try_variant_get(doc, "$[1]", "variant").isNull()

    def at(path):
        return F.get_json_object(raw, "$." + path)

    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(at(p), F.lit(""))) == "", F.lit(p)) for p in profile.required]))
    out = alerts.withColumns({f: at(p) for f, p in profile.mappings.items()} | {f: F.lit(v) for f, v in profile.constants.items()})
    score = F.when(F.col("external_score").isNull(), F.lit(0)).when(F.col("external_score").rlike(r"^\d{1,3}$"), F.col("external_score").cast("int"))
    lists = F.create_map(*[F.lit(x) for pair in profile.lists.items() for x in pair])
    stamp = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    rejected = (
        F.when(F.octet_length(raw) > profile.max_bytes, "source_too_large")
        .when(doc.isNull() | ~alone, "invalid_json")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_required_field:"), F.get(missing, F.lit(0))))
        .when(~F.col("occurred_at").rlike(stamp) | F.try_to_timestamp("occurred_at").isNull(), "invalid_occurred_at")
        .when(score.isNull() | (score > 100), "invalid_score")
        .when(F.try_element_at(lists, F.col("raw_list_name")).isNull(), "unmapped_list")
    )
    evidence = F.map_filter(F.create_map(*[x for k, p in sorted(profile.evidence.items()) for x in (F.lit(k), F.substring(at(p), 1, 256))]), lambda _, v: F.coalesce(v, F.lit("")) != "")
    return out.withColumns({"rejected": rejected, "external_score": score, "list_id": F.try_element_at(lists, F.col("raw_list_name")), "evidence": evidence})


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value.cast("binary")))


def unhexed(value: Column) -> Column:
    return F.decode(F.unhex(value), "utf-8")


def encoded(records: DataFrame, names: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(value): lines of records (record_id, entity_type, name), names (record_id, kind, name) and identifiers (record_id, type, value), trimmed, without blanks, each once."""

    def lines(df, tag, cols, plain=()):
        some = df.select(*[F.trim(F.col(c)).alias(c) for c in cols])
        for c in cols:
            some = some.where(F.col(c) != "")
        return some.distinct().select(F.concat_ws("\t", F.lit(tag), *[F.col(c) if c in plain else hexed(F.col(c)) for c in cols]).alias("value"))

    return lines(records, "R", ["record_id", "entity_type", "name"]).union(lines(names, "N", ["record_id", "kind", "name"], ("kind",))).union(lines(identifiers, "I", ["record_id", "type", "value"]))


def decoded(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, names and identifiers of lines."""
    f = F.split("value", "\t")
    tagged = lines.select(f[0].alias("tag"), f[1].alias("a"), f[2].alias("b"), f[3].alias("c"))
    out = []
    for tag, names, plain in (("R", ("record_id", "entity_type", "name"), ()), ("N", ("record_id", "kind", "name"), ("kind",)), ("I", ("record_id", "type", "value"), ())):
        cols = [(F.col(c) if n in plain else unhexed(F.col(c))).alias(n) for c, n in zip("abc", names, strict=True)]
        out.append(tagged.where(F.col("tag") == tag).select(*cols))
    return tuple(out)


def input_faults(records: DataFrame, names: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(record_id, fault): repeated records, names and identifiers of records that don't exist, kinds that aren't known."""
    known = records.select("record_id").distinct()
    faults = records.groupBy("record_id").count().where("count > 1").select("record_id", F.lit("repeated_record").alias("fault"))
    faults = faults.union(names.join(known, "record_id", "left_anti").select("record_id", F.lit("name_without_record")).distinct())
    faults = faults.union(identifiers.join(known, "record_id", "left_anti").select("record_id", F.lit("identifier_without_record")).distinct())
    return faults.union(names.where(~F.col("kind").isin("primary", "alias")).select("record_id", F.lit("unknown_kind")).distinct())
