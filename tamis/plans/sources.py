"""Queries of lists, entities, vendor alerts and compiler input, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.sources import exchange as X
from tamis.sources import lists as S

from .base import bound

SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, n_name, s_acctbal FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"


def tag(name, *inner):
    return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))


def entry_payloads(spark, sf_dir):
    """A list entry as XML for each supplier."""
    k = F.col("s_suppkey").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ["Entity", "Individual", "Vessel", "Aircraft", "Other"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    aka = F.concat(*[tag("aka", tag("uid", k, F.lit(n)), tag("type", F.lit("a.k.a.")), tag("category", F.lit(c)), tag("lastName", F.lit(p), "s_name")) for n, c, p in (("2", "Weak", "old "), ("1", "strong", "new "))])
    address = tag("address", tag("uid", k), tag("city", F.lit("Port "), "n_name"), tag("country", "n_name"))
    ident = F.concat(tag("id", tag("uid", k), tag("idType", F.lit("SWIFT/BIC")), tag("idNumber", F.lit("B"), k)), tag("id", tag("uid", k), tag("idType", F.lit("IMO account")), tag("idNumber", F.lit("I"), k)))
    return bound(spark, sf_dir, SUPPLIERS).select(
        tag(
            "sdnEntry", tag("uid", k), tag("firstName", F.lit(" F ")), tag("lastName", "s_name"), tag("sdnType", kind), tag("programList", tag("program", F.lit("Q")), tag("program", F.lit("P")), tag("program", F.lit("Q"))),
            tag("akaList", aka), tag("addressList", address), tag("idList", ident), tag("dateOfBirthList", tag("dateOfBirthItem", tag("uid", F.lit("1")), tag("dateOfBirth", F.lit("circa 1970")))),
            F.when(F.col("s_suppkey") % 5 == 2, tag("vesselInfo", tag("callSign", F.lit("C"), k), tag("vesselFlag", "n_name"))).otherwise(""),
        ).alias("payload")
    )


def list_records(spark, sf_dir):
    out = S.records(S.parsed_entries(entry_payloads(spark, sf_dir)))
    alias = F.array_join(F.transform("aliases", lambda a: F.concat_ws(":", a["source_uid"], a["strength"], a["name"])), "|")
    return out.select("record_id", "source_uid", "entity_type", "primary_name", F.array_join("programs", ",").alias("programs"), alias.alias("aliases"), F.array_join("dates_of_birth", ",").alias("dates"), F.array_join(F.array_sort(F.map_keys("vessel")), ",").alias("vessel"))


def compiled_entries(spark, sf_dir):
    """Routes and values that records are found by."""
    return S.compiled(S.records(S.parsed_entries(entry_payloads(spark, sf_dir))))


def exact_route_match(spark, sf_dir):
    """Requests by route and value against the compiled entries; the best entry of each record."""
    entries = compiled_entries(spark, sf_dir)
    asked = bound(spark, sf_dir, "SELECT n_nationkey AS request_id, 'contextual_address' AS route, 'port  ' || n_name AS value FROM {nation} UNION ALL SELECT s_suppkey + 1000, 'exact_bic', 'b' || CAST(s_suppkey AS VARCHAR(9)) FROM {supplier}")
    asked = asked.withColumn("query", F.trim(F.regexp_replace(F.upper("value"), r"\s+", " "))).drop("value")
    best = F.max(F.struct("score", "value")).alias("m")
    return entries.join(asked, ["route", "query"]).groupBy("request_id", "record_id", "route").agg(best).select("request_id", "record_id", "route", F.col("m.score").alias("score"))


def entities(spark, sf_dir):
    """Entities as JSON, parsed: companies of suppliers, addresses of nations, sanctions of both by ids in any case."""
    rows = bound(spark, sf_dir, SUPPLIERS)
    none = F.array().cast("array<string>")
    k = F.col("s_suppkey").cast("string")
    schema = F.when(F.col("s_suppkey") % 4 == 0, "Person").when(F.col("s_suppkey") % 4 == 1, "Company").when(F.col("s_suppkey") % 4 == 2, "Vessel").otherwise("Note")
    one = rows.select(
        F.concat(F.lit("Q"), k).alias("id"), schema.alias("schema"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("caption"), F.array(F.lit("d")).alias("datasets"),
        F.array(F.concat(F.lit("ofac-"), (F.col("s_suppkey") - F.col("s_suppkey") % 2).cast("string"))).alias("referents"),
        F.create_map(F.lit("name"), F.array(F.concat("s_name", F.lit(" b")), F.lit(" "), "s_name"), F.lit("weakAlias"), F.array(F.lit("w")), F.lit("bic"), F.array(F.concat(F.lit("B"), k)), F.lit("addressEntity"), F.array(F.concat(F.lit("A"), F.col("s_nationkey").cast("string")))).alias("properties"),
    )
    two = bound(spark, sf_dir, "SELECT n_nationkey, n_name FROM {nation} WHERE n_nationkey <> 5").select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Address").alias("schema"), F.lit("x").alias("caption"), none.alias("datasets"), none.alias("referents"), F.create_map(F.lit("country"), F.array("n_name")).alias("properties"))
    ref = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" q"), k)).otherwise(F.concat(F.lit("OFAC-"), (F.col("s_suppkey") - 1).cast("string")))
    three = rows.select(F.concat(F.lit("S"), k).alias("id"), F.lit("Sanction").alias("schema"), F.lit("x").alias("caption"), none.alias("datasets"), none.alias("referents"), F.create_map(F.lit("entity"), F.array(ref), F.lit("program"), F.array(F.lit("P"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))).alias("properties"))
    text = one.unionByName(two).unionByName(three).select(F.to_json(F.struct("*")).alias("value"))
    return text.select(F.from_json("value", S.ENTITY, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def entity_targets(spark, sf_dir):
    out = S.targets(entities(spark, sf_dir))
    alias = F.array_join(F.transform("aliases", lambda a: F.concat_ws(":", a["name"], a["type"])), "|")
    return out.select("entity_id", "entity_type", "primary_name", alias.alias("aliases"), F.array_join(F.transform("identifiers", lambda i: F.concat_ws("=", i["type"], i["value"])), ",").alias("identifiers"))


def entity_programs(spark, sf_dir):
    return S.sanction_programs(entities(spark, sf_dir)).withColumn("programs", F.array_join("programs", ","))


def entity_addresses(spark, sf_dir):
    return S.entity_addresses(entities(spark, sf_dir)).select("entity_id", "country")


def vendor_alerts(spark, sf_dir):
    """Events as vendor JSON, converted; some lack a field, some aren't JSON."""
    rows = bound(spark, sf_dir, "SELECT event_id, user_id, event_type, value FROM {events}")
    k = F.col("event_id")
    score = F.when(k % 13 == 0, F.lit("101")).when(k % 17 == 0, F.lit('"x"')).when(k % 19 == 0, F.lit("null")).otherwise((k % 101).cast("string"))
    lists = F.when(k % 11 == 0, "other").when(k % 2 == 0, "OFAC").otherwise("OFAC SDN")
    head = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"system": "s'), F.col("user_id").cast("string"), F.lit('", ')))
    raw = F.concat(F.lit('{"tenant_id": "t", '), head, F.lit('"alert_id": "a'), k.cast("string"), F.lit('", "list_name": "'), lists, F.lit('", "occurred_at": "2024-01-0'), (k % 12).cast("string"), F.lit('T10:00:00Z", "correlation_id": "c", "idempotency_key": "i", "score": '), score, F.lit(', "evidence": {"matched_name": "'), "event_type", F.lit('"}}'))
    raw = F.when(k % 23 == 0, F.concat(raw, F.lit("{}"))).when(k % 29 == 0, F.lit("[1]")).otherwise(raw)
    out = X.converted(rows.select("event_id", raw.alias("raw")))
    return out.select("event_id", "rejected", F.when(F.col("rejected").isNull(), F.col("external_score").cast("long")).alias("score"), F.when(F.col("rejected").isNull(), F.col("list_id")).alias("list_id"), F.when(F.col("rejected").isNull(), F.try_element_at("evidence", F.lit("matched_name"))).alias("matched"))


def vendor_batch(spark, sf_dir):
    return vendor_alerts(spark, sf_dir).groupBy(F.coalesce("rejected", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def compiler_sides(spark, sf_dir):
    rows = bound(spark, sf_dir, "SELECT CAST(p_partkey AS VARCHAR(12)) AS record_id, ' ' || p_name || ' ' AS name, p_brand, p_size FROM {part}")
    records = rows.select("record_id", F.lit("organization").alias("entity_type"), "name")
    names = rows.select("record_id", F.lit("primary").alias("kind"), "name").union(rows.select("record_id", F.lit("alias"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ")))
    return records, names, rows.select("record_id", F.lit("brand é").alias("type"), F.col("p_brand").alias("value"))


def compiler_round_trip(spark, sf_dir):
    """Names after they went through lines of hex."""
    _, names, _ = X.decoded(X.encoded(*compiler_sides(spark, sf_dir)))
    return names


def compiler_counts(spark, sf_dir):
    lines = X.encoded(*compiler_sides(spark, sf_dir))
    return lines.groupBy(F.substring("value", 1, 1).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def compiler_faults(spark, sf_dir):
    records, names, ids = compiler_sides(spark, sf_dir)
    return X.input_faults(records.where("cast(record_id as int) % 40 <> 3").union(records.where("cast(record_id as int) % 90 = 5")), names, ids)


QUERIES = {
    f.__name__: f
    for f in (
        list_records, compiled_entries, exact_route_match, entity_targets, entity_programs, entity_addresses, vendor_alerts, vendor_batch, compiler_round_trip, compiler_counts, compiler_faults,
    )
}

_S = "SELECT s_suppkey AS k, s_name, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_TYPE = "CASE CAST(k % 5 AS INT) WHEN 0 THEN 'organization' WHEN 1 THEN 'individual' WHEN 2 THEN 'vessel' WHEN 3 THEN 'aircraft' END"
_ENTRIES = f"""
SELECT route, trim(regexp_replace(upper(value), '\\s+', ' ', 'g')) AS query, 'ofac:sdn:' || k AS record_id, {_TYPE} AS entity_type, value, CAST(score AS INT) AS score FROM (
SELECT k, 'normalized_name' AS route, 'F ' || s_name AS value, 10000 AS score FROM s UNION ALL SELECT k, r, p || s_name, 9700 FROM s, (VALUES ('alias'), ('transliteration')) a(r), (VALUES ('old '), ('new ')) b(p)
UNION ALL SELECT k, 'exact_date', 'circa 1970', 10000 FROM s UNION ALL SELECT k, 'jurisdiction_policy', n_name, 10000 FROM s UNION ALL SELECT k, 'contextual_address', n_name, 9000 FROM s
UNION ALL SELECT k, 'contextual_address', 'Port ' || n_name, 9000 FROM s UNION ALL SELECT k, 'exact_bic', 'B' || k, 10000 FROM s)
"""
_V = """
SELECT event_id, event_type, CASE WHEN event_id % 23 = 0 OR event_id % 29 = 0 THEN 'invalid_json' WHEN event_id % 7 = 0 THEN 'missing_required_field:system' WHEN event_id % 12 IN (0, 10, 11) THEN 'invalid_occurred_at'
  WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'invalid_score' WHEN event_id % 11 = 0 THEN 'unmapped_list' END AS rejected FROM events
"""
_NAMES = "SELECT DISTINCT record_id, kind, trim(name) AS name FROM (SELECT p_partkey::VARCHAR AS record_id, 'primary' AS kind, p_name AS name FROM part UNION ALL SELECT p_partkey::VARCHAR, 'alias', p_brand FROM part WHERE p_size > 25)"
ORACLE = {
    "list_records": f"""
SELECT 'ofac:sdn:' || k AS record_id, k AS source_uid, {_TYPE} AS entity_type, 'F ' || s_name AS primary_name, 'P,Q' AS programs, k || '1:strong:new ' || s_name || '|' || k || '2:weak:old ' || s_name AS aliases,
  'circa 1970' AS dates, CASE WHEN k % 5 = 2 THEN 'call_sign,flag' ELSE '' END AS vessel FROM ({_S})
""",
    "compiled_entries": f"WITH s AS ({_S}) {_ENTRIES}",
    "exact_route_match": f"""
WITH s AS ({_S}), e AS ({_ENTRIES}), r AS (SELECT n_nationkey::BIGINT AS request_id, 'contextual_address' AS route, 'PORT ' || upper(n_name) AS query FROM nation UNION ALL SELECT s_suppkey + 1000, 'exact_bic', 'B' || s_suppkey FROM supplier)
SELECT request_id, record_id, route, max(score) AS score FROM r JOIN e USING (route, query) GROUP BY ALL
""",
    "entity_targets": f"""
SELECT 'Q' || k AS entity_id, CASE CAST(k % 4 AS INT) WHEN 0 THEN 'individual' WHEN 1 THEN 'organization' ELSE 'vessel' END AS entity_type, s_name AS primary_name,
  s_name || ' b:name|w:weak_alias' AS aliases, 'BIC=B' || k AS identifiers FROM ({_S}) WHERE k % 4 <> 3
""",
    "entity_programs": f"""
WITH s AS ({_S}), t AS (SELECT k, 'q' || k AS n FROM s WHERE k % 4 <> 3 UNION SELECT k, 'ofac-' || (k - k % 2) FROM s WHERE k % 4 <> 3), o AS (SELECT n, min(k) AS k FROM t GROUP BY n HAVING count(*) = 1),
l AS (SELECT CASE WHEN k % 2 = 0 THEN 'q' || k ELSE 'ofac-' || (k - 1) END AS n, s_nationkey FROM s)
SELECT 'Q' || o.k AS entity_id, string_agg(DISTINCT p, ',' ORDER BY p) AS programs FROM (SELECT n, 'P' AS p FROM l UNION ALL SELECT n, 'N' || s_nationkey FROM l) x JOIN o USING (n) GROUP BY 1
""",
    "entity_addresses": f"SELECT DISTINCT 'Q' || k AS entity_id, n_name AS country FROM ({_S}) WHERE k % 4 <> 3 AND s_nationkey <> 5",
    "vendor_alerts": f"""
SELECT event_id, rejected, CASE WHEN rejected IS NULL THEN CASE WHEN event_id % 19 = 0 THEN 0 ELSE event_id % 101 END END AS score, CASE WHEN rejected IS NULL THEN 'ofac-sdn' END AS list_id, CASE WHEN rejected IS NULL THEN event_type END AS matched FROM ({_V})
""",
    "vendor_batch": f"SELECT coalesce(rejected, 'accepted') AS outcome, count(*) AS n FROM ({_V}) GROUP BY 1",
    "compiler_round_trip": _NAMES,
    "compiler_counts": f"SELECT 'R' AS tag, count(*) AS n FROM part UNION ALL SELECT 'N', count(*) FROM ({_NAMES}) UNION ALL SELECT 'I', count(*) FROM part",
    "compiler_faults": """
SELECT p_partkey::VARCHAR AS record_id, f AS fault FROM part, (VALUES ('name_without_record'), ('identifier_without_record')) v(f) WHERE p_partkey % 40 = 3 AND p_partkey % 90 <> 5
UNION ALL SELECT p_partkey::VARCHAR, 'repeated_record' FROM part WHERE p_partkey % 90 = 5 AND p_partkey % 40 <> 3
""",
}
