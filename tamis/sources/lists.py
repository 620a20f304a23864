"""Watchlists: list XML, entity JSON lines, and what is made of them for matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import text

_ITEM = "uid:string,{0}:string,mainEntry:string"
ENTRY = (
    "uid string, firstName string, lastName string, title string, sdnType string, remarks string, programList struct<program:array<string>>,"
    " akaList struct<aka:array<struct<uid:string,type:string,category:string,lastName:string,firstName:string>>>,"
    " addressList struct<address:array<struct<uid:string,address1:string,address2:string,address3:string,city:string,stateOrProvince:string,postalCode:string,country:string>>>,"
    " idList struct<id:array<struct<uid:string,idType:string,idNumber:string,idCountry:string,issueDate:string,expirationDate:string>>>,"
    f" dateOfBirthList struct<dateOfBirthItem:array<struct<{_ITEM.format('dateOfBirth')}>>>, placeOfBirthList struct<placeOfBirthItem:array<struct<{_ITEM.format('placeOfBirth')}>>>,"
    " nationalityList struct<nationality:array<struct<uid:string,country:string,mainEntry:string>>>, citizenshipList struct<citizenship:array<struct<uid:string,country:string,mainEntry:string>>>,"
    " vesselInfo struct<callSign:string,vesselType:string,vesselFlag:string,vesselOwner:string,tonnage:string,grossRegisteredTonnage:string>"
)
# fixed values: kinds of list entries, of entity schemas, and identifiers by property
ENTRY_TYPES = {"individual": "individual", "entity": "organization", "vessel": "vessel", "aircraft": "aircraft"}
SCHEMAS = {
    "Person": "individual", "Company": "organization", "Organization": "organization", "LegalEntity": "organization",
    "PublicBody": "government_entity", "Vessel": "vessel", "Airplane": "aircraft", "Aircraft": "aircraft",
}
IDENTIFIERS = {
    "leiCode": "Legal Entity Identifier", "bic": "BIC", "imoNumber": "IMO Number", "passportNumber": "Passport Number", "registrationNumber": "Registration Number",
    "taxNumber": "Tax Number", "accountNumber": "Account Number", "idNumber": "ID Number",
}
ALIASES = [("name", "name", "strong"), ("alias", "alias", "strong"), ("previousName", "previous_name", "medium"), ("weakAlias", "weak_alias", "weak")]
ENTITY = "id string, schema string, caption string, datasets array<string>, referents array<string>, properties map<string,array<string>>"


def chosen(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def unique(values: Column) -> Column:
    """Trimmed, without blanks, sorted, each once; null as empty."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    return F.array_sort(F.array_distinct(kept))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of list files.  A file with declarations of types or entities, or with another number of entries than it states, is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    stated = F.regexp_extract("value", r"<Record_Count>\s*(\d+)\s*</Record_Count>", 1)
    found = F.size(F.regexp_extract_all("value", F.lit(r"<sdnEntry[\s>]"), F.lit(0)))
    unsafe = raw.where(F.col("value").rlike("(?i)<!(DOCTYPE|ENTITY)")).count()
    wrong = raw.where((stated != "") & (stated.cast("int") != found)).count()
    if unsafe or wrong:
        raise ValueError(f"{unsafe} unsafe and {wrong} miscounted list files in {path}")
    return spark.read.format("xml").option("rowTag", "sdnEntry").schema(ENTRY).load(path)


def parsed_entries(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Entries from one XML payload each; what isn't well formed gives nulls."""
    return payloads.withColumn("e", F.from_xml(payload_col, ENTRY)).drop(payload_col).select("*", "e.*").drop("e")


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat(F.trim(text(first)), F.lit(" "), F.trim(text(last))))


def records(entries: DataFrame) -> DataFrame:
    """Records of entries; one of an unknown kind has a null entity_type, which validation rejects."""
    vessel = F.create_map(
        *[x for k, c in (("call_sign", "callSign"), ("vessel_type", "vesselType"), ("flag", "vesselFlag"), ("owner", "vesselOwner"), ("tonnage", "tonnage"), ("grt", "grossRegisteredTonnage")) for x in (F.lit(k), F.trim(text(F.col(f"vesselInfo.{c}"))))]
    )

    def by_uid(values, make):
        return F.transform(F.array_sort(F.coalesce(values, F.array()), lambda a, b: F.when(a["uid"] < b["uid"], -1).when(a["uid"] > b["uid"], 1).otherwise(0)), make)

    alias = lambda a: F.struct(a["uid"].alias("source_uid"), a["type"].alias("type"), F.lower(text(a["category"])).alias("strength"), full_name(a["firstName"], a["lastName"]).alias("name"))
    ident = lambda i: F.struct(i["uid"].alias("source_uid"), i["idType"].alias("type"), i["idNumber"].alias("number"), i["idCountry"].alias("country"))
    return entries.select(
        F.concat(F.lit("ofac:sdn:"), "uid").alias("record_id"),
        F.col("uid").cast("long").alias("source_uid"),
        chosen(ENTRY_TYPES, F.lower(F.trim("sdnType"))).alias("entity_type"),
        full_name(F.col("firstName"), F.col("lastName")).alias("primary_name"),
        F.col("title"),
        F.col("remarks"),
        unique(F.col("programList.program")).alias("programs"),
        F.when(F.col("akaList.aka").isNotNull(), by_uid(F.col("akaList.aka"), alias)).alias("aliases"),
        F.col("addressList.address").alias("addresses"),
        F.when(F.col("idList.id").isNotNull(), by_uid(F.col("idList.id"), ident)).alias("identifiers"),
        unique(F.transform("dateOfBirthList.dateOfBirthItem", lambda d: d["dateOfBirth"])).alias("dates_of_birth"),
        F.map_filter(vessel, lambda _, v: v != "").alias("vessel"),
    )


def identifier_routes(kind: Column) -> Column:
    k = F.lower(text(kind))
    return F.array_compact(
        F.array(
            F.when(F.contains(k, F.lit("bic")) | F.contains(k, F.lit("swift")), F.lit("exact_bic")),
            F.when(F.contains(k, F.lit("legal entity identifier")) | (k == "lei"), F.lit("exact_lei")),
            F.when((F.contains(k, F.lit("account")) | F.contains(k, F.lit("iban"))) & ~F.contains(k, F.lit("imo")), F.lit("exact_account")),
        )
    )


def compiled(catalog: DataFrame) -> DataFrame:
    """(route, query, record_id, entity_type, value, score): what each record can be found by, each once."""

    def entry(route, value, score):
        return F.struct(F.lit(route).alias("route") if isinstance(route, str) else route.alias("route"), F.trim(text(value)).alias("value"), F.lit(score).alias("score"))

    none = F.array().cast("array<struct<route:string,value:string,score:int>>")

    def each(values, make):
        return F.coalesce(F.flatten(F.transform(values, make)), none)

    aliases = each(F.col("aliases"), lambda a: F.array(entry("alias", a["name"], 9700), entry("transliteration", a["name"], 9700)))
    parts = ("address1", "address2", "address3", "city", "stateOrProvince", "postalCode", "country")
    places = each(F.col("addresses"), lambda a: F.array(entry("jurisdiction_policy", a["country"], 10000), *[entry("contextual_address", a[p], 9000) for p in parts]))
    ids = each(F.col("identifiers"), lambda i: F.transform(identifier_routes(i["type"]), lambda r: entry(r, i["number"], 10000)))
    dates = F.transform("dates_of_birth", lambda d: entry("exact_date", d, 10000))
    every = F.concat(F.array(entry("normalized_name", F.col("primary_name"), 10000)), aliases, dates, places, F.array(entry("contextual_phrase", F.col("remarks"), 10000)), ids)
    flat = catalog.select("record_id", "entity_type", F.explode(F.filter(every, lambda e: e["value"] != "")).alias("e"))
    query = F.trim(F.regexp_replace(F.upper("e.value"), r"\s+", " "))
    return flat.select("e.route", query.alias("query"), "record_id", "entity_type", "e.value", "e.score").distinct()


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of JSON lines; a line that doesn't fit, or lacks id, schema or properties, is an error, and so is a repeated id."""
    out = spark.read.schema(ENTITY).option("mode", "FAILFAST").json(path)
    bad = out.where("id is null or trim(id) = '' or schema is null or properties is null").count()
    twice = out.groupBy("id").count().where("count > 1").count()
    if bad or twice:
        raise ValueError(f"{bad} incomplete and {twice} repeated entities in {path}")
    return out


def prop(name: str) -> Column:
    return unique(F.try_element_at("properties", F.lit(name)))


def targets(entities: DataFrame) -> DataFrame:
    """Entities of schemas that are screened, with names, identifiers and dates; others are dropped."""
    kind = chosen(SCHEMAS, F.col("schema"))
    first = F.get(prop("name"), F.lit(0))
    primary = F.coalesce(F.nullif(F.trim("caption"), F.lit("")), first)

    def alias(kind, strength):
        return lambda v: F.struct(v.alias("name"), F.lit(kind).alias("type"), F.lit(strength).alias("strength"))

    def identifier(name):
        return lambda v: F.struct(F.lit(name).alias("type"), v.alias("value"))

    aliases = F.concat(*[F.transform(prop(p), alias(k, s)) for p, k, s in ALIASES])
    ids = F.concat(*[F.transform(prop(p), identifier(t)) for p, t in IDENTIFIERS.items()])
    out = entities.select(F.col("id").alias("entity_id"), kind.alias("entity_type"), primary.alias("primary_name"), aliases.alias("a"), F.array_sort(ids).alias("identifiers"), prop("birthDate").alias("dates_of_birth"), F.coalesce("referents", F.array().cast("array<string>")).alias("referents"), F.try_element_at("properties", F.lit("addressEntity")).alias("address_ids"))
    out = out.where("entity_type is not null")
    return out.withColumn("aliases", F.array_sort(F.array_distinct(F.filter("a", lambda a: a["name"] != F.col("primary_name"))))).drop("a")


def resolved_references(found: DataFrame, references: DataFrame) -> DataFrame:
    """references (ref, ...) with entity_id of the one target whose id or referent it is, letters of any case; ambiguous ones get null."""
    key = lambda c: F.lower(F.trim(c))
    names = found.select("entity_id", F.explode(F.concat(F.array("entity_id"), "referents")).alias("n")).select("entity_id", key("n").alias("k")).where("k <> ''").distinct()
    one = names.groupBy("k").agg(F.min("entity_id").alias("entity_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return references.withColumn("k", key("ref")).join(one, "k", "left").drop("k")


def sanction_programs(entities: DataFrame) -> DataFrame:
    """(entity_id, programs) of targets that sanctions point at, by id or referent."""
    links = entities.where("schema = 'Sanction'").select(F.explode(prop("entity")).alias("ref"), prop("program").alias("programs"))
    hit = resolved_references(targets(entities), links).where("entity_id is not null")
    return hit.groupBy("entity_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("programs")))).alias("programs"))


def entity_addresses(entities: DataFrame) -> DataFrame:
    """(entity_id, country, city) of the addresses that targets point at, each once."""
    ids = targets(entities).select("entity_id", F.explode("address_ids").alias("address_id"))
    held = entities.where("schema = 'Address'").select(F.col("id").alias("address_id"), F.get(prop("country"), F.lit(0)).alias("country"), F.get(prop("city"), F.lit(0)).alias("city"))
    return ids.join(held, "address_id").select("entity_id", "country", "city").distinct()


def numeric_ids(values: Column) -> Column:
    return F.filter(unique(values), lambda v: v.rlike("^[0-9]+$"))


def resources(index: DataFrame, dataset: str, resource: str) -> DataFrame:
    """(url, checksum, size) of one resource of one dataset of index documents (value: JSON text)."""
    schema = "datasets array<struct<name:string,resources:array<struct<name:string,url:string,checksum:string,size:bigint>>>>"
    sets = index.select(F.explode(F.from_json("value", schema)["datasets"]).alias("d")).where(F.col("d.name") == dataset)
    return sets.select(F.explode("d.resources").alias("r")).where(F.col("r.name") == resource).select("r.url", "r.checksum", "r.size")
