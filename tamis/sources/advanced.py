"""Lists in the advanced XML form: reference sets, locations, documents, parties, entries and relations, joined by id.

The sections of such a file point at each other by id.  Each is read into a
flat table of its own, and the tables are joined; a party never needs the
whole file in one place.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTIONS = {
    "sets": "set string, id string, label string",
    "locations": "location_id string, country_id string, part_type_id string, place int, value string",
    "documents": "document_id string, identity_id string, type_id string, number string, country_id string",
    "names": "uid long, profile_id string, identity_id string, alias_id string, alias_type_id string, is_primary boolean, low_quality boolean, place int, script_id string, value string",
    "profiles": "uid long, profile_id string, subtype_id string, remarks string",
    "features": "uid long, profile_id string, type_id string, location_id string, detail string",
    "entries": "entry_id string, profile_id string, list_id string, measure_type_id string, comment string",
    "relations": "from_profile string, to_profile string, type_id string",
}
LATIN = "latin"


def local(node) -> str:
    return node.tag.rpartition("}")[2]


def children(node, name):
    return [c for c in node if local(c) == name]


def below(node, name):
    return [c for c in node.iter() if c is not node and local(c) == name]


def text_of(node) -> str:
    return (node.text or "").strip() if node is not None else ""


def truth(value) -> bool:
    return (value or "").strip().lower() in ("true", "1")


def day(node) -> str:
    """YYYY, YYYY-MM or YYYY-MM-DD of a date's parts."""
    out = []
    for part, width in (("Year", 4), ("Month", 2), ("Day", 2)):
        found = below(node, part)
        if not found or not text_of(found[0]):
            break
        out.append(text_of(found[0]).zfill(width))
    return "-".join(out)


def period(node) -> str:
    """A date, or `a to b` of a period whose ends differ."""
    ends = [[day(n) for n in below(node, e)] for e in ("Start", "End")]
    first, last = (next((d for d in e if d), "") for e in ends)
    return f"{first} to {last}" if first and last and first != last else first or last or day(node)


def rows_of(root) -> dict[str, list[tuple]]:
    """Rows of each section of one file's tree."""
    out = {k: [] for k in SECTIONS}

    def sets(node, name):
        name = local(node) if local(node).endswith("Values") else name
        if name and node.get("ID") and text_of(node):
            out["sets"].append((name, node.get("ID"), text_of(node)))
        for c in node:
            sets(c, name)

    for section in children(root, "ReferenceValueSets"):
        sets(section, "")
    for n in below(root, "Location"):
        if not n.get("ID") or local(n) != "Location":
            continue
        country = next((c.get("CountryID") for c in children(n, "LocationCountry")), None)
        out["locations"].append((n.get("ID"), country, None, -1, None))
        for k, part in enumerate(children(n, "LocationPart")):
            values = children(part, "LocationPartValue")
            best = next((v for v in values if truth(v.get("Primary"))), values[0] if values else None)
            value = next((text_of(v) for v in below(best, "Value")), "") if best is not None else ""
            if value:
                out["locations"].append((n.get("ID"), country, part.get("LocPartTypeID"), k, value))
    for n in below(root, "IDRegDocument"):
        number = next((text_of(c) for c in children(n, "IDRegistrationNo")), "")
        if n.get("ID") and number:
            out["documents"].append((n.get("ID"), n.get("IdentityID"), n.get("IDRegDocTypeID"), number, n.get("IssuedBy-CountryID")))
    for party in below(root, "DistinctParty"):
        uid = int(party.get("FixedRef") or party.get("ID") or 0)
        remarks = " | ".join(t for t in (text_of(c) for c in children(party, "Comment")) if t)
        for profile in children(party, "Profile"):
            pid = profile.get("ID")
            out["profiles"].append((uid, pid, profile.get("PartySubTypeID"), remarks))
            for identity in children(profile, "Identity"):
                for a in children(identity, "Alias"):
                    for k, documented in enumerate(below(a, "DocumentedName")):
                        parts = [p[0] for p in (children(d, "NamePartValue") for d in children(documented, "DocumentedNamePart")) if p]
                        value = " ".join(t for t in map(text_of, parts) if t)
                        if value:
                            alias_id = a.get("FixedRef") or a.get("ID")
                            out["names"].append((uid, pid, identity.get("ID"), alias_id, a.get("AliasTypeID"), truth(a.get("Primary")), truth(a.get("LowQuality")), k, parts[0].get("ScriptID"), value))
            for feature in children(profile, "Feature"):
                at = [v.get("LocationID") for v in below(feature, "VersionLocation")] or [None]
                details = [t for t in (text_of(d) for d in below(feature, "VersionDetail")) if t] or [period(feature)]
                out["features"] += [(uid, pid, feature.get("FeatureTypeID"), where, what or None) for where in at for what in details]
    for n in below(root, "SanctionsEntry"):
        for m in children(n, "SanctionsMeasure") or [ET.Element("x")]:
            comment = next((text_of(c) for c in children(m, "Comment")), None)
            out["entries"].append((n.get("ID"), n.get("ProfileID"), n.get("ListID"), m.get("SanctionsTypeID"), comment))
    for n in below(root, "ProfileRelationship"):
        out["relations"].append((n.get("From-ProfileID"), n.get("To-ProfileID"), n.get("RelationTypeID")))
    return out


def section(files: DataFrame, name: str) -> DataFrame:
    """One section of files (value: a file's XML) as rows.  Declarations of types or entities are an error."""
    schema = SECTIONS[name]
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            for value in pdf["value"]:
                if "<!DOCTYPE" in value.upper() or "<!ENTITY" in value.upper():
                    raise ValueError("unsafe declaration in a list file")
                yield pd.DataFrame(rows_of(ET.fromstring(value))[name], columns=columns)

    return files.select("value").mapInPandas(run, schema)


def labelled(rows: DataFrame, sets: DataFrame, on: str, to: str, preferred: str) -> DataFrame:
    """rows with the label of an id: from the preferred set, else from the first set that has it; null if none does."""
    one = sets.groupBy("id").agg(F.max(F.when(F.col("set") == preferred, F.col("label"))).alias("p"), F.min_by("label", "set").alias("a"))
    one = one.select(F.col("id").alias(f"__{on}"), F.coalesce("p", "a").alias(to))
    return rows.join(F.broadcast(one), F.col(on) == F.col(f"__{on}"), "left").drop(f"__{on}")


def address_field(kind: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    has = lambda *words: k.rlike("|".join(words))
    return (
        F.when(has("postal", "zip"), "postal_code")
        .when(has("city", "town"), "city")
        .when(has("state", "province", "region"), "state")
        .when(has("country"), "country")
        .otherwise("line")
    )


def addresses(locations: DataFrame, sets: DataFrame) -> DataFrame:
    """(location_id, address1, address2, address3, city, state, postal_code, country): parts by their type, the first of each; three lines at most."""
    rows = labelled(labelled(locations, sets, "part_type_id", "part_type", "LocPartTypeValues"), sets, "country_id", "named", "CountryValues")
    rows = rows.withColumn("field", F.when(F.col("place") >= 0, address_field(F.col("part_type"))))
    nth = F.row_number().over(Window.partitionBy("location_id", "field").orderBy("place"))
    rows = rows.withColumn("n", nth)

    def first(field, n=1):
        return F.max(F.when((F.col("field") == field) & (F.col("n") == n), F.col("value")))

    lines = [first("line", n).alias(f"address{n}") for n in (1, 2, 3)]
    rest = [first(f).alias(f) for f in ("city", "state", "postal_code")]
    return rows.groupBy("location_id").agg(*lines, *rest, F.coalesce(F.max("named"), first("country")).alias("country"))


def primary_name(names: Column) -> Column:
    """Primary and Latin, else primary, else Latin, else the first of names (is_primary, script, value)."""
    latin = lambda n: F.lower(F.coalesce(n["script"], F.lit(""))).contains(LATIN)

    def pick(test):
        return F.get(F.filter(names, test), F.lit(0))["value"]

    return F.coalesce(pick(lambda n: n["is_primary"] & latin(n)), pick(lambda n: n["is_primary"]), pick(latin), F.get(names, F.lit(0))["value"])


def parties(files: DataFrame, list_label: str = "SDN List") -> DataFrame:
    """Records of parties on the named list: names, addresses, identifiers, dates, programmes and kind, joined over all profiles of a party.

    Profiles of a party that state different kinds make `conflict` true.
    Programmes are comments of measures whose type names a programme.
    """
    t = {k: section(files, k) for k in SECTIONS}
    sets = t["sets"].distinct()
    names = labelled(labelled(t["names"], sets, "script_id", "script", "ScriptValues"), sets, "alias_type_id", "alias_type", "AliasTypeValues")
    held = F.struct((~F.col("is_primary")).alias("o"), "alias_id", "place", "is_primary", "script", "value", "alias_type", "low_quality")
    names = names.groupBy("uid").agg(F.array_sort(F.collect_set(held)).alias("names"))
    kinds = labelled(t["profiles"], sets, "subtype_id", "kind", "PartySubTypeValues")
    kinds = kinds.groupBy("uid").agg(F.min(F.coalesce("kind", F.lit("Entity"))).alias("kind"), (F.count_distinct(F.coalesce("kind", F.lit("Entity"))) > 1).alias("conflict"), F.max("remarks").alias("remarks"))
    by_profile = t["profiles"].select("uid", "profile_id").distinct()
    ids = labelled(t["documents"], sets, "type_id", "type", "IDRegDocTypeValues").join(t["names"].select("uid", "identity_id").distinct(), "identity_id")
    ids = ids.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("type", "number"))).alias("identifiers"))
    places = addresses(t["locations"].distinct(), sets)
    traits = labelled(t["features"], sets, "type_id", "trait", "FeatureTypeValues")
    located = traits.where("location_id is not null").select("uid", "location_id").distinct().join(places, "location_id")
    located = located.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("address1", "city", "country"))).alias("addresses"))
    born = traits.where(F.lower("trait") == "birthdate").groupBy("uid").agg(F.array_sort(F.collect_set("detail")).alias("dates_of_birth"))
    lists = labelled(labelled(t["entries"], sets, "list_id", "list", "ListValues"), sets, "measure_type_id", "measure", "SanctionsTypeValues")
    lists = lists.where(F.col("list") == list_label).join(by_profile, "profile_id")
    lists = lists.groupBy("uid").agg(F.array_sort(F.collect_set(F.when(F.upper("measure").contains("PROGRAM"), F.col("comment")))).alias("programs"))
    out = lists.join(kinds, "uid").join(names, "uid", "left").join(ids, "uid", "left").join(located, "uid", "left").join(born, "uid", "left")
    return out.withColumn("primary_name", primary_name(F.col("names")))


def relations(files: DataFrame) -> DataFrame:
    """(from_uid, to_uid, type) between parties, from their profiles."""
    sets, by = section(files, "sets").distinct(), section(files, "profiles").select("uid", "profile_id").distinct()
    rows = labelled(section(files, "relations"), sets, "type_id", "type", "RelationTypeValues")
    rows = rows.join(by.toDF("from_uid", "from_profile"), "from_profile").join(by.toDF("to_uid", "to_profile"), "to_profile")
    return rows.select("from_uid", "to_uid", "type").distinct()
