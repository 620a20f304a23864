"""Queries of lists in the advanced form, made of suppliers, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.sources import advanced as A

from .base import bound

SETS = """<ReferenceValueSets><PartySubTypeValues><PartySubType ID="1">Vessel</PartySubType><PartySubType ID="2">Entity</PartySubType></PartySubTypeValues><ScriptValues><Script ID="1">Cyrillic</Script><Script ID="2">Latin</Script></ScriptValues>
<AliasTypeValues><AliasType ID="1">A.K.A.</AliasType></AliasTypeValues><LocPartTypeValues><LocPartType ID="1">CITY</LocPartType><LocPartType ID="2">ADDRESS1</LocPartType><LocPartType ID="3">POSTAL CODE</LocPartType></LocPartTypeValues>
<CountryValues><Country ID="1">Landia</Country></CountryValues><IDRegDocTypeValues><IDRegDocType ID="1">Passport</IDRegDocType></IDRegDocTypeValues><FeatureTypeValues><FeatureType ID="1">Location</FeatureType><FeatureType ID="2">Birthdate</FeatureType></FeatureTypeValues>
<ListValues><List ID="1">SDN List</List><List ID="2">Other List</List></ListValues><SanctionsTypeValues><SanctionsType ID="1">Program</SanctionsType><SanctionsType ID="2">Block</SanctionsType></SanctionsTypeValues><RelationTypeValues><RelationType ID="1">owned by</RelationType></RelationTypeValues></ReferenceValueSets>""".replace("\n", "")


def files(spark, sf_dir):
    """A file for each ten suppliers."""
    rows = bound(spark, sf_dir, "SELECT s_suppkey AS k, s_name, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey")
    k = F.col("k").cast("string")
    city = F.concat(F.lit('<LocationPart LocPartTypeID="1"><LocationPartValue><Value>old</Value></LocationPartValue><LocationPartValue Primary="true"><Value>'), "n_name", F.lit("</Value></LocationPartValue></LocationPart>"))
    place = F.concat(F.lit('<Location ID="L'), k, F.lit('"><LocationCountry CountryID="1"/><LocationPart LocPartTypeID="2"><LocationPartValue><Value>Road '), k, F.lit("</Value></LocationPartValue></LocationPart>"), city, F.lit("</Location>"))
    paper = F.concat(F.lit('<IDRegDocument ID="D'), k, F.lit('" IDRegDocTypeID="1" IdentityID="I'), k, F.lit('"><IDRegistrationNo>P'), k, F.lit("</IDRegistrationNo></IDRegDocument>"))

    def alias(ident, primary, script, *words):
        parts = [x for w in words for x in (F.lit(f'<DocumentedNamePart><NamePartValue ScriptID="{script}">'), w, F.lit("</NamePartValue></DocumentedNamePart>"))]
        return F.concat(F.lit(f'<Alias FixedRef="{ident}'), k, F.lit(f'" AliasTypeID="1" Primary="{primary}"><DocumentedName>'), *parts, F.lit("</DocumentedName></Alias>"))

    names = F.concat(alias("1", "true", 1, F.lit("кир")), F.when(F.col("k") % 3 == 0, alias("2", "true", 2, F.lit("Big"), F.col("s_name"))).otherwise(alias("2", "false", 2, F.col("s_name"))))
    feature = F.concat(F.lit('<Feature FeatureTypeID="1"><FeatureVersion><VersionLocation LocationID="L'), k, F.lit('"/></FeatureVersion></Feature><Feature FeatureTypeID="2"><FeatureVersion><DatePeriod><Start><From><Year>19'), F.lpad((F.col("k") % 100).cast("string"), 2, "0"), F.lit("</Year><Month>5</Month></From></Start><End><From><Year>1999</Year></From></End></DatePeriod></FeatureVersion></Feature>"))
    profile = F.concat(F.lit('<Profile ID="R'), k, F.lit('" PartySubTypeID="'), (F.col("k") % 2 + 1).cast("string"), F.lit('"><Identity ID="I'), k, F.lit('">'), names, F.lit("</Identity>"), feature, F.lit("</Profile>"))
    second = F.when(F.col("k") % 7 == 0, F.concat(F.lit('<Profile ID="S'), k, F.lit('" PartySubTypeID="1"><Identity ID="J'), k, F.lit('"/></Profile>'))).otherwise("")
    party = F.concat(F.lit('<DistinctParty FixedRef="'), (F.col("k") + 1).cast("string"), F.lit('"><Comment>note</Comment>'), profile, second, F.lit("</DistinctParty>"))
    entry = F.concat(F.lit('<SanctionsEntry ID="E'), k, F.lit('" ProfileID="R'), k, F.lit('" ListID="'), F.when(F.col("k") % 5 == 0, "2").otherwise("1"), F.lit('"><SanctionsMeasure SanctionsTypeID="1"><Comment>PROG'), (F.col("k") % 4).cast("string"), F.lit('</Comment></SanctionsMeasure><SanctionsMeasure SanctionsTypeID="2"><Comment>x</Comment></SanctionsMeasure></SanctionsEntry>'))
    link = F.when(F.col("k") % 10 > 0, F.concat(F.lit('<ProfileRelationship From-ProfileID="R'), k, F.lit('" To-ProfileID="R'), (F.col("k") - 1).cast("string"), F.lit('" RelationTypeID="1"/>'))).otherwise("")
    cols = [F.array_join(F.collect_list(c), "") for c in (place, paper, party, entry, link)]
    tags = ("Locations", "IDRegDocuments", "DistinctParties", "SanctionsEntries", "ProfileRelationships")
    body = F.concat(F.lit(f'<Sanctions xmlns="urn:x">{SETS}'), *[x for t, c in zip(tags, cols, strict=True) for x in (F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))], F.lit("</Sanctions>"))
    return rows.groupBy(F.expr("k div 10").alias("file")).agg(body.alias("value"))


def advanced_parties(spark, sf_dir):
    """Parties of the list, their sections joined."""
    out = A.parties(files(spark, sf_dir))
    joined = lambda c, make: F.array_join(F.transform(c, make), "|")
    return out.select(
        "uid", "kind", "conflict", "primary_name", joined("names", lambda n: n["value"]).alias("names"), joined("identifiers", lambda i: F.concat_ws(":", i["type"], i["number"])).alias("identifiers"),
        joined("addresses", lambda a: F.concat_ws(",", a["address1"], a["city"], a["country"])).alias("addresses"), F.array_join("dates_of_birth", "|").alias("dates"), F.array_join("programs", ",").alias("programs"),
    )


def advanced_relations(spark, sf_dir):
    return A.relations(files(spark, sf_dir))


QUERIES = {f.__name__: f for f in (advanced_parties, advanced_relations)}

_S = "SELECT s_suppkey AS k, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
ORACLE = {
    "advanced_parties": f"""
SELECT k + 1 AS uid, CASE WHEN k % 2 = 0 THEN 'Vessel' ELSE CASE WHEN k % 7 = 0 THEN 'Entity' ELSE 'Entity' END END AS kind, k % 2 = 1 AND k % 7 = 0 AS conflict,
  CASE WHEN k % 3 = 0 THEN 'Big ' || s_name ELSE 'кир' END AS primary_name, CASE WHEN k % 3 = 0 THEN 'кир|Big ' || s_name ELSE 'кир|' || s_name END AS names, 'Passport:P' || k AS identifiers,
  'Road ' || k || ',' || n_name || ',Landia' AS addresses, '19' || lpad((k % 100)::VARCHAR, 2, '0') || '-05 to 1999' AS dates, 'PROG' || (k % 4) AS programs FROM ({_S}) WHERE k % 5 <> 0
""",
    "advanced_relations": "SELECT s_suppkey + 1 AS from_uid, s_suppkey AS to_uid, 'owned by' AS type FROM supplier WHERE s_suppkey % 10 > 0",
}
