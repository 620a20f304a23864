"""Names inside narratives: phrase windows, denials around them, jurisdictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.similarity import div
from tamis.functions.text import PARTED, context_fold, fields, replaced, text, upper

# fixed values: weights and bounds of the narrative profile, and words of denial
PHRASE, COMPACT, SOURCE = 5000, 3000, 2000
ORDERED = 9000
EXTRA, SINGLE_LEAST = 3, 6
WEAK_PENALTY, DENIAL_PENALTY, DENIAL_WINDOW = 500, 6000, 6
THRESHOLD, FLOOR = 8500, 3000
DENIALS = ["DECLINED", "DENIED", "NO", "NO BUSINESS RELATIONSHIP", "NOT", "REJECTED", "WITHOUT"]


def contiguous(query: Column, phrase: Column) -> Column:
    """First place (from 0) where the phrase stands in the query, or -1."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(query) - F.size(phrase), F.lit(0))), lambda i: F.slice(query, i + 1, F.size(phrase)) == phrase)
    return F.when((F.size(phrase) > 0) & (F.size(phrase) <= F.size(query)), F.coalesce(F.get(at, F.lit(0)), F.lit(-1))).otherwise(-1)


def reached(query: Column, phrase: Column, start: Column, extra: int = EXTRA) -> Column:
    """(k, end): how many of the phrase's words come in order from `start` on, where its first stands, with at most `extra` others."""
    m = F.size(phrase)
    limit = F.least(start + m + extra, F.size(query))
    zero = F.struct(F.lit(1).alias("k"), (start + 1).alias("end"))

    def step(acc, p):
        more = (acc["k"] < m) & (p < limit)
        hit = more & (F.get(query, p) == F.get(phrase, acc["k"]))
        return F.struct(F.when(hit, acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.when(more, p + 1).otherwise(acc["end"]).alias("end"))

    return F.aggregate(F.sequence(start + 1, F.greatest(start + 1, limit)), zero, step)


def ordered(query: Column, phrase: Column, extra: int = EXTRA) -> Column:
    """First (start, end) from the phrase's first word on, in which its words come in order with at most `extra` others; or null."""
    n, m = F.size(query), F.size(phrase)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(query, i) == F.get(phrase, F.lit(0)))
    tried = F.transform(starts, lambda s: F.struct(s.alias("start"), reached(query, phrase, s, extra).alias("r")))
    good = F.get(F.filter(tried, lambda t: t["r"]["k"] == m), F.lit(0))
    return F.when((n > 0) & (m > 0) & good.isNotNull(), F.struct(good["start"].alias("start"), good["r"]["end"].alias("end")))


def denials(query: Column, start: Column, end: Column) -> Column:
    """Words of denial within DENIAL_WINDOW words of the span, sorted."""
    left = F.greatest(start - DENIAL_WINDOW, F.lit(0))
    near = F.concat(F.lit(" "), F.array_join(F.slice(query, left + 1, F.least(end + DENIAL_WINDOW, F.size(query)) - left), " "), F.lit(" "))
    return F.filter(F.array(*map(F.lit, sorted(DENIALS))), lambda d: F.contains(near, F.concat(F.lit(" "), d, F.lit(" "))))


def words_of(rows: DataFrame, value: str, others: list[str]) -> DataFrame:
    """others and `q`, the words of the value's context_fold, one step after another: one expression would fold a text several times.

    A text without words has one, the empty one.
    """
    steps = rows.select(*others, text(F.col(value)).alias("v"))
    for step in (upper, replaced):
        steps = steps.select(*others, step(F.col("v")).alias("v"))
    return steps.select(*others, F.split(F.trim(F.regexp_replace("v", PARTED, " ")), " ").alias("q"))


def narrative_matches(narratives: DataFrame, entries: DataFrame, least: int = SINGLE_LEAST) -> DataFrame:
    """Entries (record_id, route, weak, phrase) in narratives (id, text), with score and reasons; FLOOR at least.

    Each word of a narrative goes with the few words around it and meets the
    phrases that begin with it.  Only windows in which the phrase's second word
    follows are searched, and of the places of one phrase in one narrative the
    first contiguous one counts, or else the first in order.
    """
    e = entries.withColumn("p", fields(context_fold(F.col("phrase")))).where(F.size("p") > 0)
    e = e.where((F.size("p") > 1) | (F.length(F.get("p", F.lit(0))) >= least)).dropDuplicates(["record_id", "route", "p"])
    e = e.select("record_id", "route", "weak", "p", F.get("p", F.lit(0)).alias("w"))
    n = words_of(narratives.where("id is not null"), "text", ["id"])
    n = n.crossJoin(F.broadcast(e.agg(F.coalesce(F.max(F.size("p")), F.lit(0)).alias("longest"))))
    near = F.slice("q", F.greatest(F.col("at") - DENIAL_WINDOW, F.lit(0)) + 1, F.col("longest") + EXTRA + 2 * DENIAL_WINDOW)
    each = n.select("id", "q", "longest", F.posexplode("q").alias("at", "w")).select("id", "at", "w", near.alias("near"))
    start, m = F.least(F.col("at"), F.lit(DENIAL_WINDOW)), F.size("p")  # start: where the word stands in its window
    second = (m == 1) | F.array_contains(F.slice("near", start + 2, m + EXTRA - 1), F.get("p", F.lit(1)))
    met = each.join(e, "w").where(second).withColumn("exact", F.slice("near", start + 1, m) == F.col("p"))
    # exploding an array of one keeps the search from being planned again where its result is used
    span = F.when(F.col("exact"), F.struct(m.alias("k"), (start + m).alias("end"))).otherwise(reached(F.col("near"), F.col("p"), start))
    met = met.withColumn("r", F.explode(F.array(span))).where(F.col("r.k") == m)
    place = F.struct((~F.col("exact")).alias("loose"), "at", (F.col("at") - start + F.col("r.end")).alias("end"), "near")
    both = met.groupBy("id", "record_id", "route", "weak", "p").agg(F.min(place).alias("b"))
    both = both.select("id", "record_id", "route", "weak", "p", (~F.col("b.loose")).alias("exact"), F.struct(F.col("b.at").alias("start"), "b.end").alias("span"), F.col("b.near").alias("near"), F.least(F.col("b.at"), F.lit(DENIAL_WINDOW)).alias("from"))
    said_no = denials(F.col("near"), F.col("from"), F.col("from") + F.col("span.end") - F.col("span.start"))
    both = both.withColumn("denials", F.explode(F.array(said_no)))
    exact, weak = F.col("exact"), F.coalesce("weak", F.lit(False))
    quality = F.when(F.col("route") == "normalized_name", 10000).when(F.col("route") == "alias", F.when(weak, 8000).otherwise(9500)).when(F.col("route") == "transliteration", 9000).otherwise(8500)
    dense = div(F.size("p") * 10000, F.col("span.end") - F.col("span.start"))
    points = div(F.when(exact, 10000).otherwise(ORDERED) * PHRASE, 10000) + div(quality * SOURCE, 10000) + div(dense * COMPACT, 10000)
    points = points - F.when(weak, WEAK_PENALTY).otherwise(0) - F.when(F.size("denials") > 0, DENIAL_PENALTY).otherwise(0)
    source = F.when(F.col("route") == "normalized_name", "primary_name_context").when(F.col("route") == "alias", "alias_context").when(F.col("route") == "transliteration", "transliteration_context")
    said = F.array_compact(F.array(F.when(exact, F.lit("narrative_phrase_exact")).otherwise("narrative_ordered_window"), source, F.when(F.size("denials") > 0, F.lit("narrative_denial_context"))))
    out = both.withColumns({"score": F.greatest(F.lit(0).cast("long"), points), "reasons": F.array_sort(said)}).where(F.col("score") >= FLOOR)
    return out.select("id", "record_id", "route", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "score", "reasons", "denials")


def best_by_record(matches: DataFrame) -> DataFrame:
    """Candidates: the best match of each record that isn't denied and reaches the threshold."""
    good = matches.where((F.size("denials") == 0) & (F.col("score") >= THRESHOLD))
    by = Window.partitionBy("id", "record_id").orderBy(F.desc("score"), "route", "start", "end")
    return good.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")


def jurisdictions(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy entries (entry_id, alpha2, alpha3, country, aliases) that a request's whole value names, and how."""
    names = F.array(
        F.struct(F.lit(0).alias("o"), F.lit("alpha2").alias("kind"), F.col("alpha2").alias("v")),
        F.struct(F.lit(1).alias("o"), F.lit("alpha3").alias("kind"), F.col("alpha3").alias("v")),
        F.struct(F.lit(2).alias("o"), F.lit("country_name").alias("kind"), F.col("country").alias("v")),
    )
    rest = F.transform("aliases", lambda a: F.struct(F.lit(3).alias("o"), F.lit("alias").alias("kind"), a.alias("v")))
    flat = policy.select("entry_id", F.explode(F.concat(names, rest)).alias("n")).select("entry_id", "n.o", "n.kind", context_fold(F.col("n.v")).alias("k"))
    one = flat.where("k <> ''").groupBy("k", "entry_id").agg(F.min(F.struct("o", "kind")).alias("m"))
    asked = requests.withColumn("k", context_fold(F.col("value")))
    return asked.join(F.broadcast(one), "k").select("request_id", "entry_id", F.col("m.kind").alias("kind"), F.lit(10000).alias("score"))
