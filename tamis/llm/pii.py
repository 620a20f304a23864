"""Information-theoretic sanitisation: protected entities, and the terms that disclose them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, restrict, settle

KINDS = ("email", "ip", "card", "phone")
#: Each finds the leftmost non-overlapping matches of the plain pattern in linear time:
#: a run of the first class is entered at its start or where the match before ended, and loops give nothing back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without it has no match that holds.
NEEDS = {"email": "@[A-Za-z0-9-]+[.]", "ip": r"[0-9][.][0-9]+[.][0-9]+[.][0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Strings of much information (a letter, a digit, 20 characters at least): keys, tokens, digests.  Protected, but no base kind.
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+"
#: Ends of sentences, and the words of a run that a longer sentence is cut into.
SENTENCE = r"(?<=[.!?])\s+|[\r\n]+"
PARTS = r"[\s,;|]+"
RUN = 64
#: Different sentences that a term and an entity must share.
SUPPORT = 5
#: Share of an entity's information that a term may disclose; from REMOVE on it is removed, below it generalised.
DISCLOSE = 0.5
REMOVE = 0.9
TERM = r"\p{L}+"
#: Matches that one step of the running sums takes, so that no array is copied over and over.
STEP = 256


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def chunks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(STEP)), lambda i: F.slice(items, i + 1, STEP))


def places(text: Column, pattern: str | Column, keep) -> Column:
    """(start, end) of the matches that keep accepts, in code points; what stands between matches gives the offsets.

    Offsets are running sums within chunks of STEP matches, from running sums
    of the chunks, so the work grows with the number of matches.
    """
    form = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, gaps = F.regexp_extract_all(text, form, F.lit(0)), F.split(text, form, -1)
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), keep(m).alias("k")))
    parts = chunks(F.filter(pairs, lambda p: p["n"].isNotNull()))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def begin(acc, c):
        size = F.aggregate(c, F.lit(0), lambda a, p: a + p["g"] + p["n"])
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def step(acc, p):
        start = acc["at"] + p["g"]
        end = start + p["n"]
        new = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["k"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    begins = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), begin)["out"]
    each = F.zip_with(parts, begins, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step)["out"])
    return F.flatten(each)


def entities(text: Column) -> Column:
    """Spans (kind, start, end) by kind as listed, then start."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def of(kind: str) -> Column:
        spans = F.when(text.rlike(NEEDS[kind]), places(text, PATTERNS[kind], lambda m: holds(kind, m))).otherwise(none)
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*[of(k) for k in KINDS])


def protected(text: Column) -> Column:
    """Entities and secrets (kind, start, end)."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.when(text.rlike(SECRET), places(text, SECRET, lambda m: F.lit(True))).otherwise(none)
    secrets = F.transform(spans, lambda s: F.struct(F.lit("secret").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.concat(entities(text), secrets)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def sentences(texts: DataFrame) -> DataFrame:
    """(s) of each sentence, or run of RUN parts of one."""
    whole = texts.select(F.explode(F.split("text", SENTENCE)).alias("s")).where("s <> ''").withColumn("w", F.split("s", PARTS))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(RUN)), lambda i: F.array_join(F.slice("w", i + 1, RUN), " "))
    return whole.select(F.explode(F.when(F.size("w") > RUN, runs).otherwise(F.array("s"))).alias("s"))


def disclosing(base: DataFrame, holders: DataFrame) -> DataFrame:
    """(term, kind, share): terms that disclose more of an entity's information than the thresholds allow, by corpus co-occurrence.

    holders: texts that have an entity.  An entity is a kind as such (that
    there is an address) and each value (which address it is).  A word stands
    with an entity if it is in the same sentence, on either side; sentences of
    more than RUN parts are taken in runs.  Over all words of the corpus, let p
    be the share that stands with e.  Knowing that one stands with e is worth
    -log2 p bits; a term t whose occurrences stand with e at the rate r
    discloses log2(r / p) of them.  The share of the two is compared with
    DISCLOSE.  r is taken a standard error lower (a support correction), counts
    equal sentences with e once, so copies of a text don't make its words
    disclosing, and needs SUPPORT different sentences.
    """
    # settled, so that the spans are found once and not again wherever they are used
    held = settle(sentences(holders).distinct().select("s", protected(F.col("s")).alias("spans")), "pii-held").where(F.size("spans") > 0)
    value = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), F.substring(F.col("s"), x["start"] + 1, x["end"] - x["start"]).alias("value")))
    named = F.array_distinct(F.concat(value, F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), F.lit(None).cast("string").alias("value")))))
    # the entities' own letters are no context
    bare = F.regexp_replace(F.regexp_replace("s", PATTERNS["email"], " "), SECRET, " ")
    rows = held.select(named.alias("es"), terms(bare).alias("w"))
    rows = settle(rows.where(F.size("w") > 0), "pii-sentences")
    all_words = base.agg(F.sum(F.size(terms(F.col("text"))))).first()[0] or 1
    mass = rows.select(F.explode("es").alias("e"), F.size("w").alias("n")).groupBy("e").agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("k"))
    mass = mass.where(F.col("k") >= SUPPORT).select("e", "mass")
    flat = rows.select("es", "w", F.explode(F.array_distinct("w")).alias("term"))
    often = F.size(F.filter("w", lambda x: x == F.col("term")))
    near = flat.select("term", F.explode("es").alias("e"), often.alias("n")).groupBy("term", "e").agg(F.sum("n").alias("near"), F.count(F.lit(1)).alias("support"))
    could = settle(near.where(F.col("support") >= SUPPORT).join(mass, "e"), "pii-could")
    names = settle(could.select("term").distinct(), "pii-names")
    n = names.count()
    if not n:
        return could.select("term", "e.kind", F.lit(0.0).alias("share"))
    side = F.broadcast(names) if n <= BROADCAST_KEYS // 4 else names
    seen = base.select(F.explode(terms(F.col("text"))).alias("term")).join(side, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    rate = F.greatest(F.col("near") - F.sqrt("near"), F.lit(0.0)) / F.col("seen")
    p = F.col("mass") / F.lit(float(all_words))
    share = F.when((rate > 0) & (p < 1), F.log2(rate / p) / -F.log2(p)).otherwise(0.0)
    found = could.join(seen, "term").select("term", "e.kind", share.alias("share")).where(F.col("share") >= DISCLOSE)
    top = F.max(F.struct("share", "kind")).alias("m")
    return found.groupBy("term").agg(top).select("term", F.col("m.kind").alias("kind"), F.col("m.share").alias("share"))


def sanitised_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (kind, start, end): entities, secrets, then kind `term` (generalised) or `removed` for each disclosing term.

    Defined results: null text counts as empty and has no span; spans depend on
    the text alone, so rows with null ids are judged like others and rows that
    repeat an id come out again, each with its own text's spans; an empty
    table gives an empty result; other columns are ignored, whatever their
    names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return found_spans(base).select(F.col("id").alias(id_col), "spans")


def found_spans(base: DataFrame) -> DataFrame:
    """base (id, text, others) without its text, and spans with what a disclosing term is generalised to."""
    none = F.lit(None).cast("string")
    first = F.transform(protected(F.col("text")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), none.alias("to")))
    rest = [c for c in base.columns if c != "text"]
    found = settle(base.select(*rest, F.md5("text").alias("__key"), first.alias("spans")), "pii-entities")
    holders = found.where(F.size("spans") > 0).select("__key").distinct()
    holders = settle(holders, "pii-holders")
    keyed = base.withColumn("__key", F.md5("text"))
    flagged = settle(disclosing(base, restrict(keyed, holders, "__key", holders.count())), "pii-terms")
    n = flagged.count()
    if not n:
        return found.drop("__key")
    side = F.broadcast(flagged) if n <= BROADCAST_KEYS // 4 else flagged
    told = F.struct(F.when(F.col("share") >= REMOVE, "removed").otherwise("term").alias("kind"), F.when(F.col("share") < REMOVE, F.col("kind")).alias("to"))
    words = keyed.select("__key", "text", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(side, "term")
    mine = words.groupBy("__key", "text").agg(F.map_from_entries(F.collect_set(F.struct(F.col("term"), told.alias("told")))).alias("told"))
    # this text's own terms: letters alone, so they need no quoting
    form = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(F.map_keys("told")), "|"), F.lit(r")(?!\p{L})"))
    at = places(F.col("text"), form, lambda m: F.map_contains_key("told", F.lower(m)))

    def span(s):
        t = F.try_element_at("told", F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
        return F.struct(t["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), t["to"].alias("to"))

    more = settle(mine.select(F.col("__key").alias("__mine"), F.transform(at, span).alias("more")).dropDuplicates(["__mine"]), "pii-more")
    both = found.join(more, F.col("__key") == F.col("__mine"), "left")
    return both.select(*rest, F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col sanitised, all columns kept.

    Entities and secrets become their kind in brackets.  A disclosing term is
    generalised to the kind that it discloses (`[email-related]`), or removed
    (`[removed]`) if it discloses nearly all; of overlapping spans the first one
    counts, of those with one start the longest.  Null texts stay null; rows
    with null or repeated ids are handled each by its own text.
    """
    every = F.struct(*[docs[c] for c in docs.columns]).alias("id")
    base = docs.select(every, F.coalesce(docs[text_col], F.lit("")).alias("text"))
    both = found_spans(base)
    text = F.col("id")[text_col]
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["to"].alias("to"))))
    parts = chunks(by_start)
    reached = F.transform(parts, lambda c: F.greatest(F.array_max(F.transform(c, lambda s: -s["back"])), F.lit(0)))

    def begin(acc, end):
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    begins = F.aggregate(reached, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), begin)["out"]

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        word = F.when(s["kind"] == "term", F.concat(F.lit("["), s["to"], F.lit("-related]"))).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        new = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), word)
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(fresh, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<string>")
    made = F.zip_with(parts, begins, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step)["out"])
    last = F.array_max(reached)
    clean = F.concat(F.array_join(F.flatten(made), ""), F.substring(text, last + 1, F.length(text)))
    done = F.when(F.size("spans") > 0, clean).otherwise(text)
    return both.select(*[done.alias(c) if c == text_col else F.col("id")[c].alias(c) for c in docs.columns])
