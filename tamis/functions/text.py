"""Normalisers of names, identifiers and codes as column expressions.

Null counts as empty in all of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters whose upper case is more than one code point; these stay as they are.
LONG_UPPER = "[ßŉǰΐΰևẖ-ẚﬀ-ﬆﬓ-ﬗὐὒὔὖᾀ-ῼ]"

#: Of these, the ones that have an upper case of one code point besides, and it.
ONE_UPPER = ("ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ")

# fixed values: letters that folding replaces, in both folds
FOLD = {
    "À": "A", "Á": "A", "Â": "A", "Ã": "A", "Ä": "A", "Å": "A", "Æ": "AE",
    "Ç": "C", "È": "E", "É": "E", "Ê": "E", "Ë": "E", "Ì": "I", "Í": "I",
    "Î": "I", "Ï": "I", "Ð": "D", "Ñ": "N", "Ò": "O", "Ó": "O", "Ô": "O",
    "Õ": "O", "Ö": "O", "Ø": "O", "Œ": "OE", "Ù": "U", "Ú": "U", "Û": "U",
    "Ü": "U", "Ý": "Y", "Þ": "TH", "ß": "SS", "Š": "S", "Ž": "Z", "Ł": "L",
    "Đ": "D", "Ğ": "G", "İ": "I", "Ş": "S", "Č": "C", "Ć": "C", "Ř": "R",
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ё": "E",
    "Ж": "ZH", "З": "Z", "И": "I", "Й": "I", "К": "K", "Л": "L", "М": "M",
    "Н": "N", "О": "O", "П": "P", "Р": "R", "С": "S", "Т": "T", "У": "U",
    "Ф": "F", "Х": "KH", "Ц": "TS", "Ч": "CH", "Ш": "SH", "Щ": "SHCH",
    "Ы": "Y", "Э": "E", "Ю": "YU", "Я": "YA", "Ь": "", "Ъ": "",
}
# fixed values: short names and what they stand for
NICKNAMES = {
    "BILL": "WILLIAM", "WILL": "WILLIAM", "BILLY": "WILLIAM", "WILLY": "WILLIAM",
    "BOB": "ROBERT", "BOBBY": "ROBERT", "ROB": "ROBERT", "ROBBIE": "ROBERT",
    "DICK": "RICHARD", "RICK": "RICHARD", "RICKY": "RICHARD", "RICHIE": "RICHARD",
    "JIM": "JAMES", "JIMMY": "JAMES", "JACK": "JOHN", "JOHNNY": "JOHN",
    "TOM": "THOMAS", "TOMMY": "THOMAS", "MIKE": "MICHAEL", "MICKEY": "MICHAEL", "MIKEY": "MICHAEL",
    "DAVE": "DAVID", "DAVEY": "DAVID", "CHUCK": "CHARLES", "CHARLIE": "CHARLES",
    "ED": "EDWARD", "EDDIE": "EDWARD", "TED": "EDWARD", "TEDDY": "EDWARD",
    "TONY": "ANTHONY", "ANDY": "ANDREW", "DREW": "ANDREW", "GREG": "GREGORY",
    "KEN": "KENNETH", "KENNY": "KENNETH", "LARRY": "LAWRENCE", "JOE": "JOSEPH", "JOEY": "JOSEPH",
    "PETE": "PETER", "MATT": "MATTHEW", "DAN": "DANIEL", "DANNY": "DANIEL",
    "NICK": "NICHOLAS", "NICKY": "NICHOLAS", "ALEX": "ALEXANDER", "BEN": "BENJAMIN", "BENNY": "BENJAMIN",
    "HANK": "HENRY", "HARRY": "HAROLD", "RON": "RONALD", "RONNIE": "RONALD", "STAN": "STANLEY", "WALT": "WALTER",
    "LIZ": "ELIZABETH", "BETH": "ELIZABETH", "LIZZY": "ELIZABETH", "ELIZA": "ELIZABETH", "BETSY": "ELIZABETH",
    "PEGGY": "MARGARET", "MEG": "MARGARET", "MAGGIE": "MARGARET", "MARGE": "MARGARET",
    "KATE": "KATHERINE", "KATIE": "KATHERINE", "KATHY": "KATHERINE",
    "SUE": "SUSAN", "SUZY": "SUSAN", "SUZANNE": "SUSAN", "JEN": "JENNIFER", "JENNY": "JENNIFER",
    "PATTY": "PATRICIA", "TRISH": "PATRICIA", "TRICIA": "PATRICIA", "DEB": "DEBORAH", "DEBBIE": "DEBORAH",
    "CINDY": "CYNTHIA", "BARB": "BARBARA", "BARBIE": "BARBARA", "CARRIE": "CAROLINE", "GINNY": "VIRGINIA",
    "JOSIE": "JOSEPHINE", "PENNY": "PENELOPE", "SANDY": "SANDRA", "VICKY": "VICTORIA", "WENDY": "GWENDOLYN",
    "EL": "AL",
}
# fixed values: tokens that name matching leaves out, and those that evidence scoring leaves out
SUFFIXES = (
    "LLC LLP LP LTD LIMITED INC INCORPORATED CORP CORPORATION CO COMPANY GMBH AG KG GBR SA SAS SARL SL SPA SRL NV BV PLC PTY OY AB AS ASA"
).split()
HONORIFICS = "MR MRS MS MISS MX DR PROF PROFESSOR REV REVEREND HON HONORABLE SIR DAME LORD LADY ESQ ESQUIRE".split()
PARTICLES = "AL BIN VAN DER DE DA DEL DOS DAS LA LE VON IBN".split()
# fixed values: names of kinds of entities
ENTITY_TYPES = {
    "PERSON": "PERSON", "INDIVIDUAL": "PERSON", "NATURAL PERSON": "PERSON",
    "ORGANIZATION": "ORGANIZATION", "ORGANISATION": "ORGANIZATION", "ENTITY": "ORGANIZATION",
    "COMPANY": "ORGANIZATION", "BUSINESS": "ORGANIZATION",
    "VESSEL": "VESSEL", "SHIP": "VESSEL", "AIRCRAFT": "AIRCRAFT", "PLANE": "AIRCRAFT",
}


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def upper(value: Column) -> Column:
    """Upper case code point by code point: what would grow stays."""
    each = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")
    return F.when(value.rlike(LONG_UPPER), each).otherwise(F.upper(value))


def text_key(value: Column) -> Column:
    """Upper case, letters and digits kept, every other run one space."""
    return F.trim(F.regexp_replace(upper(text(value)), r"[^\p{L}\p{Nd}]+", " "))


def passage_key(value: Column) -> Column:
    """text_key with the upper case of one code point where a letter has one (ß is ẞ), as SQL's upper gives it."""
    return text_key(F.translate(text(value), *ONE_UPPER))


def compact(value: Column) -> Column:
    return F.replace(text_key(value), F.lit(" "), F.lit(""))


def ascii_key(value: Column, to_upper: bool = False, separator: str = " ") -> Column:
    """ASCII letters in one case, other ASCII one separator a run, all else as it is."""
    cased = F.translate(text(value), LOWER, UPPER) if to_upper else F.translate(text(value), UPPER, LOWER)
    parted = F.regexp_replace(cased, r"[\x00-\x7F&&[^0-9A-Za-z]]+", separator)
    return F.trim(parted) if separator else parted


def identifier_type(value: Column) -> Column:
    return F.replace(text_key(value), F.lit(" "), F.lit("_"))


def entity_type(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, text_key(value)), text_key(value))


def profile_key(profile: Column, value: Column) -> Column:
    """The value as its normalisation profile wants it; an unknown profile gives null."""
    v = text(value)
    return (
        F.when(profile == "none", v)
        .when(profile.isin("party_name_v1", "address_v1", "text_context_v1", "reference_v1"), F.trim(F.regexp_replace(upper(v), r"\s+", " ")))
        .when(profile.isin("bic_v1", "lei_v1", "iban_v1", "identifier_v1"), F.regexp_replace(upper(v), r"\s+", ""))
        .when(profile == "country_code_v1", upper(F.trim(v)))
        .when(profile.isin("amount_v1", "date_v1", "datetime_v1"), F.trim(v))
    )


def reason_code(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(text(value))), "[^a-z0-9]+", "_"), F.lit("_"))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(text(value), "[^A-Za-z0-9_.-]", "_")


def unreversed(value: Column) -> Column:
    """Text between a direction override and its end, or the text's end, is turned round and the marks go."""
    parts = F.split(value, "(?=[‭‮])")

    def turned(part):
        end = F.instr(part, "‬")
        inner = F.when(end > 0, F.substring(part, F.lit(2), end - 2)).otherwise(F.substring(part, F.lit(2), F.length(part)))
        rest = F.when(end > 0, F.substring(part, end + 1, F.length(part))).otherwise(F.lit(""))
        return F.when(part.rlike("^[‭‮]"), F.concat(F.reverse(inner), rest)).otherwise(part)

    # a mark inside a span that is open belongs to the span: only spans that follow each other are told apart
    return F.when(value.rlike("[‭‮]"), F.array_join(F.transform(parts, turned), "")).otherwise(value)


def replaced(value: Column) -> Column:
    ones = [(k, v) for k, v in FOLD.items() if len(v) == 1]
    out = F.translate(value, "".join(k for k, _ in ones), "".join(v for _, v in ones))
    for k, v in FOLD.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(value.rlike(r"[^\x00-\x7F]"), out).otherwise(value)


def name_fold(value: Column) -> Column:
    """For names: marks, full stops and apostrophes go, other punctuation parts words."""
    kept = F.regexp_replace(replaced(upper(unreversed(text(value)))), r"[\p{Cf}.'’]", "")
    return F.trim(F.regexp_replace(kept, r"[^\p{L}\p{Nd}]+", " "))


#: What parts words: a run of anything but letters and digits.
PARTED = r"[^\p{L}\p{Nd}]+"


def context_fold(value: Column) -> Column:
    """For narratives: everything but letters and digits parts words."""
    return F.trim(F.regexp_replace(replaced(upper(text(value))), PARTED, " "))


def fields(value: Column) -> Column:
    return F.filter(F.split(value, " "), lambda t: t != "")


def name_tokens(folded: Column) -> Column:
    """Words of a folded name: short names spelt out, company forms and titles left out unless nothing would stay."""
    known = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    full = F.transform(fields(folded), lambda t: F.coalesce(F.try_element_at(known, t), t))

    def without(tokens, words):
        left = F.filter(tokens, lambda t: ~t.isin(*words))
        return F.when(F.size(left) > 0, left).otherwise(tokens)

    return without(without(full, SUFFIXES), HONORIFICS)


def terms(value: Column, least: int = 2) -> Column:
    """Distinct words of `least` letters or more, sorted."""
    return key_terms(text_key(value), least)


def key_terms(key: Column, least: int = 2) -> Column:
    return F.array_sort(F.array_distinct(F.filter(fields(key), lambda t: F.length(t) >= least)))


def search_tokens(value: Column) -> Column:
    """Distinct A-Z and digit runs, sorted, without single letters."""
    found = F.regexp_extract_all(upper(text(value)), F.lit("[A-Z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) | t.rlike("[0-9]"))))


def passages(value: Column) -> Column:
    """Paragraphs, white space collapsed, empty ones left out."""
    parts = F.split(F.replace(text(value), F.lit("\r\n"), F.lit("\n")), "\n\n")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def strength_band(score: Column, strong: int = 700, review: int = 400, weak: int = 1) -> Column:
    return (
        F.when(score >= strong, "strong_candidate")
        .when(score >= review, "review_candidate")
        .when(score >= weak, "weak_candidate")
        .otherwise("no_candidate_support")
    )
