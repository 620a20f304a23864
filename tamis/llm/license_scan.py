"""Licence recognition by sentence identifiers and ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentence, or the part of it that names the licence, and its identifier (lower case, letters and digits, one space).
SENTENCES = {
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied": "mit_asis",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl_grant",
    "boost software license version 1 0": "bsl_title",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advert",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "may be used to endorse or promote products derived from this software without prior written permission": "bsd_endorse",
    "and contributors as is and any express or implied warranties": "bsd_asis",
    "contributors as is and any express or implied warranties": "bsd_asis",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties": "zerobsd_grant",
    "the software is provided as is and the author disclaims all warranties": "isc_asis",
    "apache license version 2 0 january 2004": "apache2_title",
    "terms and conditions for use reproduction and distribution": "apache_terms",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21_title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    "gnu affero general public license version 3 19 november 2007": "agpl3_title",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl_terms",
    "under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl_terms",
    "under the terms of the gnu affero general public license as published by the free software foundation": "agpl_terms",
    "either version 2 of the license or": "v2",
    "either version 2 1 of the license or": "v21",
    "either version 3 of the license or": "v3",
    "version 2 of the license": "v2",
    "version 2 1 of the license": "v21",
    "version 3 of the license": "v3",
    "mozilla public license version 2 0": "mpl2_title",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_header",
    "eclipse public license v 2 0": "epl2_title",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
    "anyone is free to copy modify publish use compile sell or distribute this software": "unlicense_use",
    "this software is provided as is without any express or implied warranty": "zlib_asis",
    "permission is granted to anyone to use this software for any purpose including commercial applications": "zlib_grant",
    "this notice may not be removed or altered from any source distribution": "zlib_notice",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document": "wtfpl_copy",
    "you just do what the fuck you want to": "wtfpl_terms",
    "cc0 1 0 universal": "cc0_title",
}
# Licence, identifier of a reference to it, and the names that a reference has.
NAMES = {
    "MIT": ("mit_ref", ["mit license", "expat license", "x11 mit license"]),
    "Apache-2.0": ("apache2_ref", [f"apache {x}" for x in ("license version 2 0", "license 2 0", "license v2 0", "license v 2 0", "2 0 license", "2 0", "software license version 2 0")]),
    "BSD-2-Clause": ("bsd2_ref", ["bsd 2 clause", "2 clause bsd license", "two clause bsd license", "simplified bsd license"]),
    "BSD-3-Clause": ("bsd3_ref", ["bsd 3 clause", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license"]),
    "ISC": ("isc_ref", ["isc license"]),
    "MPL-2.0": ("mpl2_ref", [f"{x} {v}" for x in ("mozilla public license", "mpl") for v in ("version 2 0", "2 0", "v2 0", "v 2 0")]),
    "EPL-2.0": ("epl2_ref", [f"eclipse public license {v}" for v in ("version 2 0", "2 0", "v2 0", "v 2 0")]),
    "BSL-1.0": ("bsl_ref", ["boost software license version 1 0", "boost software license"]),
    "Zlib": ("zlib_ref", ["zlib license"]),
    "Unlicense": ("unlicense_ref", ["unlicense"]),
    "CC0-1.0": ("cc0_ref", ["cc0 1 0", "cc0", "creative commons zero"]),
}
for _abbr, _long, _versions in (("gpl", "gnu general public license", "23"), ("lgpl", "gnu lesser general public license", ("2 1", "3")), ("agpl", "gnu affero general public license", "3")):
    for _v in _versions:
        _all = [f"{x} {w}" for x in (_long, f"gnu {_abbr}", _abbr) for y in {_v, _v if " " in _v else f"{_v} 0"} for w in (f"version {y}", f"v{y}", f"v {y}", y)]
        NAMES[f"{_abbr.upper()}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}"] = (f"{_abbr}{_v.replace(' ', '')}_ref", [*_all, f"{_abbr}v{_v}"])
for _kind, _long in {
    "by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives",
    "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives",
}.items():
    for _v in ("2 0", "2 5", "3 0", "4 0"):
        _id = f"cc{_kind.replace(' ', '')}{_v[0] if _v[-1] == '0' else _v.replace(' ', '')}_ref"
        _full = [f"creative commons {x} {_v}" for x in (_long, f"{_long} license", _kind)]
        NAMES[f"CC-{_kind.upper().replace(' ', '-')}-{_v.replace(' ', '.')}"] = (_id, [f"cc {_kind} {_v}", *_full, *[f"{x} international" for x in _full]])
# Licence and the sequences of identifiers, any of which shows it; what is no known sentence may stand between.
RULES = {name: [[ref]] for name, (ref, _) in NAMES.items()} | {"Proprietary": [["reserved"]], "0BSD": [["zerobsd_grant"]], "BSD-4-Clause": [], "WTFPL": [["wtfpl_copy", "wtfpl_terms"]]}
for _name, *_more in (
    ("MIT", ["mit_grant", "mit_notice", "mit_asis"]),
    ("BSL-1.0", ["bsl_title", "bsl_grant"], ["bsl_grant"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_asis"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis"]),
    ("BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse", "bsd_asis"]),
    ("ISC", ["isc_grant", "isc_asis"]),
    ("Apache-2.0", ["apache2_title", "apache_terms"]),
    ("GPL-2.0", ["gpl2_title"], ["gpl_terms", "v2"]),
    ("GPL-3.0", ["gpl3_title"], ["gpl_terms", "v3"]),
    ("LGPL-2.1", ["lgpl21_title"], ["lgpl_terms", "v21"]),
    ("LGPL-3.0", ["lgpl3_title"], ["lgpl_terms", "v3"]),
    ("AGPL-3.0", ["agpl3_title"], ["agpl_terms", "v3"]),
    ("MPL-2.0", ["mpl2_title"], ["mpl2_header"]),
    ("EPL-2.0", ["epl2_title"]),
    ("Unlicense", ["unlicense_grant", "unlicense_use"]),
    ("Zlib", ["zlib_asis", "zlib_grant", "zlib_notice"]),
    ("CC0-1.0", ["cc0_title"]),
):
    RULES[_name] += _more
#: What stands before a licence's name in a reference.
REFERENCE = r"(?:licensed|released|distributed|redistributed|available|published|provided|covered) (?:under|by) (?:the |a |an )?(?:(?:terms|conditions)(?: and conditions)? of )?(?:the |a |an )?"
#: Each sentence and each reference has one of these.
MARKS = ("licens", "licenc", "permission", "permitted", "redistribution", "rights", "public domain", "warrant", "released", "distributed", "available", "published", "provided", "covered", "universal", "endorse", "notice", "copy", "terms", "advertising", "want to")
SPDX = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]+)"


def pattern(phrases: list[str]) -> str:
    """Any of the phrases, the longest that stands there; common first words are tested once."""
    by: dict[str, list[str]] = {}
    for p in phrases:
        first, _, rest = p.partition(" ")
        by.setdefault(first, []).append(rest)
    parts = []
    for first, rests in sorted(by.items()):
        more = [r for r in rests if r]
        inner = f" (?:{pattern(more)})" if more else ""
        parts.append(first + (f"(?:{inner})?" if inner and "" in rests else inner))
    return "|".join(parts)


REFS = {name: ref for ref, names in NAMES.values() for name in names}


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences and references, in the order of the text."""
    low = F.lower(text)
    clean = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", " "), r"\blicence", "license")
    known = rf"\b(?:{REFERENCE}(?:{pattern(list(REFS))})|{pattern(list(SENTENCES))})\b"
    found = F.regexp_extract_all(clean, F.lit(known), F.lit(0))
    ident = F.create_map(*[F.lit(x) for kv in (SENTENCES | REFS).items() for x in kv])
    found = F.transform(found, lambda s: F.coalesce(F.try_element_at(ident, s), F.try_element_at(ident, F.regexp_replace(s, f"^{REFERENCE}", ""))))
    marked = low.contains(MARKS[0])
    for mark in MARKS[1:]:
        marked = marked | low.contains(mark)
    return F.when(marked, found).otherwise(F.array().cast("array<string>"))


def spdx_ids(text: Column) -> Column:
    """spdx:name of every licence that SPDX lines name, in lower case; `-only`, `-or-later` and `+` are left out."""
    lines = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    names = F.flatten(F.transform(lines, lambda s: F.split(F.lower(s), r"[() \t]+")))
    names = F.transform(names, lambda s: F.regexp_replace(s, r"(-only|-or-later|\+)$", ""))
    named = F.transform(F.filter(names, lambda s: s.isin(*[n.lower() for n in RULES])), lambda s: F.concat(F.lit("spdx:"), s))
    return F.when(F.lower(text).contains("spdx-license-identifier"), named).otherwise(F.array().cast("array<string>"))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every document: id, sentence_ids and licences (comma-joined strings).

    Sentences are known wherever they stand, across line ends too; SPDX lines'
    names follow them.  A rule holds when one of its sequences occurs among
    the identifiers without another known sentence between.  Null and empty
    texts have none; repeated rows come out again; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.concat_ws(",", sentence_ids(text), spdx_ids(text)).alias("sentence_ids"))
    listed = F.concat(F.lit(","), "sentence_ids", F.lit(","))

    def shown(name: str, sequences: list[list[str]]) -> Column:
        any_of = listed.contains(f",spdx:{name.lower()},")
        for ids in sequences:
            any_of = any_of | listed.contains("".join(f",{i}" for i in ids) + ",")
        return F.when(any_of, F.lit(name))

    held = F.when(F.col("sentence_ids") != "", F.concat_ws(",", *[shown(*rule) for rule in RULES.items()])).otherwise("")
    return out.select(id_col, "sentence_ids", held.alias("licences"))
