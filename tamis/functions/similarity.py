"""Similarities of names in basis points, all in whole numbers: every division cuts off.

Arguments are folded names (strings) or their tokens (arrays of strings).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: consonants by the digit they sound like
SOUNDS = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}


@dataclass(frozen=True)
class NameProfile:
    """Weights and bounds of name matching, in basis points."""

    alignment: int = 3000
    edit: int = 3000
    ordered: int = 1500
    phonetic: int = 1500
    length: int = 1000
    threshold: int = 7800
    floor: int = 6800
    single_token_penalty: int = 700
    weak_alias_penalty: int = 500


PARTY = NameProfile()
INSTITUTION = NameProfile(threshold=8200, floor=7000, single_token_penalty=900)


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a.cast("long"), (F.lit(b) if isinstance(b, int) else b).cast("long"))


def share(part: Column, whole: Column) -> Column:
    """part of whole in basis points; nothing of nothing is all."""
    return F.when(whole == 0, F.lit(10000).cast("long")).otherwise(div(part * 10000, F.when(whole == 0, 1).otherwise(whole)))


def edit_similarity(left: Column, right: Column) -> Column:
    most = F.greatest(F.length(left), F.length(right))
    return share(most - F.levenshtein(left, right), most)


def length_similarity(left: Column, right: Column) -> Column:
    a, b = F.length(left), F.length(right)
    return share(F.least(a, b), F.greatest(a, b))


def best_edit_similarity(left: Column, right: Column, lt: Column, rt: Column) -> Column:
    """The better of the names as they are and with their tokens sorted; single tokens have no order."""
    plain = edit_similarity(left, right)
    ordered = edit_similarity(F.array_join(F.array_sort(lt), " "), F.array_join(F.array_sort(rt), " "))
    return F.when((F.size(lt) < 2) & (F.size(rt) < 2), plain).otherwise(F.greatest(plain, ordered))


def directed(source: Column, target: Column) -> Column:
    best = F.transform(source, lambda s: F.array_max(F.transform(target, lambda t: edit_similarity(s, t))))
    return div(F.aggregate(best, F.lit(0).cast("long"), lambda a, v: a + v), F.greatest(F.size(source), F.lit(1)))


def both_or_none(left: Column, right: Column, value: Column) -> Column:
    return (
        F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(10000).cast("long"))
        .when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0).cast("long"))
        .otherwise(value)
    )


def token_alignment(left: Column, right: Column) -> Column:
    return both_or_none(left, right, div(directed(left, right) + directed(right, left), 2))


def ordered_tokens(left: Column, right: Column) -> Column:
    """Longest common subsequence of tokens that are alike (7000 or more), of the longer list.

    One row of the usual table is carried from token to token.
    """
    most = F.greatest(F.size(left), F.size(right))
    zero = F.array_repeat(F.lit(0), F.size(right) + 1)

    def row(above, token):
        def cell(acc, j):
            alike = edit_similarity(token, F.get(right, j)) >= 7000
            side = F.element_at(acc, -1)
            value = F.when(alike, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), side))
            return F.concat(acc, F.array(value))

        at = F.sequence(F.lit(0), F.size(right) - 1)
        return F.aggregate(at, F.array(F.lit(0)), cell)

    last = F.when((F.size(left) == 0) | (F.size(right) == 0), zero).otherwise(F.aggregate(left, zero, row))
    return share(F.element_at(last, -1), most)


def soundex(token: Column) -> Column:
    """Letter and three digits; vowels, H and W part equal digits; what isn't A-Z goes; empty if nothing stays."""
    letters = F.regexp_replace(F.upper(token), "[^A-Z]", "")
    pairs = [(c, d) for d, cs in SOUNDS.items() for c in cs]
    digits = F.translate(letters, "".join(c for c, _ in pairs) + "AEIOUYHW", "".join(d for _, d in pairs) + "00000000")
    # a digit counts if the one before differs: equal runs shrink to one, then noughts go
    tail = F.substring(F.regexp_replace(F.regexp_replace(digits, r"(.)\1+", "$1"), "0", ""), 1, 4)
    first = F.substring(digits, 1, 1) != "0"
    tail = F.when(first, F.substring(tail, 2, 3)).otherwise(F.substring(tail, 1, 3))
    return F.when(letters == "", F.lit("")).otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), tail), 4, "0"))


def phonetic_similarity(left: Column, right: Column) -> Column:
    """Tokens that sound alike, each matched once, of the longer list."""
    lc, rc = F.transform(left, soundex), F.transform(right, soundex)

    def times(codes, code):
        return F.size(F.filter(codes, lambda c: c == code))

    each = F.transform(F.filter(F.array_distinct(lc), lambda c: c != ""), lambda c: F.least(times(lc, c), times(rc, c)))
    matched = F.aggregate(each, F.lit(0), lambda a, v: a + v)
    return both_or_none(left, right, share(matched, F.greatest(F.size(left), F.size(right))))


def name_features(left: Column, right: Column, lt: Column, rt: Column) -> dict[str, Column]:
    return {
        "edit": best_edit_similarity(left, right, lt, rt),
        "length": length_similarity(left, right),
        "ordered": ordered_tokens(lt, rt),
        "phonetic": phonetic_similarity(lt, rt),
        "alignment": token_alignment(lt, rt),
    }


def name_score(left: Column, right: Column, lt: Column, rt: Column, profile: NameProfile = PARTY, parts: dict[str, Column] | None = None) -> Column:
    """Each feature times its weight, cut off one by one, less the penalty for a single token; 0 at least."""
    parts = parts or name_features(left, right, lt, rt)
    total = F.lit(0).cast("long")
    for name, value in parts.items():
        total = total + div(value * getattr(profile, name), 10000)
    alone = (left != right) & ((F.size(lt) == 1) | (F.size(rt) == 1))
    return F.greatest(total - F.when(alone, profile.single_token_penalty).otherwise(0), F.lit(0).cast("long"))


def score_bound(left: Column, right: Column, lt: Column, rt: Column, profile: NameProfile = PARTY) -> Column:
    """No name score is above this, which needs lengths and counts alone.

    An edit similarity can't exceed the ratio of lengths, nor ordered and
    phonetic ones that of the numbers of tokens; alignment is taken as full.
    """
    sl, sr = (F.length(F.array_join(F.array_sort(t), " ")) for t in (lt, rt))

    def ratio(a, b):
        return share(F.least(a, b), F.greatest(a, b))

    edit = F.greatest(ratio(F.length(left), F.length(right)), ratio(sl, sr))
    tokens = ratio(F.size(lt), F.size(rt))
    points = profile.alignment * 10000 + edit * profile.edit + tokens * (profile.ordered + profile.phonetic)
    return div(points + ratio(F.length(left), F.length(right)) * profile.length, 10000)


def pair_bound(edit: Column, length: Column, sizes: tuple[Column, Column], lacking: tuple[Column, Column], profile: NameProfile = PARTY) -> Column:
    """No name score is above this, which needs edit and length similarities and how many tokens of either side (`lacking`, of `sizes`) have none alike on the other.

    Those can't be in an ordered run, and the best of each for the alignment
    is under 7000; sound is only bounded by the numbers of tokens.
    """
    (n, m), (a, b) = sizes, lacking
    most = F.greatest(n, m)
    ordered = share(F.least(n - a, m - b), most)
    sides = [10000 - share(lack * 3, size * 10) for lack, size in ((a, n), (b, m))]
    points = {"edit": edit, "length": length, "ordered": ordered, "phonetic": share(F.least(n, m), most), "alignment": F.call_function("div", sides[0] + sides[1], F.lit(2).cast("long"))}
    total = sum(v * getattr(profile, k) for k, v in points.items())
    return div(total, 10000)
