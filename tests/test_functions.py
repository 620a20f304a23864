import random
import unicodedata

from pyspark.sql import functions as F

from tamis.functions import similarity as S
from tamis.functions import text as T


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
    return df.select(fn(*[F.col(c) for c in df.columns]).alias("v")).first().v


def test_folds_and_keys(spark):
    rows = {
        "O'Brien": ("OBRIEN", "O BRIEN"),
        "A.C.M.E.": ("ACME", "A C M E"),
        "Smith-Jones": ("SMITH JONES", "SMITH JONES"),
        "Łódź Щука Œuvre ß": ("LODŹ SHCHUKA OEUVRE SS", "LODŹ SHCHUKA OEUVRE SS"),
        "ab​cd": ("ABCD", "AB CD"),
        "ACME ‮STROPMI‬ LLC": ("ACME IMPORTS LLC", "ACME STROPMI LLC"),
        "x ‭cba": ("X ABC", "X CBA"),
    }
    df = spark.createDataFrame([(k,) for k in rows], "v string")
    got = {r.v: (r.a, r.b) for r in df.select("v", T.name_fold(F.col("v")).alias("a"), T.context_fold(F.col("v")).alias("b")).collect()}
    assert got == rows
    assert one(spark, T.text_key, "Straße ﬁn 5") == "STRAßE ﬁN 5" and one(spark, T.text_key, None) == ""
    assert one(spark, T.ascii_key, " Ж-a__B ") == "Ж a b" and one(spark, lambda c: T.ascii_key(c, True, ""), "ab-12 é") == "AB12é"
    assert one(spark, T.reason_code, " Name--Exact! ") == "name_exact" and one(spark, T.entity_type, "natural-person") == "PERSON"
    assert one(spark, T.search_tokens, "a bank 7 é Bank x9") == ["7", "BANK", "X9"]
    assert one(spark, T.passages, "a  b\r\n\r\n \n\nc\nd") == ["a b", "c d"]
    assert one(spark, lambda c: T.name_tokens(T.name_fold(c)), "Dr. Bill El Masri Ltd") == ["WILLIAM", "AL", "MASRI"]
    assert one(spark, lambda c: T.name_tokens(T.name_fold(c)), "LLC") == ["LLC"]


def plain_soundex(v):
    digit = {c: d for d, cs in S.SOUNDS.items() for c in cs}
    v = "".join(c for c in v.upper() if "A" <= c <= "Z")
    if not v:
        return ""
    out, before = v[0], digit.get(v[0], "0")
    for c in v[1:]:
        d = digit.get(c, "0")
        if len(out) < 4 and d not in ("0", before):
            out += d
        before = d
    return out.ljust(4, "0")


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    m = max(len(a), len(b))
    return (m - row[-1]) * 10000 // m if m else 10000


def plain_score(a, b, x, y, p):
    def side(s, t):
        return sum(max(plain_edit(u, v) for v in t) for u in s) // len(s)

    edit = plain_edit(a, b)
    if len(x) >= 2 or len(y) >= 2:
        edit = max(edit, plain_edit(" ".join(sorted(x)), " ".join(sorted(y))))
    m, most = max(len(a), len(b)), max(len(x), len(y))
    length = min(len(a), len(b)) * 10000 // m if m else 10000
    if not x or not y:
        align = phone = 10000 if not x and not y else 0
        order = 10000 if not most else 0
    else:
        align = (side(x, y) + side(y, x)) // 2
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if plain_edit(u, v) >= 7000 else max(t[i][j + 1], t[i + 1][j])
        order = t[-1][-1] * 10000 // most
        left = [plain_soundex(v) for v in y]
        hits = 0
        for c in map(plain_soundex, x):
            if c and c in left:
                left.remove(c)
                hits += 1
        phone = hits * 10000 // most
    total = sum(v * w // 10000 for v, w in ((edit, p.edit), (length, p.length), (order, p.ordered), (phone, p.phonetic), (align, p.alignment)))
    return max(0, total - (p.single_token_penalty if a != b and 1 in (len(x), len(y)) else 0))


def test_name_score_against_plain_formulas(spark):
    rng = random.Random(4)
    words = "ACME ACMEE IMPORTS IMPROTS BANK BILL WILLIAM ASHCRAFT TYMCZAK PFISTER LLC 7 ÉTÉ AL EL MASRI".split()
    names = ["", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(24))]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    df = df.withColumn("x", T.name_tokens(F.col("a"))).withColumn("y", T.name_tokens(F.col("b")))
    cols = [F.col(c) for c in "abxy"]
    for p in (S.PARTY, S.INSTITUTION):
        for r in df.select("*", S.name_score(*cols, p).alias("s"), S.score_bound(*cols, p).alias("most")).collect():
            assert r.s == plain_score(r.a, r.b, r.x, r.y, p), r
            assert r.s <= r.most


def test_soundex(spark):
    words = ["ASHCRAFT", "TYMCZAK", "PFISTER", "HONEYMAN", "LLOYD", "JACKSON", "A", "É", "7", "BWB", "BB", "SCH", "AEB", "MCDONNELL"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", S.soundex(F.col("w")).alias("s")).collect()} == {w: plain_soundex(w) for w in words}
    assert unicodedata.normalize("NFC", "É") == "É"


def test_buckets_of_tokens():
    from tamis.operators.retrieval import Queries, Vectors, bucket

    assert bucket("BANK") == 23
    block = Queries([{"query_id": 1, "qt": ["A1", "BANK"], "codes": ["X", "X"]}, {"query_id": 2, "qt": [], "codes": []}])
    found = block.scores([["BANK"], []], ["HAS X", ""], Vectors())
    assert found["lexical"].tolist() == [[5000, 0], [0, 0]] and found["metadata"].tolist() == [[3000, 0], [0, 0]]
    assert found["vector"].tolist() == [[2 * 10000 // 3, 0], [0, 0]]
