import pytest
from pyspark.sql import functions as F

from tamis.operators import catalog as C
from tamis.operators import evidence as E
from tamis.operators import governance as G
from tamis.operators import narrative as N
from tamis.sources import exchange as X
from tamis.sources import families as T
from tamis.sources import lists as S
from tamis.sources import messages as M
from tamis.streaming import flows

ENTRY = "<sdnEntry><uid>{0}</uid><lastName> Ab </lastName><sdnType>Entity</sdnType><akaList><aka><uid>2</uid><category>Weak</category><lastName>z</lastName></aka></akaList></sdnEntry>"


def test_list_files_are_counted_and_safe(spark, tmp_path):
    def file(name, count, body, head=""):
        (tmp_path / name).write_text(f'<?xml version="1.0"?>{head}<sdnList xmlns="x"><publishInformation><Record_Count>{count}</Record_Count></publishInformation>{body}</sdnList>')
        return str(tmp_path / name)

    good = S.records(S.read_entries(spark, file("a.xml", 2, ENTRY.format(1) + ENTRY.format(9)))).collect()
    assert [(r.record_id, r.primary_name, r.entity_type, r.aliases[0].strength) for r in sorted(good)] == [("ofac:sdn:1", "Ab", "organization", "weak"), ("ofac:sdn:9", "Ab", "organization", "weak")]
    assert all(r.identifiers is None and r.dates_of_birth == [] for r in good)
    with pytest.raises(ValueError, match="miscounted"):
        S.read_entries(spark, file("b.xml", 3, ENTRY.format(1)))
    with pytest.raises(ValueError, match="unsafe"):
        S.read_entries(spark, file("c.xml", 1, ENTRY.format(1), "<!DOCTYPE x>"))


def test_entity_lines(spark, tmp_path):
    lines = ['{"id":"a","schema":"Person","properties":{"name":["B","A"]}}', '{"id":"b","schema":"Note","properties":{}}']
    (tmp_path / "e.json").write_text("\n".join(lines))
    got = S.targets(S.read_entities(spark, str(tmp_path / "e.json"))).collect()
    assert [(r.entity_id, r.primary_name, [a.name for a in r.aliases]) for r in got] == [("a", "A", ["B"])]
    (tmp_path / "f.json").write_text("\n".join([*lines, lines[0]]))
    with pytest.raises(ValueError, match="repeated"):
        S.read_entities(spark, str(tmp_path / "f.json"))
    (tmp_path / "g.json").write_text('{"id":"a","schema":3,"properties":[1]}')
    with pytest.raises(Exception):  # noqa: B017  the reader's own error
        S.read_entities(spark, str(tmp_path / "g.json")).collect()


def test_index_resources(spark):
    doc = '{"datasets":[{"name":"d","resources":[{"name":"r","url":"u","checksum":"c","size":5},{"name":"s"}]},{"name":"e","resources":[{"name":"r"}]}]}'
    assert [tuple(r) for r in S.resources(spark.createDataFrame([(doc,)], "value string"), "d", "r").collect()] == [("u", "c", 5)]


DOC = '<Document xmlns="urn:iso:std:iso:20022:tech:xsd:pacs.008.001.08"><FIToFICstmrCdtTrf><GrpHdr><MsgId>{0}</MsgId></GrpHdr><CdtTrfTxInf><PmtId><InstrId>i</InstrId></PmtId><Dbtr><Nm> A  b </Nm><Id><OrgId><LEI>x</LEI></OrgId></Id></Dbtr></CdtTrfTxInf></FIToFICstmrCdtTrf></Document>'


def test_messages(spark):
    rows = [(1, DOC.format("m")), (2, None), (3, DOC.format(" ")), (4, "<a/>"), (5, DOC.format("m").replace("</Dbtr>", "")), (6, "<!-- x -->")]
    found, rejected = M.elements(spark.createDataFrame(rows, "message int, payload string"))
    assert {r.path.rsplit("/", 1)[-1]: (r.tx, r.tx_id, r.value) for r in found.collect()} == {"MsgId": (None, "", "m"), "InstrId": (0, "i", "i"), "Nm": (0, "i", "A  b"), "LEI": (0, "i", "x")}
    assert {r.message: r.fault for r in rejected.collect()} == {2: "empty", 3: "malformed", 4: "unknown_root", 5: "malformed", 6: "unknown_root"}
    out = {r.role: (r.normalized, r.action) for r in M.resolved(found, M.plan(spark)).where("eligible or action like 'skip%'").collect() if r.tx is not None}
    assert out == {"Dbtr": ("X", "skip_invalid")} or out == {"Dbtr": ("A B", "candidate_lookup")}


def test_variants_and_paths():
    doc = '<Document xmlns="urn:iso:std:iso:20022:tech:xsd:pacs.009.001.08"><FICdtTrf><CdtTrfTxInf>{0}<Id>7</Id></CdtTrfTxInf><CdtTrfTxInf><Nm> a \n b</Nm><Nm>c</Nm></CdtTrfTxInf></FICdtTrf></Document>'
    profile, found = T.tree_leaves(doc.format("<UndrlygCstmrCdtTrf><Othr><Id>9</Id></Othr></UndrlygCstmrCdtTrf>"))
    assert profile == "pacs.009.001.08.cov"
    assert [(tx, path, v) for tx, path, _, v in found] == [
        (1, "/Document/FICdtTrf/CdtTrfTxInf[1]/UndrlygCstmrCdtTrf/Othr/Id", "9"),
        (1, "/Document/FICdtTrf/CdtTrfTxInf[1]/Id", "7"),
        (2, "/Document/FICdtTrf/CdtTrfTxInf[2]/Nm[1]", "a b"),
        (2, "/Document/FICdtTrf/CdtTrfTxInf[2]/Nm[2]", "c"),
    ]
    assert T.tree_leaves(doc.format(""))[0] == "pacs.009.001.08"
    for bad, why in (("<!DOCTYPE a><a/>", "unsafe_declaration"), ("<a>", "malformed"), ("", "malformed"), ("<a/>", "unsupported_message"), ("<a>" * 200 + "</a>" * 200, "too_deep_or_large")):
        with pytest.raises(ValueError, match=why):
            T.tree_leaves(bad)


def test_delta_preconditions(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    target = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    ops = C.delta(C.differences(base, target, "id"), "id")
    assert {tuple(r) for r in C.applied(base, ops, "id").collect()} == {(2, "c"), (3, "d")}
    with pytest.raises(Exception, match="precondition"):
        C.applied(target, ops, "id").collect()
    gap = C.promotion(C.metrics(C.differences(base, target, "id")), sequence=3, expected=2).first()
    assert (gap.outcome, gap.reasons, gap.change_bp) == ("reject", ["delta_sequence_gap"], 15000)


def test_golden_evidence_scores(spark):
    """Sums of points of a candidate with an exact identifier, an exact name, a weak one, and dates that support or contradict."""
    cols = "id string, s_names array<string>, c_names array<string>, s_identifiers array<struct<type:string,value:string>>, c_identifiers array<struct<type:string,value:string>>, s_dates array<string>, c_dates array<string>, s_countries array<string>, c_countries array<string>, s_type string, c_type string"
    rows = [
        ("lei", ["Acme"], ["Acme Imports"], [("LEI", "a 1")], [("lei", "A1")], [], [], ["US"], ["GB"], "organization", "company"),
        ("name", ["Acme"], ["ACME"], [], [], [], [], ["US"], ["us"], "entity", "company"),
        ("weak", ["Acme"], ["Acme Trading"], [], [], [], [], ["US"], ["GB"], "company", "vessel"),
        ("dob", ["Li Wei"], ["WEI LI"], [], [], ["1980-05-20"], ["1980-05-20"], ["CN"], ["CN"], "person", "individual"),
        ("conflict", ["Li Wei"], ["Li Wei"], [], [], ["1980-05-20"], ["1981"], ["CN"], ["CN"], "person", "individual"),
        ("none", [], ["x"], [], [], ["19"], ["1980"], [""], ["CN"], "", "person"),
    ]
    got = {r.id: (r.score, r.band) for r in E.evidence(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"lei": (780, "strong_candidate"), "name": (500, "review_candidate"), "weak": (90, "weak_candidate"), "dob": (560, "review_candidate"), "conflict": (320, "weak_candidate"), "none": (0, "no_candidate_support")}


def test_phrase_windows(spark):
    rows = [("a x b y c", "b c", 1), ("b q q q q c", "b c", 0), ("b b c", "b c", 1), ("b q b q q q c", "b c d", 0), ("", "b", 0), ("b q c d", "b c d", 1)]
    df = spark.createDataFrame(rows, "q string, p string, hit int").withColumns({"q": F.filter(F.split("q", " "), lambda t: t != ""), "p": F.split("p", " ")})
    got = df.select("hit", N.contiguous(F.col("q"), F.col("p")).alias("at"), N.ordered(F.col("q"), F.col("p")).alias("o")).collect()
    assert [r.o is not None for r in got] == [bool(r.hit) for r in got] and [r.at for r in got] == [-1, -1, 1, -1, -1, -1]
    assert [tuple(r.o) for r in got if r.o] == [(2, 5), (0, 3), (0, 4)]


def test_provider_cap_fails_instead_of_cutting(spark):
    df = spark.createDataFrame([(1, i) for i in range(3)], "request int, c int")
    assert G.capped(df, "request", 3).count() == 3
    with pytest.raises(Exception, match="too many candidates"):
        G.capped(df, "request", 2).collect()


def test_appends_twice_add_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    for rows in (df, df.union(spark.createDataFrame([(3, "c")], df.schema)), df):
        flows.appended(rows, str(tmp_path / "t"), "k")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_vendor_json(spark):
    ok = '{"tenant_id":"t","alert_id":"a","system":"s","list_name":"OFAC","occurred_at":"2024-01-01T00:00:00Z","correlation_id":"c","idempotency_key":"i","score":7}'
    rows = [ok, ok + ok, f"{ok},{ok}", "[1]", "", None, ok.replace('"a"', '" "'), ok.replace("7", "7.5"), ok.replace("2024-01-01T", "2024-13-01T"), ok.replace('"score":7', '"score":7,"score":8')]
    got = [r.rejected for r in X.converted(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")).orderBy("i").collect()]
    assert got == [None, "invalid_json", "invalid_json", "invalid_json", "invalid_json", "invalid_json", "missing_required_field:alert_id", "invalid_score", "invalid_occurred_at", "invalid_json"]
