"""Workbooks and decks made here by hand, read back as rows; sinks; streams; operators on small cases."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import formulas, numbers, periods, privacy, similarity
from tallyloom.operators import align, crosscheck, cycles, diff, graph, objects, regions, triage
from tallyloom.sources import ooxml, sinks
from tallyloom.streaming import arrivals

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


@pytest.fixture(scope="module")
def workbook(tmp_path_factory):
    path = tmp_path_factory.mktemp("x") / "book.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Data" sheetId="1" r:id="a"/><sheet name="Sum" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {REL}><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Period</t></si><si><r><t>Jan</t></r><r><t>-26</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"""<worksheet {NS}><sheetData>
            <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row>
            <row r="3"><c r="A3" s="1"><v>0.5</v></c><c r="B3"><f t="shared" si="0" ref="B3:B4">A3*$A$1+Sum!A1</f><v>1</v></c><c r="C3" t="b"><v>1</v></c></row>
            <row r="4"><c r="B4"><f t="shared" si="0"/><v>2</v></c><c r="C4" t="e"><v>#DIV/0!</v></c></row></sheetData></worksheet>""")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1"><f>SUM(Data!A1:B3)</f></c></row></sheetData></worksheet>')
    return str(path)


def test_workbook(spark, workbook):
    ooxml.register(spark)
    df = spark.read.format("workbook").load(workbook)
    got = {(r.sheet, r.row, r.col): (r.vtype, r.num, r.txt, r.formula, r.number_format) for r in df.collect()}
    assert got == {
        ("Data", 1, 1): ("text", None, "Period", None, "General"), ("Data", 1, 2): ("text", None, "Jan-26", None, "General"), ("Data", 1, 3): ("text", None, "x", None, "General"),
        ("Data", 3, 1): ("number", 0.5, "0.5", None, "0.0%"), ("Data", 3, 2): ("number", 1.0, "1", "=A3*$A$1+Sum!A1", "General"), ("Data", 3, 3): ("bool", None, "1", None, "General"),
        ("Data", 4, 2): ("number", 2.0, "2", "=A4*$A$1+Sum!A2", "General"), ("Data", 4, 3): ("error", None, "#DIV/0!", None, "General"), ("Sum", 1, 1): (None, None, None, "=SUM(Data!A1:B3)", "General"),
    }
    p = {(r.sheet, r.row, r.ref_sheet, r.min_row, r.max_row, r.min_col, r.max_col) for r in formulas.precedents(df, "formula", "sheet", "row", "col").collect()}
    assert ("Sum", 1, "Data", 1, 3, 1, 2) in p and ("Data", 4, "Sum", 2, 2, 1, 1) in p
    kinds = {(r.sheet, r.kind): r.cells for r in sinks.structure_fingerprint(df).collect()}
    assert kinds["Data", "formula"] == 2 and kinds["Data", "text"] == 3


def test_workbook_parts(spark, tmp_path):
    path = tmp_path / "parts.xlsx"
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = lambda *x: f'<Relationships {REL}>' + "".join(f'<Relationship Id="{i}" Type="{kind}/{t}" Target="{to}"/>' for i, t, to in x) + "</Relationships>"
    c = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Data" sheetId="1" r:id="a"/><sheet name="Old" sheetId="2" state="hidden" r:id="b"/></sheets><definedNames><definedName name="Total">Data!$A$1:$A$9</definedName><definedName name="Own" localSheetId="1">Old!$B$2</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels(("a", "worksheet", "worksheets/sheet1.xml"), ("b", "worksheet", "worksheets/sheet2.xml")))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><dimension ref="A1:B2"/><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData><conditionalFormatting sqref="A1:A9"><cfRule type="cellIs" operator="greaterThan" priority="1"><formula>5</formula></cfRule></conditionalFormatting><dataValidations><dataValidation type="list" sqref="B1:B9"><formula1>"a,b"</formula1></dataValidation></dataValidations></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", rels(("t", "table", "../tables/table1.xml"), ("c", "comments", "../comments1.xml"), ("d", "drawing", "../drawings/drawing1.xml")))
        z.writestr("xl/tables/table1.xml", f'<table {NS} displayName="Sales" ref="A1:B9"><tableColumns><tableColumn name="x"/><tableColumn name="y"/></tableColumns></table>')
        z.writestr("xl/comments1.xml", f'<comments {NS}><commentList><comment ref="A1"><text><t>check</t></text></comment></commentList></comments>')
        z.writestr("xl/drawings/drawing1.xml", f'<xdr:wsDr {c}><xdr:twoCellAnchor><xdr:from><xdr:col>1</xdr:col><xdr:row>2</xdr:row></xdr:from><xdr:to><xdr:col>5</xdr:col><xdr:row>9</xdr:row></xdr:to><xdr:graphicFrame><c:chart r:id="k"/></xdr:graphicFrame></xdr:twoCellAnchor></xdr:wsDr>')
        z.writestr("xl/drawings/_rels/drawing1.xml.rels", rels(("k", "chart", "../charts/chart1.xml")))
        z.writestr("xl/charts/chart1.xml", f'<c:chartSpace {c}><c:chart><c:title><a:t>Growth</a:t></c:title><c:plotArea><c:barChart><c:ser><c:order val="0"/><c:tx><c:strRef><c:f>Data!$B$1</c:f></c:strRef></c:tx><c:cat><c:strRef><c:f>Data!$A$2:$A$9</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>Data!$B$2:$B$9</c:f></c:numRef></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>')
        z.writestr("xl/vbaProject.bin", b"macro")
    ooxml.register(spark)
    got = {(r.kind, r.sheet, r.name): r.fields for r in spark.read.format("workbook_parts").load(str(path)).collect()}
    assert got["sheet", "Old", "Old"] == {"state": "hidden"} and got["name", None, "Total"] == {"ref": "Data!$A$1:$A$9"} and got["name", "Old", "Own"] == {"ref": "Old!$B$2"}
    assert got["table", "Data", "Sales"]["columns"] == "x\ny" and got["comment", "Data", "A1"] == {"text": "check"} and got["dimension", "Data", ""] == {"ref": "A1:B2"}
    assert got["validation", "Data", "1"] == {"type": "list", "sqref": "B1:B9", "formula1": '"a,b"'}
    assert got["conditional_format", "Data", "1"] == {"type": "cellIs", "operator": "greaterThan", "priority": "1", "sqref": "A1:A9", "formula1": "5"}
    assert got["chart", "Data", "chart1.xml"] == {"title": "Growth", "index": "0", "from_col": "1", "from_row": "2", "to_col": "5", "to_row": "9"}
    assert got["chart_series", "Data", "chart1.xml/0"] == {"plot": "bar", "order": "0", "name_ref": "Data!$B$1", "categories_ref": "Data!$A$2:$A$9", "values_ref": "Data!$B$2:$B$9", "chart": "chart1.xml"}
    assert got["risk", None, "xl/vbaProject.bin"]["risk"] == "macro"


def test_unsafe_package(tmp_path):
    path = tmp_path / "bad.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("../x", "")
    with pytest.raises(ValueError, match="safe"):
        ooxml.opened(str(path))


def test_deck(spark, tmp_path):
    path = tmp_path / "deck.pptx"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    text = lambda name, ph, t: f'<p:sp><p:nvSpPr><p:cNvPr name="{name}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t)}</p:txBody></p:sp>'
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {a}><p:sldIdLst><p:sldId id="1" r:id="s"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships {REL}><Relationship Id="s" Target="slides/slide1.xml"/></Relationships>')
        z.writestr("ppt/slides/slide1.xml", f'<p:sld {a}><p:cSld>{text("T", "<p:ph type=&quot;title&quot;/>".replace("&quot;", chr(34)), ["Results"])}{text("B", "", ["Revenue $1.2M", "up 12%"])}<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr name="Table"/></p:nvGraphicFramePr><a:tbl><a:tr>{cell("a")}{cell("b")}</a:tr></a:tbl></p:graphicFrame></p:cSld></p:sld>')
    ooxml.register(spark)
    df = spark.read.format("deck").load(str(path))
    assert {(r.slide, r.kind, r.row, r.col, r.text) for r in df.collect()} == {(1, "title", None, None, "Results"), (1, "text", None, None, "Revenue $1.2M\nup 12%"), (1, "table", 0, 0, "a"), (1, "table", 0, 1, "b")}
    f = df.where("kind = 'text'").select(F.explode(numbers.figures(F.col("text"))).alias("f")).select("f.*").collect()
    assert [(x.raw, x.value, x.percent, x.currency) for x in f] == [("$1.2M", 1_200_000.0, False, "$"), ("12%", 0.12, True, "")]


def test_periods(spark):
    labels = ["Jan-26", "September 2026", "2026-01", "2026-01-31", "W05", "CW 7'26", "2026-W03", "Q1", "q3 FY26", "Marchh26", "Q5", "W1234", "", None, " Feb_26 ", "2026-1"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string").select("i", periods.parse_period(F.col("x")).alias("p"))
    got = [r.p and (r.p.kind, r.p.k1, r.p.k2, r.p.k3) for r in d.orderBy("i").collect()]
    want = [("month", 2026, 1, 0), ("month", 2026, 9, 0), ("month", 2026, 1, 0), ("date", 2026, 1, 31), ("week", 0, 0, 5), ("week", 2026, 0, 7), ("week", 2026, 0, 3), ("quarter", 0, 1, 0), ("quarter", 2026, 3, 0), ("month", 2026, 3, 0), None, ("week", 2034, 0, 12), None, None, ("month", 2026, 2, 0), None]
    assert got == want
    w = spark.createDataFrame([("W02", "W51", True), ("W20", "W51", False), ("W06", "W05", True), ("W05", "W05", False), ("Q1", "W05", False)], "a string, b string, after boolean")
    assert all(r.got == r.after for r in w.select("after", periods.is_after(periods.parse_period(F.col("a")), periods.parse_period(F.col("b"))).alias("got")).collect())


def test_formula_forms():
    assert formulas.relative("=A1+$B$2*C$3", 4, 4) == "=R[-3]C[-3]+R2C2*R3C[-1]"
    assert formulas.relative("=sum('My Sheet'!A1:b2)", 1, 1) == "=SUM('MY SHEET'!RC:R[1]C[1])"
    assert formulas.relative('=IF(A1="a1",LOG10(B1),#N/A)', 1, 1) == '=IF(RC="a1",LOG10(RC[1]),#N/A)'
    assert formulas.pattern("=A1+2*SUM(B1:B9)") == "<ref>+<n>*SUM(<range>)"


def test_numbers(spark):
    rows = [(1.0, 1.0 + 2**-52, "noise"), (1.0, 1.1, "material"), (100.0, 100.5, "within_tolerance"), (None, 1.0, None), (float("nan"), 1.0, None), (2.0, 2.0, None)]
    d = spark.createDataFrame(rows, "b double, c double, want string")
    got = d.select("want", numbers.materiality(F.col("b"), F.col("c"), numbers.matches(F.col("b"), F.col("c"), 0.0, 0.01)).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    s = spark.createDataFrame([("up 1,234.5 to $3M",)], "t string").select(numbers.skeleton(F.col("t"))).first()[0]
    assert s == "up #to $#M"


def test_similarity():
    assert similarity.indel_ratio("abcd", "abxd") == pytest.approx(75.0)
    assert similarity.token_set_ratio("the big dog", "dog the") == 100.0
    assert similarity.indel_ratio("", "") == 100.0 and similarity.token_set_ratio("", "a") == 0.0


def test_alignment_edges(spark):
    empty = spark.createDataFrame([], "k long, o long")
    one = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k long, o long")
    assert {r.event for r in align.keyed(empty, one, ["k"], ["o"]).collect()} == {"inserted"}
    assert align.keyed(one, one, ["k"], ["o"]).where("event = 'paired'").count() == 3
    assert align.identity(one, one, ["k"], ["o"]).count() == 1
    moved = align.reordered(spark.createDataFrame([("d", i, x) for i, x in enumerate([2, 0, 1, 3])], "g string, a long, b long"), "g", "a", "b")
    assert [r.b for r in moved.collect()] == [2]
    assert diff.structure(one.limit(0), one.limit(0), ["k"], ["o"]).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)], "a long, b long")
    assert {(r.id, r.cycle) for r in cycles.cycles(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5)}
    assert {(r.id, r.part) for r in graph.connected(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6)}
    assert graph.connected(e.limit(0)).count() == 0 and graph.closure(e.limit(0)).count() == 0


def test_graph_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(0, 2), (100, 120)], "a long, b long")
    step = {(a, b): b - a - (a == 0 and b > 1) - 19 * (a <= 100 and b >= 120) for a in range(151) for b in range(a + 1, 151)}
    assert {(r.start, r.reached): r.distance for r in graph.closure(chain).collect()} == step
    ring = spark.createDataFrame([(i, (i + 1) % 100) for i in range(100)] + [(99, 100), *[(i, i + 1) for i in range(100, 180)], (180, 180)], "a long, b long")
    assert {(r.id, r.cycle) for r in cycles.cycles(ring).collect()} == {(i, 0) for i in range(100)} | {(180, 180)}


def test_region_scores_of_all_pairs(spark):
    pick = random.Random(3)
    side = lambda: [("s", i, pick.choice(["long", "block"]), pick.choice([1, 4, 5, 25, 26, 125, 700]), pick.choice([1, 2, 5, 25, 30]), pick.randint(1, 9), pick.randint(1, 3)) for i in range(40)]
    a, b = side(), side()
    la, lb = ({(x[1], pick.choice("pqrst")) for x in y for _ in range(x[1] % 3)} for y in (a, b))
    want = {}
    for _, i, o, r, c, t, l in a:
        for _, k, p, q, d, u, m in b:
            x, y = {z for j, z in la if j == i}, {z for j, z in lb if j == k}
            label = 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.25
            score = 0.65 * label + 0.25 * (min(r, q) / max(r, q) + min(c, d) / max(c, d)) / 2 + 0.10 / (1 + abs(t - u) + abs(l - m))
            if o == p and score >= 0.20:
                want[i, k] = score
    frame = lambda y: spark.createDataFrame(y, "sheet string, id long, orientation string, rows long, cols long, top long, left long")
    words = lambda y: spark.createDataFrame([("s", *x) for x in sorted(y)], "sheet string, id long, label string")
    got = objects.region_scores(frame(a), frame(b), words(la), words(lb)).collect()
    assert {(r.a, r.b): r.score for r in got} == pytest.approx(want, abs=1e-12) and len(got) == len(want) > 200


def test_mutual_best_until_none_is_left(spark):
    scored = spark.createDataFrame([("a1", "b1", 9), ("a1", "b2", 8), ("a2", "b1", 7), ("a2", "b2", 6), ("a3", "b3", 5), ("a3", "b4", 5), ("a4", "b3", 4)], "a string, b string, s long")
    assert {(r.a, r.b) for r in align.mutual_best(scored, "a", "b", "s").collect()} == {("a1", "b1"), ("a2", "b2")}
    assert align.mutual_best(scored.limit(0), "a", "b", "s").count() == 0


def test_zero_figure_among_cells_without_a_number(spark):
    figures = spark.createDataFrame([(1, 0.0, 1.0, False, 0, False, 0.0)], "figure_id long, mantissa double, scale double, percent boolean, decimals int, negative boolean, figure_value double")
    values = [None] * 8 + [float("nan"), float("inf"), 0.4, -0.1, 0.2, 0.0, 0.3, 0.45, 7.0]
    cells = spark.createDataFrame([("s", i, 1, v) for i, v in enumerate(values)], "sheet string, row long, col long, value double")
    assert [r.value for r in crosscheck.candidates(figures, cells).orderBy("rank").collect()] == [0.0, -0.1, 0.2, 0.3, 0.4]


def test_regions_whose_boxes_overlap_are_merged(spark):
    pick = random.Random(5)
    cells = {(r, 0) for r in range(6)} | {(5, c) for c in range(6)} | {(1, 3), (1, 4)} | {(pick.randint(60, 140), pick.randint(10, 90)) for _ in range(1_500)} | {(r, 200) for r in range(0, 200, 2)} | {(r, 201) for r in range(40)}
    left, boxes = set(cells), []
    while left:
        part = {left.pop()}
        edge = list(part)
        while edge:
            r, c = edge.pop()
            near = {(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)} & left
            left -= near
            part |= near
            edge += near
        boxes.append([min(r for r, _ in part), max(r for r, _ in part), min(c for _, c in part), max(c for _, c in part), len(part)])
    parts, again = len(boxes), True
    while again:
        again = False
        for i, j in ((i, j) for i in range(len(boxes)) for j in range(i)):
            x, y = boxes[i], boxes[j]
            if x[0] <= y[1] and y[0] <= x[1] and x[2] <= y[3] and y[2] <= x[3]:
                boxes[j], again = [min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]), x[4] + y[4]], True
                del boxes[i]
                break
    got = regions.regions(spark.createDataFrame([("s", *x) for x in cells], "sheet string, row long, col long"), "sheet", "row", "col").collect()
    assert sorted([r.min_row, r.max_row, r.min_col, r.max_col, r.cells] for r in got) == sorted(boxes)
    assert [0, 5, 0, 5, 13] in boxes and len(boxes) < parts - 1


def test_root_causes(spark):
    f = spark.createDataFrame([("excel", "S", "A1", "formula_error"), ("excel", "S", "A1", "formula_hardcoded"), ("excel", "S", "A2", "formula_error"), ("excel", "S", "A1", "value_changed")], "artifact string, sheet string, location string, finding_class string")
    assert sorted(str(r.root_cause_key) for r in triage.root_causes(f).collect()) == ["None", "None", "excel:S:A1", "excel:S:A1"]


def test_privacy(spark):
    r = spark.createDataFrame([("name", 100.0)], "t string, x double").select(privacy.pseudonym(F.col("t"), 7).alias("p"), privacy.scrambled(F.col("x"), 7, "A1").alias("x"), privacy.kind(F.lit("#N/A")).alias("k")).first()
    assert r.p.startswith("TXT_") and len(r.p) == 10 and 85 <= r.x <= 115 and r.k == "error"


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("F0002", "b"), ("F0001", "a")], "finding_id string, message string")
    for run in ("r1", "r2", "r1"):
        sinks.record_run(f, str(tmp_path / "runs"), run)
    assert spark.read.parquet(str(tmp_path / "runs")).groupBy("run_id").count().orderBy("run_id").collect()[0]["count"] == 2
    sinks.json_report(f, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2026-01-01 00:{i:02d}:00", "a", float(i)) for i in range(50)], "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = arrivals.by_window(stream, "ts", ["event_type"], "10 minutes", "5 minutes").writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    closed = {(str(r.start), r.events) for r in spark.table("closed").collect()}
    want = {(str(r.start), r.events) for r in arrivals.by_window(events, "ts", ["event_type"], "10 minutes", "5 minutes").collect()}
    assert closed < want and len(closed) >= 3
