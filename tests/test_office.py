import io
import zipfile

import pytest

from textloom.operators import chunkers
from textloom.sources import office

CELLS = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c r="B3"><v>0.1</v></c><c r="C3" s="1"><v>45443</v></c><c r="D3" s="2"><v>45443.5</v></c></row>
<row><c><v>12.0</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v>a_x000D_b</v></c><c r="AA4" s="3"><v>7</v></c></row>
<row r="5"/></sheetData></worksheet>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>na</t><rPh sb="0" eb="1"><t>x</t></rPh></si><si><r><t xml:space="preserve">two </t></r><r><t>runs &amp; é</t></r></si></sst>"""
STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="[Red]yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/></numFmts>
<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>"""


def _with(whole, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if name not in parts:
                new.writestr(name, old.read(name))
        for name, text in parts.items():
            new.writestr(name, text)
    return out.getvalue()


def _read(spark, kind, path, **options):
    office.register(spark)
    return spark.read.format(kind).options(**options).load(str(path))


def test_cells_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_with(office.xlsx_file([["x"]], "S & 1"), **{"xl/worksheets/sheet1.xml": CELLS, "xl/sharedStrings.xml": STRINGS, "xl/styles.xml": STYLES}))
    rows = _read(spark, "xlsx", tmp_path)
    got = [(r.sheet, r.row, r.cells, r.error) for r in rows.orderBy("row").collect()]
    assert got[:2] == [("S & 1", 0, ["na", "two runs & é", None, "na"], None), ("S & 1", 2, ["inline", "0.1", "2024-05-31 00:00:00", "2024-05-31 12:00:00"], None)]
    assert got[2] == ("S & 1", 3, ["12", "True", None, "a\rb", *[None] * 22, "7"], None) and len(got) == 3
    sheets = office.sheet_cells(rows)
    named = {r.row: [c.header for c in r.cells] for r in sheets.collect()}
    assert named[1] == ["na", "two runs & é", "Unnamed: 2", "na.1"] and named[2][-1] == "Unnamed: 26" and set(named) == {1, 2}
    assert {c.header for r in office.sheet_cells(rows, 0).collect() for c in r.cells} == {str(k) for k in range(27)}
    text = [r.text for r in chunkers.chunk_rows(sheets, None, "row", sheets.doc_id).collect()]
    assert text == ["na: inline | two runs & é: 0.1 | Unnamed: 2: 2024-05-31 00:00:00 | na.1: 2024-05-31 12:00:00\nna: 12 | two runs & é: True | na.1: a\rb | Unnamed: 26: 7"]


def test_files_written_are_read_back(spark, tmp_path):
    want = {f"b{n}": [[f"s{n}", "_x000D_", None, "5", "-0", "\x01 <&>", "x" * 70000]] * (n + 1) for n in range(5)}
    df = spark.createDataFrame([(f, r, c) for f, rows in want.items() for r, c in enumerate(rows)], "file string, row int, cells array<string>")
    office.write_xlsx(df, str(tmp_path / "out"))
    office.write_xlsx(df, f"file:{tmp_path}/out")
    got = {}
    for r in _read(spark, "xlsx", tmp_path / "out", maxPartitionBytes=2000).orderBy("path", "row").collect():
        got.setdefault(r.path.rpartition("/")[2][:-5], []).append(r.cells)
    assert got == want
    assert _read(spark, "xlsx", tmp_path / "out", maxPartitionBytes=1).rdd.getNumPartitions() == 5 and _read(spark, "xlsx", tmp_path / "out").rdd.getNumPartitions() == 1


def test_paragraphs(spark, tmp_path):
    given = [("Title", "On <things>"), ("Heading 1", "One"), ("Normal", "a\tb\nc"), ("Normal", ""), ("Heading 2", "Two"), ("Body Text", "é " * 40000)]
    whole = office.docx_file(given)
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        body = z.read("word/document.xml").decode()
    more = '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:tabs><w:tab w:val="left" w:pos="9"/></w:tabs></w:pPr><w:r><w:t>last</w:t><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:r></w:p></w:body>'
    (tmp_path / "a.docx").write_bytes(_with(whole, **{"word/document.xml": body.replace("</w:body>", more)}))
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    got = _read(spark, "docx", tmp_path).orderBy("pos")
    assert [(r.pos, r.style, r.text) for r in got.collect()] == [(k, s, t) for k, (s, t) in enumerate([*given, ("Normal", "last")])]
    sections = chunkers.chunk_paragraphs(got.withColumnRenamed("path", "doc_id").filter("pos < 5"))
    assert [(r.heading, r.text.split()) for r in sections.collect()] == [("One", ["One", "a", "b", "c"])]


def test_faults(spark, tmp_path):
    good = office.xlsx_file([["a"]])
    (tmp_path / "good.xlsx").write_bytes(good)
    (tmp_path / "cut.xlsx").write_bytes(good[:50])
    (tmp_path / "empty.xlsx").write_bytes(b"")
    (tmp_path / "xml.xlsx").write_bytes(_with(good, **{"xl/worksheets/sheet1.xml": CELLS[:300]}))
    (tmp_path / "bomb.xlsx").write_bytes(_with(good, **{"xl/sharedStrings.xml": '<!DOCTYPE x [<!ENTITY a "aaaa">]><sst>&a;</sst>'}))
    (tmp_path / "index.xlsx").write_bytes(_with(good, **{"xl/sharedStrings.xml": "<sst/>"}))
    for size in (1, 1 << 20):
        rows = _read(spark, "xlsx", tmp_path, maxPartitionBytes=size)
        got = {r.path.rpartition("/")[2]: r for r in rows.collect() if r.path.endswith("good.xlsx") or r.error}
        assert len(got) == 6 and got["good.xlsx"].error is None and all(r.error for f, r in got.items() if f != "good.xlsx")
    with pytest.raises(Exception, match="document type"):
        _read(spark, "xlsx", tmp_path, mode="FAILFAST").collect()
    (tmp_path / "none").mkdir()
    assert _read(spark, "xlsx", tmp_path / "none").count() == 0 and office.sheet_cells(_read(spark, "xlsx", tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="isn't there"):
        _read(spark, "xlsx", tmp_path / "nothing").collect()
