"""Spreadsheets written by hand and read back."""

import zipfile

import pytest
from lodestream.sources import ingest
from lodestream.sources.xlsx import rows, spreadsheet

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write(path, sheet_rows, shared=(), old=False, extra=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(old)}"/><sheets><sheet name="Main" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>" + "".join(f"<row>{r}</row>" for r in sheet_rows) + f"</sheetData>{extra}</worksheet>")
    return path


def text(ref, s):
    return f'<c r="{ref}" t="inlineStr"><is><t>{s}</t></is></c>'


HEAD = text("A1", "ticker") + text("B1", " weight ") + text("D1", "as of")


def test_cells_of_every_kind(tmp_path):
    cells = ['<c r="A2" t="s"><v>0</v></c><c r="B2"><v>1.5</v></c><c r="D2" s="1"><v>45292</v></c>', "", '<c r="A4" t="b"><v>1</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="D4" s="4"><v>45292.75</v></c>',
             '<c r="B5" s="3"><v>7</v></c><c r="AA5" t="str"><f>1</f><v>far</v></c>', '<c r="D6" s="2"><v>1</v></c>', '<c t="str"><v>no</v></c><c><v>2</v></c>']
    p = write(tmp_path / "a.xlsx", [HEAD, *cells], ["<r><t>0</t></r><r><t>28</t></r><rPh><t>hint</t></rPh>"])
    got = list(rows(p.read_bytes()))
    assert got[1:3] == [["028", "1.5", None, "2024-01-01"], ["true", None, None, "2024-01-01 18:00:00"]]
    assert got[3][1] == "7" and got[3][26] == "far" and got[4] == [None, None, None, "1900-01-01"] and got[5] == ["no", "2"]
    assert list(rows(write(tmp_path / "b.xlsx", ['<c r="A1" s="1"><v>0</v></c>'], old=True).read_bytes(), "Main")) == [["1904-01-01"]]


def test_files_with_drifting_headers_and_footers(spark, tmp_path):
    line = lambda i: text(f"A{i}", f"t{i}") + f'<c r="B{i}"><v>{i}</v></c>' + f'<c r="D{i}" s="1"><v>{45292 + i}</v></c>'
    write(tmp_path / "a.xlsx", [text("A1", "a title"), HEAD, line(3), line(4), text("A5", "note"), text("A6", "note")])
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "b.xlsx", [text("A1", "other title"), text("A1", "weight") + text("B1", "extra"), '<c r="A2"><v>9</v></c>', "<c/>", text("A5", "note"), text("A6", "note")])
    write(tmp_path / "sub" / "c.xlsx", [])
    got = sorted((r["ticker"], r["weight"], r["as of"], r["row_idx"]) if r["ticker"] else ("", r["weight"], r["as of"], r["row_idx"]) for r in spreadsheet(spark, f"file://{tmp_path}", skip=1, footer=2).collect())
    assert got == [("", "9", None, 0), ("t3", "3", "2024-01-04", 0), ("t4", "4", "2024-01-05", 1)]
    clean = ingest.metadata(spreadsheet(spark, str(tmp_path), ["ticker", "weight", "as of"], skip=1, footer=2), {"code": ["Ticker", "ticker"], "weight": ["weight"], "day": ["as of"]}, ["weight"], ["day"])
    assert {(r.code, r.weight, str(r.day)) for r in clean.collect()} == {("t3", 3.0, "2024-01-04"), ("t4", 4.0, "2024-01-05"), (None, 9.0, "None")}


def test_unreadable_files(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(b"no zip")
    write(tmp_path / "y.xlsx", [HEAD, text("A2", "t")])
    with pytest.raises(Exception, match="no readable spreadsheet"):
        spreadsheet(spark, str(tmp_path), ["ticker"]).collect()
    assert [r.ticker for r in spreadsheet(spark, str(tmp_path), ["ticker"], skip_unreadable=True).collect()] == ["t"]
    assert spreadsheet(spark, str(tmp_path), skip_unreadable=True).columns == ["source_file", "row_idx", "ticker", "weight", "as of"]
