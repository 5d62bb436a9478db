"""Workbooks: the active sheet by its relationship, cells as texts, and the data source over them."""

import zipfile

from mensura.sources import records, workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, active=0, styles="", shared="", date1904=False):
    """sheets: (name, file, rows as XML) in the workbook's order."""
    with zipfile.ZipFile(path, "w") as f:
        listed = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="rId{k + 7}"/>' for k, (n, _, _) in enumerate(sheets))
        flag = '<workbookPr date1904="1"/>' if date1904 else ""
        f.writestr("xl/workbook.xml", f'<workbook {MAIN} {R}>{flag}<bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{k + 7}" Target="{file}"/>' for k, (_, file, _) in enumerate(sheets))
        f.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {RELS}>{targets}</Relationships>")
        if styles:
            f.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
        if shared:
            f.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
        for _, file, rows in sheets:
            f.writestr(file.lstrip("/") if file.startswith("/") else f"xl/{file}", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return path


def text(ref, x):
    return f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>'


HEADER = f'<row r="1">{text("A1", "material_name ")}{text("B1", "unit_price")}</row>'


def test_active_sheet_by_relationship(tmp_path):
    """The first sheet is stored in sheet2.xml and the second in sheet1.xml; the active one is told by the workbook's order."""
    first, second = HEADER + f'<row r="2">{text("A2", "first")}</row>', HEADER + f'<row r="2">{text("A2", "second")}</row>'
    sheets = [("First", "worksheets/sheet2.xml", first), ("Second", "/xl/worksheets/sheet1.xml", second)]
    for active, want in ((0, "first"), (1, "second")):
        names, rows = workbooks.workbook_rows(book(tmp_path / "a.xlsx", sheets, active).read_bytes())
        assert names == ["material_name", "unit_price"] and rows == [{"material_name": want, "unit_price": ""}]


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/><numFmt numFmtId="166" formatCode="[Red]0"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/><xf numFmtId="46"/><xf numFmtId="166"/></cellXfs>'


def test_cells_as_texts(tmp_path):
    cells = [("n", 0, "12"), ("n", 0, "12.0"), ("n", 0, "1.50"), ("n", 0, "1E3"), ("n", 0, "0"), ("n", 0, "0.0"), ("n", 1, "45306"), ("n", 2, "45306.75"), ("n", 3, "2.5"), ("n", 4, "0.5"), ("n", 5, "1.25"), ("n", 6, "7"), ("b", 0, "1"), ("b", 0, "0"), ("e", 0, "#N/A"), ("str", 0, " made "), ("d", 0, "2024-01-15"), ("n", 1, "45"), ("s", 0, "0")]
    want = ["12", "12.0", "1.5", "1000.0", "", "", "2024-01-15 00:00:00", "2024-01-15 18:00:00", "2.5", "12:00:00", "1 day, 6:00:00", "7", "True", "", "#N/A", "made", "2024-01-15", "1900-02-14 00:00:00", "rich text"]
    rows = f'<row r="1">{text("A1", "v")}</row>'
    rows += "".join(f'<row r="{k + 2}"><c r="A{k + 2}" t="{t}" s="{s}"><v>{v}</v></c></row>' for k, (t, s, v) in enumerate(cells))
    shared = "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>reading</t></rPh></si>"
    got = workbooks.workbook_rows(book(tmp_path / "a.xlsx", [("S", "worksheets/sheet1.xml", rows)], styles=STYLES, shared=shared).read_bytes())
    assert got[0] == ["v"] and [r["v"] for r in got[1]] == want
    older = book(tmp_path / "b.xlsx", [("S", "worksheets/sheet1.xml", f'<row r="1">{text("A1", "v")}</row><row r="2"><c r="A2" s="1"><v>43844</v></c></row>')], styles=STYLES, date1904=True)
    assert workbooks.workbook_rows(older.read_bytes())[1] == [{"v": "2024-01-15 00:00:00"}]


def test_gaps_and_headers(tmp_path):
    """Rows that are not stored count as blank ones; columns without a name are left out; a header may stand alone."""
    rows = f'<row r="1">{text("A1", "a")}{text("C1", "c")}</row><row r="4">{text("B4", "lost")}{text("C4", "x")}</row>'
    names, got = workbooks.workbook_rows(book(tmp_path / "a.xlsx", [("S", "worksheets/sheet1.xml", rows)]).read_bytes())
    assert names == ["a", "c"] and got == [{"a": "", "c": ""}, {"a": "", "c": ""}, {"a": "", "c": "x"}]
    assert workbooks.workbook_rows(book(tmp_path / "b.xlsx", [("S", "worksheets/sheet1.xml", HEADER)]).read_bytes()) == (["material_name", "unit_price"], [])
    assert workbooks.workbook_rows(book(tmp_path / "c.xlsx", [("S", "worksheets/sheet1.xml", "")]).read_bytes()) == ([], [])


def test_header_only_workbooks_keep_their_columns(spark, tmp_path):
    book(tmp_path / "a.xlsx", [("S", "worksheets/sheet1.xml", HEADER)])
    got = records.read_catalog_xlsx(spark, str(tmp_path / "*.xlsx"))
    assert got.columns == ["row", "material_name", "unit_price"] and got.count() == 0


def test_data_source(spark, tmp_path):
    for name in ("a", "b"):
        book(tmp_path / f"{name}.xlsx", [("S", "worksheets/sheet1.xml", HEADER + f'<row r="2">{text("A2", name)}<c r="B2"><v>2.5</v></c></row><row r="3"/>')])
    book(tmp_path / "c.xlsx", [("S", "worksheets/sheet1.xml", f'<row r="1">{text("A1", "rate_name")}</row><row r="2">{text("A2", "crew")}</row>')])
    (tmp_path / "notes.txt").write_text("no workbook")
    spark.dataSource.register(workbooks.WorkbookSource)
    plain = spark.read.format("catalog_workbooks").load(str(tmp_path))
    assert plain.rdd.getNumPartitions() == 3
    got = sorted((r.file, r.row, r.header, r.cells) for r in plain.collect())
    assert got[0] == ("a.xlsx", 1, ["material_name", "unit_price"], None) and got[1][3] == {"material_name": "a", "unit_price": "2.5"} and len(got) == 8
    typed = spark.read.format("catalog_workbooks").schema("file string, row long, material_name string, unit_price string").load(str(tmp_path))
    assert sorted(map(tuple, typed.collect())) == [("a.xlsx", 2, "a", "2.5"), ("a.xlsx", 3, "", ""), ("b.xlsx", 2, "b", "2.5"), ("b.xlsx", 3, "", ""), ("c.xlsx", 2, "", "")]
