"""Workbooks, written here as the zip folders of XML that they are."""

import zipfile
from xml.sax.saxutils import escape, quoteattr

import pytest
from pyspark.sql import functions as F

from groundmesh.operators.relations import SHEETS, workbook_relations
from groundmesh.sources.workbook import WorkbookSource, parse_workbooks, read_workbook, workbook_sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def letters(n):
    return letters(n // 26 - 1) + letters(n % 26) if n >= 26 else chr(65 + n)


def write_workbook(path, sheets, late=False, absolute=False):
    """sheets: name -> rows of cells. Text, number, bool, None, or (attributes, inner XML) of a cell."""
    strings = []

    def cell(value, row, column):
        at = f'r="{letters(column)}{row}"'
        if isinstance(value, tuple):
            return f"<c {at} {value[0]}>{value[1]}</c>"
        if isinstance(value, bool):
            return f'<c {at} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c {at}><v>{value}</v></c>"
        strings.append(value)
        return f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        listed, related = "", ""
        for n, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(f'<row r="{i}">' + "".join(cell(v, i, j) for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
            listed += f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>'
            related += f'<Relationship Id="rId{n}" Type="{OFFICE}/worksheet" Target="{"/xl/" if absolute else ""}worksheets/sheet{n}.xml"/>'
        shared = "".join(f"<si>{s[1]}</si>" if isinstance(s, list) else f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="[Red]yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        related += f'<Relationship Id="rS" Type="{OFFICE}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rY" Type="{OFFICE}/styles" Target="styles.xml"/><Relationship Id="rC" Type="{OFFICE}/chartsheet" Target="chartsheets/sheet1.xml"/>'
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{OFFICE}"><workbookPr date1904="{int(late)}"/><sheets>{listed}<sheet name="Chart" sheetId="99" r:id="rC"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{related}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')


FIVE = {
    "FG & PWO": [["Functional Group (FG)", "Primary Work Object (PWO)", "Dependency Links"], ["Group", "Object", "first, second"], [None, None, None], ["Group", "Other", None]],
    "SWO": [["PWO", "Secondary Work Object (SWO)"], ["Object", "Sub"]],
    "Skills": [["SWO", "Skill"], ["Sub", "Lift"]],
    "Tasks": [["Skill", "Task"], ["Lift", "Move <it> & go"]],
    "Control Point": [["Task", "Control Point"], ["Move <it> & go", 7]],
    "Notes": [["x"], ["y"]],
}


@pytest.fixture
def source(spark):
    spark.dataSource.register(WorkbookSource)
    return lambda path: spark.read.format("xlsx").load(str(path))


def test_five_sheets_become_edges(spark, source, tmp_path):
    path = tmp_path / "book.xlsx"
    write_workbook(path, FIVE)
    rows = source(path)
    assert rows.rdd.getNumPartitions() == 6
    for sheets in (workbook_sheets(rows), read_workbook(spark, str(path))):
        assert set(sheets) == set(FIVE) and set(SHEETS) < set(FIVE)
        edges = workbook_relations(sheets, "book.xlsx").collect()
        got = sorted((e.metadata.sheet_name, e.metadata.row_number, e.source_id, e.relation_type, e.target_id) for e in edges)
        assert got == [
            ("Control Point", 2, "move-it-go", "has_control_point", "7"), ("FG & PWO", 2, "group", "has_pwo", "object"), ("FG & PWO", 2, "object", "depends_on", "first"), ("FG & PWO", 2, "object", "depends_on", "second"),
            ("FG & PWO", 3, "group", "has_pwo", "other"), ("SWO", 2, "object", "has_swo", "sub"), ("Skills", 2, "sub", "has_skill", "lift"), ("Tasks", 2, "lift", "has_task", "move-it-go"),
        ]


def test_header_rule_and_cells(source, tmp_path):
    rows = [
        [], [None, None], [None, " A\xa0 b\u200b ", None, "Twice", "", "Twice", "Long"], [],
        ["no name", "  x ", "no name", "first", "no name", "last", "  kept as stored "],
        [None, None, None, None, None, None, None], [None, True, None, 5], [None, 2.5, None, None, None, 1e-3],
        [None, ('t="inlineStr"', "<is><t>in</t><r><t>line</t></r></is>"), None, None, None, ('t="str"', "<f>A1</f><v>made</v>"), ('t="e"', "<v>#N/A</v>")],
        [None, ('s="1"', "<v>43831</v>"), None, None, None, ('s="2"', "<v>43831.5</v>"), ('s="3"', "<v>43831</v>")],
        [None, ('s="1"', "<v>0.25</v>"), None, None, None, ('s="1"', "<v>1</v>"), ('s="1"', "")],
    ]
    write_workbook(tmp_path / "a.xlsx", {"One": rows, "Empty": [], "Only header": [["h"]]}, absolute=True)
    got = [(r.sheet, r.row_number, r.cells) for r in source(tmp_path / "a.xlsx").orderBy("row_number").collect()]
    assert got == [
        ("One", 2, {"A b": "  x ", "Twice": "last", "Long": "  kept as stored "}), ("One", 3, {"A b": "True", "Twice": "", "Long": ""}), ("One", 4, {"A b": "2.5", "Twice": "0.001", "Long": ""}),
        ("One", 5, {"A b": "inline", "Twice": "made", "Long": "#N/A"}), ("One", 6, {"A b": "2020-01-01 00:00:00", "Twice": "2020-01-01 12:00:00", "Long": "43831"}), ("One", 7, {"A b": "06:00:00", "Twice": "1900-01-01 00:00:00", "Long": ""}),
    ]
    write_workbook(tmp_path / "b.xlsx", {"S": [["d"], [('s="1"', "<v>1</v>")], [["rich", "<r><t>a </t></r><rPh><t>no</t></rPh><r><t>b</t></r>"]]]}, late=True)
    assert [r.cells["d"] for r in source(tmp_path / "b.xlsx").orderBy("row_number").collect()] == ["1904-01-02 00:00:00", "a b"]


def test_folders_wide_sheets_and_bytes(spark, source, tmp_path):
    wide = [[f"c{j}" for j in range(800)], [f"v{j}" for j in range(800)]]
    write_workbook(tmp_path / "w.xlsx", {"Wide": wide})
    write_workbook(tmp_path / "x.xlsx", {"Long": [["n"]] + [[i] for i in range(12_000)]})
    both = source(tmp_path)
    assert both.where("file = 'w.xlsx'").first().cells["c799"] == "v799"
    assert both.where("file = 'x.xlsx'").agg(F.count("row_number"), F.max("row_number"), F.sum(F.col("cells")["n"].cast("long"))).first()[:] == (12_000, 12_001, 71_994_000)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.xlsx"))
    assert sorted(map(repr, parse_workbooks(files).collect())) == sorted(map(repr, both.collect()))
    assert parse_workbooks(spark.createDataFrame([("x", None)], "path string, content binary")).count() == 0


def test_paths_that_cannot_be_read(source, tmp_path):
    with pytest.raises(Exception, match="binaryFile"):
        source("s3://bucket/x.xlsx").collect()
    with pytest.raises(Exception, match="nowhere"):
        source(tmp_path / "nowhere.xlsx").collect()
