"""Rows of a sheet in every spelling, against a whole tree of the same sheet."""

import io
import time
import zipfile
from xml.etree import ElementTree

import pytest
from sluicework.sources import workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'
SHARED = f"<sst {NS}><si><t>s0</t></si><si><r><t>s</t></r><r><t>1</t></r></si></sst>"


def plain(first, n=4000):
    return "".join(
        f'<row r="{i}" spans="1:6"><c r="A{i}"><v>{i}.50</v></c><c r="C{i}" t="inlineStr"><is><t>t {i}</t></is></c><c r="D{i}" s="1"><v>{i}.25</v></c>'
        f'<c r="E{i}" t="b"><v>{i % 2}</v></c><c r="AA{i}" t="s"><v>{i % 3}</v></c><c r="AB{i}" s="1"/></row>'
        for i in range(first, first + n)
    )


def sheet(body, head="", tag="worksheet", end="", encoding="utf-8", ns=NS):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/sharedStrings.xml", SHARED)
        z.writestr("s.xml", f"{head}<{tag} {ns}><cols>{end}</cols><sheetData>{body}</sheetData></{tag}>".encode(encoding))
    return zipfile.ZipFile(out)


def expected(z):
    texts, dates, number = workbook._texts(z), workbook._date_styles(z), 0
    for row in ElementTree.fromstring(z.read("s.xml")).iter():
        if workbook._tag(row) != "row":
            continue
        number, cells = int(row.attrib.get("r", number + 1)), []
        for c in (c for c in row if workbook._tag(c) == "c"):
            at, raw = workbook._column(c.attrib["r"]) if "r" in c.attrib else len(cells), ""
            for child in c:
                if workbook._tag(child) == "v":
                    raw = child.text or ""
                elif workbook._tag(child) == "is":
                    raw = "".join(t.text or "" for t in workbook._runs(child))
            cells += [""] * (at - len(cells))
            cells.append(workbook.cell_text(raw, c.attrib.get("t", ""), int(c.attrib.get("s", 0)), texts, dates))
        yield number, cells


ODD = [
    '<row><c><v>9</v></c><c t="str"><f>A1&amp;"x"</f><v>a &lt; b</v></c></row>',
    "<row r='5000'><c r='B5000' t='inlineStr'><is><t>x</t><rPh sb='0'><t>no</t></rPh><r><t>y</t></r></is></c></row>",
    '<row r="5000"><c t="inlineStr" r="C5000"><is><t>a\r\nb ]</t></is></c><c r="A5000"><v>late</v></c></row>',
    '<!-- <row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2"><v>1</v></c></row> -->',
    '<?x <row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2"><v>1</v></c></row> ?>',
    '<row r="5000"><c r="A5000" t="inlineStr"><is><t><![CDATA[</t></is></c></row><row r="1"><c r="A1"><v>1</v></c></row>]]></t></is></c></row>',
    '<row r="5000"><c r="A5000"><v>1<x>2</x>3</v></c><extLst><c r="Z1"><v>8</v></c></extLst></row>',
    '\n  <row r="5000">\n  <c r="A5000"> <v>1e3</v> </c>\n  </row>\n',
    '<row r="5000"/><row r="5001"></row><row r="5002"><c r="B5002" t="e"><v>#N/A</v></c></row>',
    '<row r="5000"><c r="A5000" t="inlineStr"><is><t xml:space="preserve"> příliš &#65; </t></is></c></row>',
    '<x:row xmlns:x="urn:x" r="5000"><x:c r="B5000"><x:v>7.00</x:v></x:c></x:row>',
]


@pytest.mark.parametrize("odd", range(len(ODD)))
def test_odd_rows_between_plain_ones(odd):
    z = sheet(plain(3) + ODD[odd] + plain(6000))
    got = list(workbook.sheet_rows(z, "s.xml"))
    assert got == list(expected(z)) and len(got) >= 8000


@pytest.mark.parametrize(
    "head,encoding",
    [
        ("", "utf-8"), ("", "utf-8-sig"), ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n', "utf-8"), ('<?xml version="1.0" encoding="iso-8859-1"?>', "latin-1"),
        ('<?xml version="1.0" encoding="utf-16"?>', "utf-16"), ('<?xml version="1.0"?><!DOCTYPE worksheet [<!ENTITY e "<row r=\'1\'/>">]>', "utf-8"), ("<!-- <row r='1'> -->", "utf-8"),
    ],
)
@pytest.mark.parametrize("end", ["", "<col/>" * 30_000])
def test_heads_and_encodings(head, encoding, end):
    z = sheet(plain(2, 1500) + '<row r="1502"><c r="A1502" t="inlineStr"><is><t>é</t></is></c></row>', head, end=end, encoding=encoding)
    got = list(workbook.sheet_rows(z, "s.xml"))
    assert got == list(expected(z)) and got[-1] == (1502, ["é"]) and len(got) == 1501


def test_sheets_without_rows_and_broken_ones():
    assert list(workbook.sheet_rows(sheet(""), "s.xml")) == []
    for body in ('<row r="1"><c r="A1"><v>1</v></c></row><row r="2">', '<row r="1"><c r="A1"><v>\x01</v></c></row>', "<row r='1'><c r='A1'><v>&x;</v></c></row>"):
        with pytest.raises(Exception, match="line 1"):
            list(workbook.sheet_rows(sheet(plain(3, 100) + body), "s.xml"))
    with pytest.raises(ValueError, match="last column"):
        list(workbook.sheet_rows(sheet('<row r="1"><c r="XFE1"><v>1</v></c></row>'), "s.xml"))


def test_plain_rows_are_not_taken_apart_element_by_element():
    z = sheet(plain(1, 20_000))

    def seconds(read):
        began = time.process_time()
        n = sum(1 for _ in read())
        assert n >= 20_000
        return time.process_time() - began

    def events():
        with z.open("s.xml") as f:
            for _, e in ElementTree.iterparse(f):
                yield e
                e.clear()

    assert min(seconds(lambda: workbook.sheet_rows(z, "s.xml")) for _ in range(3)) < min(seconds(events) for _ in range(3))


def test_references_in_cash_sheets_stay_plain():
    from sluicework.catalog.sources import make_workbook
    import pandas as pd

    texts = ["a & b", "<x>", "&lt;", "&amp;lt;", "q \" '", "]] >", "note"] * 2000
    book = make_workbook(["ID", "Comment"], ["num", "text"])(pd.DataFrame({"id": range(len(texts)), "c": texts}))
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        got = list(workbook.sheet_rows(z, "xl/worksheets/sheet1.xml"))
        blocks = list(workbook._blocks(z.open("xl/worksheets/sheet1.xml")))
    assert [cells for _, cells in got[1:]] == [["", str(i), t] for i, t in enumerate(texts)]
    assert all(workbook._plain_rows(b, workbook._column, workbook._kind, [], set()) is not None for b in blocks[1:-1])
