"""Scans: written small files must come back value for value."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sluicework.sources import archive, json_array, text, workbook
from sluicework.sources.columns import normalise_decimal

FIELDS = ["_file", "_stem", "_record_num"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_text_scan(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes('﻿id,name , id,note\r\n1, x ,9,"q, ""w"""\r\n2,y,8,"unclosed\r\n3,z\r\n'.encode())
    (tmp_path / "c.csv").write_text("name,id\nn1,7\n")
    (tmp_path / "skip.txt").write_text("name,id\nn1,7\n")
    df = text.scan(spark, text.TextSource(str(tmp_path)))
    assert rows(df, *FIELDS, "id", "name", "note") == [
        ("a b.csv", "a b", 1, "9", "x", 'q, "w"'),
        ("a b.csv", "a b", 2, "8", "y", "unclosed"),
        ("a b.csv", "a b", 3, "", "z", ""),
        ("c.csv", "c", 1, "7", "n1", ""),
    ]


def test_header_line_and_pipe(spark, tmp_path):
    (tmp_path / "a.txt").write_text("preamble\n\nk|v\n1|1.234,56\n2|75,00\n3|N/A\n")
    src = text.TextSource(str(tmp_path), suffix=".txt", delimiter="|", quote="none", header_line=3, decimal_separator=",")
    assert rows(text.scan(spark, src), "_record_num", "k", "v") == [(1, "1", "1234.56"), (2, "2", "75.00"), (3, "3", "N/A")]


def test_headerless(spark, tmp_path):
    (tmp_path / "a.hl7").write_text("PID|1\nOBX|2|x\n")
    src = text.TextSource(str(tmp_path), suffix=".hl7", delimiter="|", header_line=0, width=3)
    df = text.scan(spark, src)
    assert rows(df, "_record_num", F.get("_fields", F.lit(0))) == [(1, "PID"), (2, "OBX")]


@pytest.mark.parametrize("enc", ["windows-1250", "ibm852", "iso-8859-10", "x-mac-cyrillic", "utf-8"])
def test_encodings(spark, tmp_path, enc):
    body = {"x-mac-cyrillic": "имя;город\nЖук;Москва\n"}.get(enc, "jméno;obec\r\nNováček;Lhota\r\n" if enc != "iso-8859-10" else "ä;å\nö;þ\n")
    (tmp_path / "a.csv").write_bytes(text.encode_text(body, enc))
    df = text.scan(spark, text.TextSource(str(tmp_path), delimiter=";", encoding=enc))
    want = [tuple(body.replace("\r", "").split("\n")[1].split(";"))]
    names = body.replace("\r", "").split("\n")[0].split(";")
    assert rows(df, *names) == want


def test_all_encodings_round_trip():
    for enc in text.ENCODINGS:
        assert text.decode_bytes(text.encode_text("abc?", enc), enc) == "abc?"
    assert text.encode_text("č€☃", "windows-1250") == b"\xe8\x80?"


def test_record_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("big", 5000), ("small", 300)):
        (tmp_path / f"{name}.csv").write_text("n,pad\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = text.scan(spark, text.TextSource(str(tmp_path)))
        assert df.rdd.getNumPartitions() > 5
        assert df.filter("try_cast(n as bigint) is distinct from _record_num").count() == 0
        assert df.count() == 5300
        plain = text.scan(spark, text.TextSource(str(tmp_path), record_numbers=False))
        assert plain.count() == 5300 and plain.filter("n = 'n'").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_normalise_decimal(spark):
    table = {
        "75,00": "75.00", "1234,56": "1234.56", "1.234,56": "1234.56", "-1.234.567,89": "-1234567.89",
        "1.234": "1234", "1.5": "1.5", "N/A": "N/A", "hello,world": "hello,world",
        "40,718807220458984": "40.718807220458984", "": "",
    }
    df = spark.createDataFrame([(k,) for k in table], "s string")
    assert {r[0]: r[1] for r in df.select("s", normalise_decimal(df.s, ",")).collect()} == table


def test_json_arrays(spark, tmp_path):
    a = '[{"a": 1.50, "b": "x", "n": {"k": 1}}, {"a": null, "c": true, "big": 12345678901234567890}, {"a": 1e3, "d": "007"}]'
    (tmp_path / "one.in.json").write_text(a)
    (tmp_path / "two.in.json").write_text(json.dumps([{"d": "only", "a": 7}]))
    df = json_array.scan(spark, json_array.JsonSource(str(tmp_path), ".in.json"))
    assert rows(df, *FIELDS, "a", "b", "n", "c", "d", "big") == [
        ("one.in.json", "one", 1, "1.5", "x", "", "", "", ""),
        ("one.in.json", "one", 2, "", "", "", "true", "", "12345678901234567890"),
        ("one.in.json", "one", 3, "1000", "", "", "", "007", ""),
        ("two.in.json", "two", 1, "7", "", "", "", "only", ""),
    ]


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("CSV/a.csv", "Kód;Obec\n1;Dolní\n2;Horní\n".encode("windows-1250"))
        z.writestr("CSV/b.csv", "Obec;Kód\nLhota;3\n".encode("windows-1250"))
        z.writestr("readme.txt", "no")
    t = text.TextSource("", delimiter=";", encoding="windows-1250")
    src = archive.ArchiveSource(str(tmp_path), ".csv", t)
    assert rows(archive.scan(spark, src), *FIELDS, "Kód", "Obec") == [
        ("a.csv", "a", 1, "1", "Dolní"), ("a.csv", "a", 2, "2", "Horní"), ("b.csv", "b", 1, "3", "Lhota"),
    ]
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("../evil.csv", "a\n1\n")
    with pytest.raises(ValueError):
        archive.scan(spark, src)


def make_workbook(path, sheets):
    """A minimal workbook: inline and shared strings, numbers, booleans, a date style."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        tabs = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>{tabs}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')  # fmt: skip
        for i, (_, data) in enumerate(sheets.items(), 1):
            out = []
            for r, cells in data:
                cs = []
                for j, c in enumerate(cells):
                    if c is None:
                        continue
                    ref = f'r="{chr(65 + j)}{r}"'
                    if isinstance(c, bool):
                        cs.append(f'<c {ref} t="b"><v>{int(c)}</v></c>')
                    elif isinstance(c, tuple):
                        cs.append(f'<c {ref} s="1"><v>{c[0]}</v></c>')
                    elif isinstance(c, (int, float)):
                        cs.append(f"<c {ref}><v>{c}</v></c>")
                    elif c.startswith("i:"):
                        cs.append(f'<c {ref} t="inlineStr"><is><t>{c[2:]}</t></is></c>')
                    elif c.startswith("#"):
                        cs.append(f'<c {ref} t="e"><v>{c}</v></c>')
                    else:
                        shared.append(c)
                        cs.append(f'<c {ref} t="s"><v>{len(shared) - 1}</v></c>')
                out.append(f'<row r="{r}">{"".join(cs)}</row>')
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{''.join(out)}</sheetData></worksheet>")
        si = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{si}</sst>")


def test_workbook(spark, tmp_path):
    make_workbook(tmp_path / "w.xlsx", {
        "Cash 2024": [(1, ["title"]), (2, [None, "id", "when", "ok", "v"]), (3, [None, 1, (25569.5,), True, 1.50]),
                      (5, [None, "i:two", None, False, "#N/A"])],
        "Other": [(1, ["x"])],
    })
    make_workbook(tmp_path / "none.xlsx", {"Other": [(1, ["x"])]})
    df = workbook.scan(spark, workbook.WorkbookSource(str(tmp_path), "Cash", header_row=2))
    assert rows(df, *FIELDS, "_sheet", "id", "when", "ok", "v") == [
        ("w.xlsx", "w", 1, "Cash", "1", "1970-01-01 12:00:00", "TRUE", "1.5"),
        ("w.xlsx", "w", 2, "Cash", "two", "", "FALSE", ""),
    ]
    assert workbook.serial_text(-1) is None and workbook.serial_text(1e308) is None
    assert workbook.number_text("1.5E-3") == "0.0015"


def test_array_files_grow_with_the_lines(spark):
    from sluicework.catalog.base import ARRAY_LINES, write_json_arrays

    n = 6 * ARRAY_LINES
    path = write_json_arrays(spark, spark.range(n).select(F.format_string('{"k": %d}', "id").alias("line")), "grow")
    read = json_array.scan(spark, json_array.JsonSource(path, ".txt"))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.size(F.split("value", ",\n")).alias("n")).collect()
    assert read.select("k").distinct().count() == n and len(files) == 6 and max(r.n for r in files) < 1.1 * ARRAY_LINES
