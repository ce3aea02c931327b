"""Scans: driver tables written out as exports and read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators.reshape import union_all
from ..plans.template import Rule, Template
from ..session import scratch_dir
from ..sinks.cells import CsvSpec, csv_line, encode_lines
from ..sinks.writers import write_csv
from ..sources import archive, json_array, text, workbook
from .base import ACTIVITY_SQL, CLIENTS_SQL, GOODS_SQL, ITEMS_SQL, activity, clients, digits, goods, items, query, table, write_json_arrays
from .quality import write_lines

f = fn.field
D = digits
_ROW = (1 << 33) - 1


def save(path: str, body: bytes) -> None:
    """Write one whole file from a task."""
    from urllib.parse import urlparse

    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        system, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as out:
        out.write(body)


def export(spark, df, label, make, ext):
    """Container files of one batch of rows each, named by task and batch so a retry overwrites itself."""
    path = scratch_dir(spark, label)

    def write(batches):
        task = TaskContext.get().partitionId()
        for i, pdf in enumerate(batches):
            if len(pdf):
                save(f"{path}/part-{task:05d}-{i:05d}{ext}", make(pdf))
                yield pd.DataFrame({"n": [len(pdf)]})

    df.repartition(spark.sparkContext.defaultParallelism).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


@query("s_01_delimited", "SELECT doc_id AS id, trim(replace(text, chr(10), '\\n'), ' ') AS text, lang FROM documents")
def _(spark, sf):
    path = scratch_dir(spark, "s01")
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.translate("text", "\n", "\u0001").alias("text"), "lang")
    df = df.withColumn("text", F.replace("text", F.lit("\u0001"), F.lit("\\n")))
    write_csv(df, path, CsvSpec(quote="double"))
    out = text.scan(spark, text.TextSource(path, suffix=".txt", record_numbers=False))
    return out.select(F.col("id").cast("bigint").alias("id"), "text", "lang")


@query("s_01_pipe_eu_decimals", f"WITH items AS ({ITEMS_SQL}) SELECT k, ln, plain AS amount, price FROM items")
def _(spark, sf):
    df = items(spark, sf).select(F.concat_ws("|", F.col("k").cast("string"), F.col("ln").cast("string"), "eu", "price").alias("line"))
    path = write_lines(spark, df, "k|ln| amount |price", "s01b")
    src = text.TextSource(path, suffix=".txt", delimiter="|", quote="none", decimal_separator=",", record_numbers=False, columns=("k", "ln", "amount", "price"))
    return text.scan(spark, src).select(F.col("k").cast("bigint").alias("k"), F.col("ln").cast("int").alias("ln"), "amount", "price")


@query("s_02_header_line", f"WITH goods AS ({GOODS_SQL}) SELECT CAST(k AS VARCHAR) AS id, name FROM goods")
def _(spark, sf):
    df = goods(spark, sf).select(F.concat_ws(";", F.col("k").cast("string"), "name").alias("line"))
    path = write_lines(spark, df, "exported by shop\n\nid;name", "s02")
    return text.scan(spark, text.TextSource(path, suffix=".txt", delimiter=";", header_line=3)).select("id", "name")


@query("s_02_headerless", f"WITH goods AS ({GOODS_SQL}) SELECT CAST(k AS VARCHAR) AS id, name FROM goods")
def _(spark, sf):
    path = scratch_dir(spark, "s02b")
    goods(spark, sf).select(F.concat_ws("|", F.lit("PID"), F.col("k").cast("string"), "name").alias("line")).write.text(path)
    df = text.scan(spark, text.TextSource(path, suffix=".txt", delimiter="|", header_line=0, width=3))
    t = Template("s_02", {"id": fn.fields(2), "name": fn.fields(3)}, {"id": "id", "name": "name"}, [Rule(fn.fields(1) == "PID")])
    return t.run(df).output()


def _encoded(spark, sf, encoding):
    path = scratch_dir(spark, "s03")
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\\n")).alias("text"))
    lines = df.select(csv_line(["id", "text"], CsvSpec(delimiter="\t")).alias("line"))
    encode_lines(spark, lines, encoding).write.text(path)
    src = text.TextSource(path, suffix=".txt", delimiter="\t", quote="none", header_line=0, width=2, encoding=encoding, record_numbers=False)
    out = text.scan(spark, src)
    return out.select(F.get("_fields", F.lit(0)).cast("bigint").alias("id"), F.get("_fields", F.lit(1)).alias("text"))


_WHOLE = "SELECT doc_id AS id, replace(text, chr(10), '\\n') AS text FROM documents"
_LATIN = "SELECT doc_id AS id, regexp_replace(replace(text, chr(10), '\\n'), '[^\\x{00}-\\x{FF}]', '?', 'g') AS text FROM documents"


@query("s_03_windows_1252", _WHOLE)
def _(spark, sf):
    return _encoded(spark, sf, "windows-1252")


@query("s_03_latin_1", _LATIN)
def _(spark, sf):
    return _encoded(spark, sf, "iso-8859-1")


@query("s_04_json_arrays", f"""WITH activity AS ({ACTIVITY_SQL}) SELECT CAST(k AS VARCHAR) AS id, {D('cents')} AS amount, CASE WHEN type = 'error' THEN '' ELSE type END AS type,
  CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS even, '' AS nested, CASE WHEN k % 3 = 0 THEN "user" ELSE '' END AS who FROM activity""")
def _(spark, sf):
    a = activity(spark, sf)
    k = F.col("k")
    one = F.concat(
        F.lit('{"id": '), k.cast("string"), F.lit(', "amount": '), F.col("value"), F.lit(', "type": '),
        F.when(F.col("type") == "error", F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("type"), F.lit('"'))),
        F.lit(', "even": '), (k % 2 == 0).cast("string"), F.lit(', "nested": '), F.col("props"),
        F.when(k % 3 == 0, F.concat(F.lit(', "who": "'), F.col("user"), F.lit('"'))).otherwise(F.lit("")), F.lit("}"),
    )
    path = write_json_arrays(spark, a.select(one.alias("line")), "s04", '5, "x", null, [1], ')
    df = json_array.scan(spark, json_array.JsonSource(path, ".txt"))
    return df.select("id", "amount", "type", "even", "nested", "who")


@query("s_05_zip", f"WITH clients AS ({CLIENTS_SQL}) SELECT k AS id, name, {D('cents')} AS balance FROM clients")
def _(spark, sf):
    df = clients(spark, sf).select("k", "name", F.format_string("%d.%02d", F.floor(F.abs("cents") / 100), F.abs("cents") % 100).alias("b"), "cents")
    df = df.select("k", "name", F.concat(F.when(F.col("cents") < 0, F.lit("-")).otherwise(F.lit("")), "b").alias("b"))

    def make(pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            tag, half = pdf["k"].iloc[0], len(pdf) // 2
            for n, part, head in ((0, pdf[:half], "Číslo;Jméno;Zůstatek"), (1, pdf[half:], "Jméno;Číslo;Zůstatek")):
                rows = zip(part["k"], part["name"], part["b"]) if n == 0 else zip(part["name"], part["k"], part["b"])
                body = head + "\n" + "".join(";".join(map(str, r)) + "\n" for r in rows)
                z.writestr(f"CSV/p{tag}_{n}.csv", body.encode("windows-1250"))
            z.writestr("about.txt", "not a table")
        return out.getvalue()

    path = export(spark, df, "s05", make, ".zip")
    src = archive.ArchiveSource(path, ".csv", text.TextSource("", delimiter=";", encoding="windows-1250"))
    t = Template("s_05", {"id": f("Číslo"), "name": f("Jméno"), "balance": f("Zůstatek")}, {"id": "id", "name": "name", "balance": "balance"})
    return t.run(archive.scan(spark, src)).output().withColumn("id", F.col("id").cast("bigint"))


_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_workbook(columns, kinds):
    """A function that packs rows into a minimal one-sheet workbook."""

    def cells(kind, letter, numbers, values):
        if kind == "text":
            return [f'<c r="{letter}{n}" t="inlineStr"><is><t>{escape(v) if "&" in v or "<" in v or ">" in v else v}</t></is></c>' for n, v in zip(numbers, map(str, values))]
        if kind == "bool":
            return [f'<c r="{letter}{n}" t="b"><v>{int(v)}</v></c>' for n, v in zip(numbers, values)]
        style = ' s="1"' if kind == "date" else ""
        return [f'<c r="{letter}{n}"{style}><v>{v}</v></c>' for n, v in zip(numbers, values)]

    def make(pdf):
        letters, numbers = [chr(66 + i) for i in range(len(columns))], range(3, len(pdf) + 3)
        rows = ["<row r=\"2\">" + "".join(cells("text", a, [2], [c])[0] for a, c in zip(letters, columns)) + "</row>"]
        made = zip(*[cells(k, a, numbers, c.tolist()) for k, a, (_, c) in zip(kinds, letters, pdf.items())])
        rows += [f'<row r="{n}">{"".join(r)}</row>' for n, r in zip(numbers, made)]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook {_NS} {_REL}><sheets><sheet name="Cash Operations 2024" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'<styleSheet {_NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}><sheetData>{''.join(rows)}</sheetData></worksheet>")
        return out.getvalue()

    return make


@query("s_06_workbook", f"""WITH items AS ({ITEMS_SQL}) SELECT CAST(k AS VARCHAR) AS id, flag, {D('cents')} AS amount, ship || ' 12:00:00' AS shipped, CASE WHEN status = 'O' THEN 'TRUE' ELSE 'FALSE' END AS open,
  'Cash' AS sheet FROM items""")
def _(spark, sf):
    serial = F.date_diff(F.col("ship").cast("date"), F.lit("1899-12-30").cast("date")) + F.lit(0.5)
    df = items(spark, sf).select("k", "flag", F.concat("plain", F.lit("00")).alias("a"), serial.alias("s"), (F.col("status") == "O").alias("o"))
    path = export(spark, df, "s06", make_workbook(["id", "flag", "amount", "shipped", "open"], ["num", "text", "num", "date", "bool"]), ".xlsx")
    out = workbook.scan(spark, workbook.WorkbookSource(path, "Cash", header_row=2))
    return out.select("id", "flag", "amount", "shipped", "open", F.col("_sheet").alias("sheet"))


@query("s_07_fan_in", "SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents")
def _(spark, sf):
    """Files of many folders in one scan; a row's language is told by its file's path alone."""
    path = scratch_dir(spark, "s07")
    table(spark, sf, "documents").select("lang", F.col("doc_id").cast("string").alias("line")).write.partitionBy("lang").text(path)
    out = text.lines(spark, f"{path}/*", ".txt", record_numbers=False)
    lang = F.nullif(F.url_decode(F.regexp_extract("_path", "/lang=([^/]*)/", 1)), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return out.select(F.col("value").alias("id"), lang.alias("lang"))


@query("s_08_record_numbers", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'right' AS state FROM orders")
def _(spark, sf):
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)) + 1
    df = table(spark, sf, "orders").repartition(5).select("o_orderkey", seq.alias("seq"))
    path = write_lines(spark, df.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("seq").cast("string")).alias("line")), "id,seq", "s08")
    out = text.scan(spark, text.TextSource(path, suffix=".txt"))
    state = F.when(F.col("_record_num") == F.col("seq").cast("bigint"), F.lit("right")).otherwise(F.lit("wrong"))
    return out.select("id", state.alias("state"))


@query("f_record_num", "SELECT CAST(o_orderkey AS VARCHAR) AS id, '0' AS off FROM orders")
def _(spark, sf):
    """Every line holds the number it was written under; the template takes the difference."""
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)) + 1
    df = table(spark, sf, "orders").repartition(3).select("o_orderkey", seq.alias("seq"))
    path = write_lines(spark, df.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("seq").cast("string")).alias("line")), "id,seq", "frn")
    t = Template("rn", {"id": f("id"), "off": fn.record_num() - f("seq")}, {"id": "id", "off": "off"})
    return t.run(text.scan(spark, text.TextSource(path, suffix=".txt"))).output()


@query("s_09_file_name", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'yes' AS ok FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("line"))
    path = write_lines(spark, df, "id", "s09")
    out = text.scan(spark, text.TextSource(path, suffix=".txt"))
    t = Template("fn", {"id": f("id"), "stem": fn.filename()}, {"id": "id", "stem": "stem"})
    rows = t.run(out).output()
    return rows.select("id", F.when(F.col("stem").startswith("part-") & ~F.col("stem").endswith(".txt"), F.lit("yes")).otherwise(F.lit("no")).alias("ok"))




@query("s_10_sheet_name", f"WITH goods AS ({GOODS_SQL}) SELECT CAST(k AS VARCHAR) AS id, 'Cash' AS sheet, '' AS other FROM goods")
def _(spark, sf):
    df = goods(spark, sf).select("k", "name")
    path = export(spark, df, "s10", make_workbook(["id", "name"], ["num", "text"]), ".xlsx")
    t = Template("sn", {"id": f("id"), "sheet": fn.sheet_name(), "other": f("no")}, {"id": "id", "sheet": "sheet", "other": "other"})
    return t.run(workbook.scan(spark, workbook.WorkbookSource(path, "Cash", header_row=2))).output()


@query("p_05_duplicate_headers", f"WITH goods AS ({GOODS_SQL}) SELECT CAST(k AS VARCHAR) AS id, brand AS last, name AS first FROM goods")
def _(spark, sf):
    df = goods(spark, sf).select(F.concat_ws(",", F.col("k").cast("string"), "name", "brand").alias("line"))
    path = write_lines(spark, df, "id,x,x", "p05")
    t = Template("dup", {"id": f("id"), "last": f("x"), "first": fn.fields(2)}, {"id": "id", "last": "last", "first": "first"})
    return t.run(text.scan(spark, text.TextSource(path, suffix=".txt"))).output()


@query("s_01_mixed_headers", f"WITH goods AS ({GOODS_SQL}) SELECT CAST(k AS VARCHAR) AS id, name, CASE WHEN k % 2 = 0 THEN brand ELSE '' END AS brand FROM goods")
def _(spark, sf):
    """Files whose headers differ in order and columns, read in one scan."""
    g = goods(spark, sf)
    even = g.filter("k % 2 = 0").select(F.concat_ws(",", F.col("k").cast("string"), "name", "brand").alias("line"))
    odd = g.filter("k % 2 = 1").select(F.concat_ws(",", "name", F.col("k").cast("string")).alias("line"))
    a = write_lines(spark, even, "id,name,brand", "mix")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)) == 0
    odd.select(F.explode(F.when(first, F.array(F.lit("name,id"), F.col("line"))).otherwise(F.array("line"))).alias("line")).write.mode("append").text(a)
    return text.scan(spark, text.TextSource(a, suffix=".txt")).select("id", "name", "brand")


@query("u_02_mixed_formats", f"WITH activity AS ({ACTIVITY_SQL}) SELECT CAST(k AS VARCHAR) AS id, day AS date, {D('cents')} AS amount FROM activity")
def _(spark, sf):
    a = activity(spark, sf)
    odd = a.filter("k % 2 = 1").select(
        F.to_json(F.struct(F.col("k").alias("order_id"), F.replace("ts", F.lit(" "), F.lit("T")).alias("ts"), F.col("value").alias("total"))).alias("line")
    )
    csv = write_lines(spark, a.filter("k % 2 = 0").select(F.concat_ws(";", F.col("k").cast("string"), F.date_format(F.col("ts").cast("timestamp"), "dd.MM.yyyy"), F.translate("value", ".", ",")).alias("line")), "id;date;amount", "u02")
    js = write_json_arrays(spark, odd, "u02j")
    names = {n: n for n in ("id", "date", "amount")}
    old = Template("old", {"id": f("id"), "date": fn.date_convert(f("date"), "DD.MM.YYYY", "YYYY-MM-DD"), "amount": fn.replace(f("amount"), " ", "", ",", ".") * 1}, names)
    new = Template("new", {"id": f("order_id"), "date": fn.date_convert(f("ts"), "YYYY-MM-DDThh:mm:ss", "YYYY-MM-DD"), "amount": f("total") * 1}, names)
    return union_all(
        old.run(text.scan(spark, text.TextSource(csv, suffix=".txt", delimiter=";"))).output(),
        new.run(json_array.scan(spark, json_array.JsonSource(js, ".txt"))).output(),
    )


@query("f_fields", f"WITH goods AS ({GOODS_SQL}) SELECT CAST(k AS VARCHAR) AS id, name, brand AS third, CASE WHEN k % 3 = 0 THEN type ELSE '' END AS fourth, '' AS none FROM goods")
def _(spark, sf):
    """Fields beyond the header, with and without quotes, trimmed like named ones."""
    q = F.lit('"')
    name = F.when(F.col("k") % 2 == 0, F.concat(q, "name", q)).otherwise(F.col("name"))
    more = F.when(F.col("k") % 3 == 0, F.concat(F.lit(","), q, "type", q)).otherwise(F.lit(""))
    df = goods(spark, sf).select(F.concat(F.col("k").cast("string"), F.lit(","), name, F.lit(",  "), "brand", F.lit(" "), more).alias("line"))
    path = write_lines(spark, df, "id,name", "ffl")
    t = Template("ff", {"id": f("id"), "name": fn.fields(2), "third": fn.fields(3), "fourth": fn.fields(4), "none": fn.fields(9)}, {n: n for n in ("id", "name", "third", "fourth", "none")})
    halves = [text.scan(spark, text.TextSource(path, suffix=".txt", record_numbers=numbers)).filter(F.col("id").cast("long") % 4 == F.lit(0) if numbers else F.col("id").cast("long") % 4 != F.lit(0)) for numbers in (True, False)]
    return union_all(*[t.run(half).output() for half in halves])
