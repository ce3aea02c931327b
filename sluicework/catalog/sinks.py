"""Outputs: cells, lines, roll-ups, per-file folders, incremental runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..plans.template import Rule, Template
from ..session import scratch_dir
from ..sinks.cells import CsvSpec, csv_cell, csv_line, encode_lines, json_line
from ..sinks.writers import write_csv, write_ordered, write_per_file
from ..sources import text
from ..streaming.incremental import convert_new, pending
from .base import ACTIVITY_SQL, ITEMS_SQL, PROSE_SQL, digits, items, prose, query, table
from .quality import write_lines
from .routing import _FAN, SALES, fan_out, numbered_sales

f = fn.field
D = digits


@query("k_02_csv_cells", f"""WITH prose AS ({PROSE_SQL}) SELECT k, replace(text, chr(10), '\\n') AS bare,
  CASE WHEN contains(text, chr(10)) OR contains(text, ',') OR contains(text, '"') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS quoted FROM prose""")
def _(spark, sf):
    df = prose(spark, sf)
    return df.select("k", csv_cell(F.col("text"), CsvSpec()).alias("bare"), csv_cell(F.col("text"), CsvSpec(quote="double")).alias("quoted"))


@query("k_02_csv_lines", f"WITH items AS ({ITEMS_SQL}) SELECT k || ';' || CASE WHEN cents < 100000 THEN replace(us, '.', ',') ELSE us END || ';' || replace(signed, '.', ',') || ';' || flag AS line FROM items")
def _(spark, sf):
    df = items(spark, sf)
    return df.select(csv_line(["k", "us", "signed", "flag"], CsvSpec(delimiter=";", decimal_separator=",")).alias("line"))


@query("k_03_formula_guard", """SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN '''=1+2' WHEN 1 THEN '-ISM, LLC' WHEN 2 THEN '''-SUM(A1)' WHEN 3 THEN '''+cmd|''/c''!A1' WHEN 4 THEN '-12.5'
  WHEN 5 THEN '''@x.y(1)' WHEN 6 THEN 'a=b' ELSE '+1 (two) ' || p_name END AS cell FROM part""")
def _(spark, sf):
    k = F.col("p_partkey") % 8
    raw = (
        F.when(k == 0, F.lit("=1+2")).when(k == 1, F.lit("-ISM, LLC")).when(k == 2, F.lit("-SUM(A1)")).when(k == 3, F.lit("+cmd|'/c'!A1"))
        .when(k == 4, F.lit("-12.5")).when(k == 5, F.lit("@x.y(1)")).when(k == 6, F.lit("a=b")).otherwise(F.concat(F.lit("+1 (two) "), "p_name"))
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), csv_cell(raw, CsvSpec()).alias("cell"))


@query("k_04_json_lines", f"WITH prose AS ({PROSE_SQL}) SELECT k, CAST(k AS VARCHAR) AS id, text, '' AS none FROM prose")
def _(spark, sf):
    df = prose(spark, sf).select("k", F.col("k").alias("id"), "text", F.lit(None).cast("string").alias("none"))
    line = df.select("k", json_line(["id", "text", "none"]).alias("line"))
    return line.select("k", F.from_json("line", "id string, text string, none string").alias("o")).select("k", "o.*")


@query("k_04_json_array", _FAN)
def _(spark, sf):
    path = scratch_dir(spark, "k04")
    write_ordered(fan_out().run(numbered_sales(spark, sf)).output(with_order=True), path, None)
    body = spark.read.text(path).filter("value NOT IN ('[', ']')")
    obj = F.from_json(F.ltrim("value", F.lit(",")), "id string, date string, action string, amount string")
    return body.select(obj.alias("o")).select("o.*")


@query("k_05_code_page", f"WITH prose AS ({PROSE_SQL}) SELECT k, strlen(text) AS utf8_bytes, length(text) AS bytes FROM prose")
def _(spark, sf):
    df = prose(spark, sf).select("k", "text", F.col("text").alias("line"))
    return encode_lines(spark, df, "windows-1252").select("k", F.octet_length("text").alias("utf8_bytes"), F.octet_length(F.col("line").cast("binary")).alias("bytes"))


@query("k_01_per_file", SALES + "SELECT prio AS stem, CAST(k AS VARCHAR) || ',' || status AS line FROM sales UNION ALL SELECT DISTINCT prio, 'id,status' FROM sales")
def _(spark, sf):
    df = numbered_sales(spark, sf).withColumns({"_file": F.concat("prio", F.lit(".csv")), "_stem": F.col("prio")})
    t = Template("k_01", {"id": f("k"), "status": f("status")}, {"id": "id", "status": "status"})
    path = scratch_dir(spark, "k01")
    write_per_file(t.run(df).output(with_order=True), path)
    return spark.read.text(path).select(F.col("_stem").alias("stem"), F.col("value").alias("line"))


@query("u_01_combined", SALES + "SELECT CAST(k AS VARCHAR) || ',' || status AS line FROM sales UNION ALL SELECT 'id,status'")
def _(spark, sf):
    df = numbered_sales(spark, sf).withColumn("_file", F.concat("prio", F.lit(".csv")))
    t = Template("u_01", {"id": f("k"), "status": f("status")}, {"id": "id", "status": "status"})
    path = scratch_dir(spark, "u01")
    write_ordered(t.run(df).output(with_order=True), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("o_01_order", SALES + "SELECT line, row_number() OVER (ORDER BY h, prio, k) AS n FROM (SELECT CAST(k AS VARCHAR) || ',' || prio AS line, prio, k, 1 AS h FROM sales UNION ALL SELECT 'id,prio', '', 0, 0)")
def _(spark, sf):
    df = numbered_sales(spark, sf).withColumn("_file", F.concat("prio", F.lit(".csv")))
    t = Template("o_01", {"id": f("k"), "prio": f("prio")}, {"id": "id", "prio": "prio"})
    path = scratch_dir(spark, "o01")
    write_ordered(t.run(df).output(with_order=True), path)
    rows = text.lines(spark, path, ".txt")
    parts = rows.groupBy("_file").agg(F.count("*").alias("c"))  # one row per part file
    before = F.coalesce(F.sum("c").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_file", before.alias("b"))
    return rows.join(starts, "_file").select(F.col("value").alias("line"), (F.col("_line") + F.col("b")).alias("n"))


@query("k_06_incremental", f"""WITH activity AS ({ACTIVITY_SQL})
  SELECT CAST(k AS VARCHAR) AS id, type, {D('cents')} AS amount, 2 AS batches FROM activity WHERE type <> 'view'""")
def _(spark, sf):
    """Two arrivals of files, three runs: the third finds nothing to do."""
    from .base import activity

    a = activity(spark, sf).select(F.col("k").alias("k"), F.concat_ws(",", F.col("k").cast("string"), "type", "value").alias("line"))
    first, out, ck = write_lines(spark, a.filter("k % 2 = 0").select("line"), "id,type,amount", "k06"), scratch_dir(spark, "k06o"), scratch_dir(spark, "k06c")
    t = Template("inc", {"id": f("id"), "type": f("type"), "amount": f("amount")}, {n: n for n in ("id", "type", "amount")}, [Rule(f("type") != "view")])
    src = text.TextSource(first, suffix=".txt")
    runs = convert_new(spark, t, src, out, ck)
    top = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    more = a.filter("k % 2 = 1").select(F.explode(F.when(top, F.array(F.lit("id,type,amount"), F.col("line"))).otherwise(F.array("line"))).alias("line"))
    more.write.mode("append").text(first)
    runs += convert_new(spark, t, src, out, ck)
    runs += convert_new(spark, t, src, out, ck)
    rows = spark.read.option("recursiveFileLookup", "true").text(out).filter("value <> 'id,type,amount'")
    parts = F.split("value", ",")
    return rows.select(parts[0].alias("id"), parts[1].alias("type"), parts[2].alias("amount"), F.lit(runs).alias("batches"))


@query("k_06_pending", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 2 = 1")
def _(spark, sf):
    """Files that arrive after others were finished are the ones left to convert, and hold just their rows."""
    path, orders = scratch_dir(spark, "k06p"), table(spark, sf, "orders").select("o_orderkey")
    src = text.TextSource(path, suffix=".txt")
    write_csv(orders.filter("o_orderkey % 2 = 0"), path)
    done = written_stems(spark, pending(spark, src, spark.createDataFrame([], "_stem string")))
    write_csv(orders.filter("o_orderkey % 2 = 1"), path, mode="append")
    left = pending(spark, src, done).select("_stem")
    rows = text.scan(spark, src)
    return rows.join(left, "_stem", "left_semi").select(F.col("o_orderkey").alias("id"))


def written_stems(spark, files):
    """The stems as they are now: a list of files is lazy and would see later ones."""
    path = scratch_dir(spark, "stems")
    files.select("_stem").write.parquet(path)
    return spark.read.parquet(path)


