"""Audit tables and cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..audit.checks import duplicates, header_drift, ingest_checks
from ..operators.daterange import range_status
from ..operators.cleaning import clean_dates, clean_numbers, clean_text, map_codes, normalise_zones
from ..operators.lookup import Lookup
from ..plans.template import Rule, Template
from ..session import scratch_dir
from ..sources.text import TextSource
from .base import ACTIVITY_SQL, ITEMS_SQL, activity, clients, digits, items, query, sales, table
from .joins import log
from .routing import _ROUTED, SALES, _routes, fan_out, numbered_sales
from .scalars import _eu

f = fn.field
D = digits


@query("a_01_outcomes", SALES + """SELECT k + 1 AS rn, pos, rule, 'emit' AS action FROM (SELECT k, CASE status WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rule,
  unnest(CASE status WHEN 'F' THEN [0, 1, 2] WHEN 'P' THEN [0, 1] ELSE [0] END) AS pos FROM sales WHERE status IN ('F', 'P') OR prio = '5-LOW')""")
def _(spark, sf):
    out = fan_out().run(numbered_sales(spark, sf)).outcomes()
    return out.select(F.col("_record_num").alias("rn"), F.col("_emit_pos").alias("pos"), F.col("_rule").alias("rule"), "action")


def _routed_template():
    return Template("routes", {"id": f("k"), "kind": ""}, {"id": "id", "kind": "kind"}, _routes())


@query("a_02_filtered", SALES + f"SELECT k + 1 AS rn, CASE WHEN status = 'O' AND prio <> '1-URGENT' THEN 'rule_skip' ELSE 'no_rule_match' END AS reason FROM sales WHERE {_ROUTED} IS NULL")
def _(spark, sf):
    out = _routed_template().run(numbered_sales(spark, sf)).filtered()
    return out.select(F.col("_record_num").alias("rn"), F.col("_reason").alias("reason"))


@query("a_02_filtered_by_name", SALES + "SELECT CASE WHEN day NOT BETWEEN '1996-01-01' AND '1996-12-31' THEN 'date_filter_from_filename' ELSE 'no_rule_match' END AS reason, count(*) AS n FROM sales WHERE day NOT BETWEEN '1996-01-01' AND '1996-12-31' OR status <> 'F' GROUP BY 1")
def _(spark, sf):
    t = Template("x", {"id": f("k"), "date": f("day")}, {"id": "id", "date": "date"}, [Rule(f("status") == "F")], date_range="date")
    out = t.run(numbered_sales(spark, sf, stem="o_1996-01-01_1996-12-31")).filtered()
    return out.groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def failing():
    """Dates and amounts that do not parse on some rows, in variables and in overrides."""
    return Template(
        "failing", {"id": f("k"), "due": fn.dateadd(f("maybe"), 14), "half": f("total") / 2, "odd": f("prio") * 1},
        {n: n for n in ("id", "due", "half", "odd")},
        [Rule(f("status") == "F", [{"odd": fn.const("")}, {"odd": f("maybe") * 1}]), Rule(f("status") == "P", [{"odd": fn.const("0")}])],
    )


@query("a_03_errors", SALES + """SELECT k + 1 AS rn, 'due' AS variable, 'variable' AS origin FROM sales WHERE status IN ('F', 'P') AND maybe = 'soon'
  UNION ALL SELECT k + 1, 'odd', 'override' FROM sales WHERE status = 'F' AND maybe <> ''""")
def _(spark, sf):
    out = failing().run(numbered_sales(spark, sf)).errors()
    return out.select(F.col("_record_num").alias("rn"), "variable", "origin")


@query("a_04_lookup_dump", f"""WITH activity AS ({ACTIVITY_SQL}) SELECT rn, 'buy' AS block, "user" AS key, 'amount' AS field, {D('cents')} AS value FROM activity WHERE type = 'purchase'
  UNION ALL SELECT rn, 'buy', "user", 'at', ts FROM activity WHERE type = 'purchase'""")
def _(spark, sf):
    t = Template("dump", {"v": fn.lookup(f("user"), "amount")}, {"v": "v"}, [Rule()],
                 {"buy": Lookup(f("user"), {"amount": f("value"), "at": f("ts")}, f("type") == "purchase")})
    out = t.run(log(spark, sf)).lookup_dump()
    return out.select(F.col("_record_num").alias("rn"), "block", "key", "field", "value")


_COUNTS = """count(*) AS rows_in, sum(CASE status WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) AS rows_out,
  count(*) FILTER (WHERE status = 'O') AS no_rule_match, 0 AS rule_skip, 0 AS date_filtered,
  count(*) FILTER (WHERE status IN ('F', 'P') AND maybe = 'soon') AS errors"""


@query("g_02_counters", SALES + f"SELECT prio || '.csv' AS file, {_COUNTS} FROM sales GROUP BY 1")
def _(spark, sf):
    df = numbered_sales(spark, sf).withColumn("_file", F.concat("prio", F.lit(".csv")))
    out = failing().run(df).counters()
    return out.drop("template").withColumnRenamed("_file", "file")


@query("g_02_one_pass", SALES + f"SELECT prio || '.csv' AS file, {_COUNTS} FROM sales GROUP BY 1")
def _(spark, sf):
    df = numbered_sales(spark, sf).withColumn("_file", F.concat("prio", F.lit(".csv")))
    out = failing().run(df).audited().counters()
    return out.drop("template").withColumnRenamed("_file", "file")


@query("a_05_summary", SALES + f"""SELECT '{{"template":"failing","files":1,"rows_in":' || rows_in || ',"rows_out":' || rows_out || ',"no_rule_match":' || no_rule_match
  || ',"rule_skip":0,"date_filtered":0,"errors":' || errors || '}}' AS document FROM (SELECT {_COUNTS} FROM sales)""")
def _(spark, sf):
    return failing().run(numbered_sales(spark, sf)).summary().select("document")


@query("a_06_unmatched", SALES + "SELECT CAST(k AS VARCHAR) AS k, status, prio, maybe FROM sales WHERE status = 'P' AND prio NOT IN ('1-URGENT', '5-LOW')")
def _(spark, sf):
    return _routed_template().run(numbered_sales(spark, sf)).unmatched().select("k", "status", "prio", "maybe")


@query("a_07_ingest_checks", """SELECT count(*) AS rows, count(*) FILTER (WHERE (length(text) - length(replace(text, 'q', ''))) % 2 = 1) AS unbalanced_quotes,
    count(*) FILTER (WHERE contains(text, 'w')) AS invalid_utf8, 'id' AS dup, 'missing' AS date_range, false AS zero_rows, false AS too_many FROM documents""")
def _(spark, sf):
    """Whole texts, with a quote for each q and an ill-formed byte behind those that hold a w."""
    one_line = F.translate(F.translate(F.coalesce("text", F.lit("")), '"', ""), "q\n\r", '"  ')
    bad = F.when(F.contains("text", F.lit("w")), F.unhex(F.lit("FFFE")).cast("string")).otherwise(F.lit("ok"))
    docs = table(spark, sf, "documents")
    line = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), one_line, bad)
    path = write_lines(spark, docs.select(line.alias("line")), "id,a,id", "a07")
    out = ingest_checks(spark, TextSource(path, suffix=".txt"))
    return out.agg(
        F.sum("rows").alias("rows"), F.sum("unbalanced_quotes").alias("unbalanced_quotes"), F.sum("invalid_utf8").alias("invalid_utf8"),
        F.max(F.array_join("duplicate_headers", ",")).alias("dup"), F.max("date_range").alias("date_range"),
        F.max("zero_rows").alias("zero_rows"), F.max("too_many_columns").alias("too_many"),
    )


def write_lines(spark, df, header, label):
    """Parallel text files with a header line each, in the shared scratch folder."""
    path = scratch_dir(spark, label)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    both = F.when(first, F.array(F.lit(header), F.col("line"))).otherwise(F.array(F.col("line")))
    df.select(F.explode(both).alias("line")).write.text(path)
    return path


@query("a_07_date_range", """SELECT k, CASE WHEN k % 4 IN (0, 1) THEN 'ok' WHEN k % 4 = 2 THEN 'malformed' ELSE 'missing' END AS status FROM (SELECT o_orderkey AS k FROM orders)""")
def _(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")
    stem = F.when(k % 4 == 0, F.concat(F.lit("a_"), day, F.lit("_"), later, F.lit("_x"))).when(k % 4 == 1, F.concat(day, F.lit("_"), day)).when(
        k % 4 == 2, F.concat(later, F.lit("_"), day)
    ).otherwise(F.concat(day, F.lit("-"), later))
    return table(spark, sf, "orders").select(k.alias("k"), range_status(stem).alias("status"))


@query("a_08_header_drift", """WITH h AS (SELECT n_nationkey AS file, unnest(['Dat' || CASE WHEN n_nationkey % 3 = 0 THEN 'e' WHEN n_nationkey % 3 = 1 THEN 'um' ELSE '' END,
      'AMOUNT' || CASE WHEN n_nationkey % 2 = 0 THEN 's' ELSE '' END, n_name]) AS found FROM nation),
    e AS (SELECT unnest(['Date', 'Amount', 'NATION_7']) AS expected)
  SELECT CAST(file AS VARCHAR) AS file, expected, found FROM h, e
  WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.file = h.file AND x.found = expected)
    AND levenshtein(lower(found), lower(expected)) <= CASE WHEN length(expected) < 6 THEN 1 ELSE 2 END""")
def _(spark, sf):
    n = F.col("n_nationkey")
    heads = table(spark, sf, "nation").select(
        n.cast("string").alias("_path"),
        F.array(
            F.concat(F.lit("Dat"), F.when(n % 3 == 0, F.lit("e")).when(n % 3 == 1, F.lit("um")).otherwise(F.lit(""))),
            F.concat(F.lit("AMOUNT"), F.when(n % 2 == 0, F.lit("s")).otherwise(F.lit(""))),
            F.col("n_name"),
        ).alias("_header"),
    )
    return header_drift(heads, ["Date", "Amount", "NATION_7"]).withColumnRenamed("_path", "file")


@query("a_07_duplicate_headers", "SELECT p_partkey AS k, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 'red' ELSE '' END AS dup FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").withColumn("h", F.concat(F.split("p_name", " "), F.array(F.lit("red"), F.lit(""), F.lit(""))))
    return df.select(F.col("p_partkey").alias("k"), F.array_join(duplicates("h"), ",").alias("dup"))


# ---------------------------------------------------------------- cleaning jobs

_IT = f"WITH items AS ({ITEMS_SQL}) "


@query("c_01_clean_numbers", _IT + f"""SELECT k, ln, {D('cents')} AS us, {D('cents')} AS eu, {D('sc')} AS paren, {D('cents')} AS price,
  CASE WHEN flag = 'A' THEN {D('disc')} WHEN flag = 'N' THEN {D('tax')} WHEN disc >= 10 THEN {D('disc', 3)} ELSE {D('disc')} END AS rate, CASE WHEN ln IN (3, 4) THEN NULL WHEN ln = 5 THEN '0' ELSE {D('cents')} END AS dirty FROM items""")
def _(spark, sf):
    styles = {"us": "us", "eu": "eu", "paren": "parentheses", "price": "currency", "rate": "rate", "dirty": "us"}
    out = clean_numbers(items(spark, sf), styles).rows
    return out.select("k", "ln", *[fn.text(fn.Val(F.col(f"{c}_num"), "number")).alias(c) for c in styles])


@query("c_01_failures", _IT + "SELECT 'us_num' AS \"column\", count(*) AS filled, 0 AS failed FROM items UNION ALL SELECT 'dirty_num', count(*) FILTER (WHERE ln <> 4), count(*) FILTER (WHERE ln = 3) FROM items")
def _(spark, sf):
    return clean_numbers(items(spark, sf), {"us": "us", "dirty": "us"}).failures()


@query("c_02_clean_dates", SALES + """SELECT k, day AS dmy_iso, strftime(date_trunc('month', d), '%Y-%m-%d') AS dmy_month, CAST(isodow(d) AS VARCHAR) AS dmy_weekday,
  CASE WHEN maybe IN ('', 'soon') THEN '' ELSE day END AS maybe_iso,
  strftime(d + 14 - CASE WHEN isodow(d) >= 6 THEN CAST(isodow(d) - 5 AS INTEGER) ELSE 0 END, '%Y-%m-%d') AS dmy_due FROM sales""")
def _(spark, sf):
    out = clean_dates(sales(spark, sf), {"dmy": "DD.MM.YYYY", "maybe": "YYYY-MM-DD"}, workdays=10).rows
    return out.select("k", "dmy_iso", "dmy_month", "dmy_weekday", "maybe_iso", "dmy_due")


@query("c_03_normalise_zones", SALES + f"""SELECT k, strftime(t - CASE WHEN {_eu} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS ts_utc,
  CASE WHEN {_eu} THEN '+02:00' ELSE '+01:00' END AS ts_offset, CAST({_eu} AS VARCHAR) AS ts_dst FROM sales""")
def _(spark, sf):
    out = normalise_zones(sales(spark, sf), "ts", "Europe/Prague", "America/New_York").rows
    return out.select("k", "ts_utc", "ts_offset", "ts_dst")


@query("c_03_zone_column", f"""WITH activity AS ({ACTIVITY_SQL}) SELECT k, strftime(t - CASE WHEN k % 3 = 0 THEN INTERVAL 330 MINUTE WHEN k % 3 = 1 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc,
  CASE WHEN k % 3 = 2 THEN '' ELSE 'x' END AS known FROM activity WHERE k % 3 < 2 UNION ALL SELECT k, '', '' FROM activity WHERE k % 3 = 2""")
def _(spark, sf):
    z = F.when(F.col("k") % 3 == 0, F.lit("Asia/Kolkata")).when(F.col("k") % 3 == 1, F.lit("Asia/Tokyo")).otherwise(F.lit("Atlantis/Capital"))
    out = normalise_zones(activity(spark, sf).withColumn("zone", z), "ts", "$zone", "UTC").rows
    return out.select("k", F.col("ts_utc").alias("utc"), F.when(F.col("ts_offset") == "", F.lit("")).otherwise(F.lit("x")).alias("known"))


@query("c_04_clean_text", "SELECT doc_id AS k, strip_accents(replace(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 'ß', 'ss')) AS text_clean, regexp_replace(source, '[^0-9]+', '', 'g') AS source_clean, CASE lang WHEN 'none' THEN '' ELSE upper(lang) END AS lang_clean FROM documents")
def _(spark, sf):
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "text", "source", "lang")
    out = clean_text(df, {"text": ["trim", "lower", "unaccent"], "source": ["digits"], "lang": ["nulls", "upper"]}).rows
    return out.select("k", "text_clean", "source_clean", "lang_clean")


_MAPS = {"segment": {"AUTOMOBILE": "cars", "BUILDING": "bricks"}, "nation": {"1": "one"}}


@query("c_05_map_codes", "SELECT c_custkey AS k, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'BUILDING' THEN 'bricks' ELSE c_mktsegment END AS segment_label, CASE c_nationkey WHEN 1 THEN 'one' ELSE CAST(c_nationkey AS VARCHAR) END AS nation_label FROM customer")
def _(spark, sf):
    return map_codes(clients(spark, sf), _MAPS)[0].select("k", "segment_label", "nation_label")


@query("c_05_unmapped", "SELECT 'segment' AS \"column\", c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING') GROUP BY 2 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer WHERE c_nationkey <> 1 GROUP BY 2")
def _(spark, sf):
    return map_codes(clients(spark, sf), _MAPS)[1]
