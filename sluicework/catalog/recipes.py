"""End-to-end table jobs on exports derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators.provenance import with_provenance
from ..operators.reshape import union_all
from ..plans import recipes as r
from ..plans.template import Lookup, Rule, Template
from ..session import scratch_dir
from ..sinks.writers import write_json_lines, write_ordered, write_per_file
from ..sources import archive, json_array, text, workbook
from . import joins, routing, sources
from .base import (
    write_json_arrays,
    ACTIVITY_SQL, CLIENTS_SQL, GOODS_SQL, ITEMS_SQL, QUERIES, ORACLES, activity, clients, digits, goods, items, query, sales, table,
)
from .quality import write_lines
from .routing import SALES, numbered_sales
from .scalars import _eu

f = fn.field
D = digits
IT = f"WITH items AS ({ITEMS_SQL}) "
ACT = f"WITH activity AS ({ACTIVITY_SQL}) "
GOODS = f"WITH goods AS ({GOODS_SQL}) "
CLIENTS = f"WITH clients AS ({CLIENTS_SQL}) "


def pick(index, *texts):
    """A text by row number, cycling."""
    return F.get(F.array(*[F.lit(t) for t in texts]), (index % len(texts)).cast("int"))


def sql_pick(index: str, *texts: str) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + f"][CAST({index} % {len(texts)} AS INTEGER) + 1]"


def rows(df, order="k"):
    return with_provenance(df, "export.csv", F.col(order) + 1 if order else None, "export")


def csv_source(spark, df, columns, label, delimiter=",", **options):
    """Write columns as delimited text and scan them back."""
    line = F.concat_ws(delimiter, *[F.col(c).cast("string") for c in columns])
    path = write_lines(spark, df.select(line.alias("line")), delimiter.join(options.pop("header", columns)), label)
    return text.scan(spark, text.TextSource(path, suffix=".txt", delimiter=delimiter, **options))


_NULLS = ("NULL", "NA", " N/A ", "n/a", "None", "none", "-", "x@y.z", " kept ", "")


@query("r_01_null_spellings", SALES + f"SELECT CAST(k AS VARCHAR) AS k, CASE WHEN k % 10 = 7 THEN 'x@y.z' WHEN k % 10 = 8 THEN 'kept' ELSE '' END AS email, prio AS notes FROM sales")
def _(spark, sf):
    df = sales(spark, sf).select("k", pick(F.col("k"), *_NULLS).alias("email"), F.col("prio").alias("notes"))
    return r.null_spellings(["email", "notes"], ["k"]).run(rows(df)).output()


@query("r_02_space_thousands", IT + f"SELECT CAST(k AS VARCHAR) AS k, {D('cents')} AS amount FROM items")
def _(spark, sf):
    df = items(spark, sf).select("k", F.translate("us", ",.", " ,").alias("value"))
    return r.styled_number("value", "space", keep=["k"]).run(rows(df)).output()


@query("r_03_zones", SALES + f"""SELECT CAST(k AS VARCHAR) AS k, strftime(t - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS utc,
  CASE WHEN k % 2 = 0 THEN CASE WHEN {_eu} THEN '+02:00' ELSE '+01:00' END ELSE '+05:30' END AS "offset",
  CASE WHEN k % 2 = 0 THEN CAST({_eu} AS VARCHAR) ELSE 'false' END AS dst,
  strftime(t - CASE WHEN k % 2 = 1 THEN INTERVAL 330 MINUTE WHEN {_eu} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS there FROM sales""")
def _(spark, sf):
    df = sales(spark, sf).select(
        "k", "ts", F.concat(F.replace("ts", F.lit(" "), F.lit("T")), F.lit("+01:30")).alias("iso"),
        pick(F.col("k"), "Europe/Prague", "Asia/Kolkata").alias("zone"),
    )
    return r.zone_report("ts", "iso", "zone", "Asia/Tokyo", ["k"]).run(rows(df)).output()


@query("r_04_units", GOODS + "SELECT CAST(k AS VARCHAR) AS k, CASE WHEN k % 5 = 0 THEN '' ELSE size END AS amount, CASE WHEN k % 5 = 0 THEN '' ELSE type END AS unit FROM goods")
def _(spark, sf):
    m = F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.concat("size", F.lit(".0 "), "type"))
    return r.number_and_unit("measure", ["k"]).run(rows(goods(spark, sf).select("k", m.alias("measure")))).output()


@query("r_05_parentheses", IT + f"SELECT CAST(k AS VARCHAR) AS k, {D('sc')} AS amount FROM items")
def _(spark, sf):
    return r.styled_number("paren", "parentheses", keep=["k"]).run(rows(items(spark, sf).select("k", "paren"))).output()


_BOOLS = ("yes", " Y ", "1", "TRUE", "t", "No", "n", "0", "false", "F", "", "maybe")


@query("r_06_booleans", SALES + "SELECT CAST(k AS VARCHAR) AS k, CASE WHEN k % 12 < 5 THEN 'true' WHEN k % 12 < 10 THEN 'false' ELSE '' END AS active FROM sales")
def _(spark, sf):
    df = sales(spark, sf).select("k", pick(F.col("k"), *_BOOLS).alias("active"))
    return r.boolean_spellings(["active"], ["k"]).run(rows(df)).output()


@query("r_07_fan_in", IT + f"SELECT ship AS date, flag AS store, {D('cents')} AS amount FROM items")
def _(spark, sf):
    df = items(spark, sf).select(F.col("ship").alias("date"), F.col("flag").alias("store"), F.translate("us", ",.", " ,").alias("gross"))
    t = r.plain("fan_in", {"date": f("date"), "store": f("store"), "amount": fn.replace(f("gross"), " ", "", ",", ".") * 1})
    return t.run(csv_source(spark, df, ["date", "store", "gross"], "r07", ";")).output()


@query("r_08_crm_mapping", CLIENTS + f"""SELECT name AS "LastName", CASE WHEN k % 3 = 0 THEN '<missing>' ELSE segment END AS "Company",
  CASE segment WHEN 'AUTOMOBILE' THEN 'Automotive' WHEN 'BUILDING' THEN 'Construction' ELSE segment END AS "Industry",
  CASE {sql_pick('k', 'New', 'Open', 'closed-won', 'odd')} WHEN 'New' THEN 'Open - Not Contacted' WHEN 'Open' THEN 'Working' WHEN 'closed-won' THEN 'Converted' ELSE 'Open - Not Contacted' END AS "Status",
  '2024-03-05T07:08:09Z' AS "CreatedDate" FROM clients""")
def _(spark, sf):
    k = F.col("k")
    df = clients(spark, sf).select(
        "k", F.concat(F.lit(" "), "name", F.lit(" ")).alias("Last Name"), F.when(k % 3 == 0, F.lit("  ")).otherwise(F.col("segment")).alias("Company Name"),
        F.col("segment").alias("Industry"), pick(k, "New", "Open", "closed-won", "odd").alias("Lead Status"),
        pick(k, "3/5/2024 07:08:09", "2024-03-05 07:08:09").alias("Create Date"),
    )
    made = f("Create Date")
    out = "YYYY-MM-DD[T]hh:mm:ss[Z]"
    t = r.plain("crm", {
        "LastName": fn.trim(f("Last Name")),
        "Company": fn.coalesce(fn.trim(f("Company Name")), "<missing>"),
        "Industry": fn.remap(fn.trim(f("Industry")), {"AUTOMOBILE": "Automotive", "BUILDING": "Construction"}),
        "Status": fn.case(fn.trim(f("Lead Status")), "New", "Open - Not Contacted", "Open", "Working", "closed-won", "Converted", "Open - Not Contacted"),
        "CreatedDate": fn.if_(fn.contains(made, "/"), fn.date_convert(made, "M/D/YYYY hh:mm:ss", out), fn.date_convert(made, "YYYY-MM-DD hh:mm:ss", out)),
    })
    return t.run(rows(df)).output()


def json_source(spark, df, label, **options):
    return json_array.scan(spark, json_array.JsonSource(write_json_arrays(spark, df, label), ".txt", **options))


@query("r_09_json_union", CLIENTS + "SELECT name AS company, CASE WHEN k % 2 = 0 THEN 'CZ' || k ELSE '' END AS vat, nation AS email, CASE WHEN k % 2 = 1 THEN '+420 ' || k ELSE '' END AS phone FROM clients")
def _(spark, sf):
    k = F.col("k").cast("string")
    body = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.col("name").alias("company"), F.concat(F.lit("CZ"), k).alias("vat"), F.col("nation").alias("email")))).otherwise(
        F.to_json(F.struct(F.col("name").alias("company"), F.concat(F.lit("+420 "), k).alias("phone"), F.col("nation").alias("email")))
    )
    src = json_source(spark, clients(spark, sf).select(body.alias("line")), "r09")
    return r.plain("json_union", {c: f(c) for c in ("company", "vat", "email", "phone")}).run(src).output()


@query("r_10_rates", IT + f"SELECT CAST(k AS VARCHAR) AS k, CASE WHEN flag = 'A' THEN {D('disc')} WHEN flag = 'N' THEN {D('tax')} WHEN disc >= 10 THEN {D('disc', 3)} ELSE {D('disc')} END AS rate_fraction FROM items")
def _(spark, sf):
    return r.styled_number("rate", "rate", "rate_fraction", ["k"]).run(rows(items(spark, sf).select("k", "rate"))).output()


@query("r_11_prices", IT + f"SELECT CAST(k AS VARCHAR) AS k, CASE WHEN ln = 4 THEN '' ELSE {D('cents')} END AS price, CASE WHEN ln = 4 THEN '' WHEN status = 'O' THEN 'USD' ELSE 'EUR' END AS currency FROM items")
def _(spark, sf):
    p = F.when(F.col("ln") == 4, F.lit("")).otherwise(F.col("price"))
    return r.price_and_currency("p", ["k"]).run(rows(items(spark, sf).select("k", p.alias("p")))).output()


_MEMO_SQL = SALES + """SELECT CAST(k AS VARCHAR) AS k, CASE WHEN k % 3 < 2 THEN substr(day, 1, 4) || '-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') ELSE '' END AS invoice,
  CASE WHEN k % 3 = 1 THEN CAST(k AS VARCHAR) ELSE '' END AS order_ref, CAST(k % 3 < 2 AS VARCHAR) AS has_ref, prio AS priority FROM sales"""


def _memos(spark, sf):
    k = F.col("k")
    inv = F.concat(F.lit("paid INV-"), F.substring("day", 1, 4), F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    memo = F.when(k % 3 == 0, inv).when(k % 3 == 1, F.concat(inv, F.lit(" for #"), k.cast("string"), F.lit(" thanks"))).otherwise(F.lit("rent, no number"))
    return rows(sales(spark, sf).select("k", memo.alias("memo"), F.concat("prio", F.lit("|tag|x")).alias("tags")))


@query("r_12_memos", _MEMO_SQL)
def _(spark, sf):
    return r.memo_tokens("memo", "tags", ["k"]).run(_memos(spark, sf)).output()


@query("r_12_memos_cheap", _MEMO_SQL)
def _(spark, sf):
    return r.memo_tokens_cheap("memo", "tags", ["k"]).run(_memos(spark, sf)).output()


@query("r_13_six_cleanings", IT + f"""SELECT ship AS date, CASE status WHEN 'O' THEN 'open' ELSE status END AS type, {D('sc')} AS amount, {D('cents')} AS price,
  CASE WHEN status = 'O' THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN flag = 'A' THEN {D('disc')} WHEN flag = 'N' THEN {D('tax')} WHEN disc >= 10 THEN {D('disc', 3)} ELSE {D('disc')} END AS fee_rate,
  CASE WHEN ln % 7 < 6 THEN '' ELSE 'note' END AS notes FROM items""")
def _(spark, sf):
    from ..operators.cleaning import blank_nulls, number_value

    df = items(spark, sf).select(
        "k", F.date_format(F.col("ship").cast("date"), "MM/dd/yyyy").alias("day"), "status", "paren", "price", "rate",
        pick(F.col("ln"), "N/A", "NA", "NULL", "None", "none", "-", "note").alias("notes"),
    )
    t = r.plain("six", {
        "date": fn.date_convert(f("day"), "MM/DD/YYYY", "YYYY-MM-DD"), "type": fn.remap(f("status"), {"O": "open"}),
        "amount": number_value("paren", "parentheses"), "price": fn.if_(fn.isempty(f("price")), "", fn.price_value(f("price")) * 1),
        "currency": fn.price_currency(f("price")), "fee_rate": number_value("rate", "rate"), "notes": blank_nulls("notes"),
    })
    return t.run(rows(df)).output()


def also(name: str, other: str) -> None:
    """The same job under its recipe name."""
    QUERIES[name] = QUERIES[other]
    if other in ORACLES:
        ORACLES[name] = ORACLES[other]


also("r_14_mixed_batches", "u_02_mixed_formats")


@query("r_15_two_hops_with_offset", f"""WITH sales AS ({routing.SALES_SQL}) SELECT CAST(k AS VARCHAR) AS order_id, cust AS customer_id,
  CASE WHEN c_custkey IS NULL THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS nation_id, coalesce(n_name, '') AS nation_name,
  day || 'T00:00:00' || CASE WHEN d >= make_date(year(d), 3, 31) - CAST(isodow(make_date(year(d), 3, 31)) % 7 AS INTEGER) + 1 AND d <
    CASE WHEN year(d) < 1996 THEN make_date(year(d), 9, 30) - CAST(isodow(make_date(year(d), 9, 30)) % 7 AS INTEGER) ELSE make_date(year(d), 10, 31) - CAST(isodow(make_date(year(d), 10, 31)) % 7 AS INTEGER) END + 1
    THEN '+02:00' ELSE '+01:00' END AS order_ts
  FROM sales LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = cust LEFT JOIN nation ON n_nationkey = c_nationkey""")
def _(spark, sf):
    """Orders find their customer, customers their nation, all in one stacked statement."""
    stack = joins.stacked(spark, sf).drop("n")
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_nationkey").cast("string").alias("nation_id"), F.lit("cn").alias("_type"), (F.col("c_custkey") + 1).alias("_record_num"))
    lands = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("nation_id"), F.col("n_name").alias("name"), F.lit("land").alias("_type"), F.col("n_nationkey").cast("bigint").alias("_record_num"))
    days = sales(spark, sf).select(F.col("k").cast("string").alias("order_id"), F.col("mdy").alias("day"))
    orders = stack.filter("_type = 'order'").join(days, "order_id").drop("_file", "_stem", "_sheet")
    names = ("order_id", "customer_id", "nation_id", "order_ts")
    one = Template("hop1", {
        "order_id": f("order_id"), "customer_id": f("customer_id"), "nation_id": fn.lookup(f("customer_id"), "nation"),
        "order_ts": fn.concat(fn.date_convert(f("day"), "M/D/YYYY", "YYYY-MM-DD"), "T00:00:00", fn.tz_offset(fn.date_convert(f("day"), "M/D/YYYY", "YYYY-MM-DD"), "Europe/Prague")),
    }, {n: n for n in names}, [Rule(f("_type") == "order")], {"people": Lookup(f("customer_id"), {"nation": f("nation_id")}, f("_type") == "cn")})
    first = one.run(union_all(orders, people)).output().withColumns({"_type": F.lit("order"), "_record_num": F.lit(0).cast("bigint")})
    two = Template("hop2", {**{n: f(n) for n in names}, "nation_name": fn.lookup(f("nation_id"), "name")}, {n: n for n in (*names, "nation_name")},
                   [Rule(f("_type") == "order")], {"lands": Lookup(f("nation_id"), {"name": f("name")}, f("_type") == "land")})
    return two.run(union_all(first, lands)).output()


also("r_16_two_tables", "j_07_stacked_tables")
also("r_17_vintages", "p_13_harmonise")


@query("r_18_workbook_tabs", GOODS + "SELECT 'January' AS month, type AS region, size AS units FROM goods WHERE k % 2 = 0 UNION ALL SELECT 'February', type, size FROM goods WHERE k % 2 = 1")
def _(spark, sf):
    out = []
    for i, month in enumerate(("January", "February")):
        df = goods(spark, sf).filter(F.col("k") % 2 == i).select("type", F.concat("size", F.lit(".0")).alias("units"))
        path = sources.export(spark, df, "r18", sources.make_workbook(["region", "units"], ["text", "num"]), ".xlsx")
        src = workbook.scan(spark, workbook.WorkbookSource(path, "Cash", header_row=2))
        out.append(r.plain("tab", {"month": fn.const(month), "region": f("region"), "units": f("units") * 1}).run(src).output())
    return union_all(*out)


@query("r_19_licences", CLIENTS + f"""SELECT CASE WHEN k % 4 = 0 THEN name ELSE segment END AS business, CASE {sql_pick('k', 'AAI', 'AAC', 'REV')} WHEN 'AAI' THEN 'active' WHEN 'AAC' THEN 'cancelled' ELSE 'REV' END AS status,
  CASE {sql_pick('k', 'ISSUE', 'RENEW', 'C_LOC')} WHEN 'ISSUE' THEN 'first' WHEN 'RENEW' THEN 'again' ELSE 'C_LOC' END AS kind, CASE WHEN k % 5 = 0 THEN '<not-on-file>' ELSE '2020-01-02' END AS applied FROM clients""")
def _(spark, sf):
    k = F.col("k")
    df = clients(spark, sf).select(
        "k", F.when(k % 4 == 0, F.lit(" ")).otherwise(F.col("segment")).alias("trade_name"), F.col("name").alias("legal_name"), pick(k, "AAI", "AAC", "REV").alias("license_status"),
        pick(k, "ISSUE", "RENEW", "C_LOC").alias("application_type"), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("2020-01-02T00:00:00.000")).alias("created"),
    )
    kind = f("application_type")
    t = r.plain("licences", {
        "business": fn.coalesce(f("trade_name"), f("legal_name")), "status": fn.remap(f("license_status"), {"AAI": "active", "AAC": "cancelled"}),
        "kind": fn.case(kind, "ISSUE", "first", "RENEW", "again", kind),
        "applied": fn.if_(fn.isempty(f("created")), "<not-on-file>", fn.date_convert(f("created"), "YYYY-MM-DD[T]hh:mm:ss", "YYYY-MM-DD")),
    })
    return t.run(rows(df)).output()


@query("r_20_wide_to_long", IT + " , w AS (SELECT CAST(k AS VARCHAR) AS country, q, disc, tax FROM items) SELECT country, '2020-01-22' AS date, CAST(q AS VARCHAR) AS cases FROM w UNION ALL SELECT country, '2020-12-31', CAST(disc AS VARCHAR) FROM w UNION ALL SELECT country, '2021-12-31', CAST(tax AS VARCHAR) FROM w")
def _(spark, sf):
    df = items(spark, sf).select("k", F.col("q").alias("1/22/20"), F.col("disc").alias("12/31/20"), F.col("tax").alias("12/31/21"))
    t = r.wide_to_long({"country": f("k")}, {"1/22/20": "2020-01-22", "12/31/20": "2020-12-31", "12/31/21": "2021-12-31"}, "date", "cases")
    return t.run(rows(df)).output()


@query("r_21_packed_dimensions", GOODS + "SELECT brand AS geo, type AS age, CASE WHEN k % 4 = 0 THEN '' ELSE size END AS pop, CASE WHEN k % 3 = 0 THEN 'b' ELSE '' END AS flag FROM goods")
def _(spark, sf):
    k = F.col("k")
    dims = F.concat_ws(",", F.lit("A"), F.lit("NR"), "type", F.lit("T"), "brand")
    value = F.concat(F.when(k % 4 == 0, F.lit(":")).otherwise(F.col("size")), F.when(k % 3 == 0, F.lit(" b")).otherwise(F.lit(" ")))
    df = goods(spark, sf).select(dims.alias("d"), value.alias("v"))
    src = csv_source(spark, df, ["d", "v"], "r21", "\t", header=["freq,unit,age,sex,geo\\TIME", "2021 "], quote="none")
    cell = fn.trim(fn.fields(2))
    t = r.plain("packed", {
        "geo": fn.split_part(fn.fields(1), ",", 5), "age": fn.split_part(fn.fields(1), ",", 3),
        "pop": fn.nullif(fn.split_part(cell, " ", 1), ":"), "flag": fn.split_part(cell, " ", 2),
    })
    return t.run(src).output()


@query("r_22_pipe_comma", SALES + f"SELECT day AS date, {D('cents')} AS price, lpad(cust, 5, '0') AS postal, cust AS postal_raw FROM sales")
def _(spark, sf):
    df = sales(spark, sf).select(F.date_format(F.col("day").cast("date"), "dd/MM/yyyy").alias("Date mutation"), F.replace("total", F.lit("."), F.lit(",")).alias("Valeur"), F.col("cust").alias("Code postal"))
    src = csv_source(spark, df, ["Date mutation", "Valeur", "Code postal"], "r22", "|", decimal_separator=",")
    t = r.plain("pipe", {"date": fn.date_convert(f("Date mutation"), "DD/MM/YYYY", "YYYY-MM-DD"), "price": f("Valeur"), "postal": fn.lpad(f("Code postal"), 5, "0"), "postal_raw": f("Code postal")})
    return t.run(src).output()


@query("r_23_parent_stations", CLIENTS + """SELECT CAST(k AS VARCHAR) AS stop_id, name, CASE WHEN k % 10 = 0 THEN 'station' ELSE 'platform' END AS kind, CASE WHEN k % 10 = 0 THEN '' ELSE CAST(k // 10 * 10 AS VARCHAR) END AS parent_id,
  CASE WHEN k % 10 = 0 THEN '' ELSE (SELECT name FROM clients p WHERE p.k = c.k // 10 * 10) END AS parent_station_name FROM clients c""")
def _(spark, sf):
    k = F.col("k")
    df = clients(spark, sf).select("k", "name", F.when(k % 10 == 0, F.lit("1")).otherwise(F.lit("0")).alias("location_type"),
                                   F.when(k % 10 == 0, F.lit("")).otherwise((F.floor(k / 10) * 10).cast("string")).alias("parent"))
    return r.parent_names("k", "name", "location_type", "parent").run(rows(df)).output()


@query("r_24_segments", SALES + "SELECT CAST(k AS VARCHAR) AS mrn, 'Name' || cust AS family, status AS given, CASE WHEN k % 6 = 0 THEN '' ELSE day END AS dob, 'F' AS sex FROM sales")
def _(spark, sf):
    s = sales(spark, sf)
    k = F.col("k")
    born = F.when(k % 6 == 0, F.lit("")).otherwise(F.replace("day", F.lit("-"), F.lit("")))
    pid = F.concat_ws("|", F.lit("PID"), F.lit("1"), F.lit(""), F.concat(k.cast("string"), F.lit("^^^H")), F.lit(""),
                      F.concat(F.lit("Name"), "cust", F.lit("&x^"), "status"), F.lit(""), born, F.lit("F"))
    path = scratch_dir(spark, "r24")
    s.select(F.explode(F.array(F.lit("MSH|^~\\&|A"), pid, F.lit("OBX|1"))).alias("line")).write.text(path)
    src = text.scan(spark, text.TextSource(path, suffix=".txt", delimiter="|", quote="none", header_line=0, width=9, record_numbers=False))
    return r.segment_roster().run(src).output()


@query("r_25_titles", GOODS + "SELECT CAST(k AS VARCHAR) AS id, name AS title, CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END AS adult, CASE WHEN k % 3 = 0 THEN '' ELSE size END AS runtime, CASE WHEN k % 4 = 0 THEN '' ELSE type END AS genre, CASE WHEN k % 4 = 0 THEN '' ELSE type || ',' || brand END AS genres FROM goods")
def _(spark, sf):
    k = F.col("k")
    df = goods(spark, sf).select(
        "k", "name", (k % 2).alias("isAdult"), F.when(k % 3 == 0, F.lit("\\N")).otherwise(F.col("size")).alias("minutes"),
        F.when(k % 4 == 0, F.lit("\\N")).otherwise(F.concat_ws(",", "type", "brand")).alias("genres"),
    )
    src = csv_source(spark, df, ["k", "name", "isAdult", "minutes", "genres"], "r25", "\t", quote="none")
    all_genres = fn.nullif(f("genres"), "\\N")
    t = r.plain("titles", {
        "id": f("k"), "title": f("name"), "adult": fn.if_(f("isAdult") == "1", "true", "false"), "runtime": fn.nullif(f("minutes"), "\\N"),
        "genre": fn.split_part(all_genres, ",", 1), "genres": all_genres,
    })
    return t.run(src).output()


@query("r_26_listings", CLIENTS + f"SELECT CAST(k AS VARCHAR) AS id, {sql_pick('k', 'home', 'private', 'Shared')} AS room, CASE WHEN k % 7 = 0 THEN '<hidden>' ELSE {D('cents')} END AS price, CASE {sql_pick('k', '', 'Exempt', 'R-1')} WHEN '' THEN 'unlicensed' WHEN 'Exempt' THEN 'exempt' ELSE 'registered' END AS reg FROM clients")
def _(spark, sf):
    k = F.col("k")
    df = clients(spark, sf).select("k", pick(k, "Entire home", "Private room", "Shared").alias("room_type"), pick(k, "", "Exempt", "R-1").alias("license"),
                                   F.when(k % 7 == 0, F.lit("")).otherwise(F.format_string("%s%d.%02d", F.when(F.col("cents") < 0, F.lit("-")).otherwise(F.lit("")), F.floor(F.abs("cents") / 100), F.abs("cents") % 100)).alias("price"))
    t = r.plain("listings", {
        "id": f("k"), "room": fn.remap(f("room_type"), {"Entire home": "home", "Private room": "private"}),
        "price": fn.coalesce(f("price"), "<hidden>"), "reg": fn.case(f("license"), "", "unlicensed", "Exempt", "exempt", "registered"),
    })
    return t.run(rows(df)).output()


_SX = SALES + """, x AS (SELECT k, CAST(k % 24 AS HUGEINT) AS h, CAST(k % 60 AS HUGEINT) AS m, CAST(k % 59 AS HUGEINT) AS s FROM sales),
  y AS (SELECT *, (m * 1000000000000 * 2 + 60) // 120 + (s * 1000000000000 * 2 + 3600) // 7200 + h * 1000000000000 AS deg FROM x) """


@query("r_27_sexagesimal", _SX + f"SELECT CAST(k AS VARCHAR) AS k, CASE WHEN k % 9 = 0 THEN '' ELSE {D('deg * 15', 12)} END AS ra_deg, {D('CASE WHEN k % 2 = 0 THEN -deg ELSE deg END', 12)} AS dec_deg FROM y")
def _(spark, sf):
    k = F.col("k")
    clock = F.format_string("%02d:%02d:%02d", k % 24, k % 60, k % 59)
    df = sales(spark, sf).select("k", F.when(k % 9 == 0, F.lit("")).otherwise(clock).alias("RA"), F.concat(F.when(k % 2 == 0, F.lit("-")).otherwise(F.lit("+")), clock).alias("Dec"))
    return r.sexagesimal("RA", "Dec", ["k"]).run(rows(df)).output()


@query("r_28_tenths", IT + f"SELECT CAST(k AS VARCHAR) AS k, CASE WHEN ln = 4 THEN '' ELSE {D('q', 1)} END AS high_c, {D('disc * 7', 1)} AS low_c, CASE WHEN ln = 4 THEN 'partial' WHEN q < disc * 7 THEN 'TMAX_below_TMIN' ELSE 'ok' END AS consistency FROM items")
def _(spark, sf):
    df = items(spark, sf).select("k", F.when(F.col("ln") == 4, F.lit("")).otherwise(F.concat(F.lit("  "), "qty")).alias("TMAX"), (F.col("disc") * 7).alias("TMIN"))
    return r.tenths({"TMAX": "high_c", "TMIN": "low_c"}, "TMAX", "TMIN", ["k"]).run(rows(df)).output()


@query("r_29_trips", SALES + f"""SELECT CAST(k AS VARCHAR) AS k, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS pickup_at, day || 'T00:30:00Z' AS dropoff_at, CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END AS stored,
  CASE {sql_pick('k', '1', '2', '9')} WHEN '1' THEN 'card' WHEN '2' THEN 'cash' ELSE '9' END AS payment, CASE WHEN k % 5 = 0 THEN 'no_passengers' WHEN k % 3 = 0 THEN 'refund' ELSE 'ok' END AS quality FROM sales""")
def _(spark, sf):
    k = F.col("k")
    ts = F.col("ts").cast("timestamp_ntz")
    df = sales(spark, sf).select(
        "k", F.date_format(ts, "MM/dd/yyyy hh:mm:ss a").alias("up"), F.concat(F.date_format(ts, "MM/dd/yyyy"), F.lit(" 12:30:00 AM")).alias("down"),
        (k % 5).alias("people"), F.when(k % 4 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("flag"), pick(k, "1", "2", "9").alias("pay"),
        F.concat(F.when(k % 3 == 0, F.lit("-")).otherwise(F.lit("")), "total").alias("fare"),
    )
    return r.trips("up", "down", "people", "flag", "pay", "fare", {"1": "card", "2": "cash"}, ["k"]).run(rows(df)).output()


def _address_zip(spark, sf, label):
    df = sales(spark, sf).select("k", "cust", "ts")

    def make(pdf):
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            body = "Kód;Název obce;Platí Od\n" + "".join(f"{k};Žďár {c};{t.replace(' ', 'T')}\n" for k, c, t in zip(pdf["k"], pdf["cust"], pdf["ts"]))
            z.writestr(f"CSV/area_{pdf['k'].iloc[0]}.csv", body.encode("windows-1250"))
        return out.getvalue()

    path = sources.export(spark, df, label, make, ".zip")
    t = r.plain("addresses", {"code": f("Kód"), "town": f("Název obce"), "valid_from": fn.date_convert(f("Platí Od"), "YYYY-MM-DD[*]", "YYYY-MM-DD")})
    return t.run(archive.scan(spark, archive.ArchiveSource(path, ".csv", text.TextSource("", delimiter=";", encoding="windows-1250"))))


_ADDRESS = SALES + "SELECT CAST(k AS VARCHAR) AS code, 'Žďár ' || cust AS town, day AS valid_from FROM sales"


@query("r_30_address_register", _ADDRESS)
def _(spark, sf):
    return _address_zip(spark, sf, "r30").output()


@query("r_41_zipped_rollup", SALES + "SELECT CAST(k AS VARCHAR) || ',Žďár ' || cust || ',' || day AS line FROM sales UNION ALL SELECT 'code,town,valid_from'")
def _(spark, sf):
    path = scratch_dir(spark, "r41o")
    write_ordered(_address_zip(spark, sf, "r41").output(with_order=True), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("r_31_census", SALES + "SELECT CAST(k AS VARCHAR) AS id, day AS date, status AS shift, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS running, '' AS place, CASE WHEN k % 3 = 0 THEN '' ELSE prio END AS fur FROM sales")
def _(spark, sf):
    k = F.col("k")
    body = F.concat(
        F.lit('{"unique_id": '), k.cast("string"), F.lit(', "date": "'), F.date_format(F.col("day").cast("date"), "MMddyyyy"), F.lit('", "shift": "'), "status",
        F.lit('", "running": '), (k % 2 == 0).cast("string"), F.lit(', "place": {"x": 1}, "fur": '), F.when(k % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), "prio", F.lit('"'))), F.lit("}"),
    )
    src = json_source(spark, sales(spark, sf).select(body.alias("line")), "r31")
    t = r.plain("census", {"id": f("unique_id"), "date": fn.date_convert(f("date"), "MMDDYYYY", "YYYY-MM-DD"), "shift": f("shift"), "running": f("running"), "place": f("place"), "fur": f("fur")})
    return t.run(src).output()


@query("r_32_yield_curve", IT + f", w AS (SELECT d, cents, q, tax FROM items) SELECT strftime(d, '%Y-%m-%d') AS date, '1 Mo' AS tenor, '1' AS months, {D('cents')} AS yield FROM w UNION ALL SELECT strftime(d, '%Y-%m-%d'), '2 Yr', '24', CAST(q AS VARCHAR) FROM w UNION ALL SELECT strftime(d, '%Y-%m-%d'), '10 Yr', '120', {D('tax', 1)} FROM w")
def _(spark, sf):
    df = items(spark, sf).select("k", F.date_format(F.col("ship").cast("date"), "MM/dd/yyyy").alias("Date"), F.col("plain").alias("1 Mo"), F.concat("qty", F.lit(".00")).alias("2 Yr"), F.concat(F.lit("0."), F.col("tax").cast("string"), F.lit("0")).alias("10 Yr"))
    cols = {"1 Mo": "1 Mo", "2 Yr": "2 Yr", "10 Yr": "10 Yr"}
    t = r.wide_to_long({"date": fn.date_convert(f("Date"), "MM/DD/YYYY", "YYYY-MM-DD")}, cols, "tenor", "yield", {"months": {"1 Mo": "1", "2 Yr": "24", "10 Yr": "120"}})
    return t.run(rows(df)).output()


# ---------------------------------------------------------------- ledgers

_BLANK = ", ".join(f"'' AS \"{c}\"" for c in ("account", "fxRate", "subtype", "instrumentType"))
_SYMBOLS = {"1-URGENT": "U", "2-HIGH": "H"}
_SYM = "CASE prio WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' ELSE prio END"


@query("r_33_ledger_paired_rows", SALES + f"""SELECT ts AS date, '$CASH-EUR' AS symbol, '1' AS quantity, 'DEPOSIT' AS "activityType", {D('cents')} AS "unitPrice", 'EUR' AS currency, '' AS fee, {D('cents')} AS amount, {_BLANK}, 'tx' || k AS comment FROM sales WHERE status = 'O'
  UNION ALL SELECT ts, {_SYM}, CAST(k % 50 + 1 AS VARCHAR), 'BUY', {D('(2 * CAST(cents AS HUGEINT) * 10000000000 + (k % 50 + 1)) // (2 * (k % 50 + 1))', 12)}, 'CZK', '', {D('cents')}, {_BLANK}, 'tx' || k FROM sales WHERE status <> 'O'""")
def _(spark, sf):
    """Orders as a statement: deposits, and trades told by a payment line and a fill line."""
    s = sales(spark, sf)
    stamp = F.concat(F.replace("ts", F.lit(" "), F.lit("T")), F.lit(".000Z")).alias("Date")
    k, tx = F.col("k"), F.concat(F.lit("tx"), F.col("k").cast("string")).alias("TX")
    order = k.cast("string").alias("Order ID")

    def line(kind, amount, currency, n):
        return F.struct(F.lit(kind).alias("Type"), amount.alias("Amount"), currency.alias("Currency"), (k * 2 + n).alias("n"))

    lines = F.when(F.col("status") == "O", F.array(line("deposit", F.col("total"), F.lit("EUR"), 1))).otherwise(
        F.array(
            line("trade fill", (k % 50 + 1).cast("string"), F.col("prio"), 1),
            line("trade payment", F.concat(F.lit("-"), "total"), F.lit("CZK"), 2),
        )
    )
    df = s.select(stamp, order, tx, F.inline(lines))
    return r.paired_trades(_SYMBOLS).run(with_provenance(df, "statement.csv", F.col("n"), "statement")).output()


@query("r_34_ledger_month_names", SALES + f"""SELECT ts AS date, CASE WHEN status = 'P' THEN '$CASH-USD' ELSE {_SYM} END AS symbol, CASE WHEN status = 'P' THEN '1' ELSE CAST(k % 50 + 1 AS VARCHAR) END AS quantity,
  CASE status WHEN 'F' THEN 'BUY' WHEN 'O' THEN 'SELL' ELSE 'DEPOSIT' END AS "activityType", CASE WHEN status = 'P' THEN {D('cents')} ELSE '2.5' END AS "unitPrice", 'USD' AS currency, CASE WHEN k % 3 = 0 THEN '' ELSE {D('k % 3', 1)} END AS fee,
  {D('cents')} AS amount, {_BLANK}, strftime(t, '%Y%m%d%H%M%S') AS comment FROM sales WHERE k % 10 < 8 AND day BETWEEN '1996-01-01' AND '1999-06-30'""")
def _(spark, sf):
    k = F.col("k")
    kind = F.when(k % 10 >= 8, F.lit("Stake")).when(F.col("status") == "F", pick(k, "Buy", "Buy - X")).when(F.col("status") == "O", F.lit("Sell")).otherwise(F.lit("Other"))
    df = sales(spark, sf).select(
        "k", F.date_format(F.col("ts").cast("timestamp_ntz"), "d MMM yyyy, HH:mm:ss").alias("Date"), kind.alias("Type"), F.col("prio").alias("Symbol"), (k % 50 + 1).alias("Quantity"),
        F.lit("$2.50").alias("Price"), F.concat(F.lit("$"), "total").alias("Value"), F.concat(F.lit("$0."), (k % 3).cast("string")).alias("Fees"),
    )
    src = with_provenance(df, "x.csv", k + 1, "orders_1996-01-01_1999-06-30")
    return r.month_name_orders(_SYMBOLS).run(src).output()


@query("r_35_ledger_many_actions", SALES + f""", x AS (SELECT *, k % 9 AS a, k % 50 + 1 AS sh, k % 4 AS fe FROM sales),
  b AS (SELECT x.*, CASE WHEN a < 4 THEN {_SYM} ELSE '$CASH-USD' END AS sym, CASE WHEN a = 0 THEN 0 ELSE cents END AS tot FROM x)
  SELECT ts AS date, sym AS symbol, CASE WHEN a < 4 THEN CAST(sh AS VARCHAR) WHEN a IN (4, 5, 8) THEN '' ELSE '1' END AS quantity,
    CASE a WHEN 0 THEN 'TRANSFER_IN' WHEN 1 THEN 'BUY' WHEN 2 THEN 'BUY' WHEN 3 THEN 'SELL' WHEN 4 THEN 'DEPOSIT' WHEN 5 THEN 'WITHDRAWAL' WHEN 6 THEN 'DIVIDEND' ELSE CASE WHEN k % 2 = 0 THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END END AS "activityType",
    CASE WHEN a < 4 THEN {D("(CASE WHEN tot < fe THEN -1 ELSE 1 END) * ((2 * CAST(abs(tot - fe) AS HUGEINT) * 10000000000 + sh) // (2 * sh))", 12)} WHEN a IN (4, 5, 8) THEN '' ELSE {D('tot')} END AS "unitPrice",
    'USD' AS currency, CASE WHEN fe > 0 THEN {D('fe')} ELSE '' END AS fee, CASE WHEN a < 4 THEN {D('tot - fe')} ELSE {D('tot')} END AS amount, {_BLANK}, k || '_' || ts AS comment FROM b WHERE a <> 7
  UNION ALL SELECT ts, '$CASH-USD', '', 'FEE', '', 'USD', '', {D('fe')}, {_BLANK}, k || '_' || ts FROM b WHERE a = 7
  UNION ALL SELECT ts, '$CASH-GBP', '', 'WITHDRAWAL', '', 'GBP', '', {D('cents')}, {_BLANK}, k || '_' || ts FROM b WHERE a = 7
  UNION ALL SELECT ts, '$CASH-EUR', '', 'DEPOSIT', '', 'EUR', '', {D('cents * 2')}, {_BLANK}, k || '_' || ts FROM b WHERE a = 7""")
def _(spark, sf):
    k = F.col("k")
    a = k % 9
    df = sales(spark, sf).select(
        "k", F.col("ts").alias("Time"), k.alias("ID"), F.lit("USD").alias("Currency"), (k % 50 + 1).alias("Shares"),
        pick(k, "Limit buy", "Market buy", "Limit buy", "Market sell", "Deposit", "Withdrawal", "Dividend (Dividend)", "Currency conversion", "Adjustment").alias("Action"),
        F.when(a < 4, F.col("prio")).otherwise(F.lit("")).alias("Ticker"),
        F.when(a == 0, F.lit("0.00")).when(k % 2 == 1, F.concat(F.lit("-"), "total")).otherwise(F.col("total")).alias("Total"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("-0.0"), (k % 4).cast("string"))).alias("Conversion fee"), F.lit("").alias("Stamp duty"),
        F.lit("USD").alias("Fee currency"), F.lit("GBP").alias("From currency"), F.lit("EUR").alias("To currency"),
        F.concat(F.lit("-"), "total").alias("From"), ((F.col("cents") * 2 / 100).cast("decimal(20,2)")).alias("To"),
    )
    return r.many_actions(_SYMBOLS).run(rows(df)).output()


def _sheet(spark, df, columns, kinds, label):
    path = sources.export(spark, df, label, sources.make_workbook(columns, kinds), ".xlsx")
    return workbook.scan(spark, workbook.WorkbookSource(path, "Cash", header_row=2))


def _cash_sql(dividend):
    return SALES + f"""SELECT ts AS date, CASE WHEN k % 3 = 0 THEN '$CASH-CZK' ELSE {_SYM} END AS symbol, CASE WHEN k % 3 = 1 THEN CAST(k % 50 + 1 AS VARCHAR) ELSE '1' END AS quantity,
  CASE k % 3 WHEN 0 THEN 'INTEREST' WHEN 1 THEN 'BUY' ELSE 'DIVIDEND' END AS "activityType",
  CASE WHEN k % 3 = 1 THEN {D('(2 * CAST(cents AS HUGEINT) * 10000000000 + (k % 50 + 1)) // (2 * (k % 50 + 1))', 12)} ELSE {D('cents')} END AS "unitPrice", 'CZK' AS currency, '' AS fee, {D('cents')} AS amount, {_BLANK},
  k || '_' || ts || '_' || CASE WHEN k % 3 = 1 THEN 'OPEN BUY ' || (k % 50 + 1) || '/99 @ 1' ELSE 'note' END AS comment FROM sales"""


def _cash(spark, sf, symbol, buy, dividend, label):
    k = F.col("k")
    df = sales(spark, sf).select(
        k.alias("id"), pick(k, "Free-funds Interest", buy, dividend).alias("t"), F.col("ts"),
        F.when(k % 3 == 1, F.concat(F.lit("OPEN BUY "), (k % 50 + 1).cast("string"), F.lit("/99 @ 1"))).otherwise(F.lit("note")).alias("c"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("prio")).alias("s"), F.when(k % 3 == 1, F.concat(F.lit("-"), "total")).otherwise(F.col("total")).alias("a"),
    )
    src = _sheet(spark, df, ["ID", "Type", "Time", "Comment", symbol, "Amount"], ["num", "text", "text", "text", "text", "num"], label)
    types = {"Free-funds Interest": "INTEREST", dividend: "DIVIDEND", "Withholding tax": "TAX"}
    return r.cash_sheet(symbol, types, buy, _SYMBOLS, "CZK").run(src).output()


@query("r_36_cash_sheet_old", _cash_sql("DIVIDENT"))
def _(spark, sf):
    return _cash(spark, sf, "Symbol", "Stock purchase", "DIVIDENT", "r36")


@query("r_38_cash_sheet_new", _cash_sql("Dividend"))
def _(spark, sf):
    return _cash(spark, sf, "Ticker", "Stock buy", "Dividend", "r38")


_CLOSED_SQL = SALES + f"""SELECT day || ' 06:00:00' AS date, {_SYM} AS symbol, CAST(k % 50 + 1 AS VARCHAR) AS quantity, 'SELL' AS "activityType", '2.5' AS "unitPrice", 'CZK' AS currency, '' AS fee, {D('cents')} AS amount, {_BLANK}, CAST(k AS VARCHAR) AS comment FROM sales WHERE k % 7 <> 0"""


def _closed(spark, sf, symbol, closed, price, value, label):
    k = F.col("k")
    serial = F.when(k % 7 == 0, F.lit("")).otherwise((F.date_diff(F.col("day").cast("date"), F.lit("1899-12-30").cast("date")) + 0.25).cast("string"))
    df = sales(spark, sf).select(k.alias("p"), F.col("prio").alias("s"), (k % 50 + 1).alias("v"), serial.alias("c"), F.lit("2.5000").alias("pr"), F.col("total").alias("t"))
    src = _sheet(spark, df, ["Position", symbol, "Volume", closed, price, value], ["num", "text", "num", "date", "num", "num"], label)
    return r.closed_sheet(symbol, closed, price, value, _SYMBOLS, "CZK").run(src).output()


@query("r_37_closed_sheet_old", _CLOSED_SQL)
def _(spark, sf):
    return _closed(spark, sf, "Symbol", "Close time", "Close price", "Sale value", "r37")


@query("r_39_closed_sheet_new", _CLOSED_SQL)
def _(spark, sf):
    return _closed(spark, sf, "Ticker", "Close Time (UTC)", "Close Price", "Sale Value", "r39")


@query("r_40_rollup", SALES + """SELECT 'all' AS "where", day || ',' || cust AS line FROM sales UNION ALL SELECT 'all', 'date,cust' UNION ALL SELECT 'file', day || ',' || cust FROM sales UNION ALL SELECT DISTINCT 'file', 'date,cust' FROM (SELECT DISTINCT status FROM sales) WHERE status = 'F'
  UNION ALL SELECT 'file', 'date,cust' FROM (SELECT DISTINCT status FROM sales) WHERE status <> 'F'""")
def _(spark, sf):
    df = numbered_sales(spark, sf).withColumns({"_file": F.concat("status", F.lit(".csv")), "_stem": F.col("status")})
    out = r.plain("rollup", {"date": f("day"), "cust": f("cust")}).run(df).output(with_order=True)
    one, many = scratch_dir(spark, "r40a"), scratch_dir(spark, "r40b")
    write_ordered(out, one)
    write_per_file(out, many)
    return (
        spark.read.text(one).select(F.lit("all").alias("where"), F.col("value").alias("line"))
        .unionByName(spark.read.text(many).select(F.lit("file").alias("where"), F.col("value").alias("line")))
    )


@query("r_42_json_values", ACT + f"SELECT day AS date, type AS ticker, {D('cents')} AS price, CASE WHEN k % 2 = 0 THEN '' ELSE '1000' END AS fee, '' AS note, 'true' AS flag FROM activity")
def _(spark, sf):
    k = F.col("k")
    body = F.concat(
        F.lit('{"date": "'), "day", F.lit('", "ticker": "'), "type", F.lit('", "price": '), "value", F.lit(', "fee": '),
        F.when(k % 2 == 0, F.lit("null")).otherwise(F.lit("1e3")), F.lit(', "note": '), "props", F.lit(', "flag": true}'),
    )
    src = json_source(spark, activity(spark, sf).select(body.alias("line")), "r42")
    t = r.plain("json_values", {c: f(c) for c in ("date", "ticker", "price", "fee", "note", "flag")})
    out = t.run(src).output()
    path = scratch_dir(spark, "r42o")
    write_json_lines(out, path)
    return spark.read.schema("date string, ticker string, price string, fee string, note string, flag string").json(path)


also("f_filename", "s_09_file_name")
also("f_sheet_name", "s_10_sheet_name")
