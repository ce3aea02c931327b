"""Projections, predicates and row routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators.provenance import with_provenance
from ..operators.reshape import harmonised, union_all, unpivot
from ..plans.template import Rule, Template
from ..functions.sqlfuncs import register_sql
from .base import GOODS_SQL, ITEMS_SQL, SALES_SQL, digits, goods, items, query, sales

f = fn.field
D = digits
SALES = f"WITH sales AS ({SALES_SQL}) "


def numbered_sales(spark, sf_dir, file="orders.csv", stem="orders"):
    return with_provenance(sales(spark, sf_dir), file, F.col("k") + 1, stem)


@query("p_01_variables", SALES + f"SELECT CAST(k AS VARCHAR) AS id, {D('cents')} AS amount, lower(prio) AS priority FROM sales")
def _(spark, sf):
    t = Template(
        "p_01", {"id": f("k"), "amount": f("total"), "priority": fn.lower(f("prio"))},
        {"id": "id", "amount": "amount", "priority": "priority"},
    )
    return t.run(numbered_sales(spark, sf)).output()


@query("p_02_output", SALES + f"SELECT {D('cents')} AS \"Amount\", day AS \"Order Date\", {D('cents')} AS \"Again\" FROM sales")
def _(spark, sf):
    t = Template("p_02", {"a": f("total"), "d": f("day")}, {"Amount": "a", "Order Date": "d", "Again": "a"})
    return t.run(numbered_sales(spark, sf)).output()


@query("p_03_positional", SALES + "SELECT CAST(k AS VARCHAR) AS id, status AS second, '' AS past, '' AS zero FROM sales")
def _(spark, sf):
    df = numbered_sales(spark, sf).withColumn("_fields", F.array(F.col("k").cast("string"), "status", "prio"))
    t = Template(
        "p_03", {"id": fn.fields(1), "second": fn.fields(2), "past": fn.fields(9), "zero": fn.fields(0)},
        {n: n for n in ("id", "second", "past", "zero")},
    )
    return t.run(df).output()


@query("p_04_missing_column", SALES + "SELECT status, '' AS gone, 'none' AS filled FROM sales")
def _(spark, sf):
    t = Template(
        "p_04", {"status": f("status"), "gone": f("Status"), "filled": fn.coalesce(f("No such column"), "none")},
        {n: n for n in ("status", "gone", "filled")},
    )
    return t.run(numbered_sales(spark, sf)).output()


def _routes():
    return [
        Rule(f("status") == "F", [{"kind": fn.const("final")}]),
        Rule(f("maybe") > 5, [{"kind": fn.const("never")}]),  # not a number: the rule does not match
        Rule(f("prio") == "1-URGENT", [{"kind": fn.const("rush")}]),
        Rule(f("status") == "O", []),
        Rule(fn.starts_with(f("prio"), "5"), [{"kind": fn.const("slow")}]),
    ]


_ROUTED = """CASE WHEN status = 'F' THEN 'final' WHEN prio = '1-URGENT' THEN 'rush' WHEN status = 'O' THEN NULL
  WHEN starts_with(prio, '5') THEN 'slow' END"""


@query("p_06_first_match", SALES + f"SELECT CAST(k AS VARCHAR) AS id, {_ROUTED} AS kind FROM sales WHERE {_ROUTED} IS NOT NULL")
def _(spark, sf):
    t = Template("p_06", {"id": f("k"), "kind": ""}, {"id": "id", "kind": "kind"}, _routes())
    return t.run(numbered_sales(spark, sf)).output()


@query("p_07_drop", SALES + f"""SELECT CASE WHEN status = 'O' AND prio <> '1-URGENT' THEN 'rule_skip' ELSE 'no_rule_match' END AS reason, count(*) AS n
  FROM sales WHERE {_ROUTED} IS NULL GROUP BY 1""")
def _(spark, sf):
    t = Template("p_07", {"id": f("k"), "kind": ""}, {"id": "id", "kind": "kind"}, _routes())
    return t.run(numbered_sales(spark, sf)).filtered().groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def fan_out():
    sell = {"action": fn.const("SELL"), "amount": f("total")}
    fee = {"action": fn.const("FEE"), "amount": fn.round_(f("total") * "0.01", 2)}
    tax = {"action": fn.const("TAX"), "amount": fn.round_(f("total") * "0.2", 2)}
    return Template(
        "fan_out", {"id": f("k"), "date": f("day"), "action": "", "amount": "0"},
        {n: n for n in ("id", "date", "action", "amount")},
        [Rule(f("status") == "F", [sell, fee, tax]), Rule(f("status") == "P", [sell, fee]), Rule(f("prio") == "5-LOW", [{}])],
    )


_FAN = SALES + f"""SELECT CAST(k AS VARCHAR) AS id, day AS date, 'SELL' AS action, {D('cents')} AS amount FROM sales WHERE status IN ('F', 'P')
  UNION ALL SELECT CAST(k AS VARCHAR), day, 'FEE', {D('((cents + 50) // 100)')} FROM sales WHERE status IN ('F', 'P')
  UNION ALL SELECT CAST(k AS VARCHAR), day, 'TAX', {D('((cents * 2 + 5) // 10)')} FROM sales WHERE status = 'F'
  UNION ALL SELECT CAST(k AS VARCHAR), day, '', '0' FROM sales WHERE status = 'O' AND prio = '5-LOW'"""


@query("p_08_fan_out", _FAN)
def _(spark, sf):
    return fan_out().run(numbered_sales(spark, sf)).output()


@query("p_09_override", SALES + f"""SELECT CAST(k AS VARCHAR) AS id, CASE WHEN status = 'P' THEN 'part of ' || cust ELSE cust END AS who,
  CASE WHEN status = 'P' THEN {D('-cents')} ELSE {D('cents')} END AS amount FROM sales""")
def _(spark, sf):
    t = Template(
        "p_09", {"id": f("k"), "who": f("cust"), "amount": f("total")}, {"id": "id", "who": "who", "amount": "amount"},
        [Rule(f("status") == "P", [{"who": fn.concat("part of ", f("cust")), "amount": -f("total")}]), Rule()],
    )
    return t.run(numbered_sales(spark, sf)).output()


@query("p_10_unpivot", f"WITH goods AS ({GOODS_SQL}) SELECT CAST(k AS VARCHAR) AS id, 'Size (in)' AS label, size AS value FROM goods "
       "UNION ALL SELECT CAST(k AS VARCHAR), 'Brand', brand FROM goods UNION ALL SELECT CAST(k AS VARCHAR), 'Type', type FROM goods")
def _(spark, sf):
    df = goods(spark, sf).select(F.col("k").cast("string").alias("id"), "size", "brand", "type")
    return unpivot(df, ["id"], {"size": "Size (in)", "brand": "Brand", "type": "Type", "absent": "No"})


@query("p_11_date_range", SALES + "SELECT CAST(k AS VARCHAR) AS id, day AS date FROM sales WHERE day BETWEEN '1996-03-01' AND '1997-02-28' AND status <> 'P'")
def _(spark, sf):
    t = Template("p_11", {"id": f("k"), "date": fn.date_convert(f("dmy"), "DD.MM.YYYY", "YYYY-MM-DD")}, {"id": "id", "date": "date"},
                 [Rule(f("status") != "P")], date_range="date")
    return t.run(numbered_sales(spark, sf, stem="orders_1996-03-01_1997-02-28")).output()


@query("p_11_date_range_override", SALES + """SELECT CAST(k AS VARCHAR) AS id, date FROM (SELECT k, day AS date FROM sales WHERE status = 'F'
  UNION ALL SELECT k, strftime(d + 365, '%Y-%m-%d') FROM sales WHERE status = 'F') WHERE date BETWEEN '1996-03-01' AND '1997-02-28'""")
def _(spark, sf):
    t = Template("p_11b", {"id": f("k"), "date": f("day")}, {"id": "id", "date": "date"},
                 [Rule(f("status") == "F", [{}, {"date": fn.dateadd(f("day"), 365)}])], date_range="date")
    return t.run(numbered_sales(spark, sf, stem="orders_1996-03-01_1997-02-28")).output()


@query("p_11_no_range", SALES + "SELECT CAST(k AS VARCHAR) AS id, maybe AS date FROM sales")
def _(spark, sf):
    t = Template("p_11c", {"id": f("k"), "date": f("maybe")}, {"id": "id", "date": "date"}, date_range="date")
    return t.run(numbered_sales(spark, sf, stem="orders_1997-02-28_1996-03-01")).output()


@query("p_12_predicates", SALES + """SELECT CAST(k AS VARCHAR) AS id FROM sales WHERE maybe NOT IN ('', 'soon') AND prio IN ('1-URGENT', '2-HIGH')
  AND contains(day, '-02-') AND cents > 10000000""")
def _(spark, sf):
    when = ~fn.isempty(f("maybe")) & fn.is_date(f("maybe")) & fn.in_(f("prio"), "1-URGENT", "2-HIGH") & fn.contains(f("day"), "-02-") & (f("total") > 100000)
    return Template("p_12", {"id": f("k")}, {"id": "id"}, [Rule(when)]).run(numbered_sales(spark, sf)).output()


@query("p_13_harmonise", SALES + f"SELECT CAST(k AS VARCHAR) AS id, day AS date, {D('cents')} AS amount FROM sales")
def _(spark, sf):
    s = sales(spark, sf)
    old = s.filter("status = 'F'").select(F.col("k").cast("string").alias("Id"), F.col("day").alias("Date"), F.col("total").alias("Amount"))
    new = s.filter("status <> 'F'").select(F.col("k").cast("string").alias("Id"), F.col("dmy").alias("order_date"),
                                           F.translate("total", ".", ",").alias("value"))
    both = with_provenance(union_all(old, new))
    t = Template("p_13", {
        "id": f("Id"),
        "date": harmonised(f("Date"), fn.date_convert(f("order_date"), "DD.MM.YYYY", "YYYY-MM-DD")),
        "amount": harmonised(f("Amount"), fn.replace(f("value"), " ", "", ",", ".")) * 1,
    }, {"id": "id", "date": "date", "amount": "amount"})
    return t.run(both).output()


@query("p_01_sql_functions", f"WITH items AS ({ITEMS_SQL}) SELECT k, ln, {D('cents * q')} AS gross, CASE WHEN flag = 'R' THEN 'back' ELSE flag END AS kind, "
       "CASE WHEN ln = 3 THEN 'bad' WHEN ln IN (4, 5) THEN '1' ELSE " + D("cents + 100") + " END AS lenient, CAST(year(d) AS VARCHAR) AS y FROM items")
def _(spark, sf):
    """The same functions from SQL text."""
    register_sql(spark, {"if", "eq", "case", "iferror", "add", "year"})
    items(spark, sf).createOrReplaceTempView("sw_items")
    return spark.sql(
        """SELECT k, ln, sw_times(plain, qty) AS gross, sw_if(sw_eq(flag, 'R'), 'x', 'y') AS unused, sw_case(flag, 'R', 'back', flag) AS kind,
           sw_iferror(sw_add(dirty, '1'), 'bad') AS lenient, sw_year(ship) AS y FROM sw_items"""
    ).drop("unused")
