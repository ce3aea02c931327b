"""Keyed lookups and table joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators.lookup import Lookup, build_side, keyed_join, last_value
from ..operators.provenance import with_provenance
from ..operators.reshape import map_join
from ..plans.template import Rule, Template
from .base import ACTIVITY_SQL, activity, digits, query, sales, table
from .routing import SALES

f = fn.field
D = digits
ACT = f"WITH activity AS ({ACTIVITY_SQL}) "


def log(spark, sf_dir):
    return with_provenance(activity(spark, sf_dir), "events.log", F.col("_record_num"), "events")


@query("j_01_lookup", ACT + f""", last AS (SELECT "user", arg_max(cents, rn) AS c FROM activity WHERE type = 'purchase' GROUP BY 1)
  SELECT CAST(k AS VARCHAR) AS id, a."user" AS who, coalesce({D('c')}, '') AS paid FROM activity a LEFT JOIN last USING ("user") WHERE type <> 'purchase'""")
def _(spark, sf):
    t = Template(
        "j_01", {"id": f("k"), "who": f("user"), "paid": fn.lookup(f("user"), "amount")}, {"id": "id", "who": "who", "paid": "paid"},
        [Rule(f("type") != "purchase")], {"purchases": Lookup(f("user"), {"amount": f("value")}, f("type") == "purchase")},
    )
    return t.run(log(spark, sf)).output()


@query("j_02_named_blocks", ACT + f""", p AS (SELECT "user", arg_max(cents, rn) AS c FROM activity WHERE type = 'purchase' GROUP BY 1),
  s AS (SELECT "user", arg_max(ts, rn) AS since FROM activity WHERE type = 'signup' AND cents > 2000 GROUP BY 1)
  SELECT CAST(k AS VARCHAR) AS id, coalesce({D('c')}, '') AS paid, coalesce(since, '') AS joined FROM activity a LEFT JOIN p USING ("user") LEFT JOIN s USING ("user")""")
def _(spark, sf):
    t = Template(
        "j_02", {"id": f("k"), "paid": fn.lookup("buy", f("user"), "amount"), "joined": fn.lookup("join", f("user"), "at")},
        {"id": "id", "paid": "paid", "joined": "joined"}, [Rule()],
        {"buy": Lookup(f("user"), {"amount": f("value")}, f("type") == "purchase"),
         "join": Lookup(f("user"), {"at": f("ts")}, (f("type") == "signup") & (f("value") > 20))},
    )
    return t.run(log(spark, sf)).output()


@query("j_03_last_writer", ACT + f"""SELECT "user" AS key, {D('arg_max(cents, rn)')} AS amount,
    coalesce(arg_max({D('cents * 2')}, rn) FILTER (WHERE type <> 'error'), NULL) AS twice,
    arg_max(CASE WHEN type = 'view' THEN '' ELSE type END, rn) AS kind FROM activity GROUP BY 1""")
def _(spark, sf):
    # an expression that fails on a row does not overwrite; an empty text does
    lk = Lookup(f("user"), {
        "amount": f("value"),
        "twice": fn.if_(f("type") == "error", f("type") * 1, f("value") * 2),
        "kind": fn.if_(f("type") == "view", "", f("type")),
    })
    return build_side(log(spark, sf), lk).select(F.col("_key").alias("key"), "amount", "twice", "kind")


@query("j_04_composite_key", ACT + f""", last AS (SELECT "user", day, arg_max(cents, rn) AS c FROM activity WHERE type = 'click' GROUP BY 1, 2)
  SELECT CAST(k AS VARCHAR) AS id, coalesce({D('c')}, '') AS clicked FROM activity a LEFT JOIN last USING ("user", day)""")
def _(spark, sf):
    key = fn.concat(f("user"), "_", fn.left(f("ts"), 10))
    t = Template("j_04", {"id": f("k"), "clicked": fn.lookup(key, "amount")}, {"id": "id", "clicked": "clicked"}, [Rule()],
                 {"clicks": Lookup(fn.concat(f("user"), "_", f("day")), {"amount": f("value")}, f("type") == "click")})
    return t.run(log(spark, sf)).output()


@query("j_05_map_join", SALES + "SELECT CAST(k AS VARCHAR) AS id, CASE WHEN c_name IS NULL THEN cust ELSE c_name END AS buyer FROM sales LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS cust, c_name FROM customer WHERE c_nationkey < 20) USING (cust)")
def _(spark, sf):
    names = table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("label"))
    df = sales(spark, sf).select(F.col("k").cast("string").alias("id"), "cust")
    return map_join(df, "cust", names, "code", "label", "buyer").select("id", "buyer")


@query("j_06_two_hops", "SELECT CAST(c_custkey AS VARCHAR) AS id, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    nation = with_provenance(table(spark, sf, "nation"), "nation", F.col("n_nationkey"))
    region = with_provenance(table(spark, sf, "region"), "region", F.col("r_regionkey"))
    as_text = lambda df: df.select(*[F.col(c) if c.startswith("_") else F.col(c).cast("string").alias(c) for c in df.columns])
    c = as_text(table(spark, sf, "customer"))
    one = keyed_join(c, as_text(nation), f("c_nationkey"), Lookup(f("n_nationkey"), {"name": f("n_name"), "region": f("n_regionkey")}), "n")
    two = keyed_join(one, as_text(region), f("n_region"), Lookup(f("r_regionkey"), {"name": f("r_name")}), "r")
    return two.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def stacked(spark, sf):
    """Customers and orders in one statement, told apart by a marker column."""
    c = table(spark, sf, "customer").select(
        F.lit("customer").alias("_type"), F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.lit("").alias("order_id"), F.lit("").alias("amount"), (F.col("c_custkey") + 1).alias("n"),
    )
    o = sales(spark, sf).select(
        F.lit("order").alias("_type"), F.col("cust").alias("customer_id"), F.lit("").alias("name"), F.lit("").alias("segment"),
        F.col("k").cast("string").alias("order_id"), F.col("total").alias("amount"), (F.col("k") + 10**9).alias("n"),
    )
    return with_provenance(c.unionByName(o), "joined.csv", F.col("n"), "joined")


@query("j_07_stacked_tables", SALES + f"SELECT CAST(k AS VARCHAR) AS order_id, cust AS customer_id, coalesce(c_name, '') AS customer_name, coalesce(c_mktsegment, '') AS customer_segment, {D('cents')} AS amount FROM sales LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = cust")
def _(spark, sf):
    names = ("order_id", "customer_id", "customer_name", "customer_segment", "amount")
    t = Template(
        "j_07", {"order_id": f("order_id"), "customer_id": f("customer_id"), "amount": f("amount"),
                 "customer_name": fn.lookup(f("customer_id"), "name"), "customer_segment": fn.lookup(f("customer_id"), "segment")},
        {n: n for n in names}, [Rule(f("_type") == "order")],
        {"customers": Lookup(f("customer_id"), {"name": f("name"), "segment": f("segment")}, f("_type") == "customer")},
    )
    return t.run(stacked(spark, sf)).output()


@query("f_lookup", ACT + f""", t AS (SELECT type, day, max_by(cents, rn) AS c FROM activity GROUP BY 1, 2)
  SELECT CAST(k AS VARCHAR) AS id, {D('c')} AS v, '' AS miss FROM activity JOIN t USING (type, day)""")
def _(spark, sf):
    t = Template("f_lookup", {"id": f("k"), "v": fn.lookup(fn.concat(f("type"), f("day")), "v"), "miss": fn.lookup(fn.concat("no ", f("type")), "v")},
                 {"id": "id", "v": "v", "miss": "miss"}, [Rule()], {"b": Lookup(fn.concat(f("type"), f("day")), {"v": f("value")})})
    return t.run(log(spark, sf)).output()


@query("g_01_last_value", ACT + 'SELECT "user" AS who, type, arg_max(cents, rn) AS cents FROM activity GROUP BY 1, 2')
def _(spark, sf):
    return last_value(activity(spark, sf).withColumnRenamed("user", "who"), ["who", "type"], "cents", "_record_num")
