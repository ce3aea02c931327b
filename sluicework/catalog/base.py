"""Query registry and the dirty text tables the queries derive from the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import register_functions, text
from ..session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Lines of a JSON array file, about: one task makes it and one reads it.
ARRAY_LINES = 10_000


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            register_functions(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_json_arrays(spark, lines: DataFrame, label: str, other_items: str = "") -> str:
    """Files that hold one JSON array each, made from the texts of ``line``; returns the folders' pattern."""
    path = scratch_dir(spark, label)
    files = max(4, -(-lines.count() // ARRAY_LINES))
    bucket = F.pmod(F.xxhash64("line"), F.lit(files))
    body = F.concat(F.lit("[" + other_items), F.array_join(F.collect_list("line"), ",\n"), F.lit("]"))
    lines.groupBy(bucket.alias("b")).agg(body.alias("line")).write.partitionBy("b").text(path)
    return f"{path}/*"


def spread_rows(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer partitions than there are cores is spread over them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scalars(name: str, source: str, build, sql: dict[str, str] | None, keys: str = "k") -> None:
    """Register column functions over one derived table.

    ``build`` returns the values once a session runs; ``sql`` spells the same
    columns for the oracle.
    """
    make, cte = SOURCES[source]
    key_list = keys.split(",")

    def run(spark, sf_dir):
        df = make(spark, sf_dir)
        return df.select(*key_list, *[text(v).alias(c) for c, v in build().items()])

    oracle = None
    if sql is not None:
        cols = ", ".join(f"{e} AS {c}" for c, e in sql.items())
        oracle = f"WITH {source} AS ({cte}) SELECT {keys}, {cols} FROM {source}"
    query(name, oracle)(run)


def digits(e: str, d: int = 2) -> str:
    """SQL text of an integer scaled by 10^d, written the canonical way."""
    p = 10**d
    return (
        f"(CASE WHEN ({e}) < 0 THEN '-' ELSE '' END || rtrim(rtrim(CAST(abs({e}) // {p} AS VARCHAR) || '.' || "
        f"lpad(CAST(abs({e}) % {p} AS VARCHAR), {d}, '0'), '0'), '.'))"
    )


# ---------------------------------------------------------------- derived tables


def _money(cents):
    return F.concat((F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def items(spark, sf_dir):
    """Line items as a statement export: one amount in many spellings."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    li = spread_rows(li)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    df = li.select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("ln"),
        cents.alias("cents"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship"),
    )
    plain = _money(F.col("cents"))
    us = F.concat(F.format_number(F.floor(F.col("cents") / 100), 0), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    df = df.withColumns({"plain": plain, "us": us})
    return df.withColumns(
        {
            "eu": F.translate("us", ",.", ".,"),
            "paren": F.when(F.col("flag") == "R", F.concat(F.lit("("), F.col("us"), F.lit(")"))).otherwise(F.col("us")),
            "signed": F.when(F.col("flag") == "R", F.concat(F.lit("-"), F.col("plain"))).otherwise(F.col("plain")),
            "price": F.when(F.col("status") == "O", F.concat(F.lit("$"), F.col("plain"))).otherwise(
                F.concat(F.col("plain"), F.lit(" EUR"))
            ),
            "rate": F.when(F.col("flag") == "A", F.concat(F.col("disc").cast("string"), F.lit("%")))
            .when(F.col("flag") == "N", F.concat((F.col("tax") * 100).cast("string"), F.lit(" bps")))
            .otherwise(F.concat(F.lit("0.0"), F.col("disc").cast("string"))),
            "dirty": F.when(F.col("ln") == 3, F.lit("n/a")).when(F.col("ln") == 4, F.lit("")).when(
                F.col("ln") == 5, F.lit("NaN")
            ).otherwise(F.col("plain")),
            "qty": F.col("q").cast("string"),
        }
    )


ITEMS_SQL = """
  SELECT *, translate(us, ',.', '.,') AS eu,
    CASE WHEN flag = 'R' THEN '(' || us || ')' ELSE us END AS paren,
    CASE WHEN flag = 'R' THEN '-' || plain ELSE plain END AS signed,
    CASE WHEN flag = 'R' THEN -cents ELSE cents END AS sc,
    CASE WHEN status = 'O' THEN '$' || plain ELSE plain || ' EUR' END AS price,
    CASE WHEN flag = 'A' THEN disc || '%' WHEN flag = 'N' THEN (tax * 100) || ' bps' ELSE '0.0' || disc END AS rate,
    CASE WHEN ln = 3 THEN 'n/a' WHEN ln = 4 THEN '' WHEN ln = 5 THEN 'NaN' ELSE plain END AS dirty,
    CAST(q AS VARCHAR) AS qty
  FROM (SELECT *, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS plain,
      format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS us
    FROM (SELECT l_orderkey AS k, l_linenumber AS ln, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
      CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS disc,
      CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag AS flag, l_linestatus AS status,
      strftime(l_shipdate, '%Y-%m-%d') AS ship, CAST(l_shipdate AS DATE) AS d FROM lineitem))"""


def sales(spark, sf_dir):
    """Orders with dates in several spellings and blanks in some keys."""
    o = spread_rows(table(spark, sf_dir, "orders"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    day = F.col("o_orderdate")
    secs = (F.col("o_orderkey") % 86400).cast("int")
    ts = F.date_format(F.timestamp_seconds(F.unix_timestamp(day) + secs), "yyyy-MM-dd HH:mm:ss")
    return o.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").cast("string").alias("cust"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("prio"),
        cents.alias("cents"),
        _money(cents).alias("total"),
        F.date_format(day, "yyyy-MM-dd").alias("day"),
        F.date_format(day, "dd.MM.yyyy").alias("dmy"),
        F.date_format(day, "M/d/yyyy").alias("mdy"),
        F.date_format(day, "d MMM yyyy").alias("mon"),
        ts.alias("ts"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).when(F.col("o_orderkey") % 11 == 0, F.lit("soon")).otherwise(
            F.date_format(day, "yyyy-MM-dd")
        ).alias("maybe"),
        (F.col("o_orderkey") % 23 - 11).cast("string").alias("n"),
    )


SALES_SQL = """
  SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status, o_orderpriority AS prio,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    (CAST(round(o_totalprice * 100) AS BIGINT) // 100) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS total,
    CAST(o_orderdate AS DATE) AS d,
    strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d.%m.%Y') AS dmy,
    strftime(o_orderdate, '%-m/%-d/%Y') AS mdy, strftime(o_orderdate, '%-d %b %Y') AS mon,
    strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS ts,
    CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS t,
    CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS maybe,
    o_orderkey % 23 - 11 AS n
  FROM orders"""


def activity(spark, sf_dir):
    """Events as a log export in one file, numbered in event order."""
    e = spread_rows(table(spark, sf_dir, "events"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    return e.select(
        F.col("event_id").alias("k"),
        (F.col("event_id") + 1).alias("_record_num"),
        F.col("user_id").cast("string").alias("user"),
        F.col("event_type").alias("type"),
        cents.alias("cents"),
        _money(cents).alias("value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.substring(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), 1, 10).alias("day"),
        F.col("props"),
    )


ACTIVITY_SQL = """
  SELECT event_id AS k, event_id + 1 AS rn, CAST(user_id AS VARCHAR) AS "user", event_type AS type,
    CAST(round(value * 100) AS BIGINT) AS cents,
    (CAST(round(value * 100) AS BIGINT) // 100) || '.' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS value,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, date_trunc('second', ts) AS t, strftime(ts, '%Y-%m-%d') AS day, props
  FROM events"""


def prose(spark, sf_dir):
    return spread_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text", "lang", "source"))


PROSE_SQL = "SELECT doc_id AS k, text, lang, source FROM documents"


def links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), "url", "html")


LINKS_SQL = "SELECT page_id AS k, url, html FROM pages"


def clients(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("k"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"),
    )


CLIENTS_SQL = """SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation,
  CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer"""


def goods(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("k"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").cast("string").alias("size"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"),
    )


GOODS_SQL = """SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size,
  CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part"""

SOURCES = {
    "items": (items, ITEMS_SQL),
    "sales": (sales, SALES_SQL),
    "activity": (activity, ACTIVITY_SQL),
    "prose": (prose, PROSE_SQL),
    "links": (links, LINKS_SQL),
    "clients": (clients, CLIENTS_SQL),
    "goods": (goods, GOODS_SQL),
}
