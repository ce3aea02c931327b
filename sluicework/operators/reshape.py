"""Wide to long, unions of differing shapes, harmonised columns, map joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coalesce as blank_coalesce
from ..functions.values import Val
from .provenance import as_text


def unpivot(df: DataFrame, ids: list[str], columns: dict[str, str], label="label", value="value") -> DataFrame:
    """One output row per listed column, stamped with its label; blanks are kept."""
    cols = [c for c in columns if c in df.columns]
    text = df.select(*ids, *[as_text(df, c).alias(c) for c in cols])
    long = text.unpivot(ids, cols, label, value)
    names = F.create_map(*[F.lit(x) for c in cols for x in (c, columns[c])])
    return long.withColumn(label, names[F.col(label)])


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns; an absent column reads ''."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(
        *[
            F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`")
            for f in out.schema.fields
        ]
    )


def harmonised(*choices: Val) -> Val:
    """The first vintage of a column that holds something."""
    return blank_coalesce(*choices)


def map_join(df: DataFrame, column: str, table: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """Replace whole values through a code table of any size; unknown values pass through.

    The table is reduced to one row per code first. Spark broadcasts it when its
    measured size allows and shuffles otherwise.
    """
    codes = table.groupBy(F.col(source).alias("_code")).agg(F.max(target).alias("_label"))
    codes = codes.withColumn("_b", F.pmod(F.hash("_code"), F.lit(1)))
    left = df.withColumn("_lb", F.pmod(F.hash(column), F.lit(1)))
    joined = left.join(codes, (F.col(column) == F.col("_code")) & (F.col("_lb") == F.col("_b")), "left")
    return joined.withColumn(out, F.coalesce("_label", column)).drop("_code", "_label", "_b", "_lb")
