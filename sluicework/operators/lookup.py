"""Keyed lookups: join each row to the last row of the same source that carries its key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val, canonical, truthy, val


@dataclass
class Lookup:
    """A build side: the rows that define values, their key and the values themselves."""

    key: Val
    values: dict[str, Val]
    when: Val | bool = True

    def __post_init__(self):
        self.key, self.when = val(self.key), val(self.when)
        self.values = {k: val(v) for k, v in self.values.items()}

    def parents(self) -> list[Val]:
        return [self.key, self.when, *self.values.values()]


def place(df: DataFrame) -> str:
    """The column that says which of two rows of a file comes later: its record number, or its place in the scan."""
    return "_order" if "_order" in df.columns else "_record_num"


def entries(df: DataFrame, lookup: Lookup, scope=("_file",)) -> DataFrame:
    """Every definition a source makes, before later ones overwrite earlier ones."""
    if any(p.lookups for p in lookup.parents()):
        raise ValueError("a lookup's own expressions cannot use lookups")
    order = place(df)
    raw = df.filter(F.coalesce(truthy(lookup.when), F.lit(False))).select(
        *scope, order, lookup.key.col.alias("_k"), *[v.col.alias(f"_v{i}") for i, v in enumerate(lookup.values.values())]
    )
    kinds = list(lookup.values.values())
    key = Val(F.col("_k"), lookup.key.kind)
    return raw.select(
        *scope,
        order,
        canonical(key).alias("_key"),
        *[
            canonical(Val(F.col(f"_v{i}"), kinds[i].kind)).alias(name)
            for i, name in enumerate(lookup.values)
        ],
    ).filter(F.col("_key") != "")


def build_side(df: DataFrame, lookup: Lookup, scope=("_file",)) -> DataFrame:
    """One row per key. Each value keeps its own last definition that did not fail."""
    e = entries(df, lookup, scope)
    last = [
        F.expr(f"max_by(`{n}`, {place(df)}) FILTER (WHERE `{n}` IS NOT NULL)").alias(n) for n in lookup.values
    ]
    return e.groupBy(*scope, "_key").agg(*last)


def probe(df: DataFrame, build: DataFrame, key: Val, prefix: str, scope=("_file",)) -> DataFrame:
    """Left join ``build``; its values arrive as ``<prefix>_<name>``.

    Both sides also join on a bucket of the key. The build side is the output of
    an aggregate, and Spark splits a skewed partition only when the join reads
    straight from a shuffle: the extra key makes it shuffle the (small) build
    side again, so a hot key is split at run time instead of filling one task.
    Blank keys match nothing and join as NULL.
    """
    names = [c for c in build.columns if c not in (*scope, "_key")]
    spelled = canonical(Val(F.col(f"{prefix}_raw"), key.kind))
    left = df.withColumn(f"{prefix}_raw", key.col).withColumn(f"{prefix}_key", F.nullif(spelled, F.lit("")))
    left = left.withColumn(f"{prefix}_b", F.pmod(F.hash(f"{prefix}_key"), F.lit(1))).drop(f"{prefix}_raw")
    right = build.select(
        *[F.col(s).alias(f"{prefix}_s_{s}") for s in scope],
        F.col("_key").alias(f"{prefix}_rk"),
        F.pmod(F.hash("_key"), F.lit(1)).alias(f"{prefix}_rb"),
        *[F.col(f"`{n}`").alias(f"{prefix}_{n}") for n in names],
    )
    on = (F.col(f"{prefix}_key") == F.col(f"{prefix}_rk")) & (F.col(f"{prefix}_b") == F.col(f"{prefix}_rb"))
    for s in scope:
        on = on & (F.col(s) == F.col(f"{prefix}_s_{s}"))
    gone = [f"{prefix}_key", f"{prefix}_b", f"{prefix}_rk", f"{prefix}_rb", *[f"{prefix}_s_{s}" for s in scope]]
    return left.join(right, on, "left").drop(*gone)


def keyed_join(fact: DataFrame, dim: DataFrame, fact_key: Val, lookup: Lookup, prefix="dim") -> DataFrame:
    """Two tables joined directly: the last dimension row per key wins, misses answer ''."""
    side = build_side(dim, lookup, scope=())
    out = probe(fact, side, fact_key, prefix, scope=())
    return out.withColumns({f"{prefix}_{n}": F.coalesce(F.col(f"`{prefix}_{n}`"), F.lit("")) for n in lookup.values})


def last_value(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Last non-NULL value per key, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.expr(f"max_by(`{value}`, `{order}`) FILTER (WHERE `{value}` IS NOT NULL)").alias(value))


@dataclass
class Lookups:
    """The named blocks of a template."""

    blocks: dict[str, Lookup] = field(default_factory=dict)

    def resolve(self, name: str | None) -> str:
        if name is None:
            if len(self.blocks) != 1:
                raise ValueError("lookup(key, field) needs exactly one lookup block")
            return next(iter(self.blocks))
        if name not in self.blocks:
            raise ValueError(f"unknown lookup block {name!r}")
        return name
