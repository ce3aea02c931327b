"""Ordered first-match routing: drop a row, keep it, or fan it out into many."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import Val, truthy, val


@dataclass
class Rule:
    """``rows`` holds one dict of variable overrides per emitted row; no rows means drop."""

    when: Val | bool = True
    rows: list[dict[str, Val]] = field(default_factory=lambda: [{}])

    def __post_init__(self):
        self.when = val(self.when)
        self.rows = [{k: val(v) for k, v in r.items()} for r in self.rows]


def rule_index(rules: list[Rule]) -> Column:
    """Position of the first rule that holds; a failing condition does not match."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(F.coalesce(truthy(rules[i].when), F.lit(False)), F.lit(i)).otherwise(out)
    return out


def emit_count(rules: list[Rule], rule: Column) -> Column:
    sizes = [len(r.rows) for r in rules]
    if not sizes:
        return F.lit(0)
    if len(set(sizes)) == 1:
        return F.when(rule.isNull(), F.lit(0)).otherwise(F.lit(sizes[0]))
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in sizes]), rule), F.lit(0))


def choose(rules: list[Rule], name: str, base: Val | None, rule: Column, pos: Column, as_col) -> Column:
    """The value of a variable for one emitted row: its override, else the base."""
    out, any_override = None, False
    for i, r in enumerate(rules):
        hits = {p: row[name] for p, row in enumerate(r.rows) if name in row}
        if not hits:
            continue
        any_override = True
        if len(hits) == len(r.rows) and len({id(v) for v in hits.values()}) == 1:
            test = rule == i
            out = F.when(test, as_col(hits[0])) if out is None else out.when(test, as_col(hits[0]))
            continue
        for p, v in hits.items():
            test = (rule == i) & (pos == p)
            out = F.when(test, as_col(v)) if out is None else out.when(test, as_col(v))
    default = as_col(base) if base is not None else F.lit("")
    return out.otherwise(default) if any_override else default


def overridden(rules: list[Rule], name: str, rule: Column, pos: Column) -> Column:
    """Whether an emitted row sets ``name`` itself."""
    out = F.lit(False)
    for i, r in enumerate(rules):
        for p, row in enumerate(r.rows):
            if name in row:
                out = out | ((rule == i) & (pos == p))
    return out


def base_used(rules: list[Rule], name: str, rule: Column) -> Column:
    """Whether some emitted row of the matched rule takes the base value."""
    hit = [i for i, r in enumerate(rules) if any(name not in row for row in r.rows)]
    if len(hit) == len(rules):
        return rule.isNotNull()
    return rule.isin(hit) if hit else F.lit(False)
