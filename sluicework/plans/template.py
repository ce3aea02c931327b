"""A conversion template and the tables one run of it produces."""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.values import TEXT, Val, canonical_text, register_functions, text, val
from ..operators.daterange import in_range
from ..operators.lookup import Lookup, Lookups, build_side, entries, probe
from ..operators.provenance import prepare
from ..operators.rules import Rule, base_used, choose, emit_count, rule_index
from ..session import scratch_dir, session_conf


def exact_names(df: DataFrame):
    """Column names match letter for letter while a plan is built."""
    return session_conf(df.sparkSession, {"spark.sql.caseSensitive": "true"})


def _exact(method):
    @functools.wraps(method)
    def run(self, *args, **kwargs):
        register_functions(self.source.sparkSession)
        with exact_names(self.source):
            return method(self, *args, **kwargs)

    return run


__all__ = ["Audit", "Lookup", "Rule", "Run", "Template"]


@dataclass
class Template:
    """What to read, how to route rows and which columns to write.

    ``variables`` read source fields only. ``rules`` are tried in order; without
    rules nothing is written. ``output`` maps headers to variables.
    """

    name: str
    variables: dict[str, Val]
    output: dict[str, str]
    rules: list[Rule] = field(default_factory=lambda: [Rule()])
    lookups: dict[str, Lookup] = field(default_factory=dict)
    date_range: str | None = None  # the variable a file-name date range applies to

    def __post_init__(self):
        self.variables = {k: val(v) for k, v in self.variables.items()}
        known = set(self.variables)
        extra = {k for r in self.rules for row in r.rows for k in row} - known
        for name in extra:
            if not all(name in row for r in self.rules for row in r.rows):
                raise ValueError(f"{name!r} is only set by some rules and has no base expression")
        missing = set(self.output.values()) - known - extra
        if missing:
            raise ValueError(f"output uses undefined variables: {sorted(missing)}")
        if self.date_range and self.date_range not in known | extra:
            raise ValueError("the date range needs a date variable")
        blocks = Lookups(self.lookups)
        for p in self._probes():
            blocks.resolve(p.block)

    def _vals(self) -> list[Val]:
        out = list(self.variables.values())
        for r in self.rules:
            out.append(r.when)
            out += [v for row in r.rows for v in row.values()]
        return out

    def _probes(self):
        return {p.key: p for v in self._vals() for p in v.lookups}.values()

    def fields(self) -> set[str]:
        """Source columns the template reads by name."""
        parents = self._vals() + [p for lk in self.lookups.values() for p in lk.parents()]
        return set().union(*(v.fields for v in parents)) if parents else set()

    def run(self, df: DataFrame) -> "Run":
        if self.lookups and not {"_record_num", "_order"} & set(df.columns):
            raise ValueError("lookups need _record_num or _order to tell which row is the last one")
        with exact_names(df):
            return Run(self, prepare(df, self.fields()))


class Run:
    """Lazy tables of one run: the output and the audit over the same rows."""

    def __init__(self, template: Template, source: DataFrame):
        self.template = template
        self.source = source

    # ------------------------------------------------------------ stages

    def _joined(self) -> DataFrame:
        t, df = self.template, self.source
        blocks, sides = Lookups(t.lookups), {}
        for p in t._probes():
            name = blocks.resolve(p.block)
            if name not in sides:  # one build side per block, whatever probes it
                sides[name] = build_side(self.source, t.lookups[name])
            df = probe(df, sides[name], p.probe, p.prefix)
        return df

    def _date_override(self) -> bool:
        return any(self.template.date_range in row for r in self.template.rules for row in r.rows)

    def routed(self) -> DataFrame:
        """One row per source row with its rule, the rows it will emit and why it is dropped."""
        t = self.template
        df = self._joined()
        early = t.date_range is not None and not self._date_override()
        rule = rule_index(t.rules)
        if early:
            df = _with_date(df, "_date", text(t.variables[t.date_range]))
            df = df.withColumn("_date_ok", _once(in_range(F.col("_date"), F.col("_stem")))).drop("_date")
            rule = F.when(F.col("_date_ok"), rule)
        df = df.withColumn("_rule", rule)
        n = emit_count(t.rules, F.col("_rule"))
        reason = F.when(F.col("_rule").isNull(), F.lit("no_rule_match")).when(n == 0, F.lit("rule_skip"))
        if early:
            reason = F.when(~F.col("_date_ok"), F.lit("date_filter_from_filename")).otherwise(reason)
        return df.withColumns({"_n": n, "_reason": reason})

    def _emitted(self) -> DataFrame:
        t = self.template
        df = self.routed().filter("_n > 0")
        if all(len(r.rows) <= 1 for r in t.rules):
            df = df.withColumn("_emit_pos", F.lit(0))
        else:
            df = df.withColumn("_emit_pos", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        if t.date_range is not None and self._date_override():
            date = choose(t.rules, t.date_range, t.variables.get(t.date_range), F.col("_rule"), F.col("_emit_pos"), text)
            df = _with_date(df, "_date", date)
            df = df.withColumn("_date_ok", _once(in_range(F.col("_date"), F.col("_stem")))).drop("_date")
        return df

    def _kept(self) -> DataFrame:
        df = self._emitted()
        return df.filter("_date_ok") if "_date_ok" in df.columns else df

    def _variable(self, name: str) -> tuple[Column, bool]:
        """A variable's text and whether it still has to be canonicalised."""
        t = self.template
        base = t.variables.get(name)
        parts = [base] if base is not None else []
        parts += [row[name] for r in t.rules for row in r.rows if name in row]
        done = all(p.kind != TEXT or p.numeric is not None or _settled(p) for p in parts)
        return choose(t.rules, name, base, F.col("_rule"), F.col("_emit_pos"), text), not done

    # ------------------------------------------------------------ one pass

    @_exact
    def audited(self, path: str | None = None) -> "Audit":
        """Runs the conversion once and writes everything it tells, row by row; all tables are read from that.

        One record per emitted row, or one for a row that emits nothing: what became of it (`_fate`:
        kept, dropped or late, by the date range of the file name), the reason, the written cells, the
        cells that failed, and the source row where no rule matched. Totals are observed on the way.
        path: where to write; a folder in the shared scratch place if none is given.
        """
        t, rule, pos = self.template, F.col("_rule"), F.col("_emit_pos")
        df = self.routed().withColumn("_emit_pos", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n"), F.lit(1)) - 1)))
        kept = F.col("_n") > 0
        if t.date_range is not None and self._date_override():
            df = _with_date(df, "_date", choose(t.rules, t.date_range, t.variables.get(t.date_range), rule, pos, text))
            df = df.withColumn("_late", F.when(kept, ~in_range(F.col("_date"), F.col("_stem"))).otherwise(F.lit(False))).drop("_date")
        else:
            df = df.withColumn("_late", F.lit(False))
        df = df.withColumn("_fate", F.when(~kept, F.lit("dropped")).when(F.col("_late"), F.lit("late")).otherwise(F.lit("kept")))
        is_kept = F.col("_fate") == "kept"
        used, cols, pending = list(dict.fromkeys(t.output.values())), [], []
        for i, name in enumerate(used):
            c, canon = self._variable(name)
            cols.append(F.when(is_kept, c).alias(f"_v{i}"))
            pending.append(canon)
        source = F.when(F.col("_reason") == "no_rule_match", F.struct(*[F.col(f"`{c}`") for c in self.source.columns]))
        tests = F.when(is_kept, F.array_compact(F.array(*self._failures()))) if self._failures() else F.lit(None)
        cells = "array<struct<variable:string,origin:string,emit_pos:int>>"
        at = ["_file", "_stem", "_record_num", "_emit_pos", "_rule", "_n", "_fate"]
        df = df.select(
            *at, F.when(F.col("_late"), F.lit("date_filter_from_filename")).otherwise(F.col("_reason")).alias("_reason"), *cols,
            tests.cast(cells).alias("_cells"), F.when(pos == 0, self._failed_variables()).otherwise(F.lit(0)).cast("bigint").alias("_failed"), source.alias("_source"),
        )
        settled = [canonical_text(F.col(f"_v{i}")) if canon else F.col(f"_v{i}") for i, canon in enumerate(pending)]
        df = df.withColumns({f"_v{i}": F.when(is_kept, F.coalesce(c, F.lit(""))) for i, c in enumerate(settled)})
        seen = Observation(f"audit-{uuid.uuid4().hex}")
        df = df.observe(seen, *[c.alias(n) for n, c in _totals().items()])
        path = path or scratch_dir(df.sparkSession, "audit")
        df.write.parquet(path)
        return Audit(t, df.sparkSession.read.schema(df.schema).parquet(path), seen.get, list(self.source.columns))

    def _failed_variables(self) -> Column:
        """How many variables fail on a row; every variable counts, written or not."""
        t, failed = self.template, F.lit(0)
        for n, base in t.variables.items():
            if base is not None and base.const is None:
                failed = failed + (base_used(t.rules, n, F.col("_rule")) & base.col.isNull()).cast("int")
        return F.coalesce(failed, F.lit(0))

    # ------------------------------------------------------------ tables

    @_exact
    def output(self, with_order: bool = False) -> DataFrame:
        """The converted rows. ``with_order`` keeps file, record number and emit position."""
        t = self.template
        used = list(dict.fromkeys(t.output.values()))
        order = ["_file", "_stem", "_record_num", "_emit_pos", "_rule"] if with_order else []
        cols, pending = [], {}
        for i, name in enumerate(used):
            c, pending[name] = self._variable(name)
            cols.append(c.alias(f"_v{i}"))
        raw = self._kept().select(*order, *cols)
        at = {name: F.col(f"_v{i}") for i, name in enumerate(used)}
        return raw.select(
            *order,
            *[
                F.coalesce(canonical_text(at[v]) if pending[v] else at[v], F.lit("")).alias(header)
                for header, v in t.output.items()
            ],
        )

    @_exact
    def outcomes(self) -> DataFrame:
        """One record per emitted row: where it came from and which rule made it."""
        return self._kept().select(
            "_file", "_record_num", "_emit_pos", "_rule", F.lit("emit").alias("action")
        )

    @_exact
    def filtered(self) -> DataFrame:
        """One record per dropped row with the reason."""
        t = self.template
        cols = ["_file", "_record_num", "_rule", "_reason"]
        out = self.routed().filter("_reason IS NOT NULL").select(*cols)
        if t.date_range is not None and self._date_override():
            late = self._emitted().filter("NOT _date_ok")
            out = out.unionByName(late.withColumn("_reason", F.lit("date_filter_from_filename")).select(*cols))
        return out

    @_exact
    def unmatched(self) -> DataFrame:
        """The source row of every row no rule matched."""
        return self.routed().filter("_reason = 'no_rule_match'").select(*self.source.columns)

    def _failures(self) -> list[Column]:
        """For each expression: its cell where it fails, else NULL."""
        t = self.template
        rule, pos = F.col("_rule"), F.col("_emit_pos")
        names = list(dict.fromkeys([*t.output.values(), *t.variables, *(n for r in t.rules for row in r.rows for n in row)]))
        tests = []
        for n in names:
            base = t.variables.get(n)
            if base is not None and base.const is None:
                first = F.when((pos == 0) & base_used(t.rules, n, rule) & base.col.isNull(), _cell(n, "variable", -1))
                tests.append(first)
            for i, r in enumerate(t.rules):
                for p, row in enumerate(r.rows):
                    if n in row and row[n].const is None:
                        hit = (rule == i) & (pos == p) & row[n].col.isNull()
                        tests.append(F.when(hit, _cell(n, "override", p)))
        return tests

    @_exact
    def errors(self) -> DataFrame:
        """One record per failing cell: variable and where its expression stands."""
        tests = self._failures() or [F.when(F.lit(False), _cell("", "", 0))]
        cells = self._kept().select("_file", "_record_num", "_rule", F.array_compact(F.array(*tests)).alias("cells"))
        cells = cells.select("_file", "_record_num", "_rule", F.explode("cells").alias("c"))
        return cells.select("_file", "_record_num", "_rule", "c.variable", "c.origin", "c.emit_pos")

    @_exact
    def lookup_dump(self) -> DataFrame:
        """Every lookup definition in build order, overwritten ones included."""
        out = None
        for block, lk in self.template.lookups.items():
            e = entries(self.source, lk)
            part = e.unpivot(["_file", "_record_num", "_key"], list(lk.values), "field", "value").filter("value IS NOT NULL")
            part = part.withColumn("block", F.lit(block))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("the template has no lookups")
        return out.select("_file", "_record_num", "block", F.col("_key").alias("key"), "field", "value")

    @_exact
    def counters(self) -> DataFrame:
        """Rows in, rows out, drops by reason and counted errors per file, in one pass."""
        t = self.template
        rule = F.col("_rule")
        df = self.routed()
        if t.date_range is not None and self._date_override():
            flags = None
            for i, r in enumerate(t.rules):
                hits = F.lit(0)
                for p in range(len(r.rows)):
                    v = r.rows[p].get(t.date_range, t.variables.get(t.date_range))
                    df = _with_date(df, f"_date_{i}_{p}", text(v))
                    hits = hits + in_range(F.col(f"_date_{i}_{p}"), F.col("_stem")).cast("int")
                flags = F.when(rule == i, hits) if flags is None else flags.when(rule == i, hits)
            emitted = flags.otherwise(F.lit(0)) if flags is not None else F.lit(0)
        else:
            emitted = F.when(F.col("_reason").isNull(), F.col("_n")).otherwise(F.lit(0))

        def count(reason):
            return F.sum((F.col("_reason") == reason).cast("bigint"))

        zero = F.lit(0).cast("bigint")
        return df.groupBy("_file").agg(
            F.count(F.lit(1)).alias("rows_in"),
            F.sum(emitted.cast("bigint")).alias("rows_out"),
            F.coalesce(count("no_rule_match"), zero).alias("no_rule_match"),
            F.coalesce(count("rule_skip"), zero).alias("rule_skip"),
            F.coalesce(count("date_filter_from_filename"), zero).alias("date_filtered"),
            F.sum(self._failed_variables().cast("bigint")).alias("errors"),
        ).withColumn("template", F.lit(t.name))

    def summary(self) -> DataFrame:
        """The run as one document per template."""
        return _summary(self.counters())


_COUNTED = ["rows_in", "rows_out", "no_rule_match", "rule_skip", "date_filtered", "errors"]


def _summary(counters: DataFrame) -> DataFrame:
    total = counters.groupBy("template").agg(F.count(F.lit(1)).alias("files"), *[F.sum(n).alias(n) for n in _COUNTED])
    return total.withColumn("document", F.to_json(F.struct("template", "files", *_COUNTED)))


def _totals() -> dict[str, Column]:
    """The counters as aggregates over the records of an audit."""
    reason = F.col("_reason")
    tests = {
        "rows_in": F.col("_emit_pos") == 0, "rows_out": F.col("_fate") == "kept", "no_rule_match": reason == "no_rule_match",
        "rule_skip": reason == "rule_skip", "date_filtered": (reason == "date_filter_from_filename") & (F.col("_fate") == "dropped"),
    }
    counted = {n: F.count_if(c) for n, c in tests.items()}
    return {**counted, "errors": F.coalesce(F.sum("_failed"), F.lit(0).cast("bigint"))}


class Audit:
    """The tables of one finished run, all read from its records. The input is not read again.

    totals: the counters of the whole run, observed while the records were written.
    """

    def __init__(self, template: Template, records: DataFrame, totals: dict, columns: list[str]):
        self.template, self.records, self.totals, self._columns = template, records, totals, columns

    def _kept(self) -> DataFrame:
        return self.records.filter("_fate = 'kept'")

    def output(self, with_order: bool = False) -> DataFrame:
        order = ["_file", "_stem", "_record_num", "_emit_pos", "_rule"] if with_order else []
        place = {name: f"_v{i}" for i, name in enumerate(dict.fromkeys(self.template.output.values()))}
        return self._kept().select(*order, *[F.col(place[v]).alias(header) for header, v in self.template.output.items()])

    def outcomes(self) -> DataFrame:
        return self._kept().select("_file", "_record_num", "_emit_pos", "_rule", F.lit("emit").alias("action"))

    def filtered(self) -> DataFrame:
        return self.records.filter("_fate <> 'kept'").select("_file", "_record_num", "_rule", "_reason")

    def unmatched(self) -> DataFrame:
        return self.records.filter("_reason = 'no_rule_match'").select(*[F.col("_source").getField(c).alias(c) for c in self._columns])

    def errors(self) -> DataFrame:
        cells = self._kept().select("_file", "_record_num", "_rule", F.explode("_cells").alias("c"))
        return cells.select("_file", "_record_num", "_rule", "c.variable", "c.origin", "c.emit_pos")

    def counters(self) -> DataFrame:
        counted = self.records.groupBy("_file").agg(*[c.cast("bigint").alias(n) for n, c in _totals().items()])
        return counted.withColumn("template", F.lit(self.template.name))

    def summary(self) -> DataFrame:
        return _summary(self.counters())


def _with_date(df: DataFrame, name: str, date: Column) -> DataFrame:
    """A date text as its own column first: the range test reads it several times."""
    return df.withColumn(name, date).withColumn(name, F.coalesce(canonical_text(F.col(name)), F.lit("")))


def _once(test: Column) -> Column:
    """A test that filters read. Spark spells a filter out in the columns below, again wherever it reads one, unless a
    generator lies between: the one row it makes holds the outcome."""
    return F.explode(F.array(test))


def _settled(v: Val) -> bool:
    """A literal whose canonical text is itself."""
    return isinstance(v.const, str) and not any(ch.isdigit() or ch == "." for ch in v.const)


def _cell(name: str, origin: str, pos: int) -> Column:
    return F.struct(F.lit(name).alias("variable"), F.lit(origin).alias("origin"), F.lit(pos).alias("emit_pos"))
