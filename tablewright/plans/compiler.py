"""A bound plan as a DataFrame: scans, joins, one conjunction, then rows or groups, order and limit.

Catalyst does the rest: it prunes columns, pushes the conjuncts into the scans, and picks the joins.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_ascii
from .binder import BoundPlan
from .contracts import Measure

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(column: Column, pattern: str) -> Column:
    """LIKE that folds A-Z only and has no escape character."""
    return fold_ascii(column.cast("string")).like(pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\"))


def predicate(column: Column, operator: str, value: Any) -> Column:
    simple = {
        "eq": lambda: column == F.lit(value), "neq": lambda: column != F.lit(value),
        "gt": lambda: column > F.lit(value), "gte": lambda: column >= F.lit(value),
        "lt": lambda: column < F.lit(value), "lte": lambda: column <= F.lit(value),
        "in": lambda: column.isin(*value), "not_in": lambda: ~column.isin(*value),
        "like": lambda: like(column, value), "not_like": lambda: ~like(column, value),
        "between": lambda: column.between(F.lit(value[0]), F.lit(value[1])),
        "is_null": lambda: column.isNull(), "is_not_null": lambda: column.isNotNull(),
    }
    return simple[operator]()


def aggregate(m: Measure, column: Column | None) -> Column:
    """The aggregate before rounding; distinct means nothing to min and max."""
    if m.aggregation == "count_all":
        return F.count("*")
    distinct = bool(m.distinct)
    if m.aggregation == "count":
        return F.count_distinct(column) if distinct else F.count(column)
    if m.aggregation == "sum":
        return F.sum_distinct(column) if distinct else F.sum(column)
    if m.aggregation == "avg":
        return F.call_function("avg", column) if not distinct else F.sum_distinct(column) / F.count_distinct(column)
    return (F.min if m.aggregation == "min" else F.max)(column)


def joined(bound: BoundPlan, tables: dict[str, DataFrame]) -> DataFrame:
    """The plan's tables, joined outwards from the first; columns are named table.column."""
    named = {t: tables[t].select(*[F.col(f"`{c}`").alias(f"{t}.{c}") for c in tables[t].columns]) for t in bound.schema.tables}
    base = bound.schema.tables[0]
    out, reached, left = named[base], {base}, list(bound.schema.joins)
    while left:
        join = next(j for j in left if len({j.left.split(".")[0], j.right.split(".")[0]} & reached) == 1)
        left.remove(join)
        new = next(x.split(".")[0] for x in (join.left, join.right) if x.split(".")[0] not in reached)
        kind = join.kind if join.kind == "inner" or new == join.right.split(".")[0] else "right"
        out = out.join(named[new], F.col(f"`{join.left}`") == F.col(f"`{join.right}`"), kind)
        reached.add(new)
    return out


def compile_plan(bound: BoundPlan, tables: dict[str, DataFrame]) -> DataFrame:
    """Dimensions first, then measures, each under its slot's name."""
    spec = bound.spec
    column = lambda slot: F.col(f"`{bound.columns[slot]}`")
    rows = joined(bound, tables)
    tests = [predicate(column(f.slot), f.operator, bound.literals.get(f.slot)) for f in spec.filters]
    if tests:
        rows = rows.filter(reduce(Column.__and__, tests))
    if spec.intent == "existence":
        return rows.limit(1).agg((F.count("*") > 0).cast("int").alias("found"))
    shown = [*spec.dimensions, *spec.measures]
    if spec.shape == "rows":
        out = rows.select(*[column(x.slot).alias(x.slot) for x in shown], *[column(o.by).alias(f"by {o.by}") for o in spec.orders if o.by not in {x.slot for x in shown}])
        out = out.distinct() if spec.distinct_rows else out
        exact = {x.slot: x.slot for x in shown}
    else:
        # orders see the aggregates before they are rounded
        aggregates = [aggregate(m, None if bound.columns[m.slot] is None else column(m.slot)).alias(f"exact {m.slot}") for m in spec.measures]
        out = rows.groupBy(*[column(d.slot).alias(d.slot) for d in spec.dimensions]).agg(*aggregates)
        rounded = {m.slot: F.col(f"exact {m.slot}") if m.precision is None else F.round(f"exact {m.slot}", m.precision) for m in spec.measures}
        out = out.withColumns(rounded)
        exact = {d.slot: d.slot for d in spec.dimensions} | {m.slot: f"exact {m.slot}" for m in spec.measures}
    if spec.orders:
        out = out.orderBy(*[(F.desc if o.descending else F.asc)(exact.get(o.by, f"by {o.by}")) for o in spec.orders])
    if spec.shape != "scalar":
        out = out.limit(spec.limit)
    return out.select(*[x.slot for x in shown])
