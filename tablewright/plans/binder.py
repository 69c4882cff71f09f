"""Binding: every slot of a QuerySpec gets its column, or a conflict says who must mend what."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from .contracts import INTENTS, QuerySpec, SchemaPlan, fingerprint


@dataclass(frozen=True)
class Conflict:
    code: str
    slot: str
    #: query: the QuerySpec must change; schema: the SchemaPlan.
    owner: str
    detail: str = ""


@dataclass(frozen=True)
class BoundPlan:
    spec: QuerySpec
    schema: SchemaPlan
    #: Slot to qualified column (None for count_all).
    columns: dict[str, str | None]
    #: Filter slot to values of the column's type.
    literals: dict[str, Any]
    snapshot: str

    @property
    def fingerprint(self) -> str:
        return fingerprint(self)


NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def coerce(value: Any, kind: T.DataType) -> Any:
    """The value as one of the column's type, if that loses nothing; else ValueError."""
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool):
            return value
    elif isinstance(kind, NUMBERS):
        if not isinstance(value, bool) and isinstance(value, (int, float, str, decimal.Decimal)):
            try:
                number = decimal.Decimal(str(value).strip())
            except decimal.InvalidOperation:
                raise ValueError(f"{value!r} is no number") from None
            if not isinstance(kind, WHOLE):
                return float(number) if isinstance(kind, (T.FloatType, T.DoubleType)) else number
            # a fraction against whole numbers stays a number: it compares, and equals nothing
            return int(number) if number == number.to_integral_value() else float(number)
    elif isinstance(kind, T.StringType):
        if isinstance(value, str):
            return value
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, (datetime.date, datetime.datetime)):
            return value
        if isinstance(value, str):
            return datetime.datetime.fromisoformat(value)
    raise ValueError(f"{value!r} can't be compared with {kind.simpleString()}")


def bind(spec: QuerySpec, plan: SchemaPlan, schemas: dict[str, T.StructType], snapshot: str) -> BoundPlan | list[Conflict]:
    """A bound plan, or all conflicts in the order of the slots."""
    found: list[Conflict] = []
    columns: dict[str, str | None] = {}
    literals: dict[str, Any] = {}

    def conflict(code: str, slot: str, owner: str, detail: str = "") -> None:
        found.append(Conflict(code, slot, owner, detail))

    if not snapshot:
        conflict("version_pin_missing", "", "schema")
    slots = [x.slot for x in (*spec.dimensions, *spec.measures, *spec.filters)]
    for slot in sorted({s for s in slots if slots.count(s) > 1}):
        conflict("duplicate_slot_id", slot, "query")
    shape_conflicts(spec, plan, conflict)

    known = {f"{t}.{f.name}": f.dataType for t in plan.tables if t in schemas for f in schemas[t]}
    for name in [t for t in plan.tables if t not in schemas] + [c for c in plan.columns.values() if c not in known]:
        conflict("invalid_schema_binding", name, "schema")
    for join in plan.joins:
        for side in (join.left, join.right):
            if side not in known:
                conflict("invalid_schema_binding", side, "schema", "join")

    def resolve(slot: str, concept: str) -> str | None:
        """Exact column, then the plan's words (case and space folded), then a column name that only one table has."""
        if not concept:
            conflict("missing_logical_reference", slot, "query")
            return None
        if concept in known:
            return concept
        fold = lambda x: " ".join(x.split()).lower()
        named = sorted({c for k, c in plan.columns.items() if fold(k) == fold(concept)})
        named = named or sorted(c for c in known if c.split(".")[1].lower() == fold(concept))
        if len(named) == 1:
            return named[0]
        conflict("ambiguous_schema_binding" if named else "missing_schema_binding", slot, "schema", concept)
        return None

    for d in spec.dimensions:
        columns[d.slot] = resolve(d.slot, d.concept)
    for m in spec.measures:
        columns[m.slot] = None if m.aggregation == "count_all" else resolve(m.slot, m.concept or "")
    for f in spec.filters:
        column = columns[f.slot] = resolve(f.slot, f.concept)
        if column is None or column not in known or f.operator in ("is_null", "is_not_null"):
            continue
        words = plan.values.get(column, {})
        values = f.value if isinstance(f.value, tuple) else (f.value,)
        out = []
        for v in values:
            same = [w for k, w in words.items() if isinstance(v, str) and k.lower() == v.lower()]
            if len({repr(w) for w in same}) > 1:
                conflict("ambiguous_value_binding", f.slot, "schema", str(v))
                continue
            try:
                out.append(coerce(same[0] if same else v, T.StringType() if "like" in f.operator else known[column]))
            except ValueError as e:
                conflict("missing_value_binding", f.slot, "schema", str(e))
        literals[f.slot] = tuple(out) if isinstance(f.value, tuple) else (out[0] if out else None)
    for o in spec.orders:
        if o.by not in columns:
            conflict("missing_logical_reference", o.by, "query", "order")
    if spec.shape == "grouped_rows" and {columns.get(d.slot) for d in spec.dimensions} != set(plan.grain):
        conflict("result_grain_mismatch", "", "schema", f"grain is {plan.grain}")
    return found or BoundPlan(spec, plan, columns, literals, snapshot)


def shape_conflicts(spec: QuerySpec, plan: SchemaPlan, conflict) -> None:
    """Which intents, shapes, dimensions and measures go together."""
    bad = lambda slot, why: conflict("unsupported_query_contract", slot, "query", why)
    aggregates = [m for m in spec.measures if m.aggregation != "none"]
    if spec.shape not in INTENTS[spec.intent]:
        bad("", f"{spec.intent} can't have the shape {spec.shape}")
    if spec.intent == "ranking" and not spec.orders:
        bad("", "a ranking needs an order")
    if spec.shape == "rows":
        if aggregates:
            bad(aggregates[0].slot, "rows have no aggregates")
        if plan.joins:
            conflict("result_grain_mismatch", "", "schema", "rows over a join may repeat")
        if not spec.dimensions and not spec.measures:
            bad("", "nothing to show")
    elif spec.shape == "grouped_rows":
        if not spec.dimensions or not aggregates or len(aggregates) != len(spec.measures):
            bad("", "groups need a dimension and only aggregates")
    elif spec.intent == "existence":
        if spec.measures or spec.dimensions:
            bad("", "existence has neither measures nor dimensions")
    elif spec.dimensions or len(spec.measures) != 1 or len(aggregates) != 1:
        bad("", "a scalar is one aggregate without dimensions")
    for m in spec.measures:
        if m.aggregation in ("count", "sum", "avg") and m.distinct is None:
            bad(m.slot, f"{m.aggregation} must say whether it is distinct")
