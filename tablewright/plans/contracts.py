"""The two halves of a plan, as plain frozen records.

A QuerySpec says what is asked in logical terms; a SchemaPlan says where those terms live.  Each
record checks what it can check alone and raises ValueError; what needs both is the binder's work.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

AGGREGATIONS = ("count_all", "count", "sum", "avg", "min", "max", "none")
SHAPES = ("rows", "scalar", "grouped_rows")
#: Intents and the result shapes each may have.
INTENTS = {"lookup": ("rows",), "ranking": ("rows", "grouped_rows"), "count": ("scalar", "grouped_rows"), "aggregate": ("scalar", "grouped_rows"), "existence": ("scalar",)}
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in", "like", "not_like", "between", "is_null", "is_not_null")
#: Other spellings of the operators.
SYMBOLS = {"=": "eq", "==": "eq", "!=": "neq", "<>": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "not in": "not_in", "not like": "not_like", "is null": "is_null", "is not null": "is_not_null"}
MOST_ROWS = 1000


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Dimension:
    slot: str
    concept: str


@dataclass(frozen=True)
class Measure:
    slot: str
    aggregation: str
    concept: str | None = None
    distinct: bool | None = None
    precision: int | None = None

    def __post_init__(self):
        # count(distinct x) has two common names of its own
        if self.aggregation in ("count_distinct", "distinct_count"):
            object.__setattr__(self, "aggregation", "count")
            object.__setattr__(self, "distinct", True)
        require(self.aggregation in AGGREGATIONS, f"unknown aggregation {self.aggregation}")
        if self.aggregation == "count_all":
            require(self.concept is None and not self.distinct, "count_all takes no column and no distinct")
        else:
            require(self.concept is not None, f"{self.aggregation} needs a column")
        if self.precision is not None:
            require(self.aggregation != "none" and type(self.precision) is int and 0 <= self.precision <= 12, "precision: 0 to 12, of an aggregate")


@dataclass(frozen=True)
class Filter:
    slot: str
    concept: str
    operator: str
    value: Any = None

    def __post_init__(self):
        op = SYMBOLS.get(self.operator.lower(), self.operator.lower())
        object.__setattr__(self, "operator", op)
        require(op in OPERATORS, f"unknown operator {op}")
        if op in ("in", "not_in"):
            require(isinstance(self.value, (list, tuple)) and len(self.value) > 0, f"{op} needs a list that isn't empty")
            object.__setattr__(self, "value", tuple(self.value))
        elif op == "between":
            require(isinstance(self.value, (list, tuple)) and len(self.value) == 2, "between needs two values")
            object.__setattr__(self, "value", tuple(self.value))
        elif op in ("is_null", "is_not_null"):
            require(self.value is None, f"{op} takes no value")
        else:
            require(self.value is not None and not isinstance(self.value, (list, tuple, dict)), f"{op} needs one value")
        if op in ("like", "not_like"):
            require(isinstance(self.value, str), f"{op} needs a pattern")


@dataclass(frozen=True)
class Order:
    by: str
    descending: bool = False


@dataclass(frozen=True)
class QuerySpec:
    intent: str
    shape: str
    dimensions: tuple[Dimension, ...] = ()
    measures: tuple[Measure, ...] = ()
    filters: tuple[Filter, ...] = ()
    orders: tuple[Order, ...] = ()
    limit: int = 20
    distinct_rows: bool = False

    def __post_init__(self):
        require(self.intent in INTENTS and self.shape in SHAPES, "unknown intent or shape")
        require(type(self.limit) is int and 1 <= self.limit <= MOST_ROWS, f"limit: 1 to {MOST_ROWS}")
        require(not self.distinct_rows or self.shape == "rows", "distinct rows are for the shape rows")


@dataclass(frozen=True)
class Join:
    """left and right: qualified columns; kind: inner or left (the left side keeps all rows)."""

    left: str
    right: str
    kind: str = "inner"

    def __post_init__(self):
        require(self.kind in ("inner", "left"), "joins are inner or left")
        require(all(x.count(".") == 1 for x in (self.left, self.right)), "joins need qualified columns")
        require(self.left.split(".")[0] != self.right.split(".")[0], "a table can't join itself")


@dataclass(frozen=True)
class SchemaPlan:
    tables: tuple[str, ...]
    #: Concept to qualified column.
    columns: dict[str, str]
    joins: tuple[Join, ...] = ()
    grain: tuple[str, ...] = ()
    #: Per qualified column: words for values, and the values stored.
    values: dict[str, dict[str, Any]] = field(default_factory=dict)

    def __post_init__(self):
        require(len(self.tables) > 0 and len(set(self.tables)) == len(self.tables), "tables: at least one, each once")
        require(len(self.joins) == len(self.tables) - 1, "n tables need n - 1 joins")
        reached, left = {self.tables[0]}, list(self.joins)
        while left:
            step = next((j for j in left if len({j.left.split(".")[0], j.right.split(".")[0]} & reached) == 1), None)
            require(step is not None, "joins must connect all tables, as a tree")
            reached |= {step.left.split(".")[0], step.right.split(".")[0]}
            left.remove(step)
        require(reached == set(self.tables), "joins name other tables than the plan")


def fingerprint(record: Any) -> str:
    """SHA-256 of the record as JSON with sorted keys."""
    plain = asdict(record) if hasattr(record, "__dataclass_fields__") else record
    return hashlib.sha256(json.dumps(plain, sort_keys=True, ensure_ascii=False, default=str, separators=(",", ":")).encode()).hexdigest()
