"""Contracts, binding and compilation of plans."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablewright.plans.binder import BoundPlan, bind, coerce
from tablewright.plans.compiler import compile_plan
from tablewright.plans.contracts import Dimension, Filter, Join, Measure, Order, QuerySpec, SchemaPlan, fingerprint
from pyspark.sql import types as T


@pytest.fixture(scope="module")
def tables(spark):
    nulls = spark.createDataFrame([(1, 1, 2.5, "a"), (2, 2, None, "B"), (3, None, 3.5, None), (4, 5, 1.25, "ä"), (5, 5, 1.25, "Ä_x\\y")], "id int, i int, r double, s string")
    parent = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    child = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0)], "id int, parent_id int, amt double")
    return {"nulls": nulls, "parent": parent, "child": child, "empty": nulls.limit(0)}


def bound(tables, spec, plan):
    return bind(spec, plan, {n: d.schema for n, d in tables.items()}, "dbs_1")


def run(tables, spec, plan):
    b = bound(tables, spec, plan)
    assert isinstance(b, BoundPlan), b
    return [tuple(r) for r in compile_plan(b, tables).collect()]


def ids(tables, operator, column, value=None):
    spec = QuerySpec("lookup", "rows", (Dimension("id", "nulls.id"),), filters=(Filter("f", f"nulls.{column}", operator, value),), orders=(Order("id"),))
    return [x for (x,) in run(tables, spec, SchemaPlan(("nulls",), {}))]


@pytest.mark.parametrize(
    "operator,column,value,found",
    [
        ("=", "i", "5.0", [4, 5]), ("eq", "i", 1.5, []), ("!=", "i", 5, [1, 2]), (">", "r", 1.25, [1, 3]), (">=", "r", 1.25, [1, 3, 4, 5]), ("<", "i", 2, [1]), ("<=", "i", 2, [1, 2]),
        ("in", "i", [1, 2], [1, 2]), ("not in", "i", [1, 2], [4, 5]), ("like", "s", "b", [2]), ("like", "s", "ä%", [4]), ("like", "s", "%_X\\Y", [5]), ("not like", "s", "b", [1, 4, 5]),
        ("between", "r", [1.25, 2.5], [1, 4, 5]), ("is null", "s", None, [3]), ("is not null", "r", None, [1, 3, 4, 5]),
    ],
)
def test_each_operator_over_nulls(tables, operator, column, value, found):
    assert ids(tables, operator, column, value) == found


def test_fan_out_counts(tables):
    plan = SchemaPlan(("parent", "child"), {}, (Join("parent.id", "child.parent_id", "left"),), ("parent.name",))
    spec = QuerySpec("count", "grouped_rows", (Dimension("name", "name"),), (Measure("n", "count_all"), Measure("kids", "count", "child.id", False), Measure("ids", "count_distinct", "parent.id")), orders=(Order("name"),))
    assert run(tables, spec, plan) == [("x", 2, 2, 1), ("y", 1, 0, 1)]
    turned = SchemaPlan(("child", "parent"), {}, (Join("parent.id", "child.parent_id", "left"),), ("parent.name",))
    assert run(tables, spec, turned) == [("x", 2, 2, 1), ("y", 1, 0, 1)]


def test_aggregates_over_an_empty_table(tables):
    for m, want in ((Measure("v", "count_all"), 0), (Measure("v", "sum", "r", False), None), (Measure("v", "avg", "r", True), None), (Measure("v", "max", "s"), None)):
        assert run(tables, QuerySpec("aggregate", "scalar", measures=(m,)), SchemaPlan(("empty",), {})) == [(want,)]
    assert run(tables, QuerySpec("existence", "scalar"), SchemaPlan(("empty",), {})) == [(0,)]


def test_order_sees_values_before_rounding(spark):
    t = {"t": spark.createDataFrame([("a", 1.04), ("b", 1.01)], "g string, x double")}
    spec = QuerySpec("ranking", "grouped_rows", (Dimension("g", "g"),), (Measure("v", "avg", "x", False, 1),), orders=(Order("v"),))
    assert run(t, spec, SchemaPlan(("t",), {}, (), ("t.g",))) == [("b", 1.0), ("a", 1.0)]


def codes(tables, spec, plan):
    b = bound(tables, spec, plan)
    return set() if isinstance(b, BoundPlan) else {c.code for c in b}


def test_conflicts(tables):
    one = SchemaPlan(("nulls",), {"a b": "nulls.s", "A  B": "nulls.i", "gone": "nulls.nope"}, values={"nulls.s": {"x": "1", "X": "2"}})
    d = (Dimension("id", "nulls.id"),)
    assert codes(tables, QuerySpec("lookup", "rows", d), SchemaPlan(("nulls",), {})) == set()
    found = codes(tables, QuerySpec("lookup", "rows", (*d, Dimension("q", "a b"), Dimension("z", "zzz"), Dimension("e", "")), filters=(Filter("id", "s", "=", "x"), Filter("g", "i", "=", "abc"))), one)
    assert found == {"ambiguous_schema_binding", "missing_schema_binding", "missing_logical_reference", "duplicate_slot_id", "ambiguous_value_binding", "missing_value_binding", "invalid_schema_binding"}
    plan = SchemaPlan(("parent", "child"), {}, (Join("parent.id", "child.parent_id"),), ("parent.name",))
    assert "result_grain_mismatch" in codes(tables, QuerySpec("lookup", "rows", (Dimension("a", "parent.name"),)), plan)
    assert "unsupported_query_contract" in codes(tables, QuerySpec("count", "scalar", measures=(Measure("n", "count", "child.id"),)), plan)
    assert "unsupported_query_contract" in codes(tables, QuerySpec("ranking", "rows", d), SchemaPlan(("nulls",), {}))
    assert {c.code for c in bind(QuerySpec("lookup", "rows", d), SchemaPlan(("nulls",), {}), {"nulls": tables["nulls"].schema}, "")} == {"version_pin_missing"}


@pytest.mark.parametrize(
    "make",
    [
        lambda: Filter("f", "a", "~", 1), lambda: Filter("f", "a", "in", []), lambda: Filter("f", "a", "between", [1]), lambda: Filter("f", "a", "is_null", 1), lambda: Filter("f", "a", "like", 1),
        lambda: Measure("m", "median", "a"), lambda: Measure("m", "count_all", "a"), lambda: Measure("m", "sum"), lambda: Measure("m", "sum", "a", False, 13), lambda: Join("a.x", "a.y"), lambda: Join("a.x", "b.y", "full"),
        lambda: QuerySpec("lookup", "rows", limit=True), lambda: QuerySpec("lookup", "rows", limit=1001), lambda: QuerySpec("count", "scalar", distinct_rows=True),
        lambda: SchemaPlan(("a", "b"), {}), lambda: SchemaPlan(("a", "b", "c"), {}, (Join("a.x", "b.x"), Join("b.y", "a.y"))),
    ],
)
def test_contracts_refuse(make):
    with pytest.raises(ValueError):
        make()


def test_coercion_and_fingerprints():
    assert coerce("5.0", T.LongType()) == 5 and coerce("2.5", T.DoubleType()) == 2.5 and coerce(2.5, T.IntegerType()) == 2.5
    assert coerce("2020-01-02", T.TimestampNTZType()) == datetime.datetime(2020, 1, 2)
    for v, k in ((True, T.LongType()), (1, T.StringType()), ("x", T.DoubleType()), (1, T.BooleanType())):
        with pytest.raises(ValueError):
            coerce(v, k)
    a, b = QuerySpec("lookup", "rows", (Dimension("x", "y"),)), QuerySpec("lookup", "rows", (Dimension("x", "y"),))
    assert fingerprint(a) == fingerprint(b) != fingerprint(QuerySpec("lookup", "rows", (Dimension("x", "z"),)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["=", "!=", "<", ">=", "in", "is null"]), st.integers(0, 6)), min_size=1, max_size=3))
def test_random_conjunctions(tables, tests):
    rows = [(1, 1), (2, 2), (3, None), (4, 5), (5, 5)]
    ok = {"=": lambda x, v: x is not None and x == v, "!=": lambda x, v: x is not None and x != v, "<": lambda x, v: x is not None and x < v, ">=": lambda x, v: x is not None and x >= v, "in": lambda x, v: x in (v, v + 1) and x is not None, "is null": lambda x, v: x is None}
    filters = tuple(Filter(f"f{i}", "nulls.i", o, [v, v + 1] if o == "in" else None if o == "is null" else v) for i, (o, v) in enumerate(tests))
    spec = QuerySpec("lookup", "rows", (Dimension("id", "nulls.id"),), filters=filters, orders=(Order("id"),))
    assert run(tables, spec, SchemaPlan(("nulls",), {})) == [(n,) for n, i in rows if all(ok[o](i, v) for o, v in tests)]
