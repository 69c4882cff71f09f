"""The engine's queries over the driver's tables, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import MASK, SECRET_PATTERNS, bucket, clip, redact, token_estimate, tokens, words
from .operators import catalog, evaluation, release, retrieval, windows
from .plans.binder import BoundPlan, bind
from .plans.compiler import compile_plan
from .plans.contracts import Dimension, Filter, Join, Measure, Order, QuerySpec, SchemaPlan
from .sources.tables import drop_orphans, insert_missing, keep_newest, load, snapshot_id, upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def planned(spark: SparkSession, sf_dir: str, spec: QuerySpec, plan: SchemaPlan) -> DataFrame:
    """Bind a plan against the tables and compile it."""
    tables = load(spark, sf_dir, plan.tables)
    bound = bind(spec, plan, {n: df.schema for n, df in tables.items()}, snapshot_id(tables))
    if not isinstance(bound, BoundPlan):
        raise ValueError(bound)
    return compile_plan(bound, tables)


def plan_query(name: str, spec: QuerySpec, plan: SchemaPlan, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: planned(spark, sf_dir, spec, plan)
    ORACLE_SQL[name] = sql


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return list(load(spark, sf_dir, names).values())


def one(name: str, *joins: Join, grain: tuple[str, ...] = (), columns: dict[str, str] | None = None, values: dict | None = None) -> SchemaPlan:
    tables = dict.fromkeys([name, *[x.split(".")[0] for j in joins for x in (j.left, j.right)]])
    return SchemaPlan(tuple(tables), columns or {}, joins, grain, values or {})


# Plan tier: projections and predicates.

plan_query(
    "proj_eq_distinct",
    QuerySpec("lookup", "rows", (Dimension("o_custkey", "orders.o_custkey"),), filters=(Filter("f", "status", "=", "failed"),), orders=(Order("o_custkey"),), limit=50, distinct_rows=True),
    one("orders", columns={"status": "orders.o_orderstatus"}, values={"orders.o_orderstatus": {"failed": "F"}}),
    "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey LIMIT 50",
)

FILTERS = {
    "eq": ("l_returnflag", "R", "l_returnflag = 'R'"), "neq": ("l_returnflag", "R", "l_returnflag <> 'R'"),
    "gt": ("l_quantity", 45, "l_quantity > 45"), "gte": ("l_quantity", "45.0", "l_quantity >= 45"),
    "lt": ("l_quantity", 5, "l_quantity < 5"), "lte": ("l_quantity", 5, "l_quantity <= 5"),
    "in": ("l_linenumber", [1, 3, "5.0"], "l_linenumber IN (1, 3, 5)"), "not_in": ("l_linenumber", [1, 3], "l_linenumber NOT IN (1, 3)"),
    "between": ("l_discount", [0.02, 0.04], "l_discount BETWEEN 0.02 AND 0.04"), "is_not_null": ("l_shipdate", None, "l_shipdate IS NOT NULL"),
}
for _op, (_column, _value, _sql) in FILTERS.items():
    plan_query(
        f"filter_{_op}",
        QuerySpec("aggregate", "grouped_rows", (Dimension("l_linestatus", "l_linestatus"),), (Measure("n", "count_all"), Measure("keys", "count_distinct", "l_orderkey")), (Filter("f", f"lineitem.{_column}", _op, _value),), (Order("l_linestatus"),), 100),
        one("lineitem", grain=("lineitem.l_linestatus",)),
        f"SELECT l_linestatus, COUNT(*) AS n, COUNT(DISTINCT l_orderkey) AS keys FROM lineitem WHERE {_sql} GROUP BY 1 ORDER BY 1",
    )
for _op, _test in (("like", "lower(p_type) LIKE '%economy%'"), ("not_like", "lower(p_type) NOT LIKE '%economy%'")):
    plan_query(
        f"filter_{_op}",
        QuerySpec("aggregate", "grouped_rows", (Dimension("p_brand", "p_brand"),), (Measure("n", "count_all"),), (Filter("f", "part.p_type", _op, "%ECONOMY%"),), (Order("p_brand"),), 100),
        one("part", grain=("part.p_brand",)),
        f"SELECT p_brand, COUNT(*) AS n FROM part WHERE {_test} GROUP BY 1 ORDER BY 1 NULLS FIRST LIMIT 100",
    )
plan_query(
    "filter_is_null",
    QuerySpec("aggregate", "scalar", measures=(Measure("n", "count_all"),), filters=(Filter("f", "orders.o_orderkey", "is null"),)),
    one("customer", Join("customer.c_custkey", "orders.o_custkey", "left")),
    "SELECT COUNT(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
)
plan_query(
    "filter_and3",
    QuerySpec("count", "scalar", measures=(Measure("n", "count_all"),), filters=(Filter("a", "l_quantity", ">=", 10), Filter("b", "l_discount", "<", 0.05), Filter("c", "l_returnflag", "in", ["A", "N"]))),
    one("lineitem"),
    "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 AND l_returnflag IN ('A', 'N')",
)

# Aggregates.
for _name, _measure, _sql in (
    ("count_star", Measure("v", "count_all"), "COUNT(*)"),
    ("count_col", Measure("v", "count", "o_orderpriority", False), "COUNT(o_orderpriority)"),
    ("count_distinct", Measure("v", "count_distinct", "o_custkey"), "COUNT(DISTINCT o_custkey)"),
    ("sum", Measure("v", "sum", "o_totalprice", False, 2), "ROUND(SUM(o_totalprice), 2)"),
    ("sum_distinct", Measure("v", "sum", "o_custkey", True), "CAST(SUM(DISTINCT o_custkey) AS BIGINT)"),
    ("avg_round6", Measure("v", "avg", "o_totalprice", False, 6), "ROUND(AVG(o_totalprice), 6)"),
    ("avg_distinct", Measure("v", "avg", "o_custkey", True, 6), "ROUND(AVG(DISTINCT o_custkey), 6)"),
    ("min", Measure("v", "min", "o_totalprice"), "MIN(o_totalprice)"),
    ("max", Measure("v", "max", "o_orderpriority"), "MAX(o_orderpriority)"),
):
    plan_query(_name, QuerySpec("aggregate", "scalar", measures=(_measure,)), one("orders"), f"SELECT {_sql} AS v FROM orders")
plan_query(
    "group_count",
    QuerySpec("count", "grouped_rows", (Dimension("o_orderpriority", "o_orderpriority"),), (Measure("n", "count_all"),), orders=(Order("n", True), Order("o_orderpriority"))),
    one("orders", grain=("orders.o_orderpriority",)),
    "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
plan_query(
    "group_two_dims",
    QuerySpec(
        "aggregate", "grouped_rows", (Dimension("l_returnflag", "l_returnflag"), Dimension("l_linestatus", "l_linestatus")),
        (Measure("sum_qty", "sum", "l_quantity", False, 2), Measure("avg_price", "avg", "l_extendedprice", False, 4), Measure("max_tax", "max", "l_tax"), Measure("n", "count_all")),
        orders=(Order("l_returnflag"), Order("l_linestatus")),
    ),
    one("lineitem", grain=("lineitem.l_returnflag", "lineitem.l_linestatus")),
    "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, MAX(l_tax) AS max_tax, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20",
)
plan_query(
    "group_multi_agg",
    QuerySpec("aggregate", "grouped_rows", (Dimension("c_mktsegment", "c_mktsegment"),), (Measure("n", "count_all"), Measure("nations", "count_distinct", "c_nationkey"), Measure("least", "min", "c_acctbal"), Measure("mean", "avg", "c_acctbal", False, 6)), orders=(Order("c_mktsegment"),)),
    one("customer", grain=("customer.c_mktsegment",)),
    "SELECT c_mktsegment, COUNT(*) AS n, COUNT(DISTINCT c_nationkey) AS nations, MIN(c_acctbal) AS least, ROUND(AVG(c_acctbal), 6) AS mean FROM customer GROUP BY 1 ORDER BY 1 LIMIT 20",
)
plan_query(
    "group_then_max",
    QuerySpec("ranking", "grouped_rows", (Dimension("nation", "n_name"),), (Measure("n", "count_all"),), orders=(Order("n", True), Order("nation")), limit=1),
    one("nation", Join("nation.n_nationkey", "customer.c_nationkey"), grain=("nation.n_name",)),
    "SELECT n_name AS nation, COUNT(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
plan_query(
    "rank_topk_rows",
    QuerySpec("ranking", "rows", (Dimension("p_partkey", "p_partkey"), Dimension("p_retailprice", "p_retailprice")), orders=(Order("p_retailprice", True), Order("p_partkey")), filters=(Filter("f", "p_retailprice", "is not null"),), limit=5),
    one("part"),
    "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 5",
)
plan_query(
    "rank_topk_groups",
    QuerySpec("ranking", "grouped_rows", (Dimension("segment", "c_mktsegment"),), (Measure("orders_", "count_distinct", "o_orderkey"),), (Filter("f", "o_orderstatus", "eq", "F"),), (Order("orders_", True), Order("segment")), 3),
    one("customer", Join("customer.c_custkey", "orders.o_custkey"), grain=("customer.c_mktsegment",)),
    "SELECT c_mktsegment AS segment, COUNT(DISTINCT o_orderkey) AS orders_ FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)

# Joins.
plan_query(
    "join_inner",
    QuerySpec("count", "grouped_rows", (Dimension("region", "r_name"),), (Measure("n", "count_all"),), orders=(Order("region"),)),
    one("nation", Join("nation.n_regionkey", "region.r_regionkey"), grain=("region.r_name",)),
    "SELECT r_name AS region, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 1",
)
plan_query(
    "join_left_agg",
    QuerySpec("count", "grouped_rows", (Dimension("segment", "c_mktsegment"),), (Measure("customers", "count_distinct", "c_custkey"), Measure("orders_", "count", "o_orderkey", False)), orders=(Order("segment"),)),
    one("customer", Join("customer.c_custkey", "orders.o_custkey", "left"), grain=("customer.c_mktsegment",)),
    "SELECT c_mktsegment AS segment, COUNT(DISTINCT c_custkey) AS customers, COUNT(o_orderkey) AS orders_ FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY 1",
)
plan_query(
    "join_chain4",
    QuerySpec("aggregate", "grouped_rows", (Dimension("region", "r_name"),), (Measure("n", "count_all"), Measure("total", "sum", "o_totalprice", False, 2)), orders=(Order("total", True),)),
    one("region", Join("nation.n_regionkey", "region.r_regionkey"), Join("nation.n_nationkey", "customer.c_nationkey"), Join("customer.c_custkey", "orders.o_custkey"), grain=("region.r_name",)),
    "SELECT r_name AS region, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1",
)
plan_query(
    "join_count",
    QuerySpec("count", "scalar", measures=(Measure("n", "count_all"),), filters=(Filter("f", "p_size", ">", 40),)),
    one("lineitem", Join("lineitem.l_partkey", "part.p_partkey")),
    "SELECT COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40",
)
plan_query(
    "exists_true",
    QuerySpec("existence", "scalar", filters=(Filter("f", "o_totalprice", ">", 1000),)),
    one("orders"),
    "SELECT CAST(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) THEN 1 ELSE 0 END AS INTEGER) AS found",
)
plan_query(
    "exists_case",
    QuerySpec("existence", "scalar", filters=(Filter("f", "o_totalprice", "<", -1),)),
    one("orders"),
    "SELECT CAST(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_totalprice < -1) THEN 1 ELSE 0 END AS INTEGER) AS found",
)


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = read(spark, sf_dir, "customer", "orders")
    return customer.join(orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = read(spark, sf_dir, "customer", "orders")
    return customer.join(orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1 HAVING COUNT(*) > (SELECT COUNT(*) / 25.0 FROM customer)")
def having_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customer,) = read(spark, sf_dir, "customer")
    mean = customer.agg((F.count("*") / 25).alias("mean"))
    return customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).filter(F.col("n") > mean.scalar()).select("c_nationkey", "n")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = read(spark, sf_dir, "orders")
    return orders.filter(F.col("o_totalprice") > orders.agg(F.avg("o_totalprice")).scalar()).select("o_orderkey", "o_totalprice")


plan_query(
    "two_filter_count_distinct",
    QuerySpec("count", "scalar", measures=(Measure("n", "count_distinct", "l_suppkey"),), filters=(Filter("a", "l_returnflag", "eq", "R"), Filter("b", "l_quantity", "between", [10, 20]))),
    one("lineitem"),
    "SELECT COUNT(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20",
)


@query("WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_mktsegment, COUNT(*) AS n FROM big JOIN customer ON o_custkey = c_custkey WHERE total > 500000 GROUP BY 1")
def cte_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders", "customer")
    sql = "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM {orders} GROUP BY 1) SELECT c_mktsegment, COUNT(*) AS n FROM big JOIN {customer} ON o_custkey = c_custkey WHERE total > 500000 GROUP BY 1"
    return spark.sql(sql, orders=orders, customer=customer)


@query("SELECT l_linestatus, COUNT(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1")
def in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, part = read(spark, sf_dir, "lineitem", "part")
    return lineitem.join(part.filter("p_size < 10"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_linestatus").agg(F.count("*").alias("n"))


# Catalog.
@query("SELECT COUNT(*) - COUNT(nullif(o_orderstatus, 'P')) AS null_count, ROUND((COUNT(*) - COUNT(nullif(o_orderstatus, 'P'))) / COUNT(*)::DOUBLE, 6) AS null_ratio FROM orders")
def null_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = read(spark, sf_dir, "orders")
    return catalog.profile(orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("s")), "orders").select("null_count", "null_ratio")


@query("SELECT p_type AS value, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.value_sample(*read(spark, sf_dir, "part"), "p_type", 20)


def _profile_sql(table: str, columns: dict[str, bool]) -> str:
    each = [
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, "
        + (f"CAST(MIN({c}) AS DOUBLE) AS least, CAST(MAX({c}) AS DOUBLE) AS most" if number else "CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS most")
        + f" FROM {table}"
        for c, number in columns.items()
    ]
    return " UNION ALL ".join(each)


@query(_profile_sql("orders", {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderdate": False, "o_orderpriority": False}))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.profile(*read(spark, sf_dir, "orders"), "orders").select("table_name", "column_name", "row_count", "null_count", "distinct_count", "least", "most")


@query("SELECT 'o_orderpriority' AS column_name, string_agg(v, '|' ORDER BY v) AS vals FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) UNION ALL SELECT 'o_orderstatus', string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)")
def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = read(spark, sf_dir, "orders")
    return catalog.low_cardinality(orders, catalog.profile(orders, "orders")).select("column_name", F.array_join("values", "|").alias("vals"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.row_counts(load(spark, sf_dir, TABLES))


PREFIXES = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}
_PAIRS = (
    ("customer", "c_custkey", "orders", "o_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "supplier", "s_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("nation", "n_nationkey", "supplier", "s_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {'1.0' if (a, b) == ('lineitem', 'l_orderkey') else '0.75'}::DOUBLE)" for a, b, c, d in _PAIRS) + ") AS t(left_table, left_column, right_table, right_column, confidence)")
def join_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = catalog.catalog_columns(load(spark, sf_dir, tuple(PREFIXES)), PREFIXES)
    return catalog.join_candidates(columns, [("lineitem.l_orderkey", "orders.o_orderkey")])


@query(
    "WITH a AS (SELECT o_custkey AS v, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT c_custkey AS v, COUNT(*) AS m FROM customer GROUP BY 1), "
    "t AS (SELECT COUNT(n) AS l, COUNT(m) AS r, COUNT(CASE WHEN n IS NOT NULL AND m IS NOT NULL THEN 1 END) AS c, MAX(n) AS mn, MAX(m) AS mm FROM a FULL OUTER JOIN b USING (v)) "
    "SELECT l AS left_distinct, r AS right_distinct, c AS common, ROUND(c / l::DOUBLE, 6) AS left_coverage, ROUND(c / r::DOUBLE, 6) AS right_coverage, ROUND(c / (l + r - c)::DOUBLE, 6) AS jaccard, "
    "CASE WHEN mn <= 1 AND mm <= 1 THEN 'one_to_one' WHEN mn <= 1 THEN 'one_to_many' WHEN mm <= 1 THEN 'many_to_one' ELSE 'many_to_many_or_unknown' END AS cardinality FROM t"
)
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders", "customer")
    return catalog.overlap(orders.filter("o_orderstatus = 'F'"), "o_custkey", customer, "c_custkey")


# Windows and state.
@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest(*read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE r <= 2")
def last_n_per_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_newest(*read(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], 2).select("conv_id", "turn", "role")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS turn_number FROM events")
def turn_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(*read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "turn_number").select("event_id", "user_id", "turn_number")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(turn, 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE turn <> 1) WHERE turn <> b + 1")
def chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    (conversations,) = read(spark, sf_dir, "conversations")
    shifted = conversations.filter("turn <> 1").select("conv_id", (F.col("turn") + 1).alias("revision"))
    return windows.bad_revisions(shifted, "conv_id", "revision").select("conv_id", (F.col("revision") - 1).alias("turn"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, text, role, SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations) WHERE s <= 800 AND r <= 3")
def budgeted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("turn"), F.col("role"), F.col("text")]
    return windows.within_budget(*read(spark, sf_dir, "conversations"), ["conv_id"], order, F.length("text"), 800, 3).select("conv_id", "turn")


@query("SELECT kind, user_id, MAX(happened) AS last_at FROM (SELECT 'order' AS kind, o_custkey AS user_id, o_orderdate AS happened FROM orders UNION ALL SELECT 'event', user_id, ts FROM events) GROUP BY 1, 2")
def union_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = read(spark, sf_dir, "orders", "events")
    both = orders.select(F.lit("order").alias("kind"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at")).unionByName(events.select(F.lit("event").alias("kind"), "user_id", F.col("ts").alias("at")))
    return both.groupBy("kind", "user_id").agg(F.max("at").alias("last_at"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT user_id FROM events")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, events = read(spark, sf_dir, "customer", "events")
    return customer.select(F.col("c_custkey").alias("k")).intersect(events.select("user_id"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = read(spark, sf_dir, "customer", "orders")
    return customer.select(F.col("c_custkey").alias("k")).subtract(orders.filter("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT * FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer)")
def except_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders", "customer")
    return orders.select(F.col("o_custkey").alias("k")).exceptAll(customer.select("c_custkey"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_nationkey < 5")
def upsert_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customer,) = read(spark, sf_dir, "customer")
    new = customer.filter("c_nationkey < 5").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return upsert(customer.select("c_custkey", "c_acctbal"), new, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def insert_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = read(spark, sf_dir, "customer", "orders")
    return insert_missing(orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), customer.select("c_custkey"), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def orphans_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = read(spark, sf_dir, "lineitem", "orders")
    return drop_orphans(lineitem, orders.filter("o_orderpriority = '1-URGENT'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


# Evaluation: labels and events as outcomes.
@query("SELECT s.state AS state, COUNT(event_type) AS n FROM (SELECT DISTINCT event_type AS state FROM events UNION SELECT 'never') s LEFT JOIN events ON event_type = s.state GROUP BY 1")
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.histogram(*read(spark, sf_dir, "events"), "event_type", ["never"])


@query("SELECT event_type, COUNT(*) AS cases, median(value) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def p50_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = read(spark, sf_dir, "events")
    return evaluation.metrics(events.withColumnRenamed("value", "duration_ms"), ["event_type"]).select("event_type", "cases", "p50", "p95")


@query("SELECT source, COUNT(*) AS cases, ROUND(AVG(quality), 6) AS execution_accuracy, ROUND(AVG(1 - toxic), 6) AS safe FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def bucket_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, documents = read(spark, sf_dir, "labels", "documents")
    outcomes = labels.join(documents.select("doc_id", "source", "n_chars"), "doc_id").select("source", F.col("quality").alias("execution_accuracy"), (1 - F.col("toxic")).alias("safe"), F.col("n_chars").alias("duration_ms"))
    return evaluation.metrics(outcomes, ["source"]).select("source", "cases", "execution_accuracy", "safe")


@query("SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'fixed' WHEN quality = 1 AND toxic = 0 THEN 'regressed' ELSE 'same' END AS change, COUNT(*) AS n FROM labels GROUP BY 1")
def fixed_regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    (labels,) = read(spark, sf_dir, "labels")
    a, b = labels.select("doc_id", F.col("quality").alias("right")), labels.select("doc_id", F.col("toxic").alias("right"))
    return evaluation.compared(a, b, "doc_id", "right").groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN quality = 0 THEN 'not_executable' WHEN toxic = 1 THEN 'wrong_result' END AS failure, COUNT(*) AS n FROM labels GROUP BY 1")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    (labels,) = read(spark, sf_dir, "labels")
    outcomes = labels.select(F.lit(True).alias("safe"), (F.col("quality") == 1).alias("executable"), F.lit(1.0).alias("table_recall"), (F.col("toxic") == 0).alias("execution_accuracy"))
    return outcomes.groupBy(evaluation.failure_kind().alias("failure")).agg(F.count("*").alias("n"))


_B = "CAST('0x' || substr(sha256(CAST({} AS VARCHAR)), 1, 8) AS BIGINT) % 100"


@query(f"SELECT o_orderkey, {_B.format('o_orderkey')} AS bucket FROM orders WHERE {_B.format('o_orderkey')} < 5")
def hash_bucket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", bucket(F.col("o_orderkey")).alias("bucket")).filter("bucket < 5")


@query(
    "SELECT split, COUNT(*) AS n FROM (SELECT CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'holdout' END AS split FROM "
    "(SELECT CAST('0x' || substr(sha256('v1' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS b FROM events)) GROUP BY 1"
)
def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = evaluation.split_by_hash(*read(spark, sf_dir, "events"), "user_id", "v1", {"train": 60, "validation": 20, "holdout": 20})
    return split.groupBy("split").agg(F.count("*").alias("n"))


# Releases: each customer's orders as runs of two versions.
_SHADOW = (
    "d AS (SELECT o_orderkey, c_mktsegment AS deployment, o_orderstatus <> 'P' AS a_ok, o_orderpriority <> '5-LOW' AS b_ok, o_totalprice / 1000 AS a_ms, (o_totalprice + CASE WHEN c_nationkey < 12 THEN 0 ELSE 60000 END) / 1000 AS b_ms, "
    "o_custkey % 7 = 0 AS other FROM orders JOIN customer ON o_custkey = c_custkey), "
    "x AS (SELECT *, CASE WHEN a_ok AND b_ok THEN NOT other ELSE a_ok = b_ok END AS same, a_ok AND NOT b_ok AS failed FROM d)"
)


def _shadow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders", "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    none = F.array().cast("array<string>")
    status = lambda ok: F.when(ok, "success").otherwise("rejected")
    common = [F.lit(None).cast("string").alias("question"), F.lit("").alias("error"), none.alias("errors"), none.alias("refs"), F.lit("SELECT 1").alias("sql")]
    late = F.when(F.col("c_nationkey") < 12, 0).otherwise(60000)
    stable = rows.select("o_orderkey", status(F.col("o_orderstatus") != "P").alias("status"), F.lit("r").alias("result"), (F.col("o_totalprice") / 1000).alias("ms"), *common)
    candidate = rows.select("o_orderkey", status(F.col("o_orderpriority") != "5-LOW").alias("status"), F.when(F.col("o_custkey") % 7 == 0, "s").otherwise("r").alias("result"), ((F.col("o_totalprice") + late) / 1000).alias("ms"), *common)
    return release.shadow_diff(stable, candidate, "o_orderkey").join(rows.select("o_orderkey", F.col("c_mktsegment").alias("deployment")), "o_orderkey")


@query(f"WITH {_SHADOW} SELECT same AS result_equivalent, failed AS candidate_failed, NOT same OR failed AS review_required, COUNT(*) AS n FROM x GROUP BY 1, 2, 3")
def shadow_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shadow_runs(spark, sf_dir).groupBy("result_equivalent", "candidate_failed", "review_required").agg(F.count("*").alias("n"))


@query(
    f"WITH {_SHADOW}, r AS (SELECT deployment, COUNT(*) AS samples, ROUND(AVG(failed::INT), 6) AS failure_rate, ROUND(AVG((NOT same)::INT), 6) AS disagreement_rate, quantile_disc(a_ms, 0.95) AS a, quantile_disc(b_ms, 0.95) AS b FROM x GROUP BY 1) "
    "SELECT deployment, samples, failure_rate, disagreement_rate, CASE WHEN samples < 20 THEN 'shadow_running' WHEN failure_rate > 0.5 OR disagreement_rate > 0.2 OR (b > a * 1.2 AND b - a > 25) THEN 'rolled_back:shadow_threshold_exceeded' ELSE 'shadow_review' END AS decision FROM r"
)
def shadow_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = release.shadow_decision(_shadow_runs(spark, sf_dir), ["deployment"], release.Shadow(most_failures=0.5))
    return found.select("deployment", "samples", "failure_rate", "disagreement_rate", "decision")


@query("SELECT doc_id, quality = 0 AS present_before, toxic = 0 AS gone_after, quality = 0 AND toxic = 0 AS passed FROM labels")
def replayed_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    (labels,) = read(spark, sf_dir, "labels")
    code = lambda bad: F.when(bad, F.array(F.lit("wrong"))).otherwise(F.array().cast("array<string>"))
    runs = lambda bad: labels.select("doc_id", code(bad).alias("codes"))
    found = release.target_replay(labels.select("doc_id", F.lit("wrong").alias("code")), runs(F.col("quality") == 0), runs(F.col("toxic") == 1), "doc_id")
    return found.select("doc_id", "present_before", "gone_after", "passed")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'pending' END AS state, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2".join(
    ("SELECT o_orderpriority, CAST(SUM(n) AS BIGINT) AS total, CAST(SUM(CASE state WHEN 'approved' THEN n ELSE 0 END) AS BIGINT) AS approved, CAST(SUM(CASE state WHEN 'rejected' THEN n ELSE 0 END) AS BIGINT) AS rejected, CAST(SUM(CASE state WHEN 'pending' THEN n ELSE 0 END) AS BIGINT) AS pending FROM (", ") GROUP BY 1")))
def review_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = read(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
    return release.review_counts(orders.withColumn("state", state), "o_orderpriority", "state")


# Retrieval.
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
_LEXICAL = (
    f"q AS (SELECT DISTINCT item_id AS question_id, unnest({_WORDS.format('text')}) AS token FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents), "
    "a AS (SELECT question_id, COUNT(*) AS asked FROM q GROUP BY 1), h AS (SELECT question_id, doc_id, COUNT(*) AS common, SUM(1 + ln(1 + length(token))) AS long FROM q JOIN d USING (token) GROUP BY 1, 2), "
    "s AS (SELECT question_id, doc_id, 4 * common / asked::DOUBLE + long AS score FROM h JOIN a USING (question_id))"
)
_TOP = "SELECT question_id, {key}, ROUND(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY ROUND(score, 6) DESC, {key}) AS rank FROM {src}"


def _asked(benchmark: DataFrame) -> DataFrame:
    return retrieval.inverted(benchmark.withColumnRenamed("item_id", "question_id"), "question_id", words(F.col("text"))).distinct()


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The scores among which each question's k best are."""
    benchmark, documents = read(spark, sf_dir, "benchmark", "documents")
    return retrieval.lexical_best(_asked(benchmark), documents, "question_id", "doc_id", words(F.col("text")), k)


@query(f"WITH {_LEXICAL}, r AS ({_TOP.format(key='doc_id', src='s')}) SELECT question_id, doc_id, rank FROM r WHERE rank <= 5")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(_lexical(spark, sf_dir, 5), "question_id", "doc_id", 5).select("question_id", "doc_id", "rank")


_COSINE = (
    "c AS (SELECT q.vec_id AS question_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS score "
    "FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"
)


def _cosine(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The scores among which each question's k best are."""
    (vectors,) = read(spark, sf_dir, "embeddings")
    return retrieval.cosine_best(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", k)


@query(f"WITH {_COSINE}, r AS ({_TOP.format(key='vec_id', src='c')}) SELECT question_id, vec_id, rank FROM r WHERE rank <= 8")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(_cosine(spark, sf_dir, 8), "question_id", "vec_id", 8).select("question_id", "vec_id", "rank")


def _text_vectors(name: str, table: str, key: str) -> str:
    """Tables of WITH, of which the last is name (key, vector)."""
    letter = "ascii(substr(said, i + {}, 1))::BIGINT"
    triple = f"(({letter.format(0)} * 128 + {letter.format(1)}) * 128 + {letter.format(2)})"
    return (
        f"{name}_words AS (SELECT {key}, token, COUNT(*) AS n FROM (SELECT {key}, unnest({_WORDS.format('text')}) AS token FROM (SELECT DISTINCT {key}, text FROM {table} WHERE {key} IS NOT NULL)) GROUP BY 1, 2), "
        f"{name}_triples AS (SELECT token, {triple} * 2654435761 % 4294967296 AS h FROM (SELECT token, ' ' || token || ' ' AS said, unnest(range(1, length(token) + 1)) AS i FROM (SELECT DISTINCT token FROM {name}_words))), "
        f"{name}_hashed AS (SELECT token, h // 33554432 AS place, SUM(1 - 2 * (h // 16777216 % 2)) AS x FROM {name}_triples GROUP BY 1, 2), "
        f"{name}_places AS (SELECT {key}, place, SUM(n * x) AS x FROM {name}_words JOIN {name}_hashed USING (token) GROUP BY 1, 2), "
        f"{name} AS (SELECT {key}, list(COALESCE(x, 0)::DOUBLE ORDER BY place) AS vector FROM (SELECT DISTINCT {key} FROM {name}_places) CROSS JOIN (SELECT unnest(range(128)) AS place) LEFT JOIN {name}_places USING ({key}, place) GROUP BY 1)"
    )


_NEAR = (
    f"{_text_vectors('qv', 'benchmark', 'item_id')}, {_text_vectors('dv', 'documents', 'doc_id')}, "
    "c AS (SELECT item_id AS question_id, doc_id, list_inner_product(q.vector, v.vector) / (sqrt(list_inner_product(q.vector, q.vector)) * sqrt(list_inner_product(v.vector, v.vector))) AS score "
    "FROM qv q CROSS JOIN dv v WHERE list_inner_product(q.vector, q.vector) > 0 AND list_inner_product(v.vector, v.vector) > 0)"
)


def _beside_words(spark: SparkSession, sf_dir: str, near: DataFrame) -> DataFrame:
    """Each question's five best documents by words and by their places among those that are near."""
    benchmark, documents = read(spark, sf_dir, "benchmark", "documents")
    # The best five of both are among the best five by words and what is near.
    beside = retrieval.pair_scores(_asked(benchmark), documents, near, "question_id", "doc_id", words(F.col("text")))
    scores = _lexical(spark, sf_dir, 5).join(near, ["question_id", "doc_id"], "left_anti").unionByName(beside)
    return retrieval.top_k(retrieval.fuse(scores, near, "question_id", "doc_id"), "question_id", "doc_id", 5).select("question_id", "doc_id", "rank")


@query(
    f"WITH {_LEXICAL}, {_NEAR}, v AS ({_TOP.format(key='doc_id', src='c')}), x AS (SELECT question_id, doc_id, 5.0 / (rank + 1) AS extra FROM v WHERE rank <= 20), "
    f"f AS (SELECT question_id, doc_id, COALESCE(s.score, 0) + COALESCE(extra, 0) AS score FROM s FULL JOIN x USING (question_id, doc_id)), g AS ({_TOP.format(key='doc_id', src='f')}) SELECT question_id, doc_id, rank FROM g WHERE rank <= 5"
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By words, and by the vectors of the texts of questions and documents."""
    benchmark, documents = read(spark, sf_dir, "benchmark", "documents")
    close = retrieval.text_best(benchmark.withColumnRenamed("item_id", "question_id"), documents, "question_id", "doc_id", "text", 20)
    return _beside_words(spark, sf_dir, retrieval.top_k(close, "question_id", "doc_id", 20).select("question_id", "doc_id", "rank").persist())


_FIELDS = (("p_name", 2.4), ("p_brand", 2.1), ("p_type", 1.0))
_PIECES = "regexp_extract_all(lower(replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '[a-z0-9]+')"
_EVIDENCE = (
    f"q AS (SELECT DISTINCT p_type AS question_id, unnest({_PIECES.format('p_type')}) AS token FROM part), a AS (SELECT question_id, COUNT(*) AS asked FROM q GROUP BY 1), "
    "i AS (SELECT item_id, token, MAX(weight) AS weight FROM (" + " UNION ALL ".join(f"SELECT p_partkey AS item_id, unnest({_PIECES.format(c)}) AS token, {w}::DOUBLE AS weight FROM part" for c, w in _FIELDS) + ") GROUP BY 1, 2), "
    "h AS (SELECT question_id, item_id, COUNT(*) AS common, SUM((1 + ln(1 + length(token))) * weight) AS special FROM q JOIN i USING (token) GROUP BY 1, 2), "
    "s AS (SELECT question_id, item_id, ROUND(1.5 * (4 * common / asked::DOUBLE + special + CASE WHEN contains(lower(p_name || chr(10) || p_brand || chr(10) || chr(10) || p_type), lower(question_id)) THEN 3 ELSE 0 END), 6) AS score "
    "FROM h JOIN a USING (question_id) JOIN part ON p_partkey = item_id)"
)


@query(f"WITH {_EVIDENCE}, r AS (SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT question_id, item_id, rank FROM r WHERE rank <= 10")
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = read(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    items = part.select(F.col("p_partkey").alias("item_id"), F.lit("schema").alias("kind"), F.col("p_name").alias("title"), F.col("p_brand").alias("item_key"), none.alias("dependencies"), F.col("p_type").alias("content"), none.alias("values"))
    scores = retrieval.evidence_scores(part.select(F.col("p_type").alias("question_id"), F.col("p_type").alias("text")).distinct(), items, "schema-grounding")
    return retrieval.top_k(scores, "question_id", "item_id", 10).select("question_id", "item_id", "rank")


# Text functions.
def _redact_sql() -> str:
    out = "text"
    for p in SECRET_PATTERNS:
        out = f"regexp_replace({out}, '{p}', '{MASK}', 'g')"
    return f"SELECT doc_id, sha256({out}) AS redacted_sha256 FROM documents"


@query(_redact_sql())
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = read(spark, sf_dir, "documents")
    return documents.select("doc_id", F.sha2(redact(F.col("text")), 256).alias("redacted_sha256"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 140) || ' ... ' || right(text, 60) END AS clipped FROM documents")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = read(spark, sf_dir, "documents")
    return documents.select("doc_id", clip(F.col("text"), 200).alias("clipped"))


@query("SELECT item_id, CAST(ceil((length(text) - o) / 3.2::DOUBLE + o + 4) AS BIGINT) AS estimate FROM (SELECT item_id, text, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS o FROM benchmark)")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    (benchmark,) = read(spark, sf_dir, "benchmark")
    return benchmark.select("item_id", token_estimate(F.col("text")).cast("long").alias("estimate"))


@query(f"SELECT item_id, COUNT(DISTINCT token) AS n FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS token FROM benchmark) GROUP BY 1")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    (benchmark,) = read(spark, sf_dir, "benchmark")
    return benchmark.select("item_id", F.size(F.filter(tokens(F.translate("text", "_", "_")), lambda t: t.rlike("^[a-z0-9]+$"))).cast("long").alias("n"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by priority among those with status F: the first plan, end to end."""
    spec = QuerySpec("ranking", "grouped_rows", (Dimension("o_orderpriority", "priority"),), (Measure("n", "count_distinct", "o_orderkey"),), (Filter("f", "o_orderstatus", "=", "F"),), (Order("n", True), Order("o_orderpriority")), 3)
    return planned(spark, folder, spec, one("orders", grain=("orders.o_orderpriority",), columns={"priority": "orders.o_orderpriority"}))


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = "SELECT o_orderpriority, COUNT(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"

# They register themselves.
from . import more_queries  # noqa: E402, F401
