"""Read-only SQL under bounds: a check before it runs, and a limit of rows and time while it does.

Spark parses the statement; what is allowed is a list of node names of its logical plan.
"""

from __future__ import annotations

import hashlib
import re
import threading
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 64_000
MOST_ROWS, MOST_MS = 10_000, 60_000
# Nodes of Spark's logical plans that only read.
READS = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit LimitAndOffset Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHaving "
    "OneRowRelation WithWindowDefinition Window UnresolvedInlineTable LocalRelation CTERelationDef CTERelationRef WithCTE UnresolvedOrdinal ResolvedInlineTable".split()
)
BLOCKED = re.compile(r"(?i)\b(reflect|java_method|try_reflect|input_file_name|input_file_block_start|input_file_block_length|load_extension|readfile|writefile|read_files|range|spark_partition_id)\s*\(")


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]
    truncated: bool
    elapsed_ms: float
    fingerprint: str


def parsed(spark: SparkSession, sql: str):
    """The one place that reaches into the JVM session for its parser."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def nodes(plan) -> tuple[set[str], set[tuple[str, ...]]]:
    """Names of all nodes, those of subqueries and common tables included, and the relations they name."""
    names, relations, todo = set(), set(), [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName().strip("'")
        names.add(name)
        if name == "UnresolvedRelation":
            parts = p.multipartIdentifier()
            relations.add(tuple(parts.apply(i) for i in range(parts.size())))
        if name == "UnresolvedWith":
            ctes = p.cteRelations()
            todo += [ctes.apply(i)._2() for i in range(ctes.size())]
        for group in (p.children(), p.subqueries()):
            todo += [group.apply(i) for i in range(group.size())]
    return names, relations


def common_tables(plan) -> set[str]:
    found, todo = set(), [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().strip("'") == "UnresolvedWith":
            ctes = p.cteRelations()
            for i in range(ctes.size()):
                found.add(ctes.apply(i)._1().lower())
                todo.append(ctes.apply(i)._2())
        for group in (p.children(), p.subqueries()):
            todo += [group.apply(i) for i in range(group.size())]
    return found


def problems(spark: SparkSession, sql: str, tables: set[str]) -> list[str]:
    """Why a statement may not run; empty if it may.  tables: the names it may read."""
    if not sql.strip():
        return ["empty_sql"]
    if len(sql.encode()) > MOST_BYTES:
        return ["sql_too_large"]
    if "--" in sql or "/*" in sql:  # the parser would drop them silently
        return ["comments_not_allowed"]
    text = sql.strip().removesuffix(";")
    if ";" in re.sub(r"'(?:[^']|'')*'", "", text):
        return ["exactly_one_statement_required"]
    try:
        plan = parsed(spark, text)
    except (ParseException, Py4JJavaError, PySparkException):
        return ["parse_error"]
    names, relations = nodes(plan)
    out = [] if names <= READS else ["read_only_query_required:" + ",".join(sorted(names - READS))]
    if m := BLOCKED.search(re.sub(r"'(?:[^']|'')*'", "''", text)):
        out.append(f"blocked_function:{m[1].lower()}")
    known = {t.lower() for t in tables} | common_tables(plan)
    out += [f"unknown_table:{'.'.join(r)}" for r in sorted(relations) if len(r) != 1 or r[0].lower() not in known]
    if not out:
        try:
            spark.sql(text).schema  # noqa: B018  analysis finds unknown columns
        except PySparkException as e:
            out.append(f"unknown_column:{e.getCondition() or 'analysis'}")
    return out


def skeleton(sql: str) -> str:
    """The statement with its literals taken out and its space evened."""
    text = re.sub(r"'(?:[^']|'')*'", "?", sql)
    text = re.sub(r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])", "?", text)
    return " ".join(text.lower().split()).rstrip("; ")


def run_bounded(df: DataFrame, max_rows: int = 200, timeout_ms: int = 3000) -> Result:
    """At most max_rows rows, within the time; TimeoutError beyond it."""
    if not (1 <= max_rows <= MOST_ROWS and 10 <= timeout_ms <= MOST_MS):
        raise ValueError(f"rows: 1 to {MOST_ROWS}; time: 10 to {MOST_MS} ms")
    context, group = df.sparkSession.sparkContext, f"bounded-{uuid.uuid4().hex}"
    out: dict = {}

    def work():
        context.setJobGroup(group, "bounded query", interruptOnCancel=True)
        try:
            out["rows"] = df.limit(max_rows + 1).collect()
        except Exception as e:
            out["error"] = e

    from pyspark import InheritableThread

    began, thread = time.monotonic(), InheritableThread(target=work)
    thread.start()
    alarm = threading.Timer(timeout_ms / 1000, context.cancelJobGroup, [group])
    alarm.start()
    thread.join()
    alarm.cancel()
    spent = (time.monotonic() - began) * 1000
    if "error" in out:
        if spent >= timeout_ms:
            raise TimeoutError(f"stopped after {timeout_ms} ms") from out["error"]
        raise out["error"]
    rows = tuple(tuple(r) for r in out["rows"])
    digest = hashlib.sha256(repr((df.columns, rows)).encode()).hexdigest()
    return Result(tuple(df.columns), rows[:max_rows], len(rows) > max_rows, spent, digest)


def run_sql(spark: SparkSession, sql: str, tables: set[str], max_rows: int = 200, timeout_ms: int = 3000) -> Result:
    if found := problems(spark, sql, tables):
        raise PermissionError(", ".join(found))
    return run_bounded(spark.sql(sql.strip().removesuffix(";")), max_rows, timeout_ms)
