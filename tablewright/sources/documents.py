"""Text sources: JSON lines with checks, Markdown pages, SQL dumps, hash-chained logs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_cases(spark: SparkSession, pattern: str, schema: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """JSON-line cases, and the problems among them: ids used twice, foreign snapshots, a split that isn't its file's name."""
    cases = spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_name"))
    by_id = cases.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("duplicate_id").alias("problem"))
    foreign = cases.filter(~F.col("database_snapshot_id").eqNullSafe(F.lit(snapshot))).select("case_id", F.lit("foreign_snapshot").alias("problem"))
    moved = cases.filter(~F.col("file").startswith(F.col("split"))).select("case_id", F.lit("split_differs_from_file").alias("problem"))
    return cases, by_id.unionByName(foreign).unionByName(moved)


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"), "length")


def read_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, title, planning, nth, heading, body): Markdown pages in chunks at their headings.

    title: from the front matter; planning: what stands between the planning marks, if anything.
    """
    return chunked_pages(spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def chunked_pages(pages: DataFrame) -> DataFrame:
    """As read_pages, for pages that are rows (path, value)."""
    front = r"(?s)^---\n(.*?)\n---\n"
    body = F.regexp_replace("value", front, "")
    chunks = F.filter(F.split(body, r"(?m)^(?=#{1,6} )"), lambda c: F.length(F.trim(c)) > 0)
    out = pages.select(
        "path",
        F.regexp_extract(F.regexp_extract("value", front, 1), r"(?m)^title:\s*(.+)$", 1).alias("title"),
        F.regexp_extract(body, r"(?s)<!-- planning -->(.*?)<!-- /planning -->", 1).alias("planning"),
        F.posexplode(chunks).alias("nth", "chunk"),
    )
    return out.select("path", "title", "planning", "nth", F.regexp_extract("chunk", r"^#{1,6} ([^\n]*)", 1).alias("heading"), F.trim(F.regexp_replace("chunk", r"^#{1,6} [^\n]*\n?", "")).alias("body"))


# Kinds of pages, and phrases that tell a model what to do.
PAGE_KINDS = ("business_glossary", "relationship", "schema", "value", "verified_example")
INJECTION = r"(?i)ignore (all |any )?(the )?(previous|prior|above) (instructions|rules)|disregard (all |any )?(the )?(previous|prior|above)|you are now|system prompt"
SQL_WORDS = r"(?i)\b(select|insert|update|delete|create|drop|alter|with|pragma|values)\b"


def page_problems(pages: DataFrame, columns: DataFrame, snapshot: str) -> DataFrame:
    """(path, problem) of pages (path, value, knowledge_type, snapshot_id) against the catalog's (table_name, column_name).

    Names in backquotes, alone or as table.column, must be known.  Planning blocks may hold no SQL.
    """
    of = lambda problem, test: pages.filter(test).select("path", F.lit(problem).alias("problem"))
    planning = F.regexp_extract("value", r"(?s)<!-- planning -->(.*?)<!-- /planning -->", 1)
    marks = lambda m: F.size(F.split("value", m)) - 1
    found = of("invalid_or_missing_knowledge_type", ~F.coalesce(F.col("knowledge_type").isin(*PAGE_KINDS), F.lit(False)))
    found = found.unionByName(of("database_snapshot_mismatch", ~F.col("snapshot_id").eqNullSafe(F.lit(snapshot))))
    found = found.unionByName(of("prompt_injection_detected", F.col("value").rlike(INJECTION)))
    found = found.unionByName(of("invalid_planning_block", marks("<!-- planning -->") != marks("<!-- /planning -->")))
    found = found.unionByName(of("planning_sql_leak", planning.rlike(SQL_WORDS)))
    named = pages.select("path", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"`([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)`"), F.lit(1)))).alias("name"))
    known = columns.select(F.col("table_name").alias("name")).union(columns.select("column_name")).union(columns.select(F.concat_ws(".", "table_name", "column_name"))).distinct()
    unknown = named.join(known, "name", "left_anti").select("path", F.concat(F.when(F.contains("name", F.lit(".")), "unknown_column:").otherwise("unknown_name:"), "name").alias("problem"))
    return found.unionByName(unknown)


# The column types of dumps and what they become.
WHOLE = ("bigint", "int", "integer", "mediumint", "smallint", "tinyint")
REAL = ("decimal", "double", "float", "numeric", "real")
BYTES = ("binary", "blob", "longblob", "mediumblob", "tinyblob", "varbinary")
TABLE = re.compile(r"CREATE TABLE\s+`([^`]+)`\s*\((.*?)\n\)[^;]*;", re.S)
COLUMN = re.compile(r"^\s*`([^`]+)`\s+([a-zA-Z]+)(\([^)]*\))?(.*)$")
KEY = re.compile(r"^\s*PRIMARY KEY\s*\(([^)]*)\)")


def dump_type(name: str) -> T.DataType:
    name = name.lower()
    return T.LongType() if name in WHOLE else T.DoubleType() if name in REAL else T.BinaryType() if name in BYTES else T.StringType()


def dump_schemas(ddl: str) -> dict[str, tuple[T.StructType, list[str]]]:
    """Tables of a dump's definitions: their columns, and their primary keys.  The text holds definitions only, so it is short."""
    found = {}
    for name, body in TABLE.findall(ddl):
        fields, key = [], []
        for line in body.split("\n"):
            if m := COLUMN.match(line):
                fields.append(T.StructField(m[1], dump_type(m[2]), "NOT NULL" not in m[4].upper()))
            elif m := KEY.match(line):
                key = re.findall(r"`([^`]+)`", m[1])
        found[name] = T.StructType(fields), key
    return found


VALUE = re.compile(r"""\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,'()\s][^,()]*?))\s*(,|$)""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a"}


def row_values(text: str, width: int) -> list:
    """The values between the brackets of one row; quotes double or take a backslash."""
    out, at = [], 0
    while at < len(text):
        m = VALUE.match(text, at)
        if not m:
            raise ValueError(f"no value at {at} of {text[:80]!r}")
        if m[1] is not None:
            out.append(re.sub(r"\\(.)|''", lambda x: ESCAPES.get(x[1], x[1]) if x[1] else "'", m[1], flags=re.S))
        else:
            out.append(None if m[2].upper() == "NULL" else bytes.fromhex(m[2][2:]) if m[2].lower().startswith("0x") else m[2])
        at = m.end()
        if not m[3]:
            break
    if len(out) != width:
        raise ValueError(f"{len(out)} values for {width} columns")
    return out


def read_dump_rows(spark: SparkSession, pattern: str, table: str, schema: T.StructType) -> DataFrame:
    """The rows of one table's INSERT lines, one row a line; the lines are parsed where they lie."""
    width, kinds = len(schema), [f.dataType for f in schema]
    head = f"INSERT INTO `{table}` VALUES "

    def typed(value, kind):
        if value is None or isinstance(kind, (T.StringType, T.BinaryType)):
            return value
        return int(value) if isinstance(kind, T.LongType) else float(value)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [row_values(v[len(head) :].strip().rstrip(";").strip()[1:-1], width) for v in f["value"]]
            yield pd.DataFrame({c: pd.Series([typed(r[i], kinds[i]) for r in rows], dtype=object) for i, c in enumerate(schema.names)})

    return spark.read.text(pattern).filter(F.col("value").startswith(head)).mapInPandas(parse, schema)


GENESIS = "GENESIS"


def chain_breaks(log: DataFrame, chain: str | None = None) -> DataFrame:
    """Rows of a hash-chained log (seq, payload, previous_hash, record_hash) that don't follow from the row before them.

    chain: a column that tells several logs apart.  A row follows the one whose seq is one less; a log's first row
    follows GENESIS.  Rows meet by a join, so that a long log isn't one task's work.
    """
    rows = log.withColumn("__chain", F.col(chain) if chain else F.lit(0))
    before = rows.select("__chain", (F.col("seq") + 1).alias("seq"), F.col("record_hash").alias("__before"))
    first = rows.groupBy("__chain").agg(F.min("seq").alias("__first"))
    own = F.sha2(F.concat("previous_hash", F.lit("|"), "payload"), 256)
    expected = F.when(F.col("seq") == F.col("__first"), GENESIS).otherwise(F.col("__before"))
    broken = ~F.col("previous_hash").eqNullSafe(expected) | (F.col("record_hash") != own)
    return rows.join(before, ["__chain", "seq"], "left").join(first, "__chain").filter(broken).select(*log.columns)


def chained(payloads: list[str], previous: str = GENESIS) -> list[tuple[int, str, str, str]]:
    """Records to append to a log: each hash covers its predecessor's, so they follow one after another."""
    out = []
    for i, p in enumerate(payloads):
        own = hashlib.sha256(f"{previous}|{p}".encode()).hexdigest()
        out.append((i, p, previous, own))
        previous = own
    return out


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, sha256, records): each file's digest and how many lines of it aren't blank.

    A file's bytes are one value of one task, so this is for files below the 2 GB that Spark's binary source takes.
    Spark's readers leave out files without any byte, so an empty file has no row and counts as missing.
    """
    name = F.col("_metadata.file_name").alias("name")
    digests = spark.read.format("binaryFile").load(pattern).select(name, F.sha2("content", 256).alias("sha256"))
    records = spark.read.text(pattern).filter(F.trim("value") != "").select(name).groupBy("name").agg(F.count("*").alias("records"))
    return digests.join(records, "name", "left").select("name", "sha256", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def manifest_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, problem) of files against a manifest, both (name, sha256, records); no rows: they agree."""
    there, stated = files.alias("there").withColumn("here", F.lit(True)), manifest.alias("stated").withColumn("listed", F.lit(True))
    both = there.join(stated, "name", "full_outer")
    problem = (
        F.when(F.col("here").isNull(), "missing_file").when(F.col("listed").isNull(), "unlisted_file")
        .when(~F.col("there.sha256").eqNullSafe(F.col("stated.sha256")), "digest_mismatch").when(~F.col("there.records").eqNullSafe(F.col("stated.records")), "count_mismatch")
    )
    return both.select("name", problem.alias("problem")).filter(F.col("problem").isNotNull())
