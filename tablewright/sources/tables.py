"""Parquet folders of tables: views, snapshot ids, typed copies, and edits that plain Parquet lacks."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def register(tables: dict[str, DataFrame]) -> None:
    """Each table as a temporary view of its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def snapshot_id(tables: dict[str, DataFrame], counts: dict[str, int] | None = None) -> str:
    """A name for these schemas (and row counts): what is bound against one snapshot doesn't fit another."""
    said = {n: [json.loads(df.schema.json()), (counts or {}).get(n)] for n, df in sorted(tables.items())}
    return "dbs_" + hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()[:20]


def write_table(df: DataFrame, path: str, rows: int | None = None, replace: bool = False) -> int:
    """Write a table, refuse to overwrite unless told, and check its number of rows against what was expected."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if rows is not None and written != rows:
        raise ValueError(f"{path}: {written} rows written, {rows} expected")
    return written


def write_split_jsonl(df: DataFrame, path: str, split: str, key: str) -> None:
    """JSON lines, a folder for each split, each sorted by key; a split's rows go to one range of files in key order."""
    rows = df.select(F.col(split), F.col(key), F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    rows.repartitionByRange(split, key).sortWithinPartitions(split, key).select(split, "value").write.partitionBy(split).text(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key the old table lacks, to be appended."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def keep_newest(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows of each group by the order columns, falling."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def merged_review(candidates: DataFrame, review: DataFrame, snapshot: str) -> DataFrame:
    """Candidates (candidate_id, ...) with the decision that an older review of the same snapshot took, else pending."""
    old = review.filter(F.col("snapshot_id") == snapshot).select("candidate_id", "decision", "note")
    return candidates.join(old, "candidate_id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def registered(registry: DataFrame, new: DataFrame) -> DataFrame:
    """A registry of (question, sql, source_id) and its entry_id, a digest of question and SQL; entries it has are not added again."""
    keyed = lambda d: d.select("question", "sql", "source_id").withColumn("entry_id", F.sha2(F.concat_ws("\n", F.trim("question"), F.trim("sql")), 256))
    added = keyed(new).groupBy("entry_id").agg(F.min_by(F.struct("question", "sql", "source_id"), F.struct("source_id", "question", "sql")).alias("x")).select("x.*", "entry_id")
    return insert_missing(keyed(registry), added, ["entry_id"]).unionByName(keyed(registry))


def unregistered(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """The registry without the entries of some sources (source_id)."""
    return registry.join(sources.select("source_id").distinct(), "source_id", "left_anti").select(*registry.columns)


def drop_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent exists."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def newest_file(spark: SparkSession, pattern: str, must_hold: str) -> str | None:
    """The most recently changed file that matches the pattern and holds the text."""
    try:
        files = spark.read.format("binaryFile").load(pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    hit = files.filter(F.col("content").cast("string").contains(must_hold)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return hit["path"]
