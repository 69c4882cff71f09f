"""Catalog work: column profiles, row counts, joins guessed from names and measured on values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import column_key

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: A column with at most so many values, none longer than this, has them listed.
LOW_CARDINALITY, LONGEST_VALUE = 20, 128


def profile(df: DataFrame, table: str) -> DataFrame:
    """One row for each column: nulls, distinct values, longest text, the values if they are few, bounds of numbers.

    Two passes, each one job over the whole table: counts first, then the values of the columns that have few.
    """

    def stats(c: str, kind: T.DataType) -> list[Column]:
        number = isinstance(kind, NUMBERS)
        x = F.col(f"`{c}`")
        return [
            F.count_if(x.isNull()).alias("null_count"), F.count_distinct(x).alias("distinct_count"), F.max(F.length(x.cast("string"))).cast("long").alias("max_length"),
            F.min(x.cast("double") if number else F.lit(None).cast("double")).alias("least"), F.max(x.cast("double") if number else F.lit(None).cast("double")).alias("most"),
        ]

    names = ["null_count", "distinct_count", "max_length", "least", "most"]
    flat = df.agg(F.count("*").alias("rows"), *[s.alias(f"{i}:{n}") for i, f in enumerate(df.schema) for s, n in zip(stats(f.name, f.dataType), names, strict=True)])
    each = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(i).alias("nth"), F.col("rows").alias("row_count"), *[F.col(f"`{i}:{n}`").alias(n) for n in names]) for i, f in enumerate(df.schema)])
    return flat.select(F.inline(each)).withColumn("null_ratio", F.round(F.try_divide("null_count", "row_count"), 6))


def low_cardinality(df: DataFrame, profiled: DataFrame) -> DataFrame:
    """(column_name, values): the values of columns with few, short ones.  The profile has one row for each column."""
    few = [r["column_name"] for r in profiled.filter((F.col("distinct_count") <= LOW_CARDINALITY) & (F.col("max_length") <= LONGEST_VALUE)).select("column_name").collect()]
    if not few:
        return df.sparkSession.createDataFrame([], "column_name string, values array<string>")
    got = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(c) for c in few])
    return got.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("values")) for c in few])))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in sorted(tables.items())])


def catalog_columns(tables: dict[str, DataFrame], prefixes: dict[str, str] | None = None) -> DataFrame:
    """(table_name, column_name, key): all columns, and what is left of their names without a table's own prefix."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.name.removeprefix((prefixes or {}).get(t, ""))) for t, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, short string").select("table_name", "column_name", column_key(F.col("short")).alias("key"))


def join_candidates(columns: DataFrame, declared: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of columns of two tables with one key that looks like a key; declared foreign keys are certain."""
    looks = F.col("key").rlike("(key|id|code)$")
    a = columns.filter(looks).select(F.col("table_name").alias("left_table"), F.col("column_name").alias("left_column"), "key")
    b = columns.filter(looks).select(F.col("table_name").alias("right_table"), F.col("column_name").alias("right_column"), "key")
    pairs = a.join(b, "key").filter("left_table < right_table")
    stated = F.concat_ws("=", F.concat_ws(".", "left_table", "left_column"), F.concat_ws(".", "right_table", "right_column")).isin(*[f"{x}={y}" for x, y in declared]) if declared else F.lit(False)
    return pairs.select("left_table", "left_column", "right_table", "right_column", F.when(stated, 1.0).otherwise(0.75).alias("confidence"))


# Confidence of a join that is guessed from names.
DECLARED, PRIMARY, SAME_NAME, SAME_KEY = 1.0, 0.9, 0.75, 0.65


def graded_candidates(columns: DataFrame, primary: list[tuple[str, str]], declared: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of columns of two tables with one key, where it looks like a key or either is primary, and how sure that is.

    columns: table_name, column_name, key.  primary: (table, column); declared: ("table.column", "table.column").
    """
    spark = columns.sparkSession
    keys = spark.createDataFrame(list(primary), "table_name string, column_name string").withColumn("primary", F.lit(True))
    known = columns.join(F.broadcast(keys), ["table_name", "column_name"], "left").withColumn("primary", F.coalesce("primary", F.lit(False))).filter("key != ''")
    side = lambda s: known.select(F.col("table_name").alias(f"{s}_table"), F.col("column_name").alias(f"{s}_column"), "key", F.col("primary").alias(f"{s}_primary"))
    ends = F.array_sort(F.array(F.concat_ws(".", "left_table", "left_column"), F.concat_ws(".", "right_table", "right_column")))
    pairs = side("left").join(side("right"), "key").filter("left_table < right_table").select(F.get(ends, F.lit(0)).alias("left"), F.get(ends, F.lit(1)).alias("right"), "key", "left_column", "right_column", (F.col("left_primary") | F.col("right_primary")).alias("primary"))
    guessed = pairs.filter(F.col("primary") | F.col("key").rlike("(id|code|no|key)$")).select("left", "right", F.when(F.col("primary"), PRIMARY).when(F.lower("left_column") == F.lower("right_column"), SAME_NAME).otherwise(SAME_KEY).alias("confidence"))
    stated = spark.createDataFrame([(*sorted(p), DECLARED) for p in declared], "left string, right string, confidence double")
    return guessed.unionByName(stated).groupBy("left", "right").agg(F.max("confidence").alias("confidence"))


def ddl(columns: DataFrame) -> DataFrame:
    """(table_name, ddl) from (table_name, nth, column_name, type): each table's definition as text."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", "column_name", "type"))), lambda x: F.concat(F.lit("  "), x["column_name"], F.lit(" "), x["type"]))
    return columns.groupBy("table_name").agg(F.concat(F.lit("CREATE TABLE "), F.first("table_name"), F.lit(" (\n"), F.array_join(lines, ",\n"), F.lit("\n)")).alias("ddl"))


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, nth, column_name, type) of all columns."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema)], "table_name string, nth int, column_name string, type string")


def known_values(probes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Probes (table_name, column_name, value) that some row of the column equals, null included.

    All probes of a table are looked up in one pass; they are what a plan names, so they are few and go to every executor.
    """
    found = None
    for name, df in tables.items():
        asked = F.broadcast(probes.filter(F.col("table_name") == name))
        columns = [r[0] for r in asked.select("column_name").distinct().collect() if r[0] in df.columns]
        if not columns:
            continue
        values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])))
        hit = values.join(asked, (F.col("c") == F.col("column_name")) & F.col("v").eqNullSafe(F.col("value"))).select("table_name", "column_name", "value").distinct()
        found = hit if found is None else found.unionByName(hit)
    return found if found is not None else probes.limit(0)


def overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """How two columns' values meet: common values, shares of either side, Jaccard, and the cardinality the values allow."""
    a = left.filter(F.col(left_column).isNotNull()).groupBy(F.col(left_column).alias("v")).agg(F.count("*").alias("a"))
    b = right.filter(F.col(right_column).isNotNull()).groupBy(F.col(right_column).alias("v")).agg(F.count("*").alias("b"))
    both = a.join(b, "v", "full_outer").agg(
        F.count("a").alias("left_distinct"), F.count("b").alias("right_distinct"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"),
        F.coalesce(F.max("a"), F.lit(0)).alias("most_a"), F.coalesce(F.max("b"), F.lit(0)).alias("most_b"),
    )
    share = lambda n, d: F.round(F.coalesce(F.try_divide(n, d), F.lit(0.0)), 6)
    kind = F.when((F.col("most_a") <= 1) & (F.col("most_b") <= 1), "one_to_one").when(F.col("most_a") <= 1, "one_to_many").when(F.col("most_b") <= 1, "many_to_one").otherwise("many_to_many_or_unknown")
    return both.select(
        "left_distinct", "right_distinct", "common", share(F.col("common"), F.col("left_distinct")).alias("left_coverage"), share(F.col("common"), F.col("right_distinct")).alias("right_coverage"),
        share(F.col("common"), F.col("left_distinct") + F.col("right_distinct") - F.col("common")).alias("jaccard"), kind.alias("cardinality"),
    )


def confidence(base: Column, common: Column, least_coverage: Column) -> Column:
    """A guess after the values were seen: at most 0.25 without common ones, a little more with good coverage."""
    return F.when(common == 0, F.least(base, F.lit(0.25))).when(least_coverage >= 0.8, F.greatest(base, F.least(base + 0.05, F.lit(0.98)))).otherwise(base)


def value_sample(df: DataFrame, column: str, n: int = 50) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def owners(columns: DataFrame) -> DataFrame:
    """Column name (lowered) to all tables that have it."""
    return columns.groupBy(F.lower("column_name").alias("column_name")).agg(F.sort_array(F.collect_set("table_name")).alias("tables"))
