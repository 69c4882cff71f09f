"""Column functions over text: keys, tokens, buckets, clips, redaction.  All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAN = r"㐀-䶿一-鿿"


def fold_ascii(column: Column) -> Column:
    """Lower A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def column_key(name: Column) -> Column:
    """A column's name without its one-letter type prefix and without marks, for matching across tables."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "^(c|i|d|f|n|s)_", ""), rf"[^a-z0-9{HAN}]", "")


def tokens(text: Column) -> Column:
    """Distinct words: camelCase and underscores part words; runs of Han characters also give their pairs and triples."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"), "_", " "))
    words = F.regexp_extract_all(spaced, F.lit("[a-z0-9]+"), F.lit(0))
    han = F.regexp_extract_all(spaced, F.lit(f"[{HAN}]+"), F.lit(0))

    def grams(run: Column, n: int) -> Column:
        last = F.length(run) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = F.flatten(F.transform(han, lambda r: F.concat(F.array(r), grams(r, 2), grams(r, 3))))
    return F.array_distinct(F.concat(words, parts))


def words(text: Column) -> Column:
    """All runs of letters a-z (A-Z lowered) and digits, with repeats."""
    return F.regexp_extract_all(fold_ascii(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bucket(key: Column, buckets: int = 100) -> Column:
    """A stable bucket: the first 32 bits of the SHA-256 of the key as text."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % buckets


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in the order of their names; nulls are written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def clip(text: Column, most: int, gap: str = " ... ") -> Column:
    """The text, or 70 % of `most` characters from its head and 30 % from its tail."""
    head = most * 7 // 10
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(gap), F.right(text, F.lit(most - head))))


def token_estimate(text: Column) -> Column:
    """A guess at model tokens: ASCII characters by 3.2, others one each, and 4."""
    others = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.ceil((F.length(text) - others) / 3.2 + others + 4)


# What counts as a secret in stored text, and column names that are masked whole.
SECRET_PATTERNS = (r"AKIA[A-Z0-9]{16}", r"(?i)(password|secret|token|api_?key)\s*[:=]\s*[^\s]+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
SECRET_NAMES = r"(?i)(password|passwd|secret|token|api_?key|credential)"
MASK = "[REDACTED]"


def redact(text: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, MASK)
    return text


def masked_columns(df: DataFrame) -> DataFrame:
    """The same columns; those with a sensitive name hold the mask wherever they hold anything."""
    return df.select(*[F.when(F.col(f"`{c}`").isNotNull(), MASK).alias(c) if re.search(SECRET_NAMES, c) else F.col(f"`{c}`") for c in df.columns])


def decoded(text: Column, schema: str, fallback: str | None = None) -> Column:
    """JSON of the schema; the fallback (JSON as well), or null without one, where the text is none."""
    found = F.from_json(text, f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    value = F.when(found.isNotNull() & found["__broken"].isNull(), F.struct(*[found[n].alias(n) for n in names]))
    return value if fallback is None else F.coalesce(value, F.from_json(F.lit(fallback), schema))


# Words that are asked for together, and concepts with the words that stand for them.
SYNONYMS = {"案例": ("案件", "case"), "案件": ("案例", "case"), "多少": ("数量", "计数", "count"), "几个": ("数量", "计数", "count"), "数量": ("多少", "计数", "count")}
CONCEPTS = {
    "aggregation": ("统计", "数量", "多少", "计数", "聚合", "分组", "count", "sum", "avg"),
    "join": ("关联", "连接", "联表", "join", "exists", "重复计数", "fanout"),
    "schema": ("字段", "列名", "表名", "schema", "ddl", "模式链接"),
    "filter": ("筛选", "过滤", "条件", "等于", "范围", "filter", "where"),
    "ordering": ("排序", "最高", "最低", "最多", "最少", "order", "limit", "top"),
}


def expanded(text: Column, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> Column:
    """The text, and behind it the synonyms of every term it holds."""
    return F.concat_ws(" ", text, *[F.when(F.contains(text, F.lit(term)), " ".join(others)) for term, others in synonyms.items()])


def memory_tokens(text: Column) -> Column:
    """Distinct words, pairs of Han characters, and concept:<name> for each concept that a word stands for."""
    low = F.lower(F.coalesce(text, F.lit("")))
    han = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(F.filter(han, lambda r: F.length(r) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    concepts = F.array_compact(F.array(*[F.when(low.rlike("|".join(aliases)), f"concept:{name}") for name, aliases in CONCEPTS.items()]))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), pairs, concepts))


def sql_fingerprint(sql: Column) -> Column:
    """SHA-256 of SQL text with white space evened and the last semicolon gone."""
    return F.sha2(F.regexp_replace(F.trim(F.regexp_replace(sql, r"\s+", " ")), r"\s*;$", ""), 256)


def grounded(value: Column, question: Column) -> Column:
    """Whether a question says the value: as words of their own where it begins or ends with a letter or digit of ASCII, else anywhere."""
    v = F.lower(F.trim(value))
    word = F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.replace(v, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![a-z0-9_])"))
    return (F.length(v) > 0) & F.rlike(F.lower(question), word) | (v.rlike(rf"^[{HAN}]+$") & F.contains(F.lower(question), v))


def only_wildcards_added(pattern: Column, literal: Column) -> Column:
    """Whether a LIKE pattern is the literal with nothing but % before or behind it."""
    return F.regexp_replace(F.regexp_replace(pattern, "^%+", ""), "%+$", "") == literal
