"""Secret scans over an incremental ledger of blobs and rule versions.

Every version of every text is addressed by its SHA-256, and every rule by its kind and a digest of
what it says, so a changed rule is a new version without anybody's care.  The ledger, a Parquet
table, holds for each scanned blob which rule versions went over it and what they found.  A scan
takes the pairs of blob and rule version that the ledger lacks, each blob once however many rows hold
it and under the missing rules alone, adds what it finds, and joins the ledger back to every row.  All
of it is DataFrame work.

A null text is an empty blob without findings.  Repeated rows give repeated results, an empty table
an empty one; columns beside the id and the text are never read.  Spans are code points, end
exclusive.  Matches of one kind are leftmost and don't overlap; kinds may overlap each other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from .common import scratch, stored, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Texts without this string have no match; a cheap test before the pattern.
    literal: str = ""
    #: The group that must have `least` characters, else the match counts for nothing (but is consumed).
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(repr((self.pattern, self.literal, self.group, self.least)).encode()).hexdigest()[:16]}"


# Kinds and patterns of the base rules, in the order in which equal starts are listed.
# AKIA and hex runs are maximal, so a lower bound in the pattern drops what a later test would drop.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# More kinds of credentials, by their public formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", "_"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
)
RULES = BASE + MORE

#: Blobs with findings that may be sent to every executor, some 200 bytes each; more are joined by a shuffle.
BROADCAST_FOUND = 50_000
SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("rule", "nth", "gap", "size", "kept")]))


def _matches(text: Column, at: int, rule: Rule) -> Column:
    """Lengths of the rule's matches and of the text before each, in order."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    each = F.transform(
        F.arrays_zip(found.alias("m"), group.alias("g"), F.slice(gaps, 1, F.size(found)).alias("b")),
        lambda x, i: F.struct(F.lit(at).alias("rule"), i.alias("nth"), F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["g"]) >= rule.least).cast("int").alias("kept")),
    )
    test = text.rlike(rule.pattern)
    test = text.contains(rule.literal) & test if rule.literal else test
    return F.when(test, each.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, rules) with distinct blobs to (blob, rules, spans): what the listed rule versions find, also where that is nothing."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    matches = [F.when(F.array_contains("rules", r.version), _matches(F.col("text"), i, r)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules)]
    found = blobs.select("blob", "rules", F.explode_outer(F.concat(*matches)).alias("x")).select("blob", "rules", "x.*")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("nth"))
    spans = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    span = F.when(F.col("kept") == 1, F.struct(F.get(versions, F.col("rule")).alias("rule"), "start", "end"))
    return spans.groupBy("blob", "rules").agg(F.collect_list(span).alias("spans"))


def listed(ledger: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """(blob, n_<base kind>..., base_sha256, spans): what the ledger has of these rules, as one row a blob."""
    versions, kinds = F.array(*[F.lit(r.version) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    spans = F.filter(F.flatten(F.collect_list("spans")), lambda x: F.array_contains(versions, x["rule"]))
    at = lambda x: (F.array_position(versions, x["rule"]) - 1).cast("int")
    whole = ledger.filter(F.arrays_overlap("rules", versions)).groupBy("blob").agg(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), at(x).alias("rule"), x["end"].alias("end")))).alias("all"))
    count = lambda rule: F.size(F.filter("all", lambda x: x["rule"] == rule))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return whole.select(
        "blob",
        *[count(i).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])],
        F.sha2(joined(F.filter("all", lambda x: x["rule"] < base)), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
    )


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), id_column: str = "doc_id") -> DataFrame:
    """Findings of every row; the ledger at that path (a new one if none is given) gains the pairs of blob and rule it lacked.

    The first `base` rules are counted one by one.  Only one scan may write a ledger at a time.  A scan that fails
    leaves no part of its rows.
    """
    rows = docs.select(F.col(id_column), text_of().alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    found = updated(rows, ledger, rules, base)
    # most blobs have no finding, so only the others travel to the rows; copies of one text may be very many
    some = stored(found.filter("spans != ''").withColumnRenamed("blob", "found"), "found")
    some = F.broadcast(some) if some.limit(BROADCAST_FOUND + 1).count() <= BROADCAST_FOUND else some
    none = {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")} | {f"n_{r.kind}": F.lit(0).cast("long") for r in rules[:base]}
    joined = rows.select(id_column, "blob").join(some, F.col("blob") == F.col("found"), "left")
    return joined.select(id_column, *[F.coalesce(c, none[c]).alias(c) for c in found.columns if c != "blob"])


def updated(rows: DataFrame, ledger: str | None, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """The ledger's findings after it has taken in all (blob, text) of the rows."""
    ledger = ledger or scratch(rows.sparkSession, "ledger")
    versions = F.array(*[F.lit(r.version) for r in rules])
    blobs = rows.select("blob", "text")
    if (known := _seen(rows, ledger)) is not None:
        done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        blobs = blobs.join(done, "blob", "left").withColumn("rules", F.array_except(versions, F.coalesce("done", F.array().cast("array<string>"))))
        fresh = blobs.filter(F.size("rules") > 0).groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("rules").alias("rules"))
    else:
        fresh = blobs.groupBy("blob").agg(F.any_value("text").alias("text")).withColumn("rules", versions)
    find(fresh, rules).write.mode("append").parquet(ledger)
    return listed(_seen(rows, ledger), rules, base)


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with every span found in `text` replaced by the mask (overlapping spans by one)."""
    # the rows' own columns stay in one struct, so that their names can be any
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("body")).withColumn("blob", F.unhex(F.sha2("body", 256)))
    found = updated(rows.select("blob", F.col("body").alias("text")), ledger, rules).filter("spans != ''")
    part = lambda x, i: F.element_at(F.split(x, ":"), i).cast("int")
    spans = F.transform(F.split("spans", ","), lambda x: F.struct(part(x, 2).alias("a"), part(x, 3).alias("z")))  # by start
    # a span that begins inside an earlier one has no gap before it and adds no mask of its own
    reach = lambda upto: F.coalesce(F.array_max(F.transform(F.slice("s", 1, upto), lambda x: x["z"])), F.lit(0))
    gaps = F.transform("s", lambda x, i: F.struct(reach(i).alias("b"), x["a"].alias("a"), (x["a"] >= reach(i)).alias("new")))
    cut = F.array_join(F.transform(F.filter("g", lambda x: x["new"]), lambda x: F.substring(F.col("body"), x["b"] + 1, x["a"] - x["b"])), mask)
    marked = found.select(F.col("blob").alias("found"), spans.alias("s")).withColumn("g", gaps).withColumn("end", reach(F.size("s"))).select("found", "g", "end")
    text = F.when(F.col("g").isNull(), F.col("row.text")).otherwise(F.concat(cut, F.lit(mask), F.substring(F.col("body"), F.col("end") + 1, F.length("body"))))
    out = rows.join(marked, F.col("blob") == F.col("found"), "left").withColumn("masked", text)
    return out.select(*[(F.col("masked") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _seen(docs: DataFrame, ledger: str) -> DataFrame | None:
    try:
        return docs.sparkSession.read.schema(SEEN).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


SEEN = "blob binary, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"
