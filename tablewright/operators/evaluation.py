"""Results compared, outcomes summed up, and the gates that decide on a release."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(df: DataFrame) -> DataFrame:
    """One column of tagged values: numbers rounded to six places, bytes by digest, nulls apart from empty texts.

    Column names don't count, their order does.
    """

    def tagged(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            said = F.concat(F.lit("b:"), c.cast("string"))
        elif isinstance(f.dataType, T.BinaryType):
            said = F.concat(F.lit("x:"), F.sha2(c, 256), F.lit(":"), F.length(c).cast("string"))
        elif isinstance(f.dataType, T.IntegralType):
            said = F.concat(F.lit("n:"), c.cast("string"))
        elif isinstance(f.dataType, T.NumericType):
            # numbers too large for the decimal keep Spark's own way to write them
            places = F.regexp_replace(F.round(c, 6).try_cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
            said = F.concat(F.lit("n:"), F.coalesce(places, c.cast("string")))
        else:
            said = F.concat(F.lit("s:"), c.cast("string"))
        return F.coalesce(said, F.lit("null"))

    return df.select(F.array(*[tagged(f) for f in df.schema]).alias("values"))


def result_differences(a: DataFrame, b: DataFrame, place: str | None = None) -> DataFrame:
    """(values, n, m): canonical rows that stand n times in a but m times in b.

    place: a column that numbers the rows of either result, where the question asks for an order.  It becomes part of
    the row, so that rows in other places differ.
    """
    first = lambda d: d.select(place, *[c for c in d.columns if c != place]) if place else d
    x, y = (canonical(first(d)).groupBy("values").agg(F.count("*").alias("n")) for d in (a, b))
    return x.join(y.withColumnRenamed("n", "m"), "values", "full_outer").filter(~F.col("n").eqNullSafe(F.col("m"))).select("values", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


def same_rows(a: DataFrame, b: DataFrame, place: str | None = None) -> bool:
    """Equal multisets of canonical rows; with place, equal in order."""
    return len(a.columns) == len(b.columns) and result_differences(a, b, place).isEmpty()


def result_fingerprint(df: DataFrame) -> str:
    """A digest of the multiset of rows: sums of row hashes, so that no order and no collecting is needed."""
    n, s, x = canonical(df).agg(F.count("*"), F.sum(F.xxhash64("values").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(values, 17))")).first()
    return f"{n}:{s or 0}:{x or 0}"


def recall(wanted: Column, found: Column) -> Column:
    """Share of the wanted members found; null if nothing was wanted."""
    w = F.array_distinct(wanted)
    return F.try_divide(F.size(F.array_intersect(w, found)), F.size(w))


def nearest_rank(column: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def metrics(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Means of what is true or false, means of recalls where there are any, and times at the half and at 95 %."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("cases"), *[mean(c) for c in ("execution_accuracy", "executable", "ast_valid", "safe", "table_recall", "column_recall", "join_edge_recall", "value_grounding_accuracy") if c in outcomes.columns],
        F.percentile("duration_ms", F.lit(0.5)).alias("p50"), nearest_rank("duration_ms", 0.95).alias("p95"),
    )


def histogram(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Counts of each known state, zeros included, and of any other that occurs."""
    states = df.sparkSession.createDataFrame([(k,) for k in known], "state string")
    counts = df.groupBy(F.col(column).cast("string").alias("state")).agg(F.count("*").alias("n"))
    return states.join(counts, "state", "full_outer").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def compared(base: DataFrame, candidate: DataFrame, key: str, right: str) -> DataFrame:
    """Each case of either run: fixed, regressed, same or missing on one side."""
    a, b = base.select(key, F.col(right).cast("boolean").alias("was")), candidate.select(key, F.col(right).cast("boolean").alias("is"))
    change = F.when(F.col("was").isNull() | F.col("is").isNull(), "missing").when(~F.col("was") & F.col("is"), "fixed").when(F.col("was") & ~F.col("is"), "regressed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


#: Choices for one split that exact_split tries before it says that there is none.
MOST_CHOICES = 1000


@dataclass(frozen=True)
class Gate:
    """Bounds of a promotion."""

    least_gain: float = 0.02
    least_fixed: int = 5
    safety: float = 1.0
    most_drop: float = 0.01
    most_bucket_drop: float = 0.03
    most_slower: float = 1.2


def promotion(base: DataFrame, candidate: DataFrame, gate: Gate = Gate(), declared: float | None = None) -> DataFrame:
    """One row: each check of the gate, and whether all hold.

    Both: case_id, bucket, execution_accuracy, executable, safe (booleans), duration_ms; ast_valid (as executable) and
    split, in whose holdout no case may regress, where they are there.  declared: what the candidate says of its own
    accuracy; it must be what its cases give.
    """
    means = {"ex": "execution_accuracy", "run": "executable", "safe": "safe", "ast": "ast_valid" if "ast_valid" in base.columns and "ast_valid" in candidate.columns else "executable"}
    total = lambda d, n: d.agg(*[F.avg(F.col(c).cast("double")).alias(f"{k}_{n}") for k, c in means.items()], nearest_rank("duration_ms", 0.95).alias(f"p95_{n}"))
    held = base.filter("split = 'holdout'").select("case_id") if "split" in base.columns else base.limit(0).select("case_id")
    changes = compared(base, candidate, "case_id", "execution_accuracy").join(held.withColumn("held", F.lit(True)).distinct(), "case_id", "left")
    net = changes.agg(F.count_if(F.col("held") & (F.col("change") == "regressed")).alias("held_regressed"), (F.count_if(F.col("change") == "fixed") - F.count_if(F.col("change") == "regressed")).alias("net"), F.count_if(F.col("change") == "missing").alias("missing"))
    per = lambda d, n: d.groupBy("bucket").agg(F.avg(F.col("execution_accuracy").cast("double")).alias(n))
    worst = per(base, "a").join(per(candidate, "b"), "bucket", "full_outer").agg(F.max(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("bucket_drop"))
    # four tables of one row each
    row = reduce(DataFrame.crossJoin, [total(base, "base"), total(candidate, "new"), net, worst])
    checks = {
        "same_cases": F.col("missing") == 0,
        "gain": F.col("ex_new") - F.col("ex_base") >= gate.least_gain - 1e-9,
        "net_fixed": F.col("net") >= gate.least_fixed,
        "safety": F.col("safe_new") >= gate.safety,
        "executable": F.col("run_base") - F.col("run_new") <= gate.most_drop + 1e-9,
        "ast": F.col("ast_base") - F.col("ast_new") <= gate.most_drop + 1e-9,
        "holdout": F.col("held_regressed") == 0,
        "declared": F.lit(True) if declared is None else F.abs(F.col("ex_new") - declared) <= 1e-6,
        "buckets": F.col("bucket_drop") <= gate.most_bucket_drop + 1e-9,
        "latency": F.col("p95_new") <= F.col("p95_base") * gate.most_slower,
    }
    return row.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]).withColumn("promote", reduce(Column.__and__, [F.col(n) for n in checks]))


# Reasons of failures, the first that holds.
FAILURES = (("unsafe", "NOT safe"), ("not_executable", "NOT executable"), ("wrong_tables", "table_recall < 1"), ("wrong_result", "NOT execution_accuracy"))


# What the gates' codes say about a failure, the first kind of which any code holds.
GATE_CODES = {
    "PARSE_ERROR": ("parse_error",),
    "UNKNOWN_TABLE": ("unknown_table",),
    "UNKNOWN_COLUMN": ("unknown_column",),
    "UNSAFE_SQL": ("read_only_query_required", "write_or_control_statement_forbidden", "comments_not_allowed", "exactly_one_statement_required", "blocked_function"),
    "SCHEMA_LINK_MISMATCH": (
        "sql_tables_outside_schema_plan", "sql_columns_outside_schema_plan", "unexpected_table", "missing_table", "unexpected_column", "unresolved_sql_column", "missing_bound_column",
        "missing_schema_binding", "ambiguous_schema_binding", "invalid_schema_binding", "missing_value_binding", "ambiguous_value_binding",
    ),
    "FILTER_MISMATCH": ("filter_mismatch", "unsupported_filter_expression"),
    "VALUE_GROUNDING_MISMATCH": ("unverified_value_binding",),
    "AGGREGATION_MISMATCH": ("aggregation_mismatch", "distinct_mismatch", "group_by_mismatch", "result_shape_mismatch"),
    "JOIN_OR_GRAIN_MISMATCH": ("missing_join", "unexpected_join", "result_grain_mismatch"),
    "PLANNING_FAILURE": (
        "worker_failed", "unsupported_query_contract", "duplicate_slot_id", "missing_logical_reference", "missing_bound_query_plan", "lead_plan_not_approved",
        "missing_or_invalid_approved_query_plan", "invalid_revision_request_contract", "invalid_post_revision_approval_contract",
    ),
    "CANDIDATE_GENERATION_FAILURE": ("sql_generation_failure", "no_accepted_sql_candidate", "candidate_gate_rejected", "candidate_gate_runtime_failure"),
    "CRITIC_REJECTION": ("critic_runtime_failure", "critic_rejected_all_candidates"),
    "LEAD_SELECTION_FAILURE": ("invalid_final_candidate_index", "critic_rejected_candidate"),
}
# States of a run that name the failure by themselves.
RUN_STATES = {"needs_clarification": "NEEDS_CLARIFICATION", "framework_error": "FRAMEWORK_ERROR", "timeout": "TIMEOUT", "execution_error": "EXECUTION_ERROR", "user_correction": "USER_CORRECTION", "no_sql": "NO_SQL"}
#: Parts of two queries that are told apart, in this order, and what a difference is.
PARTS = (("tables", "JOIN_OR_GRAIN_MISMATCH"), ("joins", "JOIN_OR_GRAIN_MISMATCH"), ("aggregates", "AGGREGATION_MISMATCH"), ("grouping", "AGGREGATION_MISMATCH"), ("filters", "FILTER_MISMATCH"))


def _first_of(pairs: list[tuple[Column, str | None]], otherwise: Column) -> Column:
    out = otherwise
    for test, kind in reversed(pairs):
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out


def gate_failure(errors: Column) -> Column:
    """The kind that a list of gate errors stands for (what follows a colon is detail); other errors are unsafe, none at all a mere mismatch."""
    said = F.transform(F.filter(errors, lambda e: F.trim(e) != ""), lambda e: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.lower(e), r"^\s*sql_safety:", ""), ":.*$", ""))))
    codes = F.transform(said, lambda c: F.when(c.startswith("blocked_function"), "blocked_function").otherwise(c))
    tests = [(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in known])), kind) for kind, known in GATE_CODES.items()]
    return _first_of(tests, F.when(F.size(said) > 0, "UNSAFE_SQL").otherwise("RESULT_MISMATCH"))


def attributed(outcomes: DataFrame) -> DataFrame:
    """Each case with failure: null if it is right, else one of the kinds.

    outcomes: status, errors (list), right (boolean), row_count, and for each of PARTS gold_<part> and sql_<part>, sorted
    lists of strings.  A state of the run comes first, then gate errors, then what differs between the two queries.
    """
    differs = [(~F.col(f"gold_{p}").eqNullSafe(F.col(f"sql_{p}")), kind) for p, kind in PARTS]
    mismatch = _first_of([*differs, (F.col("row_count") == 0, "UNEXPECTED_EMPTY")], F.lit("RESULT_MISMATCH"))
    tests = [(F.col("right"), None), *[(F.col("status") == s, kind) for s, kind in RUN_STATES.items()]]
    return outcomes.withColumn("failure", _first_of(tests, F.when(F.size("errors") > 0, gate_failure(F.col("errors"))).otherwise(mismatch)))


def failure_kind() -> Column:
    out = F.lit(None).cast("string")
    for name, test in reversed(FAILURES):
        out = F.when(F.expr(test), name).otherwise(out)
    return out


def split_by_hash(df: DataFrame, key: str, salt: str, shares: dict[str, int]) -> DataFrame:
    """A split for each key by its place in a salted hash order within 100 buckets; equal keys stay together."""
    b = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    out, upto = F.lit(None).cast("string"), 0
    for name, share in shares.items():
        out = F.when(out.isNull() & (b < upto + share), name).otherwise(out)
        upto += share
    return df.withColumn("split", out)


def hash_ordered(df: DataFrame, by: str, key: str, salt: str) -> DataFrame:
    """Each row's place in the salted hash order of the keys of its group, from 1."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), key))
    return df.withColumn("place", place.cast("long"))


def choices(groups: dict[int, int], want: int) -> Iterator[dict[int, int]]:
    """How many groups of each size (groups: size -> how many there are) make exactly the wanted sum; every way, but some come twice.

    The first ways take most sizes in proportion, so that only the small rest needs a table of the sums that can be reached.
    """
    total = sum(size * n for size, n in groups.items())
    for tenths in (10, 9, 5, 0) if 0 <= want <= total else ():
        fixed = {size: n * want * tenths // (10 * total) if total else 0 for size, n in groups.items()}
        sizes, rest = sorted((s for s in groups if s > 0), reverse=True), want - sum(size * n for size, n in fixed.items())
        spare = [groups[s] - fixed[s] for s in sizes]
        reach = [1]  # bit sets: sums that the last sizes make
        for size, n in zip(reversed(sizes), reversed(spare), strict=True):
            sums, step = reach[-1], 1
            while n:
                step = min(step, n)
                sums |= (sums << size * step) & ((1 << rest + 1) - 1)
                n, step = n - step, 2 * step
            reach.append(sums)
        reach.reverse()
        open_ = [(0, rest, ())] if reach[0] >> rest & 1 else []
        while open_:
            at, left, taken = open_.pop()
            if at == len(sizes):
                yield fixed | {s: fixed[s] + n for s, n in zip(sizes, taken, strict=True)}
                continue
            ways = range(min(spare[at], left // sizes[at]) + 1)
            open_ += [(at + 1, left - n * sizes[at], (*taken, n)) for n in ways if reach[at + 1] >> left - n * sizes[at] & 1]


def exact_counts(groups: dict[int, int], wants: dict[str, int]) -> dict[str, dict[int, int]]:
    """Groups of each size for each split; a choice that leaves a later split without one is taken back."""
    (split, want), *later = wants.items()
    failed = ValueError(f"no groups make {want} rows for {split}")
    for taken in itertools.islice(choices(groups, want), MOST_CHOICES):
        try:
            left = {size: n - taken[size] for size, n in groups.items()}
            return {split: taken} | (exact_counts(left, dict(later)) if later else {})
        except ValueError as e:
            failed = e
    raise failed


def exact_split(groups: DataFrame, key: str, n: str, salt: str, shares: dict[str, int]) -> DataFrame:
    """(key, n, split): whole groups to splits whose sizes are exactly their shares of 100; the last split takes what is left.

    groups: one row a group.  Only how many groups there are of each size goes to the driver, and how many of them each
    split takes comes back; among groups of one size the salted hash order decides.  An error says if no choice is exact.
    """
    spark, digest = groups.sparkSession, F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = groups.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(n).cast("long"), F.lit(0)).alias("n"), digest.alias("h")).withColumn("part", F.substring("h", 1, 3))
    counted = rows.groupBy("n", "part").agg(F.count("*").alias("groups"))
    sizes = {r["n"]: r["groups"] for r in counted.groupBy("n").agg(F.sum("groups").alias("groups")).collect()}
    total = sum(size * many for size, many in sizes.items())
    wants = {split: round(total * share / 100) for split, share in shares.items()}
    last = list(wants)[-1]
    wants[last] = total - sum(want for split, want in wants.items() if split != last)
    taken, quotas, start = exact_counts(sizes, wants), [], dict.fromkeys(sizes, 0)
    for split in wants:
        for size in sizes:
            many = taken[split][size] if split != last else sizes[size] - start[size]
            quotas.append((size, split, start[size], start[size] + many))
            start[size] += many
    before = F.sum("groups").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(counted.select("n", "part", F.coalesce(before, F.lit(0)).alias("before")), ["n", "part"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("n", "part").orderBy("h", "key")) - 1
    bounds = spark.createDataFrame(quotas, "size long, split string, first long, upto long")
    chosen = placed.withColumn("place", place).join(F.broadcast(bounds), (F.col("n") == F.col("size")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("upto")))
    return chosen.select("key", "n", "split")


def usage(calls: DataFrame, run: str, price_in: float, price_out: float) -> DataFrame:
    """Per run: calls, tokens in and out, and what they cost; prices are for a million tokens."""
    sums = calls.groupBy(run).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return sums.withColumn("cost", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 8))


def counters(observations: DataFrame, name: str, duration: str) -> DataFrame:
    """Per name: how many observations, and the sum of their durations."""
    return observations.groupBy(name).agg(F.count("*").alias("count"), F.round(F.sum(duration), 6).alias("duration_sum"))


def united_sources(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, n, source): each source of a rule once, beside how often the rule occurred; a row a source, so that no list grows without bound."""
    return df.select(key, source).distinct().join(df.groupBy(key).agg(F.count("*").alias("n")), key)


def first_per_skill(df: DataFrame, skill: str, fingerprint: str, order: list[str], most: int = 50) -> DataFrame:
    """The first row of each fingerprint of a skill, and of those the first `most` of each skill."""
    once = F.row_number().over(Window.partitionBy(skill, fingerprint).orderBy(*order))
    nth = F.row_number().over(Window.partitionBy(skill).orderBy(*order))
    return df.withColumn("__once", once).filter("__once = 1").withColumn("__nth", nth).filter(F.col("__nth") <= most).drop("__once", "__nth")


# What each grade of evidence must prove, as (reason if it doesn't, condition).
ADMISSION = {
    "deterministic_plan_revision": (
        ("plan_issue_not_proven", "before_issue_present"), ("plan_issue_not_resolved", "after_issue_resolved"),
        ("plan_change_not_proven", "before_plan != '' AND after_plan != '' AND before_plan != after_plan"), ("approved_plan_missing", "approved_plan != ''"),
    ),
    "deterministic_repair": (
        ("rejected_sql_not_proven", "NOT before_accepted"), ("repaired_sql_not_accepted", "after_accepted"), ("gate_codes_missing", "size(gate_codes) > 0"),
        ("before_sql_missing", "before_sql != ''"), ("after_sql_missing", "after_sql != ''"), ("approved_plan_missing", "approved_plan != ''"), ("bound_plan_missing", "bound_plan != ''"),
    ),
    "human_correction_with_gate": (
        ("negative_user_feedback_missing", "feedback = 'incorrect'"), ("feedback_reason_missing", "feedback_note"), ("corrected_sql_not_gate_accepted", "corrected_accepted"),
        ("corrected_sql_proof_missing", "after_accepted AND after_sql != ''"),
    ),
}


def admitted(evidence: DataFrame) -> DataFrame:
    """Each row with reasons against its automatic admission, and eligible where there are none.  A null proves nothing."""
    fails = lambda reason, holds: F.when(~F.coalesce(F.expr(holds), F.lit(False)), reason)
    common = [fails("experience_not_admissible", "state IN ('candidate', 'confirmed')"), fails("source_task_missing", "trim(source_task) != ''")]
    by_grade = F.when(F.lit(False), F.array().cast("array<string>"))
    for grade, proofs in ADMISSION.items():
        by_grade = by_grade.when(F.col("grade") == grade, F.array(*[fails(*p) for p in proofs]))
    found = F.array_compact(F.concat(F.array(*common), by_grade.otherwise(F.array(F.lit("evidence_grade_not_automatic")))))
    return evidence.withColumn("reasons", F.array_distinct(found)).withColumn("eligible", F.size("reasons") == 0)


def occurrences(df: DataFrame, key: str, source: str) -> DataFrame:
    """Equal rules as one: how often, and from which sources; sources are counted apart, so that no list grows without bound."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(source).alias("sources"))


def running_share(df: DataFrame, key: str, order: str, right: str) -> DataFrame:
    """Accuracy up to each case of a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("so_far", F.round(F.avg(F.col(right).cast("double")).over(w), 6))
