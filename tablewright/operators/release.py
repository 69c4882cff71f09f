"""Two versions side by side: shadow runs compared, thresholds over them, and replays of known problems."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import nearest_rank

# Gate errors that mean that a statement wasn't safe.
UNSAFE = ("read_only_query_required", "write_or_control_statement_forbidden", "comments_not_allowed", "exactly_one_statement_required")
#: Less than this isn't slower, whatever the ratio.
LEAST_SLOWER_MS = 25.0


def shadow_diff(stable: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Each stable run beside the candidate's of its key, as flags; a missing candidate run counts as failed.

    Both: key, status, sql, result (a fingerprint), errors and refs (lists), question (what is asked back, if
    anything), error (of the run itself, or empty), ms.
    """
    names = ["status", "sql", "result", "errors", "refs", "question", "error", "ms"]
    a = stable.select(key, *[F.col(n).alias(f"a_{n}") for n in names])
    b = candidate.select(key, *[F.col(n).alias(f"b_{n}") for n in names])
    both = a.join(b, key, "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    codes = lambda c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>")))
    failed_run = F.col("b_status").isNull() | (text("b_error") != "")
    worked = (F.col("a_status") == "success") & (text("b_status") == "success")
    asked = (F.col("a_status") == "needs_clarification") & (text("b_status") == "needs_clarification")
    same_codes = ~failed_run & (F.col("a_status") == text("b_status")) & (codes("a_errors") == codes("b_errors"))
    equal = F.when(worked, (text("a_result") != "") & (text("a_result") == text("b_result"))).when(asked, same_codes & (text("a_question") == text("b_question"))).otherwise(same_codes)
    unsafe = F.exists(codes("b_errors"), lambda e: e.isin(*UNSAFE) | e.startswith("blocked_function"))
    out = both.select(
        key,
        F.col("a_ms").alias("stable_ms"),
        F.col("b_ms").alias("candidate_ms"),
        equal.alias("result_equivalent"),
        (text("a_sql") != text("b_sql")).alias("sql_changed"),
        (F.array_distinct(codes("a_refs")) != F.array_distinct(codes("b_refs"))).alias("refs_changed"),
        (failed_run | unsafe | ((F.col("a_status") == "success") & (text("b_status") != "success"))).alias("candidate_failed"),
    )
    return out.withColumn("review_required", F.col("candidate_failed") | ~F.col("result_equivalent") | F.col("sql_changed") | F.col("refs_changed"))


@dataclass(frozen=True)
class Shadow:
    """Bounds of a shadow deployment."""

    least_samples: int = 20
    most_failures: float = 0.0
    most_disagreement: float = 0.2
    most_slower: float = 1.2


def shadow_decision(diffs: DataFrame, by: list[str] = (), bounds: Shadow = Shadow()) -> DataFrame:
    """For each deployment: samples, rates, times at 95 %, and what follows from them."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    seen = diffs.groupBy(*by).agg(
        F.count("*").alias("samples"), rate(F.col("candidate_failed")).alias("failure_rate"), rate(~F.col("result_equivalent")).alias("disagreement_rate"),
        nearest_rank("stable_ms", 0.95).alias("stable_p95"), nearest_rank("candidate_ms", 0.95).alias("candidate_p95"),
    )
    slower = (F.col("candidate_p95") > F.col("stable_p95") * bounds.most_slower) & (F.col("candidate_p95") - F.col("stable_p95") > LEAST_SLOWER_MS)
    over = (F.col("failure_rate") > bounds.most_failures) | (F.col("disagreement_rate") > bounds.most_disagreement) | F.coalesce(slower, F.lit(False))
    decision = (
        F.when((F.col("failure_rate") > 0) & (bounds.most_failures == 0), "rolled_back:candidate_runtime_or_safety_failure")
        .when(F.col("samples") < bounds.least_samples, "shadow_running")
        .when(over, "rolled_back:shadow_threshold_exceeded")
        .otherwise("shadow_review")
    )
    return seen.withColumn("decision", decision)


def target_replay(problems: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Each known problem: was it there before, is it gone after, and which codes are new.

    problems: key, code; before and after: key, codes (a list, empty if nothing is wrong).  It passes only if it was
    reproduced, is gone, and brought nothing new; a missing run passes nothing.
    """
    rows = problems.select(key, "code").join(before.select(key, F.col("codes").alias("was")), key, "left").join(after.select(key, F.col("codes").alias("is")), key, "left")
    new = F.array_sort(F.array_except("is", "was"))
    out = rows.select(key, "code", F.coalesce(F.array_contains("was", F.col("code")), F.lit(False)).alias("present_before"), F.coalesce(~F.array_contains("is", F.col("code")), F.lit(False)).alias("gone_after"), F.coalesce(new, F.array().cast("array<string>")).alias("new_codes"))
    return out.withColumn("passed", F.col("present_before") & F.col("gone_after") & (F.size("new_codes") == 0))


def in_state_order(df: DataFrame, column: str, states: list[str]) -> DataFrame:
    """Rows in the order of a list of states, others last."""
    place = reduce(lambda c, x: c.when(F.col(column) == x[1], x[0]), enumerate(states), F.when(F.lit(False), -1)).otherwise(len(states))
    return df.orderBy(place, column)


def review_counts(df: DataFrame, by: str, state: str) -> DataFrame:
    """Per group: all, approved, rejected and pending rows."""
    count = lambda s: F.count_if(F.col(state) == s).alias(s)
    return df.groupBy(by).agg(F.count("*").alias("total"), count("approved"), count("rejected"), count("pending"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are for a million tokens."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 8)


def backfilled(tasks: DataFrame, feedback: DataFrame, key: str, value: str, missing: str) -> DataFrame:
    """Every task with the last of its feedback in text order, or `missing`, and how much of it there is."""
    return tasks.join(feedback, key, "left").groupBy(key).agg(F.coalesce(F.max(value), F.lit(missing)).alias(value), F.count(value).alias("n"))


def observed(observations: DataFrame, deployments: DataFrame, key: str) -> DataFrame:
    """Observations of deployments that there are, with what is known of them."""
    return observations.join(deployments, key)
