import pytest
from pyspark.sql import functions as F

from tablewright import more_queries
from tablewright.operators import evaluation, release, retrieval

RUN = "k int, status string, sql string, result string, errors array<string>, refs array<string>, question string, error string, ms double"


def test_shadow_differences_and_decisions(spark):
    run = lambda k, status="success", sql="q", result="r", errors=(), refs=("a",), question=None, error="", ms=10.0: (k, status, sql, result, list(errors), list(refs), question, error, ms)
    stable = spark.createDataFrame([run(1), run(2), run(3, "rejected", errors=["x", "y"]), run(4), run(5, "needs_clarification", question="which?"), run(6), run(7)], RUN)
    candidate = spark.createDataFrame([run(1, refs=["a", "a"]), run(2, result="other", sql="p"), run(3, "rejected", errors=["y", "x"]), run(4, "rejected", errors=["blocked_function:f"]), run(5, "needs_clarification", question="who?"), run(6, error="boom")], RUN)
    got = {r.k: (r.result_equivalent, r.sql_changed, r.refs_changed, r.candidate_failed, r.review_required) for r in release.shadow_diff(stable, candidate, "k").collect()}
    assert got == {1: (True, False, False, False, False), 2: (False, True, False, False, True), 3: (True, False, False, False, False), 4: (False, False, False, True, True), 5: (False, False, False, False, True), 6: (True, False, False, True, True), 7: (False, True, True, True, True)}
    assert release.shadow_decision(release.shadow_diff(stable, candidate, "k")).first().decision == "rolled_back:candidate_runtime_or_safety_failure"
    few = spark.createDataFrame([run(i) for i in range(5)], RUN)
    assert release.shadow_decision(release.shadow_diff(few, few, "k")).first().decision == "shadow_running"
    many = spark.createDataFrame([run(i) for i in range(20)], RUN)
    slow = spark.createDataFrame([run(i, ms=20.0) for i in range(20)], RUN)
    slower = spark.createDataFrame([run(i, ms=40.0) for i in range(20)], RUN)
    assert [release.shadow_decision(release.shadow_diff(many, c, "k")).first().decision for c in (many, slow, slower)] == ["shadow_review", "shadow_review", "rolled_back:shadow_threshold_exceeded"]


def test_target_replay(spark):
    codes = "k int, codes array<string>"
    problems = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a")], "k int, code string")
    before, after = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["a"]), (4, ["a"])], codes), spark.createDataFrame([(1, ["b"]), (2, []), (3, ["a"]), (4, ["c"])], codes)
    assert {r.k: (r.present_before, r.gone_after, r.new_codes, r.passed) for r in release.target_replay(problems, before, after, "k").collect()} == {1: (True, True, [], True), 2: (False, True, [], False), 3: (True, False, [], False), 4: (True, True, ["c"], False), 5: (False, False, [], False)}


def test_orders_counts_and_cost(spark):
    df = spark.createDataFrame([("b", "rejected"), ("a", "approved"), ("a", "pending"), ("a", "odd")], "g string, s string")
    assert [r.s for r in release.in_state_order(df, "s", ["pending", "approved"]).collect()] == ["pending", "approved", "odd", "rejected"]
    assert sorted(map(tuple, release.review_counts(df, "g", "s").collect())) == [("a", 3, 1, 0, 1), ("b", 1, 0, 1, 0)]
    assert spark.range(1).select(release.cost(F.lit(2_000_000), F.lit(500_000), 3.0, 4.0)).first()[0] == 8.0


def test_evidence(spark):
    items = spark.createDataFrame(
        [("v", "value", "Level", "column:t.level", ["t.level"], "strong", ["strong", "x"]), ("s", "schema", "level of rock", "column:t.level", None, None, None), ("n", "schema", "other", "k", [], "c", []), ("g", "verified_example", "level", "k", [], "", [])],
        "item_id string, kind string, title string, item_key string, dependencies array<string>, content string, values array<string>",
    )
    asked = spark.createDataFrame([(1, "level of rock"), (2, "how many are STRONG"), (3, ""), (4, None)], "question_id int, text string")
    got = {(r.question_id, r.item_id): r.score for r in retrieval.evidence_scores(asked, items, "lead").collect()}
    assert set(got) == {(1, "v"), (1, "s"), (2, "v")}
    from math import log1p

    level = 1 + log1p(5)
    assert got[1, "s"] == round(4 + 2.4 * (level + (1 + log1p(2)) + (1 + log1p(4))) + 3, 6)
    assert got[2, "v"] == round(0.9 * (4 / 4 + (1 + log1p(6)) + 12), 6)
    scored = spark.createDataFrame([(1, "a", 3.0, "SELECT x FROM t", ["t"], ["x"]), (1, "b", 5.0, "SELECT * FROM t", ["t"], []), (1, "c", 4.0, "SELECT y FROM u", ["u"], ["y"]), (1, "d", 2.0, "SELECT x, x FROM t", ["t"], ["x"])], "question_id int, item_id string, score double, sql string, tables array<string>, columns array<string>")
    assert [r.item_id for r in retrieval.fitting_examples(scored, ["t"], ["x"]).orderBy("item_id").collect()] == ["a", "d"]
    assert [r.item_id for r in retrieval.fitting_examples(scored, ["t"], ["x"], characters=20).collect()] == ["a"]


def cases(spark, right, **more):
    rows = [(i, "b", r, True, True, True, 1.0, "holdout" if i % 2 else "train") for i, r in enumerate(right)]
    return spark.createDataFrame(rows, "case_id int, bucket string, execution_accuracy boolean, executable boolean, ast_valid boolean, safe boolean, duration_ms double, split string")


def test_promotion_watches_the_holdout_and_what_is_declared(spark):
    base, better = cases(spark, [False] * 12), cases(spark, [True] * 12)
    assert evaluation.promotion(base, better).first()["promote"] and evaluation.promotion(base, better, declared=1.0).first()["promote"]
    assert not evaluation.promotion(base, better, declared=0.9).first()["promote"]
    lost = evaluation.promotion(cases(spark, [False] * 11 + [True]), cases(spark, [True] * 11 + [False])).first()
    assert lost["gain"] and lost["net_fixed"] and not lost["holdout"] and not lost["promote"]


def test_exact_split(spark):
    groups = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "key string, n long")
    got = {r["key"]: r["split"] for r in evaluation.exact_split(groups, "key", "n", "s", {"train": 50, "validation": 30, "holdout": 20}).collect()}
    sizes = {"a": 5, "b": 3, "c": 2}
    assert {s: sum(sizes[k] for k, v in got.items() if v == s) for s in ("train", "validation", "holdout")} == {"train": 5, "validation": 3, "holdout": 2}
    with pytest.raises(ValueError, match="no groups make"):
        evaluation.exact_split(groups, "key", "n", "s", {"train": 10, "holdout": 90})


def test_exact_split_of_many_groups_and_of_choices_taken_back(spark):
    shares = {"train": 60, "validation": 20, "holdout": 20}
    many = spark.range(12_000).select(F.col("id").alias("key"), (1 + F.col("id") % 7).alias("n"))
    total = many.agg(F.sum("n")).first()[0]
    got = evaluation.exact_split(many, "key", "n", "s", shares)
    sums = {r["split"]: r["n"] for r in got.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert sums == {"train": round(total * 0.6), "validation": round(total * 0.2), "holdout": total - round(total * 0.6) - round(total * 0.2)}
    assert got.select("key").distinct().count() == got.count() == 12_000
    # 6 + 2 would do for the first split alone, and leave no 6 for the second
    assert evaluation.exact_counts({6: 1, 5: 1, 3: 1, 2: 1}, {"a": 8, "b": 6, "c": 2})["a"] == {6: 0, 5: 1, 3: 1, 2: 0}
    assert evaluation.exact_counts({5: 1, 3: 1, 2: 1}, {"a": 5, "b": 3, "c": 2}) == {"a": {5: 1, 3: 0, 2: 0}, "b": {5: 0, 3: 1, 2: 0}, "c": {5: 0, 3: 0, 2: 1}}


def test_exact_split_sizes_at_any_number_of_orders(spark, tmp_path):
    for rows, want in ((15_000, [3000, 9000, 3000]), (1, [0, 1, 0]), (0, [0, 0, 0])):
        folder = str(tmp_path / str(rows))
        spark.range(rows).selectExpr("id AS o_orderkey", "id % 1499 * id % 997 AS o_custkey").write.parquet(f"{folder}/orders.parquet")
        got = more_queries.exact_split_sizes(spark, folder).orderBy("split").collect()
        assert [r["n"] for r in got] == want


def test_gate_codes(spark):
    rows = [(["sql_safety:parse_error"], "PARSE_ERROR"), (["Unknown_Table: x", "missing_join"], "UNKNOWN_TABLE"), (["blocked_function_load"], "UNSAFE_SQL"), (["odd"], "UNSAFE_SQL"), ([" "], "RESULT_MISMATCH"), ([], "RESULT_MISMATCH")]
    df = spark.createDataFrame(rows, "errors array<string>, want string")
    assert df.filter(evaluation.gate_failure(F.col("errors")) != F.col("want")).count() == 0
