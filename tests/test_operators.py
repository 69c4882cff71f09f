"""Catalog, windows, retrieval, evaluation, bounded SQL, sources and streams on small frames."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright import queries
from tablewright.functions.text import clip, column_key, decoded, fingerprint, token_estimate, tokens
from tablewright.operators import catalog, evaluation, execution, retrieval, windows
from tablewright.sources import documents, tables
from tablewright.streaming.append import append_new, windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, 1, 2.5, "a"), (2, 2, None, "B"), (3, None, 3.5, None), (4, 5, 1.25, "ä")], "id int, i int, r double, s string")


def test_profile(nulls):
    got = {r["column_name"]: r for r in catalog.profile(nulls, "nulls").collect()}
    assert (got["i"]["null_count"], got["i"]["distinct_count"], got["i"]["least"], got["i"]["most"], got["i"]["null_ratio"]) == (1, 3, 1.0, 5.0, 0.25)
    assert (got["s"]["max_length"], got["s"]["least"]) == (1, None)
    assert {r["column_name"]: r["values"] for r in catalog.low_cardinality(nulls, catalog.profile(nulls, "nulls")).collect()}["s"] == ["B", "a", "ä"]
    empty = catalog.profile(nulls.limit(0), "e").collect()
    assert all(r["row_count"] == 0 and r["null_ratio"] is None for r in empty)


def test_overlap_and_confidence(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int"), spark.createDataFrame([(2,), (3,)], "y int")
    r = catalog.overlap(a, "x", b, "y").first()
    assert (r["left_distinct"], r["right_distinct"], r["common"], r["jaccard"], r["cardinality"]) == (2, 2, 1, 0.333333, "many_to_one")
    got = spark.createDataFrame([(0.75, 0, 0.0), (0.75, 5, 0.9), (0.9, 5, 0.5)], "c double, n int, m double").select(catalog.confidence(F.col("c"), F.col("n"), F.col("m")))
    assert [round(x[0], 2) for x in got.collect()] == [0.25, 0.8, 0.9]


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 4, 9), ("b", 1, 1)], "k string, rev int, size int")
    assert rows(windows.latest(df, ["k"], [F.desc("rev")]).select("k", "rev")) == [("a", 4), ("b", 1)]
    assert rows(windows.bad_revisions(df, "k", "rev").select("k", "rev")) == [("a", 4)]
    assert rows(windows.within_budget(df, ["k"], [F.col("rev")], F.col("size"), 11, 5).select("k", "rev")) == [("a", 1), ("a", 2), ("b", 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("fooBar_baz 岩爆强 x",), (None,)], "t string")
    assert [sorted(r[0]) for r in df.select(tokens(F.col("t"))).collect()] == [sorted(["foo", "bar", "baz", "x", "岩爆强", "岩爆", "爆强"]), []]
    one = spark.createDataFrame([("c_caseCode", "a" * 100, '{"a": 1}', "nope")], "n string, l string, j string, b string")
    r = one.select(column_key(F.col("n")), clip(F.col("l"), 10, "~"), token_estimate(F.lit("abc é")), decoded(F.col("j"), "a int")["a"], decoded(F.col("b"), "a int")["a"]).first()
    assert tuple(r) == ("casecode", "a" * 7 + "~" + "a" * 3, 7, 1, None)
    x = spark.createDataFrame([(1, None)], "b int, a string")
    assert x.select(fingerprint("b", "a")).first() == x.select(fingerprint("a", "b")).first()


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "red"), (1, "car"), (2, "sky")], "q int, token string")
    d = spark.createDataFrame([(10, "red"), (10, "car"), (11, "red"), (12, "sky")], "d int, token string")
    top = retrieval.top_k(retrieval.lexical_scores(q, d, "q", "d"), "q", "d", 1)
    assert rows(top.select("q", "d", "rank")) == [(1, 10, 1), (2, 12, 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0])], "id int, e array<double>")
    best = retrieval.top_k(retrieval.cosine_scores(v, v.filter("id = 1"), "id", "e"), "question_id", "id", 2)
    assert rows(best.select("id", "rank")) == [(2, 1), (3, 2)]
    hits = spark.createDataFrame([("v", 10.0), ("c", 1.0)], "item string, score double")
    led = retrieval.expand(hits, spark.createDataFrame([("v", "c"), ("v", "t")], "item string, target string"), 1, 0.5)
    assert rows(led) == [("c", 5.0), ("t", 5.0), ("v", 10.0)]
    seen = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1), ("a", 3.0, 2)], "id string, score double, nth int")
    assert [(r["id"], r["score"]) for r in retrieval.merged(seen).collect()] == [("a", 3.0), ("b", 2.0)]


def test_results_compared(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, None), (2, 0.0, "")], "a int, b double, c string")
    b = spark.createDataFrame([(2.0, -0.0, ""), (1.0, 0.3, None)], "x double, y double, z string")
    assert evaluation.same_rows(a, b) and evaluation.result_fingerprint(a) == evaluation.result_fingerprint(b)
    assert not evaluation.same_rows(a, b.withColumn("z", F.coalesce("z", F.lit(""))))
    assert not evaluation.same_rows(a, b.unionByName(b.limit(1)))


def outcomes(spark, right, ms=100):
    return spark.createDataFrame([(i, "x" if i % 2 else "y", i < right, True, True, float(ms)) for i in range(100)], "case_id int, bucket string, execution_accuracy boolean, executable boolean, safe boolean, duration_ms double")


def test_promotion(spark):
    base = outcomes(spark, 80)
    assert evaluation.promotion(base, outcomes(spark, 90)).first()["promote"]
    slow = evaluation.promotion(base, outcomes(spark, 90, 130)).first()
    assert not slow["latency"] and not slow["promote"]
    same = evaluation.promotion(base, base).first()
    assert not same["gain"] and not same["net_fixed"] and same["safety"]
    assert not evaluation.promotion(base, outcomes(spark, 90).filter("case_id > 0")).first()["same_cases"]
    assert rows(evaluation.compared(base, outcomes(spark, 70), "case_id", "execution_accuracy").groupBy("change").count()) == [("regressed", 10), ("same", 90)]
    r = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"])], "w array<string>, f array<string>").select(evaluation.recall(F.col("w"), F.col("f")))
    assert [x[0] for x in r.collect()] == [0.5, None]


def test_sql_gate(spark, nulls):
    nulls.createOrReplaceTempView("nulls")
    good = ["SELECT i, COUNT(*) FROM nulls WHERE i > (SELECT AVG(i) FROM nulls) GROUP BY i", "WITH x AS (SELECT id FROM nulls) SELECT * FROM x UNION ALL SELECT id FROM nulls", "SELECT id, row_number() OVER (ORDER BY id) FROM nulls;", "SELECT s FROM nulls WHERE s = 'a;b'"]
    for sql in good:
        assert execution.problems(spark, sql, {"nulls"}) == [], sql
    bad = {
        "": "empty_sql", "SELECT 1 -- x": "comments_not_allowed", "SELECT 1; SELECT 2": "exactly_one_statement_required", "SELEC 1": "parse_error", "DROP TABLE nulls": "read_only_query_required", "INSERT INTO nulls SELECT * FROM nulls": "read_only_query_required",
        "SET a=b": "read_only_query_required", "SELECT reflect('java.lang.System', 'exit') FROM nulls": "blocked_function", "SELECT * FROM other": "unknown_table", "SELECT * FROM parquet.`/tmp/x`": "unknown_table", "SELECT nope FROM nulls": "unknown_column",
        "SELECT 1 WHERE EXISTS (SELECT 1 FROM other)": "unknown_table", "SELECT '" + "x" * 70_000 + "'": "sql_too_large",
    }
    for sql, code in bad.items():
        found = execution.problems(spark, sql, {"nulls"})
        assert found and found[0].startswith(code), (sql[:60], found)
    with pytest.raises(PermissionError):
        execution.run_sql(spark, "DROP TABLE nulls", {"nulls"})
    got = execution.run_sql(spark, "SELECT id FROM nulls ORDER BY id", {"nulls"}, max_rows=2, timeout_ms=60_000)
    assert got.rows == ((1,), (2,)) and got.truncated
    assert execution.skeleton("SELECT a FROM t WHERE b = 'x' AND c > 3.5;") == "select a from t where b = ? and c > ?"


def test_timeout_stops_the_job(spark):
    with pytest.raises(TimeoutError):
        execution.run_bounded(spark.range(10**12).selectExpr("sum(id * 3 % 7)"), timeout_ms=1500)


def test_tables_and_state(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert tables.write_table(df, path, 2) == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_table(df, path)
    assert rows(tables.upsert(df, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.snapshot_id({"t": df}) == tables.snapshot_id({"t": df}) != tables.snapshot_id({"t": df.select("k")})
    tables.write_split_jsonl(df.withColumn("split", F.lit("train")), str(tmp_path / "j"), "split", "k")
    assert spark.read.json(str(tmp_path / "j" / "split=train")).count() == 2
    (tmp_path / "run1.json").write_text('{"id": "x"}')
    assert tables.newest_file(spark, str(tmp_path / "run*.json"), '"x"').endswith("run1.json") and tables.newest_file(spark, str(tmp_path / "no*.json"), "x") is None


def test_dump(spark, tmp_path):
    ddl = "CREATE TABLE `t_case` (\n  `id` bigint NOT NULL,\n  `name` varchar(20) DEFAULT NULL,\n  `size` decimal(10,2),\n  `raw` blob,\n  PRIMARY KEY (`id`)\n) ENGINE=x;\n"
    schema, key = documents.dump_schemas(ddl)["t_case"]
    assert key == ["id"] and [f.dataType.simpleString() for f in schema] == ["bigint", "string", "double", "binary"]
    (tmp_path / "d.sql").write_text(ddl + "INSERT INTO `t_case` VALUES (1, 'it''s, (a) \\'q\\' \\n', 2.5, 0x4142);\nINSERT INTO `t_case` VALUES (2, NULL, NULL, NULL);\nINSERT INTO `other` VALUES (9);\n")
    got = documents.read_dump_rows(spark, str(tmp_path / "d.sql"), "t_case", schema).orderBy("id").collect()
    assert [(r["id"], r["name"], r["size"], None if r["raw"] is None else bytes(r["raw"])) for r in got] == [(1, "it's, (a) 'q' \n", 2.5, b"AB"), (2, None, None, None)]
    with pytest.raises(ValueError):
        documents.row_values("1, 2", 3)


def test_pages_cases_and_chain(spark, tmp_path):
    (tmp_path / "p.md").write_text("---\ntitle: Rock\n---\n# One\nfirst\n<!-- planning -->use t<!-- /planning -->\n## Two\nsecond\n")
    got = documents.read_pages(spark, str(tmp_path / "p.md")).orderBy("nth").collect()
    assert [(r["title"], r["heading"], r["planning"]) for r in got] == [("Rock", "One", "use t"), ("Rock", "Two", "use t")]
    (tmp_path / "train.jsonl").write_text("".join(json.dumps({"case_id": c, "split": s, "database_snapshot_id": d}) + "\n" for c, s, d in (("a", "train", "s"), ("a", "train", "s"), ("b", "holdout", "s"), ("c", "train", "z"))))
    _, found = documents.read_cases(spark, str(tmp_path / "train.jsonl"), "case_id string, split string, database_snapshot_id string", "s")
    assert rows(found) == [("a", "duplicate_id"), ("b", "split_differs_from_file"), ("c", "foreign_snapshot")]
    log = documents.chained(["x", "y", "z"])
    schema = "seq int, payload string, previous_hash string, record_hash string"
    assert documents.chain_breaks(spark.createDataFrame(log, schema)).count() == 0
    bad = [log[0], (1, "changed", *log[1][2:]), log[2]]
    assert [r["seq"] for r in documents.chain_breaks(spark.createDataFrame(bad, schema)).collect()] == [1]


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("k int, v string").parquet(source)
    append_new(stream(), out, ["k"], str(tmp_path / "c1")).awaitTermination(60)
    append_new(stream(), out, ["k"], str(tmp_path / "c2")).awaitTermination(60)  # the same rows once more
    assert rows(spark.read.parquet(out)) == [(1, "a"), (2, "b")]
    events = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:07:00", "y")], "t string, e string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r["e"], r["n"]) for r in windowed_counts(events, "t", "e").collect()) == [("x", 2), ("y", 1)]


def test_files_against_their_manifest(spark, tmp_path):
    import hashlib

    for name, lines in (("a.jsonl", "{}\n\n{}\n"), ("b.jsonl", "{}\n"), ("c.jsonl", ""), ("new.jsonl", "{}")):
        (tmp_path / name).write_text(lines)
    sha = lambda name: hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
    files = documents.file_digests(spark, f"{tmp_path}/*.jsonl")
    assert sorted(map(tuple, files.collect())) == [(n, sha(n), k) for n, k in (("a.jsonl", 2), ("b.jsonl", 1), ("new.jsonl", 1))]  # none of the empty file
    stated = spark.createDataFrame([("a.jsonl", sha("a.jsonl"), 3), ("b.jsonl", sha("a.jsonl"), 1), ("c.jsonl", sha("c.jsonl"), 0), ("gone.jsonl", "x", 1)], "name string, sha256 string, records long")
    found = documents.manifest_problems(files, stated)
    assert dict(map(tuple, found.collect())) == {"a.jsonl": "count_mismatch", "b.jsonl": "digest_mismatch", "c.jsonl": "missing_file", "new.jsonl": "unlisted_file", "gone.jsonl": "missing_file"}
    assert not documents.manifest_problems(files, files).count()


def test_best_by_cosine_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARD", 7)
    monkeypatch.setattr(retrieval, "TILE", 3)
    monkeypatch.setattr(retrieval, "PASS_BYTES", 200)
    odd = [(200, None), (201, [1.0, None, 2.0]), (202, [0.0, 0.0, 0.0]), (203, [float("nan"), 1.0, 0.0]), (204, [1.0]), (205, []), (None, [1.0, 1.0, 1.0]), (206, [float("inf"), 1.0, 0.0]), (100, [3.0, 1.0, 0.5]), (7, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame([(i, [float(i % 5 - 2), float(i % 7), 1.0 + i % 3]) for i in range(60)] + odd, "id int, e array<double>")
    for asked in (v.filter("id % 20 = 0"), v.filter("id >= 200"), v.filter("id < 0")):
        want = retrieval.top_k(retrieval.cosine_scores(v, asked, "id", "e"), "question_id", "id", 6).select("question_id", "rank", "id", "score")
        got = retrieval.top_k(retrieval.cosine_best(v, asked, "id", "e", 6), "question_id", "id", 6).select("question_id", "rank", "id", "score")
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # what a task hands on doesn't grow with the vectors
    many = spark.range(3000).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("e"))
    assert retrieval.cosine_best(many, many.filter("id < 2"), "id", "e", 3).count() <= 2 * 3 * 2 * spark.sparkContext.defaultParallelism * 2


def test_best_by_words_are_those_of_all_pairs(spark, monkeypatch):
    texts = [(i, [f"w{i * j % 11}x" + "y" * (j % 3) for j in range(i % 6)]) for i in range(80)]
    items = spark.createDataFrame([*texts, (3, ["w1x", "w2xyy"]), (3, ["w1x"]), (None, ["w0x", "w5xy"]), (90, None), (91, [])], "d int, said array<string>")
    asked = spark.createDataFrame([(q, f"w{q * n % 7}x" + "y" * (n % 3)) for q in range(6) for n in range(q)] + [(9, "never"), (None, "w0x")], "q string, token string").distinct()
    index = retrieval.inverted(items.groupBy("d").agg(F.flatten(F.collect_list("said")).alias("said")), "d", F.col("said"))
    nulls = lambda df: sorted(map(repr, df.select("q", "rank", "d", "score").collect()))
    for tokens_, hits, held in ((200_000, 4_000_000, 500_000), (4, 20, 5)):
        monkeypatch.setattr(retrieval, "HITS", hits)
        monkeypatch.setattr(retrieval, "HELD", held)
        want = retrieval.top_k(retrieval.lexical_scores(asked, index, "q", "d"), "q", "d", 4)
        monkeypatch.setattr(retrieval, "BROADCAST_TOKENS", tokens_)
        assert nulls(retrieval.top_k(retrieval.lexical_best(asked, items, "q", "d", F.col("said"), 4), "q", "d", 4)) == nulls(want)
        pairs = spark.createDataFrame([("3", 3), ("3", 3), ("5", 11), ("4", 90), ("77", 1)], "q string, d int")
        some = retrieval.pair_scores(asked, items, pairs, "q", "d", F.col("said"))
        all_ = retrieval.lexical_scores(asked, index, "q", "d").join(pairs.distinct(), ["q", "d"])
        round_ = lambda df: sorted((r["q"], r["d"], round(r["score"], 6)) for r in df.collect())
        assert round_(some) == round_(all_) != []
    assert retrieval.lexical_best(asked.limit(0), items, "q", "d", F.col("said"), 4).count() == 0
    # what a task hands on doesn't grow with the items
    many = spark.range(4000, numPartitions=4).select(F.col("id").alias("d"), F.array(F.lit("w1x"), F.lit("w0x")).alias("said"))
    assert retrieval.lexical_best(asked, many, "q", "d", F.col("said"), 2).count() <= 4 * 7 * 2


def test_search_by_words_counts_repeated_rows_once(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "red car"), (1, "red car")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(5, "red"), (5, "red"), (5, "red"), (6, "red car"), (7, None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    for query in (queries.lexical_topk, queries.hybrid_topk):
        assert rows(query(spark, folder).select("question_id", "doc_id", "rank")) == [(1, 5, 2), (1, 6, 1)]


def test_texts_as_vectors(spark, monkeypatch):
    def by_hand(*texts):
        found = [0] * retrieval.COMPONENTS
        for text in texts:
            for word in re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
                for a, b, c in zip(f" {word[:-1]}", word, f"{word[1:]} ", strict=True):
                    h = ((ord(a) * 128 + ord(b)) * 128 + ord(c)) * 2654435761 % 2**32
                    found[h >> 25] += -1 if h >> 24 & 1 else 1
        return found

    texts = ["Red cars", "x", "naïve İK 7z, under_score Ⅷ\0", "long " * 3000 + "tail" * 50]
    odd = [(10, None), (11, ""), (12, "… é"), (None, "red"), (13, "one two"), (13, "one two"), (13, "three"), (13, None)]
    df = spark.createDataFrame([*enumerate(texts), *odd], "d long, said string")
    want = {**{i: by_hand(t) for i, t in enumerate(texts)}, 13: by_hand("one two", "three")}
    assert dict(map(tuple, retrieval.text_vectors(df, "d", "said").collect())) == want
    assert retrieval.text_vectors(df.limit(0), "d", "said").count() == 0
    monkeypatch.setattr(retrieval, "PIECE", 5)
    assert [retrieval._hashed(t.encode()).tolist() for t in texts] == [want[i] for i in range(len(texts))]


def test_best_by_text_are_those_of_all_pairs(spark, monkeypatch):
    said = [(i, " ".join(f"w{i * j % 13}y" for j in range(i % 6))) for i in range(70)] + [(70, None), (71, "w3y w5y"), (71, "w4y"), (71, "w4y"), (None, "w3y")]
    items = spark.createDataFrame(said, "d int, said string")
    asked = spark.createDataFrame([(q, f"w{q}y W{q * q}") for q in range(12)] + [(3, "w8"), (12, "..."), (13, None), (None, "w3y")], "q long, said string")
    vectors = {n: dict(map(tuple, retrieval.text_vectors(df, key, "said").collect())) for n, df, key in (("q", asked, "q"), ("d", items, "d"))}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    score = lambda a, b: round(dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5), 6)
    order = {q: sorted((-score(a, b), d) for d, b in vectors["d"].items())[:6] for q, a in vectors["q"].items()}
    want = sorted((q, n, d, -s) for q, best in order.items() for n, (s, d) in enumerate(best, 1))
    for shard, tile, size in ((2048, 256, 1 << 24), (7, 3, 4000)):
        monkeypatch.setattr(retrieval, "SHARD", shard)
        monkeypatch.setattr(retrieval, "TILE", tile)
        monkeypatch.setattr(retrieval, "PASS_BYTES", size)
        near = retrieval.top_k(retrieval.text_best(asked, items, "q", "d", "said", 6), "q", "d", 6).select("q", "rank", "d", "score")
        assert near.dtypes[0] == ("q", "bigint") and near.dtypes[2] == ("d", "int")
        assert sorted(map(tuple, near.collect())) == want
    assert retrieval.text_best(asked.limit(0), items, "q", "d", "said", 6).count() == retrieval.text_best(asked, items.limit(0), "q", "d", "said", 6).count() == 0
    # what a task hands on doesn't grow with the items
    many = spark.range(9000, numPartitions=4).select(F.col("id").alias("d"), F.concat(F.lit("w3y "), F.col("id")).alias("said"))
    assert retrieval.text_best(asked, many, "q", "d", "said", 2).count() <= 4 * 12 * 2


def test_search_by_both_finds_what_only_vectors_find(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "gardening books"), (1, "gardening books"), (2, "Über 7"), (3, "—"), (4, None), (None, "red")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    odd = [(90, "gardener's bookshelf"), (91, "books"), (91, "books"), (91, "and gardens"), (92, None), (93, "…"), (None, "books of gardening"), (1, "gardening")]
    said = [(i, " ".join(f"w{i * j % 13}" for j in range(1, 2 + i % 9))) for i in range(100, 160)]
    spark.createDataFrame([*odd, *said], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = rows(queries.hybrid_topk(spark, folder).select("question_id", "doc_id", "rank"))
    assert (1, 90) in {r[:2] for r in found}  # no word of the question stands in it
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.sql(f"SELECT question_id, doc_id, rank FROM ({queries.ORACLE_SQL['hybrid_topk']})").fetchall()
    assert sorted(map(repr, found)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["lexical_topk", "hybrid_topk", "role_view"])
def test_null_keys_come_last_among_ties(spark, tmp_path, name):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "red car")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    # the first twenty are close by their letters only; the others have both words, and are too long to be close
    said = [(i, "reds cars") for i in range(20)] + [(i, "red car " + "among many other things that nobody wanted " * 5) for i in (None, *range(20, 50))]
    spark.createDataFrame(said, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    found = rows(queries.QUERIES[name](spark, folder).select("question_id", "doc_id", "rank"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.sql(f"SELECT question_id, doc_id, rank FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert [d for _, d, _ in sorted(found, key=lambda r: r[2])][:5] == [20, 21, 22, 23, 24]
