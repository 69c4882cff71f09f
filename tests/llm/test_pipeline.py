"""Each stage of the pipeline over its own input, against plain versions."""

import os
import struct

import duckdb
import pyarrow as pa
import pytest
from brute import decontaminated, groups, key, masked, sha, tokenizer

import corpus_pipeline
from tablewright.llm import toxicity

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output) of each stage, written and read again in between."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_all_but_the_last_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "decontamination", "secrets", "encoding"]
    for n in names[:-1]:
        before, after = stages[n]
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in before.schema]


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = texts(before)
    scores = model.scores(pa.array([t or "" for _, t in rows]))
    assert texts(after) == [r for r, s in zip(rows, scores, strict=True) if s < 0.5] and len(texts(after)) < len(rows)


def test_near_duplicates(stages):
    before, after = stages["near duplicates"]
    rows = texts(before)
    found, root = groups(rows, 5, 80)
    assert texts(after) == [r for r, (d, n, least) in zip(rows, found, strict=True) if n == 0 or d == least]
    assert len(texts(after)) < len(rows)


def test_decontamination(stages):
    before, after = stages["decontamination"]
    rows, items = texts(before), duckdb.sql(f"SELECT item_id, text FROM read_parquet('{FOLDER}/benchmark.parquet')").fetchall()
    assert texts(after) == [r for r, x in zip(rows, decontaminated(rows, items), strict=True) if not x[5]]


def test_secrets(stages):
    before, after = stages["secrets"]
    assert texts(after) == [(d, masked(t)) for d, t in texts(before)]
    assert after.filter("n_chars != length(text)").count() == 0


def test_encoding(spark, stages):
    before, after = stages["encoding"]
    t, want = tokenizer("byte_bpe_50k.json"), []
    for d, x in texts(before):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((x or "").encode())))
    assert key(after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == key(want)
    assert key(corpus_pipeline.run(spark, FOLDER).collect()) == key(after.collect())
