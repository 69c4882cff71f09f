"""Each operator's query over whole small tables against a brute-force version, or the SQL in DuckDB."""

import hashlib
import os
import re
import struct
import zlib

import duckdb
import pytest

from tablewright.llm import queries
from tablewright.llm.queries import vocabulary

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows_of(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{FOLDER}/{name}.parquet') ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def texts():
    return {d: t or "" for d, t in rows_of("documents", "doc_id, text")}


def got(spark, name, *columns):
    rows = queries.QUERIES[name](spark, FOLDER).select(*columns).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_suffix_dedup(spark, texts):
    length, places = 400, {}
    raw = {d: t.encode() for d, t in texts.items()}
    for d, b in raw.items():
        for i in range(len(b) - length + 1):
            places.setdefault(hashlib.blake2b(b[i : i + length], digest_size=16).digest(), []).append((d, i))
    gone = {d: bytearray(len(b)) for d, b in raw.items()}
    for hits in places.values():
        if len(hits) > 1:
            for d, i in hits:
                gone[d][i : i + length] = b"\1" * length
    want = {d: (len(b), sum(gone[d]), len(re.findall(b"\x01+", bytes(gone[d]))), sha(bytes(x for x, g in zip(b, gone[d], strict=True) if not g))) for d, b in raw.items()}
    assert sum(w[1] for w in want.values())
    assert got(spark, "op1_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_token_counts(spark, texts):
    encoded = tokenizer("word_bpe_49k.json").encode_batch(list(texts.values()), add_special_tokens=False)
    want = {d: (len(t.encode()), len(e.ids), len(e.ids) > 2048) for (d, t), e in zip(texts.items(), encoded, strict=True)}
    assert got(spark, "op2_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_licenses(spark, texts):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    want = {}
    for d, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        found = [(i, label) for p, label in phrases.items() for k in [p.split()] for i in range(len(words)) if words[i : i + len(k)] == k]
        want[d] = (len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found})))
    rows = got(spark, "op7_licenses", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {d: r[:5] for d, r in rows.items()} == want
    for r in rows.values():
        labels = r[5].split(",") if r[5] else []
        assert labels == sorted(set(labels)) and set(labels) >= set(filter(None, r[4].split(","))) and 0 <= r[6] <= 1


def test_bpe_codec(spark, texts):
    t = tokenizer("byte_bpe_50k.json")
    encoded = [e.ids for e in t.encode_batch(list(texts.values()), add_special_tokens=False)]
    want = {d: (len(i), sha(struct.pack(f"<{len(i)}I", *i)), sha(t.decode(i, skip_special_tokens=False).encode())) for d, i in zip(texts, encoded, strict=True)}
    assert got(spark, "op8_bpe_codec", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_token_files(spark, texts):
    start, want = 0, {}
    for d, e in zip(texts, tokenizer("byte_bpe_50k.json").encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        want[d] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert got(spark, "op9_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_toxicity(spark, texts):
    rows = got(spark, "op4_toxicity", "doc_id", "held_out", "score", "predicted")
    assert rows.keys() == texts.keys()
    assert all(held == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.5) for d, (held, s, p) in rows.items())
