"""Byte-pair encoding and decoding of texts, by a walk over the trie of distinct words (see bpe.py).

A null text counts as empty: no ids, empty decoded text.  Rows are independent, so repeated rows
give repeated results and an empty table an empty one; other columns pass through or are dropped as
the function says.  Very long texts take memory in proportion to themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import decode_table, words_of
from .common import kept, map_arrow, text_of

_tables: dict[str, tuple[np.ndarray, np.ndarray]] = kept()


def decode(ids: np.ndarray, ends: np.ndarray, vocabulary: str) -> list[str]:
    """The texts of consecutive runs of ids; bytes that are no UTF-8 become U+FFFD."""
    if vocabulary not in _tables:
        _tables[vocabulary] = decode_table(vocabulary)
    data, start = _tables[vocabulary]
    length = (start[1:] - start[:-1])[ids]
    after = np.cumsum(length)
    total = int(after[-1]) if len(after) else 0
    out = data[np.repeat(start[ids] - (after - length), length) + np.arange(total)].tobytes()
    cuts = np.concatenate([[0], after])[ends]
    return [out[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", full: bool = False) -> DataFrame:
    """For each row: n_tokens, digests of its ids and of the text decoded from them; with full also ids and decoded."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(vocabulary)
        ids, ends = words.encode(part.column("text"))
        texts = decode(ids, ends, vocabulary)
        raw = ids.astype("<u4").tobytes()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        columns = {
            "id": part.column("id"),
            "n_tokens": pa.array(np.diff(ends)),
            "ids_sha256": pa.array([sha(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
            "decoded_sha256": pa.array([sha(t.encode()) for t in texts], pa.string()),
        }
        if full:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            columns["decoded"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return map_arrow(docs.select(F.col(id_column).alias("id"), text_of().alias("text")), run, schema).withColumnRenamed("id", id_column)
