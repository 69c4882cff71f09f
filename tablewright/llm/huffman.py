"""Token ids as files of canonical, length-limited Huffman codes.

Ids are counted over the whole corpus, and the counts give one code book of at most LIMIT bits a
code.  Documents go in ascending id order into independent blocks; every LANE ids a block notes its
bit offset, and those checkpoints let a reader decode all lanes of a block side by side by table.

A file set is a folder: `codes` (id, bits: lengths alone, as the codes are canonical) and `blocks`
(part, block: ascending; docs, sizes: the documents and their numbers of ids; lanes: bit offsets;
payload), both Parquet, so that any file system serves and a lost task leaves nothing behind.

A null text counts as empty and is the end id alone.  Null document ids come first.  Repeated ids
follow each other in the order of their texts' hashes.  An empty table gives empty files.  A very
long document is a block of its own.  Other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import words_of
from .common import bounded, scratch, steps, text_of

LIMIT = 20
LANE = 256
#: Ids of one block, unless one document has more.
BLOCK = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 for those that don't occur: package-merge, at most `limit` bits."""
    present = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(present) <= 1:
        lengths[present] = 1
        return lengths
    if len(present) > 1 << limit:
        raise ValueError("more symbols than codes")
    order = present[np.argsort(counts[present], kind="stable")]
    leaves = counts[order].astype(np.float64) if counts.sum() >= 2**52 else counts[order].astype(np.int64)
    n = len(leaves)
    # each level: sorted weights, and which of them are leaves
    levels, weights = [np.ones(n, bool)], leaves
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaves, pairs])
        at = np.argsort(merged, kind="stable")
        weights = merged[at]
        levels.append(at < n)
    # the first 2n - 2 items of the last level are taken; its packages take twice their number from the level below
    take, used = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        used[k] += 1
        take = 2 * (take - k)
    lengths[order] = np.cumsum(used[::-1])[::-1][1:]  # a leaf at place i is taken once in each level that took more than i
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then symbol."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        bits = lengths[order]
        # each code is the sum of the shares that the earlier ones take of the code space
        share = np.int64(1) << (LIMIT - bits)
        codes[order] = (np.cumsum(share) - share) >> (LIMIT - bits)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' codes one after another, and the bit at which each LANE of ids begins."""
    bits = lengths[ids]
    end = np.cumsum(bits)
    start = end - bits
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    code = codes[ids].astype(np.uint64)
    word, over = start >> 6, (start & 63) + bits - 64  # over: bits that go into the next word
    head = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(head, first)
    split = np.flatnonzero(over > 0)  # at most one code runs into each word
    out[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], start[::LANE].copy()


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For every LIMIT bits the id whose code they begin with, times 32, plus its length."""
    table = np.zeros(1 << LIMIT, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    filled = np.repeat(order * 32 + lengths[order], np.int64(1) << (LIMIT - lengths[order]))
    table[: len(filled)] = filled
    return table


def unpack(payload: bytes, lanes: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The n ids of a block: all lanes go ahead by one id at a time."""
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # the 32 bits from each byte on
    out = np.zeros((LANE, len(lanes)), np.uint32)
    at, last = lanes.astype(np.int64), len(window) - 1
    shift, mask = np.uint32(32 - LIMIT), np.int64(7)
    for i in range(min(LANE, n)):
        bits = (window[np.minimum(at >> 3, last)] << (at & mask).astype(np.uint32)) >> shift
        entry = table[bits]
        out[i] = entry >> 5
        at += entry & 31
    return out.T.ravel()[:n]


def encoded(docs: DataFrame, vocabulary: str, ranks: str | None, end_id: int, id_column: str) -> DataFrame:
    """(part, seq, id, n, ids): the documents' ids in ascending order of (part, seq)."""
    rows = docs.select(F.col(id_column).alias("id"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        seq, words = 0, words_of(vocabulary, ranks)
        narrow = words.merges.size <= 1 << 16
        for part in (p for b in batches for p in steps(b, "text")):
            ids, ends = words.encode(part.column("text"))
            n = len(part)
            whole = np.insert(ids, ends[1:], end_id).astype(np.uint16 if narrow else np.uint32)
            ends = ends + np.arange(n + 1)
            raw, width = whole.tobytes(), whole.itemsize
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((ends * width).astype(np.int64).tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(seq, seq + n)), part.column("id"), pa.array(np.diff(ends)), data.cast(pa.binary())], ["seq", "id", "n", "ids"])
            seq += n

    ordered = rows.repartitionByRange("id", "th").sortWithinPartitions("id", "th")
    return bounded(ordered).mapInArrow(run, f"seq long, id {kind}, n long, ids binary").withColumn("part", F.spark_partition_id())


def flat_ids(column: pa.Array, wide: bool) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint32 if wide else np.uint16)


def write_ids(docs: DataFrame, path: str, vocabulary: str, ranks: str | None = None, end_id: int = 0, id_column: str = "doc_id") -> None:
    """Encode the texts, count all ids, and write the file set."""
    spark = docs.sparkSession
    tokens_at = scratch(spark, "ids")
    encoded(docs, vocabulary, ranks, end_id, id_column).write.parquet(tokens_at)
    tokens = spark.read.parquet(tokens_at)
    size = words_of(vocabulary, ranks).merges.size
    wide = size > 1 << 16

    def count(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            counts += np.bincount(flat_ids(b.column("ids"), wide), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["token", "n"])

    # at most one row for each id of the vocabulary
    totals = tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[np.asarray(totals.column("token"), np.int64)] = np.asarray(totals.column("n"), np.int64)
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    present = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"token": pa.array(present), "bits": pa.array(lengths[present])}), "token long, bits long").coalesce(1).write.parquet(f"{path}/codes")
    kind = tokens.schema["id"].dataType.simpleString()

    def blocks(batches):
        for b in batches:
            parts, seqs, n = np.asarray(b.column("part")), np.asarray(b.column("seq")), np.asarray(b.column("n"), np.int64)
            start, ends = 0, np.cumsum(n)
            while start < len(n):
                # as many documents of one part as fill a block, in unbroken order
                stop = start + 1
                base = ends[start] - n[start]
                while stop < len(n) and parts[stop] == parts[start] and seqs[stop] == seqs[stop - 1] + 1 and ends[stop] - base <= BLOCK:
                    stop += 1
                payload, lanes = pack(flat_ids(b.column("ids").slice(start, stop - start), wide).astype(np.int64), lengths, codes)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([int(parts[start])], pa.int32()), "block": pa.array([int(seqs[start])], pa.int64()), "docs": pa.array([b.column("id").slice(start, stop - start).to_pylist()], pa.list_(b.schema.field("id").type)),
                    "sizes": pa.array([n[start:stop]], pa.list_(pa.int64())), "n": pa.array([int(n[start:stop].sum())], pa.int64()), "lanes": pa.array([lanes], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()),
                })
                start = stop

    schema = f"part int, block long, docs array<{kind}>, sizes array<long>, n long, lanes array<long>, payload binary"
    # blocks take a fraction of the ids' room, so a file holds several parts
    packed = tokens.select("part", "seq", "id", "n", "ids")
    packed.coalesce(max(1, packed.rdd.getNumPartitions() // 4)).mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, id_column: str = "doc_id", ids: bool = False) -> DataFrame:
    """For each document of a file set: start (ids before it in the set), n_tokens, crc32 of its ids; with ids also the ids."""
    book = spark.read.parquet(f"{path}/codes").toArrow()  # at most one row for each id of the vocabulary
    token = np.asarray(book.column("token"), np.int64)
    lengths = np.zeros(int(token.max(initial=0)) + 1, np.int64)
    lengths[token] = np.asarray(book.column("bits"), np.int64)
    files = spark.read.parquet(f"{path}/blocks")
    kind = files.schema["docs"].dataType.elementType.simpleString()

    def run(batches):
        table = decode_table(lengths, canonical(lengths))
        for b in batches:
            for i in range(len(b)):
                sizes = np.asarray(b.column("sizes")[i].values, np.int64)
                got = unpack(b.column("payload")[i].as_py(), np.asarray(b.column("lanes")[i].values), int(sizes.sum()), table)
                raw, ends = memoryview(got.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(sizes)])
                n = len(sizes)
                columns = {
                    "part": pa.array(np.full(n, b.column("part")[i].as_py(), np.int32)),
                    "block": pa.array(np.full(n, b.column("block")[i].as_py(), np.int64)),
                    "before": pa.array(ends[:-1]),
                    "id": b.column("docs")[i].values,
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"part int, block long, before long, id {kind}, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    rows = bounded(files).select("part", "block", "docs", "sizes", "lanes", "payload").mapInArrow(run, schema)
    # sums over parts (one row for each written file), then over the blocks of a part
    index = files.select("part", "block", "n")
    parts = index.groupBy("part").agg(F.sum("n").alias("total"))
    part_start = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    block_start = index.select("part", "block", (F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).alias("block_start"))
    starts = block_start.join(part_start, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    found = rows.join(starts, ["part", "block"]).withColumn("start", F.col("base") + F.col("before"))
    return found.select(F.col("id").alias(id_column), "start", "n_tokens", "ids_crc32", *["ids"] * ids)
