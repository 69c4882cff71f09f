"""Removal of long repeated byte strings, over a logarithmic family of sparse suffix arrays.

Suffixes are sampled by content: of every MATCH bytes (or `length`, if that is less), the GRAM-byte
string in them with the smallest hash (the leftmost, if several) is their anchor.  Equal strings have
their anchor at the same place, so every repeated string of MATCH bytes shows as two anchors with an
equal gram, and a text of n bytes has about 2 n / (MATCH - GRAM) of them.  A run of `length` bytes
belongs to the anchor of its first MATCH bytes.

The index holds suffix arrays: sorted tables of the sampled suffixes' beginnings, as the first eight
bytes (which give the order) and a digest of the whole gram, with the first place of each and how many
there are.  Texts come in batches.  A batch's array is built, merge-joined with every level of the
family for grams that stand in both, and then put on the lowest level; two levels of one size merge
into one of the next, so that n batches leave log n levels and each suffix is merged log n times.  The
levels are folders of one path, and a family that is opened there later goes on from them.

Grams found twice only say where to look.  There, exactly which runs repeat is settled with 128-bit
digests, coarse to fine: all runs of an anchor at once, then blocks of STEP neighbouring runs (a block
whose common core stands nowhere else is done with; one that stands elsewhere as a whole is settled),
then single runs.  One copy of each distinct string goes to the next finer step, so that a thousand
copies cost as much as one, and every step is a count by digest with partial sums.

Bytes are UTF-8; a null text is empty.  Matches never cross texts; a run may repeat within its text,
overlaps included.  Rows that repeat are texts of their own, thus copies of each other; texts shorter
than LENGTH lose nothing; an empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, folders, map_arrow, move, scratch, stored, text_of

STEP = 16
#: Every repeated string of so many bytes has a sampled suffix of its own.
MATCH = 256
#: Batches of one run; more make smaller jobs and more merging.
BATCHES = 4
#: Bytes of per-text lists that may be sent to every executor.
BROADCAST_BYTES = 24 << 20
#: Bytes that are hashed at once; anchors are numbered within them.
WINDOW = 1 << 23
PLACES = np.uint64((1 << 24) - 1)


def gram_of(length: int) -> int:
    """Bytes of a sampled suffix's beginning: half of MATCH, or a third to a sixth of a shorter length."""
    return MATCH // 2 if length >= MATCH else 1 << max(0, (length // 3).bit_length() - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram that starts at each byte; the length is doubled until it is a gram's."""
    h = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
    k, factor = 1, 0x9E3779B97F4A7C15 | 1
    while k < gram:
        h = h[:-k] * np.uint64(factor) + h[k:]
        factor = factor * factor % (1 << 64)
        k *= 2
    return mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of the strings of MATCH bytes that have it, and the gram's hash; places are those in data.

    offsets: where each text begins in data (one more than texts).  At most WINDOW starts are looked at together.
    """
    found, match = [], min(length, MATCH)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for at in range(0, max(1, len(data) - match + 1), WINDOW):
        part = data[at : at + WINDOW + match - 1]
        if len(part) < match:
            break
        gram = gram_of(length)
        h = gram_hashes(part, gram)
        n, width = len(part) - match + 1, match - gram + 1
        key = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        key[: len(h)] = (h & ~PLACES) | np.arange(len(h), dtype=np.uint64)
        rows = key.reshape(-1, width)
        left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        right = np.minimum.accumulate(rows, axis=1).ravel()
        place = (np.minimum(left[:n], right[width - 1 : width - 1 + n]) & PLACES).astype(np.int64)
        start = np.flatnonzero(np.arange(at, at + n) + match <= ends[at : at + n])
        place = place[start]
        if not len(start):
            continue
        first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        last = np.append(first[1:], len(start)) - 1
        found.append((place[first] + at, start[first] + at, start[last] + at, h[place[first]].astype(np.int64)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class SuffixFamily:
    """Levels of sampled suffixes (head, gram, n, at); level i holds 2**i batches.  at: the place of one of the n (see place_of).

    Each level is a sorted table, a folder level-<i> of the family's path; an existing path is gone on with.  Only one
    family may write a path at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or scratch(spark, "family")).rstrip("/")
        self.levels = {int(name.removeprefix("level-").split("-")[0]): self._read(f"{self.path}/{name}") for name in folders(spark, self.path) if name.startswith("level-")}

    def _read(self, path: str) -> tuple[DataFrame, str]:
        return self.spark.read.parquet(path), path

    def _array(self, rows: DataFrame, path: str) -> tuple[DataFrame, str]:
        counted = rows.groupBy("head", "gram").agg(F.sum("n").alias("n"), F.min("at").alias("at")).sortWithinPartitions("head", "gram")
        return stored(counted, "suffixes", path), path

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of (head, gram, n, at); give the (head, gram) that stand twice in it, or in it and in a level."""
        fresh, path = self._array(batch, scratch(self.spark, "suffixes"))
        twice = fresh.filter("n > 1").select("head", "gram")
        for level, _ in self.levels.values():
            twice = twice.unionByName(fresh.join(level.select("head", "gram"), ["head", "gram"]).select("head", "gram"))
        twice = stored(twice, "matches")
        rank = 0
        while rank in self.levels:
            level, old = self.levels.pop(rank)
            merged, merged_path = self._array(level.unionByName(fresh), scratch(self.spark, "suffixes"))
            discard(self.spark, old)
            discard(self.spark, path)
            fresh, path, rank = merged, merged_path, rank + 1
        move(self.spark, path, f"{self.path}/level-{rank}")
        self.levels[rank] = self._read(f"{self.path}/level-{rank}")
        return twice

    def drop(self) -> None:
        for _, path in self.levels.values():
            discard(self.spark, path)


def place_of() -> Column:
    """A sampled suffix's place as one number: 40 bits of its text's hash, and 24 of the byte it begins at."""
    return F.xxhash64("id", "th").bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(F.col("place").cast("long").bitwiseAND(F.lit((1 << 24) - 1)))


def sampled(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, head, gram, key, k, place, first, last, upto): each text's sampled suffixes and the string that their runs cover.

    key: digest of all bytes of the anchor's runs, null if it has none because the text ends too soon.  Anchors with
    equal keys whose runs follow each other, as in periodic texts, are one row, with k of them: place, first and last
    are the first one's, and the starts go on to upto.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = bytes_of(part.column("text"))
        place, first, last, gram = anchors(data, offsets, length)
        raw = memoryview(data)
        owner = np.searchsorted(offsets, place, "right") - 1
        last = np.minimum(last, offsets[owner + 1] - length)
        none = first > last  # the text ends before a run would
        key = [b"" if no else xxhash.xxh3_128_digest(raw[a:z]) for a, z, no in zip(first.tolist(), (last + length).tolist(), none.tolist(), strict=True)]
        high = np.frombuffer(b"".join(k or bytes(16) for k in key), np.dtype([("a", np.int64), ("b", np.int64)]))
        new = np.ones(len(place), bool)
        new[1:] = (high["a"][1:] != high["a"][:-1]) | (high["b"][1:] != high["b"][:-1]) | (owner[1:] != owner[:-1]) | (first[1:] != last[:-1] + 1) | none[1:] | none[:-1]
        at = np.flatnonzero(new)
        count, upto = np.diff(at, append=len(place)), last[np.append(at[1:], len(place)) - 1] if len(at) else last
        padded, begin = np.concatenate([data, np.zeros(8, np.uint8)]), offsets[owner[at]]
        head = padded[place[at][:, None] + np.arange(8)].copy().view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
        take = pa.array(owner[at])
        return pa.RecordBatch.from_arrays([
            part.column("id").take(take), part.column("th").take(take), pa.array(head.astype(np.int64)), pa.array(gram[at]), pa.array([key[i] or None for i in at.tolist()], pa.binary()), pa.array(count.astype(np.int32)),
            *[pa.array((x - begin).astype(np.int32)) for x in (place[at], first[at], last[at], upto)],
        ], ["id", "th", "head", "gram", "key", "k", "place", "first", "last", "upto"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, th long, head long, gram long, key binary, k int, place int, first int, last int, upto int")


def with_lists(rows: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """rows beside what `lists` has for their (id, th); the lists are sent around only if they are small."""
    lists = stored(lists.withColumnsRenamed({"id": "lid", "th": "lth"}), "lists")
    size = lists.agg(F.sum(F.coalesce(F.size("list"), F.lit(0)) * 24 + 64)).first()[0] or 0
    return rows.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, F.col("id").eqNullSafe(F.col("lid")) & (F.col("th") == F.col("lth")), how).drop("lid", "lth")


def blocks(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, done, first, last, core, whole): each listed anchor's starts in blocks of STEP places before the anchor."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = {n: [] for n in ("at", "done", "first", "last", "core", "whole")}
        for i, (text, items) in enumerate(zip(part.column("text").to_pylist(), part.column("list").to_pylist(), strict=True)):
            raw = memoryview(text.encode())
            for x in items:
                place = x["place"]
                for j in range((place - x["last"]) // STEP, (place - x["first"]) // STEP + 1):
                    first, last = max(x["first"], place - STEP * j - STEP + 1), min(x["last"], place - STEP * j)
                    core = xxhash.xxh3_128(raw[place - STEP * j : place - STEP * j - STEP + 1 + length])
                    core.update(str(j))
                    for n, v in zip(out, (i, x["done"], first, last, core.digest(), xxhash.xxh3_128_digest(raw[first : last + length])), strict=True):
                        out[n].append(v)
        at = pa.array(out["at"], pa.int64())
        return pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("th").take(at), pa.array(out["done"], pa.bool_()), pa.array(out["first"], pa.int32()), pa.array(out["last"], pa.int32()), pa.array(out["core"], pa.binary()), pa.array(out["whole"], pa.binary())], ["id", "th", "done", "first", "last", "core", "whole"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows.select("id", "th", "text", "list"), run, f"id {kind}, th long, done boolean, first int, last int, core binary, whole binary")


def singles(rows: DataFrame, length: int) -> DataFrame:
    """(id, th, done, first, key): each single run of the listed starts."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        at, done, first, key = [], [], [], []
        for i, (text, items) in enumerate(zip(part.column("text").to_pylist(), part.column("list").to_pylist(), strict=True)):
            raw = memoryview(text.encode())
            for x in items:
                for s in range(x["first"], x["last"] + 1):
                    at.append(i)
                    done.append(x["done"])
                    first.append(s)
                    key.append(xxhash.xxh3_128_digest(raw[s : s + length]))
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("th").take(take), pa.array(done, pa.bool_()), pa.array(first, pa.int32()), pa.array(key, pa.binary())], ["id", "th", "done", "first", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows.select("id", "th", "text", "list"), run, f"id {kind}, th long, done boolean, first int, key binary")


def merged(starts: DataFrame, length: int) -> DataFrame:
    """(id, th, list of (first, last)): each text's spans of bytes, from starts; spans that meet are one."""

    def run(batches):
        for b in batches:
            lists = []
            for items in b.column("list").to_pylist():
                cuts: list[tuple[int, int]] = []
                for x in sorted((x["first"], x["last"]) for x in items):
                    if cuts and x[0] <= cuts[-1][1] + length:
                        cuts[-1] = (cuts[-1][0], max(x[1], cuts[-1][1]))
                    else:
                        cuts.append(x)
                lists.append([{"first": a, "last": z + length} for a, z in cuts])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(lists, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["id", "th", "list"])

    kind = starts.schema["id"].dataType.simpleString()
    # A text's runs are fewer than its bytes.
    listed = starts.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("list"))
    return listed.mapInArrow(run, f"id {kind}, th long, list array<struct<first:int,last:int>>")


def repeated_spans(docs: DataFrame, length: int, id_column: str) -> DataFrame:
    """(id, th, list of (first, last), matches): the bytes that runs of `length` bytes cover which start elsewhere too, last exclusive.

    matches: the text's sampled suffixes that stand elsewhere too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    long_enough = rows.filter(F.octet_length("text") >= length)
    samples_at, starts_at = scratch(spark, "samples"), scratch(spark, "starts")
    batched = sampled(rows.filter(F.octet_length("text") >= min(length, MATCH)), length).withColumn("batch", F.pmod(F.xxhash64("id", "th"), F.lit(BATCHES)))
    batched.write.partitionBy("batch").parquet(samples_at)
    samples = spark.read.schema(batched.schema).parquet(samples_at)
    family, found = SuffixFamily(spark), None
    for i in range(BATCHES):
        twice = family.add(samples.filter(F.col("batch") == i).select("head", "gram", F.col("k").alias("n"), place_of().alias("at")))
        found = twice if found is None else found.unionByName(twice)
    family.drop()
    twice_at = scratch(spark, "strings")
    both = stored(samples.drop("batch").join(found.distinct(), ["head", "gram"]), "strings", twice_at)
    matches = stored(both.groupBy("id", "th").agg(F.sum("k").alias("matches")), "matches")
    strings = both.filter("key IS NOT NULL")
    discard(spark, samples_at)

    def add(starts: DataFrame) -> None:
        starts.select("id", "th", "first", "last").write.mode("append").parquet(starts_at)

    one = F.struct("id", "th", "place", "first", "last")
    copies = stored(strings.groupBy("head", "gram", "key").agg(F.sum("k").alias("copies"), F.min(one).alias("x")), "copies")
    add(strings.join(copies.filter("copies > 1").select("key"), "key").drop("last").withColumnRenamed("upto", "last"))
    discard(spark, twice_at)

    # Only a gram of two different strings can hold a run that one of them shares with the other.
    several = copies.groupBy("head", "gram").agg(F.count("*").alias("n")).filter("n > 1").select("head", "gram")
    by_text = copies.join(several, ["head", "gram"]).select("x.id", "x.th", F.struct("x.place", "x.first", "x.last", (F.col("copies") > 1).alias("done")).alias("y")).groupBy("id", "th").agg(F.collect_list("y").alias("list"))
    parts_at = scratch(spark, "blocks")
    parts = stored(blocks(with_lists(long_enough, by_text), length), "blocks", parts_at)
    wholes_at = scratch(spark, "wholes")
    wholes = stored(parts.groupBy("whole").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "first", "last", "core", "done")).alias("x")), "wholes", wholes_at)
    add(parts.filter("not done").join(wholes.filter("copies > 1").select("whole"), "whole"))
    discard(spark, parts_at)

    # of blocks whose core stands in two distinct strings, one of each goes on
    cores = wholes.groupBy("x.core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    mixed = wholes.select("x.*", (F.col("x.done") | (F.col("copies") > 1)).alias("settled")).join(cores, "core")
    by_text = mixed.select("id", "th", F.struct("first", "last", F.col("settled").alias("done")).alias("y")).groupBy("id", "th").agg(F.collect_list("y").alias("list"))
    runs_at = scratch(spark, "runs")
    runs = stored(singles(with_lists(long_enough, by_text), length), "runs", runs_at)
    discard(spark, wholes_at)
    again = runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    add(runs.filter("not done").join(again, "key").withColumn("last", F.col("first")))
    discard(spark, runs_at)
    kind = rows.schema["id"].dataType.simpleString()
    spans = merged(spark.read.schema(f"id {kind}, th long, first int, last int").parquet(starts_at), length)
    # every run has an anchor, so each text with spans has matches
    spans = spans.withColumnsRenamed({"id": "sid", "th": "sth"})
    return matches.join(spans, F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")), "left").select("id", "th", "list", "matches")


def remove_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", full: bool = False) -> DataFrame:
    """For each row: n_bytes, n_removed, n_spans, the digest of the bytes kept, and n_matches; with full also the bytes and the removed spans.

    Every byte that some repeated run covers goes.  n_matches: the text's sampled suffixes whose beginning (128 bytes for
    a length of 400) stands elsewhere too, at least one for each repeated string of MATCH bytes, removed or not.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(docs, length, id_column)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, n_removed, n_spans, digests, kept_all, cut_all = [], [], [], [], [], []
        matches = pa.compute.fill_null(part.column("matches"), 0)
        for text, items in zip(part.column("text").to_pylist(), part.column("list").to_pylist(), strict=True):
            raw, cuts = text.encode(), [[x["first"], x["last"]] for x in items or ()]
            at, kept = 0, []
            for first, last in cuts:
                kept.append(raw[at:first])
                at = last
            kept = b"".join([*kept, raw[at:]])
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept))
            n_spans.append(len(cuts))
            digests.append(hashlib.sha256(kept).hexdigest())
            if full:
                kept_all.append(kept)
                cut_all.append(cuts)
        columns = [part.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), matches]
        if full:
            columns += [pa.array(kept_all, pa.binary()), pa.array(cut_all, pa.list_(pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_matches", *["kept", "removed"] * full])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_matches long" + ", kept binary, removed array<array<long>>" * full
    return map_arrow(with_lists(rows, spans, "left").select("id", "text", "list", "matches"), run, schema).withColumnRenamed("id", id_column)
