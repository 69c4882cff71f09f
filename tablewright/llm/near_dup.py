"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct runs of `words` consecutive words.  Two sets with a
Jaccard similarity of at least the threshold differ in at most D members, where D follows from their
sizes.  Sets are joined within size bands, so that D is one number for a band: the sketch is a row of
P = D + 1 + spare blocks of BITS bits, and each member flips one bit of one block.  The Hamming
distance of two sketches is at most the size of the sets' symmetric difference, so at most D blocks
differ and at least one is equal in both.  Documents meet on equal blocks (as 64-bit codes of the
bits set).  Most blocks have one document and are done; those that meet on a block compare a second,
small parity sketch, and only what its Hamming distance leaves is a candidate.  Candidates are
clustered, and each cluster's pairs are verified on the sets themselves.

An empty block, or one with a single member, says little.  Each set leaves out its `spare` lightest
blocks, in the order of (members, number): of the blocks in which a pair agrees, spare + 1 at least,
the last in that order then is kept by both.  So D + 1 blocks remain, however many are spare.

Equal sets are one class from the start, and only one of them per task enters the join.  Groups of
more than GROUP documents and clusters of more than CHUNK members' hashes are worked on in pairs of
chunks, so that no task holds a whole one; each gives a forest of links, never all pairs.

Shingles and classes are 64-bit hashes.  A null or empty text, or one without words, has an empty set
and is linked with nothing.  Rows with equal ids but different texts are classes of their own.  A row
with a null id is linked like others; its component has the smallest id that is not null, or null.
Repeated rows give repeated results, an empty table an empty one.  Other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, discard, let_go, map_arrow, mapped, scratch, split_words, steps, stored, text_of, without, wrapped
from .components import components

#: Blocks beyond D + 1, and one more for so many members of D: some more than a set has empty ones.
SPARE = 2
SPARE_OF = 8
BITS = 1024
#: Hashes that one verification holds, and documents of one block that one task compares.
CHUNK = 2_000_000
GROUP = 50_000
#: Bits of the smallest parity sketch; larger sets have larger ones, in powers of two, that fold to it.
LEAST_BITS = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A code for each bit of a block; a block's code is the sum modulo 2 of those of its set bits.
BIT_CODES = mix(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, and where each text's begin (one more than texts)."""
    flat, ends = split_words(mapped(texts, LOWER))
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = table[np.asarray(coded.indices)] if len(table) else np.zeros(0, np.uint64)
    factor = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = len(h)
    run = np.zeros(n, np.uint64)
    for j in range(words):
        run[: n - j] += h[j:] * factor[j]
    run = mix(run)
    sets = []
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if z - a >= words:
            sets.append(np.unique(run[a : z - words + 1]))
        elif z > a:
            sets.append(mix(np.array([int((h[a:z] * factor[: z - a]).sum()) + z - a], np.uint64)))
        else:
            sets.append(h[:0])
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


class Bands:
    """Size bands: of a pair that can be similar, the larger is in the smaller's band or the next."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1, 2]

    def more(self) -> None:
        self.low.append(max(self.low[-1] + 1, (self.low[-1] - 1) * 100 // self.percent + 1))

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.more()
        return bisect_right(self.low, n) - 1

    def differ(self, band: int) -> int:
        """The most members in which a pair can differ whose smaller set is of this band."""
        while len(self.low) <= band + 1:
            self.more()
        least = self.low[band + 1] - 1
        both = least + least * 100 // self.percent
        return both * (100 - self.percent) // (100 + self.percent)


def sketch_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """The codes of a sorted set's blocks, in its own band and in the one below."""
    out = []
    own = bands.of(len(hashes))
    for band in (own, own - 1):
        if band < 0 or (differ := bands.differ(band)) < 1:
            continue  # only equal sets can be similar, and those are one class
        spare = SPARE + differ // SPARE_OF if differ >= 4 else 1
        blocks = differ + 1 + spare
        block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with the sorted hashes
        first = np.flatnonzero(np.diff(block, prepend=np.uint64(blocks)))
        absent = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[first])
        code = np.concatenate([np.bitwise_xor.reduceat(BIT_CODES[(hashes & np.uint64(BITS - 1)).astype(np.int64)], first), np.zeros(len(absent), np.uint64)])
        number, size = np.concatenate([block[first], absent]), np.concatenate([np.diff(first, append=len(hashes)), np.zeros(len(absent), np.int64)])
        kept = np.lexsort((number, size))[spare:]
        code, number = code[kept], number[kept]
        place = np.uint64((blocks * (1 << 32) + band * 0x9E3779B97F4A7C15) % (1 << 64))
        out.append(mix(code ^ mix(number + place)))
    return np.concatenate(out) if out else hashes[:0]


def parity(hashes: np.ndarray) -> bytes:
    """One bit for each place that an odd number of members has; about as many bits as members."""
    bits = max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def sketched(docs: DataFrame, words: int, percent: int, id_column: str) -> DataFrame:
    """(id, th, n, node, keys, bits): each row's set size and class; its sketches once for each class and task."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))

    def run(batches):
        let_go()
        bands, seen = Bands(percent), set()
        for part in (p for b in batches for p in steps(b, "text")):
            hashes, ends = shingle_sets(part.column("text"), words)
            nodes, keys, bits = [], [], []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                node = xxhash.xxh3_64_intdigest(hashes[a:z].tobytes()) - (1 << 63) if z > a else None
                own = None
                if node is not None and node not in seen:
                    seen.add(node)
                    own = sketch_keys(hashes[a:z], bands).tobytes() or None
                nodes.append(node)
                keys.append(own)
                bits.append(parity(hashes[a:z]) if own else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(np.diff(ends)), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())], ["id", "th", "n", "node", "keys", "bits"])

    return rows.mapInArrow(run, f"id {kind}, th long, n long, node long, keys binary, bits binary")


def shared_blocks(sets: DataFrame) -> DataFrame:
    """(gid, size, node): the classes of each block that several have; blocks of the same classes are one group."""

    def spread(batches):
        let_go()
        for b in batches:
            for at in range(0, len(b), 2000):
                keys, nodes = b.column("keys").slice(at, 2000), np.asarray(b.column("node").slice(at, 2000), np.int64)
                sizes = np.asarray(pa.compute.binary_length(keys), np.int64) // 8
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys.to_pylist()), np.int64)), pa.array(np.repeat(nodes, sizes))], ["key", "node"])

    def several(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(keys), bool)  # a class can come from several tasks
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(first, append=len(keys))
        gid = mix(np.add.reduceat(mix(nodes.astype(np.uint64)), first) + sizes.astype(np.uint64)).astype(np.int64) if len(first) else first
        at = np.repeat(sizes > 1, sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(gid, sizes)[at]), pa.array(np.repeat(sizes, sizes)[at]), pa.array(nodes[at])], ["gid", "size", "node"])

    def groups(batches):
        let_go()
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows whose last block may go on in the next batch
        for b in (b for b in batches if len(b)):
            keys, nodes = np.asarray(b.column("key")), np.asarray(b.column("node"))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or held and held[-1][0][-1] != keys[0]:
                held.append((keys[:cut], nodes[:cut]))
                yield several(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append((keys[cut:], nodes[cut:]))
        if held:
            yield several(*map(np.concatenate, zip(*held, strict=True)))

    rows = sets.filter(F.col("keys").isNotNull()).select("node", "keys").mapInArrow(spread, "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(groups, "gid long, size long, node long").distinct()


def close(members: list[tuple[int, int, bytes]], percent: int, split: list[bool] | None = None) -> list[tuple[int, int]]:
    """A forest over (node, size, parity sketch) of pairs whose sketches don't rule out that they are similar."""
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    nodes, sizes = [members[i][0] for i in order], np.array([members[i][1] for i in order])
    widths = [len(members[i][2]) for i in order]  # they rise with the sizes
    side = np.array([split[i] for i in order]) if split else None
    label, links, width, table = np.arange(len(order)), [], 0, None
    for i in range(len(order) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        open_ = label[i + 1 : last] != label[i]
        if side is not None:
            open_ &= side[i + 1 : last] != side[i]
        at = np.flatnonzero(open_) + i + 1
        if not len(at):
            continue
        if widths[i] != width:
            width, base = widths[i], i
            table = np.stack([np.bitwise_xor.reduce(np.frombuffer(members[j][2], np.uint64).reshape(-1, width // 8), axis=0) for j in order[i:]])
        most = (sizes[i] + sizes[at]) * (100 - percent) // (100 + percent)
        for start in range(0, len(at), 4096):
            some = at[start : start + 4096]
            apart = np.bitwise_count(table[some - base] ^ table[i - base]).sum(1)
            found = some[apart <= most[start : start + 4096]]
            joined, one = np.unique(label[found], return_index=True)
            new = joined != label[i]
            if new.any():
                links += [(nodes[i], nodes[int(j)]) for j in found[one[new]]]
                label[np.isin(label, joined)] = label[i]
    return links


def in_pairs_of_chunks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, chunks, node, ...) to (key, a, b, second, ...): each meets the others of its key chunk by chunk, once for each chunk."""
    chunk = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    return chunk.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(key, F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), (F.col("chunk") > F.col("other")).alias("second"), *columns)


def linked(pairs: DataFrame, key: str, compare) -> DataFrame:
    """(u, v): what compare(members, split) gives for each (key, a, b); members are the rows' columns after second."""

    def run(batches):
        let_go()
        at, group = None, []

        def done():
            if len(group) < 2:
                return None
            found = compare([m for _, m in group], [s for s, _ in group] if at[1] != at[2] else None)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

        for b in batches:
            for k, p, q, second, *member in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if (k, p, q) != at:
                    if (out := done()) is not None:
                        yield out
                    at, group = (k, p, q), []
                group.append((second, member))
        if (out := done()) is not None:
            yield out

    return pairs.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b").mapInArrow(run, "u long, v long")


def block_edges(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): for each block, a forest over its classes of what may be similar."""
    sketches = sets.filter(F.col("bits").isNotNull()).select("node", "n", "bits").dropDuplicates(["node"])
    rows = stored(shared_blocks(sets), "blocks").join(sketches, "node").withColumn("chunks", F.ceil(F.col("size") / GROUP).cast("int"))
    return linked(in_pairs_of_chunks(rows, "gid", ["node", "n", "bits"]), "gid", lambda members, split: close(members, percent, split)).distinct()


def verified(members: list[tuple[int, np.ndarray]], percent: int, split: list[bool] | None = None) -> list[tuple[int, int]]:
    """A forest of true links among (node, sorted hashes); with split, only between members of different sides."""
    root = list(range(len(members)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(len(members)), key=lambda i: len(members[i][1]))
    members = [members[i] for i in order]
    side = np.array([split[i] for i in order]) if split else None
    sizes = np.array([len(m[1]) for m in members])
    _, codes = np.unique(np.concatenate([m[1] for m in members]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(int(codes.max()) + 1, np.int64)
    links = []
    for i in range(len(members) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))  # larger sets can't be similar
        if last <= i + 1:
            continue
        mine = find(i)
        open_ = np.fromiter((find(j) != mine for j in range(i + 1, last)), bool, last - i - 1)
        if side is not None:
            open_ &= side[i + 1 : last] != side[i]
        if not open_.any():
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        held[own] = 1
        stop = starts[last - 1] + sizes[last - 1]
        common = np.add.reduceat(held[codes[starts[i + 1] : stop]], starts[i + 1 : last] - starts[i + 1])
        held[own] = 0
        similar = 100 * common >= percent * (sizes[i] + sizes[i + 1 : last] - common)
        for j in np.flatnonzero(similar & open_) + i + 1:
            if find(int(j)) != find(i):
                root[find(int(j))] = find(i)
                links.append((members[i][0], members[int(j)][0]))
    return links


def true_links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, words: int, percent: int, id_column: str) -> DataFrame:
    """(u, v): links that join what is linked within each cluster."""
    # one row for each class, and the cluster's size in hashes
    of = sets.filter("n > 0").groupBy("node").agg(F.min_by(F.struct("id", "th", "n"), F.struct("id", "th")).alias("x")).join(clusters, "node").select("node", "x.*", F.col("root").alias("cluster"))
    big = of.groupBy("cluster").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks")).filter("chunks > 1")
    chosen = stored(of.join(big, "cluster", "left").select("id", "th", "node", "cluster", F.coalesce("chunks", F.lit(1)).alias("chunks")), "classes")
    side = F.broadcast(chosen) if chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else chosen
    rows = docs.select(F.col(id_column).alias("did"), text_of().alias("text")).withColumn("dth", F.xxhash64("text"))
    texts = rows.join(side, F.col("did").eqNullSafe(F.col("id")) & (F.col("dth") == F.col("th"))).select("node", "cluster", "chunks", "text")

    def to_sets(part):
        let_go()
        hashes, ends = shingle_sets(part.column("text"), words)
        raw = [hashes[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column("node"), part.column("cluster"), part.column("chunks"), pa.array(raw, pa.binary())], ["node", "cluster", "chunks", "hashes"])

    members = map_arrow(texts, to_sets, "node long, cluster long, chunks int, hashes binary")

    def compare(found, split):
        return verified([(node, np.frombuffer(raw, np.uint64)) for node, raw in found], percent, split)

    return linked(in_pairs_of_chunks(members, "cluster", ["node", "hashes"]), "cluster", compare)


def grouped(docs: DataFrame, words: int, percent: int, id_column: str) -> DataFrame:
    """(id, th, n, root) for each row: its component's class, null for an empty set."""
    spark = docs.sparkSession
    wide_at, sets_at = scratch(spark, "sketches"), scratch(spark, "sets")
    wide = stored(sketched(docs, words, percent, id_column), "sketches", wide_at)
    edges = stored(block_edges(wide, percent), "edges")
    sets = stored(wide.select("id", "th", "n", "node"), "sets", sets_at)
    discard(spark, wide_at)  # the sketches are most of what has been written
    links = stored(true_links(docs, sets, components(edges), words, percent, id_column), "links")
    return sets.select("id", "th", "n", "node").join(components(links), "node", "left").select("id", "th", "n", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id") -> DataFrame:
    """For each row: n_shingles, and component_id, the smallest id reachable by links of at least percent / 100."""
    rows = grouped(docs, words, percent, id_column)
    named = rows.filter("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    return rows.join(named, "root", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id") -> DataFrame:
    """One row of each component, that of the smallest id; rows without any word all stay."""
    rows = stored(grouped(docs, words, percent, id_column).filter("n > 0"), "groups")
    kept = rows.groupBy("root").agg(F.min(F.struct("id", "th")).alias("x"), F.count("*").alias("rows")).filter("rows > 1")
    gone = rows.join(kept, "root").filter(~(F.col("id").eqNullSafe(F.col("x.id")) & (F.col("th") == F.col("x.th"))))
    left = without(docs, gone, id_column)
    # a kept row may stand in the table more than once
    again = rows.groupBy(F.col("id").alias("again_id"), F.col("th").alias("again_th")).agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    if again.isEmpty():
        return left
    one = wrapped(left, id_column).join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("th") == F.col("again_th"))).dropDuplicates(["id", "th"]).select("row.*")
    return without(left, again.select(F.col("again_id").alias("id"), F.col("again_th").alias("th")), id_column).unionByName(one)
