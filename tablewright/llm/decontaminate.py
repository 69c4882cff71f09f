"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is a run of `size` consecutive words of an item (a shorter item is one window).  Its tokens
are its shingles of three consecutive words (fewer in shorter windows).  A document that contains the
window contains all its tokens, so it is enough to look for one of them: the one that is rarest in
the whole corpus.  One pass over the texts keeps the places of the benchmark's shingles; their counts
order them by rarity; each window joins on its rarest shingle at the place where the window would
begin, within the document's length; then all its shingles must stand at their places.

Shingles are 64-bit hashes of their words; a wrong match needs every hash of a window to collide in a
row.  Documents are rows: repeated rows give repeated results.  A null or empty text has no words and
hits nothing; items without words have no windows; an empty benchmark hits nothing, and an empty
document table gives an empty result.  Other columns are never read.  All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored, text_of, without

#: Words are what lies between these characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Benchmark shingles that may be sent to every executor (16 bytes each in a long table); more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def shingles(words: Column, sizes: list[int]) -> Column:
    """Places (from 0) and hashes of the runs of each of these many words."""

    def runs(k: int) -> Column:
        # zip the words with themselves moved on, so that each element sees its run without a search
        n = F.size(words) - (k - 1)
        moved = [F.slice(words, j + 1, F.greatest(n, F.lit(0))).alias(f"w{j}") for j in range(k)]
        return F.when(n > 0, F.transform(F.arrays_zip(*moved), lambda x, i: F.struct(i.alias("p"), F.xxhash64(*[x[f"w{j}"] for j in range(k)]).alias("sh"))))

    none = F.array().cast("array<struct<p:int,sh:bigint>>")
    return F.concat(*[F.coalesce(runs(k), none) for k in sizes]) if sizes else none


def windows_of(benchmark: DataFrame, size: int, item_column: str, text_column: str) -> DataFrame:
    """(item_id, wid, len, words): the windows of all items; equal windows have one wid."""
    items = benchmark.select(F.col(item_column).alias("item_id"), words_of(text_of(text_column)).alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))).alias("s")
    cut = items.select("item_id", "w", start).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("words"))
    return cut.select("item_id", F.xxhash64(F.array_join("words", " ")).alias("wid"), F.size("words").alias("len"), "words").distinct()


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int, id_column: str, item_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (id, th, n_words), the windows found in them (id, th, wid, start, end), and all windows (item_id, wid)."""
    spark = docs.sparkSession
    windows = stored(windows_of(benchmark, size, item_column, text_column), "windows")
    # (wid, len, j, sh): the shingles of each window, at their places
    sizes = [r["k"] for r in windows.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # at most three
    distinct = windows.dropDuplicates(["wid"])
    parts = [distinct.filter(F.least("len", F.lit(SHINGLE)) == k).select("wid", "len", F.explode(shingles(F.col("words"), [k])).alias("x")).select("wid", "len", F.col("x.p").alias("j"), "x.sh") for k in sorted(sizes)]
    tokens = parts[0] if parts else spark.createDataFrame([], "wid long, len int, j int, sh long")
    for p in parts[1:]:
        tokens = tokens.unionByName(p)
    tokens = stored(tokens, "tokens")
    wanted = tokens.select("sh").distinct().withColumn("wanted", F.lit(True))
    if wanted.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)

    # One pass over the texts.  Each row also leaves one mark (p = -1) that carries its number of words.
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_of(text_column)).alias("th"), words_of(text_of(text_column)).alias("w"))
    mark = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("long").alias("sh")))
    places = rows.select("id", "th", F.size("w").alias("n_words"), F.explode(F.concat(mark, shingles(F.col("w"), sorted(sizes)))).alias("x")).select("id", "th", "n_words", "x.p", "x.sh")
    seen = stored(places.join(wanted, "sh", "left").filter((F.col("p") < 0) | F.col("wanted")).drop("wanted"), "places")
    hits = seen.filter("p >= 0").distinct()

    count = hits.groupBy("sh").agg(F.count("*").alias("n"))
    rare = tokens.join(count, "sh").groupBy("wid", "len").agg(F.count("*").alias("k"), F.min_by(F.struct("sh", "j"), F.struct("n", "sh", "j")).alias("r"))
    # a window with a shingle that stands nowhere stands nowhere
    prefix = rare.filter(F.col("k") == F.col("len") - F.least("len", F.lit(SHINGLE)) + 1).select("wid", "len", F.col("r.sh").alias("sh"), F.col("r.j").alias("j"))
    begin = hits.join(prefix, "sh").withColumn("start", F.col("p") - F.col("j")).filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words"))).select("id", "th", "wid", "len", "start")
    need = begin.join(tokens.drop("len"), "wid").withColumn("p", F.col("start") + F.col("j"))
    at = hits.select(F.col("id").alias("hid"), F.col("th").alias("hth"), F.col("p").alias("hp"), F.col("sh").alias("hsh"))
    whole = (
        need.join(at, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")) & (F.col("p") == F.col("hp")) & (F.col("sh") == F.col("hsh")))
        .groupBy("id", "th", "wid", "len", "start")
        .agg(F.count("*").alias("k"))
        .filter(F.col("k") == F.col("len") - F.least("len", F.lit(SHINGLE)) + 1)
    )
    found = stored(whole.select("id", "th", "wid", "start", (F.col("start") + F.col("len")).alias("end")), "found")

    return seen.filter("p < 0").select("id", "th", "n_words"), found, windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """For each row of docs: n_words, n_hit, n_items, items_sha256, contaminated."""
    marks, found, windows = find_windows(docs, benchmark, size, id_column, item_column, text_column)
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    hit = found.groupBy("id", "th").agg(covered.alias("n_hit"))
    listed = (
        found.select("id", "th", "wid").distinct().join(windows.select("wid", "item_id"), "wid").select("id", "th", "item_id").distinct()
        .groupBy("id", "th").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.coalesce(F.col("item_id").cast("string"), F.lit("")))), ",").alias("items"))
    )
    result = hit.join(listed, [hit["id"].eqNullSafe(listed["id"]), hit["th"] == listed["th"]]).select(hit["id"].alias("rid"), hit["th"].alias("rth"), "n_hit", "n_items", "items")
    return marks.join(result, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left").select(
        F.col("id").alias(id_column),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_column: str = "doc_id", item_column: str = "item_id") -> DataFrame:
    """The rows in which no window of the benchmark stands, with all their columns."""
    _, found, _ = find_windows(docs, benchmark, size, id_column, item_column, "text")
    return without(docs, found.select("id", "th"), id_column)
