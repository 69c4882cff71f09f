"""Removal of repeated byte strings against brute force."""

import hashlib
import random

from tablewright.llm.common import folders, scratch
from tablewright.llm.suffix_dedup import MATCH, SuffixFamily, anchors, bytes_of, gram_of, place_of, remove_repeats, sampled

SCHEMA = "doc_id long, text string, lang string, id string, th long, list string"


def brute(docs, length):
    places = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for n, (_, b) in enumerate(raw):
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((n, i))
    gone = [[False] * len(b) for _, b in raw]
    for hits in places.values():
        if len(hits) > 1:
            for n, i in hits:
                gone[n][i : i + length] = [True] * length
    out = []
    for (d, b), g in zip(raw, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        out.append((d, len(b), sum(g), sum(y and not x for x, y in zip([False, *g], g, strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def holds_repeat(docs, length):
    """Whether each text holds a string of so many bytes that starts elsewhere too."""
    return [n > 0 for _, _, n, _, _ in brute(docs, length)]


def check(spark, docs, length):
    df = spark.createDataFrame([(d, t, "en", "x", 1, "y") for d, t in docs], SCHEMA)
    got = [tuple(r) for r in remove_repeats(df, length).collect()]
    assert order(r[:5] for r in got) == order(brute(docs, length))
    # a repeated string of MATCH bytes has a match, and a match is a repeated gram
    matched = sorted((str(r[0]), r[4], r[5] > 0) for r in got)
    must, may = holds_repeat(docs, min(length, MATCH)), holds_repeat(docs, gram_of(length))
    for (_, _, is_), (_, _, low, high) in zip(matched, sorted((str(d), x[4], a, b) for (d, _), x, a, b in zip(docs, brute(docs, length), must, may, strict=True)), strict=True):
        assert low <= is_ <= high


def test_random_texts_with_planted_repeats(spark):
    r = random.Random(5)
    word = lambda n, letters="abcdé": "".join(r.choice(letters) for _ in range(n))
    shared = [word(60) for _ in range(4)]
    docs = []
    for i in range(60):
        t = word(r.randrange(0, 80))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(shared)
            a = r.randrange(0, 25)
            t += p[a : a + r.randrange(10, 60)] + word(r.randrange(0, 30))
        docs.append((i, t))
    docs += [(100, docs[0][1]), (100, docs[0][1]), (101, docs[1][1] + "!"), (None, docs[2][1])]
    check(spark, docs, 24)


def test_periodic_null_empty_and_repeated_rows(spark):
    docs = [(1, "a" * 200), (2, "ab" * 50), (3, None), (4, ""), (5, "short"), (6, "xyz" * 7 + "q" + "xyz" * 7), (7, "short"), (8, "b" + "ab" * 20), (9, "é" * 40)]
    check(spark, docs, 24)
    check(spark, docs, 20)


def test_thousand_copies_of_a_passage(spark):
    r = random.Random(7)
    passage = "".join(r.choice("abcdefgh ") for _ in range(40))
    docs = [(i, "".join(r.choice("abcdefgh ") for _ in range(i % 7)) + passage + "".join(r.choice("xyz") for _ in range(i % 11))) for i in range(1000)]
    check(spark, docs, 32)


def test_passages_shorter_than_a_run(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, run = word(300), word(450)
    docs = [(1, word(500) + passage), (2, passage + word(90)), (3, word(70) + passage[:260] + word(600)), (4, word(900)), (5, passage[:100] + word(400)), (6, run + word(30)), (7, word(200) + run), (8, passage), (9, word(256))]
    check(spark, docs, 400)
    got = {x["doc_id"]: (x["n_removed"], x["n_matches"] > 0) for x in remove_repeats(spark.createDataFrame([(d, t, "", "", 0, "") for d, t in docs], SCHEMA), 400).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (0, True), 4: (0, False), 5: (0, False), 6: (450, True), 7: (450, True), 8: (0, True), 9: (0, False)}


def test_a_stored_family_takes_more_batches(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    path = scratch(spark, "family")

    def batch(*texts):
        rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, th long, text string")
        return sampled(rows, 400).selectExpr("head", "gram", "CAST(k AS long) AS n", "id", "th", "place").withColumn("at", place_of()).select("head", "gram", "n", "at")

    assert SuffixFamily(spark, path).add(batch(texts[0], texts[1])).count() == 0
    assert SuffixFamily(spark, path).add(batch(texts[2])).count() == 0  # merges with the first level
    assert folders(spark, path) == ["level-1"]
    family = SuffixFamily(spark, path)
    found = family.add(batch("!" + texts[1], texts[3]))
    assert found.count() > 0 and folders(spark, path) == ["level-0", "level-1"]
    again = batch(texts[1]).join(found, ["head", "gram"]).count()
    assert again == found.distinct().count()
    assert family.add(batch(texts[4])).count() == 0 and folders(spark, path) == ["level-2"]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA), 24).collect() == []


def test_full_output_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "head " + "0123456789" * 3, "", "", 0, ""), (2, "0123456789" * 3 + " tail", "", "", 0, "")], SCHEMA)
    rows = {x["doc_id"]: x for x in remove_repeats(docs, 30, full=True).collect()}
    assert (bytes(rows[1]["kept"]), rows[1]["removed"]) == (b"head ", [[5, 35]])
    assert (bytes(rows[2]["kept"]), rows[2]["removed"]) == (b" tail", [[0, 30]])


def test_every_run_has_one_anchor_that_it_holds():
    import pyarrow as pa

    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(n)) for n in (0, 5, 24, 25, 300)]
    data, offsets = bytes_of(pa.array(texts))
    place, first, last, _ = anchors(data, offsets, 24)
    starts = [s for a, z in zip(first, last, strict=True) for s in range(a, z + 1)]
    assert starts == [o + s for o, t in zip(offsets, texts, strict=False) for s in range(len(t) - 23)]
    assert all(z <= p < a + 24 for p, a, z in zip(place, first, last, strict=True))
