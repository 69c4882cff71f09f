"""Token counts by prefix dynamic programming.

Each word's table holds the exact number of tokens of each of its prefixes; a text's table is the
running sum over its words.  So "how many tokens have the first n characters" and "what fits into a
budget" need no second encoding: the running sum finds the word, the word's table the character.

A null text counts as empty (0 tokens).  Rows are independent, so repeated rows give repeated
results and an empty table an empty one; only the columns named are read, whatever others there are.
Very long texts and very long words take memory in proportion to themselves.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Words, words_of
from .common import map_arrow, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of the longest piece that isn't a run of one kind ("'re").
NEAR = 3


def prefix_table(words: Words, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the text's words, in characters, and the tokens of the text up to each end."""
    counts, _ = words.counts(pa.array([text]))
    return np.array([m.end() for m in WORD.finditer(text)], np.int64), np.cumsum(counts)


@cache
def composing() -> frozenset[str]:
    """Characters that a normaliser can join to the one before: second parts of compositions, and Hangul vowels and ends."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset([chr(int(p[1], 16)) for p in parts if len(p) == 2 and p[0][0] != "<"] + [chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))])


@cache
def joins(c: str) -> bool:
    """Whether normalising can change with what stands before this character."""
    first = unicodedata.normalize("NFD", c)[0]
    return c > "\x7f" and (first in composing() or unicodedata.combining(first) > 0)


def word_prefixes(words: Words, word: str, most: int | None = None) -> list[int]:
    """counts[i]: tokens of the word's first i characters.

    Pieces before the cut are summed, and one pass of the dynamic programme over each piece has the
    counts of all its cuts, so time and memory are in proportion to the word (and to the square of
    the marks on one letter).  With `most`, larger counts may be given as most + 1, and the list ends
    where no longer prefix has that few.
    """
    out, whole = [0], 0
    parts = [*(words.special.split(word) if words.special else [word]), ""]
    for text, special in zip(parts[::2], parts[1::2], strict=True):
        # a special token is text until it is whole
        found = _text_prefixes(words, text + special[:-1], None if most is None else most - whole)
        out += [whole + c for c in found[1:]]
        if len(found) <= len(text):
            break
        if special:
            out += [most + 1 if most is not None else 0] * (len(text) + len(special) - len(found))
            whole += found[len(text)] + 1
            out.append(whole)
    return out


def _text_prefixes(words: Words, text: str, most: int | None) -> list[int]:
    """As word_prefixes, for a word without special tokens.

    Characters that join to the one before form groups with it.  Normalised groups stand one after
    another; a cut inside one can change only its own letters and where the last pieces before it end.
    """
    normal = words.library.normalizer.normalize_str if words.library.normalizer is not None else str
    split, merges = words.library.pre_tokenizer.pre_tokenize_str, words.merges
    normal_of, count_of = cache(normal), cache(lambda piece: merges.prefix_counts(piece)[-1])
    begins_of_groups = [i for i, c in enumerate(text) if not i or not joins(c)] + [len(text)]
    groups = [[normal_of(text[a:i]) for i in range(a + 1, b + 1)] for a, b in itertools.pairwise(begins_of_groups)]
    line = "".join(g[-1] for g in groups)
    pieces = split(line)
    begins, ends = [a for _, (a, _) in pieces], [b for _, (_, b) in pieces]
    before, tables = [0], []  # tokens before each piece; its states, and the letters before each of its characters
    out, cut, closed = [0], 0, len(line) + 1  # closed: what goes on from here has more than `most`
    for group in groups:
        while len(tables) < len(pieces) and begins[len(tables)] < cut + len(group[-1]) and closed > len(line):
            letters, (a, b) = pieces[len(tables)]
            places = np.cumsum([0, *[len(c.encode()) for c in line[a:b]]])
            states, inner, counts = merges.prefix_states(letters, None if most is None else most - before[-1])
            tables.append((states, inner, counts, places))
            before.append(before[-1] + counts[-1])
            if len(counts) <= len(letters):
                closed = a + int(np.searchsorted(places, len(counts) - 1))
        safe = max(bisect.bisect_right(begins, cut - NEAR) - 1, 0)  # pieces before this one stay, whatever comes
        if cut >= closed or most is not None and before[min(safe, len(tables))] > most:
            break
        for some in group:
            end = cut + len(some)
            if line.startswith(some, cut):
                at = bisect.bisect_left(ends, end)
                if end >= closed:
                    out.append(most + 1)
                elif at == len(pieces) or begins[at] >= end:
                    out.append(before[at])
                elif ends[at] == end:
                    out.append(before[at + 1])
                elif ends[at] - begins[at] > NEAR:
                    _, _, counts, places = tables[at]
                    out.append(before[at] + counts[places[end - begins[at]]])
                else:
                    out.append(before[at] + sum(count_of(p) for p, _ in split(line[begins[at] : end])))
                continue
            begin = begins[safe] if begins and begins[safe] <= cut - NEAR else 0
            if cut - begin <= 4 * NEAR:
                out.append(before[safe] + sum(count_of(p) for p, _ in split(line[begin:cut] + some)))
                continue
            # a long run: its end tells where the pieces end, its states the tokens
            near = max(min(cut, ends[safe]) - 2 * NEAR, begin)
            (first, _), *rest = split(line[near:cut] + some)
            states, inner, _, places = tables[safe]
            out.append(before[safe] + merges.count_changed(pieces[safe][0], int(places[near - begin]), states, inner, first) + sum(count_of(p) for p, _ in rest))
        cut += len(group[-1])
    return out


def count_prefix(words: Words, text: str, n: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Tokens of text[:n], from the tables."""
    ends, sums = table or prefix_table(words, text)
    k = int(np.searchsorted(ends, n, "right"))
    whole = int(sums[k - 1]) if k else 0
    begin = int(ends[k - 1]) if k else 0
    rest = text[begin:n].lstrip(" \t\n\r\v\f")
    if not rest or k >= len(ends):
        return whole
    word = WORD.search(text, begin)[0]
    return whole + word_prefixes(words, word)[len(rest)]


def fitting_prefix(words: Words, text: str, budget: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Characters of the longest prefix with at most `budget` tokens (without the white space after its last word)."""
    ends, sums = table or prefix_table(words, text)
    k = int(np.searchsorted(sums, budget, "right"))
    whole, begin = (int(sums[k - 1]), int(ends[k - 1])) if k else (0, 0)
    if k >= len(ends):
        return begin
    m = WORD.search(text, begin)
    inside = word_prefixes(words, m[0], budget - whole)
    fits = max(i for i, c in enumerate(inside) if whole + c <= budget)
    return m.start() + fits if fits else begin


def token_counts(docs: DataFrame, vocabulary: str, budget: int = 2048, id_column: str = "doc_id") -> DataFrame:
    """For each row: n_bytes, n_tokens, whether it goes over the budget, and fit_chars, what of it the budget holds."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(vocabulary)
        texts = part.column("text")
        counts, ends = words.counts(texts)
        sums = np.concatenate([[0], np.cumsum(counts)])
        totals = sums[ends[1:]] - sums[ends[:-1]]
        fit = np.asarray(pc.utf8_length(texts), np.int64).copy()
        for i in np.flatnonzero(totals > budget):
            text = texts[int(i)].as_py()
            own = np.array([m.end() for m in WORD.finditer(text)], np.int64), sums[ends[i] + 1 : ends[i + 1] + 1] - sums[ends[i]]
            fit[i] = fitting_prefix(words, text, budget, own)
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(np.asarray(pc.binary_length(texts), np.int64)), pa.array(totals), pa.array(totals > budget), pa.array(fit)],
            ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
        )

    kind = docs.schema[id_column].dataType.simpleString()
    out = map_arrow(docs.select(F.col(id_column).alias("id"), text_of().alias("text")), run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.withColumnRenamed("id", id_column)


def prefix_tables(docs: DataFrame, vocabulary: str, id_column: str = "doc_id") -> DataFrame:
    """For each row the whole table: word_ends (characters) and token_sums, arrays of equal length."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(vocabulary)
        tables = [prefix_table(words, t) for t in part.column("text").to_pylist()]
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array([e for e, _ in tables], lists), pa.array([s for _, s in tables], lists)], ["id", "word_ends", "token_sums"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_column).alias("id"), text_of().alias("text")), run, f"id {kind}, word_ends array<long>, token_sums array<long>").withColumnRenamed("id", id_column)
