"""A toxicity classifier with counterfactual regularisation.

Logistic regression on which words and word beginnings a text holds (a beginning is written with a
star: insults inflect).  They are chosen by their association with the label in a bounded,
hash-ordered sample of labelled rows; identity terms always are features.  For
each training text that names a group, the loss also has the squared change of its score when every
identity term is swapped for the next of its set, so that the score doesn't hang on which group is
named.  Scoring takes whole texts.

A null text counts as empty and gets the score of a text without any feature.  Labels may be
missing, null or repeated (a row is toxic if any of its labels is); without labels of both kinds the
score is the share of toxic rows (0.0 with none).  Repeated rows give repeated results and an empty
table an empty one.  Only the id and the text are read for scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, let_go, letters_only, map_arrow, mapped, split_words, steps, stored, text_of

# Sets of identity terms; a term is swapped for the next of its set.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("african", "european", "american", "arab", "mexican", "chinese"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY for i, term in enumerate(group)}


@dataclass(frozen=True)
class Settings:
    #: Labelled rows used for the fit: those with the smallest hashes of their ids.
    max_rows: int = 20_000
    #: Features kept, and in how many rows and what share of the sample each must occur.
    max_features: int = 4096
    least_rows: int = 4
    least_share: float = 0.001
    #: Squared deviations by which a word must be associated with the label.
    least_chi2: float = 20.0
    #: Weights of the squared coefficients and of the squared counterfactual changes.
    l2: float = 2e-4
    counterfactual: float = 1.0
    steps: int = 500


@dataclass(frozen=True)
class Model:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    prior: float | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        owner, feature = features(texts, self.words)
        z = self.bias + np.bincount(owner, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


LETTERS = letters_only(keep_digits=False)
#: Letters of the word beginnings.
BEGINNINGS = (3, 4, 5, 6, 7)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word's text, the distinct words, and which of them each word is; words are lowered runs of letters."""
    flat, ends = split_words(mapped(pc.utf8_lower(texts), LETTERS))
    coded = flat.dictionary_encode()
    return np.repeat(np.arange(len(texts)), np.diff(ends)), coded.dictionary, np.asarray(coded.indices, np.int64)


def forms(words: pa.Array):
    """The words, then for each length their beginnings (null for shorter words, and for identity terms: they count only as what is swapped)."""
    yield words
    sizes = pc.if_else(pc.is_in(words, value_set=pa.array(list(SWAP), words.type)), 0, pc.utf8_length(words))
    for k in BEGINNINGS:
        begun = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string()))
        yield pc.if_else(pc.greater_equal(sizes, k), begun, pa.scalar(None, pa.large_string()))


def features(texts: pa.Array, known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, for the features that the texts hold."""
    owner, distinct, which = words_of(texts)
    value_set, size, pairs = pa.array(known, pa.large_string()), len(known) + 1, []
    for form in forms(distinct):
        at = np.asarray(pc.fill_null(pc.index_in(form, value_set=value_set), -1), np.int64)
        at = np.where(np.asarray(form.is_valid()), at, -1)[which]
        held = at >= 0
        pairs.append(owner[held] * size + at[held])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // size, pairs % size


def in_fold(id_column: str) -> Column:
    """Rows held out of the fit: crc32 of the id as text is divisible by 5.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, settings: Settings, id_column: str, label_column: str) -> DataFrame:
    """(id, toxic, text) of at most max_rows labelled rows outside the held-out fold."""
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~in_fold(id_column))
    chosen = known.groupBy(F.col(id_column).alias("lid")).agg(F.max(F.col(label_column).cast("int")).alias("toxic")).orderBy(F.xxhash64("lid"), "lid").limit(settings.max_rows)
    rows = docs.select(F.col(id_column).alias("id"), text_of().alias("text"))
    # the sample's ids: at most max_rows rows of two numbers
    return rows.join(F.broadcast(stored(chosen, "labelled")), F.col("id") == F.col("lid")).select("id", "toxic", "text").dropDuplicates(["id"])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", label_column: str = "toxic") -> Model:
    """The classifier; the driver gets at most max_rows short lists of feature numbers."""

    def distinct_words(part: pa.RecordBatch) -> pa.RecordBatch:
        let_go()
        owner, distinct, which = words_of(part.column("text"))
        found = []
        for form in forms(distinct):
            coded = form.dictionary_encode()
            at, size = np.asarray(pc.fill_null(coded.indices, -1), np.int64)[which], len(coded.dictionary) + 1
            pairs = np.unique(owner[at >= 0] * size + at[at >= 0])
            found.append((pairs // size, coded.dictionary.take(pa.array(pairs % size))))
        whose, names = np.concatenate([o for o, _ in found]), pa.concat_arrays([w for _, w in found])
        order = np.argsort(whose, kind="stable")
        lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(whose[order], np.arange(len(part) + 1))), names.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([part.column("toxic"), lists.cast(pa.list_(pa.string()))], ["toxic", "words"])

    rows = stored(map_arrow(sample(docs, labels, settings, id_column, label_column).repartition(16).select("toxic", "text"), distinct_words, "toxic int, words array<string>"), "sample")
    n, positive = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not positive or positive == n:
        return Model(prior=(positive or 0) / n if n else 0.0)
    by_word = rows.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("k"), F.sum("toxic").alias("t"))
    p = positive / n
    expected = F.col("k") * p
    chosen = by_word.filter(F.col("k") >= max(settings.least_rows, settings.least_share * n)).withColumn("chi2", F.pow(F.col("t") - expected, 2) / (expected * (1 - p))).filter(F.col("chi2") >= settings.least_chi2)
    top = [r["w"] for r in chosen.orderBy(F.desc("chi2"), "w").limit(settings.max_features).select("w").collect()]
    words = sorted({*top, *SWAP})
    place = {w: i for i, w in enumerate(words)}

    def numbered(batches):
        value_set = pa.array(words)
        for b in batches:
            lists = b.column("words")
            at = pc.index_in(pc.list_flatten(lists), value_set=value_set)
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)])
            known = np.asarray(at.is_valid())
            kept = np.concatenate([[0], np.cumsum(known)])[ends]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.ListArray.from_arrays(pa.array(kept, pa.int32()), at.filter(pa.array(known)).cast(pa.int32()))], ["toxic", "at"])

    got = rows.mapInArrow(numbered, "toxic int, at array<int>").toArrow().combine_chunks()
    y = np.asarray(got.column("toxic"), np.float64)
    lists = got.column("at").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    column = np.asarray(pc.list_flatten(lists), np.int64)
    row = np.repeat(np.arange(len(y)), np.asarray(pc.list_value_length(lists), np.int64))
    order = np.lexsort((column, row))
    swap = np.full(len(words), -1)
    for a, b in SWAP.items():
        swap[place[a]] = place[b]
    weights, bias = train(row[order], column[order], y, len(words), swap, settings)
    return Model(words, weights, bias)


def train(row: np.ndarray, column: np.ndarray, y: np.ndarray, width: int, swap: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + l2 |w|^2 + counterfactual * mean squared change of the logit under the swap, by Adam."""
    n = len(y)
    named = swap[column] >= 0
    # the swapped text has the swapped terms in place of its own: change = sum of weights gained - weights lost
    c_row = np.concatenate([row[named], row[named]])
    c_col = np.concatenate([swap[column[named]], column[named]])
    c_val = np.concatenate([np.ones(named.sum()), -np.ones(named.sum())])
    w, b = np.zeros(width), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, settings.steps + 1):
        z = b + np.bincount(row, w[column], n)
        miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        change = np.bincount(c_row, c_val * w[c_col], n)
        g = np.bincount(column, miss[row], width) + 2 * settings.l2 * w
        g += 2 * settings.counterfactual / n * np.bincount(c_col, c_val * change[c_row], width)
        grad = np.append(g, miss.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """For each row: whether it is held out, its score, and the decision at one half."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        let_go()
        s = model.scores(part.column("text"))
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), in_fold(id_column).alias("held_out"), text_of().alias("text"))
    return map_arrow(rows, run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_column)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", label_column: str = "toxic") -> DataFrame:
    return score(docs, fit(docs, labels, settings, id_column, label_column), id_column)


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows whose score is below one half, with all their columns."""

    def run(batches):
        let_go()
        for b in batches:
            for part in steps(b, text_column):
                clean = part.filter(pa.array(model.scores(pc.fill_null(part.column(text_column), "")) < 0.5))
                if len(clean):
                    yield clean

    return bounded(docs).mapInArrow(run, docs.schema)
