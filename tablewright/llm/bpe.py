"""Byte-pair encoding by last-token states.

A byte-pair encoding of a string is the one split into tokens in which every neighbouring pair is
stable: no merge across their border would have come before the merges that built the two.  So the
encoding of a prefix is known by its last token alone, and the encoding of a longer string extends
that of one of its prefixes.  Words are visited in sorted order, which is the depth-first order of
their trie: states of a prefix that neighbours share are computed once.

The library of the vocabulary file splits texts into pieces; merging happens here.
"""

from __future__ import annotations

import base64
import gc
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept, split_words

#: What either Unicode's or Python's rules call white space.
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Between these two characters every pattern for words has a border.
BORDER = re.compile(f"(?<=[^{SPACE}])(?= [^{SPACE}])")
#: A text that can't be cut before each space and each line end.
UNEVEN = f"(^[ \n])|([ \n]$)|([ \n][{SPACE}])|([{SPACE}][ \n])"
#: A word of letters whose pieces are plain: a line end, the word, and the marks after it.
PLAIN = re.compile("(\n)?( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@[-`{-~]*)")
#: Such a word behind a space or a line end, for whole columns.
PLAIN_BEGUN = "^(\n ?| )[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[!-&(-/:-@\\[-`{-~]*$"
#: Words kept between batches; beyond that the store starts anew.
STORE_WORDS = 600_000
STORE_IDS = 6_000_000
#: The same where a file of ranks makes new words cheap.
RANKED_WORDS = 250_000
RANKED_IDS = 3_000_000


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter; the others move to 256 and up, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(moved)}


LETTERS = byte_letters()
LETTER_OF_BYTE = {b: ord(c) for b, c in LETTERS.items()}


def as_letters(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(LETTER_OF_BYTE)


def all_ends(tokens: dict[str, int]) -> dict[str, int]:
    """Every ending of every token, with the id where it is a token."""
    return {t[i:]: -1 for t in tokens for i in range(len(t))} | tokens


class Merges:
    """Vocabulary and merges of a tokenizer file, with the test whether two tokens can stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.vocab[left], self.vocab[right]
            whole = self.vocab[left + right]
            self.rank.setdefault(a * self.size + b, r)
            self.made.setdefault(whole, (a, b, r))
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._stable: dict[int, bool] = {}
        last = len(self.rank) + 1
        self.never = last
        # A token counts only if merging its own letters leads to it.
        n = len(self.end)
        sound = {i for t, i in self.vocab.items() if i not in self.made and len(t) <= 1 + (n if n and t.endswith(self.end) else 0)}
        for whole, (a, b, r) in sorted(self.made.items(), key=lambda x: x[1][2]):
            if a in sound and b in sound and self._apart(a, b, r):
                sound.add(whole)
        inner = {t: i for t, i in self.vocab.items() if i in sound and not (n and t.endswith(self.end))}
        last = {t[: len(t) - n]: i for t, i in self.vocab.items() if i in sound and t.endswith(self.end)} if n else inner
        self.inner_ends, self.last_ends = all_ends(inner), all_ends(last)
        self.length = [0] * self.size
        for t, i in [*inner.items(), *last.items()]:
            self.length[i] = len(t)
        self.length.append(1)  # of -1, so that a walk ends
        self.longest = max(self.length)

    def _spine(self, token: int, side: int, store: dict) -> list[tuple[int, int]]:
        """The tokens at one border of a token from the whole inwards, each with the rank at which it is merged away."""
        found = store.get(token)
        if found is None:
            found, at, gone = [], token, self.never
            while True:
                found.append((at, gone))
                if at not in self.made:
                    break
                a, b, gone = self.made[at]
                at = b if side else a
            store[token] = found
        return found

    def _apart(self, a: int, b: int, before: int) -> bool:
        """No merge across the border comes before rank `before` and before what merges either side away.

        Of merges of equal rank the left one comes first.
        """
        get, size = self.rank.get, self.size
        right = self._spine(b, 0, self._left)
        for x, x_gone in self._spine(a, 1, self._right):
            x_gone, base = min(x_gone, before), x * size
            for y, y_gone in right:
                r = get(base + y)
                if r is not None and r < x_gone and r <= y_gone and r < before:
                    return False
        return True

    def stable(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self._stable.get(key)
        if found is None:
            if len(self._stable) > 2_000_000:
                self._stable.clear()
            found = self._stable[key] = self._apart(a, b, self.never)
        return found

    def _state(self, word: str, n: int, states: list[int], ends: dict[str, int]) -> int:
        """The last token of the first n letters, given states[i], the last token of the first i letters (none: -1).

        ends: every ending of the tokens allowed here, with its id if it is itself a token, else -1.
        """
        found, start = [], n - 1
        while start >= 0:
            token = ends.get(word[start:n])
            if token is None:
                break
            if token >= 0:
                found.append((start, token))
            start -= 1
        known, size = self._stable, self.size
        for start, token in reversed(found):
            if not start:
                return token
            before = states[start]
            if before >= 0:
                ok = known.get(before * size + token)
                if self.stable(before, token) if ok is None else ok:
                    return token
        return -1

    def _extend(self, word: str, n: int, states: list[int]) -> None:
        """Append the states up to n letters: as _state for each of them, without a call for each."""
        get, known, size, stable = self.inner_ends.get, self._stable, self.size, self.stable
        for i in range(len(states), n + 1):
            found, start, state = [], i - 1, -1
            while start >= 0:
                token = get(word[start:i])
                if token is None:
                    break
                if token >= 0:
                    found.append(start)
                    found.append(token)
                start -= 1
            while found:
                token, start = found.pop(), found.pop()
                if start:
                    before = states[start]
                    if before < 0:
                        continue
                    ok = known.get(before * size + token)
                    if not (stable(before, token) if ok is None else ok):
                        continue
                state = token
                break
            states.append(state)

    def encode_sorted(self, words: list[str]):
        """Token ids of each of the sorted, distinct words: one walk of their trie."""
        before, states, state, length = "", [-1], self._state, self.length
        last, end = self.last_ends, bool(self.end)
        for word in words:
            n, shared = len(word), 0
            most = min(n, len(before), len(states) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            self._extend(word, n - end, states)
            out, i = [], n
            if end and n:
                out.append(state(word, n, states, last))
                i -= length[out[0]]
            while i > 0:
                out.append(states[i])
                i -= length[states[i]]
            if -1 in out:
                raise ValueError(f"no encoding of {word[:40]!r}")
            out.reverse()
            yield out
            before = word

    def prefix_states(self, word: str, most: int | None = None) -> tuple[list[int], list[int], list[int]]:
        """For each i: the last token of the first i letters, their tokens inside a longer word, and their tokens as a text of their own.

        most: end where no longer prefix can have that few tokens.  Every longer one has a border among
        any `longest` neighbouring places, so it has more tokens once all of those have more.
        """
        states, inner, counts, length, over = [-1], [0], [0], self.length, 0
        for i in range(1, len(word) + 1):
            states.append(self._state(word, i, states, self.inner_ends))
            inner.append(inner[i - length[states[i]]] + 1)
            if self.end:
                counts.append(inner[i - length[self._state(word, i, states, self.last_ends)]] + 1)
            else:
                counts.append(inner[i])
            if most is not None:
                over = over + 1 if inner[i] > most else 0
                if over > self.longest:
                    break
        return states, inner, counts

    def prefix_counts(self, word: str) -> list[int]:
        """counts[i]: tokens of the first i letters of the word, as a text of their own."""
        return self.prefix_states(word)[2]

    def count_changed(self, word: str, n: int, states: list[int], inner: list[int], more: str) -> int:
        """Tokens of the first n letters of the word and `more`, from the word's states: only the letters of `more` are walked."""
        begin = max(0, n - self.longest - 1)  # no token of the walk reaches a later word's begin
        tail, near, sums = word[begin:n] + more, states[begin : n + 1], inner[begin : n + 1]
        size = len(tail)
        for i in range(n - begin + 1, size + 1):
            near.append(self._state(tail, i, near, self.inner_ends))
            sums.append(sums[i - self.length[near[i]]] + 1)
        return sums[size - self.length[self._state(tail, size, near, self.last_ends)]] + 1 if self.end and size else sums[size]


class Words:
    """Encodings of the words of whole batches: each distinct word is cut and merged once and kept for later batches.

    spaced: the vocabulary keeps spaces, as the first letter of the word they stand before.
    ranks: the same vocabulary as a file of ranks; then its library merges plain words, in place of the walk.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.path = path
        self.ranked = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.bytes_of_rank = np.zeros(1 + max(table.values()), np.int64)
            self.bytes_of_rank[list(table.values())] = [len(t) for t in table]
            self.ranked = tiktoken.Encoding("ranked", pat_str=r" ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s", mergeable_ranks=table, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = Merges(path)
        self.spaced = not self.merges.end
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) + ")") if self.merges.special else None
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.known_codes = np.zeros(0, np.int64)
        self.code: dict[str, int] = {}
        self.piece: dict[str, int] = {}
        self.ids = array("i")
        self.start = array("q")
        self.length = array("q")

    def pieces(self, word: str) -> list[str | int]:
        """The word's pieces in letters of the vocabulary; a special token as its id."""
        m = PLAIN.fullmatch(word)
        if m and (self.spaced or word[0] > " "):
            first = m[2] if self.spaced else m[2].lower()
            first = first.replace(" ", LETTERS[32]) if first.isascii() else as_letters(first)
            return [LETTERS[10]] * bool(m[1]) + [first] + [m[3]] * bool(m[3])
        out: list[str | int] = []
        for part in self.special.split(word) if self.special else [word]:
            if part in self.merges.special:
                out.append(self.merges.special[part])
            elif part:
                if self.library.normalizer is not None:
                    part = self.library.normalizer.normalize_str(part)
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _entry(self, ids) -> int:
        """The place of new ids in the store."""
        self.start.append(len(self.ids))
        self.length.append(len(ids))
        self.ids.extend(ids)
        return len(self.start) - 1

    def add(self, words) -> None:
        """Encode the words that are new; a piece that stood in another word is known already."""
        new: dict[str, list] = {w: self.pieces(w) for w in words if w not in self.code}
        if not new:
            return
        gc.disable()  # hundreds of thousands of lists live until the end of this call
        distinct = sorted({p for ps in new.values() for p in ps if isinstance(p, str) and p not in self.piece})
        for p, ids in zip(distinct, self.merges.encode_sorted(distinct), strict=True):
            self.piece[p] = self._entry(ids)
        for w, ps in new.items():
            if len(ps) == 1 and isinstance(ps[0], str):
                self.code[w] = self.piece[ps[0]]
                continue
            ids = array("i")
            for p in ps:
                if isinstance(p, str):
                    at = self.start[self.piece[p]]
                    ids += self.ids[at : at + self.length[self.piece[p]]]
                else:
                    ids.append(p)
            self.code[w] = self._entry(ids)
        gc.enable()

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as places in the store, and where each text's words begin (one more than texts)."""
        if max(len(self.start), len(self.known)) > (STORE_WORDS if self.ranked is None else RANKED_WORDS) or len(self.ids) > (STORE_IDS if self.ranked is None else RANKED_IDS):
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.spaced:
            return self._spaced(texts)
        flat, ends = split_words(texts)
        return self._looked_up(flat), ends

    def _looked_up(self, flat: pa.Array) -> np.ndarray:
        """Places of words that follow a space or begin with a line end (if the vocabulary keeps spaces; else of words)."""
        at = pc.index_in(flat, value_set=self.known)
        if at.null_count:
            missing = flat.filter(at.is_null())
            new = missing.unique()
            words = pc.binary_join_element_wise(pc.if_else(pc.starts_with(new, "\n"), pa.scalar("", new.type), pa.scalar(" ", new.type)), new, pa.scalar("", new.type)) if self.spaced else new
            self.known = pa.concat_arrays([self.known, new])
            self.known_codes = np.concatenate([self.known_codes, self._added(words)])
            out = np.asarray(pc.fill_null(at, 0), np.int64)
            out[np.asarray(at.is_null())] = np.asarray(pc.index_in(missing, value_set=new), np.int64) + (len(self.known) - len(new))
            at = out
        return self.known_codes[np.asarray(at, np.int64)] if len(flat) else np.zeros(0, np.int64)

    def _added(self, words: pa.Array) -> np.ndarray:
        """Places of new, distinct words in the store; with ranks, all plain ones are merged in one call."""
        codes, ranked = np.empty(len(words), np.int64), np.zeros(len(words), bool)
        if self.ranked is not None and self.spaced:
            ranked = np.asarray(pc.match_substring_regex(words, PLAIN_BEGUN))
            plain = words.filter(pa.array(ranked))
            ids = np.array(self.ranked.encode_ordinary("".join(plain.to_pylist())), np.int32)
            # a word's tokens are those whose bytes end with its own
            ends = np.searchsorted(np.cumsum(self.bytes_of_rank[ids]), np.cumsum(np.asarray(pc.binary_length(plain), np.int64)), "left") + 1
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            codes[ranked] = len(self.start) + np.arange(len(plain))
            self.start.frombytes((starts + len(self.ids)).astype(np.int64).tobytes())
            self.length.frombytes((ends - starts).astype(np.int64).tobytes())
            self.ids.frombytes(ids.tobytes())
        rest = words.filter(pa.array(~ranked)).to_pylist()
        self.add(rest)
        # Where the vocabulary keeps spaces, self.known has them from now on; token_counts goes on with the others.
        codes[~ranked] = [self.code.pop(w) if self.spaced else self.code[w] for w in rest]
        return codes

    def _spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        uneven = np.asarray(pc.match_substring_regex(texts, UNEVEN))
        even = pc.replace_substring(texts.filter(pa.array(~uneven)), "\n", " \n")
        lists = pc.split_pattern(even, " ")
        flat, offsets = pc.list_flatten(lists), _offsets(lists)
        codes = self._looked_up(flat)
        firsts = offsets[:-1]
        if len(firsts):
            words = flat.take(pa.array(firsts)).to_pylist()
            self.add(words)
            codes[firsts] = [self.code[w] for w in words]
        if not uneven.any():
            return codes, offsets
        others = [BORDER.split(t) for t in texts.filter(pa.array(uneven)).to_pylist()]
        self.add({w for ws in others for w in ws})
        counts = np.empty(len(texts), np.int64)
        counts[~uneven], counts[uneven] = np.diff(offsets), [len(ws) for ws in others]
        ends = np.concatenate([[0], np.cumsum(counts)])
        whose = np.repeat(uneven, counts)
        out = np.empty(ends[-1], np.int64)
        out[~whose] = codes
        out[whose] = [self.code[w] for ws in others for w in ws]
        return out, ends

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word, and where each text's words begin."""
        codes, ends = self.codes(texts)
        return np.frombuffer(self.length, np.int64)[codes], ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one more than texts)."""
        codes, ends = self.codes(texts)
        start, length = np.frombuffer(self.start, np.int64)[codes], np.frombuffer(self.length, np.int64)[codes]
        after = np.cumsum(length)
        total = int(after[-1]) if len(after) else 0
        at = np.repeat(start - (after - length), length) + np.arange(total)
        return np.frombuffer(self.ids, np.int32)[at], np.concatenate([[0], after])[ends]


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where each list begins among the flattened values."""
    return np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)])


_loaded: dict[tuple, Words] = kept()


def words_of(path: str, ranks: str | None = None) -> Words:
    """One store for each vocabulary and worker."""
    if (path, ranks) not in _loaded:
        _loaded[path, ranks] = Words(path, ranks)
    return _loaded[path, ranks]


def decode_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after another, and where each id's bytes begin (one more than ids)."""
    merges = words_of(path).merges
    byte_of = {c: b for b, c in LETTERS.items()}
    texts = [b""] * merges.size
    for t, i in merges.vocab.items():
        texts[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    for t, i in merges.special.items():
        texts[i] = t.encode()
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
