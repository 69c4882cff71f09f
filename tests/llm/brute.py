"""Plain versions of what the operators compute."""

import hashlib
import re

from tokenizers import Tokenizer

from tablewright.llm.queries import vocabulary


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def tokenizer(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def decontaminated(rows, items, size=10):
    """What the contract asks of each row, by comparing each window with each place."""
    windows = []
    for item, text in items:
        v = words_of(text)
        k = min(size, len(v))
        windows += [(item, k, w) for w in {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v]
    want = []
    for d, t in rows:
        w, hit, found = words_of(t), set(), set()
        places = {}
        for k in {k for _, k, _ in windows}:
            for i in range(len(w) - k + 1):
                places.setdefault(tuple(w[i : i + k]), []).append(i)
        for item, k, win in windows:
            for i in places.get(win, ()):
                hit |= set(range(i, i + k))
                found.add(item)
        named = sorted("" if i is None else str(i) for i in found)
        want.append((d, len(w), len(hit), len(found), sha(",".join(named).encode()), bool(hit)))
    return want


def groups(rows, words, percent):
    """Set sizes and least ids of the components, row by row."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))], [find(i) for i in range(len(rows))]


MORE_SECRETS = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{10,}",
}


def more_secrets(text):
    """Base spans and those of the kinds the method adds, by start and kind."""
    found = brute_secrets(text) + [(m.start(), 3 + n, kind, m.end()) for n, (kind, pattern) in enumerate(MORE_SECRETS.items()) for m in re.finditer(pattern, text)]
    return sorted(found)


def brute_secrets(text):
    """Base spans by the contract's words."""
    flags = {"assign": re.I | re.A}
    found = []
    for n, (kind, pattern, group, least) in enumerate([("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text, flags.get(kind, 0)) if len(m[group]) >= least]
    return sorted(found)


def masked(text):
    if not text:
        return text
    out, at = "", 0
    for a, _, _, z in brute_secrets(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, z)
    return out + text[at:]
