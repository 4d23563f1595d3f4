"""Plain counterparts of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=True):
    text = text or ""
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER) if fold else text)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(data):
    return zlib.crc32(data)


def secrets(text):
    """The base spans of a text as (start, kind number, kind, end)."""
    text = text or ""
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password")
    names = ["password", "passwd", "secret", "token", "api_?key"]
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in names)
    assert key in either
    assign = re.compile(f"({either})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def line_dedup(docs, min_docs=5, min_chars=40):
    """(doc_id, text) pairs to (doc_id, n_lines, n_dropped, kept)."""
    holders = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            holders[line.strip(SPACES).translate(LOWER)].add(d)
    out = []
    for d, text in docs:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            k = line.strip(SPACES).translate(LOWER)
            if len(k) >= min_chars and len(holders[k]) >= min_docs and d != max(holders[k]):
                continue
            kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, k=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near(docs, percent=75):
    """(doc_id, text) pairs to doc_id -> (n_shingles, component)."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    where = defaultdict(list)
    for d in sorted(sets):
        tried = set()
        for s in sets[d]:
            for other in where[s]:
                if other not in tried:
                    tried.add(other)
                    both = len(sets[d] & sets[other])
                    if 100 * both >= percent * (len(sets[d]) + len(sets[other]) - both):
                        a, b = sorted((root(d), root(other)))
                        parent[b] = a
            where[s].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def quality(text):
    text = text or ""
    w = words(text, fold=False)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = defaultdict(int)
    for t in three:
        count[t] += 1
    inside = {i + j for i, t in enumerate(three) if count[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(w) < 50 or 100 * len(inside) > 50 * len(w),
    }


def verdicts(docs, max_docs=10):
    """(doc_id, host, text) rows to doc_id -> (n_removed, kept)."""
    key = lambda line: tuple(words(line))
    holders = defaultdict(set)
    for d, host, text in docs:
        for line in (text or "").split("\n"):
            holders[host, key(line)].add(d)
    out = {}
    for d, host, text in docs:
        removed = 0
        for line in (text or "").split("\n"):
            own = holders[host, key(line)]
            if len(own) > max_docs and d != min(own):
                removed += len(key(line))
        q = quality(text)
        out[d] = removed, not q["base_failed"] and 2 * (q["n_words"] - removed) >= q["n_words"]
    return out


def repeats(texts, length=400):
    """Texts to (n_bytes, n_removed, n_spans, bytes kept)."""
    where = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            where[b[i : i + length]] += 1
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if where[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        n_spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), n_spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out
