"""Plain Python versions of the operators, for small inputs."""

import re
from hashlib import sha256

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alphanumeric(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, size):
    w = spaced((text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[i:] for i in range(size))))


def components(texts, size, threshold):
    """Smallest id of each id's component; `texts`: (id, text) rows with ids that may repeat."""
    sets = [(i, shingles(t, size)) for i, t in texts if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def hits(texts, items, span=10):
    """For each text: words, hit words, ids of items met."""
    windows = {}
    for item, text in items:
        w = alphanumeric(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, met = alphanumeric(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    met |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in met if x is not None)))
    return out


def without_repeats(texts, window):
    """For each text: words, words removed, words kept."""
    seen = {}
    split = [spaced(t) for t in texts]
    for r, w in enumerate(split):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((r, i))
    gone = {(r, i + k) for places in seen.values() if len(places) > 1 for r, i in places for k in range(window)}
    return [
        (len(w), sum((r, i) in gone for i in range(len(w))), " ".join(x for i, x in enumerate(w) if (r, i) not in gone))
        for r, w in enumerate(split)
    ]


BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def secrets(text):
    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, part, least) in enumerate(BASE)
        for m in re.finditer(pattern, text or "")
        if len(m.group(part)) >= least
    ]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def quality(text):
    """Words, characters in words, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    w = spaced(text)
    lines = [x for x in text.split("\n") if spaced(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def digest(text):
    return sha256(text.encode()).hexdigest()
