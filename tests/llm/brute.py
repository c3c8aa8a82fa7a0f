"""Plain versions of the operators' contracts, a document at a time."""

from __future__ import annotations

import hashlib
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(s: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def licenses(text):
    w = ALNUM.findall(low(text))
    places = {}
    for p, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        q = p.split()
        for i in range(len(w)):
            if w[i : i + len(q)] == q:
                places.setdefault(label, []).append(i)
    at = sorted(x for v in places.values() for x in v)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(places))


def decontaminate(texts, items, n=10):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for j in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for t in texts:
        w = ALNUM.findall(low(t))
        hit, ids = set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if (got := wins.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    ids |= got
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def substrings(texts, n=35):
    from collections import Counter

    ws = [BLANK.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in ws for i in range(len(w) - n + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def pii(text):
    out = []
    for kind, p in PII:
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def quality(text):
    t = text or ""
    w = BLANK.findall(t)
    lines = [x for x in t.split("\n") if BLANK.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    from collections import Counter

    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            rep.update((i, i + 1, i + 2))
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), failed


def unigrams(rows):
    import zlib
    from collections import Counter
    from math import log10

    toks = [BLANK.findall(low(t)) + [None] for _, t in rows]
    out_ = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(x for t, h in zip(toks, out_, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[x] > 0 for x in t), n, sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for t, h in zip(toks, out_, strict=True)]


def near(rows, k=3, percent=85):
    """(n, component id) of (id, text) rows, all pairs compared."""
    from collections import defaultdict

    sets = []
    for _, t in rows:
        w = BLANK.findall(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    both = defaultdict(int)
    for v in at.values():
        for i, a in enumerate(v):
            for b in v[i + 1 :]:
                both[a, b] += 1
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]
