"""Plain Python versions of the corpus operators, for small tables."""

import math
import struct
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import regex
import xxhash

SPACE = " \t\n\x0b\x0c\r"


def words(text, lower=True):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def held(doc_id, mod, rest):
    return (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0) % mod == rest


def base_rules(text):
    t = text or ""
    w = words(t, lower=False)
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    seen = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i: i + 3])] > 1 for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
            "base_failed": len(w) < 50 or 100 * len(inside) > 50 * len(w)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text, bits):
    h = [signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for t in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]+", text or "")]
    two = [signed(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42))) for a, b in pairwise(h)]
    return [x & ((1 << bits) - 1) for x in h + two]


def rule_verdicts(docs, labels, bits=16, threshold=-0.35):
    """doc_id -> (score, kept) of the quality rules."""
    good = {i for i, q in labels if q == 1}
    raw, target = Counter(), Counter()
    for i, t in docs:
        g = grams(t, bits)
        raw.update(g)
        if i in good:
            target.update(g)
    n, m, prior = sum(raw.values()), sum(target.values()), float(1 << bits)
    p = lambda b: (raw[b] + 1) / (n + prior)
    weight = lambda b: math.log((target[b] + prior * p(b)) / ((m + prior) * p(b)))
    out = {}
    for i, t in docs:
        g = grams(t, bits)
        score = sum(map(weight, g)) / len(g) if g else 0.0
        out[i] = score, not base_rules(t)["base_failed"] and score >= threshold
    return out


def dedup_lines(docs, least=50):
    """doc_id -> text without lines of runs of ``least`` words that occur earlier.  Documents in order of doc_id."""
    first, out = {}, {}
    for i, t in docs:
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(SPACE)]
        own = [lines[k].strip(SPACE) for k in at]
        gone = set()
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(words(own[b]))
                if n >= least:
                    run = tuple(own[a: b + 1])
                    if first.setdefault(run, (i, a)) != (i, a):
                        gone.update(range(a, b + 1))
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in {at[g] for g in gone})
    return out


def shingles(text, width):
    w = words(text)
    return {tuple(w[i: i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def near_components(docs, width, percent=80):
    """doc_id -> smallest doc_id reachable by links."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    having = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in having[s])
        for s in sets[i]:
            having[s].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def leaked(docs, benchmark, share=0.6):
    """doc_id -> items that have over ``share`` of their word 4-grams in the document; items under 8 words: all words in a row."""
    out = {}
    items = [(i, w) for i, t in benchmark if len(w := regex.findall(r"\w+", (t or "").lower())) >= 4]

    def holds(w, have, x):
        if len(x) < 8:
            return any(w[k: k + len(x)] == x for k in range(len(w) - len(x) + 1))
        return sum(tuple(x[k: k + 4]) in have for k in range(len(x) - 3)) >= share * (len(x) - 3)

    for d, t in docs:
        w = regex.findall(r"\w+", (t or "").lower())
        have = {tuple(w[k: k + 4]) for k in range(len(w) - 3)}
        hit = [i for i, x in items if holds(w, have, x)]
        if hit:
            out[d] = sorted(hit)
    return out
