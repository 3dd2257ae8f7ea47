"""Plain-Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substrings(rows, length):
    """{key: (bytes, removed, runs, sha256 of the rest)} of (key, text) rows in key order."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def jaccard(rows, width, percent):
    """{key: (shingles, smallest key linked)} of (key, text) rows."""
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[key] = set() if not w else {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def licence_base(text, phrases):
    """(words, places, first, last, labels) of the base phrases in a text."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = []
    for phrase, label in phrases.items():
        own = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i:i + len(own)] == own]
    places = [i for i, _ in hits]
    return (len(w), len(hits), min(places, default=None), max(places, default=None),
            ",".join(sorted({x for _, x in hits})))


def greedy_tiles(item, text, least):
    """Words of ``item`` that greedy tiling covers: the longest free common run first, again and again."""
    a, b = [False] * len(item), [False] * len(text)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while (i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k]
                       and not a[i + k] and not b[j + k]):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return sum(a)
        a[i:i + k] = [True] * k
        b[j:j + k] = [True] * k


def top(points, queries, k):
    """{query: [(score, id), ...]} by integer products, ties to the smaller id."""
    return {q: sorted(((-sum(x * y for x, y in zip(u, v, strict=True)), i) for i, v in points.items() if i != q))[:k]
            for q, u in queries.items()}


def conversation_trie(rows, group=20, most=3):
    """Rows (conv_id, depth, parent's conv_id, members, children, leaves, saved words, sha256 of ends), sorted,
    of (conv_id, turn, role, text) rows without equal turns in a conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - int(math.fmod(c, group))
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(1 for x in below if not any(y[:len(x)] == x and len(y) > len(x) for y in below))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ranked(docs, items, k=10):
    """{item: [(doc, score), ...]} of (id, text) rows by the formula of the lexical search."""
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    bags = {d: Counter(terms(text)) for d, text in docs}
    bags = {d: b for d, b in bags.items() if b}
    all_docs, all_terms = len(bags), sum(sum(b.values()) for b in bags.values())
    df = Counter(t for b in bags.values() for t in b)
    out = {}
    for item, text in items:
        scores = []
        for d, b in bags.items():
            m = 10 + 90 * sum(b.values()) * all_docs // all_terms
            score = sum(math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                        for t in set(terms(text)) if b[t])
            if score > 0:
                scores.append((-score, d))
        out[item] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out
