"""Plain versions of the operators for small inputs: one loop after the other, no Spark."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return BLANK_WORD.findall(text or "")


def quality_base(docs):
    """doc_id -> n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = []
    for doc, text in docs:
        w, lines = words(text), [line for line in (text or "").split("\n") if words(line)]
        windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
        out.append((doc, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
                    len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    return out


def line_dedup(docs):
    found = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                found[key(line)].add(doc)
    rank = lambda doc: (doc is not None, doc or 0)
    keeper = {k: max(v, key=rank) for k, v in found.items() if len(v) >= 5}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if keeper.get(key(line), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def simhash(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(links, n):
    """A number for every row, equal within a group."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def near_roots(docs):
    prints = [simhash(text) for _, text in docs]
    return roots([(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], len(docs))


def near_groups(docs):
    groups, smallest = near_roots(docs), {}
    for g, (doc, _) in zip(groups, docs):
        if doc is not None:
            smallest[g] = min(smallest.get(g, doc), doc)
    return [(doc, f"{simhash(text):016x}", smallest.get(g)) for g, (doc, text) in zip(groups, docs)]


def jaccard_roots(docs):
    """Groups of texts that share four fifths of their five-word shingles."""
    sets = []
    for _, text in docs:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return roots([(i, j) for i in range(len(docs)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])], len(docs))


def survivors(docs, groups):
    """One row a group: that with the group's smallest id, or without any id in it; the smallest text hash of several."""
    def signed(text):
        h = xxhash.xxh64_intdigest((text or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    out = []
    for g in set(groups):
        rows = [r for r, h in zip(docs, groups) if h == g]
        name = min((d for d, _ in rows if d is not None), default=None)
        out.append(min((r for r in rows if r[0] == name), key=lambda r: signed(r[1])))
    return out


def substring_dedup(docs):
    order = lambda doc: float("inf") if doc is None else doc
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            first[k] = min(first.get(k, float("inf")), order(doc))
    out = []
    for doc, text in docs:
        w = words(text)
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < order(doc) for k in range(13)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def decontamination(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda text: pattern.findall((text or "").translate(LOWER))
    known = defaultdict(set)
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known[tuple(w[i:i + n])] |= {str(item)} if item is not None else set()
    lengths = {len(k) for k in known}
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in known:
                    hit |= set(range(i, i + n))
                    found |= known[k]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def warc(pages):
    digest = lambda html: hashlib.sha1((html or "").encode()).digest()
    import base64
    origin = {}
    for page, html in pages:
        if page is not None:
            origin[html or ""] = min(origin.get(html or "", page), page)
    return [(page, len((html or "").encode()), base64.b32encode(digest(html)).decode(),
             *(("response", None) if origin.get(html or "", page) == page else ("revisit", origin[html or ""]))) for page, html in pages]
