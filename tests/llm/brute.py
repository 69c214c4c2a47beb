"""The contracts of the queries, row by row in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def url_verdict(url, rules, default="allow"):
    after = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host):])[0]
    host = host.translate(LOWER)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return (host, path, best and best[0] + best[1], best[2] if best else default)


def decontamination(docs, items):
    """{doc_id: (n_words, n_hit, n_items, items, contaminated)}"""
    windows = {}
    for item, text in items:
        words = FOLDED_WORDS.findall((text or "").translate(LOWER))
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("" if item is None else str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        words = FOLDED_WORDS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                items_of = windows.get(tuple(words[i : i + size]))
                if items_of:
                    hit |= set(range(i, i + size))
                    found |= items_of
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))),
                    bool(hit) and 20 * len(hit) >= len(words))
    return out


def fingerprint(text):
    words = SPACE_WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs, distance=4):
    """{doc_id: (fingerprint, component_id)} for distinct ids."""
    prints = {d: fingerprint(t) for d, t in docs}
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints.items():
        least[root(f)] = min(d, least.get(root(f), d))
    return {d: (f"{f:016x}", least[root(f)]) for d, f in prints.items()}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = SPACE_WORDS.findall(text)
    lines = [line for line in text.split("\n") if SPACE_WORDS.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeat), len(words) < 20 or 100 * len(repeat) > 30 * len(words))


def substrings(docs, size=50):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    words = {d: SPACE_WORDS.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(d for d in words if d is not None):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, own in words.items():
        gone = set()
        for i in range(len(own) - size + 1):
            if d is not None and first[tuple(own[i : i + size])] < d:
                gone |= set(range(i, i + size))
        out[d] = (len(own), len(gone), sha(" ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


def lines(docs, size=3):
    """{doc_id: (n_lines, n_removed, text_sha256)}"""
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        own = [] if t is None else t.split("\n")
        for i in range(len(own) - size + 1):
            first.setdefault(tuple(own[i : i + size]), (d, i))
    out = {}
    for d, t in docs:
        own = [] if t is None else t.split("\n")
        gone = set()
        for i in range(len(own) - size + 1):
            w = tuple(own[i : i + size])
            if SPACE_WORDS.search("\n".join(w)) and first[w] < (d, i):
                gone |= set(range(i, i + size))
        out[d] = (len(own), len(gone), sha("\n".join(line for i, line in enumerate(own) if i not in gone)))
    return out


def lm_base(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    tokens = {d: SPACE_WORDS.findall((t or "").translate(LOWER)) + [None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, own in tokens.items() if not held[d] for w in own)
    n, v = sum(counts.values()), len(counts)
    return {d: (held[d], len(own), sum(counts[w] > 0 for w in own), n,
                sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) for d, own in tokens.items()}
