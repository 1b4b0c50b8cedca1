"""Plain loops for the contracts of the text queries, over (doc_id, text) rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import re
import zlib
from itertools import permutations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall(text or "")


def exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, t), n in zip(rows, norm):
        groups[n].append((-len(t or ""), i))
    return [
        (i, min(groups[n])[1], len(groups[n]), i == min(groups[n])[1], hashlib.sha256(n.encode()).hexdigest())
        for (i, _), n in zip(rows, norm)
    ]


def stats(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def fingerprint(text, size=3):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def components(rows, radius=3):
    """doc_id to (fingerprint, smallest doc_id reachable)."""
    fp = {i: fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    all_ = np.array([fp[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(all_[k + 1 :] ^ all_[k]) <= radius):
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def without_repeats(rows, window=35):
    """(doc_id, n_words, n_removed, kept words) per row."""
    all_ = [words(t) for _, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in all_ for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, all_):
        gone = set()
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out


def profile_distance(text, profiles, size):
    """Out-of-place distances by plain counting."""
    chars = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    count = collections.Counter()
    padded = " " + chars + " "
    for k, c in enumerate(padded):
        if c != " ":
            count[c] += 1
        two, three = padded[k : k + 2], padded[k : k + 3]
        if len(two) == 2 and two != "  ":
            count[two] += 1
        if len(three) == 3 and three[1] != " ":
            count[three] += 1
    mine = sorted(count, key=lambda g: (-count[g], gram_number(g)))[:size]
    return {
        lang: sum(abs(r - ranked.index(gram_number(g))) if gram_number(g) in ranked else size for r, g in enumerate(mine))
        for lang, ranked in profiles.items()
    }, len(mine)


def gram_number(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def archive(rows):
    """(page_id, bytes, digest, type, refers_to) per (page_id, html)."""
    raw = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in raw:
        first[p] = min(i, first.get(p, i))
    return [
        (i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first[p] else "revisit", None if i == first[p] else first[p])
        for i, p in raw
    ]


def crc(text):
    return zlib.crc32((text or "").encode())


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text, size):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, size + 1) for i in range(len(w) - n + 1)]


def importance(rows, target, size=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(doc_id, n_words, n_features, weight, score, rank) per row; ids are distinct."""
    hashed = lambda g: zlib.crc32(g.encode()) % buckets
    found = [(i, *grams(t, size)) for i, t in rows]
    s, t = collections.Counter(), collections.Counter()
    for _, _, gs in found:
        s.update(map(hashed, gs))
    for text in target:
        t.update(map(hashed, grams(text, size)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(all_s + buckets) / ((s[b] + 1) * float(all_t + buckets)))) for b in range(buckets)]
    scored = []
    for i, n, gs in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[hashed(g)] for g in gs)
        scored.append((i, n, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return [(*r, rank.get(r[0])) for r in scored]


def fails(text):
    """The filters A to D that a text fails."""
    text = text or ""
    w = words(text)
    return (
        len(w) < 50,
        100 * len(set(w)) < 65 * len(w),
        100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        re.search(r"[#$%&*|]", text) is not None,
    )


def audit(rows, labels):
    """Reports by applying every order of the filters; rows are (doc_id, text, source)."""
    bad = []
    for i, text, source in rows:
        late = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, _ in rows)
        good = any(k == i and q == 1 for k, q, _ in labels if i is not None)
        toxic = any(k == i and x == 1 for k, _, x in labels if i is not None)
        bad.append((source or "", (*fails(text), late), good, toxic))
    out, total = {}, collections.Counter()
    for part in {b[0] for b in bad}:
        mine = [b[1:] for b in bad if b[0] == part]
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [b for b in left if b[0][f]]
                left = [b for b in left if not b[0][f]]
                total[part, f] += len(gone)
                failing = sum(b[0][f] for b in mine)
                out[part, "".join("ABCDE"[x] for x in order), step] = (
                    len(left), len(gone), failing - len(gone), sum(b[0][f] and sum(b[0]) == 1 for b in mine),
                    sum(b[1] for b in gone), sum(b[2] for b in gone),
                )
    return {(*k, *v, total[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def strict_spans(text):
    """(kind, start, stop) of the base patterns, as they are written down."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
