"""Plain versions of what the operators compute, on small tables in one process."""

import hashlib
import math
import re
import string
import unicodedata
import zlib

import xxhash


def words10(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leaks(docs, items, size=10):
    own = [(None if i is None else str(i), words10(t)) for i, t in items]
    out = []
    for d, t in docs:
        w, hit, met = words10(t), set(), set()
        for i, x in own:
            n = min(size, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    met.add(i)
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(m for m in met if m is not None)).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(docs, percent=80):
    sets = [(d, shingles(t)) for d, t in docs]
    group = {d: d for d, _ in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    by = {}
    for d, s in sets:
        for x in s:
            by.setdefault(x, []).append((d, s))
    for found in by.values():
        d, s = found[0]
        for i, (d, s) in enumerate(found):
            for e, t in found[i + 1 :]:
                if top(d) != top(e) and 100 * len(s & t) >= percent * len(s | t):
                    a, b = sorted((top(d), top(e)))
                    group[b] = a
    return [(d, len(s), top(d)) for d, s in sets]


def kept_lines(docs, least=50):
    """docs in order; text after later copies of runs of at least so many words are gone, as the longest runs say it."""
    lines = [(t or "").split("\n") for _, t in docs]
    count = [[len(x.encode().split()) for x in d] for d in lines]
    first, gone = {}, [set() for _ in docs]
    for i, d in enumerate(lines):
        for a in range(len(d)):
            for b in range(a + 1, len(d) + 1):
                if sum(count[i][a:b]) >= least:
                    key = tuple(d[a:b])
                    if key not in first:
                        first[key] = (i, b)
                    elif first[key][0] != i or first[key][1] <= a:
                        gone[i].update(range(a, b))
    return [(k, "\n".join(x for n, x in enumerate(d) if n not in gone[i])) for i, ((k, _), d) in enumerate(zip(docs, lines, strict=True))]


def statistics(text):
    """A text's statistics, one value at a time."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars = len(words), len(t)
    share = lambda keep: sum(map(keep, t)) / max(chars, 1)
    return {
        "chars": math.log1p(chars), "word_chars": (chars - n + 1) / max(n, 1), "distinct_words": len(set(words)) / max(n, 1), "upper": share(lambda c: unicodedata.category(c) == "Lu"), "digits": share(lambda c: c in "0123456789"),
        "marks": share(lambda c: c in string.punctuation and c not in "'"), "stops": share(lambda c: c in ".,"), "exclaimed": share(lambda c: c == "!"), "line_words": n / len(t.split("\n")), "words": math.log1p(n),
    }


def rule_score(model, text):
    s = statistics(text)
    z = model.bias + sum(r.weight for r in model.rules if all(s[k] > x if above else s[k] <= x for k, above, x in r.tests))
    return 1 / (1 + math.exp(-z))


def print_of(text, least=16, normal=32, most=128, digest=6):
    """A fingerprint, byte by byte: the hash of the last 32 bytes is summed anew at each place."""
    gear = [int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:4], "big") for b in range(256)]
    data, at, covered = text.encode(), 0, {}
    while at < len(data):
        end = len(data)
        if end - at > least:
            for k in range(at + least - 1, min(at + most, len(data))):
                h = sum(gear[data[k - j]] << j for j in range(min(32, k + 1))) & 0xFFFFFFFF
                if h & ((63 if k < at + normal else 7) << 26) == 0:
                    end = k + 1
                    break
            else:
                end = min(at + most, len(data))
        d = xxhash.xxh3_64_digest(data[at:end])[:digest]
        covered[d] = covered.get(d, 0) + end - at
        at = end
    return covered


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def merkle(rows, order_of_null=""):
    """rows (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each, level by level."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(enc, r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        """(siblings before, siblings after) of each run."""
        out = []
        for level in tree[:-1]:
            run = level[i & ~1 : (i & ~1) + 2]
            out.append((run[: i & 1], run[(i & 1) + 1 :]))
            i >>= 1
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: levels([leaf(r) for r in groups[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            steps = path(trees[x], i) + path(top, k)
            other = r[:3] + (r[3] + 1,) + r[4:] if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None else r
            cur = leaf(other)
            for a, b in steps:
                cur = h(*a, cur, *b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*(s for a, b in steps for s in a + b)), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


def clusters(rows, k=8, rounds=10):
    """rows (vec_id, components): (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), all distances in every round."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else x for m, x in zip(own, c, strict=True)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, x, d in got if x == j) for j in range(len(c))]
    return [(i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got]
