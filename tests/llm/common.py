"""Small tables with awkward rows, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def make_docs(seed=0, n=60):
    """Prose of a small vocabulary with copies, near copies, shared passages, nulls, empty and very long texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)] + ["Der", "été", "ñandú", "don't", "x2"]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared, out = prose(30), []
    lines = [prose(8) for _ in range(4)]
    for i in range(n):
        text = "\n".join(prose(r.randint(3, 20)) for _ in range(r.randint(1, 6)))
        if i % 7 == 0:
            text += "\n" + shared + "\n" + prose(5)
        if i % 9 == 0:
            text += "\n" + "\n".join(lines)
        out.append([i * 3 + 1, text, ["en", "fr", None][i % 3], f"src{i % 5}", len(text)])
    for i in range(0, n, 5):
        w = out[i][1].split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append([1000 + i, " ".join(w), "en", "src0", 1])
        out.append([2000 + i, out[i][1], "fr", "src1", 1])
    out += [[5000, None, None, None, None], [5001, "", "en", "src1", 0], [5002, " \n\t ", "en", "src1", 4], [5003, "word", "en", "src2", 4], [5004, "two words", "de", "src2", 9], [5005, "1234 ###", "en", "", 8]]
    out += [[5006, prose(60_000), "en", "src0", 1], [5007, "word", "en", "src2", 4], [5008, "\U0001f600 a b c 漢字 ¿Qué?", "es", "src3", 9], [7000, "twice the very same row\nand again the same row\nso it is", "en", "src1", 5], [7000, "twice the very same row\nand again the same row\nso it is", "en", "src1", 5]]
    out += [[None, "a row without an id\n" + lines[0] + "\n" + lines[1] + "\n" + shared, "en", "src1", 5]]
    return [tuple(x) for x in out]


def frame(spark, rows, extra=True):
    """The rows with columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' AS row", "1 AS cls", "2 AS bucket", "'y' AS rank", "3 AS n_tokens", "4 AS Score", "'z' AS lang_pred", "5 AS __text", "6 AS n_lines", "7 AS n_removed", "8 AS gone", "9 AS _row", "'w' AS domain", "10 AS item_ids") if extra else df


def held(doc_id, k):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % k


def lower(text):
    return (text or "").encode().lower()


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def shingles(text, k):
    w = lower(text).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_copies(rows, k, percent):
    """Roots and set sizes; a row without an id is no copy of another in these tables."""
    rows, alone = [r for r in rows if r[0] is not None], [r for r in rows if r[0] is None]
    sets = [shingles(t, k) for _, t, *_ in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    roots = components({r[0] for r in rows}, links) | {r[0]: r[0] for r in alone}
    return roots, {r[0]: len(s) for r, s in zip(rows, sets)} | {r[0]: len(shingles(r[1], k)) for r in alone}


ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window=10):
    grams = {}
    for k, t in items:
        w = ITEM_WORD.findall(lower(t))
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add("null" if k is None else str(k))
    sizes = {len(g) for g in grams}
    out = []
    for d, t, *_ in rows:
        w = ITEM_WORD.findall(lower(t))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                own = grams.get(tuple(w[i : i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=str)


def line_dedup(rows, window=2, long=5):
    first, parsed = {}, []
    for d, t, *_ in rows:
        parts = (t or "").split("\n") if t is not None else []
        full = [i for i, p in enumerate(parts) if words(p)]
        runs = [(s, tuple(parts[i] for i in full[s : s + window])) for s in range(len(full) - window + 1)]
        runs += [(s, (parts[i],)) for s, i in enumerate(full) if len(words(parts[i])) >= long]
        order = (d is not None, d)
        parsed.append((order, parts, full, runs))
        for s, key in runs:
            first[key] = min(first.get(key, (order, s)), (order, s))
    out = []
    for (order, parts, full, runs), (d, t, *_) in zip(parsed, rows):
        gone = set()
        for s, key in runs:
            if (order, s) > first[key]:
                gone |= set(full[s : s + len(key)])
        out.append((d, None if t is None else "\n".join(p for i, p in enumerate(parts) if i not in gone), len(full), len(gone)))
    return sorted(out, key=str)


def substring_dedup(rows, window=13):
    first = {}
    for d, t, *_ in rows:
        w, order = words(t), (d is not None, d)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, order), order)
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d is not None, d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def counts(rows, k, out):
    c = Counter()
    for d, t, *_ in rows:
        if held(d, k) != out:
            c.update([*lower(t).split(), None])
    return c


def shares(nodes, budget):
    """{key: tokens} of nodes {key: (weight, capacity)}: close whoever holds no more than its part, until all hold more."""
    out, open_ = {}, {k: x for k, x in nodes.items() if x[0] > 0}
    while True:
        weight = sum(w for w, _ in open_.values())
        full = {k for k, (w, c) in open_.items() if c * weight <= w * budget}
        if not full:
            return out | {k: min(c, w * budget // weight) for k, (w, c) in open_.items()}
        for k in full:
            out[k] = open_[k][1]
        budget -= sum(open_.pop(k)[1] for k in full)


def mixed(rows, weights, budget_of, epochs, seed):
    """Sorted (doc_id, copies) of rows (doc_id, (domain, lang, source), tokens). weights: {leaf: a weight a level}."""
    tokens = Counter()
    for _, leaf, n in rows:
        tokens[leaf] += n
    tokens = Counter({k: n for k, n in tokens.items() if n and k in weights and min(weights[k]) > 0})
    budget = {(): min(epochs * sum(tokens.values()), budget_of(epochs * sum(tokens.values())))}
    for depth in (1, 2, 3):
        below = {}
        for node, b in budget.items():
            children = {}
            for k, n in tokens.items():
                if k[: depth - 1] == node:
                    w, c = children.get(k[:depth], (0, 0))
                    children[k[:depth]] = (max(w, weights[k][depth - 1]), c + epochs * n)
            below |= shares(children, b)
        budget = below
    out = []
    for leaf, n in tokens.items():
        whole, part = divmod(budget[leaf], n)
        own = sorted((hashlib.md5(f"{seed}:{whole}:{'null' if d is None else d}".encode()).hexdigest(), size, i) for i, (d, k, size) in enumerate(rows) if k == leaf)
        upto = 0
        for _, size, i in own:
            upto += size
            copies = whole + (upto <= part)
            if copies:
                out.append((rows[i][0], copies))
    return sorted(out, key=str)
