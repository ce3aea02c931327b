"""Small documents with every awkward case, and brute-force answers in plain Python."""

import collections
import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, t string, path string, label string, n long, first long"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def documents(n=160, seed=5):
    """Rows of SCHEMA: nulls in every column, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeilnorstué") for _ in range(rng.randint(1, 8))) for _ in range(500)]
    passages = [" ".join(rng.choice(words) for _ in range(k)) for k in (20, 60, 75, 140)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [None, "", " \t\n", "One", "one", "a b", "x" * 5000, "Long " * 9000 + "end.", "ÉTÉ été", "éTÉ été", "a. b! c?", "1234 !!! ###"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.15:
            texts.append(rng.choice(texts))
        elif kind < 0.4:
            mine = list(base)
            for _ in range(rng.randint(0, 7)):
                mine[rng.randrange(len(mine))] = rng.choice(words)
            texts.append(" ".join(mine))
        elif kind < 0.7:
            texts.append(" ".join([rng.choice(words) for _ in range(rng.randint(1, 60))] + [rng.choice(passages)] + [rng.choice(words) for _ in range(rng.randint(0, 40))]))
        else:
            texts.append(".\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))).capitalize() for _ in range(rng.randint(1, 30))))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src1", None]), None, None, 7, "t", None, "label", 1, 2) for i, t in enumerate(texts)]
    rows += rows[20:24]  # repeated rows
    rows += [(None, texts[30], "en", "src0", 1, True, 1, "", "", "", 1, 1), (None, "only here, without an id", None, None, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def shingles(text, words=5):
    w = SPACE_WORD.findall(lowered(text))
    k = min(words, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def near_groups(rows):
    """(doc_id, smallest reachable) of rows (doc_id, text), by comparing all pairs."""
    sets = collections.defaultdict(list)
    for d, t in rows:
        if d is not None:
            sets[d].append(shingles(t))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def repeated(rows, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text)."""
    seen, split = {}, [SPACE_WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for a in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[a : a + window])
            seen[key] = min(seen.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1) if d is not None else ():
            if seen[tuple(w[a : a + window])] < d:
                gone[a : a + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def contamination(rows, items, window=13):
    """(doc_id, n_words, n_hit, names) of rows (doc_id, text) against items (item_id, text)."""
    found = collections.defaultdict(set)
    for name, text in items:
        w = ALNUM_WORD.findall(lowered(text))
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if k else ():
            found[tuple(w[i : i + k])].add(name)
    sizes = {len(k) for k in found}
    out = []
    for d, text in rows:
        w = ALNUM_WORD.findall(lowered(text))
        hit, names = [False] * len(w), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (key := tuple(w[i : i + k])) in found:
                    hit[i : i + k] = [True] * k
                    names |= {str(x) for x in found[key] if x is not None}
        out.append((d, len(w), sum(hit), tuple(sorted(names))))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)
