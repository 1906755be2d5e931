"""Frames with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import random

CLASHING = "digest row key n rank bucket before component component_id kept starts ats spans hashes words __x __id __own __digest __lost __repeat __kept __n __spans __copy __rest __key __cid c3 lang source n_chars".split()
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed: int = 4) -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, near copies, shared passages and a very long text."""
    rng = random.Random(seed)
    passage = prose(rng, 45)
    base = prose(rng, 120)
    words = base.split()
    rows: list[tuple] = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "One"),
        (6, "two words"),
        (7, base),
        (8, base),
        (8, base),
        (9, base.upper()),
        (None, base),
        (None, None),
        (10, " ".join([*words[:50], "changed", *words[51:]])),
        (11, prose(rng, 60) + "\n" + passage + " " + prose(rng, 30)),
        (12, passage + " " + prose(rng, 70)),
        (13, prose(rng, 10) + " " + passage + " " + passage),
        (14, "é ü 中文 😀 \x00 ▁ <s> &amp; ### |||" * 12),
        (15, "same line here\n" * 40),
        (16, prose(rng, 30_000, 5000)),
        (-3, prose(rng, 80)),
    ]
    rows += [(20 + k, prose(rng, rng.choice([5, 25, 90, 200]))) for k in range(25)]
    rows += [(60 + k, "tiny copy") for k in range(6)]
    return [(i, t, *("x" for _ in CLASHING)) for i, t in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_components(rows, width: int, percent: int = 80) -> dict[int, int]:
    """Smallest reachable id for every id, from all pairs."""
    sets: dict[int, set] = {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        w = (text or "").encode().lower().split()
        own = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        sets.setdefault(doc_id, own)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def removed_words(rows, window: int = 20) -> dict[int, tuple[list[bytes], list[bool]]]:
    """Words and removal flags by id; rows equal in id and text count once."""
    seen, out = set(), {}
    for doc_id, text in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            own = tuple(w[s : s + window])
            if own in seen:
                gone[s : s + window] = [True] * window
            seen.add(own)
        out[doc_id] = (w, gone)
    return out
