"""Plain versions of the operators, and rows that every operator must bear."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rnd: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and white texts, copies, near copies, repeated rows, shared passages, a very long text, no id."""
    rnd = random.Random(5)
    passage, long_ = sentence(rnd, 60), sentence(rnd, 30_000, 5_000)
    base = sentence(rnd, 100)
    near = " ".join(w if i != 50 else "other" for i, w in enumerate(base.split()))
    rows = [
        (1, None, "s1"), (2, "", "s1"), (3, " \t\n", None), (4, "a", "s2"), (5, "A b c", "s2"),
        (10, base, "s1"), (11, base, "s1"), (12, base.replace(" ", "  "), "s2"), (13, near, None), (13, near, None),
        (20, sentence(rnd, 30) + " " + passage, "s1"), (21, passage + " " + sentence(rnd, 40), "s1"), (22, passage + " " + passage, "s1"),
        (30, long_, "s3"), (31, long_ + " end", "s3"), (32, "été\r\nß\x0b漢字 😀 it's  1 2,3", "s3"), (33, "word " * 50, "S3"),
        (None, base, "s1"), (None, "no id here", None), (40, sentence(rnd, 19), ""), (41, sentence(rnd, 20), "s1"), (42, "x", None), (42, "y z", None),
    ]
    for i in range(100, 140):
        rows.append((i, sentence(rnd, rnd.randrange(5, 60)), f"s{i % 4}"))
    return rows


#: Names that operators use inside; an input may have them too.
CLASHING = ("block", "bucket", "keys", "size", "kept", "score", "id", "label", "n", "copies", "unit", "filter", "held_out", "component_id", "range", "target", "part", "k", "words")


def frame(spark, rows: list[tuple], clash: bool = True):
    df = spark.createDataFrame([(*r, *(["z"] * len(CLASHING) if clash else [])) for r in rows], "doc_id long, text string, source string" + ("".join(f", `{c}` string" for c in CLASHING) if clash else ""))
    return df.repartition(3)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def count(rows) -> dict:
    out: dict = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def smallest_reachable(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
