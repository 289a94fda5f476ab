import random
import re

import numpy as np
from plain import LOWER, WORD, count, edge_rows, frame, sentence, sha, smallest_reachable

from paylens.llm.bitmap import bitmap, bits_for, hits, id_positions
from paylens.llm.cap_filters import Code, both, cap_links, plan, tail
from paylens.llm.exact_dedup import exact_dedup
from paylens.llm.landing import landed
from paylens.llm.minhash_dedup import minhash_dedup, signatures
from paylens.llm.substring_dedup import substring_dedup


def test_exact_dedup_on_edge_rows(spark):
    rows = edge_rows()
    groups: dict = {}
    for i, text, _ in rows:
        groups.setdefault(sha(re.sub(r"[\x20\x09-\x0D]", "", text or "")), []).append((-len(text or ""), i is None, i or 0))
    want = []
    for i, text, _ in rows:
        key = sha(re.sub(r"[\x20\x09-\x0D]", "", text or ""))
        _, no_id, best = min(groups[key])
        best = None if no_id else best
        want.append((i, best, len(groups[key]), i == best, key))
    got = exact_dedup(frame(spark, rows)).drop("shuffled").collect()
    assert count(map(tuple, got)) == count(want)
    assert exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_rows_without_a_twin_are_not_shuffled(spark):
    rows = [(i, f"text {i}", "s") for i in range(2000)] + [(5000 + i, "same", "s") for i in range(300)]
    got = exact_dedup(frame(spark, rows, clash=False))
    assert got.filter("doc_id >= 5000 AND shuffled").count() == 300
    assert got.filter("doc_id < 5000 AND shuffled").count() < 20


def test_bitmap_merges_partitions_and_never_loses(spark):
    ids = landed(spark.range(0, 4000, 1, 40), "ids")
    bits = bits_for(4000)
    full = bitmap(ids, id_positions("id"), bits, "once")
    batch = ids.toArrow().to_batches()[0]
    assert hits(batch, id_positions("id"), bits, full).all()
    twice = landed(spark.range(0, 100, 1, 40).union(spark.range(0, 50, 1, 40)), "twice")
    more = bitmap(twice, id_positions("id"), bits, "more")
    told = hits(spark.range(100).coalesce(1).toArrow().to_batches()[0], id_positions("id"), bits, more)
    assert told[:50].all() and told[50:].sum() <= 2


def plain_substring(rows, window):
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    seen, out = set(), []
    for i, text, _ in order:
        ws = WORD.findall(text or "")
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            k = tuple(ws[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return out


def test_substring_dedup_on_edge_rows(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    for per_block in (8, 2048):
        got = substring_dedup(frame(spark, rows), rows_per_block=per_block).collect()
        assert count(map(tuple, got)) == count(plain_substring(rows, 20))
    assert substring_dedup(frame(spark, rows).limit(0)).count() == 0


def test_substring_rows_without_id_come_last(spark):
    text = sentence(random.Random(1), 40)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(frame(spark, [(None, text, "s"), (7, text, "s")])).collect()}
    assert got == {7: 0, None: 40}


def test_substring_small_windows(spark):
    rnd = random.Random(3)
    rows = [(i, sentence(rnd, rnd.randrange(0, 60), 4), "s") for i in range(120)]
    got = substring_dedup(frame(spark, rows), window=6, rows_per_block=16).collect()
    assert count(map(tuple, got)) == count(plain_substring(rows, 6))


def plain_sets(rows):
    out = []
    for i, text, _ in rows:
        ws = WORD.findall((text or "").translate(LOWER))
        out.append((i, frozenset(tuple(ws[p : p + 5]) for p in range(max(1, len(ws) - 4))) if ws else frozenset()))
    return out


def check_near(spark, rows):
    sets = plain_sets(rows)
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y)]
    root = smallest_reachable({i for i, _ in sets}, [(a, b) for a, b in links if a != b])
    want = [(i, len(s), root[i], root[i] == i) for i, s in sets]
    assert count(map(tuple, minhash_dedup(frame(spark, rows)).collect())) == count(want)


def test_minhash_on_edge_rows(spark):
    check_near(spark, edge_rows())
    assert minhash_dedup(frame(spark, edge_rows()).limit(0)).count() == 0


def test_minhash_chains_and_borderline_families(spark):
    rnd = random.Random(2)
    rows = []
    for f in range(6):  # families of texts at many distances from each other, some linked by chains alone
        ws = sentence(rnd, 80).split()
        for k in range(25):
            ws = list(ws)
            for _ in range(rnd.randrange(1, 3)):
                ws[rnd.randrange(len(ws))] = f"n{f}{k}{rnd.randrange(9)}"
            rows.append((1000 * f + 997 * k % 1000, " ".join(ws), "s"))
    check_near(spark, rows)


def test_signatures_agree_as_often_as_sets(spark):
    rnd = np.random.default_rng(0)
    for size in (7, 60, 3000):  # from mostly borrowed bins to mostly filled ones
        agree = []
        for _ in range(60):
            common = rnd.integers(0, 1 << 62, size).astype(np.uint64)
            extra = rnd.integers(0, 1 << 62, size // 4 + 1).astype(np.uint64)
            s = signatures([np.unique(common), np.unique(np.r_[common, extra])], 192)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - size / (size + size // 4 + 1)) < 0.06


def vectors(n=400, dim=24):
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, 120, 4):  # near, at many angles
        for j in (1, 2):
            x[i + j] = x[i] + rnd.standard_normal(dim) * rnd.uniform(0.05, 0.5)
        x[i + 3] = x[i] * 1.0
    return x


def test_cap_links_against_all_pairs(spark):
    x = vectors()
    rows = [(int(i * 3 % 1201), [float(v) for v in r]) for i, r in enumerate(x)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    ids = [r[0] for r in rows]
    near = unit @ unit.T >= 0.95
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    root = smallest_reachable(ids, links)
    want = {i: (int(near[k].sum()) - 1, root[i], root[i] == i) for k, i in enumerate(ids)}
    odd = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [None] * 24), (None, rows[0][1]), (9006, [1e300] * 24), (9007, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "z", "z", "z") for i, v in rows + odd], "vec_id long, embedding array<double>, unit string, filter string, size string").repartition(5)
    got = {r["vec_id"]: tuple(r)[1:] for r in cap_links(df).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[i] == (0, i, True) for i in (9001, 9002, 9003, 9004, 9005, None, 9006, 9007))
    assert cap_links(df.limit(0)).count() == 0


def test_cap_links_count_every_copy(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(100, [1.0, 2.0, 3.001]), (7, [1.0, 2.0, 3.0])]
    got = cap_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 52 and {tuple(r)[1:3] for r in got} == {(51, 0)}


def test_filters_are_those_above_the_threshold():
    code, rnd = Code(24, 20, 1), np.random.default_rng(1)
    x = rnd.standard_normal((30, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, name = code.list(x, 1.8)
    turned = x @ code.rotation.T
    dots = [turned[:, 12 * i : 12 * (i + 1)] @ code.words[i].T * np.sqrt(12) for i in (0, 1)]
    want = {(r, a * 20 + b) for r in range(30) for a in range(20) for b in range(20) if dots[0][r, a] + dots[1][r, b] >= 1.8}
    assert set(zip(row.tolist(), name.tolist(), strict=True)) == want


def test_plan_keeps_filters_small_at_every_size():
    for n in (1000, 10**6, 10**9):
        t, words = plan(n)
        assert n * tail(t) <= 49 and 4 * words**2 * both(t, 0.95) >= 19
