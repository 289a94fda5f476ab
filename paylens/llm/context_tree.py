"""Scoring texts by context-tree weighting over bytes.

A text is its words in lower case, a space after each, and an end mark. Every byte is eight
binary decisions; each has a Krichevsky-Trofimov estimate in the node of every context of the
last 0 to ``DEPTH`` bytes, and a node's estimate is weighted against those below it by the
evidence of the training texts, from the deepest context up. Where training never reached a
context, the deepest one that it reached is the last.

Counts are gathered per block of documents as distinct (context, byte) grams, summed in buckets
of whole subtrees below the last two context bytes, and mixed there; only the nodes of depth 0
and 1 are shared, at most 256 * 255 + 255 of them. Each gram's log probability goes back to the
blocks that hold the gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.exchange import by_block, opened, slices, squeezed, unsqueezed
from paylens.llm.landing import block_of, landed, texts, wide
from paylens.llm.scan import Words, scan

#: Context bytes (a gram and its bucket fit 64 bits up to 7). Subtrees below two bytes are whole in one bucket.
DEPTH = 5
ROWS = 4096
#: Powers of two, so that no subtree is split.
GRAM_BUCKETS = 256
WORDS, GRAMS = 0, 1
#: How counts of words and log probabilities of grams travel.
VALUE = {WORDS: np.int64, GRAMS: np.float32}
SPACE, END = 32, 10
#: The end mark as a token.
END_KEY = np.uint64(0xE0D)
SENT = "kind int, bucket long, block long, keys binary, counts binary"


def _root(two: np.ndarray) -> np.ndarray:
    """A permutation of 16-bit numbers that spreads common contexts over the buckets."""
    two = ((two ^ (two >> np.uint64(7))) * np.uint64(0x9E3B)) & np.uint64(0xFFFF)
    return two ^ (two >> np.uint64(9))


def grams(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, text of each)`` for every byte of the texts: context from the nearest byte on, then the byte, from the top bit down."""
    size = w.end - w.start
    before = np.cumsum(size) - size
    total, n_doc = int(size.sum()), len(w.first) - 1
    stream = np.full(total + len(size) + (depth + 1) * n_doc, SPACE, np.uint8)
    doc = w.doc()
    at = np.arange(total)
    stream[at + np.repeat(np.arange(len(size)) + (depth + 1) * doc + depth, size)] = w.data[at + np.repeat(w.start - before, size)]
    letters = np.r_[0, np.cumsum(size)][w.first]  # letters before each text
    begin = letters + w.first + (depth + 1) * np.arange(n_doc + 1)  # each text: lead-in, words, end
    lead = (begin[:-1, None] + np.arange(depth)[None, :]).reshape(-1)
    stream[lead] = END
    stream[begin[1:] - 1] = END
    x = stream.astype(np.uint64)
    n = len(x)
    key = np.zeros(n, np.uint64)
    if n > depth:
        key[depth:] = _root((x[depth - 1 : n - 1] << np.uint64(8)) | x[depth - 2 : n - 2]) << np.uint64(48)
        for j in range(2, depth):
            key[depth:] |= x[depth - 1 - j : n - 1 - j] << np.uint64(56 - 8 * j)
        key[depth:] |= x[depth:] << np.uint64(56 - 8 * depth)
    own = np.ones(n, bool)
    own[lead] = False
    return key[own], np.repeat(np.arange(n_doc), np.diff(begin) - depth)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, text of each)``: every word, then the end marks of all texts."""
    n = len(w.first) - 1
    return np.r_[w.hashes(), np.full(n, END_KEY)], np.r_[w.doc(), np.arange(n)]


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their weights."""
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weight, at) if len(at) else weight


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is in training."""
    seen, n = np.unique(keys[train], return_counts=True)
    held = np.unique(keys[~train])
    return (seen, n) if not len(held) else _counted(np.r_[seen, held], np.r_[n, np.zeros(len(held), np.int64)])


def _gather(depth: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in by_block(batch):
                train = ~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                found = {WORDS: [], GRAMS: []}
                for i, j, w in scan(rows.column("text"), lower=True):
                    for kind, (keys, doc) in ((WORDS, tokens(w)), (GRAMS, grams(w, depth))):
                        found[kind].append(_distinct(keys, train[i:j][doc]))
                for kind, n in ((WORDS, buckets), (GRAMS, GRAM_BUCKETS)):
                    keys, counts = _counted(*(np.concatenate(x) for x in zip(*found[kind], strict=True)))
                    parts = list(slices(keys, n))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(parts), pa.int32()),
                            pa.array([b for b, _ in parts], pa.int64()),
                            pa.array([block] * len(parts), pa.int64()),
                            squeezed([keys[s] for _, s in parts]),
                            squeezed([counts[s].astype(np.int64) for _, s in parts]),
                        ],
                        ["kind", "bucket", "block", "keys", "counts"],
                    )

    return run


def _totals(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _counted(unsqueezed(t.column("keys")), unsqueezed(t.column("counts"), np.int64))


def _answers(t: pa.Table, keys: np.ndarray, values: np.ndarray) -> pa.Table:
    """The value of each key sent, to the block that sent it."""
    out = [values[np.searchsorted(keys, opened(x))] for x in t.column("keys").to_pylist()]
    return pa.table({"block": t.column("block"), "kind": t.column("kind"), "keys": t.column("keys"), "values": squeezed(out)})


def _vocabulary(t: pa.Table) -> pa.Table:
    counts = _totals(t)[1]
    return pa.table({"n": pa.array([int(counts.sum())]), "v": pa.array([int((counts > 0).sum())])})


def _frequencies(t: pa.Table) -> pa.Table:
    keys, counts = _totals(t)
    return _answers(t, keys, counts.astype(VALUE[WORDS]))


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for ``x >= 0.5``, by Stirling's series shifted by seven."""
    y = x + 7
    z = 1 / y
    series = z / 12 - z**3 / 360 + z**5 / 1260
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(x * (x + 1) * (x + 2)) - np.log((x + 3) * (x + 4) * (x + 5) * (x + 6))


def evidence(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def weigh(log_e: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted log probability and the weight of its own estimate."""
    return np.log(0.5) + np.logaddexp(log_e, below), 1 / (1 + np.exp(np.clip(below - log_e, -700, 700)))


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each of the eight bits: ``(node of depth 2 of each gram's bit, its root, prefix, zeros, ones, log weight), probability of a one down to depth 2 of each gram, bit``."""
    byte = ((keys >> np.uint64(56 - 8 * depth)) & np.uint64(255)).astype(np.int64)
    for k in range(8):
        prefix, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
        node = ((keys >> np.uint64(64 - 8 * depth)) << np.uint64(8)) | prefix.astype(np.uint64)
        # grams are sorted, so their deepest nodes are too
        at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        of = np.cumsum(np.r_[True, node[1:] != node[:-1]]) - 1
        ids, ones = node[at], np.add.reduceat(counts * bit, at).astype(float)
        zeros = np.add.reduceat(counts * (1 - bit), at).astype(float)
        log_w = evidence(zeros, ones)
        p, leaf = (ones + 0.5) / (zeros + ones + 1), np.arange(len(ids))
        seen = zeros + ones > 0
        for d in range(depth - 1, 1, -1):
            up = ((ids >> np.uint64(16)) << np.uint64(8)) | (ids & np.uint64(255))
            ids, parent = np.unique(up, return_inverse=True)
            zeros, ones, below = (np.bincount(parent, x, len(ids)) for x in (zeros, ones, log_w))
            log_w, own = weigh(evidence(zeros, ones), below)
            kt = (ones + 0.5) / (zeros + ones + 1)
            leaf = parent[leaf]
            p = np.where(seen, own[leaf] * kt[leaf] + (1 - own[leaf]) * p, kt[leaf])
            seen = (zeros + ones)[leaf] > 0
        yield ids, zeros, ones, log_w, p[of], seen[of], prefix, bit


def _last(ids: np.ndarray) -> np.ndarray:
    """The nearest context byte of nodes of depth 2."""
    return UNROOT[(ids >> np.uint64(8)).astype(np.int64)] >> 8


UNROOT = np.argsort(_root(np.arange(1 << 16, dtype=np.uint64)))


def _nodes(depth: int):
    def run(t: pa.Table) -> pa.Table:
        out = []
        for ids, zeros, ones, log_w, *_ in subtrees(*_totals(t), depth):
            where, of = np.unique(_last(ids) * 256 + (ids & np.uint64(255)).astype(np.int64), return_inverse=True)
            out.append((where, *(np.bincount(of, x) for x in (zeros, ones, log_w))))
        node, zeros, ones, log_w = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"node": pa.array(node, pa.int64()), "zeros": pa.array(zeros), "ones": pa.array(ones), "log_w": pa.array(log_w)})

    return run


def top(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    """Own weight and estimate of the nodes of depth 1, ``(256, 256)``, and of depth 0, ``(256,)``."""
    log_w, own = weigh(evidence(zeros, ones), below)
    log_w = np.where(zeros + ones > 0, log_w, 0.0)
    z, o = zeros.sum(axis=0), ones.sum(axis=0)
    _, own0 = weigh(evidence(z, o), log_w.sum(axis=0))
    return own, (ones + 0.5) / (zeros + ones + 1), zeros + ones > 0, own0, (o + 0.5) / (z + o + 1)


def _priced(depth: int, shared):
    def run(t: pa.Table) -> pa.Table:
        own1, kt1, seen1, own0, kt0 = shared.value
        keys, counts = _totals(t)
        last = UNROOT[(keys >> np.uint64(48)).astype(np.int64)] >> 8
        total = np.zeros(len(keys))
        for *_, p, seen, prefix, bit in subtrees(keys, counts, depth):
            w = own1[last, prefix]
            p = np.where(seen, w * kt1[last, prefix] + (1 - w) * p, kt1[last, prefix])
            p = np.where(seen1[last, prefix], own0[prefix] * kt0[prefix] + (1 - own0[prefix]) * p, kt0[prefix])
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return _answers(t, keys, total.astype(VALUE[GRAMS]))

    return run


class Table:
    """Values by 64-bit key, open addressing; every key looked up is there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = keys, values
        self.slot = np.full(1 << self.bits, -1, np.int64)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.key_at = np.where(self.slot >= 0, keys[np.maximum(self.slot, 0)], 0) if len(keys) else np.zeros(1 << self.bits, np.uint64)
        self.value_at = values[np.maximum(self.slot, 0)] if len(keys) else np.zeros(1 << self.bits)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.value_at[at]
        wrong = np.flatnonzero(self.key_at[at] != keys)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            ok = self.key_at[at] == keys[wrong]
            out[wrong[ok]] = self.value_at[at[ok]]
            wrong, at = wrong[~ok], at[~ok]
        return out


def _score(depth: int, n: int, v: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers.column("kind").to_numpy()
        known = {}
        for k in (WORDS, GRAMS):
            mine = answers.filter(pa.array(kind == k))
            keys, at = np.unique(unsqueezed(mine.column("keys")), return_index=True)
            known[k] = Table(keys, unsqueezed(mine.column("values"), VALUE[k])[at].astype(np.float64))
        out = []
        for i, j, w in scan(docs.column("text"), lower=True):
            keys, doc = tokens(w)
            c = known[WORDS][keys]
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            keys, owner = grams(w, depth)
            out.append((np.bincount(doc, minlength=j - i), np.bincount(doc, c > 0, j - i), np.bincount(doc, base, j - i), np.bincount(owner, known[GRAMS][keys], j - i)))
        n_tokens, n_known, base, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0),) * 4
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(n_tokens.astype(np.int64)),
                "n_known": pa.array(n_known.astype(np.int64)),
                "train_tokens": pa.array(np.full(docs.num_rows, n, np.int64)),
                "base_score": pa.array(base.astype(float)),
                "score": pa.array(score.astype(float)),
            }
        )

    return run


def context_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, depth: int = DEPTH, rows_per_block: int = ROWS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Learns from rows whose ``crc32(id) mod folds`` is not ``held``; a null id counts as an empty
    one. ``score`` is the log10 probability of the text's lower-cased words and end under the
    tree, ``base_score`` under smoothed counts of single tokens. A null or empty text is its end
    alone. Repeated rows are counted and scored each. An empty table gives no rows; without
    training rows every estimate is even.
    """
    spark = docs.sparkSession
    if not 3 <= depth <= 6:
        raise ValueError("depth must be 3 to 6")
    t = texts(docs, id_col, text_col)
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    t = t.withColumn("held_out", remainder == held).withColumn("block", block_of(rows_per_block))
    sent = landed(t.mapInArrow(_gather(depth, wide(spark)), SENT), "sent")
    words, found = sent.filter(F.col("kind") == WORDS), sent.filter(F.col("kind") == GRAMS)
    size = words.groupBy("bucket").applyInArrow(_vocabulary, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    nodes = found.groupBy("bucket").applyInArrow(_nodes(depth), "node long, zeros double, ones double, log_w double")
    upper = np.zeros((3, 256 * 256))
    for r in nodes.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("log_w")).collect():  # at most 256 * 255
        upper[:, r[0]] = r[1:]
    shared = spark.sparkContext.broadcast(top(*upper.reshape(3, 256, 256)))
    kinds = "block long, kind int, keys binary, values binary"
    answers = words.groupBy("bucket").applyInArrow(_frequencies, kinds).unionByName(found.groupBy("bucket").applyInArrow(_priced(depth, shared), kinds))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return t.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(depth, size["n"] or 0, size["v"] or 0), schema)
