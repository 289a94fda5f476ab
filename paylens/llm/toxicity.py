"""Toxicity by weak supervision.

Words and word beginnings are mined from a bounded sample of labelled rows and put into lexicons
by kind (a word, a beginning, several words of one beginning) and strength of evidence. Each
lexicon is a voter; patterns of the text are voters too. A generative label model over all
training rows (labels unseen) estimates how often each voter fires for either class and which
voters depend on each other: given the class, votes form a tree, fitted by expectation
maximisation. Its posteriors are the labels of a linear classifier over entries and votes. Rows
mostly hold several entries, so the classifier is also shown each entry alone, with its share of
posterior toxicity; it scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.landing import landed
from paylens.llm.worker import turn

#: Rows are held out where crc32(id) mod FOLDS is HELD.
FOLDS, HELD = 3, 1
#: Bounds of the samples, as far as the caller names no others: labelled rows that lexicons are mined from, and rows that the classifier is fitted on.
MOST_LABELLED, MOST_FITTED = 20_000, 20_000
#: Least share of toxic rows, and least number, that hold an entry; entries kept, the strongest ones, as far as the caller names no other number.
LEAST_SHARE, LEAST_ROWS, MOST_ENTRIES = 0.01, 3, 256
#: Lexicons: three kinds of entries, each in so many ranks of strength.
KINDS, RANKS = 3, 4
LEXICONS = KINDS * RANKS
#: Rows by which an entry's share of toxic rows is drawn to the share of all rows.
DOUBT = 2.0
#: A document is rejected from this score on.
REJECT = 0.7
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: An entry can ask for up to so many different words with its beginning: one alone may be an innocent word.
MOST_DIFFERENT = 3
WORD = re.compile(r"[^\W\d_]{3,}")
#: Patterns that vote besides the lexicons.
PATTERNS = (re.compile(r"!{2,}"), re.compile(r"\b[A-Z]{4,}(?:\s+[A-Z]{4,})+"))
VOTERS = LEXICONS + len(PATTERNS)


def training(id_col: str) -> Column:
    """Whether a row may be learnt from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD


def entries_of(text: str) -> set[str]:
    """``beginning#k``: at least ``k`` different words of the text begin so; ``word.#1``: the word itself."""
    n: Counter = Counter()
    for w in set(WORD.findall(text.lower())):
        n[w + "."] += 1
        for size in BEGINNINGS:
            if len(w) >= size:
                n[w[:size]] += 1
    return {f"{e}#{k}" for e, many in n.items() for k in range(1, min(many, MOST_DIFFERENT) + 1)}


def lexicons(entries: list[str]) -> list[int]:
    """Lexicon of each entry, by kind and, as entries come in order of evidence, by rank within the kind."""
    kinds = [0 if e.endswith(".#1") else 1 if e.endswith("#1") else 2 for e in entries]
    size, seen, out = Counter(kinds), Counter(), []
    for k in kinds:
        out.append(k * RANKS + seen[k] * RANKS // size[k])
        seen[k] += 1
    return out


@dataclass
class Model:
    """Everything that scoring needs; entries are bounded, and in order of evidence."""

    entries: dict[str, int]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.heads = {e[:3] for e in self.entries}
        self.lexicon = lexicons(list(self.entries))
        self.asked: dict[str, list[tuple[int, int]]] = {}
        for e, i in self.entries.items():
            beginning, k = e.split("#")
            self.asked.setdefault(beginning, []).append((int(k), i))

    def found(self, text: str) -> list[int]:
        """Entries of a text, in order."""
        n: Counter = Counter()
        asked, heads = self.asked, self.heads
        for w in set(WORD.findall(text.lower())):
            if w[:3] in heads:
                for e in (w + ".", *(w[:size] for size in BEGINNINGS if len(w) >= size)):
                    if e in asked:
                        n[e] += 1
        return sorted(i for e, many in n.items() for k, i in asked[e] if many >= k)

    def votes(self, found: list[int], text: str) -> int:
        """One bit per voter that fires."""
        bits = 0
        for i in found:
            bits |= 1 << self.lexicon[i]
        for k, p in enumerate(PATTERNS):
            if p.search(text):
                bits |= 1 << (LEXICONS + k)
        return bits

    def score(self, text: str) -> float:
        found = self.found(text)
        z = self.bias + float(features([found], [self.votes(found, text)], len(self.entries))[0] @ self.weights)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def features(found: list[list[int]], votes: list[int], entries: int) -> np.ndarray:
    x = np.zeros((len(found), entries + VOTERS))
    for r, (f, v) in enumerate(zip(found, votes, strict=True)):
        x[r, f] = 1
        for k in range(VOTERS):
            x[r, entries + k] = v >> k & 1
    return x


def _entry_counts(wanted: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        n: Counter = Counter()
        for b in batches:
            for x in b.column("text").to_pylist():
                own = entries_of(x)
                n.update(own if wanted is None else own & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["entry", "n"])

    return run


def _family(text: str) -> int:
    """Smallest hash of three words in a row: mostly the same in copies and near copies, hardly ever elsewhere."""
    ws = text.split()
    return min((zlib.crc32(" ".join(ws[i : i + 3]).encode()) for i in range(max(1, len(ws) - 2))))


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn("toxicity")
    for b in batches:
        yield b.append_column("family", pa.array([_family(x) for x in b.column("text").to_pylist()], pa.int64()))


def _g2(a: int, pos: int, b: int, neg: int) -> float:
    """Log likelihood ratio of an entry in ``a`` of ``pos`` and ``b`` of ``neg`` rows."""
    total = pos + neg
    share = (a + b) / total
    out = 0.0
    for k, n in ((a, pos), (b, neg)):
        for x, p in ((k, share), (n - k, 1 - share)):
            if x:
                out += 2 * x * math.log(x / (n * p))
    return out


def _covers(kept: str, entry: str) -> bool:
    """Whether one is found wherever the other is: a narrower entry says nothing more, a wider one of less weight is less sure."""
    (a, j), (b, k) = kept.split("#"), entry.split("#")
    return b.startswith(a) and j <= k or a.startswith(b) and k <= j


def labelled(labels: DataFrame, id_col: str, label_col: str, most: int = MOST_LABELLED) -> DataFrame:
    """``(id, label)`` of a fixed sample of at most ``most`` training rows."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    return landed(known.filter(training("id")).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most), "labelled")


def mine(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, most: int = MOST_ENTRIES) -> tuple[dict[str, int], float]:
    """Lexicon entries in order of weight of evidence, and the share of toxic rows in the sample."""
    t = docs.filter(training(id_col)).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = t.join(F.broadcast(known), "id")  # a bounded number of short rows
    # copies are one witness: words that only they share would look like evidence
    rows = landed(rows.select("label", "text").mapInArrow(_families, "label int, text string, family long").groupBy("label", "family").agg(F.min("text").alias("text")), "witnesses")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    share = (pos + 0.5) / (pos + neg + 1)
    if not pos or not neg:
        return {}, share
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * pos))
    # an entry in a hundredth of the rows: at most a hundred times the entries of a mean row
    seen = rows.filter("label = 1").select("text").mapInArrow(_entry_counts(None), "entry string, n long")
    often = {r["entry"]: r["n"] for r in seen.groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()}
    against = rows.filter("label = 0").select("text").mapInArrow(_entry_counts(frozenset(often)), "entry string, n long")
    clean = {r["entry"]: r["n"] for r in against.groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    bar = 2 * math.log(max(2, len(often)))
    scored = [(_g2(a, pos, clean.get(e, 0), neg), e) for e, a in often.items() if (a + 0.5) / (pos + 1) > 8 * (clean.get(e, 0) + 0.5) / (neg + 1)]
    kept: list[str] = []
    for g, e in sorted(scored, key=lambda x: (-round(x[0], 6), -len(x[1]), x[1])):
        if g <= bar or len(kept) == most:
            break
        if not any(_covers(k, e) for k in kept):
            kept.append(e)
    return {e: i for i, e in enumerate(kept)}, share


def fit_label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of class 1 for each vote pattern ``(patterns, voters)``.

    ``counts`` are the rows of a pattern without a label, ``known`` ``(2, patterns)`` those of the
    labelled sample, whose class is not in question and keeps the classes in place. Given the class, a vote depends on one other vote at most: the tree of largest conditional
    mutual information, found anew as the classes settle.
    """
    n, k = votes.shape
    p = np.where(votes[:, :LEXICONS].any(axis=1), 0.9, 0.02)
    parent = np.full(k, -1)
    for r in range(rounds):
        w = np.stack([counts * (1 - p), counts * p]) + known  # (class, pattern)
        prior = (w.sum(axis=1) + 1) / (w.sum() + 2)
        if r in (5, 15, 30):
            parent = dependencies(votes, w)
        log = np.log(prior)[:, None] + np.zeros((2, n))
        for j in range(k):
            if parent[j] < 0:
                on = (w @ votes[:, j] + 0.1) / (w.sum(axis=1) + 0.2)
                log += np.log(np.where(votes[:, j], on[:, None], 1 - on[:, None]))
            else:
                for state in (0, 1):
                    at = votes[:, parent[j]] == state
                    on = (w[:, at] @ votes[at, j] + 0.1) / (w[:, at].sum(axis=1) + 0.2)
                    log[:, at] += np.log(np.where(votes[at, j], on[:, None], 1 - on[:, None]))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        # a text in which no voter fires carries no evidence for class 1
        new = np.where(votes.any(axis=1), new, np.minimum(new, 0.02))
        if np.abs(new - p).max() < 1e-9 and r > 30:
            break
        p = new
    return p


def dependencies(votes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Parent of each voter in the spanning tree of conditional mutual information; the first has none."""
    k = votes.shape[1]
    info = np.zeros((k, k))
    total = w.sum()
    for c in (0, 1):
        size = w[c].sum()
        if size <= 0:
            continue
        for x in (0, 1):
            for y in (0, 1):
                joint = ((votes == x) * w[c][:, None]).T @ (votes == y) / size
                left, right = ((votes == x) * w[c][:, None]).sum(axis=0) / size, ((votes == y) * w[c][:, None]).sum(axis=0) / size
                expected = np.outer(left, right)
                info += size / total * np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(expected, 1e-300)), 0)
    parent, best = np.full(k, -1), info[0].copy()
    by, inside = np.zeros(k, int), np.zeros(k, bool)
    inside[0] = True
    for _ in range(k - 1):
        j = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[j], inside[j] = by[j], True
        closer = info[j] > best
        best, by = np.where(closer, info[j], best), np.where(closer, j, by)
    return parent


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 0.1, rounds: int = 60, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's steps, halved until they help; the bias is shrunk towards the base rate."""
    x = np.c_[x, np.ones(len(x))]
    many = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    w[-1] = base = math.log((many @ p + 0.5) / (many @ (1 - p) + 0.5))
    centre = np.zeros(len(w))
    centre[-1] = base

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(many @ (np.logaddexp(0, z) - p * z) + ridge / 2 * ((v - centre) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (many * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (many * (p - q)) - ridge * (w - centre))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return w[:-1], float(w[-1])


def _vote_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        for b in batches:
            found = [(model.found(x), x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label"), pa.array([model.votes(f, x) for f, x in found], pa.int32()), pa.array([f for f, _ in found], pa.list_(pa.int32()))], ["h", "label", "votes", "found"])

    return run


def alone(x: np.ndarray, p: np.ndarray, entries: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Toxicity of a text that holds one entry and no other, and how many rows it is worth.

    It is that of the rows which hold just this entry, drawn towards that of all which hold it, and
    this towards ``share``, in each case as by ``DOUBT`` further rows.
    """
    held = x[:, :entries]
    single = held * (held.sum(axis=1) == 1)[:, None]
    n, n_single = held.sum(axis=0), single.sum(axis=0)
    any_ = (held.T @ p + DOUBT * share) / (n + DOUBT)
    return (single.T @ p + DOUBT * any_) / (n_single + DOUBT), np.minimum(n, n_single + DOUBT)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED, most_fitted: int = MOST_FITTED, most_entries: int = MOST_ENTRIES) -> Model:
    """Learns from training rows alone."""
    known = labelled(labels, id_col, label_col, most_labelled)
    entries, share = mine(docs, known, id_col, text_col, most_entries)
    model = Model(entries, np.zeros(len(entries) + VOTERS), math.log(share / (1 - share)))
    if not entries:
        return model
    train = docs.filter(training(id_col)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).cast("long").alias("id"))
    train = train.join(F.broadcast(known), "id", "left").select("text", "h", "label")
    rows = landed(train.mapInArrow(_vote_rows(model), "h long, label int, votes int, found array<int>"), "votes")
    patterns = rows.groupBy("votes").agg(*(F.count(F.when(c, 1)) for c in (F.col("label").isNull(), F.col("label") == 0, F.col("label") == 1))).orderBy("votes").collect()  # at most 2 ** VOTERS
    if not patterns:
        return model
    bits = np.array([[r["votes"] >> k & 1 for k in range(VOTERS)] for r in patterns])
    counts = np.array([r[1:] for r in patterns], float).T
    posterior = dict(zip((r["votes"] for r in patterns), fit_label_model(bits, counts[0], counts[1:]), strict=True))
    sample = rows.orderBy("h", "votes", "found").limit(most_fitted).collect()
    x = features([list(r["found"]) for r in sample], [r["votes"] for r in sample], len(entries))
    p = np.array([posterior[r["votes"]] if r["label"] is None else r["label"] for r in sample], float)  # a known label is its row's posterior
    single, many = alone(x, p, len(entries), share)
    ones = features([[i] for i in range(len(entries))], [model.votes([i], "") for i in range(len(entries))], len(entries))
    model.weights, model.bias = fit_linear(np.r_[x, ones], np.r_[p, single], weight=np.r_[np.ones(len(x)), many])
    return model


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score in ``score_col``, a name that ``docs`` must not have."""
    if score_col in docs.columns:
        raise ValueError(f"{score_col} is taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        for b in batches:
            yield b.append_column(score_col, pa.array([model.score(x or "") for x in b.column(text_col).to_pylist()], pa.float64()))

    fields = docs.withColumn(score_col, F.lit(0.0)).schema
    return docs.mapInArrow(run, fields)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED, most_fitted: int = MOST_FITTED, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    ``most_labelled`` and ``most_fitted`` bound the samples that lexicons and classifier are fitted
    on, ``most_entries`` the lexicons together; every row is scored by its whole text, however long.

    A null or empty text fires no voter and scores as the classifier's bias. Labels other than 0
    and 1 are left out; of an id with several labels the larger counts. Without toxic and clean
    training labels every score is the share of toxic ones, one half without any. Repeated rows
    score alike. An empty table gives no rows. Only the two named columns of ``docs`` are read, whatever names others have.
    """
    model = fit(docs, labels, id_col, text_col, label_col, most_labelled, most_fitted, most_entries)
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = with_scores(t, model)
    return out.select("doc_id", (~training("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
