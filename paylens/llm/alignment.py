"""Alignment of two tokenizers' tokens over the same bytes, by an associative monoid of fragments.

A fragment covers a range of bytes and holds the tokens that end in it: an open prefix up to the
first offset where tokens of both sides end, the closed groups between such offsets, and an open
suffix behind the last. Two neighbours compose in any order of brackets: the left suffix and the
right prefix make one more group. Ordinary texts are one fragment each; very long ones are cut into
cells which are tokenized apart in many tasks, and their fragments are composed in a tree of Spark
steps. Counts of linked id pairs are summed over blocks of documents, joined, and answered block by
block, so that no document's links are exploded into rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paylens.llm.landing import landed, texts, wide
from paylens.llm.worker import kept

#: Bytes of text that are aligned at a time, and bytes of text in a block of documents.
STEP, BLOCK = 1 << 20, 16 << 20
#: Texts above LONG bytes are cut into cells of about CELL characters; RANGE bytes of a cell make one fragment.
LONG, CELL, RANGE, FAN_IN = 1 << 19, 1 << 16, 1 << 13, 16
#: Neither tokenizer ever joins what stands before such a space with what follows it.
SAFE = re.compile(r"(?<=[^\s▁]) (?=[A-Za-z])")
#: Long classed characters of Unicode, on which all libraries' patterns agree; other texts go to the side's own library.
OTHER = re.compile("[^\t-\r -~\xa1-ɏ‐-‧]")
SHORT = 1 << 16
LETTER = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """Byte-level BPE of a ``tokenizers`` file; special tokens' strings are ordinary text."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocabulary.values(), *added.values()]) + 1
        self.bytes = [b""] * self.size
        for t, i in vocabulary.items():
            self.bytes[i] = t.encode() if t in added else bytes(alphabet[c] for c in t)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # ids that rise with the order of merges are ranks, and ranks can be encoded without the library's detours
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [vocabulary[a + b] for a, b in merges]
        self.quick = None
        if pattern and ids == sorted(set(ids)) and min(ids, default=256) >= 256:
            ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in added}
            self.quick = tiktoken.Encoding("side", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, cells: list[str]) -> list[list[int]]:
        out: list = [None] * len(cells)
        slow = []
        for k, c in enumerate(cells):
            if self.quick and len(c) <= SHORT and not OTHER.search(c):
                out[k] = self.quick.encode_ordinary(" " + c)
            else:
                slow.append(k)
        for k, e in zip(slow, self.library.encode_batch_fast([" " + cells[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


class PieceSide:
    """Pieces of a ``sentencepiece`` model, which puts the space in front by itself."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(LETTER, " ").encode() for i in range(self.size) for p in [self.library.id_to_piece(i)]]

    def encode(self, cells: list[str]) -> list[list[int]]:
        return self.library.encode(cells, num_threads=1) if cells else []


class Pair:
    """Both sides and what writing groups needs."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a, self.b = ByteSide(a_path, pattern), PieceSide(b_path)
        self.a_len, self.b_len = (np.array([len(x) for x in s.bytes], np.int64) for s in (self.a, self.b))
        self.kind = np.uint32 if self.a.size * self.b.size < 1 << 32 else np.uint64
        # token and what follows it: A tokens "," or "|", B tokens "," or ";" or nothing
        self.words = [f"{i}{s}" for i in range(self.a.size) for s in ",|"] + [f"{i}{s}" for i in range(self.b.size) for s in (",", ";", "")]

    def tokens(self, cells: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides per cell; None where a side's bytes are not those of the text."""
        a, b, left, right = self.a.encode(cells), self.b.encode(cells), self.a.bytes, self.b.bytes
        out = []
        for cell, x, y in zip(cells, a, b, strict=True):
            data = b" " + cell.encode()
            same = b"".join(map(left.__getitem__, x)) == data and b"".join(map(right.__getitem__, y)) == data
            out.append((x, y) if same else None)
        return out

    def groups(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """``(codes, groups, keys)`` of streams that start at offset 0 and end together.

        ``codes`` are indexes into ``words`` in the order in which groups are written, ``keys`` the
        linked pairs: one for each offset where a token of either side ends.
        """
        marks = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, np.uint8)
        marks[a_end] = 1
        marks[b_end] |= 2
        mark = marks[marks > 0]
        at_a, at_b, closed = mark & 1, mark >> 1, mark == 3
        i, j = np.cumsum(at_a, dtype=np.int64) - at_a, np.cumsum(at_b, dtype=np.int64) - at_b
        keys = b[j].astype(self.kind) * self.kind(self.a.size) + a[i].astype(self.kind)
        n_a, n_b = np.r_[0, i[closed] + 1], np.r_[0, j[closed] + 1]  # tokens before each group, and all
        codes = np.empty(len(a) + len(b), np.int64)
        a_code, b_code = a * 2, b * 3 + 2 * self.a.size
        a_code[n_a[1:] - 1] += 1
        b_code[n_b[1:] - 1] += 1
        codes[np.arange(len(a)) + np.repeat(n_b[:-1], np.diff(n_a))] = a_code
        codes[np.arange(len(b)) + np.repeat(n_a[1:], np.diff(n_b))] = b_code
        return codes, len(n_a) - 1, keys

    def written(self, codes: np.ndarray) -> str:
        """Groups as text, without the separator after the last."""
        return "".join(map(self.words.__getitem__, codes.tolist()))[:-1]


def pair(a_path: str, b_path: str, pattern: str) -> Pair:
    return kept("alignment", (a_path, b_path, pattern), lambda: Pair(a_path, b_path, pattern))


def _none(width: int = 2) -> np.ndarray:
    return np.zeros((0, width), np.int64)


@dataclass
class Fragment:
    """Tokens that end in a range of ``size`` bytes; open ones as rows ``(id, end)``, ends counted from the range's start.

    ``first`` and ``last`` are the outermost offsets where both sides end; -1, and all tokens in the
    head, where there is none.
    """

    size: int = 0
    good: bool = True
    first: int = -1
    last: int = -1
    head_a: np.ndarray = field(default_factory=_none)
    head_b: np.ndarray = field(default_factory=_none)
    tail_a: np.ndarray = field(default_factory=_none)
    tail_b: np.ndarray = field(default_factory=_none)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _closed(pair: Pair, a: np.ndarray, b: np.ndarray, start: int) -> tuple[int, int, int, str, np.ndarray]:
    """Counts, text and links of the groups of tokens that cover ``start`` to their common last end."""
    codes, n, keys = pair.groups(a[:, 0], a[:, 1] - start, b[:, 0], b[:, 1] - start)
    return len(a), len(b), n, pair.written(codes), keys.astype(np.uint64)


def _joined(*parts: tuple[int, int, int, str, np.ndarray]) -> tuple[int, int, int, str, np.ndarray]:
    return sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts), ";".join(p[3] for p in parts if p[3]), np.concatenate([p[4] for p in parts])


def _shift(rows: np.ndarray, by: int) -> np.ndarray:
    return rows + np.array([0, by])


def fragment(pair: Pair, a: np.ndarray, b: np.ndarray, size: int) -> Fragment:
    """The fragment of a range, from the tokens that end in it."""
    both = np.intersect1d(a[:, 1], b[:, 1])
    if not len(both):
        return Fragment(size, head_a=a, head_b=b)
    first, last = int(both[0]), int(both[-1])
    (head_a, in_a, tail_a), (head_b, in_b, tail_b) = ((x[x[:, 1] <= first], x[(x[:, 1] > first) & (x[:, 1] <= last)], x[x[:, 1] > last]) for x in (a, b))
    return Fragment(size, True, first, last, head_a, head_b, tail_a, tail_b, *_closed(pair, in_a, in_b, first))


def compose(pair: Pair, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges: associative, and ``Fragment()`` changes nothing."""
    size = x.size + y.size
    if not (x.good and y.good):
        return Fragment(size, good=False)
    head, tail = (_shift(y.head_a, x.size), _shift(y.head_b, x.size)), (_shift(y.tail_a, x.size), _shift(y.tail_b, x.size))
    ours, theirs = (x.n_a, x.n_b, x.n_groups, x.groups, x.links), (y.n_a, y.n_b, y.n_groups, y.groups, y.links)
    if x.first < 0:
        places = (y.first + x.size, y.last + x.size) if y.first >= 0 else (-1, -1)
        return Fragment(size, True, *places, np.r_[x.head_a, head[0]], np.r_[x.head_b, head[1]], *tail, *theirs)
    if y.first < 0:
        return Fragment(size, True, x.first, x.last, x.head_a, x.head_b, np.r_[x.tail_a, head[0]], np.r_[x.tail_b, head[1]], *ours)
    middle = _closed(pair, np.r_[x.tail_a, head[0]], np.r_[x.tail_b, head[1]], x.last)
    return Fragment(size, True, x.first, y.last + x.size, x.head_a, x.head_b, *tail, *_joined(ours, middle, theirs))


def whole(pair: Pair, x: Fragment) -> tuple[int, int, int, str, np.ndarray]:
    """Counts, groups and links of a whole text: both sides start at its start, which closes the head."""
    if not x.good or not x.size:
        return 0, 0, 0, "", np.zeros(0, np.uint64)
    return _joined(_closed(pair, x.head_a, x.head_b, 0), (x.n_a, x.n_b, x.n_groups, x.groups, x.links))


def cell_fragment(pair: Pair, cell: str, step: int = RANGE) -> Fragment:
    """The fragment of a cell, composed from those of its ranges of ``step`` bytes."""
    size = len(cell.encode()) + 1
    found = pair.tokens([cell])[0]
    if found is None:
        return Fragment(size, good=False)
    sides = [np.c_[np.array(ids, np.int64), np.cumsum(n[ids])] for ids, n in zip(found, (pair.a_len, pair.b_len), strict=True)]
    parts = []
    for lo in range(0, size, step):
        own = [_shift(x[(x[:, 1] > lo) & (x[:, 1] <= lo + step)], -lo) for x in sides]
        parts.append(fragment(pair, *own, min(step, size - lo)))
    while len(parts) > 1:
        parts = [reduce(lambda x, y: compose(pair, x, y), parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0]


def cells(text: str, size: int = CELL) -> Iterator[str]:
    """A text cut at the first safe space behind each ``size`` characters, without that space."""
    start = 0
    while True:
        cut = SAFE.search(text, start + size)
        if cut is None:
            yield text[start:]
            return
        yield text[start : cut.start()]
        start = cut.end()


ROW = "doc_id long, block long, is_block boolean, n_a long, n_b long, n_groups long, groups string, links binary, counts binary"
FRAGMENT = "uid long, seq long, size long, good boolean, first long, last long, head_a binary, head_b binary, tail_a binary, tail_b binary, n_a long, n_b long, n_groups long, groups string, links binary"
ROW_TYPES = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("is_block", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.binary()), ("counts", pa.binary())])
FRAGMENT_TYPES = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in FRAGMENT.split(", ")])


def _fragment_row(uid: int, seq: int, x: Fragment) -> tuple:
    return uid, seq, x.size, x.good, x.first, x.last, *(v.tobytes() for v in (x.head_a, x.head_b, x.tail_a, x.tail_b)), x.n_a, x.n_b, x.n_groups, x.groups, x.links.tobytes()


def _fragment_of(row: dict) -> Fragment:
    arrays = [np.frombuffer(row[c], np.int64).reshape(-1, 2) for c in ("head_a", "head_b", "tail_a", "tail_b")]
    return Fragment(row["size"], row["good"], row["first"], row["last"], *arrays, row["n_a"], row["n_b"], row["n_groups"], row["groups"], np.frombuffer(row["links"], np.uint64))


def _rows(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types) if rows else pa.RecordBatch.from_pylist([], types)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Block:
    """Pair counts of the documents that a task puts in one block."""

    def __init__(self, first: int):
        self.id, self.bytes, self.parts = first, 0, []

    def add(self, keys: np.ndarray, size: int) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.bytes += size

    def row(self) -> tuple:
        """The block's counts as a row; the next block begins."""
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        out = (None, self.id, True, 0, 0, 0, "", keys.astype(np.uint64).tobytes(), counts.astype(np.int64).tobytes())
        self.id, self.bytes, self.parts = self.id + 1, 0, []
        return out


def _together(pair: Pair, ids: list, docs: list[str], block: Block) -> pa.RecordBatch:
    """Rows of short documents, aligned in one pass over all their bytes."""
    filled = [k for k, t in enumerate(docs) if t]
    tokens = dict(zip(filled, pair.tokens([docs[k] for k in filled]), strict=True))
    good = [k for k in filled if tokens[k] is not None]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(np.array(tokens[k][side], np.int64) for k in good)]) for side in (0, 1))
    n_a, n_b = (np.array([len(tokens[k][side]) for k in good], np.int64) for side in (0, 1))
    a_end = np.cumsum(pair.a_len[a])
    codes, _, keys = pair.groups(a, a_end, b, np.cumsum(pair.b_len[b]))
    words = [pair.words[c] for c in codes.tolist()]
    closes = np.cumsum(_group_ends(pair, codes))
    to = np.cumsum(n_a + n_b)
    n_groups = np.diff(np.r_[0, closes[to - 1]]) if len(good) else np.zeros(0, np.int64)
    links_to = np.cumsum(n_a + n_b - n_groups)
    block.add(keys, len(a_end) and int(a_end[-1]))
    place = {k: x for x, k in enumerate(good)}
    rows, wide_keys = [], keys.astype(pair.kind)
    for k, i in enumerate(ids):
        x = place.get(k)
        if x is None:
            rows.append((i, block.id, False, 0, 0, 0, "", b"", None))
            continue
        lo, hi = (int(to[x - 1]), int(links_to[x - 1])) if x else (0, 0)
        rows.append((i, block.id, False, int(n_a[x]), int(n_b[x]), int(n_groups[x]), "".join(words[lo : int(to[x])])[:-1], wide_keys[hi : int(links_to[x])].tobytes(), None))
    return _rows(rows, ROW_TYPES)


def _group_ends(pair: Pair, codes: np.ndarray) -> np.ndarray:
    return (codes >= 2 * pair.a.size) & ((codes - 2 * pair.a.size) % 3 == 1)


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, cell: int = CELL) -> DataFrame:
    """Rows of documents, and one row per block of them with its pair counts, for ``link_counts``.

    A document's row has ``doc_id, n_a, n_b, n_groups, groups``: tokens of either side, and the groups
    as ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and texts whose tokens do not spell space and text
    on both sides, have no tokens: zeros and an empty ``groups``. Texts above ``long`` bytes are cut
    into cells of about ``cell`` characters that are spread over tasks. Repeated rows repeat, a null id
    stays, an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = pair(a_path, b_path, pattern), Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, values = batch.column("doc_id").to_pylist(), batch.column("text")
            lo = size = 0
            sizes = [len(v) for v in values.to_pylist()]
            for k, n in enumerate(sizes):
                size += n
                if size >= STEP or k == len(sizes) - 1:
                    yield _together(known, ids[lo : k + 1], values.slice(lo, k + 1 - lo).to_pylist(), block)
                    lo, size = k + 1, 0
                    if block.bytes > BLOCK:
                        yield _rows([block.row()], ROW_TYPES)
        if block.parts:
            yield _rows([block.row()], ROW_TYPES)

    t = texts(docs, id_col, text_col)
    out = t.filter(F.octet_length("text") <= long).mapInArrow(short, ROW)
    big = landed(t.filter(F.octet_length("text") > long).withColumn("uid", F.monotonically_increasing_id()), "long")
    if big.isEmpty():
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for seq, part in enumerate(cells(text, cell)):
                    yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), pa.array([seq], pa.int64()), pa.array([part], pa.string())], ["uid", "seq", "cell"])

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pair(a_path, b_path, pattern)
        for batch in batches:
            for uid, seq, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _rows([_fragment_row(uid, seq, cell_fragment(known, part))], FRAGMENT_TYPES)

    def composed(t: pa.Table) -> pa.Table:
        known, rows = pair(a_path, b_path, pattern), t.sort_by("seq").to_pylist()
        x = reduce(lambda x, y: compose(known, x, y), map(_fragment_of, rows))
        return pa.Table.from_batches([_rows([_fragment_row(rows[0]["uid"], rows[0]["seq"] // FAN_IN, x)], FRAGMENT_TYPES)])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pair(a_path, b_path, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                n_a, n_b, n, groups, links = whole(known, _fragment_of(row))
                block = Block((1 << 62) + row["uid"])
                block.add(links, 0)
                yield _rows([(row["doc_id"], block.id, False, n_a, n_b, n, groups, links.astype(known.kind).tobytes(), None), block.row()], ROW_TYPES)

    parts = big.select("uid", "text").mapInArrow(cut, "uid long, seq long, cell string").repartition(wide(spark), "uid", "seq")
    level = landed(parts.mapInArrow(fragments, FRAGMENT), "fragments")
    most = level.agg(F.max("seq")).first()[0]
    while True:
        level = landed(level.groupBy("uid", F.floor(F.col("seq") / FAN_IN).alias("up")).applyInArrow(composed, FRAGMENT), "composed")
        most //= FAN_IN
        if not most:
            break
    names = level.join(big.select("uid", "doc_id"), "uid")
    return out.unionByName(names.mapInArrow(finished, ROW))


def link_counts(rows: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """``aligned`` rows, written before, with ``n_links``, ``n_best`` and ``count_sum`` for each document.

    An id pair's count is the number of links of all documents that join it. ``count_sum`` adds it up
    over a document's links; ``n_best`` are its links whose count is the largest of their B id, ties
    included. Further columns of the rows stay. ``a_size`` and ``b_size`` are the sizes of the vocabularies.
    """
    kind = np.uint32 if a_size * b_size < 1 << 32 else np.uint64

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                for k in range(0, len(keys), 1 << 16):
                    part = keys[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(counts[k : k + (1 << 16)])], ["block", "key", "n"])

    pairs = rows.filter("is_block").select("block", "links", "counts").mapInArrow(opened, "block long, key long, n long")
    total = landed(pairs.groupBy("key").agg(F.sum("n").alias("count")), "pairs")
    side = F.expr(f"key div {a_size}")
    top = total.groupBy(side.alias("b")).agg(F.max("count").alias("top"))
    told = total.withColumn("b", side).join(top, "b").select("key", "count", (F.col("count") == F.col("top")).alias("best"))
    answers = pairs.select("block", "key").join(told, "key").select("block", "key", "count", "best")
    own = rows.filter("not is_block").drop("is_block", "counts")
    kept_columns = [f for f in own.schema.fields if f.name not in ("block", "links")]

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, count, best = keys[order], right.column("count").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        parts = [np.frombuffer(x, kind) for x in left.column("links").to_pylist()]
        to = np.cumsum([0, *map(len, parts)])
        at = np.searchsorted(keys, np.concatenate([np.zeros(0, kind), *parts]).astype(np.int64))
        sums, hits = (np.r_[0, np.cumsum(x[at].astype(np.int64))] if len(at) else np.zeros(1, np.int64) for x in (count, best))
        more = {"n_links": np.diff(to), "n_best": hits[to[1:]] - hits[to[:-1]], "count_sum": sums[to[1:]] - sums[to[:-1]]}
        return pa.table([*(left.column(f.name) for f in kept_columns), *(pa.array(v.astype(np.int64)) for v in more.values())], names=[*(f.name for f in kept_columns), *more])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns) + ", n_links long, n_best long, count_sum long"
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema)


def vocabulary_sizes(a_path: str, b_path: str, pattern: str) -> tuple[int, int]:
    known = Pair(a_path, b_path, pattern)
    return known.a.size, known.b.size
