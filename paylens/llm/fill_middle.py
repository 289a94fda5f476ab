"""Fill-in-the-middle forms of documents, cut by memoised content-defined chunks.

A rolling hash over the bytes cuts each text into chunks, so that a passage which many documents
share falls into the same chunks wherever it stands. A chunk's boundary summary (its words, and
whether it begins and ends inside a word) is looked up by its content: a hit is always verified,
because the content itself is the key. Summaries of a document's chunks are added up, and the sums
say in which chunk a wanted token ends; only that chunk is then searched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.scan import BYTE, BYTE_BASE, buffers, inverse, mix, powers, spans
from paylens.llm.worker import kept

#: Bytes under the rolling hash; a chunk ends where the hash has this many zero bits, within these lengths.
WINDOW, ZERO_BITS, SHORTEST, LONGEST = 16, 7, 64, 2048
#: Bytes of chunks whose summaries a worker keeps, in each of two generations.
MOST_KEPT = 16 << 20
#: The three marks; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SOLID = re.compile(rb"[^\x20\x09-\x0D]+")
CONTINUED = bytes(range(0x80, 0xC0))


def edges(data: np.ndarray) -> np.ndarray:
    """Offsets after which the rolling hash of the last ``WINDOW`` bytes says that a chunk may end."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BYTE_BASE, n), out=total[1:])
    rolling = mix((total[WINDOW:] - total[: n - WINDOW + 1]) * powers(inverse(BYTE_BASE), n - WINDOW + 1))
    return np.flatnonzero(rolling >> np.uint64(64 - ZERO_BITS) == 0) + WINDOW


def chunk_ends(marks: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of ``begin:end``, given sorted marks; every chunk but the last has an allowed length."""
    out, at, last = [], begin, len(marks)
    while end - at > SHORTEST:
        k = bisect_left(marks, at + SHORTEST)
        at = min(marks[k] if k < last else end, at + LONGEST, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def summary(chunk: bytes) -> tuple[int, bool, bool]:
    """``(words, begins inside or at a word, ends inside or at the end of a word)`` of a chunk that is not empty."""
    return len(chunk.split()), not chunk[:1].isspace(), not chunk[-1:].isspace()


class Summaries(dict):
    """Boundary summaries by content, kept for two generations."""

    def __init__(self):
        super().__init__()
        self.old: dict[bytes, tuple[int, bool, bool]] = {}
        self.bytes = 0

    def __missing__(self, chunk: bytes) -> tuple[int, bool, bool]:
        found = self.old.get(chunk)
        if found is None:
            found = summary(chunk)
        if self.bytes > MOST_KEPT:
            self.old.clear()
            self.old.update(self)
            self.clear()
            self.bytes = 0
        self[chunk] = found
        self.bytes += len(chunk)
        return found


class Cutter:
    """Token counts and token ends of one text, from its chunks' summaries."""

    def __init__(self, text: bytes, ends: list[int], known: Summaries):
        self.text, self.ends = text, ends
        self.starts = [0, *ends][:-1]
        told = [known[text[a:b]] for a, b in zip(self.starts, ends)]
        # a word that runs across a joint is counted where it ends
        joints = [x[2] and y[1] for x, y in pairwise(told)]
        self.words = list(accumulate(t[0] - j for t, j in zip(told, [*joints, False])))
        self.n = (self.words[-1] + (not told[-1][2])) if told else 0

    def after(self, tokens: int) -> int:
        """Bytes of the first ``tokens`` tokens: a token is a word with the white space before it, or what white space is left at the end."""
        if tokens == 0:
            return 0
        if tokens == self.n:
            return len(self.text)
        k = bisect_left(self.words, tokens)
        left = tokens - (self.words[k - 1] if k else 0)
        for m in SOLID.finditer(self.text, self.starts[k]):
            left -= 1
            if not left:
                return m.end()
        raise AssertionError("sums and chunks disagree")


def characters(data: bytes) -> int:
    return len(data.translate(None, CONTINUED))


def chances(id_col: str, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hash of seed and id, as numbers; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``docs``; ``n`` counts tokens.

    ``percent`` of the documents are cut in three at two tokens drawn from ``seed`` and id, and
    written as suffix, prefix, middle (``spm``, ``spm_percent`` of them) or prefix, suffix, middle
    (``psm``); the others, empty and null texts, and texts that hold one of the marks stay plain, with
    null lengths. Rows that share an id share their draws, repeated rows repeat; a null id draws
    as an empty one. Texts of any length are cut whole, one row at a time. An empty table gives no
    rows. Other columns of ``docs`` are not looked at, whatever their names.
    """
    h = chances(id_col, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = (text == "") | (h[2] % 100 >= percent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept("fill_middle", (), Summaries)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in spans(at):
                yield _forms(batch.slice(i, j - i), data, at[i : j + 1], known)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _forms(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, known: Summaries) -> pa.RecordBatch:
    whole = data[at[0] : at[-1]].tobytes()
    marks = edges(data[at[0] : at[-1]])
    n, before, between, out = [], [], [], []
    bounds = (at - at[0]).tolist()
    first = np.searchsorted(marks, at - at[0] + WINDOW).tolist()  # marks whose window lies in the text
    last = np.searchsorted(marks, at - at[0]).tolist()
    for k, (form, h1, h2) in enumerate(zip(batch.column("form").to_pylist(), batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
        a, b = bounds[k], bounds[k + 1]
        text = whole[a:b]
        own = (marks[first[k] : max(first[k], last[k + 1])] - a).tolist()
        cut = Cutter(text, chunk_ends(own, 0, b - a), known)
        n.append(cut.n)
        if form == "plain":
            before.append(None)
            between.append(None)
            out.append(text)
            continue
        lo, hi = sorted((h1 % (cut.n + 1), h2 % (cut.n + 1)))
        x, y = cut.after(lo), cut.after(hi)
        prefix, middle, suffix = text[:x], text[x:y], text[y:]
        before.append(characters(prefix))
        between.append(characters(middle))
        p, s, m = (v.encode() for v in (PREFIX, SUFFIX, MIDDLE))
        out.append(b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)))
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from output and form alone."""
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = F.when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.concat(part[1], part[3], part[2]))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(order)
