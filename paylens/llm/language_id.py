"""Language identification by cross-parsing entropy.

A suffix automaton of each language's sample tells how far a text can be followed as a substring of
that sample. A text is parsed into phrases, each the longest match from where the last one ended; the
language whose sample needs the fewest phrases, weighed by the bits of a pointer into it, wins. The
automata are laid out as one table, and many stretches of text walk through all of them in step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.worker import kept

#: Rows are held out where crc32(id) mod FOLDS is HELD.
FOLDS, HELD = 3, 1
#: Bounds of the sample: languages (the most frequent ones), bytes over all of them, bytes of a sampled text.
MOST_LANGUAGES, MOST_BYTES, SNIPPET = 256, 1 << 16, 128
#: Bytes that are parsed in one go; a longer text is parsed whole, stretch by stretch. Stretches that walk in step.
STRETCH, LANES = 512, 4096
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def plain(text: str) -> bytes:
    """Lower-case letters with one space between words, as UTF-8."""
    return OTHER.sub(" ", text.lower()).strip().encode()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that follows exactly the substrings of ``data`` from state 0."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """All languages' automata in one table: ``table[state + symbol]`` is the next state, doubled, plus one where a phrase begins."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.bits = np.array([np.log2(len(samples[x]) + 2) for x in self.names])
        seen = sorted(set(b"".join(samples.values())))
        #: Symbols of bytes: 0 past the end of a stretch, 1 for bytes that no sample has.
        self.symbol = np.ones(256, np.uint8)
        self.symbol[seen] = np.arange(2, len(seen) + 2)
        width, parts, self.root = len(seen) + 2, [], []
        base = 0
        for name in self.names:
            step = suffix_automaton(samples[name])
            root = base * width
            start = np.full(width, root, np.int64)
            for c, to in step[0].items():
                start[self.symbol[c]] = (base + to) * width
            t = np.tile(start * 2 + 1, (len(step), 1))
            rows = np.repeat(np.arange(1, len(step)), [len(s) for s in step[1:]])
            if len(rows):
                symbols = self.symbol[np.fromiter((c for s in step[1:] for c in s), np.int64, len(rows))]
                t[rows, symbols] = (base + np.fromiter((to for s in step[1:] for to in s.values()), np.int64, len(rows))) * width * 2
            t[:, 0] = root * 2
            parts.append(t.astype(np.int32).reshape(-1))
            self.root.append(root)
            base += len(step)
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """``(texts, languages)``: how many phrases each text needs."""
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        owner, data = [], []
        for k, t in enumerate(texts):
            for i in range(0, len(t), STRETCH):
                owner.append(k)
                data.append(t[i : i + STRETCH])
        order = np.argsort([-len(x) for x in data], kind="stable") if data else []
        for lo in range(0, len(data), LANES):  # stretches of like length go together
            rows = order[lo : lo + LANES]
            size = len(data[rows[0]])
            raw = np.frombuffer(b"".join(data[r].ljust(size, b"\0") for r in rows), np.uint8).reshape(len(rows), size)
            symbols = self.symbol[raw]
            symbols[np.arange(size) >= np.array([len(data[r]) for r in rows])[:, None]] = 0
            symbols = np.ascontiguousarray(symbols.T).astype(np.int32)
            state = np.tile(np.array(self.root, np.int32), (len(rows), 1))
            n = np.zeros(state.shape, np.int32)
            for column in symbols:
                state += column[:, None]
                found = self.table.take(state)
                n += found & 1
                state = found >> 1
            np.add.at(counts, np.array(owner)[rows], n)
        return counts

    def best(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the share of the winner when a bit more halves a language's weight."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [k for k, t in enumerate(texts) if t and self.names and has_letter(t)]
        cost = self.phrases([plain(texts[k]) for k in rows]) * self.bits
        for k, c in zip(rows, cost, strict=True):
            first = int(np.argmin(c))
            names[k], scores[k] = self.names[first], float(1 / np.exp2(np.maximum(c[first] - c, -1000.0)).sum())
        return names, scores


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A bounded sample of training text per language: snippets of texts chosen by their hash, copies once."""
    t = docs.filter(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    t = t.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    sizes = t.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).orderBy(F.col("texts").desc(), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return {}
    most = MOST_BYTES // len(sizes)
    wanted = max(1, most // SNIPPET)
    # a quarter more than wanted, because the number of texts is an estimate; few texts give longer snippets
    plan = [(r["lang"], min(1.0, 1.25 * wanted / max(1, r["texts"])), -(-most // min(wanted, max(1, r["texts"])))) for r in sizes]
    plan = docs.sparkSession.createDataFrame(plan, "lang string, bar double, size int")
    chosen = t.join(F.broadcast(plan), "lang").filter(F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("bar")).select("lang", "h", "size", "text")

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, size, text in zip(b.column("h").to_pylist(), b.column("size").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = plain(text)
                at = (h >> 30) % max(1, len(data) - size + 1)
                out.append(data[at : at + size].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(out, pa.string())], ["lang", "h", "data"])

    rows = chosen.mapInArrow(snippets, "lang string, h long, data string").groupBy("lang", "h").agg(F.min("data").alias("data"))
    found: dict[str, list[str]] = {r["lang"]: [] for r in sizes}
    for r in rows.orderBy("lang", "h").collect():  # about MOST_BYTES
        found[r["lang"]].append(r["data"])
    return {lang: data for lang, parts in found.items() if (data := " ".join(parts).encode()[:most].strip())}


def parser(model: dict[str, bytes]) -> Parser:
    return kept("language_id", tuple(sorted(model.items())), lambda: Parser(model))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``.

    Learns from rows outside the held-out fold that have a text and a language, at most ``MOST_BYTES``
    of them; a language without any letter in its sample is not learnt. A null text, or one without a
    letter, is ``und`` with score 0, and so is everything if nothing can be learnt. On a tie the first
    language by code point wins. Texts of any length are parsed whole. Rows of equal text get equal
    results; a null id counts as an empty one in the fold. An empty table gives no rows. Only the named
    columns are read, whatever others there are.
    """
    model = samples(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parser(model)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                names, scores = known.best(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
