"""Byte-level BPE as a finite-state transducer, and streaming decoding.

A token sequence is what the merges give exactly when each neighbouring pair is what the merges
give for the pair alone, so an encoder needs to remember only where a token can still be open
and which token ended there. Those memories are the states of a nondeterministic transducer; it
is determinised while texts are read, one (state, byte) at a time, and a token is emitted as soon
as all its open continuations agree on it, at the latest one longest token further on.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paylens.llm.landing import texts
from paylens.llm.worker import kept

#: Entries of a worker's tables; a full table of transitions is dropped and grows again, the others keep two generations.
MOST_TRANSITIONS, MOST_UNITS, MOST_PIECES = 300_000, 250_000, 50_000
#: Tokens that are decoded at a time.
STREAM = 1 << 16
#: White space of Unicode, as the pattern's ``\\s`` means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts without this have units that begin at every single space or line end.
ODD_SPACE = re.compile(r"[^\S \n]|\s\s")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


class Transducer:
    """Merges compiled as far as the texts seen so far need it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, r in ranks.items():
            node = 0
            for b in t:
                step = self.next[node].get(b)
                if step is None:
                    step = self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = step
            self.ends[node] = r
        self.fits: dict[tuple[int, int], bool] = {}
        self.state: dict[tuple, dict] = {}
        self.forget()

    def forget(self) -> None:
        """A state is a table: by byte the next state and the tokens then certain, at -1 what is open in it."""
        self.fits.clear()
        for table in self.state.values():  # states point at each other: empty ones go at once, without a look through all objects
            table.clear()
        entries = ((0, -1, ()),)
        self.start = {-1: entries}
        self.state = {entries: self.start}
        self.moves = 0

    def merged(self, piece: bytes) -> list[int]:
        """The merges carried out one by one, lowest rank first; only for single tokens and pairs."""
        ranks, none = self.ranks, 1 << 62
        parts = [piece[i : i + 1] for i in range(len(piece))]
        cost = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while cost:
            least = min(cost)
            if least == none:
                break
            i = cost.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i < len(cost):
                cost[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                cost[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def follows(self, before: int, token: int) -> bool:
        key = (before, token)
        ok = self.fits.get(key)
        if ok is None:
            left = self.token[before] if before >= 0 else b""
            ok = self.fits[key] = self.merged(left + self.token[token]) == ([before, token] if before >= 0 else [token])
        return ok

    def move(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """Determinises one step: the next state and the tokens that are now certain."""
        open_, ended, following, ends = [], None, self.next, self.ends
        for node, before, pending in state[-1]:
            step = following[node].get(byte)
            if step is not None:
                token = ends[step]
                if ended is None and token >= 0 and self.follows(before, token):
                    ended = (0, token, (*pending, token))
                if following[step]:
                    open_.append((step, before, pending))
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        open_.append(ended)
        first, certain = open_[0][2], min([len(p) for _, _, p in open_])
        for _, _, p in open_:
            while p[:certain] != first[:certain]:
                certain -= 1
        after = tuple([(n, b, p[certain:]) for n, b, p in open_]) if certain else tuple(open_)
        target = self.state.get(after)
        if target is None:
            target = self.state[after] = {-1: after}
        out = state[byte] = (target, first[:certain])
        self.moves += 1
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.moves > MOST_TRANSITIONS or len(self.fits) > MOST_TRANSITIONS:
            self.forget()
        out: list[int] = []
        state = self.start
        for byte in piece:
            step = state.get(byte)
            if step is None:
                step = self.move(state, byte)
            state, certain = step
            if certain:
                out += certain
        out += state[-1][-1][2]  # the one that ended here
        return out


class Pieces(dict):
    """Ids, as packed bytes, of pieces, kept for two generations."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.encode, self.old = machine.encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if len(self) >= MOST_PIECES:
                self.old.clear()
                self.old.update(self)
                self.clear()
            found = array("i", self.encode(piece.encode())).tobytes()
        self[piece] = found
        return found


class Units(dict):
    """Ids, as packed bytes, of stretches of text that the pattern never crosses."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.machine = Transducer(load_ranks(path))
        spaced = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")
        self.pieces = regex.compile(spaced)
        size = max(self.machine.token) + 1
        self.length = np.zeros(size, np.int64)
        for r, t in self.machine.token.items():
            self.length[r] = len(t)
        self.bytes = np.frombuffer(b"".join(self.machine.token.get(r, b"") for r in range(size)), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.known, self.old = Pieces(self.machine), {}

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))

    def __missing__(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            if unit.isalpha():  # one piece
                found = array("i", self.machine.encode((" " + unit).encode())).tobytes()
            else:
                found = self.ids(unit if unit[:1] == "\n" else " " + unit)
        self[unit] = found
        return found

    def text(self, text: str) -> bytes:
        """Ids of a whole text."""
        if ODD_SPACE.search(text):
            return self.ids(text)
        if len(self) > MOST_UNITS:
            self.old.clear()
            self.old.update(self)
            self.clear()
        units = text.replace("\n", " \n").split(" ")
        first = self.ids(units[0])
        return first + b"".join(map(self.__getitem__, units[1:]))

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens."""
        n = self.length[ids]
        return self.bytes[np.arange(int(n.sum())) + np.repeat(self.start[ids] - (np.cumsum(n) - n), n)].tobytes()


class Utf8Stream:
    """Incremental UTF-8: state is how many bytes the character that is open still awaits.

    Text comes out up to the last complete character; bytes that can be part of none become U+FFFD.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def awaited(tail: bytes) -> int:
        """Bytes at the end of ``tail`` that belong to a character not complete yet."""
        need = have = 0
        for b in tail:
            if have and b & 0xC0 == 0x80:
                have += 1
            else:
                need, have = (2, 1) if 0xC2 <= b < 0xE0 else (3, 1) if 0xE0 <= b < 0xF0 else (4, 1) if 0xF0 <= b < 0xF5 else (0, 0)
            if have == need:
                need = have = 0
        return have

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.open + data
        cut = len(data) if last else len(data) - self.awaited(data[-3:].lstrip(bytes(range(0x80, 0xC0))))
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def units(path: str, pattern: str) -> Units:
    """One per worker and vocabulary, kept between tasks."""
    # the tables are many small objects that live long: looking through them all the time is not worth it
    gc.set_threshold(200_000, 50, 100)
    return kept("byte_bpe", (path, pattern), lambda: Units(path, pattern))


def decoded(known: Units, ids: np.ndarray) -> str:
    stream = Utf8Stream()
    out = [stream.feed(known.spelled(ids[i : i + STREAM])) for i in range(0, len(ids), STREAM)]
    return "".join(out) + stream.feed(b"", last=True)


def _list(parts: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` per row: the ids of each whole text, and the text that decoding the ids gives back.

    ``path`` names a file of ranks, ``pattern`` cuts a text into pieces that are encoded apart. A
    null text is empty and has no ids. Rows are encoded each for itself: repeated rows repeat, and
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [known.text(x) for x in part.column("text").to_pylist()]
                back = [decoded(known, np.frombuffer(x, np.int32)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), _list(ids), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from a column of ids; a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units(path, pattern)
        for batch in batches:
            out = [decoded(known, np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"`{ids_col}` AS ids").mapInArrow(run, "doc_id long, text string")
