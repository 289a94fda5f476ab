"""Token ids in files: one shared frequency table, segments of independently coded blocks.

Documents are encoded where they are read, dealt out by ranges of their id and sorted there.
One table of frequencies over the whole corpus codes all segments. A segment is a self-contained
run of bytes:

    magic, documents, ids, blocks, checksum of the table
    per document: id, has an id, number of ids
    per block, the checkpoints: first word (and one past the last), checksum, the lanes' states
    words

Segments are the rows of a written table, one or more per range, so any file system that Spark
knows can hold them, and each can be read, and each block in it decoded, alone.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from paylens.llm import rans
from paylens.llm.exchange import unpacked
from paylens.llm.landing import landed, texts, wide
from paylens.llm.worker import give_back, kept
from paylens.session import ensure_checkpoint_dir

END_ID = 1
#: Bytes of text for each range of ids, at most so many ranges, and ids of a segment.
BYTES_PER_RANGE, MOST_RANGES, SEGMENT_IDS = 8 << 20, 1 << 14, 4 << 20
#: Words that a worker remembers between portions of text, and about how many bytes and rows make a portion.
MOST_WORDS, PORTION_BYTES, PORTION_ROWS = 500_000, 4 << 20, 1 << 16
MAGIC = b"PLR1"
HEAD = struct.Struct("<4sIQII")
#: Marks at the end of a word, after a letter, are always a piece of their own.
MARKED = r"(?s)^(?P<core>.*[a-zß-öø-ÿ])(?P<marks>[!-/:-@\[-`{-~]+)$"
#: Words that no normaliser changes and no pattern cuts: lower-case letters that are one code point each.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def spread(flat: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of ``flat``, which are ``size`` long, in the order asked for, and where each of them ends."""
    first, n = np.cumsum(size) - size, size[entry]
    after = np.cumsum(n)
    total = int(after[-1]) if len(after) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((first[entry] - (after - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return flat[at], after


class Words:
    """Ids of words cut at ASCII white space, which the tokenizer drops and never crosses."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or not t.special for t in added):
            raise ValueError("added tokens are looked for in the text as it stands")
        #: Texts that hold one go to the library whole; in a word they come from lower-casing and are ordinary text.
        self.added = [t.content.encode() for t in added]
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        # words asked for before, their ids one after another, how many each has and in which portion it came last
        self.words, self.ids, self.size, self.used, self.portion = pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        # the library's model alone is enough for a plain word, if its letters are spelt as bytes
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.model = self.tokenizer.model
        self.direct = all(self.of_model(w) == self.of_text(w) for w in ("a", "word", "straße", "éàÿ", "unbelievably", "don"))

    def of_model(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.spelling))]

    def of_text(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    kind = np.uint16

    def whole(self, text: str) -> bytes:
        """The library's plain call, added tokens included."""
        self.tokenizer.encode_special_tokens = False
        try:
            return array("H", self.of_text(text)).tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def places(self, asked: pa.Array) -> np.ndarray:
        """Where different words stand among those that are remembered; the library is asked for the others."""
        self.portion += 1
        if len(self.words) > MOST_WORDS:  # the half that came last stays
            keep = self.used > np.median(self.used)
            self.ids, _ = spread(self.ids, self.size, np.flatnonzero(keep))
            self.words, self.size, self.used = self.words.filter(pa.array(keep)), self.size[keep], self.used[keep]
        at = pc.index_in(asked, value_set=self.words)
        ids, size = array("H"), []
        new = asked.filter(at.is_null())
        for word in new.to_pylist():
            found = self.of_model(word) if self.direct and PLAIN.fullmatch(word) else self.of_text(word)
            ids.extend(found)
            size.append(len(found))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        self.ids, self.size = np.r_[self.ids, np.array(ids, self.kind)], np.r_[self.size, np.array(size, np.int64)]
        self.used = np.r_[self.used, np.zeros(len(new), np.int64)]
        self.used[at] = self.portion
        return at

    def text(self, text: bytes) -> bytes:
        return self.texts(pa.array([text.decode()]))[0]

    def texts(self, texts: pa.Array, end: bytes = b"") -> list[bytes]:
        """Packed ids of each text, ``end`` behind them. A different word is looked up once, whatever the number of its places."""
        apart = np.zeros(len(texts), bool)
        for t in self.added:
            apart |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        whole = [self.whole(t) + end for t in texts.filter(pa.array(apart)).to_pylist()]
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(apart), "", texts)))
        found = cut.flatten().dictionary_encode()
        different = found.dictionary.cast(pa.string())
        marked = pc.extract_regex(different, MARKED)
        core, marks = (pc.if_else(marked.is_valid(), pc.struct_field(marked, c), other) for c, other in (("core", different), ("marks", "")))
        parts = pa.concat_arrays([core, marks]).dictionary_encode()
        at = self.places(parts.dictionary)[parts.indices.to_numpy()]
        # a different word has the ids of its core, then of its marks; then come the end and the texts that went to the library whole
        ids, after = spread(self.ids, self.size, at.reshape(2, -1).T.reshape(-1))
        rest = [end, *whole]
        size = np.r_[np.diff(after[1::2], prepend=0), [len(x) // ids.itemsize for x in rest]]
        ids = np.r_[ids, np.frombuffer(b"".join(rest), self.kind)]
        last = np.full(len(texts), len(different))
        last[apart] += 1 + np.arange(len(whole))
        stop = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False), dtype=np.int64)
        ids, after = spread(ids, size, np.insert(found.indices.to_numpy(), stop, last))
        data, stops = ids.tobytes(), (after[stop + np.arange(len(stop))] * ids.itemsize).tolist()
        return [data[i:j] for i, j in zip([0, *stops][:-1], stops, strict=True)]


def words(path: str) -> Words:
    """One per worker and vocabulary, kept between tasks."""
    return kept("token_files", (path,), lambda: Words(path))


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``PORTION_BYTES`` of text."""

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    held, sofar, rows = [], 0, 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = min(batch.num_rows, lo + PORTION_ROWS - rows, int(np.searchsorted(ends, before + PORTION_BYTES - sofar)) + 1)
            held.append(batch.slice(lo, hi - lo))
            sofar, rows, lo = sofar + int(ends[hi - 1]) - before, rows + hi - lo, hi
            if sofar >= PORTION_BYTES or rows >= PORTION_ROWS:
                yield from joined(held)
                held, sofar, rows = [], 0, 0
    if held:
        yield from joined(held)


def _tokenised(path: str, bounds: np.ndarray, end_id: int):
    """Packed ids of the documents of each range, one row per portion and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        end = np.array([end_id], known.kind).tobytes()
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in portions(batches):
            ids = part.column("doc_id")
            has = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            where = np.where(has, np.searchsorted(bounds, doc, side="right"), len(bounds) + 1)
            # the order among rows without an id, or of one id, is that of a hash of the text
            tie = part.column("tie").to_numpy()
            coded = known.texts(part.column("text"), end)
            for r in np.unique(where):
                rows = np.flatnonzero(where == r)
                body = [coded[i] for i in rows]
                size = np.array([len(b) // known.kind().itemsize for b in body], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(r)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (doc[rows], has[rows], tie[rows], size)), pa.array([pack(b"".join(body))], pa.binary())],
                    ["range", "docs", "has", "ties", "sizes", "ids"],
                )
        give_back()  # the next step sorts whole ranges in this worker

    return run


RANGE = "range long, docs binary, has binary, ties binary, sizes binary, ids binary"


def _in_order(t: pa.Table) -> pa.Table:
    """All documents of a range, by id, in one row."""
    open_ = zstandard.ZstdDecompressor().decompress
    doc, has, tie, size = (unpacked(t.column(c), k)[0] for c, k in (("docs", np.int64), ("has", bool), ("ties", np.int64), ("sizes", np.int64)))
    ids = np.frombuffer(b"".join(open_(x) for x in t.column("ids").to_pylist()), Words.kind)
    first = np.cumsum(size) - size
    order = np.lexsort((tie, doc, ~has))
    at = np.cumsum(size[order]) - size[order]
    ids = ids[np.arange(len(ids)) + np.repeat(first[order] - at, size[order])]
    packed = (x[order].tobytes() for x in (doc, has, tie, size))
    return pa.table({"range": t.column("range")[:1].combine_chunks(), **{c: pa.array([x], pa.binary()) for c, x in zip(("docs", "has", "ties", "sizes"), packed, strict=True)}, "ids": pa.array([zstandard.ZstdCompressor(level=3).compress(ids.tobytes())], pa.binary())})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for x in b.column("ids").to_pylist():
            n = np.bincount(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), Words.kind))
            if len(n) > len(total):
                total, n = n, total
            total[: len(n)] += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def segment(doc: np.ndarray, has: np.ndarray, size: np.ndarray, ids: np.ndarray, freq: np.ndarray, end_id: int = END_ID) -> bytes:
    """The bytes of one segment."""
    states, run, first = rans.encode(ids.astype(np.int64), freq, end_id)
    head = HEAD.pack(MAGIC, len(doc), len(ids), len(states), zlib.crc32(freq.tobytes()))
    parts = (doc.astype("<i8"), has.astype("u1"), size.astype("<u4"), first.astype("<u8"), rans.checksums(states, run, first).astype("<u4"), states.astype("<u8"), run.astype("<u4"))
    return head + b"".join(p.tobytes() for p in parts)


def read_segment(data: bytes, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ids of documents, which have one, their numbers of token ids, token ids)``; fails on a wrong checksum."""
    magic, n_docs, n_ids, n_blocks, table = HEAD.unpack_from(data)
    if magic != MAGIC or table != zlib.crc32(freq.tobytes()):
        raise ValueError("not a segment of this table")
    at, out = HEAD.size, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", n_blocks + 1), ("<u4", n_blocks), ("<u8", n_blocks * rans.LANES)):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    doc, has, size, first, sums, states = out
    run, first, states = np.frombuffer(data, "<u4", -1, at), first.astype(np.int64), states.reshape(n_blocks, rans.LANES)
    if (rans.checksums(states, run, first) != sums).any():
        raise ValueError("a block's checksum does not hold")
    return doc, has.astype(bool), size.astype(np.int64), rans.decode(states, run, first, freq)[:n_ids]


def _written(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for b in batches:
            for row in b.to_pylist():
                doc, has, size = (np.frombuffer(row[c], k) for c, k in (("docs", np.int64), ("has", bool), ("sizes", np.int64)))
                ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["ids"]), Words.kind)
                ends = np.cumsum(size)
                cut = np.r_[0, np.flatnonzero(np.diff(ends // SEGMENT_IDS)) + 1, len(size)]
                for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if j > i:
                        lo, hi = int(ends[i] - size[i]), int(ends[j - 1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["range"]], pa.int64()), pa.array([k], pa.int64()), pa.array([hi - lo], pa.int64()), pa.array([segment(doc[i:j], has[i:j], size[i:j], ids[lo:hi], freq, end_id)], pa.binary())],
                            ["range", "segment", "n_ids", "content"],
                        )

    return run


def write_token_files(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes ``path``/table (id, frequency) and ``path``/segments (range, segment, n_ids, content), in ascending order of ids.

    Every text ends with ``end_id``; a null text is its end alone. Rows without an id come last.
    Rows of one id are all written, in a fixed order of their texts.
    """
    spark = docs.sparkSession
    t = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, wide(spark, max(64, -(-size // BYTES_PER_RANGE))))
    cuts = t.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))
    sent = t.mapInArrow(_tokenised(vocabulary, bounds, end_id), RANGE)
    ordered = landed(sent.groupBy("range").applyInArrow(_in_order, RANGE), "ordered")
    counts = ordered.mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary
    total = np.zeros(max([end_id, *(r["id"] for r in counts)]) + 1, np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    freq = rans.quantised(total)
    spark.createDataFrame([(freq.astype("<i8").tobytes(),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    out = ordered.mapInArrow(_written(shared, end_id), "range long, segment long, n_ids long, content binary")
    out.write.option("compression", "uncompressed").parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files: ``start`` counts the ids of all documents before."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first()["frequencies"], "<i8").astype(np.int64)
    segments = spark.read.parquet(f"{path}/segments")
    before, sofar = {}, 0
    for r in segments.select("range", "segment", "n_ids").orderBy("range", "segment").collect():  # one short row per segment of millions of ids
        before[r["range"], r["segment"]] = sofar
        sofar += r["n_ids"]
    shared = spark.sparkContext.broadcast((freq, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, before = shared.value
        for b in batches:
            for row in b.to_pylist():
                doc, has, size, ids = read_segment(row["content"], freq)
                at = np.r_[0, np.cumsum(size)]
                for i in range(0, len(doc), 1024):
                    j = min(i + 1024, len(doc))
                    offsets = pa.array(at[i : j + 1] - at[i], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc[i:j], pa.int64(), mask=~has[i:j]),
                            pa.array(before[row["range"], row["segment"]] + at[i:j], pa.int64()),
                            pa.array(size[i:j], pa.int64()),
                            pa.ListArray.from_arrays(offsets, pa.array(ids[at[i] : at[j]].astype(np.int32))),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def crc32_of_ids(read: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of ``ids``: of all ids of a row as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to a new folder in the shared one and reads them back."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/llm-{uuid.uuid4().hex}"
    write_token_files(docs, vocabulary, path, id_col, text_col)
    return read_token_files(docs.sparkSession, path)
