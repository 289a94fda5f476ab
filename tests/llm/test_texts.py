import math
import random
import zlib
from collections import Counter, defaultdict

import base64
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from plain import LOWER, WORD, count, edge_rows, frame, sentence
from tokenizers import Tokenizer

from paylens.llm import rans
from paylens.llm.byte_bpe import Utf8Stream, byte_bpe, decode, units
from paylens.llm.context_tree import context_tree_scores, evidence, grams, lgamma, subtrees
from paylens.llm.scan import scan
from paylens.llm.token_files import read_segment, read_token_files, segment, write_token_files

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_on_edge_rows(spark, reference):
    rows = edge_rows()
    got = byte_bpe(frame(spark, rows), RANKS, PATTERN)
    want = [(i, len(ids := reference.encode_ordinary(t or "")), tuple(ids), t or "") for i, t, _ in rows]
    assert count((r[0], r[1], tuple(r[2]), r[3]) for r in got.collect()) == count(want)
    back = decode(got.select("doc_id", "ids", "decoded"), RANKS, PATTERN).collect()
    assert count(map(tuple, back)) == count((i, t or "") for i, t, _ in rows)
    assert byte_bpe(frame(spark, rows).limit(0), RANKS, PATTERN).count() == 0


def test_transducer_on_random_texts(reference):
    rnd, known = random.Random(1), units(RANKS, PATTERN)
    for letters in ("ab  \n\n\t éß漢😀1's.,!x\x1c Z\x85", "etaoin shrdlu ", "  \n", "0123456789"):
        for _ in range(1500):
            s = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
            assert np.frombuffer(known.text(s), np.int32).tolist() == reference.encode_ordinary(s), repr(s)


def test_transducer_waits_no_longer_than_a_token(reference):
    machine = units(RANKS, PATTERN).machine
    longest = max(map(len, machine.ranks))
    rnd = random.Random(2)
    for _ in range(300):
        piece, state, sure = bytes(rnd.choice(b"aeinothrs") for _ in range(60)), machine.start, 0
        for n, byte in enumerate(piece, 1):
            state, out = state.get(byte) or machine.move(state, byte)
            sure += sum(len(machine.token[t]) for t in out)
            assert n - sure <= 2 * longest
    machine.forget()
    assert machine.encode(b"unbelievably") == reference.encode_ordinary("unbelievably")


def test_utf8_stream_at_every_cut():
    text = "aé漢😀z"
    data = text.encode()
    for i in range(len(data) + 1):
        for j in range(i, len(data) + 1):
            s = Utf8Stream()
            assert s.feed(data[:i]) + s.feed(data[i:j]) + s.feed(data[j:], last=True) == text
    for bad in (b"\xff", b"a\xe6\xbc", b"\x80\x80\x80\x80", b"\xf0\x9f\x98x"):
        s = Utf8Stream()
        assert "".join(s.feed(bad[i : i + 1]) for i in range(len(bad))) + s.feed(b"", last=True) == bad.decode("utf-8", "replace")


def test_token_files_on_edge_rows(spark, tmp_path):
    rows = edge_rows()
    write_token_files(frame(spark, rows), WORDS, str(tmp_path / "a"))
    got = sorted(read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    known = Tokenizer.from_file(WORDS)
    known.encode_special_tokens = True
    want = count((i, tuple([*known.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _ in rows)
    assert count((r["doc_id"], tuple(r["ids"])) for r in got) == want
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((i for i in ids if i is not None)) + [None] * ids.count(None)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    write_token_files(frame(spark, rows).limit(0), WORDS, str(tmp_path / "b"))
    assert read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_words_cut_at_white_space_are_encoded_as_in_the_text():
    from paylens.llm.token_files import words

    known, library = words(WORDS), Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    rnd = random.Random(0)
    for _ in range(2000):
        s = "".join(rnd.choice("aB,. é'sİΣ1-\ń <|endoftext|>\x85漢!") for _ in range(rnd.randrange(40)))
        assert np.frombuffer(known.text(s.encode()), np.uint16).tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_rans_round_trip_and_damage():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 1000, rans.BLOCK, 3 * rans.BLOCK + 7):
        ids = np.minimum(rnd.zipf(1.3, n), 40_000).astype(np.int64)
        freq = rans.quantised(np.bincount(np.r_[ids, 1], minlength=40_001))
        assert freq.sum() == 1 << rans.SCALE and (freq[ids] > 0).all()
        data = segment(np.array([5]), np.array([True]), np.array([n]), ids, freq)
        assert (read_segment(data, freq)[3] == ids).all()
        if n > 1000:
            assert len(data) < 2 * n + 40_000
            for where in (len(data) - 3, len(data) // 2):
                broken = bytearray(data)
                broken[where] ^= 1
                with pytest.raises(ValueError):
                    read_segment(bytes(broken), freq)
            with pytest.raises(ValueError):
                read_segment(data, np.roll(freq, 1))


def test_any_block_can_be_decoded_alone():
    ids = np.random.default_rng(1).integers(0, 300, 4 * rans.BLOCK)
    freq = rans.quantised(np.bincount(ids))
    states, words, first = rans.encode(ids, freq, 0)
    b = 2
    alone = rans.decode(states[b : b + 1], words[first[b] : first[b + 1]], np.array([0, first[b + 1] - first[b]]), freq)
    assert (alone == ids[b * rans.BLOCK : (b + 1) * rans.BLOCK]).all()


def test_rare_symbols_keep_a_frequency():
    counts = np.r_[10**12, np.ones(49_000, np.int64)]
    freq = rans.quantised(counts)
    assert freq.min() == 1 and freq.sum() == 1 << rans.SCALE


def held(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def test_context_tree_counts_on_edge_rows(spark):
    rows = edge_rows()
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t, _ in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = count((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for i, ws in tokens)
    for per_block in (8, 4096):
        got = context_tree_scores(frame(spark, rows), rows_per_block=per_block).collect()
        assert count((*tuple(r)[:5], round(r["base_score"], 5)) for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert context_tree_scores(frame(spark, rows).limit(0)).count() == 0


def plain_tree(train: list[bytes], depth: int):
    """Counts of every node, by context (nearest byte first) and bits so far."""
    node: dict = defaultdict(lambda: [0, 0])
    for s in train:
        x = b"\n" * depth + s
        for i in range(depth, len(x)):
            for k in range(8):
                prefix, bit = (1 << k) | (x[i] >> (8 - k)), x[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    node[bytes(x[i - d : i][::-1]), prefix][bit] += 1
    return node


def plain_score(node, s: bytes, depth: int) -> float:
    children = defaultdict(set)
    for c, p in node:
        if c:
            children[c[:-1], p].add((c, p))
    memo: dict = {}

    def log_w(key):
        if key not in memo:
            e = math.lgamma(node[key][0] + 0.5) + math.lgamma(node[key][1] + 0.5) - math.lgamma(sum(node[key]) + 1) - math.log(math.pi)
            below = sum(log_w(x) for x in children[key])
            memo[key] = (e, e, 1.0) if len(key[0]) == depth else (e, math.log(0.5) + np.logaddexp(e, below), 1 / (1 + math.exp(max(-700, min(700, below - e)))))
        return memo[key][1]

    total, x = 0.0, b"\n" * depth + s
    for i in range(depth, len(x)):
        for k in range(8):
            prefix, bit = (1 << k) | (x[i] >> (8 - k)), x[i] >> (7 - k) & 1
            p = None
            for d in range(depth, -1, -1):
                key = (bytes(x[i - d : i][::-1]), prefix)
                if key not in node:
                    continue
                log_w(key)
                kt, own = (node[key][1] + 0.5) / (sum(node[key]) + 1), memo[key][2]
                p = kt if p is None else own * kt + (1 - own) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
    return total


def test_context_tree_equals_a_plain_tree(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["the", "then", "Them", "a", "an", "été"]) for _ in range(rnd.randrange(0, 12))), "s") for i in range(40)]
    for depth in (3, 5):
        texts = {i: "".join(w + " " for w in WORD.findall(t.translate(LOWER))).encode() + b"\n" for i, t, _ in rows}
        node = dict(plain_tree([s for i, s in texts.items() if not held(i)], depth))
        got = {r["doc_id"]: r["score"] for r in context_tree_scores(frame(spark, rows), depth=depth, rows_per_block=16).collect()}
        for i, s in texts.items():
            assert abs(got[i] - plain_score(node, s, depth)) < 1e-3


def test_next_bytes_sum_to_one():
    """Over all 256 next bytes of a context the eight decisions make one distribution."""
    import pyarrow as pa

    _, _, w = next(scan(pa.array(["the then them a an the"]), lower=True))
    keys = grams(w, 5)[0]
    every = np.unique(np.r_[keys, (keys[5] & ~np.uint64(255 << 16)) | (np.arange(256, dtype=np.uint64) << np.uint64(16))])
    counts = np.isin(every, keys).astype(np.int64)
    p = np.ones(len(every))
    for *_, one, _, _, bit in subtrees(every, counts, 5):
        p *= np.where(bit == 1, one, 1 - one)
    here = (every & ~np.uint64(255 << 16)) == (keys[5] & ~np.uint64(255 << 16))
    assert here.sum() == 256 and abs(p[here].sum() - 1) < 1e-9


def test_lgamma_and_evidence():
    x = np.r_[0.5, 1, 1.5, 7.25, 1000.5, 1e9]
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    assert np.allclose(np.exp(evidence(np.array([0.0, 1, 2]), np.array([0.0, 0, 1]))), [1, 0.5, 1 / 16])


def test_scores_of_unseen_texts_beat_single_tokens(spark):
    rnd = random.Random(11)
    tongues = [["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 7))) for _ in range(150)] for letters in ("abcdef", "ghijkl", "mnopqr", "stuvwx")]
    rows = [(i, " ".join(rnd.choice(tongues[i % 4]) for _ in range(200)), "s") for i in range(300)]
    got = context_tree_scores(frame(spark, rows)).filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_long_single_word_and_sentence(spark):
    rows = [(1, "x" * 300_000, "s"), (2, sentence(random.Random(1), 10), "s")]
    assert {r["n_tokens"] for r in context_tree_scores(frame(spark, rows)).collect()} == {2, 11}


def test_added_tokens_in_a_text_are_those_of_the_plain_library_call(spark, tmp_path):
    from paylens.llm.token_files import words

    known, library = words(WORDS), Tokenizer.from_file(WORDS)
    rnd = random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "Aé's ", " don't", "\n", "x.", "İΣ ", "漢"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(8))) for _ in range(1000)]
    for s in texts:
        assert np.frombuffer(known.text(s.encode()), np.uint16).tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)
    rows = [(i, s, None) for i, s in enumerate(texts[:50])]
    write_token_files(frame(spark, rows), WORDS, str(tmp_path / "a"))
    got = read_token_files(spark, str(tmp_path / "a")).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*library.encode(s, add_special_tokens=False).ids, 1] for i, s, _ in rows}


def test_token_files_look_up_a_word_once_however_often_it_stands(monkeypatch):
    """Time of op9: more words than are remembered, each in many rows and with marks behind it, must not be encoded over and over."""
    import pyarrow as pa
    import zstandard
    from paylens.llm import token_files

    monkeypatch.setattr(token_files, "MOST_WORDS", 40)
    monkeypatch.setattr(token_files, "kept", lambda owner, key, make: known)
    known, library, asked = token_files.Words(WORDS), Tokenizer.from_file(WORDS), []
    for name in ("of_model", "of_text"):
        monkeypatch.setattr(known, name, lambda w, f=getattr(known, name): asked.append(w) or f(w))
    rnd = random.Random(5)
    cores = ["".join(rnd.choice("aeinothrsé") for _ in range(9)) for _ in range(300)]
    marks = ["", ".", ",", "...", "'.", "!?", '")', "***"]
    rows = [" ".join(w + rnd.choice(marks) for w in rnd.sample(cores, 300)) for _ in range(40)]
    rows[3:3] = ["", " \t", " a  b\n", "x <|endoftext|> y", "<|ENDOFTEXT|>", "don't's. '.' a'll.' 3. é. É, .a a.b a.,9 \x85 .", "İ. Σ.\x0b\x0cΣΑΣ ,,"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(i, i + len(p)), pa.int64()), "text": p, "tie": pa.array([0] * len(p), pa.int64())}) for i in range(0, len(rows), 9) if (p := rows[i : i + 9])]
    got = {}
    for b in token_files._tokenised(WORDS, np.zeros(0, np.int64), 1)(iter(batches)):
        for docs, sizes, ids in zip(*(b.column(c).to_pylist() for c in ("docs", "sizes", "ids")), strict=True):
            flat, ends = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint16), np.cumsum(np.frombuffer(sizes, np.int64))
            got |= {int(d): x.tolist() for d, x in zip(np.frombuffer(docs, np.int64), np.split(flat, ends[:-1]), strict=True)}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(rows)}
    assert max(Counter(asked).values()) == 1 and not any(w[:-1] in cores for w in asked), asked


def test_portions_keep_rows_whatever_the_batches(monkeypatch):
    import pyarrow as pa
    from paylens.llm import token_files

    monkeypatch.setattr(token_files, "PORTION_BYTES", 100)
    monkeypatch.setattr(token_files, "PORTION_ROWS", 7)
    monkeypatch.setattr(token_files, "MOST_WORDS", 5)
    rnd, library = random.Random(7), Tokenizer.from_file(WORDS)
    texts = [" ".join(rnd.choice(["one", "two.", "Three,", "é", "4"]) + rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 0, 1, 5, 40]))) for _ in range(200)]
    cuts = sorted({0, 200, *rnd.sample(range(200), 12)})
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i:j], pa.string())}) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    out = [b.column("text") for b in token_files.portions(iter([*batches, batches[0].slice(0, 0)]))]
    assert [t for b in out for t in b.to_pylist()] == texts
    assert max(map(len, out)) == 7 and all(sum(len(t.encode()) for t in b.to_pylist()[:-1]) < 100 for b in out) and all(len(b) == 7 or sum(len(t.encode()) for t in b.to_pylist()) >= 100 for b in out[:-1])
    known = token_files.Words(WORDS)
    for b in out:
        assert [np.frombuffer(x, np.uint16).tolist() for x in known.texts(b)] == [library.encode(t, add_special_tokens=False).ids for t in b.to_pylist()]
    assert list(token_files.portions(iter([]))) == []
    for kind in (pa.string(), pa.large_string()):
        assert known.texts(pa.array([], kind)) == [] and known.texts(pa.array(["", "", " "], kind), b"ee") == [b"ee"] * 3
        assert [len(x) for x in known.texts(pa.array(["one", "", "<|endoftext|>"], kind))] == [2, 0, 2]
