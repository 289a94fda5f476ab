"""Fill-in-the-middle forms, language identification, alignment of tokenizers."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from plain import count, edge_rows, frame, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paylens.llm import alignment, fill_middle as fim
from paylens.llm.alignment import Fragment, Pair, aligned, cell_fragment, cells, compose, fragment, link_counts, whole
from paylens.llm.fill_middle import Cutter, Summaries, chunk_ends, edges, fill_middle, restored
from paylens.llm.landing import landed
from paylens.llm.language_id import Parser, language_id, plain, suffix_automaton

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SIDES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def plain_form(i, text):
    """The contract, unit by unit."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_on_edge_rows(spark):
    rows = edge_rows() + [(i, f"word{i} <P> x", "s") for i in range(200, 210)] + [(i, " é" * (i % 7) + "\n" * (i % 3) + "漢 x" * (i % 5), "s") for i in range(300, 400)]
    got = fill_middle(frame(spark, rows)).withColumn("back", restored())
    assert count(tuple(r)[:6] for r in got.collect()) == count(plain_form(i, t) for i, t, _ in rows)
    assert count((r["doc_id"], r["back"]) for r in got.collect()) == count((i, t or "") for i, t, _ in rows)
    assert {r["form"] for r in got.collect()} == {"plain", "spm", "psm"}
    assert fill_middle(frame(spark, rows).limit(0)).count() == 0


def test_chunk_sums_cut_as_the_pattern_does(monkeypatch):
    monkeypatch.setattr(fim, "SHORTEST", 3)
    monkeypatch.setattr(fim, "LONGEST", 9)
    rnd, known = random.Random(3), Summaries()
    for _ in range(2000):
        text = "".join(rnd.choice("ab é\n\t 漢 ") for _ in range(rnd.randrange(60)))
        data = text.encode()
        marks = sorted(rnd.sample(range(len(data) + 1), rnd.randrange(len(data) // 2 + 1)))
        ends = chunk_ends(marks, 0, len(data))
        assert all(0 < b - a <= 9 for a, b in zip([0, *ends], ends)) and (ends[-1:] == [len(data)] or not data)
        cut, units = Cutter(data, ends, known), UNIT.findall(text)
        assert cut.n == len(units)
        for k in range(len(units) + 1):
            assert data[: cut.after(k)] == "".join(units[:k]).encode()


def test_shared_passages_fall_into_the_same_chunks():
    rnd = random.Random(4)
    shared = sentence(rnd, 2000, 10**6).encode()
    found = []
    for _ in range(2):
        data = sentence(rnd, rnd.randrange(50, 90), 10**6).encode() + b" " + shared
        ends = chunk_ends(edges(np.frombuffer(data, np.uint8)).tolist(), 0, len(data))
        found.append({data[a:b] for a, b in zip([0, *ends], ends)})
    assert len(found[0] & found[1]) > 0.8 * len(found[0])


def test_summaries_stay_bounded(monkeypatch):
    monkeypatch.setattr(fim, "MOST_KEPT", 1000)
    known = Summaries()
    for k in range(500):
        assert known[b"word %d end" % k] == (3, True, True)
        assert sum(map(len, known)) <= 1100 and sum(map(len, known.old)) <= 1100


def letters_of(rnd, language, n):
    syllables = {"x": ["ka", "to", "ri", "mu"], "y": ["sch", "ein", "ver", "ü"], "z": ["ción", "que", "os", "ñ"]}[language]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


def test_languages_on_held_out_rows(spark):
    rnd, rows = random.Random(6), []
    for i in range(600):
        lang = "xyz"[i % 3]
        rows.append((i, letters_of(rnd, lang, rnd.randrange(3, 60)).capitalize() + rnd.choice(["", ".", "!!", " 12"]), lang))
    rows += [(1000, None, "x"), (1001, "", "y"), (1002, " 12 ²!", "z"), (1003, letters_of(rnd, "x", 30), None), (1003, letters_of(rnd, "x", 30), None), (None, letters_of(rnd, "y", 9), None), (1004, letters_of(rnd, "z", 40_000), None), (1005, "Ψ漢", None)]
    docs = frame(spark, rows).withColumnRenamed("source", "lang")
    got = language_id(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) for r in got)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by_id[i] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "x", "y", "z"] and by_id[1005] in "xyz"
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 150 and sum(r["lang_pred"] == "xyz"[r["doc_id"] % 3] for r in held) >= 0.99 * len(held)
    # the label of a held-out row is not looked at, nor that of any row when it is predicted
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("q")).otherwise(F.col("lang")))
    assert count(tuple(r) for r in language_id(swapped).collect()) == count(tuple(r) for r in got)
    none = language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert language_id(docs.limit(0)).count() == 0


def test_parser_counts_the_longest_matches():
    rnd = random.Random(7)
    known = {"a": b"abracadabra banana ana", "b": b"bbb c dcc abc"}
    parser = Parser(known)
    for data in (b"", b"a", b"zzz", *(bytes(rnd.choice(b"abcdrn z") for _ in range(rnd.randrange(40))) for _ in range(300)), b"banana" * 80):
        want = []
        for name in parser.names:
            n, i = 0, 0
            while i < len(data):
                k = i
                while k < len(data) and data[i : k + 1] in known[name]:
                    k += 1
                n, i = n + 1, max(k, i + 1)
            want.append(n)
        assert parser.phrases([data, b"x", data]).tolist()[::2] == [want, want], data
    for text in (b"", b"aaa", b"abcabcab"):
        step = suffix_automaton(text)
        words = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        paths, level = set(), {b"": 0}
        while level:
            level = {w + bytes([c]): to for w, s in level.items() for c, to in step[s].items()}
            paths |= set(level)
        assert paths == words
    assert plain("Été-2 İx_Y  ²") .startswith("été i̇x y".replace("̇", " ").encode()[:6])


@pytest.fixture(scope="module")
def both():
    return Pair(*SIDES)


def plain_alignment(rows):
    """The contract, token by token, with the libraries as they come."""
    a_side, b_side = Tokenizer.from_file(SIDES[0]), sentencepiece.SentencePieceProcessor(model_file=SIDES[1])
    a_side.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    docs, links = [], Counter()
    for i, text, _ in rows:
        one = dict(doc_id=i, n_a=0, n_b=0, groups="", links=[])
        docs.append(one)
        if not text:
            continue
        data = (" " + text).encode()
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        a_bytes = [bytes(alphabet[c] for c in a_side.id_to_token(t)) if t < 50256 else None for t in a]
        b_bytes = [bytes([t - 3]) if b_side.is_byte(t) else b_side.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            continue
        owner = [[k for k, x in enumerate(side) for _ in x] for side in (a_bytes, b_bytes)]
        pairs = sorted(set(zip(*owner)))
        one["links"] = [(a[x], b[y]) for x, y in pairs]
        links.update(one["links"])
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (a_bytes, b_bytes)]
        groups, at, k, m = [], 0, 0, 0
        for end in sorted(ends[0] & ends[1]):
            ga, gb, size = [], [], 0
            while at + size < end:
                ga.append(a[k])
                size += len(a_bytes[k])
                k += 1
            size = 0
            while at + size < end:
                gb.append(b[m])
                size += len(b_bytes[m])
                m += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            at = end
        one |= dict(n_a=len(a), n_b=len(b), groups=";".join(groups))
    top = {}
    for (_, b), n in links.items():
        top[b] = max(top.get(b, 0), n)
    return [(d["doc_id"], d["n_a"], d["n_b"], d["groups"].count(";") + bool(d["groups"]), d["groups"], len(d["links"]), sum(links[x] == top[x[1]] for x in d["links"]), sum(links[x] for x in d["links"])) for d in docs]


ODD = ["<|endoftext|> in <s> text </s> <unk> <0x41>", "a ▁ b", "▁", " ", "  two  spaces ", "\ttab\r\nline\x00nul", "ﬁ ½ é ñ ǅ", "don't I'll they've", "漢字かな交じり文 한국어 ไทย", "😀👩‍👩‍👧 x", "x" * 300, " " * 50, "1234567890 " * 9, "ends with space ", "Ω≈ç√ \x85   　 z"]


@pytest.mark.parametrize("long", [alignment.LONG, 200])
def test_alignment_on_edge_rows(spark, monkeypatch, long):
    rows = [(i, t if t is None or len(t) < 40_000 else t[:40_000], s) for i, t, s in edge_rows()] + [(500 + k, t, "s") for k, t in enumerate(ODD)] + [(600 + k, (t + " word and more ") * 20, "s") for k, t in enumerate(ODD)]
    monkeypatch.setattr(alignment, "BLOCK", 5_000)
    out = landed(aligned(frame(spark, rows), *SIDES, long=long, cell=70), "aligned")
    got = link_counts(out, 50_257, 32_000).select("doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum")
    assert count(tuple(r) for r in got.collect()) == count(plain_alignment(rows))
    if long == 200:
        assert out.filter(f"block >= {1 << 62}").count() > 10
    assert link_counts(landed(aligned(frame(spark, rows).limit(0), *SIDES), "none"), 50_257, 32_000).count() == 0


def test_fragments_compose_in_any_order(both):
    rnd = random.Random(9)
    for text in ("héllo wörld, unbelievably " * 3, "漢字 mixed 12345 don't", "x" * 90, sentence(rnd, 30), "😀é" * 20):
        want = whole(both, cell_fragment(both, text))
        size = len(text.encode()) + 1
        a, b = both.tokens([text])[0]
        sides = [np.c_[np.array(ids), np.cumsum([len(side.bytes[t]) for t in ids])] for ids, side in ((a, both.a), (b, both.b))]
        for _ in range(30):
            cuts = sorted({0, size, *rnd.sample(range(1, size), min(size - 1, rnd.randrange(9)))})
            parts = [fragment(both, *(x[(x[:, 1] > lo) & (x[:, 1] <= hi)] - [0, lo] for x in sides), hi - lo) for lo, hi in zip(cuts, cuts[1:])]
            while len(parts) > 1:  # any bracket
                k = rnd.randrange(len(parts) - 1)
                parts[k : k + 2] = [compose(both, parts[k], parts[k + 1])]
            got = whole(both, compose(both, compose(both, Fragment(), parts[0]), Fragment()))
            assert got[:4] == want[:4] and got[4].tolist() == want[4].tolist()
    broken = compose(both, cell_fragment(both, "a ▁"), cell_fragment(both, "b"))
    assert not broken.good and whole(both, broken)[:4] == (0, 0, 0, "")


def test_cells_are_tokenized_as_in_the_whole_text(both):
    rnd = random.Random(10)
    for _ in range(200):
        text = "".join(rnd.choice(["ab", "Xy", " ", " ", "é", "\n", "1", ",", "'s", "▁", "  ", "the", "漢"]) for _ in range(rnd.randrange(1, 200)))
        parts = list(cells(text, 10))
        assert " ".join(parts) == text
        for side in (both.a, both.b):
            assert sum(side.encode(parts), []) == side.encode([text])[0], repr(text)
    assert reduce(lambda x, y: compose(both, x, y), (cell_fragment(both, c, 16) for c in cells("word " * 300, 50))).size == 1501
