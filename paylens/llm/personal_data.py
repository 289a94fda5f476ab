"""Personal data by a semi-Markov conditional random field beside four base rules.

The base rules find well-formed emails, addresses of the internet protocol, card and phone
numbers. Around everything that has a digit, an at sign or a spelt-out one, the text is cut into
tokens; whole candidate spans are scored by what they are as a whole (digits, check digit,
groups, separators, neighbours) and a dynamic programme of bounded span length chooses
boundaries and kinds together. The field learns from the base rules' spans in a bounded sample
and from spellings of them that the rules do not know; what it finds besides is added.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.landing import texts

KINDS = ("email", "ip", "card", "phone")
#: The contract's base patterns. Fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Bounds: tokens of a span; for fitting alone characters of a zone, documents and zones.
MOST_TOKENS, MOST_ZONE, MOST_DOCS, MOST_ZONES, ROUNDS = 24, 240, 4_000, 4_000, 4
HINT = re.compile(r"[0-9@]|[(\[{](?:at|AT)[)\]}]|\sdot\s")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
#: Words that can belong to a span: with a digit or an at sign, or bracketed or spelt out.
PART = re.compile(r"\S*[0-9@]\S*|[(\[{](?:at|AT|dot|DOT|\.)[)\]}]|\S+[(\[{](?:at|AT|dot|DOT|\.)[)\]}]\S*")
SPELT = re.compile(r"[A-Za-z0-9._%+-]+\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+")
AT, DOT = r"\s*(?:@|[(\[{]\s?(?:at|AT)\s?[)\]}]|(?<=\s)at(?=\s))\s*", r"\s*(?:\.|[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]|(?<=\s)dot(?=\s))\s*"
LOOSE_MAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,6}}")
LOOSE_IP = re.compile(rf"([0-9]{{1,3}}){DOT}([0-9]{{1,3}}){DOT}([0-9]{{1,3}}){DOT}([0-9]{{1,3}})")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the base rules find, kind by kind from the left; a match that fails its test is not tried again."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def zones(text: str, most: float = math.inf) -> list[tuple[int, int]]:
    """Stretches that can hold spans: neighbouring parts, with a word more where an at sign stands at the edge.

    A stretch runs as long as its parts do; only fitting cuts it, after ``most`` characters.
    """
    found = [m.span() for m in SPELT.finditer(text)] if " dot " in text else []
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)] if HINT.search(text) else []
    part = [i for i, (a, b) in enumerate(words) if PART.fullmatch(text[a:b])]
    i = 0
    while i < len(part):
        j = i
        while j + 1 < len(part) and part[j + 1] <= part[j] + 2 and words[part[j + 1]][1] - words[part[i]][0] <= most and (part[j + 1] == part[j] + 1 or "@" in text[slice(*words[part[j + 1]])] or text[words[part[j + 1]][0]] in "([{"):
            j += 1
        lo, hi = part[i], part[j]
        if lo and text[words[lo][0]] in "@([{":
            lo -= 1
        if hi + 1 < len(words) and text[words[hi][1] - 1] in "@)]}":
            hi += 1
        found.append((words[lo][0], words[hi][1]))
        i = j + 1
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def edge(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "word" if c.isalnum() or c == "_" else "join" if c in "+-./@" else "mark"


def features(text: str, a: int, b: int) -> list[str]:
    """What a candidate span is as a whole."""
    s = text[a:b]
    digits = _digits(s)
    n, left, right = len(digits), edge(text[a - 1 : a]), edge(text[b : b + 1])
    letters = any(c.isalpha() for c in s)
    seps = sorted({"s" if c.isspace() else c for c in s if not c.isalnum()})
    shape = "mail" if letters and LOOSE_MAIL.fullmatch(s) else "text" if letters else "num"
    if shape == "num":
        if (m := LOOSE_IP.fullmatch(s)) and all(int(p) <= 255 for p in m.groups()):
            shape = "quad"
        elif 12 <= n <= 19:
            shape = "luhn" if luhn(digits) else "long"
        elif s[0] == "+" or (s[0] == "(" and 9 <= n <= 15):
            shape = "call"
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", s)) if not letters and n <= 19 else ""
    inner = f"{shape}:{n if n < 20 else 20}" if shape not in ("mail", "text", "quad") else shape
    return ["bias", shape, inner, f"{shape}<{left}", f"{shape}>{right}", f"<{left}", f">{right}", f"{shape}|{''.join(seps)}", f"{shape}#{groups}", f"plus:{s[0] == '+'}", f"seps:{len(seps)}"]


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


class Field:
    """Weights of (kind, feature) and of (kind, next kind); plain tokens outside spans score nothing."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = defaultdict(float)

    def endings(self, text: str, tokens: list[tuple[int, int]]) -> Iterator[list[tuple[int, list[str]]]]:
        """For each token the spans that end with it: (first token, features)."""
        head = [text[a].isalnum() or text[a] in "+(" for a, _ in tokens]
        hint = [text[a].isdigit() or text[a] in "@([{" or text[a:b] == "at" for a, b in tokens]
        for j, (_, end) in enumerate(tokens):
            own: list[tuple[int, list[str]]] = []
            seen = False
            for i in range(j, max(-1, j - MOST_TOKENS), -1) if text[end - 1].isalnum() else ():
                seen = seen or hint[i]
                if seen and head[i]:
                    own.append((i, features(text, tokens[i][0], end)))
            yield own

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """All of ``endings`` at once."""
        return list(self.endings(text, tokens))

    def decode(self, text: str, tokens: list[tuple[int, int]], spans: Iterable[list[tuple[int, list[str]]]]) -> list[Span]:
        """Best spans: over the last token's kind, none or one of ``KINDS``.

        Scores are kept as far back as a span reaches, and of each token and kind one byte: how
        many tokens the best way goes back, and the kind it comes from.
        """
        w, kinds = self.w, ("", *KINDS)
        number = {k: n for n, k in enumerate(kinds)}
        best: deque[dict[str, float]] = deque([{"": 0.0}], MOST_TOKENS)
        back = bytearray(len(kinds) * (len(tokens) + 1))
        for j, ending in enumerate(spans):
            here: dict[str, float] = {}
            way = len(kinds) * (j + 1)
            here[""], before = max((score + w.get((k, ">"), 0.0), k) for k, score in best[-1].items())
            back[way] = len(kinds) + number[before]
            for i, f in ending:
                first = best[i - j - 1]
                for kind in KINDS:
                    own = sum(w.get((kind, x), 0.0) for x in f)
                    for k, score in first.items():
                        score = score + own + w.get((k, ">" + kind), 0.0)
                        if kind not in here or score > here[kind]:
                            here[kind] = score
                            back[way + number[kind]] = len(kinds) * (j + 1 - i) + number[k]
            best.append(here)
        out: list[Span] = []
        j, k = len(tokens), max(kinds, key=lambda k: best[-1].get(k, -math.inf))
        while j:
            length, before = divmod(back[len(kinds) * j + number[k]], len(kinds))
            if k:
                out.append((k, tokens[j - length][0], tokens[j - 1][1]))
            j, k = j - length, kinds[before]
        return out[::-1]

    def gradient(self, tokens: list, spans: list[list[tuple[int, list[str]]]], gold: list[Span]) -> dict[tuple[str, str], float]:
        """Of the log likelihood of ``gold``: its features less the expected ones, by the forward and backward sums over all cuts."""
        w, n = self.w, len(tokens)
        own = [[(i, f, [(k, sum(w.get((k, x), 0.0) for x in f)) for k in KINDS]) for i, f in ending] for ending in spans]
        step = {(a, b): w.get((a, ">" + b), 0.0) for a in ("", *KINDS) for b in ("", *KINDS)}
        ahead: list[dict[str, float]] = [{"": 0.0}]
        for j in range(n):
            terms: dict[str, list[float]] = {"": [v + step[k, ""] for k, v in ahead[j].items()]}
            for i, _, scores in own[j]:
                for kind, score in scores:
                    terms.setdefault(kind, []).extend(v + step[k, kind] + score for k, v in ahead[i].items())
            ahead.append({k: _logsum(v) for k, v in terms.items()})
        whole = _logsum(list(ahead[n].values()))
        behind: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(ahead[n], 0.0)]
        begins: list[list] = [[] for _ in range(n)]
        for j in range(n):
            for i, f, scores in own[j]:
                begins[i].append((j + 1, f, scores))
        out: dict[tuple[str, str], float] = defaultdict(float)
        for i in range(n - 1, -1, -1):
            for k, v in ahead[i].items():
                terms = [step[k, ""] + behind[i + 1][""]]
                out[k, ">"] -= math.exp(v + terms[0] - whole)
                for j, f, scores in begins[i]:
                    for kind, score in scores:
                        terms.append(step[k, kind] + score + behind[j][kind])
                        p = math.exp(v + terms[-1] - whole)
                        if p > 1e-6:
                            out[k, ">" + kind] -= p
                            for x in f:
                                out[kind, x] -= p
                behind[i][k] = _logsum(terms)
        first, last = {a: t for t, (a, _) in enumerate(tokens)}, {b: t + 1 for t, (_, b) in enumerate(tokens)}
        at, kind = 0, ""
        for k, a, b in [*gold, ("", None, None)]:
            stop = first[a] if k else n
            for t in range(at, stop):
                out[kind if t == at else "", ">"] += 1
            if stop > at:
                kind = ""
            if k:
                out[kind, ">" + k] += 1
                for x in next(f for i, f in spans[last[b] - 1] if i == stop):
                    out[k, x] += 1
                at, kind = last[b], k
        return out

    def fit(self, zones_: list[tuple[str, list[Span]]], rounds: int = ROUNDS, rate: float = 0.3, shrink: float = 1e-4) -> None:
        """Conditional likelihood by adaptive gradient steps, zone after zone; all chance is seeded, so reruns agree."""
        ready = []
        for text, gold in zones_:
            tokens = [m.span() for m in TOKEN.finditer(text)]
            spans = self.candidates(text, tokens)
            ends = {(tokens[i][0], tokens[j][1]) for j, own in enumerate(spans) for i, _ in own}
            if all((a, b) in ends for _, a, b in gold):  # others are no candidates, so they can't be learnt
                ready.append((tokens, spans, gold))
        size: dict[tuple[str, str], float] = defaultdict(float)
        for r in range(rounds):
            random.Random(r).shuffle(ready)
            for tokens, spans, gold in ready:
                for key, g in self.gradient(tokens, spans, gold).items():
                    g -= shrink * self.w.get(key, 0.0)
                    size[key] += g * g
                    self.w[key] += rate * g / (1e-3 + math.sqrt(size[key]))
        self.w = {k: v for k, v in self.w.items() if abs(v) > 1e-6}

    def spans(self, text: str) -> list[Span]:
        """Spans of a whole text, zone by zone."""
        out = []
        if self.w:
            for a, b in zones(text):
                # a zone sees its neighbours' edges
                lo, hi = max(0, a - 1), min(len(text), b + 1)
                piece = text[lo:hi]
                tokens = [m.span() for m in TOKEN.finditer(piece)]
                out += [(k, lo + x, lo + y) for k, x, y in self.decode(piece, tokens, self.endings(piece, tokens))]
        return out


def respelt(kind: str, s: str, rnd: random.Random) -> str:
    """Another way to write a span, one that the base rules mostly do not know."""
    if kind == "email":
        name, _, host = s.rpartition("@")
        at, dot = rnd.choice([("@", "."), (" @ ", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", " . ")])
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", rnd.choice([".", "[.]", " . ", "(.)"]))
    digits = _digits(s)
    if kind == "card":
        return rnd.choice([" ", "-", ".", "/", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    head = digits[:-10]
    return rnd.choice([f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}", f"+{head or 1}-{last[:3]}-{last[3:6]}-{last[6:]}", f"{head or 1} ({last[:3]}) {last[3:6]}-{last[6:]}", f"+{head or 1}/{last[:3]}/{last[3:]}"])


def spoilt(kind: str, s: str, rnd: random.Random) -> str:
    """Something that looks like a span and is none."""
    digits = _digits(s)
    if kind == "card":
        return s[:-1] + str((int(s[-1]) + rnd.randrange(1, 9)) % 10)
    if kind == "ip":
        return rnd.choice([".".join(s.split(".")[:3]), f"{rnd.randrange(300, 999)}.{s.split('.', 1)[1]}"])
    if kind == "phone":
        return rnd.choice([digits[: rnd.randrange(2, 7)], f"{digits[:3]}-{digits[3:6]}", f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}"])
    return rnd.choice([s.replace("@", "."), s.split("@")[0], s.split("@")[1]])


def examples(docs: list[str]) -> list[tuple[str, list[Span]]]:
    """Zones with their base spans, as they are, written otherwise, and spoilt."""
    out = []
    for n, text in enumerate(docs):
        rnd = random.Random(n)
        base = base_spans(text)
        for a, b in zones(text, MOST_ZONE):
            lo, hi = max(0, a - 1), min(len(text), b + 1)
            gold, at = [], lo
            for k, x, y in sorted((s for s in base if lo <= s[1] and s[2] <= hi), key=lambda s: (s[1], -s[2])):
                if x >= at:
                    gold.append((k, x - lo, y - lo))
                    at = y
            piece = text[lo:hi]
            out.append((piece, gold))
            for change, keep in ((respelt, True), (spoilt, False)):
                new, spans, at = "", [], 0
                for k, x, y in gold:
                    s = change(k, piece[x:y], rnd)
                    new += piece[at:x]
                    if keep:
                        spans.append((k, len(new), len(new) + len(s)))
                    new, at = new + s, y
                if gold:
                    out.append((new + piece[at:], spans))
            if len(out) >= MOST_ZONES:
                return out
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fits on a fixed sample of at most ``MOST_DOCS`` documents that have a digit or an at sign."""
    t = texts(docs, id_col, text_col).filter(F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # zones with a little of what stands around them, in place of whole texts
            out = [" \n ".join(x[max(0, lo - 20) : hi + 20] for lo, hi in zones(x, MOST_ZONE)[:8]) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(out, pa.string())], ["h", "text"])

    order = t.select(F.xxhash64("doc_id", "text").alias("h"), "text").orderBy("h").limit(MOST_DOCS)
    field = Field()
    field.fit(examples([r["text"] for r in order.mapInArrow(cut, "h long, text string").orderBy("h", "text").collect()]))
    return field


def found(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: added ones overlap no base span."""
    if not HINT.search(text):
        return [], []
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted(base_spans(text), key=lambda s: (s[1], order[s[0]]))
    more = [s for s in field.spans(text) if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` per row: lists of (kind, start, end) in code points, end exclusive, by start, then kind.

    ``spans`` are the base rules' and those that the field adds. A null or empty text has none; a
    corpus without base spans gives a field that adds none. Repeated rows repeat. An empty table
    gives no rows.
    """
    field = fit(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(dict(field.w))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.w = shared.value
        for b in batches:
            pairs = [found(x, own) for x in b.column("text").to_pylist()]
            lists = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in p[i]] for p in pairs], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], ["doc_id", "base", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}")
