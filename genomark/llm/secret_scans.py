"""Secret scans: three fixed patterns, and a linear-chain conditional random field that adds spans.

The base patterns (assign, access, hex) give their leftmost non-overlapping matches per kind; those that fail
their length rule are dropped. The field tags the tokens of every whole text as B (a secret begins), I (inside) or O
from their shape, the words around them and features of the file, and the tags are decoded by Viterbi; its spans
(kind crf) stay, overlapping ones whole, unless base spans cover all of them.

The field is trained here, by likelihood, on at most ``WINDOWS`` windows of ``WIDTH`` tokens from a sample of about
``SAMPLE_ROWS`` distinct texts chosen by a hash, so a text counts once however often it occurs: windows around the
first ``PER_TEXT`` base matches of a text, windows without one, and windows into which made-up secrets and look-alikes
(numbers, addresses, dates) are put with a fixed seed. Tokens are whole, in training and in use, however long.

Decoding is exact without walking over all tokens: where O leads by more than all that transitions could add, O is
the best tag whatever the neighbours are; Viterbi runs on what is left between such tokens.

Positions are code points, ends exclusive. Null text counts as empty: no spans. Repeated rows each give a row, as do
rows with a null doc_id, which stays null. Spans with one start are in order of kind, then end. Other columns are
ignored by ``scan`` and kept by ``redact``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.llm.common import text_slices, tidy

KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SAYS_SECRET, HINTS, HEXADECIMAL = {*KEYWORDS, "pwd", "auth", "key", "credential", "bearer"}, ("passw", "pwd", "secret", "token", "apikey", "auth", "credential"), set("0123456789abcdef")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # runs of 24 or more
TOKEN = re.compile(r"[\w+/.=-]+|[^\w\s+/.=-]+")
DIGITS = re.compile(r"\d+")

SAMPLE_ROWS, WINDOWS, PER_TEXT, WIDTH, BUCKETS, ROUNDS, SEED = 4000, 1500, 3, 32, 1 << 14, 40, 11
O, B, I = 0, 1, 2
ROLES = 4  # the token itself, the two before it, the next one
CACHE_ROWS = 400_000

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Of the three patterns, by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def shape(word: str) -> str:
    """Character classes with runs shortened, at most 8."""
    out = ""
    for c in word:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "+/_.=-@:\"'" else "?"
        if not out.endswith(k):
            out += k
            if len(out) == 8:
                break
    return out


def plain_class(word: str) -> str | None:
    """One of a few classes for a token of letters (full stops around them aside) that is no word about secrets; None for others."""
    bare = word.strip(".")
    if not bare.isalpha() or bare.lower() in SAYS_SECRET:
        return None
    case = "a" if bare.islower() else "A" if bare.isupper() else "Aa" if bare[1:].islower() else "aA"
    return f"{case}{min(8, int(math.log2(len(bare)) * 2))}{len(word) > len(bare):d}{any(k in bare.lower() for k in HINTS):d}"


def word_features(word: str) -> tuple[list[str], list[str]]:
    """Of a token for itself, and for its neighbours."""
    if c := plain_class(word):
        return ["bias", f"plain={c}", f"plain={c[:-3]}"], [f"near plain={c[-1]}"]
    n, letters = len(word), set(word)
    digits, upper, lower = (sum(map(f, word)) for f in (str.isdigit, str.isupper, str.islower))
    size = min(12, int(math.log2(n) * 2))
    entropy = -sum(k / n * math.log2(k / n) for k in (word.count(c) for c in letters))
    changes = min(6, 2 * len(DIGITS.findall(word)) - (DIGITS.match(word) is not None) - (DIGITS.match(word[-1]) is not None))
    kinds = f"{digits > 0:d}{upper > 1:d}{lower > 0:d}{n - digits - upper - lower > 0:d}"
    own = ["bias", f"size={size}", f"shape={shape(word)}", f"kinds+size={kinds}{size}", f"digits={int(4 * digits / n)}", f"entropy={int(2 * entropy)}", f"changes+size={changes},{size}", f"hex={letters <= HEXADECIMAL}{size}", f"head={'9' if word[0].isdigit() else word[:4]}"]
    low = word.lower().strip(".=")
    near = [f"word={low}" if low in SAYS_SECRET or n <= 3 else f"kinds={kinds}", f"key={any(k in low for k in HINTS)}"]
    return own, near


def slot(role: int, feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{role}{feature}".encode(), digest_size=4).digest(), "little") % BUCKETS


def file_features(n_tokens: int, n_digits: int) -> list[int]:
    return [slot(9, f"length={min(12, int(math.log2(n_tokens + 1)))}"), slot(9, f"digits={min(5, int(100 * n_digits / (n_tokens + 1)))}")]


class Field(NamedTuple):
    weight: np.ndarray  # BUCKETS x 3
    step: np.ndarray  # 3 x 3, from a tag to the next


def _slots(word: str) -> list[list[int]]:
    """Of a token in each role."""
    own, near = word_features(word)
    return [[slot(0, x) for x in own], *([slot(r, x) for x in near] for r in range(1, ROLES))]


Window = tuple[list[list[list[int]]], list[int], list[int]]  # slots of its tokens in each role, their tags, slots of the file


def train(windows: list[Window]) -> Field:
    """Maximum likelihood with a penalty, by Adam."""
    width, most = max((len(t) for t, _, _ in windows), default=1), 18
    n = len(windows)
    index = np.full((n, width, most), BUCKETS, np.int32)
    gold, live = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for k, (each, tags, file) in enumerate(windows):
        for i in range(len(each)):
            found = each[i][0] + (each[i - 1][1] if i else []) + (each[i - 2][2] if i > 1 else []) + (each[i + 1][3] if i + 1 < len(each) else []) + file
            index[k, i, : len(found)] = found
        gold[k, : len(tags)], live[k, : len(tags)] = tags, True
    weight, step = np.zeros((BUCKETS + 1, 3)), np.zeros((3, 3))
    flat = index.reshape(n * width, most)
    one = np.eye(3)
    want = one[gold] * live[..., None]
    both = live[:, 1:] & live[:, :-1]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weight, step)]
    for t in range(1, ROUNDS + 1):
        score = weight[flat].sum(1).reshape(n, width, 3)
        ahead, back = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        ahead[:, 0] = score[:, 0]
        for i in range(1, width):
            new = score[:, i] + np.logaddexp.reduce(ahead[:, i - 1, :, None] + step, axis=1)
            ahead[:, i] = np.where(live[:, i, None], new, ahead[:, i - 1])
        for i in range(width - 2, -1, -1):
            new = np.logaddexp.reduce(step + (score[:, i + 1] + back[:, i + 1])[:, None, :], axis=2)
            back[:, i] = np.where(live[:, i + 1, None], new, 0)
        whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + back - whole[:, None, None]) * live[..., None]
        wrong = (p - want).reshape(-1, 3)
        slope = np.stack([np.bincount(flat.ravel(), np.repeat(wrong[:, y], most), BUCKETS + 1) for y in range(3)], 1)
        joint = np.exp(ahead[:, :-1, :, None] + step + (score[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * both[..., None, None]
        for x, g, (m, v) in zip((weight, step), (slope / n + 1e-5 * weight, (joint.sum((0, 1)) - pairs) / n + 1e-5 * step), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weight[BUCKETS] = 0
    return Field(weight[:BUCKETS].astype(np.float32), step)


def viterbi(score: np.ndarray, step: np.ndarray, before: bool, after: bool) -> list[int]:
    """The best tags of an island whose neighbours, if there are any, are O."""
    best = score[0] + (step[O] if before else 0)
    came = []
    for row in score[1:]:
        ways = best[:, None] + step
        came.append(ways.argmax(0))
        best = ways.max(0) + row
    tags = [int((best + (step[:, O] if after else 0)).argmax())]
    for c in reversed(came):
        tags.append(int(c[tags[-1]]))
    return tags[::-1]


class Tagger(dict):
    """Token -> row of its emission scores in every role; plain words share the row of their class."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.table, self.n, self.classes = field, np.zeros((1 << 12, ROLES, 3), np.float32), 0, {}
        self.margin = 2 * float(field.step.max() - field.step.min())

    def __missing__(self, word: str) -> int:
        kind = plain_class(word)
        row = self.classes.get(kind) if kind else None
        if row is None:
            if self.n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            row, self.n = self.n, self.n + 1
            for role, slots in enumerate(_slots(word)):
                self.table[row, role] = self.field.weight[slots].sum(0)
            if kind:
                self.classes[kind] = row
        if len(word) <= 128:
            self[word] = row
        return row

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The field's spans of each text."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if len(self) > CACHE_ROWS or self.n > CACHE_ROWS:
            self.clear()
            self.classes.clear()
            self.n = 0
        tokens = [TOKEN.findall(t) for t in texts]
        first = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
        if not first[-1]:
            return out
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), np.int64, int(first[-1]))
        rows = self.table[ids]
        score = rows[:, 0].copy()
        begin, end = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        begin[first[:-1][np.diff(first) > 0]] = True
        end[first[1:][np.diff(first) > 0] - 1] = True
        second = np.zeros(len(ids), bool)
        second[1:] = begin[:-1]
        score[1:] += np.where(begin[1:, None], 0, rows[:-1, 1])
        score[2:] += np.where((begin | second)[2:, None], 0, rows[:-2, 2])
        score[:-1] += np.where(end[:-1, None], 0, rows[1:, 3])
        for k, x in enumerate(tokens):
            if x:
                score[first[k] : first[k + 1]] += self.field.weight[file_features(len(x), sum(w[0].isdigit() for w in x))].sum(0)
        unsure = np.flatnonzero(score[:, O] - score[:, 1:].max(1) <= self.margin)
        if not len(unsure):
            return out
        owner = np.searchsorted(first, unsure, "right") - 1
        cuts = np.flatnonzero((np.diff(unsure) > 1) | (np.diff(owner) > 0)) + 1
        for island, k in zip(np.split(unsure, cuts), owner[np.concatenate([[0], cuts])], strict=True):
            tags = viterbi(score[island], self.field.step, not begin[island[0]], not end[island[-1]])
            if any(tags):
                at = island - first[k]
                places = None
                for i, tag in zip(at, tags, strict=True):
                    if tag == O:
                        continue
                    places = places or [m.span() for m in TOKEN.finditer(texts[k])]
                    if tag == I and out[k] and out[k][-1][2] == i - 1:
                        out[k][-1] = (out[k][-1][0], places[i][1], i)
                    else:
                        out[k].append((*places[i], i))
        return [[(a, b) for a, b, _ in x] for x in out]


def _windows(text: str, rng: random.Random) -> Iterator[tuple[bool, list[list[list[int]]], list[int], list[int]]]:
    """Around the first PER_TEXT base matches, and one elsewhere: has a secret, slots of the tokens, tags, slots of the file."""
    found = list(TOKEN.finditer(text))
    if not found:
        return
    tags = [O] * len(found)
    starts = [m.start() for m in found]
    values = [(a + (len(m[0]) - len(m[1]) if (m := ASSIGN.match(text, a)) and k == 0 else 0), b) for a, k, b in base_spans(text)]
    for a, b in values:
        inside = False
        for i in range(int(np.searchsorted(starts, a)), len(found)):
            if found[i].start() >= b:
                break
            if found[i][0][0].isalnum():
                tags[i], inside = I if inside and tags[i] != B else B, True
    file = file_features(len(found), sum(m[0][0].isdigit() for m in found))
    at = [i for i, t in enumerate(tags) if t == B][:PER_TEXT]
    for i in [*at, rng.randrange(len(found))]:
        low = max(0, i - rng.randrange(4, WIDTH - 4))
        own = tags[low : low + WIDTH]
        yield any(own), [_slots(m[0]) for m in found[low : low + WIDTH]], own, file


def _made_up(tokens: list, tags: list[int], rng: random.Random, of: Callable[[str], object] = _slots) -> tuple[list, list[int]]:
    """The window with secrets and look-alikes put in; of: what stands for a token."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    secret = rng.choice(
        (
            lambda: draw(num + "abcdef", rng.choice((24, 32, 40, 64))),
            lambda: draw(low + up + num, rng.randrange(16, 44)),
            lambda: draw(low + up + num + "+/", rng.randrange(24, 60)) + "==",
            lambda: "AKIA" + draw(up + num, 16),
            lambda: draw(low, rng.randrange(2, 5)) + rng.choice("_-") + rng.choice(("", draw(low, 4) + "_")) + draw(low + up + num, rng.randrange(20, 40)),
            lambda: draw(low, 4) + "-" + "-".join(draw(low + up + num, rng.randrange(8, 16)) for _ in range(3)),
            lambda: ".".join(draw(low + up + num, rng.randrange(18, 40)) for _ in range(3)),
            lambda: draw(low + up, rng.randrange(3, 7)) + draw(num, rng.randrange(1, 5)) + draw(low + up, rng.randrange(0, 5)),
        )
    )()
    key = rng.choice((*KEYWORDS, "pwd", "auth", "key", "credential", "access_token", "passphrase"))
    strong = len(secret) >= 16
    lead = [rng.choice((key, key.upper(), key.title())), *rng.choice((["="], [":"], ["is"], ["was"], [])), *rng.choice(([], ['"'], ["'"]))] if not strong or rng.random() < 0.5 else []
    innocent = rng.choice(
        (
            lambda: [draw(num, rng.randrange(3, 20))],
            lambda: [".".join(draw(num, 3) for _ in range(4))],
            lambda: [draw(low, 6) + "." + draw(low, 5), "@", draw(low, 8) + ".com"],
            lambda: [f"20{draw(num, 2)}-0{draw(num, 1)}-1{draw(num, 1)}"],
            lambda: [draw(low, rng.randrange(10, 40))],
            lambda: [draw(up, rng.randrange(4, 16))],
            lambda: [draw(up, rng.randrange(1, 4)) + draw(low, rng.randrange(2, 16))],
            lambda: [draw(low, rng.randrange(1, 8)) + draw(up, rng.randrange(1, 3)) + draw(low, rng.randrange(1, 10))],
            lambda: ["https", "://", draw(low, 8) + ".org/" + "/".join(draw(rng.choice((low, low, num)), rng.randrange(2, 9)) for _ in range(rng.randrange(0, 4)))],
            lambda: ["https", "://", "-".join(draw(low, rng.randrange(3, 9)) for _ in range(rng.randrange(1, 4))) + ".org/" + "-".join(draw(low, rng.randrange(2, 9)) for _ in range(rng.randrange(1, 6))) + ".htm"],
            lambda: ["-".join(draw(num, rng.randrange(1, 6)) for _ in range(rng.randrange(2, 6)))],
            lambda: [draw(low, 5) + rng.choice("-_/") + draw(low, 6) + rng.choice("-_/") + draw(low, 4)],
            lambda: [draw(up, 1) + draw(low, 4) + draw(num, 2)],
            lambda: [rng.choice(KEYWORDS), rng.choice(("is", "was", "of", draw(low, 5))), draw(low, rng.randrange(2, 9))],
            lambda: [draw(num, 2) + ":" + draw(num, 2), draw(low, 3) + draw(num, 1)],
        )
    )
    out, marks = list(tokens), list(tags)
    for put, marked in ((innocent(), False), (innocent(), False), ([*lead, secret], True)):
        i = rng.randrange(len(out) + 1)
        if i < len(out) and marks[i] == I:
            continue
        out[i:i] = map(of, put)
        marks[i:i] = [O] * (len(put) - 1) + [B] if marked else [O] * len(put)
    return out, marks


def fit(documents: DataFrame, text: str = "text") -> Field:
    """The field, from a bounded sample of the distinct texts."""
    share = max(1, documents.count() // SAMPLE_ROWS)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=7).digest(), "little")
                cols = list(zip(*((h + k, *w) for k, w in enumerate(_windows(t, random.Random(h)))), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _WINDOW.types, strict=True)], schema=_WINDOW)

    @tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first third of WINDOWS of either kind."""
        left = {True: WINDOWS // 3, False: WINDOWS // 3}
        for b in batches:
            keep = []
            for x in b.column("secret").to_pylist():
                left[x] -= 1
                keep.append(left[x] >= 0)
            yield b.filter(pa.array(keep, pa.bool_()))

    schema = "h long, secret boolean, tokens array<array<array<int>>>, tags array<int>, file array<int>"
    sample = documents.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(F.col(text)), F.lit(share)) == 0)).select(text).distinct()
    own = sorted(sample.mapInArrow(cut, schema).repartition(1).sortWithinPartitions("h").mapInArrow(pick, schema).collect(), key=lambda r: (not r["secret"], r["h"]))
    rng = random.Random(SEED)
    windows = [(r["tokens"], list(r["tags"]), list(r["file"])) for r in own] or [([_slots("the")], [O], [])]
    plain = [w for w in windows if not any(w[1])] or windows
    windows += [(*_made_up(t, g, rng), f) for t, g, f in (rng.choice(plain) for _ in range(WINDOWS // 3))]
    return train(windows)


_WINDOW = pa.schema({"h": pa.int64(), "secret": pa.bool_(), "tokens": pa.list_(pa.list_(pa.list_(pa.int32()))), "tags": pa.list_(pa.int32()), "file": pa.list_(pa.int32())})


def _covered(a: int, b: int, base: list[Span]) -> bool:
    """Whether base spans, in order, cover a to b between them."""
    for x, _, y in base:
        if x > a:
            break
        a = max(a, y)
    return a >= b


def all_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Base spans and the field's further ones, by start, then kind."""
    out = []
    for text, added in zip(texts, tagger.spans(texts), strict=True):
        base = base_spans(text)
        out.append(sorted(base + [(a, 3, b) for a, b in added if not _covered(a, b, base)]))
    return out


def _line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added of every row."""
    field = documents.sparkSession.sparkContext.broadcast(tuple(fit(documents, text)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Field(*field.value))
        for batch in batches:
            for part, own in text_slices(batch, "t", 1 << 19):
                rows = []
                for spans in all_spans(own.to_pylist(), tagger):
                    count = [sum(k == x for _, k, _ in spans) for x in range(4)]
                    rows.append((*count[:3], hashlib.sha256(_line([s for s in spans if s[1] < 3]).encode()).hexdigest(), _line(spans), count[3]))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.string() if k in (3, 4) else pa.int64()) for k, c in enumerate(cols))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact(documents: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """The documents with every span replaced by mark; all columns stay, and n_chars, if there is one, follows the text."""
    field = documents.sparkSession.sparkContext.broadcast(tuple(fit(documents, text)))
    at = documents.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Field(*field.value))
        for batch in batches:
            for part, own in text_slices(batch, text, 1 << 19):
                texts: list[str | None] = own.to_pylist()
                null = part.column(text).is_null().to_pylist()
                changed = False
                for i, (t, spans) in enumerate(zip(texts, all_spans(texts, tagger), strict=True)):
                    if spans:
                        out, end = [], 0
                        for a, _, b in spans:
                            if a >= end:
                                out += [t[end:a], mark]
                            end = max(end, b)
                        texts[i], changed = "".join([*out, t[end:]]), True
                if changed:
                    columns = list(part.columns)
                    columns[at] = pa.array([None if z else t for t, z in zip(texts, null, strict=True)], part.schema.field(at).type)
                    part = pa.RecordBatch.from_arrays(columns, part.schema.names)
                yield part

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length(text).cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
