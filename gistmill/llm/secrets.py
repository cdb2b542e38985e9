"""Secret scans: base patterns, and a character convolutional network for the rest.

Base kinds are found leftmost and without overlap in each kind; failing matches
are dropped: `assign` (a secret's name, a sign and a value of 6 or more
characters), `access` (AKIA and 20 or more characters in all) and `hex` (24 or
more lower-case hexadecimal digits).  Base spans always stay.

Every candidate - each base span, and each run of token characters that outreaches
base spans: of 16 or more characters, with and without inner dots, and of 8 to 15
where it mixes letters with digits or small letters with capitals - is scored with
CONTEXT bytes on both sides by a network in numpy: byte embeddings, filters WIDTH
bytes wide over the whole candidate and its surroundings, maximum and mean pools, a
logistic layer.  Long runs are pooled in windows of BLOCK bytes, which combine
exactly.  Runs at or over a threshold add spans of the kind `model`.

Training takes labelled findings (before, candidate, after, label): secrets are
generated with a fixed seed, as no table labels any; harmless runs are generated
(dates, paths, identifiers, numbers, long words) and drawn from the documents
themselves, at most ORDINARY runs of about ORDINARY_DOCS documents.  A secret among
those is a wrong label; the recall that the threshold must keep is taken over the
generated secrets alone, so it bounds what such labels can do.  A held-out part
calibrates the scores and, passed through the candidate search as texts, sets for
each length class the highest threshold that keeps its recall (MIN_RECALL,
SHORT_RECALL): a secret that no candidate covers counts as missed.

Spans are code points with an exclusive end.  Defined cases: a null text is
empty; an empty text has no span; repeated rows are scanned each; extra columns
are not touched.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import small_batches
from gistmill.llm.kernel import buffers, columns, groups, strings, words
from gistmill.llm.toxicity import platt

KINDS = ("assign", "access", "hex", "model")
CONTEXT = 24
WIDTH = 5
FILTERS = 24
DIM = 8
MIN_RUN = 16
SHORT_RUN = 8
MIN_RECALL = 0.98
SHORT_RECALL = 0.7
BLOCK = 1 << 18
ORDINARY = 2_000
ORDINARY_DOCS = 2_000
ORDINARY_BYTES = 1_024  # longer runs are scored, but not learnt from
MARK = "[secret]"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RUN_GAP = np.ones(256, bool)
_RUN_GAP[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")] = False
_DOTTED_GAP = _RUN_GAP.copy()
_DOTTED_GAP[46] = False
_DIGIT, _SMALL, _CAPITAL, _RISE = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = _DIGIT, _SMALL, _CAPITAL


def _spoken(rng: np.random.Generator) -> str:
    """A syllable that can be said."""
    vowel = ["a", "e", "i", "o", "u", "y", "ie", "ou", "ea", "ei", "au", "ai"]
    onset = ["b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "br", "ch", "cr", "dr", "fl", "gr", "ll", "pl", "pr", "qu", "rr", "sch", "sh", "sp", "st", "th", "tr", "z", ""]
    coda = ["", "", "", "n", "r", "s", "t", "l", "m", "nd", "ng", "nt", "st", "ck", "rt", "ss", "mb"]
    return "".join(str(rng.choice(x)) for x in (onset, vowel, coda))


def labelled_findings(n: int = 1500, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """Generated findings: n secrets and 2 * n harmless runs, each with its context."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(str(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "st", "ou", "ie", "que", "ment", "ung"])) for _ in range(int(rng.integers(1, 5))))
    said = lambda: _spoken(rng)
    long = lambda parts: "".join(str(rng.choice([word(), said()])) for _ in range(parts))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 6))))
    out = []
    for _ in range(n):
        k = int(rng.integers(16, 64))
        body = [lambda: pick(lower + upper + digits, k), lambda: pick(lower + upper + digits + "+/", k) + "==", lambda: pick("0123456789abcdef", k), lambda: pick(upper + digits, k), lambda: "sk-" + pick(lower + upper + digits, k), lambda: pick(lower + digits, k), lambda: pick(lower + upper, k), lambda: pick(lower + upper + digits, k // 2) + "." + pick(lower + upper + digits, k // 2)][int(rng.integers(8))]()
        lead = ["", "key ", "Bearer ", "auth: ", "credential=", "private ", '"', "id_token: "][int(rng.integers(8))]
        out.append((prose() + " " + lead, body, " " + prose(), 1))
    for _ in range(2 * n):
        body = [
            lambda: "".join(word() for _ in range(6))[:40] + str(int(rng.integers(10, 2030))),
            lambda: f"{int(rng.integers(1990, 2030))}-{int(rng.integers(10, 13))}-{int(rng.integers(10, 29))}-{word()}-{word()}",
            lambda: "/".join([word(), word(), str(int(rng.integers(10, 99999))), word()]) + "/" + word(),
            lambda: "_".join(word() for _ in range(4)) + "_" + str(int(rng.integers(10, 99))),
            lambda: str(int(rng.integers(1, 10))) * int(rng.integers(16, 40)),
            lambda: "-" * 12 + str(int(rng.integers(10, 999))) + "-" * 12,
            lambda: word().title() + word().title() + word().title() + word().title() + str(int(rng.integers(10, 99))),
            lambda: "".join(str(i % 10) for i in range(int(rng.integers(16, 32)))),
            lambda: long(int(rng.integers(4, 9))),
            lambda: long(int(rng.integers(4, 9))).capitalize(),
            lambda: "-".join(long(2) for _ in range(int(rng.integers(2, 5)))),
            lambda: "/".join(long(1) for _ in range(int(rng.integers(3, 7)))),
            lambda: ".".join(long(2) for _ in range(int(rng.integers(2, 5)))),
            lambda: "".join(long(1).title() for _ in range(int(rng.integers(3, 6)))),
            lambda: str(rng.choice(["-", "=", "_", "/"])) * int(rng.integers(16, 60)),
            lambda: long(int(rng.integers(5, 9))).upper(),
            lambda: pick(digits, 16),
            lambda: pick(digits, int(rng.integers(16, 21))),
            lambda: "".join(word() for _ in range(int(rng.integers(4, 8)))),
            lambda: "".join(long(int(rng.integers(1, 4))).title() for _ in range(int(rng.integers(2, 5)))),
            lambda: long(2) + "".join(long(int(rng.integers(1, 4))).title() for _ in range(int(rng.integers(2, 4)))),
            lambda: "-".join(pick("0123456789abcdef", i) for i in (8, 4, 4, 4, 12)),
            lambda: f"97{rng.integers(8, 10)}-{rng.integers(10)}-{pick(digits, 2)}-{pick(digits, 6)}-{rng.integers(10)}",
            lambda: "-".join(pick(digits, int(rng.integers(2, 5))) for _ in range(5)),
            lambda: f"{rng.choice(['IMG', 'DSC', 'VID', 'scan', 'Screenshot'])}_{rng.integers(1990, 2030)}{pick(digits, 4)}_{pick(digits, 6)}",
            lambda: f"/{rng.integers(1990, 2030)}/{rng.integers(1, 13):02d}/{rng.integers(1, 29):02d}/" + "-".join(word() for _ in range(int(rng.integers(3, 8)))),
            lambda: f"/{word()}/" + "-".join(word() for _ in range(int(rng.integers(3, 8)))) + "-" + pick(digits, int(rng.integers(4, 9))),
            lambda: f"www.{said()}{word()}.{rng.choice(['com', 'org', 'net', 'de'])}/{word()}/{word()}" + str(rng.choice(["", ".html", ".php", "/2021"])),
        ][int(rng.integers(28))]()
        lead = ["", "see ", "page ", "http://", "file ", "ref=", '"', "in "][int(rng.integers(8))]
        out.append((prose() + " " + lead, body if len(body) >= MIN_RUN else body + "-" * (MIN_RUN - len(body)), " " + prose(), 0))
    return out


def short_findings(n: int = 700, seed: int = 6) -> list[tuple[str, str, str, int]]:
    """Generated findings of 8 to 15 characters: n secrets and 2 * n harmless runs."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(str(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "st", "ou", "ie", "que", "ment", "ung", "ka", "lo", "mi"])) if rng.random() < 0.4 else _spoken(rng) for _ in range(int(rng.integers(2, 4))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 6))))
    out = []
    for _ in range(n):
        k = int(rng.integers(SHORT_RUN, MIN_RUN))
        body = pick([lower + upper + digits, lower + digits, upper + digits, lower + upper, lower + upper + digits + "+/_-"][int(rng.integers(5))], k)
        out.append((prose() + " " + ["", "key ", "Bearer ", "auth: ", "credential=", "private ", '"', "login "][int(rng.integers(8))], body, " " + prose(), 1))
    while len(out) < 3 * n:
        body = [
            lambda: word() + str(int(rng.integers(1, 2030))),
            lambda: word().title() + word().title(),
            lambda: word().upper() + "-" + str(int(rng.integers(1, 2030))),
            lambda: word() + "/" + pick(digits, 3),
            lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{word()}",
            lambda: word() + "_" + pick(digits, 2) + "_" + word(),
            lambda: pick(digits, 4) + word(),
            lambda: word() + word().title(),
            lambda: f"20{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 2)}",
            lambda: "IMG_" + pick(digits, int(rng.integers(4, 9))),
            lambda: pick(digits, 3) + "-" + pick(digits, 4) + "-" + word(),
            lambda: "v" + pick(digits, 1) + "-" + word(),
        ][int(rng.integers(12))]()
        if SHORT_RUN <= len(body) < MIN_RUN:
            out.append((prose() + " " + ["", "see ", "page ", "http://", "file ", "ref=", '"', "in "][int(rng.integers(8))], body, " " + prose(), 0))
    return out


@dataclass
class Model:
    taps: np.ndarray  # 256 x WIDTH x FILTERS: embedding times filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    short_threshold: float = 0.5

    def pools(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        gap = b"\0" * WIDTH
        data = np.frombuffer(gap.join([*pieces, b""]) + gap, np.uint8)
        size = np.array([len(p) for p in pieces])
        start = np.cumsum([0, *(size[:-1] + WIDTH)])
        span = len(data) - WIDTH + 1
        conv = np.repeat(self.bias[None], span, 0)
        for j in range(WIDTH):
            conv += self.taps[data[j : j + span], j]
        np.maximum(conv, 0, out=conv)
        bounds = np.stack([start, start + np.maximum(size, 1)], 1).reshape(-1)
        return np.maximum.reduceat(conv, bounds)[::2], np.add.reduceat(conv, bounds)[::2] / np.maximum(size, 1)[:, None], conv, bounds

    def long_pools(self, long: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The pools of one piece, in windows of BLOCK bytes that share WIDTH - 1."""
        top, total = np.full(FILTERS, -np.inf), np.zeros(FILTERS)
        for at in range(0, len(long), BLOCK):
            window = np.frombuffer(long[at : at + BLOCK + WIDTH - 1] + b"\0" * (WIDTH - 1), np.uint8)
            conv = np.repeat(self.bias[None], min(BLOCK, len(long) - at), 0)
            for j in range(WIDTH):
                conv += self.taps[window[j : j + len(conv)], j]
            np.maximum(conv, 0, out=conv)
            top = np.maximum(top, conv.max(0))
            total += conv.sum(0)
        return top[None], total[None] / len(long)

    def raw(self, pieces: list[bytes]) -> np.ndarray:
        parts, at = [np.zeros(0)], 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) < BLOCK):
                size += len(pieces[end])
                end += 1
            top, mean = self.long_pools(pieces[at]) if size > BLOCK else self.pools(pieces[at:end])[:2]
            parts.append(np.concatenate([top, mean], 1) @ self.out + self.out_bias)
            at = end
        return np.concatenate(parts)

    def score(self, pieces: list[bytes]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(pieces) + b, -30, 30)))

    def least(self, size: int) -> float:
        """The score from which a run of `size` characters is marked."""
        return self.threshold if size >= MIN_RUN else self.short_threshold


def piece(data: bytes, start: int, end: int) -> bytes:
    """A candidate and its context, parted by bytes that no text holds."""
    return data[max(0, start - CONTEXT) : start] + b"\x01" + data[start:end] + b"\x02" + data[end : end + CONTEXT]


def train(found: list[tuple[str, str, str, int]] | None = None, ordinary: list[tuple[str, str, str, int]] = (), *, epochs: int = 12, seed: int = 3) -> Model:
    """A model of labelled findings, by default generated ones, and of `ordinary` runs."""
    found = [*(labelled_findings() + short_findings() if found is None else found), *ordinary]
    rng = np.random.default_rng(seed)
    pieces = []
    covers = []  # by finding: the candidates of the search that cover it, None where base spans do
    for before, body, after, _ in found:
        b, c, a = before.encode(), body.encode(), after.encode()
        text, s, e = b + c + a, len(b), len(b) + len(c)
        ((base, runs),) = candidates(*buffers(strings(pa.array([text.decode()]))))
        over = [piece(text, x, y) for x, y in runs if x <= s and e <= y]
        covers.append(None if outreached(s, e, merged(base)) is False else over)
        # as the search meets it, where it does
        pieces.append(over[0] if over else piece(text, s, e))
    y = np.array([f[3] for f in found], float)
    held = rng.random(len(y)) < 0.25
    emb = rng.normal(0, 0.5, (256, DIM))
    filt = rng.normal(0, 0.4, (WIDTH, DIM, FILTERS))
    params = [emb, filt, np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1)]
    mom = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    model = Model(np.einsum("vd,jdf->vjf", params[0], params[1]), params[2], params[3], 0.0)
    step, ends = 0, []
    for epoch in range(epochs):
        for lot in np.array_split(rng.permutation(np.flatnonzero(~held)), max(1, (~held).sum() // 64)):
            some = [pieces[i] for i in lot]
            top, mean, conv, bounds = model.pools(some)
            z = np.concatenate([top, mean], 1)
            g = (1 / (1 + np.exp(-np.clip(z @ params[3] + params[4][0], -30, 30))) - y[lot]) / len(lot)
            gz = g[:, None] * params[3]
            gconv = np.zeros_like(conv)
            for i, (s, e) in enumerate(bounds.reshape(-1, 2)):
                gconv[s:e] += gz[i, FILTERS:] / (e - s)
                gconv[s + conv[s:e].argmax(0), np.arange(FILTERS)] += gz[i, :FILTERS]
            gconv *= conv > 0
            data = np.frombuffer((b"\0" * WIDTH).join([*some, b""]) + b"\0" * WIDTH, np.uint8)
            grads = [np.zeros_like(emb), np.zeros_like(filt), gconv.sum(0), z.T @ g, np.array([g.sum()])]
            one_hot = np.zeros((len(data), 256), np.float32)
            one_hot[np.arange(len(data)), data] = 1
            for j in range(WIDTH):
                by_byte = one_hot[j : j + len(conv)].T @ gconv.astype(np.float32)
                grads[1][j] = params[0].T @ by_byte
                grads[0] += by_byte @ params[1][j].T
            step += 1
            rate = 0.01 * (1 - epoch / (epochs + 1))
            for q, gq, (m, v) in zip(params, grads, mom, strict=True):
                m += 0.1 * (gq - m)
                v += 0.001 * (gq * gq - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model = Model(np.einsum("vd,jdf->vjf", params[0], params[1]), params[2], params[3], float(params[4][0]))
        if epoch >= epochs - 4:
            ends.append([q.copy() for q in params])
    emb, filt, bias, out, out_bias = (np.mean(q, 0) for q in zip(*ends, strict=True))  # of the last epochs
    model = Model(np.einsum("vd,jdf->vjf", emb, filt), bias, out, float(out_bias[0]))
    raw = model.raw([pieces[i] for i in np.flatnonzero(held)])
    model.scale = platt(raw, y[held], np.ones(int(held.sum())))
    long = np.array([len(f[1]) >= MIN_RUN for f in found])
    model.threshold, model.short_threshold = (recalled(model, [covers[i] for i in np.flatnonzero(held & (y == 1) & some)], recall) for some, recall in ((long, MIN_RECALL), (~long, SHORT_RECALL)))
    return model


def recalled(model: Model, covers: list[list[bytes] | None], recall: float) -> float:
    """The highest threshold that keeps `recall` over secrets, each with the candidates
    that cover it; None where base spans do."""
    good = np.sort([2.0 if x is None else max(model.score(x), default=-1.0) for x in covers])
    return float(np.clip(good[int((1 - recall) * len(good))], 0, 1)) if len(good) else 0.5


def _ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arr = strings(batch.column(0))
        out = []
        for lo, hi in groups(arr):
            data, off = buffers(arr.slice(lo, hi - lo))
            for i, (_, runs) in enumerate(candidates(data, off)):
                for s, e in runs:
                    if e - s <= ORDINARY_BYTES:
                        text = data[off[i] + max(0, s - CONTEXT) : min(off[i] + e + CONTEXT, off[i + 1])].tobytes()
                        b = min(s, CONTEXT)
                        out.append((text[:b].decode(errors="ignore"), text[b : b + e - s].decode(), text[b + e - s :].decode(errors="ignore")))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], ["before", "body", "after"])


def ordinary_runs(docs: DataFrame) -> list[tuple[str, str, str, int]]:
    """At most ORDINARY distinct runs outside base spans, each with one of its contexts,
    from the documents whose hash lies under a threshold for about ORDINARY_DOCS rows."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    if n > ORDINARY_DOCS:
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(ORDINARY_DOCS / n * (1 << 40)))
    runs = docs.select("text").mapInArrow(_ordinary, "before string, body string, after string")
    runs = runs.groupBy("body").agg(F.min(F.struct("before", "after")).alias("c"))
    rows = runs.orderBy(F.xxhash64("body"), "body").limit(ORDINARY).collect()
    return [(r.c.before, r.body, r.c.after, 0) for r in rows]


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of one text's base findings, in order."""
    out = []
    if b":" in data or b"=" in data:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(data.translate(_LOWER)) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(data) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


def merged(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches under base spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in sorted(base):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def outreached(start: int, end: int, under: tuple[list[int], list[int]]) -> bool:
    """Whether start..end holds a byte under no base span."""
    i = bisect_right(under[0], start) - 1
    return i < 0 or under[1][i] < end


def _mixed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether data[starts[i]:ends[i]] holds digits and letters, or a capital after a
    small letter."""
    if not len(starts):
        return np.zeros(0, bool)
    kind = np.append(_CLASS[data], np.uint8(0))
    kind[1:][(kind[:-1] == _SMALL) & (kind[1:] == _CAPITAL)] |= _RISE
    held = np.bitwise_or.reduceat(kind, np.stack([starts, ends], 1).reshape(-1))[::2]
    return ((held & _DIGIT > 0) & (held & (_SMALL | _CAPITAL) > 0)) | (held & _RISE > 0)


def candidates(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """For each text, in order: its base findings, and the token runs that outreach them, in bytes."""
    starts, ends, at = words(data, off, _RUN_GAP)
    keep = ends - starts >= MIN_RUN
    short = np.flatnonzero((ends - starts >= SHORT_RUN) & ~keep)
    keep[short] = _mixed(data, starts[short], ends[short])
    long = np.flatnonzero(keep)
    by_text = np.searchsorted(long, at)
    starts_d, ends_d, at_d = words(data, off, _DOTTED_GAP)
    long_d = np.flatnonzero(ends_d - starts_d >= MIN_RUN)
    by_text_d = np.searchsorted(long_d, at_d)
    for i in range(len(off) - 1):
        lo, hi = int(off[i]), int(off[i + 1])
        runs = [(int(starts[x]) - lo, int(ends[x]) - lo) for x in long[by_text[i] : by_text[i + 1]]]
        found: list[tuple[int, int, int]] = []
        text = data[lo:hi].tobytes()
        if b":" in text or b"=" in text:
            found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text.translate(_LOWER)) if m.end(2) - m.start(2) >= 6]
        for s, e in runs:  # digits and capitals of the other kinds lie within such runs
            run = text[s:e]
            if b"AKIA" in run:
                found += [(s + m.start(), s + m.end(), 1) for m in _ACCESS.finditer(run) if m.end() - m.start() >= 20]
            if e - s >= 24:
                found += [(s + m.start(), s + m.end(), 2) for m in _HEX.finditer(run) if m.end() - m.start() >= 24]
        for x in long_d[by_text_d[i] : by_text_d[i + 1]]:
            s, e = int(starts_d[x]) - lo, int(ends_d[x]) - lo
            run = text[s:e]
            s, e = s + len(run) - len(run.lstrip(b".")), e - len(run) + len(run.rstrip(b"."))
            if e - s >= MIN_RUN and b"." in text[s:e]:
                runs.append((s, e))
        under = merged(found)
        yield found, [(s, e) for s, e in runs if outreached(s, e, under)]


def scan(arr: pa.Array, model: Model) -> Iterator[list[tuple[int, int, int, float]]]:
    """For each text of a group, in order: (start, end, kind, score) in code points."""
    data, off = buffers(arr)
    asked, where = [], []
    for i, (found, runs) in enumerate(candidates(data, off)):
        found = sorted([*found, *((s, e, 3) for s, e in runs)], key=lambda f: (f[0], f[2], f[1]))
        if found:
            text = data[off[i] : off[i + 1]].tobytes()
        for f in found:
            asked.append(piece(text, f[0], f[1]))
            where.append((i, f))
    scores = model.score(asked) if asked else np.zeros(0)
    by_row: dict[int, list] = {}
    for (i, f), s in zip(where, scores, strict=True):
        if f[2] < 3 or s >= model.least(f[1] - f[0]):
            by_row.setdefault(i, []).append((*f, float(s)))
    for i in range(len(off) - 1):
        found = by_row.get(i, [])
        if not found:
            yield []
            continue
        first = (data[off[i] : off[i + 1]] & 0xC0) != 0x80
        points = np.concatenate(([0], np.cumsum(first)))
        yield [(int(points[s]), int(points[e]), kind, score) for s, e, kind, score in found]


def join(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, *_ in spans)


def redact(text: str, spans: list) -> str:
    """text with every stretch under a span replaced by MARK."""
    out, at, until = [], 0, -1
    for s, e, *_ in sorted(spans):
        if s >= until:
            out += [text[at:s], MARK]
            until = e
        until = max(until, e)
        at = until
    return "".join([*out, text[at:]])


def _digests(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model.value)
        for batch in batches:
            ids, text = columns(batch, "doc_id", "text")
            arr = strings(text)
            n, sha, joined, top = [[], [], []], [], [], []
            for lo, hi in groups(arr):
                for spans in scan(arr.slice(lo, hi - lo), m):
                    for k in range(3):
                        n[k].append(sum(s[2] == k for s in spans))
                    sha.append(hashlib.sha256(join([s for s in spans if s[2] < 3]).encode()).hexdigest())
                    joined.append(join(spans))
                    top.append([s[3] for s in spans])
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(joined, pa.string()), pa.array(top, pa.list_(pa.float64()))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    return run


def _send(docs: DataFrame, model: Model | None):
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps(model or train(ordinary=ordinary_runs(docs))))


def scanned(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, counts and digest of base spans, all spans, their scores."""
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return asked.mapInArrow(_digests(_send(docs, model)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>")


def _findings(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model.value)
        for batch in batches:
            ids, text = columns(batch, "doc_id", "text")
            arr = strings(text)
            out, at = [], 0
            for lo, hi in groups(arr):
                for spans in scan(arr.slice(lo, hi - lo), m):
                    if spans:
                        whole = arr[at].as_py()
                        out += [(ids[at].as_py(), KINDS[k], s, e, score, whole[s:e]) for s, e, k, score in spans]
                    at += 1
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["doc_id", "kind", "start", "end", "score", "found"])

    return run


def findings(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each span: doc_id, kind, start, end, score, found (its text); every
    row of docs gives its own, repeated and null ids too."""
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return asked.mapInArrow(_findings(_send(docs, model)), "doc_id long, kind string, start long, end long, score double, found string")


def _redacted(model, n_chars: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            arr = strings(batch.column(at))
            texts = batch.column(at).to_pylist()
            hit = set()
            row = 0
            for lo, hi in groups(arr):
                for spans in scan(arr.slice(lo, hi - lo), m):
                    if spans:
                        texts[row] = redact(texts[row], spans)
                        hit.add(row)
                    row += 1
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if n_chars:
                c = batch.schema.get_field_index("n_chars")
                old = cols[c].to_pylist()
                cols[c] = pa.array([len(texts[i]) if i in hit else old[i] for i in range(len(texts))], cols[c].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return run


def without_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every found secret replaced by MARK; n_chars, where it is, follows."""
    return docs.mapInArrow(_redacted(_send(docs, model), "n_chars" in docs.columns), docs.schema)
