"""LM scoring: a gated recurrent language model beside exact unigram counts.

Tokens of a text are its white-space words (A-Z lowered), then one end.  Counts of
all training tokens come from a pass over every training text and a shuffle; the
score of a document under them is a sum over all its tokens.  The HOT commonest
words (a fixed bound) and the number of ends are sent to all tasks; the other words of each document
meet their counts in a join, so nothing is approximated.

The model is a gated recurrent network over the VOCAB commonest tokens.  Its
softmax is factored into CLASSES of equal size by frequency: the probability of
the class, then of the word in the class.  Other words are one token, unknown,
times their share among such words in training where they are among the HOT
words, plus what is left (at least LEFT) times the probability of their spelling
under a byte-pair chain with an end, so the words of a place share at most a
probability of 1.  Truncated backpropagation in numpy trains it on every training
text: from a start on the driver (TRAIN_DOCS documents, the first by a hash of the
id, of longer ones a stretch of START_CHARS at a place by that hash) each task goes
on over all whole texts of its own partition, and the weights are averaged by
tokens, FAN tasks at a time in levels; byte pairs are counted over all of them.
Weights hang on how the input is partitioned, as sums of floats do.  Scoring runs documents through
lanes, window by window; a lane carries its state across windows and starts anew
with each document, so a log-likelihood is that of the complete document.

Defined cases: a null or empty text is the end alone; a null doc_id trains and is
not held out; repeated rows count and are scored each (the start takes the largest
text of an id, so reruns agree); without training texts all
counts are 0 and the model is untrained; extra columns are not touched.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import first_by_hash, fold, largest, table
from gistmill.llm.kernel import LOWER, Lookup, buffers, columns, gathered, groups, hashes, strings, words

CLASSES = 48
VOCAB = CLASSES * CLASSES
HIDDEN = 24
DIM = 16
HOT = 131_072
TRAIN_DOCS = 1_200
PASS_RATE = 0.004
START_CHARS = 16_384
CHUNKS = 32
FAN = 64
LEFT = 1e-3
WINDOW = 32
LANES = 256
END_HASH = np.uint64(0x5EED0F7E17E17E15)
UNKNOWN, END = 0, 1
_GROUP = 8 << 20
_FLUSH = 2_000_000
_ONES = np.ones(VOCAB, np.float32)  # sums of rows and columns as products


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([p[1] for p in parts])[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n, at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c): token hashes and how often this task met them."""

    def emit(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "c"])

    parts, size, ends = [], 0, 0
    for batch in batches:
        arr = strings(batch.column(0))
        ends += len(arr)
        for lo, hi in groups(arr):
            data, off = buffers(arr.slice(lo, hi - lo))
            starts, stops, _ = words(data, off)
            if len(starts):
                parts.append(np.unique(hashes(data, starts, stops), return_counts=True))
                size += len(parts[-1][0])
            if size > _FLUSH:
                parts = [_merge(parts)]
                size = len(parts[0][0])
                if size > _FLUSH // 2:
                    yield emit(*parts.pop())
                    size = 0
    if parts:
        yield emit(*_merge(parts))
    if ends:
        yield emit(np.array([END_HASH]), np.array([ends]))


class Model:
    """Parameters, training and scoring of the network."""

    def __init__(self, vocab: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.lookup = Lookup(vocab)
        # ids by frequency: vocab comes commonest first; unknown and end go before
        rank = {int(h): i + 2 for i, h in enumerate(vocab)}
        self.ids = np.array([rank[int(h)] for h in self.lookup.keys], np.int32)
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2]), s).astype(np.float32)
        self.p = {
            "e": rng.normal(0, 0.3, (VOCAB, DIM)).astype(np.float32), "w": f(DIM, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "u": f(HIDDEN, 3 * HIDDEN),
            "wc": f(HIDDEN, CLASSES), "bc": np.zeros(CLASSES, np.float32), "wo": f(CLASSES, HIDDEN, CLASSES), "bo": np.zeros((CLASSES, CLASSES), np.float32),
        }
        self.spell = np.zeros((257, 257))

    def tokens(self, h: np.ndarray) -> np.ndarray:
        pos = self.lookup.find(h)
        out = np.zeros(len(h), np.int32)
        ok = pos >= 0
        out[ok] = self.ids[pos[ok]]
        return out

    @staticmethod
    def byte_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of byte pairs of words, from a start (256) to an end (256)."""
        n = np.zeros(257 * 257)
        for at in range(0, len(starts), 1 << 16):
            s, size = starts[at : at + (1 << 16)], ends[at : at + (1 << 16)] - starts[at : at + (1 << 16)]
            # each word with a place after it for the end, and the end of the word before as its start
            chars = np.full(int(size.sum()) + len(s) + 1, 256, np.int64)
            word = np.repeat(np.arange(len(s)), size)
            place = np.arange(int(size.sum()))
            chars[1 + place + word] = LOWER[data[place - np.repeat(np.cumsum(size) - size, size) + s[word]]]
            n += np.bincount(chars[:-1] * 257 + chars[1:], minlength=257 * 257)
        return n.reshape(257, 257)

    def fit_spelling(self, n: np.ndarray) -> None:
        """Chain of the unknown words from counts of their byte pairs."""
        n = n + 0.02
        self.spell = np.log(n / n.sum(1, keepdims=True))

    def spelling(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(starts)), 0
        while at < len(starts):  # in pieces of about a megabyte
            lo = starts[at]
            end = max(int(np.searchsorted(ends, lo + (1 << 20), "right")), at + 1)
            low = LOWER[data[lo : ends[end - 1]]].astype(np.int64)
            s, e = starts[at:end] - lo, ends[at:end] - lo
            chain = np.zeros(len(low) + 1)
            chain[2:] = np.cumsum(self.spell[low[:-1], low[1:]])
            out[at:end] = self.spell[256, low[s]] + chain[e] - chain[s + 1] + self.spell[low[e - 1], 256]
            at = end
        return out

    def steps(self, x: np.ndarray, h: np.ndarray, table_: np.ndarray, keep: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states (time, lanes, hidden) for inputs x (lanes, time), and the last;
        keep: by time, takes the states before, gates, candidates and their recurrent parts."""
        u, n = self.p["u"], HIDDEN
        out = np.empty((x.shape[1], len(x), n), np.float32)
        for t in range(x.shape[1]):
            ids = x[:, t]
            at = [k[t] for k in keep] if keep else [None] * 4
            h = np.multiply(h, (ids != END)[:, None], out=at[0])
            a = table_[ids]
            r = h @ u
            g = np.add(a[:, : 2 * n], r[:, : 2 * n], out=at[1])
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, rn = g[:, :n], r[:, 2 * n :]
            c = np.multiply(g[:, n:], rn, out=at[2])
            c += a[:, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                at[3][:] = rn
            h = h - c
            h *= z
            h += c
            out[t] = h
        return out, h

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of the token y after each state h."""
        p = self.p
        order = np.argsort(y // CLASSES, kind="stable")
        h, y = h[order], y[order]
        cls, rows = y // CLASSES, np.arange(len(y))
        logit = h @ p["wc"]
        logit += p["bc"]
        got = logit[rows, cls]
        total = np.exp(logit, out=logit) @ _ONES[:CLASSES]
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            some = slice(cuts[c], cuts[c + 1])
            np.matmul(h[some], p["wo"][c], out=logit[some])
            logit[some] += p["bo"][c]
        got += logit[rows, y % CLASSES]
        total *= np.exp(logit, out=logit) @ _ONES[:CLASSES]
        out = np.empty_like(got)
        out[order] = got - np.log(total)
        return out

    @staticmethod
    def _softmax(logit: np.ndarray, want: np.ndarray, count: int) -> tuple[np.ndarray, float]:
        """Gradient of the mean loss over `count` by the logits (in their place), and
        the summed loss."""
        rows = np.arange(len(want))
        own = logit[rows, want]
        np.exp(logit, out=logit)
        total = logit @ _ONES[:CLASSES]
        logit *= (1 / (total * np.float32(count)))[:, None]
        logit[rows, want] -= np.float32(1 / count)
        return logit, float((np.log(total) - own).sum(dtype=np.float64))

    def gradients(self, x: np.ndarray, y: np.ndarray, h0: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Truncated backpropagation over one window."""
        p, n = self.p, HIDDEN
        kept = [np.empty((x.shape[1], len(x), k * n), np.float32) for k in (1, 2, 1, 1)]
        hs, last = self.steps(x, h0, p["e"] @ p["w"] + p["b"], kept)
        want = y.T.reshape(-1)
        order = np.argsort(want // CLASSES, kind="stable")  # all by class from here
        flat, want = hs.reshape(-1, n)[order], want[order]
        cls = want // CLASSES
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        met = [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]
        g = {k: np.zeros_like(v) for k, v in p.items() if k in ("wo", "bo")}
        d, loss = self._softmax(flat @ p["wc"] + p["bc"], cls, len(want))
        ones = np.ones(len(want), np.float32)
        g["wc"], g["bc"] = flat.T @ d, ones @ d
        to_states = d @ p["wc"].T
        inner = np.empty((len(want), CLASSES), np.float32)
        for c, rows in met:
            np.matmul(flat[rows], p["wo"][c], out=inner[rows])
            inner[rows] += p["bo"][c]
        d, more = self._softmax(inner, want % CLASSES, len(want))
        loss += more
        for c, rows in met:
            np.matmul(flat[rows].T, d[rows], out=g["wo"][c])
            to_states[rows] += d[rows] @ p["wo"][c].T
            g["bo"][c] = ones[rows] @ d[rows]
        dh_all = np.empty_like(to_states)
        dh_all[order] = to_states
        dh_all = dh_all.reshape(hs.shape)
        h, gate, c, rn = kept
        z, r = np.ascontiguousarray(gate[:, :, :n]), np.ascontiguousarray(gate[:, :, n:])
        open_ = 1 - z
        by_c, by_z, by_r = (1 - c * c) * open_, (h - c) * z * open_, rn * r * (1 - r)
        goes_on = (x.T != END)[:, :, None]
        dh = np.zeros_like(h0)
        by_step = np.empty((x.shape[1], len(x), 3 * n), np.float32)
        back = np.empty_like(by_step)
        u = np.ascontiguousarray(p["u"].T)
        for t in range(x.shape[1] - 1, -1, -1):
            dh += dh_all[t]
            dc = dh * by_c[t]
            at, to = by_step[t], back[t]
            np.multiply(dh, by_z[t], out=at[:, :n])
            np.multiply(dc, by_r[t], out=at[:, n : 2 * n])
            at[:, 2 * n :] = dc
            to[:, : 2 * n] = at[:, : 2 * n]
            np.multiply(dc, r[t], out=to[:, 2 * n :])
            dh *= z[t]
            dh += to @ u
            dh *= goes_on[t]
        g["u"] = h.reshape(-1, n).T @ back.reshape(-1, 3 * n)
        by_step, tokens = by_step.reshape(-1, 3 * n), x.T.reshape(-1)
        g["b"], g["w"], g["e"] = ones @ by_step, p["e"][tokens].T @ by_step, np.zeros_like(p["e"])
        to_tokens = by_step @ p["w"].T  # DIM numbers a token are added up, not 3 * HIDDEN
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        cuts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        g["e"][tokens[cuts]] = np.add.reduceat(to_tokens[order], cuts)
        return g, last, loss / len(want)

    def train(self, texts: list[np.ndarray], *, epochs: int = 2, lanes: int = 48, window: int = 20, seed: int = 2, first: float = 0.01, last: float = 0.002, state: dict | None = None) -> list[float]:
        """texts: token ids without the end; returns the loss by window.  The rate
        falls from first to last; `state` carries the moments to a next call."""
        if not texts:
            return []
        rng = np.random.default_rng(seed)
        state = {} if state is None else state
        mom = state.setdefault("mom", {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()})
        step, losses = state.get("step", 0), []
        for epoch in range(epochs):
            stream = np.concatenate([np.array([END], np.int32), *(np.append(texts[i], END).astype(np.int32) for i in rng.permutation(len(texts)))])
            used = min(lanes, len(stream) - 1)
            width = -(-(len(stream) - 1) // used)
            x = np.resize(stream[:-1], (used, width))  # filled up from the front
            y = np.resize(stream[1:], (used, width))
            h = np.zeros((used, HIDDEN), np.float32)
            for a in range(0, width, window):
                g, h, loss = self.gradients(x[:, a : a + window], y[:, a : a + window], h)
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                rate = first + (last - first) * (epoch + a / width) / epochs
                for k, v in g.items():
                    m, s = mom[k]
                    v *= min(1.0, 1.0 / max(norm, 1e-9))
                    m += 0.1 * (v - m)
                    s += 0.001 * (v * v - s)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        state["step"] = step
        return losses

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By text (tokens at[i]..at[i + 1] of ids, then the end): the natural log of
        its probability, unknown words as such."""
        n = len(at) - 1
        size = np.diff(at) + 1
        count = min(LANES, n)
        heap = [(0, i) for i in range(count)]
        placed: list[list[int]] = [[] for _ in range(count)]
        for d in np.argsort(-size, kind="stable"):
            have, lane = heapq.heappop(heap)
            placed[lane].append(int(d))
            heapq.heappush(heap, (have + int(size[d]), lane))
        placed.sort(key=lambda p: -sum(size[d] for d in p))
        # lanes one after another, each text from an end to its end: as long as all texts together
        texts = np.array([d for p in placed for d in p], np.int64)
        begin = np.cumsum(size[texts]) - size[texts]
        x = np.full(int(size.sum()), END, np.int32)
        x[np.arange(len(ids)) + np.repeat(begin + 1 - (np.cumsum(size[texts] - 1) - (size[texts] - 1)), size[texts] - 1)] = ids[np.arange(len(ids)) + np.repeat(at[texts] - (np.cumsum(size[texts] - 1) - (size[texts] - 1)), size[texts] - 1)]
        length = np.array([sum(int(size[d]) for d in p) for p in placed])
        lane = np.cumsum(length) - length
        y = np.append(x[1:], END).astype(np.int32)
        y[begin + size[texts] - 1] = END
        log = np.zeros(len(x), np.float32)
        table_ = self.p["e"] @ self.p["w"] + self.p["b"]
        h = np.zeros((count, HIDDEN), np.float32)
        for a in range(0, int(length[0]), WINDOW):
            live = int(np.searchsorted(-length, -a, "left"))
            steps = np.arange(a, min(a + WINDOW, int(length[0])))
            inside = steps < length[:live, None]
            where = np.where(inside, lane[:live, None] + steps, 0)
            hs, h = self.steps(np.where(inside, x[where], END), h[:live], table_)
            inside, where = inside.T.reshape(-1), where.T.reshape(-1)
            where = where[inside]
            log[where] = self.log_probs(hs.reshape(-1, HIDDEN)[inside], y[where])
        out = np.zeros(n)
        out[texts] = np.add.reduceat(log.astype(np.float64), begin)
        return out


def shares(counts: np.ndarray, others: float) -> tuple[np.ndarray, float]:
    """Each word's share of the unknown token, and what is left for all spellings; 1 in all."""
    share = counts / max(1.0, others)
    share *= min(1.0, (1 - LEFT) / max(share.sum(), LEFT))
    return share, 1 - share.sum()


def _score(sent, z: float, others: float, n_ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hot, counts = pickle.loads(sent.value)
        hot = Lookup(hot)
        weight = np.log10((counts + 0.5) / z)
        outside = model.tokens(hot.keys) == UNKNOWN
        share, left = shares(np.where(outside, counts, 0), others)
        end_weight, end_known = np.log10((n_ends + 0.5) / z), int(n_ends > 0)
        uid = TaskContext.get().partitionId() << 33
        for batch in gathered(batches, _GROUP):
            ids, text = columns(batch, "doc_id", "text")
            arr = strings(text)
            n, known, base, score, cuts, tail = [], [], [], [], [np.zeros(1, np.int64)], []
            for lo, hi in groups(arr, _GROUP):
                data, off = buffers(arr.slice(lo, hi - lo))
                starts, ends, at = words(data, off)
                h = hashes(data, starts, ends)
                tokens = model.tokens(h)
                owner = np.repeat(np.arange(hi - lo), np.diff(at))
                pos = hot.find(h)
                ok = pos >= 0
                base.append(np.bincount(owner[ok], weights=weight[pos[ok]], minlength=hi - lo) + end_weight)
                known.append(np.bincount(owner[ok], minlength=hi - lo) + end_known)
                tail.append(h[~ok])
                cuts.append(np.cumsum(np.bincount(owner[~ok], minlength=hi - lo)) + cuts[-1][-1])
                odd = np.flatnonzero(tokens == UNKNOWN)
                known_share = np.where(ok[odd], share[pos[odd]], 0.0) if len(share) else np.zeros(len(odd))
                as_unknown = np.logaddexp(np.log(left) + model.spelling(data, starts[odd], ends[odd]), np.log(np.maximum(known_share, 1e-300)))
                spelt = np.bincount(owner[odd], weights=as_unknown, minlength=hi - lo)
                score.append((model.score(tokens, at) + spelt) / np.log(10))
                n.append(np.diff(at) + 1)
            if not n:
                continue
            join = np.concatenate
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + len(arr))), ids, pa.array(join(n)), pa.array(join(known)), pa.array(join(base)), pa.array(join(score)), pa.ListArray.from_arrays(pa.array(join(cuts).astype(np.int32)), pa.array(join(tail).view(np.int64)))],
                ["uid", "doc_id", "n_tokens", "known", "base", "score", "tail"],
            )
            uid += len(arr)

    return run


def _encoded(model: Model, arr: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Token ids of each text, and the byte pairs of unknown words."""
    texts, pairs = [], np.zeros((257, 257))
    for lo, hi in groups(arr):
        data, off = buffers(arr.slice(lo, hi - lo))
        starts, ends, at = words(data, off)
        ids = model.tokens(hashes(data, starts, ends))
        texts += [ids[at[i] : at[i + 1]] for i in range(hi - lo)]
        odd = ids == UNKNOWN
        pairs += model.byte_pairs(data, starts[odd], ends[odd])
    return texts, pairs


def _train(sent):
    """(chunk, part, v): a task's weights times its tokens, then its tokens and byte pairs, in CHUNKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state, tokens, pairs = pickle.loads(sent.value), {}, 0, np.zeros((257, 257))
        for batch in gathered(batches, _GROUP):
            texts, some = _encoded(model, strings(batch.column(0)))
            lanes = min(max(sum(map(len, texts)) // 2_000, 48), LANES)  # small inputs take more, smaller steps
            model.train(texts, epochs=1, lanes=lanes, first=PASS_RATE, last=PASS_RATE, state=state)
            tokens += sum(map(len, texts)) + len(texts)
            pairs += some
        if tokens:
            flat = np.concatenate([*(model.p[k].reshape(-1).astype(float) * tokens for k in sorted(model.p)), [tokens], pairs.reshape(-1)])
            cuts = np.linspace(0, len(flat), CHUNKS + 1).astype(np.int32)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["chunk", "part", "v"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    total = sum(np.asarray(v.values) for v in rows["v"])
    return pa.table({"chunk": rows["chunk"][:1], "part": rows["to"][:1], "v": pa.array([total], pa.list_(pa.float64()))})


def summed(sums: DataFrame) -> DataFrame:
    """(chunk, part, v) added up by chunk: FAN parts at a time, level by level, so no
    group grows with the number of parts."""
    most = sums.agg(F.max("part")).first()[0]
    while most:
        sums = sums.withColumn("to", F.expr(f"cast(part div {FAN} as int)"))
        sums = sums.groupBy("chunk", "to").applyInArrow(_added, "chunk int, part int, v array<double>")
        most //= FAN
    return sums


def start_texts(training: DataFrame) -> pa.Table:
    """(doc_id, text) of TRAIN_DOCS documents, each text at most START_CHARS long."""
    ids = F.broadcast(first_by_hash(training.where("doc_id is not null").select("doc_id").distinct(), TRAIN_DOCS, "doc_id"))  # TRAIN_DOCS ids
    over = F.greatest(F.length("text") - START_CHARS, F.lit(0)) + 1
    part = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id"), over) + 1).cast("int"), F.lit(START_CHARS))
    return training.join(ids, "doc_id").select("doc_id", part.alias("text")).groupBy("doc_id").agg(F.max("text").alias("text")).toArrow().sort_by("doc_id")


def fit(training: DataFrame, vocab: np.ndarray) -> Model:
    """Start on stretches of at most TRAIN_DOCS rows, then train on all rows."""
    model = Model(vocab)
    model.train(_encoded(model, strings(start_texts(training)["text"]))[0])
    sent = training.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    sums = table(training.select("text").mapInArrow(_train(sent), "chunk int, part int, v array<double>"), "sums")
    sums = summed(sums).toArrow().sort_by("chunk")  # CHUNKS rows
    if not len(sums):
        model.fit_spelling(np.zeros((257, 257)))
        return model
    flat = np.concatenate([np.asarray(v.values) for v in sums["v"]])
    model.fit_spelling(flat[-257 * 257 :].reshape(257, 257))
    tokens, at = flat[-257 * 257 - 1], 0
    for k in sorted(model.p):
        v = model.p[k]
        model.p[k] = (flat[at : at + v.size] / tokens).reshape(v.shape).astype(np.float32)
        at += v.size
    return model


def scored(docs: DataFrame, *, left_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(fold(F.col("doc_id")) != left_out)
    counts = table(training.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = int(np.array(END_HASH).view(np.int64))
    ends = counts.where(F.col("h") == end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = largest(counts.where(F.col("h") != end), "c", HOT, fill="h").toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    hot, n = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(float)
    common = hot[: VOCAB - 2]
    others = float(total - ends - n[: VOCAB - 2].sum())  # training tokens outside the vocabulary
    model = fit(training, common)
    order = np.argsort(hot)
    z = total + 0.5 * (kinds + 1)
    sent = spark.sparkContext.broadcast(pickle.dumps((model, hot[order], n[order])))
    rows = table(docs.mapInArrow(_score(sent, z, others, ends), "uid long, doc_id long, n_tokens long, known long, base double, score double, tail array<long>"), "scored")
    rest = rows.select("uid", F.explode("tail").alias("h")).join(counts, "h", "left")
    rest = rest.groupBy("uid").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(z))).alias("more"), F.count("c").alias("met"))
    out = rows.drop("tail").join(rest, "uid", "left")
    return out.select("doc_id", (fold(F.col("doc_id")) == left_out).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
