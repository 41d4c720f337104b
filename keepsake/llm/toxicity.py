"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the embedding of its hash and the mean embedding of its hashed character pieces; a long word, such as a
passage in a script without spaces, is read as several. The network reads runs of ``RUN`` words in both directions. Runs
start every ``WINDOW`` words, so that each window of ``WINDOW`` words, at whatever word it starts, stands whole in a run:
a word is read in two runs instead of in each of its 32 windows. Every window is pooled by attention over the states of
its own words, and a linear layer gives its logit. A text's logit is the largest of all its overlapping windows, one at
every word, set to a probability by a logistic curve of two parameters.

Labels are of documents, so windows to learn from are found first: words and word starts get log odds from the
training sample, a toxic document's windows with the highest odds are positive, those of clean documents negative, and
other windows of toxic documents are not used. The sample is bounded: ``SAMPLE`` documents of each label, ``SAMPLE_WINDOWS``
windows of each (a toxic document's by odds, a clean one's by a seeded hash), taken ``SAMPLE_STRIDE`` words apart, and
``POSITIVE``, ``NEGATIVE`` and ``HARD`` windows an epoch. Its texts stay on the executors: words are counted, windows are
cut and the quarter that the network doesn't see is scored there, to set the curve by whole texts; the driver gets log
odds, windows and logits. Scoring has no bounds and no stride: it covers the windows at every start of every whole text.

Defined results: a null text is empty; a text without words scores like the median of clean tuning texts; with
no usable labels, or only one of the two, the score is the share of label 1 (0 without any); held_out is false where
doc_id is null; repeated rows are scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, in_slices, read, written
from .labelled import held_out, sample

#: Labelled documents of each label that are learned from, and windows of each, at most.
SAMPLE, SAMPLE_WINDOWS = {0: 2500, 1: 2000}, 64
WINDOW, RUN, SAMPLE_STRIDE = 32, 64, 24
#: Windows an epoch learns from, at most: of toxic documents, of clean ones, and of clean ones that look worst so far.
POSITIVE, NEGATIVE, HARD = 4000, 5000, 3000
#: Rounds over the windows, and steps that are taken at least, as small samples have few windows.
EPOCHS, LEAST_STEPS = 6, 400
#: Made-up words of clean windows.
UNSEEN = 512
WORD_ROWS, CHAR_ROWS, WORD_SIZE, CHAR_SIZE, HIDDEN = 8192, 8192, 12, 20, 8
TRIGRAMS, THRESHOLD, SEED = 12, 0.7, 7
#: Bytes of a word whose trigrams, with a mark at either end, are just so many.
LONGEST = TRIGRAMS + 1
#: Words a scorer remembers, and runs it reads at a time.
KNOWN_WORDS, BATCH_RUNS = 60_000, 512
TOKEN = re.compile(r"[^\W_]+")


def pieces(word: str) -> list[str]:
    """A word of at most ``LONGEST`` bytes as it is; a longer one as runs of as many of its characters as fit.

    A run starts with the last characters, three bytes or more, of the one before, so that each four bytes of the word
    stand whole in some run."""
    sizes = [len(c.encode()) for c in word]
    if sum(sizes) <= LONGEST:
        return [word]
    out, at = [], 0
    while True:
        end, size = at, 0
        while end < len(word) and size + sizes[end] <= LONGEST:
            size += sizes[end]
            end += 1
        out.append(word[at:end])
        if end == len(word):
            return out
        back = 0
        while back < 3:  # so many bytes of this run stand in the next one too
            end -= 1
            back += sizes[end]
        at = end


def tokens(text: str) -> list[str]:
    """The words of a text, long ones in pieces, so that each character is read."""
    found = TOKEN.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST and text.isascii():
        return found
    out: list[str] = []
    for w in found:
        if len(w) <= LONGEST // 4 or (len(w) <= LONGEST and len(w.encode()) <= LONGEST):
            out.append(w)
        else:
            out += pieces(w)
    return out


def starts_of(n: int, window: int = WINDOW, stride: int = SAMPLE_STRIDE) -> np.ndarray:
    """Starts of the windows to learn from: every stride of n words, and one that ends with the text."""
    return np.unique(np.append(np.arange(0, max(1, n - window + 1), stride), max(0, n - window)))


def word_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash rows of words, and of their pieces of four bytes filled up with the last row, which is zero."""
    own = np.array([zlib.crc32(w.encode()) % WORD_ROWS for w in words], dtype=np.int32)
    marked = [f"<{w}>".encode() for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    data = np.frombuffer(b"".join(marked) + bytes(TRIGRAMS + 4), dtype=np.uint8).astype(np.uint32)
    four = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    place = np.arange(TRIGRAMS)[None, :] + (np.cumsum(sizes) - sizes)[:, None]
    piece = four[place] & np.where(sizes < 4, (1 << 8 * np.minimum(sizes, 3)) - 1, 0xFFFFFFFF).astype(np.uint32)[:, None]
    hashed = (piece * np.uint32(2654435761) ^ piece >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(7)
    there = np.arange(TRIGRAMS)[None, :] < np.maximum(1, sizes - 3)[:, None]
    return own, np.where(there, hashed % np.uint32(CHAR_ROWS), CHAR_ROWS).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name in ``p``; inputs are looked up by word rows and trigram rows."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        size, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        self.p = {"word": draw(WORD_ROWS, WORD_SIZE, by=0.05), "char": draw(CHAR_ROWS + 1, CHAR_SIZE, by=0.2), "w": draw(size, 6 * h, by=size**-0.5), "b": np.zeros(6 * h, dtype=np.float32), "u0": draw(h, 3 * h, by=h**-0.5), "u1": draw(h, 3 * h, by=h**-0.5), "a": draw(2 * h, by=0.3), "v": draw(2 * h, by=0.5), "c": np.zeros(1, dtype=np.float32)}
        self.p["b"][:h] = self.p["b"][3 * h : 4 * h] = 1.0  # states are kept at first
        self.p["char"][CHAR_ROWS] = 0
        self.slope, self.shift = 1.0, 0.0
        self.quiet = 0.0  # the logit of a text without words

    def inputs(self, own: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.maximum(1, (grams < CHAR_ROWS).sum(axis=1))[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][own], self.p["char"][grams].sum(axis=1) / counts], axis=1), counts

    def projected(self, own: np.ndarray, grams: np.ndarray, step: int = 8192) -> np.ndarray:
        """Of all words, some at a time: the trigrams' embeddings of many words are large."""
        return np.concatenate([self.inputs(own[i : i + step], grams[i : i + step])[0] @ self.p["w"] + self.p["b"] for i in range(0, max(1, len(own)), step)])

    def logits(self, table: np.ndarray, rows: np.ndarray, mask: np.ndarray, pool: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Of one window each: rows (n x steps) of runs into table (words x 6 h); mask: 1 where there is a word; pool: 1 on the window's words. keep: gets what training needs."""
        n, steps, h = len(rows), rows.shape[1], HIDDEN
        states = np.empty((steps, n, 2 * h), dtype=np.float32)
        for way in (0, 1):
            own, u = np.ascontiguousarray(table[:, 3 * h * way : 3 * h * (way + 1)]), self.p[f"u{way}"]
            state = np.zeros((n, h), dtype=np.float32)
            for t in range(steps) if not way else range(steps - 1, -1, -1):
                g, hu = own.take(rows[:, t], axis=0), state @ u
                gates = sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(g[:, 2 * h :] + r * hu[:, 2 * h :])
                after = new + z * (state - new)
                m = mask[:, t, None]
                after = state + m * (after - state)
                if keep is not None:
                    keep.append((way, t, state, z, r, new, hu[:, 2 * h :]))
                state = states[t, :, way * h : (way + 1) * h] = after
        weights = np.where(pool.T > 0, states @ self.p["a"], -np.inf)
        weights = np.exp(weights - np.maximum(weights.max(axis=0), -1e30))
        weights /= np.maximum(weights.sum(axis=0), 1e-30)
        pooled = np.einsum("tn,tnk->nk", weights, states)
        if keep is not None:
            keep.append((states, weights, pooled))
        return pooled @ self.p["v"] + self.p["c"][0]

    def best_of_runs(self, table: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The largest logit of all windows of each run: those of WINDOW words from each of its first WINDOW places, or the one of all its words if they are fewer.

        Runs lie along the rows, so a step is a few operations on whole rows; attention needs only the states' products with a and v."""
        h, n = HIDDEN, len(rows)
        words = np.ascontiguousarray(table.take(rows.T, axis=0).transpose(0, 2, 1))  # steps x 6 h x runs
        there = np.arange(RUN)[:, None] < sizes[None, :]
        padded = there.all(axis=1)
        weights, values = np.zeros((RUN, n), dtype=np.float32), np.zeros((RUN, n), dtype=np.float32)
        with np.errstate(over="ignore"):  # of a very negative gate: 1 / inf is 0
            for way in (0, 1):
                own = slice(way * h, (way + 1) * h)
                # of a state: what it adds to the gates and to the new state, and its products with a and v
                u = np.concatenate([self.p[f"u{way}"].T, self.p["a"][None, own], self.p["v"][None, own]])
                of_state = np.zeros((3 * h + 2, n), dtype=np.float32)
                state = np.zeros((h, n), dtype=np.float32)
                for t in range(RUN) if not way else range(RUN - 1, -1, -1):
                    g, gates, new = words[t, 3 * h * way : 3 * h * (way + 1)], of_state[: 2 * h], of_state[2 * h : 3 * h]
                    gates += g[: 2 * h]
                    np.negative(gates, out=gates)
                    np.exp(gates, out=gates)
                    gates += 1
                    np.reciprocal(gates, out=gates)
                    new *= gates[h:]
                    new += g[2 * h :]
                    new *= -2  # tanh x = 2 / (1 + exp(-2x)) - 1
                    np.exp(new, out=new)
                    new += 1
                    np.divide(2, new, out=new)
                    new -= 1
                    state -= new
                    state *= gates[:h]
                    state += new
                    if not padded[t]:
                        state *= there[t]
                    np.matmul(u, state, out=of_state)
                    weights[t] += of_state[3 * h]
                    values[t] += of_state[3 * h + 1]
        weights[~there] = -np.inf
        weights -= np.maximum(weights.max(axis=0), np.float32(-1e30))
        np.exp(np.maximum(weights, -80, where=there, out=weights), out=weights)
        values *= weights
        span = 1
        while span < WINDOW:  # sums over windows by doubling: only like signs of the weights are added
            weights, values = weights[:-span] + weights[span:], values[:-span] + values[span:]
            span *= 2
        logit = values[:WINDOW] / np.maximum(weights[:WINDOW], np.float32(1e-37)) + self.p["c"][0]
        whole = np.arange(WINDOW)[:, None] <= np.maximum(sizes - WINDOW, 0)[None, :]
        return np.where(whole, logit, -np.inf).max(axis=0)

    def gradients(self, own: np.ndarray, grams: np.ndarray, rows: np.ndarray, mask: np.ndarray, pool: np.ndarray, labels: np.ndarray, weights_of: np.ndarray, drop: np.ndarray) -> tuple[dict, float]:
        """Of the weighted logistic loss; rows are positions in own and grams; drop: 0 for words whose own embedding is left out."""
        h, p = HIDDEN, self.p
        x, counts = self.inputs(own, grams)
        x[:, :WORD_SIZE] *= drop[:, None]
        table, keep = x @ p["w"] + p["b"], []
        logit = self.logits(table, rows, mask, pool, keep)
        prob = 1 / (1 + np.exp(-logit))
        loss = float(-(weights_of * (labels * np.log(prob + 1e-7) + (1 - labels) * np.log(1 - prob + 1e-7))).mean())
        d = ((prob - labels) * weights_of / len(labels)).astype(np.float32)
        states, weights, pooled = keep.pop()
        out = {k: np.zeros_like(v) for k, v in p.items() if k in ("u0", "u1")}
        out |= {"v": pooled.T @ d, "c": np.array([d.sum()], dtype=np.float32)}
        dp = d[:, None] * p["v"]
        dw = np.einsum("nk,tnk->tn", dp, states)
        dw = weights * (dw - (weights * dw).sum(axis=0))
        out["a"] = np.einsum("tn,tnk->k", dw, states)
        ds = weights[:, :, None] * dp[None] + dw[:, :, None] * p["a"]
        dg = np.zeros((*rows.shape, 6 * h), dtype=np.float32)
        for way in (1, 0):
            carry = np.zeros((len(rows), h), dtype=np.float32)
            for _, t, state, z, r, new, hn in reversed([k for k in keep if k[0] == way]):
                m = mask[:, t, None]
                d_after = carry + ds[t, :, way * h : (way + 1) * h]
                live = d_after * m
                d_new, d_z = live * (1 - z) * (1 - new**2), live * (state - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                dg[:, t, 3 * h * way : 3 * h * (way + 1)] = np.concatenate([d_z, d_r, d_new], axis=1)
                out[f"u{way}"] += state.T @ d_hu
                carry = d_after * (1 - m) + live * z + d_hu @ p[f"u{way}"].T
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        d_table = np.zeros_like(table)
        d_table[flat[order][first]] = np.add.reduceat(dg.reshape(-1, 6 * h)[order], first, axis=0)
        out |= {"w": x.T @ d_table, "b": d_table.sum(axis=0)}
        dx = d_table @ p["w"].T
        out["word"], out["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(out["word"], own, dx[:, :WORD_SIZE] * drop[:, None])
        np.add.at(out["char"], grams.ravel(), np.repeat(dx[:, WORD_SIZE:] / counts, TRIGRAMS, axis=0))
        out["char"][CHAR_ROWS] = 0
        return out, loss


class Adam:
    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.t += 1
        by = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            self.params[k] -= by * self.m[k] / (np.sqrt(self.s[k]) + 1e-7)


def marks(words: list[str]) -> set[str]:
    """Distinct words of a text, and the first four letters of long ones (with < before them)."""
    distinct = set(words)
    return distinct | {"<" + w[:4] for w in distinct if len(w) > 4}


def log_odds(toxic: int, clean: int, in_toxic: int, in_clean: int) -> float:
    """Of a mark in so many toxic and clean documents out of ``in_toxic`` and ``in_clean``."""
    return float(np.log((toxic + 0.1) / (max(1, in_toxic) + 1)) - np.log((clean + 0.5) / (max(1, in_clean) + 1)))


def windows_of(text: str, label: int, odds: dict[str, float], most: int = SAMPLE_WINDOWS) -> list[tuple[str, int, int, float]]:
    """(words of the run, place of the window in it, its words, value) of windows to learn from; a toxic text's value is that of the window's highest odds, and only windows near its best are given."""
    words = tokens(text)
    starts = starts_of(len(words))
    value = np.zeros(len(starts))
    if label:
        worth = np.array([max(odds.get(w, -9.0), 0.8 * odds.get("<" + w[:4], -9.0) if len(w) > 4 else -9.0) for w in words] or [-9.0])
        value = np.array([worth[s : s + WINDOW].max() for s in starts])
    by = np.argsort(-value, kind="stable") if label else np.argsort([zlib.crc32(f"{SEED} {s} {len(text)}".encode()) for s in starts], kind="stable")
    out = []
    for i in by[:most].tolist():
        if label and value[i] < max(1.0, 0.8 * value[by[0]]):
            break
        s = int(starts[i])
        first = s // WINDOW * WINDOW
        out.append((" ".join(words[first : first + RUN]), s - first, len(words[s : s + WINDOW]), float(value[i])))
    return out


def constant(labels: list[int], seed: int = SEED) -> Network | None:
    """What is known without both labels."""
    if len(set(labels)) > 1:
        return None
    net = Network(seed)
    net.p["v"][:] = 0
    net.shift = 12.0 if labels and labels[0] else -12.0
    return net


def learned(windows: list[tuple[int, str, int, int]], epochs: int = EPOCHS, batch: int = 128, seed: int = SEED) -> Network:
    """Of windows (label, words of the run, place, words in it); the same for the same windows in any order."""
    net, rng = Network(seed), np.random.default_rng(seed)
    windows = sorted(windows)
    vocabulary: dict[str, int] = {"": 0}
    rows = np.zeros((len(windows), RUN), dtype=np.int32)
    pool = np.zeros((len(windows), RUN), dtype=np.float32)
    for i, (_, run, at, count) in enumerate(windows):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in run.split()]
        rows[i, : len(ids)] = ids
        pool[i, at : at + count] = 1
    y = np.array([w[0] for w in windows], dtype=np.float32)
    # words that no one has seen, in scripts or tongues of their own, say nothing: runs of made-up ones are clean
    own, grams = word_rows([*vocabulary, *("".join(map(chr, rng.integers(161, 700, rng.integers(1, 7)))) for _ in range(UNSEEN))])
    made = np.where(np.arange(RUN)[None, :] < rng.integers(1, RUN + 1, len(windows) // 20 + 1)[:, None], rng.integers(len(vocabulary), len(own), (len(windows) // 20 + 1, RUN)), 0)
    made[::2] = np.where(made[::2] > 0, made[::2, :1], 0)  # every other one says a single word
    rows, y = np.concatenate([rows, made.astype(np.int32)]), np.append(y, np.zeros(len(made), dtype=np.float32))
    pool = np.concatenate([pool, (made > 0) & (np.arange(RUN) < WINDOW)]).astype(np.float32)
    mask = (rows > 0).astype(np.float32)
    positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    adam, hard = Adam(net.p, 0.01), negative[:0]
    steps = -(-(min(len(positive), POSITIVE) + min(len(negative), NEGATIVE)) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // max(1, steps)))
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - 0.8 * epoch / epochs)
        if epoch >= 2 and epoch % 2 == 0 and len(negative):  # clean windows that look worst so far
            table = net.projected(own, grams)
            logit = np.concatenate([net.logits(table, rows[negative[i : i + 2048]], mask[negative[i : i + 2048]], pool[negative[i : i + 2048]]) for i in range(0, len(negative), 2048)])
            hard = negative[np.argsort(-logit, kind="stable")[: len(negative) // 20 + 1][:HARD]]
        some = np.concatenate([rng.permutation(positive)[:POSITIVE], rng.permutation(negative)[:NEGATIVE], hard])
        rng.shuffle(some)
        for i in range(0, len(some), batch):
            part = some[i : i + batch]
            distinct, inverse = np.unique(rows[part], return_inverse=True)
            drop = (rng.random(len(distinct)) > 0.4).astype(np.float32)
            label = y[part]
            grads, _ = net.gradients(own[distinct], grams[distinct], inverse.reshape(len(part), RUN), mask[part], pool[part], label, np.where(label == 1, 1.0, 1.5).astype(np.float32), drop)
            adam.step(grads)
    return net


def curve(logits: np.ndarray, labels: np.ndarray, l2: float = 0.003) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, the slope held near 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        e, s = p - labels, p * (1 - p)
        g = np.array([(e * logits).sum() + l2 * len(labels) * (a - 1), e.sum() + 1e-3 * b])
        hessian = np.array([[(s * logits**2).sum() + l2 * len(labels), (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hessian, g), -1, 1)
        a, b = max(0.2, a - step[0]), b - step[1]
    return float(a), float(b)


class Rows(dict):
    """Position of a word in the scorer's table; a new word goes to the end."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.new: list[str] = [""]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Scorer:
    """Scores texts, a batch of windows at a time."""

    def __init__(self, net: Network):
        self.net, self.rows, self.table = net, Rows(), np.zeros((0, 6 * HIDDEN), dtype=np.float32)

    def _project(self) -> None:
        if self.rows.new:
            new = [self.net.projected(*word_rows(self.rows.new[i : i + 8192])) for i in range(0, len(self.rows.new), 8192)]
            self.table = np.concatenate([self.table, *new])
            self.rows.new = []

    def logits(self, texts: list[str]) -> np.ndarray:
        """The largest of each text's windows."""
        top = np.full(len(texts), -np.inf)
        owners: list[int] = []
        runs: list[np.ndarray] = []

        def flush(least: int) -> None:
            while len(runs) >= least and runs:
                own, part = owners[:BATCH_RUNS], runs[:BATCH_RUNS]
                del owners[:BATCH_RUNS], runs[:BATCH_RUNS]
                self._project()
                sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
                rows = np.zeros((len(part), RUN), dtype=np.int32)
                rows[np.arange(RUN)[None, :] < sizes[:, None]] = np.concatenate(part)
                np.maximum.at(top, own, self.net.best_of_runs(self.table, rows, sizes))

        for i, text in enumerate(texts):
            ids = np.fromiter(map(self.rows.__getitem__, tokens(text)), dtype=np.int32)
            for start in range(0, max(1, len(ids) - WINDOW + 1) if len(ids) else 0, WINDOW):
                owners.append(i)
                runs.append(ids[start : start + RUN])
            flush(BATCH_RUNS)
            if len(self.rows) > KNOWN_WORDS:
                flush(1)
                self.rows, self.table = Rows(), self.table[:0]
        flush(1)
        return np.where(np.isfinite(top), top, self.net.quiet)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.net.slope * self.logits(texts) + self.net.shift, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, most_of_each: dict[int, int] = SAMPLE) -> Network:
    """Texts of the sample stay in a written table; words are counted, windows cut and the tuning quarter scored on the executors."""
    rows = sample(docs, labels, "toxic", most_of_each).select("text", "label", (F.pmod(F.xxhash64("text"), F.lit(4)) == 3).alias("tune"))
    rows = written(rows, "labelled")
    counts = {(r["label"], r["tune"]): r["n"] for r in rows.groupBy("label", "tune").agg(F.count(F.lit(1)).alias("n")).collect()}
    net = constant([label for label, _ in counts])
    if net:
        return net

    def marked(batches):
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(marks(tokens(text)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["mark", "label"])

    seen = rows.filter("NOT tune").select("text", "label").mapInArrow(in_slices(marked), "mark string, label int").groupBy("mark").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).filter("toxic > 1")
    of_label = [counts.get((label, False), 0) for label in (1, 0)]
    odds = {r["mark"]: log_odds(r["toxic"], r["n"] - r["toxic"], *of_label) for r in seen.collect()}

    def cut(batches):
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = windows_of(text, label, odds)
                runs, at, count, _ = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(runs, pa.string()), pa.array(at, pa.int32()), pa.array(count, pa.int32())], names=["label", "run", "at", "count"])

    windows = rows.filter("NOT tune").select("text", "label").mapInArrow(in_slices(cut), "label int, run string, at int, count int").collect()
    net = learned([tuple(r) for r in windows])

    def tuned(batches):
        scorer = Scorer(net)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scorer.logits(batch.column(0).to_pylist()), pa.float64()), batch.column(1)], names=["logit", "label"])

    tune = sorted(tuple(r) for r in rows.filter("tune").select("text", "label").mapInArrow(in_slices(tuned), "logit double, label int").collect())
    if tune:
        net.quiet = float(np.median([logit for logit, label in tune if not label] or [0.0]))
        net.slope, net.shift = curve(*(np.array(c, dtype=float) for c in zip(*tune, strict=True)))
    return net


def scored(docs: DataFrame, net: Network, threshold: float = THRESHOLD, columns: tuple[str, ...] = ()) -> DataFrame:
    """``columns``, doc_id, held_out, score and predicted."""
    from pyspark.sql import types as T

    kept = [c for c in columns if c not in ("doc_id", "text")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *([docs.schema["text"]] if "text" in columns else []), *(docs.schema[c] for c in kept)])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), *kept)

    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            score = scorer.score([t or "" for t in batch.column(2).to_pylist()])
            arrays = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            arrays += [batch.column(2)] if "text" in columns else []
            yield pa.RecordBatch.from_arrays(arrays + batch.columns[3:], names=schema.names)

    return source.mapInArrow(in_slices(run), schema)


def op8_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fitted(docs, read(spark, sf_dir, "labels")))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold stay."""
    columns = [c for c in DOCUMENT_COLUMNS if c in docs.columns]
    net = fitted(docs, read(spark, sf_dir, "labels"))
    return scored(docs, net, columns=tuple(columns)).filter("predicted = 0").select(*columns)
