"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of words. A word's input is the sum of a hashed word
vector and the mean of its hashed character trigrams' vectors; gated recurrent units run over
the window both ways, attention weighs the positions, and a linear layer gives the window's
score. A text's score comes from its worst window. Training is plain numpy: which windows of
a toxic text are the toxic ones isn't labelled, so the network picks them itself, turn by turn,
from a first guess by word frequencies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm._words import NON_ALNUM, Words, mix, pieces, scan
from routeloom.llm.quality_model import held_out, sample_labels

WINDOW, STRIDE = 16, 8
_WORDS, _TRIGRAMS = 1 << 15, 1 << 13
_f = np.float32


def word_inputs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number of each word, word buckets, trigram buckets, trigram bounds), the last three by different word."""
    _, first, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    h = w.hashes[first]
    starts, ends = w.starts[first], w.ends[first]
    n = ends - starts
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(starts, n)
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    own = lower[w.data[at]] if len(at) else np.zeros(0, np.uint64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[bounds[:-1][n > 0]] = 1
    after[bounds[1:][n > 0] - 1] = 2
    tri = mix(before | (own << np.uint64(8)) | (after << np.uint64(16)), 21) % np.uint64(_TRIGRAMS)
    return number.astype(np.int32), (h % np.uint64(_WORDS)).astype(np.int32), tri.astype(np.int32), bounds.astype(np.int64)


def windows(counts: np.ndarray, first: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, words, row) of every window: each stride words one starts, and the last ends with the text; no words, no window."""
    each = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - window) // stride)), 0)
    row = np.repeat(np.arange(len(counts)), each)
    k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    start = np.minimum(k * stride, np.maximum(0, counts[row] - window))
    return first[row] + start, np.minimum(window, counts[row] - start), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _f(1) / (_f(1) + np.exp(-x))


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by their number in at, for the numbers below n."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = np.zeros((n, values.shape[1]), _f)
    out[own[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    def __init__(self, size: int = 12, hidden: int = 8, seed: int = 1):
        r = np.random.default_rng(seed)
        self.size, self.hidden = size, hidden
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(_f)
        self.p = {"words": np.zeros((_WORDS, size), _f), "tri": (0.1 * r.standard_normal((_TRIGRAMS, size))).astype(_f)}
        for d in "fb":
            self.p |= {f"W{d}": g(size, 3 * hidden), f"U{d}": g(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, _f)}
        self.p |= {"A": g(2 * hidden, hidden), "a": g(hidden), "o": g(2 * hidden), "bias": np.zeros(1, _f)}
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, buckets: np.ndarray, tri: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)
        total = np.add.reduceat(self.p["tri"][tri], bounds[:-1], axis=0)  # no word is empty
        return self.p["words"][buckets] + total / n[:, None].astype(_f)

    def forward(self, projected: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray):
        """Scores of windows, and all that lies on the way there: at (windows, places) are rows of the projected inputs, real marks places that hold a word."""
        n, t = at.shape
        h = self.hidden
        states, kept = np.empty((n, t, 2 * h), _f), {}
        for d in "fb":
            x, u, s = projected[d], self.p[f"U{d}"], np.zeros((n, h), _f)
            part = slice(0, h) if d == "f" else slice(h, 2 * h)
            steps = []
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                i = x[at[:, k]]
                v = s @ u
                rz = _sigmoid(i[:, : 2 * h] + v[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                q = v[:, 2 * h :]
                c = np.tanh(i[:, 2 * h :] + r * q)
                m = real[:, k : k + 1]
                steps.append((k, s, r, z, q, c, m))
                s = s + m * (1 - z) * (c - s)
                states[:, k, part] = s
            kept[d] = steps
        e = np.tanh((states.reshape(n * t, 2 * h) @ self.p["A"]).reshape(n, t, h))
        w = e @ self.p["a"] + np.where(real > 0, _f(0), _f(-1e9))
        w = np.exp(w - w.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        pooled = (w[:, None, :] @ states)[:, 0]
        return pooled @ self.p["o"] + self.p["bias"][0], (states, kept, e, w, pooled)

    def infer(self, inputs: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray, room: dict) -> np.ndarray:
        """What forward gives, and nothing of the way: places and features come before windows (inputs (features, words), at and real (places, windows)), so that every operation runs along the windows; room keeps the arrays for the next windows."""
        t, n = at.shape
        h, p = self.hidden, self.p
        if room.get("n") != n:  # large arrays made anew for every operation cost more than the arithmetic
            empty = lambda *shape: np.empty((*shape, n), _f)
            room |= {"n": n, "states": empty(t, 2 * h), "i": empty(3 * h), "v": empty(3 * h), "z": empty(h), "e": empty(t, h), "zero": np.zeros((h, n), _f)}
        states, i, v, one_z, e = (room[k] for k in ("states", "i", "v", "z", "e"))
        rz, c = i[: 2 * h], v[2 * h :]
        whole = bool(real.all())
        for d in "fb":
            x, u, s = inputs[d], np.ascontiguousarray(p[f"U{d}"].T), room["zero"]
            part = slice(0, h) if d == "f" else slice(h, 2 * h)
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                x.take(at[k], axis=1, out=i, mode="clip")
                np.matmul(u, s, out=v)
                rz += v[: 2 * h]
                np.negative(rz, out=rz)
                np.exp(rz, out=rz)
                rz += _f(1)
                np.reciprocal(rz, out=rz)
                c *= rz[:h]
                c += i[2 * h :]
                np.tanh(c, out=c)
                c -= s
                np.subtract(_f(1), rz[h:], out=one_z)
                c *= one_z
                if not whole:
                    c *= real[k]
                s = np.add(s, c, out=states[k, part])
        np.matmul(np.ascontiguousarray(p["A"].T), states, out=e)
        w = p["a"] @ np.tanh(e, out=e) + np.where(real > 0, _f(0), _f(-1e9))
        w = np.exp(w - w.max(0))
        return (w * (p["o"] @ states)).sum(0) / w.sum(0) + p["bias"][0]

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vectors @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def step(self, batch, y: np.ndarray, known: np.ndarray, rate: float, moments: dict, turn: int) -> None:
        """One turn of Adam on windows given as (word numbers by place, real, buckets, trigrams, bounds)."""
        at, real, buckets, tri, bounds = batch
        h, p = self.hidden, self.p
        x = self.vectors(buckets, tri, bounds)
        projected = self.project(x)
        out, (states, kept, e, w, pooled) = self.forward(projected, at, real)
        d_out = ((_sigmoid(out) - y) / len(y)).astype(_f)
        g = {"o": pooled.T @ d_out, "bias": np.array([d_out.sum()], _f)}
        d_pooled = d_out[:, None] * p["o"]
        d_states = w[:, :, None] * d_pooled[:, None, :]
        d_w = np.einsum("nh,nth->nt", d_pooled, states)
        d_w = w * (d_w - (w * d_w).sum(1, keepdims=True))
        g["a"] = np.einsum("nt,nth->h", d_w, e)
        d_e = d_w[:, :, None] * p["a"] * (1 - e * e)
        g["A"] = np.einsum("nti,ntj->ij", states, d_e)
        d_states += d_e @ p["A"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = p[f"U{d}"]
            d_u, d_is, d_s = np.zeros_like(u), np.zeros((*at.shape, 3 * h), _f), np.zeros((len(y), h), _f)
            for k, s, r, z, q, c, m in reversed(kept[d]):
                d_s = d_s + d_states[:, k, part]
                d_c = d_s * m * (1 - z) * (1 - c * c)
                d_z = -d_s * m * (c - s) * z * (1 - z)
                d_r = d_c * q * r * (1 - r)
                d_q = d_c * r
                d_i = np.concatenate([d_r, d_z, d_c], axis=1)
                d_u += np.concatenate([s.T @ d_r, s.T @ d_z, s.T @ d_q], axis=1)
                d_is[:, k] = d_i
                d_s = d_s * (1 - m * (1 - z)) + d_r @ u[:, :h].T + d_z @ u[:, h : 2 * h].T + d_q @ u[:, 2 * h :].T
            d_i_all = _summed(at.ravel(), d_is.reshape(-1, 3 * h), len(x))
            g |= {f"U{d}": d_u, f"W{d}": x.T @ d_i_all, f"c{d}": d_i_all.sum(0)}
            d_x += d_i_all @ p[f"W{d}"].T
        n = np.maximum(1, np.diff(bounds))
        rows = {"words": (buckets, d_x * known[buckets, None]), "tri": (tri, np.repeat(d_x / n[:, None].astype(_f), np.diff(bounds), axis=0))}
        for k, grad in g.items():
            a, b = moments.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            p[k] -= (rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.99**turn)) + 1e-7)).astype(_f)
        for k, (own, grad) in rows.items():  # only the rows that the batch holds
            some, where = np.unique(own, return_inverse=True)
            total = _summed(where, grad, len(some))
            b = moments.setdefault(k, np.zeros(len(p[k]), _f))
            b[some] += (total * total).mean(1)
            p[k][some] -= rate * 5 * total / (np.sqrt(b[some])[:, None] + _f(1e-6))

    def window_scores(self, w: Words, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(score, row) of every window of some texts."""
        start, n, row = windows(w.counts, w.first)
        if not len(row):
            return np.zeros(0, _f), row
        number, buckets, tri, bounds = word_inputs(w)
        inputs = {d: np.ascontiguousarray(x.T) for d, x in self.project(self.vectors(buckets, tri, bounds)).items()}
        place = np.arange(WINDOW)[:, None]
        out, room = [], {}
        for i in range(0, len(row), batch):
            s, m = start[i : i + batch], n[i : i + batch]
            real = (place < m).astype(_f)
            out.append(self.infer(inputs, number[np.minimum(s + place, len(number) - 1)], real, room))
        return np.concatenate(out), row

    def score(self, w: Words) -> np.ndarray:
        """Scores of texts from 0 to 1, from each one's worst window; a text without words has the score of an unremarkable window."""
        s, row = self.window_scores(w)
        worst = np.full(len(w.counts), -8.0)
        np.maximum.at(worst, row, s)
        return 1 / (1 + np.exp(-(self.scale * worst + self.shift)))


def _parts(texts: list[str], target: int = 1 << 18) -> list[Words]:
    """The words of the texts, some texts at a time."""
    return [w for _, _, w in scan(pa.array(texts, pa.large_string()), NON_ALNUM, True, target)]


def fit(texts: list[str], y: np.ndarray, turns: int = 4, seed: int = 1) -> Network:
    """Trains on texts with labels 0 and 1; with one class only the network learns to say that."""
    net, r = Network(seed=seed), np.random.default_rng(seed)
    parts = _parts(texts)
    w = Words.joined(parts)
    start, n, row = windows(w.counts, w.first)
    if not len(row):
        return net
    number, buckets, tri, bounds = word_inputs(w)
    y = y.astype(np.int64)
    positive = y[row] == 1
    # first guess: words that toxic texts hold more often than others
    pairs = np.divmod(np.unique(w.rows() * len(buckets) + number), len(buckets))
    seen = [np.bincount(pairs[1][y[pairs[0]] == k], minlength=len(buckets)) for k in (0, 1)]
    share = [(s + 0.5) / (1 + (y == k).sum()) for k, s in enumerate(seen)]
    odds = np.where(seen[1] >= 3, np.log(share[1] / share[0]), -5.0)
    place = np.arange(WINDOW)
    inside = place < n[:, None]
    at = number[np.minimum(start[:, None] + place, len(number) - 1)]
    guess = np.where(inside, odds[at], -9.0).max(1)

    def sub(chosen: np.ndarray):
        some, where = np.unique(at[chosen], return_inverse=True)
        m = np.diff(bounds)[some]
        own = np.concatenate([[0], np.cumsum(m)])
        k = np.arange(own[-1]) - np.repeat(own[:-1], m) + np.repeat(bounds[:-1][some], m)
        return where.reshape(-1, WINDOW), inside[chosen].astype(_f), buckets[some], tri[k], own

    # words of few texts have no vector of their own, only their trigrams' mean: what they say wouldn't carry over
    known = np.zeros(_WORDS, _f)
    known[buckets[seen[0] + seen[1] >= 5]] = 1
    learn = np.arange(len(y)) % 5 > 0  # the others set the threshold
    moments: dict = {}
    count = 0
    for turn in range(turns):
        order = np.lexsort((r.random(len(row)), -guess, row))
        first = np.ones(len(row), bool)
        first[1:] = row[order][1:] != row[order][:-1]
        worst = order[first & learn[row[order]]]
        sure = np.flatnonzero(positive & learn[row] & (guess > (2.0 if turn == 0 else 0.0)))
        pos = np.union1d(worst[positive[worst]], sure)
        clean = np.flatnonzero(~positive & learn[row])
        neg = np.union1d(worst[~positive[worst]], r.choice(clean, min(len(clean), 2 * len(pos) + 500), replace=False)) if len(clean) else clean
        chosen = np.concatenate([pos, neg])
        target = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))]).astype(_f)
        for _ in range(2):
            mixed = r.permutation(len(chosen))
            for k in range(0, len(mixed), 256):
                own = mixed[k : k + 256]
                count += 1
                net.step(sub(chosen[own]), target[own], known, 0.01 if turn < turns - 2 else 0.003, moments, count)
        guess = np.concatenate([net.window_scores(p)[0] for p in parts])
    # worst windows are far apart for the two classes; a line through them gives the text's score
    worst = np.full(len(y), -8.0)
    np.maximum.at(worst, row, guess)
    unseen, truth = (worst[~learn], y[~learn]) if (~learn).any() else (worst, y)
    # logistic regression; both classes weigh the same, so that 0.5 lies between them
    weight = np.where(truth == 1, 0.5 / max(1, (truth == 1).sum()), 0.5 / max(1, (truth == 0).sum()))
    x, line = np.stack([unseen, np.ones(len(unseen))], axis=1), np.array([0.1, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ ((truth - p) * weight) - 1e-3 * line
        line = line + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    a, b = line
    net.scale, net.shift = max(float(a), 0.05), float(b)
    return net


def train(docs: DataFrame, labels: DataFrame, most: int = 5000) -> Network:
    """A network from at most `most` labelled texts outside the held-out fold."""
    chosen = F.broadcast(sample_labels(labels, "toxic", most))  # at most `most` rows
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"])
    return fit(got["text"].tolist(), got["y"].to_numpy(np.float64))


def score(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs; null texts count as empty."""
    doc = docs.schema["doc_id"].dataType.simpleString()
    box = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            for i, j, data, offsets in pieces(b.column("text")):
                w = Words(data, offsets, NON_ALNUM, True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(box.value.score(w))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
