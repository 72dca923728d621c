"""Quality score by a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features, one after another, and adds
a shallow tree of one feature to that feature's table of scores by bin; then the pairs of
features that explain most of what is left get tables too. A text's score is the sum of its
bins' entries, so scoring is a few table lookups for each text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm._words import pieces
from routeloom.llm.quality_rules import measures

FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "exclaims", "bars", "line_words", "short_lines", "distinct", "top_word", "beyond_ascii", "inner_case")


def _bytes(test) -> np.ndarray:
    return np.array([bool(test(chr(b))) and b < 0x80 for b in range(256)], np.int64)


_CLASSES = {
    "upper": _bytes(str.isupper),
    "lower": _bytes(str.islower),
    "digits": _bytes(str.isdigit),
    "punctuation": _bytes(lambda c: c in ".,;:?"),
    "exclaims": _bytes(lambda c: c == "!"),
    "bars": _bytes(lambda c: c in "|<>{}[]"),
    "beyond": np.array([b >= 0xC0 for b in range(256)], np.int64),
}


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text, from all of it."""
    (n, chars, symbols, dups, repeats), words, lines = measures(data, offsets)
    words_of_line = np.searchsorted(words.starts, lines.ends) - np.searchsorted(words.starts, lines.starts)
    full = words_of_line > 0
    n_lines = np.maximum(1, _sums(full, lines.first))
    short = _sums(full & (words_of_line < 4), lines.first)
    # counts of each word in its row
    order = np.lexsort((words.hashes, words.rows()))
    rows, h = words.rows()[order], words.hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, rows[at], counts)
    by = {k: _sums(v[data], offsets) for k, v in _CLASSES.items()}
    w, c = np.maximum(1, n), np.maximum(1, chars)
    inner = np.zeros(len(data), np.int64)
    inner[1:] = _CLASSES["upper"][data[1:]] & _CLASSES["lower"][data[:-1]]
    return np.stack(
        [
            np.log1p(n), chars / w, symbols / c, dups / n_lines, repeats / w, by["upper"] / c, by["digits"] / c, by["punctuation"] / w, by["exclaims"] / w, by["bars"] / w,
            n / n_lines, short / n_lines, np.bincount(rows[at], minlength=len(n)) / w, top / w, by["beyond"] / c, _sums(inner, offsets) / w,
        ],
        axis=1,
    )


class Additive:
    """Bin edges, and tables by feature and by pair of features."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 150, pairs: int = 6, rate: float = 0.15, ridge: float = 2.0):
        self.bins, self.coarse, self.rounds, self.n_pairs, self.rate, self.ridge = bins, coarse, rounds, pairs, rate, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        m = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(m)]
        self.few = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.coarse + 1)[1:-1])) for f in range(m)]
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.tables = [np.zeros(self.bins + 1) for _ in range(m)]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        b = self._binned(x)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f in range(m):
                g, h = self._slopes(score, y)
                step = self._tree(np.bincount(b[:, f], g, self.bins + 1), np.bincount(b[:, f], h, self.bins + 1))
                self.tables[f] += step
                score += step[b[:, f]]
        c = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.few)], axis=1)
        k = self.coarse + 1
        g, h = self._slopes(score, y)
        gains = []
        for i, j in combinations(range(m), 2):
            cell = c[:, i] * k + c[:, j]
            gains.append((self._quadrants(np.bincount(cell, g, k * k).reshape(k, k), np.bincount(cell, h, k * k).reshape(k, k))[0], i, j))
        chosen = sorted(gains, reverse=True)[: self.n_pairs]
        self.pairs = [(i, j, np.zeros((k, k))) for _, i, j in chosen]
        for _ in range(self.rounds // 3):
            for i, j, table in self.pairs:
                g, h = self._slopes(score, y)
                cell = c[:, i] * k + c[:, j]
                _, step = self._quadrants(np.bincount(cell, g, k * k).reshape(k, k), np.bincount(cell, h, k * k).reshape(k, k))
                table += step
                score += step[c[:, i], c[:, j]]
        return self

    @staticmethod
    def _slopes(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Leaf values by bin of the best tree with two levels of cuts."""
        step = np.zeros(len(g))

        def cut(lo: int, hi: int) -> int | None:
            a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            if not len(a):
                return None
            ga, ha = g[lo:hi].sum(), h[lo:hi].sum()
            gain = a**2 / (b + self.ridge) + (ga - a) ** 2 / (ha - b + self.ridge) - ga**2 / (ha + self.ridge)
            return lo + 1 + int(gain.argmax()) if gain.max() > 1e-9 else None

        mid = cut(0, len(g))
        for lo, hi in ((0, mid), (mid, len(g))) if mid else ((0, len(g)),):
            inner = cut(lo, hi)
            for s, e in ((lo, inner), (inner, hi)) if inner else ((lo, hi),):
                step[s:e] = self.rate * g[s:e].sum() / (h[s:e].sum() + self.ridge)
        return step

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain and leaf values of the best tree that cuts both features once."""
        k = len(g)
        ga, ha = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1))
        ga[1:, 1:], ha[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        i, j = np.meshgrid(np.arange(1, k), np.arange(1, k), indexing="ij")
        part = lambda s: (s[i, j], s[i, k] - s[i, j], s[k, j] - s[i, j], s[k, k] - s[i, k] - s[k, j] + s[i, j])
        gain = sum(a**2 / (b + self.ridge) for a, b in zip(part(ga), part(ha), strict=True))
        at = np.unravel_index(int(gain.argmax()), gain.shape)
        x, y = at[0] + 1, at[1] + 1
        step = np.zeros((k, k))
        for rows in (slice(0, x), slice(x, k)):
            for cols in (slice(0, y), slice(y, k)):
                step[rows, cols] = self.rate * g[rows, cols].sum() / (h[rows, cols].sum() + self.ridge)
        return float(gain[at]), step

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, e in enumerate(self.edges):
            total += self.tables[f][np.searchsorted(e, x[:, f], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.few[i], x[:, i], "right"), np.searchsorted(self.few[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def held_out(folds: int = 5):
    """The rows that no classifier learns from: crc32 of doc_id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` labelled rows (doc_id, y) to learn from, the first by a hash of doc_id; of several labels of a doc_id the largest counts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg(F.max(column).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _featurise(batches):
    for b in batches:
        for i, j, data, offsets in pieces(b.column("text")):
            x = features(data, offsets)
            rest = [b.column(c).slice(i, j - i) for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], [*(c for c in b.schema.names if c != "text"), "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Additive:
    """A model from at most `most` labelled texts outside the held-out fold; with one class only, it scores by that class's share."""
    chosen = F.broadcast(sample_labels(labels, "quality", most))  # at most `most` rows
    doc = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(_featurise, f"doc_id {doc}, y double, x array<double>").select("x", "y").toPandas()
    x, y = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES)), got["y"].to_numpy(np.float64)
    if not len(y):
        x, y = np.zeros((2, len(FEATURES))), np.array([0.0, 1.0])
    return Additive().fit(x, y)


def score(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs; null texts count as empty, and score as empty ones do."""
    doc = docs.schema["doc_id"].dataType.simpleString()
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i, j, data, offsets in pieces(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(box.value.score(features(data, offsets)))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
