import zlib

import numpy as np

from routeloom.llm import toxicity
from routeloom.llm._words import Words
from routeloom.llm.toxicity import STRIDE, WINDOW, fit, score, train, windows


def test_windows_cover_all_words():
    counts = np.array([0, 1, 15, 16, 17, 24, 25, 100])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    start, n, row = windows(counts, first)
    for r, c in enumerate(counts):
        own = [(s - first[r], k) for s, k, q in zip(start, n, row) if q == r]
        assert {i for s, k in own for i in range(s, s + k)} == set(range(c))
        assert all(b[0] - a[0] <= STRIDE for a, b in zip(own, own[1:])) and all(k == min(WINDOW, c) for _, k in own)


def test_gradient_learns_order():
    r = np.random.default_rng(0)
    texts, y = [], []
    for i in range(600):
        w = [f"w{k}" for k in r.integers(0, 60, 30)]
        if i % 3 == 0:
            w[int(r.integers(0, 30))] = ["awful", "vile"][i % 2]
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    from routeloom.llm.toxicity import _parts

    net = fit(texts[:480], np.array(y[:480]))
    p = net.score(Words.joined(_parts(texts[480:])))
    assert ((p > 0.5) == np.array(y[480:])).mean() > 0.9


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score(d, train(d, labels)).collect()}
    out = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    a, b = np.array(out).T
    assert (a == b).mean() > 0.93 and a[b == 1].mean() > 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b"), (3, "\n"), (4, "w " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, 1, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = score(docs, train(docs, known)).collect()
        assert len(rows) == 6 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0


def test_windows_score_alike_with_and_without_their_way():
    r = np.random.default_rng(4)
    net = toxicity.Network()
    net.p["words"][:] = 0.1 * r.standard_normal(net.p["words"].shape)
    x = r.standard_normal((30, net.size)).astype(np.float32)
    for least in (1, 16):
        at = r.integers(0, 30, (9, 16))
        real = (np.arange(16) < r.integers(least, 17, 9)[:, None]).astype(np.float32)
        p = net.project(x)
        got = net.infer({d: np.ascontiguousarray(v.T) for d, v in p.items()}, np.ascontiguousarray(at.T), np.ascontiguousarray(real.T), {})
        assert np.allclose(got, net.forward(p, at, real)[0], atol=1e-5)


def test_sums_by_number():
    r = np.random.default_rng(2)
    at, values = r.integers(0, 7, 50), r.standard_normal((50, 3)).astype(np.float32)
    want = np.zeros((8, 3), np.float32)
    np.add.at(want, at, values)
    assert np.allclose(toxicity._summed(at, values, 8), want, atol=1e-5)
