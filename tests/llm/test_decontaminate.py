import random

from routeloom.llm.decontaminate import decontaminate, find_contamination, words_of


def brute(docs, items, window):
    windows = []
    for name, text in items:
        w = words_of(text)
        windows += [(tuple(w[i : i + window]), name) for i in range(max(1, len(w) - window + 1)) if w]
    out = []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        by: dict = {}
        for x, name in windows:
            by.setdefault(len(x), {}).setdefault(x, set()).add(name)
        for n, table in by.items():
            for i in range(len(w) - n + 1):
                if names := table.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= {"null" if k is None else str(k) for k in names}
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def check(spark, docs, items, window, block=50_000):
    a, b = spark.createDataFrame(docs, "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, sum(e - s for s, e in zip(r.begins, r.ends)), r["items"]) for r in find_contamination(a, b, window, block).collect()]
    assert sorted(got, key=str) == brute([d[:2] for d in docs], items, window)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["a", "b", "c", "d", "é1", "Z"]
    items = [(i, " ".join(r.choices(vocab, k=r.randrange(0, 14)))) for i in range(30)] + [(None, "b b. B"), (7, None), (31, "a b a b a b a b a b a b")]
    docs = [(i, ", ".join(r.choices(vocab + ["q"], k=r.randrange(60))), "x") for i in range(60)] + [(3, None, None), (None, "b b b", None), (61, "", "x")]
    for window in (3, 5):
        check(spark, docs, items, window)
    check(spark, docs, items, 4, 10)
    check(spark, docs, [], 4)
    check(spark, [], items, 4)


def test_documents(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    check(spark, [(r.doc_id, r.text, "") for r in d.collect()], [(r.item_id, r.text) for r in b.collect()], 10)


def test_removal_keeps_the_rest(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Hm -- One, two! three four; ok then"), (2, "clean  text\n"), (3, "one two three four")], "doc_id long, text string")
    assert dict(decontaminate(docs, items, 4, 0.8).collect()) == {1: "Hm -- ; ok then", 2: "clean  text\n"}
