import re
from collections import Counter, defaultdict

import pytest

from routeloom.llm import quality_rules
from routeloom.llm._common import materialise
from routeloom.llm.quality_rules import assess, without_boilerplate

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = len(w)
    return (n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(rep), n < 10 or 100 * len(rep) > 20 * n)


def brute(rows, max_docs, min_left):
    fold = lambda s: tuple(PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s)))
    texts = defaultdict(set)
    for _, t, host in rows:
        texts[host].add(t)
    common = {h: Counter(x for t in ts for x in {fold(line) for line in (t or "").split("\n")} if x) for h, ts in texts.items()}
    out = []
    for d, t, h in rows:
        lines = [fold(x) for x in (t or "").split("\n")]
        plain = sum(map(len, lines))
        left = sum(len(x) for x in lines if not common[h][x] > max_docs)
        b = base(t)
        out.append((d, *b, not b[-1] and left >= min_left * plain, left))
    return sorted(out, key=str)


def check(spark, rows, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", df_lit())
    got = [tuple(r)[:-1] for r in assess(df, **limits).collect()]
    assert sorted(got, key=str) == brute(rows, limits["max_docs"], limits["min_left"])
    return got


def df_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_small(spark):
    menu = "Home | About us | Contact, one two three four five six"
    rows = [(i, f"{menu}\nunique{i} line number {i} é|", "a" if i % 2 else None) for i in range(12)]
    rows += [(20 + i, f"{menu.upper() if i else menu}", "a") for i in range(2)] + [(30, menu, "a"), (31, menu, "b"), (40, None, "a"), (41, "", None), (42, " \n \n\t", "a")]
    rows += [(43, "x y z v w " * 30, "a"), (43, "same\nsame\n same\nsame", "a"), (None, menu, None), (44, "\n".join(f"l{i} <>" for i in range(40)), "b")]
    got = check(spark, rows, max_docs=3, min_left=0.3)
    assert not all(r[7] for r in got if not r[6])
    assert check(spark, [], max_docs=3, min_left=0.3) == []


def test_documents(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows, max_docs=50, min_left=0.1)


def test_large_host(spark):
    # 60 of 2,000 texts hold the notice: over the limit of documents, though 3% of the host
    notice = "please accept all our cookies before you go on reading this page"
    rows = [(i, f"{notice}\nn{i}" if i < 60 else f"text {i} " + " ".join(f"w{i}x{j}" for j in range(12)), "hot") for i in range(2000)]
    out = assess(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id for r in out.filter("NOT kept").collect()} == set(range(60))


def test_without_boilerplate(spark):
    from routeloom.llm.pipeline import quality_rules

    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(60)]
    rows = [(i, f"é | Menu of all pages\n{own[i]}\n\nMENU of (all) pages", "a", 7) for i in range(60)]
    rows += [(100, f"\n {own[0]}\n", "a", 7), (101, f"menu of all pages\n{own[1]}", "b", 7), (102, f"menu of all pages!\n{own[2]}\nend é\n", "a", 7), (103, "no", "a", 7)]
    rows = [(d, t.replace("é | ", ""), s, n) for d, t, s, n in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    right = {i: f"{own[i]}\n" for i in range(60)} | {100: rows[60][1], 101: rows[61][1], 102: f"{own[2]}\nend é\n"}
    assert {r.doc_id: r.text for r in without_boilerplate(df).collect()} == right
    out = quality_rules(spark, df, "").collect()
    assert {r.doc_id: r.text for r in out} == right
    assert all(r.n_chars == (7 if r.doc_id in (100, 101) else len(r.text)) for r in out)


def test_texts_stay_where_they_lie(spark):
    """With few boilerplate lines no text is shuffled, not even for size; with more of them the result is the same."""
    own = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(200)]
    rows = [(i, f"Menu of {i % 3} pages\n\n{own[i]}é\n{'' if i % 7 else 'menu, of 0 pages'}", f"h{i % 2}" if i % 5 else None, len(own[i])) for i in range(200)]
    rows += [(300, None, "h0", 0), (301, "", None, 0), (302, "menu of 0 pages\n" * 20 + own[0], "h0", 1), (303, "Menu of 0 pages\n" + own[1], "h2", 1), (None, own[2] + "\nmenu of 1 pages", "h1", 1), (None, own[2] + "\nmenu of 1 pages", "h1", 1)]
    rows += [(400 + i, f"Menu of 0 pages {own[0]}\nb c d e f g h i j k {i}", "h0", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    held = {"max_docs": 20, "min_left": 0.4}
    written = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_rules, "materialise", lambda out, label, **k: written.append((label, out._jdf.queryExecution().executedPlan().toString())) or materialise(out, label, **k))
        here = without_boilerplate(df, **held)
    plan = dict(written)["cleaned"]
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    joined = without_boilerplate(df, few=0, **held)
    assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    got, as_joined = (sorted(map(tuple, x.collect()), key=str) for x in (here, joined))
    assert got == as_joined
    # against the plain version: who stays, and that only boilerplate lines went
    stays = {r[0] for r in brute([(i, t, s) for i, (_, t, s, _) in enumerate(rows)], **held) if r[7]}
    assert sorted((str(rows[i][0]) for i in stays)) == sorted(str(r[0]) for r in got)
    assert 0 < len(got) < len(rows) and any(r[1] != rows[r[0]][1] for r in got if (r[0] or 999) < 200)
    assert without_boilerplate(df.limit(0)).count() == 0
