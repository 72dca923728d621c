import pytest
from pyspark.sql import functions as F

from routeloom.llm.token_counts import RULES, count_tokens

ODD = [None, "", "\n", "one\n\n\n  two\n", "é\nñandú 🙂🙂\n日本\n", "no newline", "a\n" * 300, "x" * 3000 + "\n", "<|endoftext|>\n#%&\n\n\n\n\n"]


def brute(text, rule):
    """By the tokenizer's other implementation, character by character."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    text = text or ""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)] + [len(text)]
    of = [sum(i >= e for e in ends) for i in range(len(text))]
    n, over, last = [0] * len(ends), [0] * len(ends), 0
    for s, e in t.encode(text, add_special_tokens=False).offsets:
        s, last = max(s, last), max(e, last)  # a character shared by tokens is the first one's
        own = [of[i] for i in range(s, e)] or [of[min(s, len(text) - 1)]]
        best = {"first": own[0], "last": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]
        n[best] += 1
        over[best] += own[0] != own[-1]
    return [(k, ends[k - 1] if k else 0, ends[k], n[k], over[k]) for k in range(len(ends))]


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_against_brute_force(spark, rule):
    rows = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("section", F.lit("clash"))
    got = {}
    for r in count_tokens(df, rule).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for d, text in rows:
        want = brute(text, rule)
        assert sum(x[3] for x in got[d]) == sum(x[3] for x in want)
        assert sorted(got[d]) == want, (d, text and text[:50])


def test_empty(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "c")], "doc_id long, text string")
    assert count_tokens(df).count() == 5
    assert count_tokens(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", RULES)
def test_characters_of_several_tokens_at_the_end_of_a_section(spark, rule):
    texts = ["ab\n\U00013000", "\U00013000\n\U00013000\U00013001", "\U00013000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, text in enumerate(texts):
        own = [r for r in count_tokens(df, rule).collect() if r.doc_id == i]
        assert len(own) == text.count("\n") + 1 and all(0 <= r.n_crossing <= r.n_tokens for r in own)
        assert own[-1].n_tokens > 1
