import hashlib
import json
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routeloom.llm._common import tokenizer_path
from routeloom.llm.alignment import A_FILE, B_FILE, Aligner, align, vocabulary

ODD = [
    "", " ", "  ", "\n", " a", "a ", "a  ", "a\n b", "a \n b", "It's   THE end.\tI'll see;they'd go...", "x▁y", "▁", "Ünïcode ÉÀ ñandú ΣΑΣ İ", "a<|endoftext|>b <s> </s> <unk> <0x41>", "é b\xa0 c　 d  e\x85 f", "日本語 テキスト 한국어",
    "🙂 👍🏽  x\x00 b\x01 c", "ﬁ Å K", "a\r\n b", "x" * 3000, "12,345.67 #$%& word&&& THE!!", "don't''s 's", "​ a   b  c  d  e  f", "a\x1c b\x1f c",
]


@lru_cache(1)
def tools():
    a = Tokenizer.from_file(tokenizer_path(A_FILE))
    a.encode_special_tokens = True
    names = {i: t for t, i in json.load(open(tokenizer_path(A_FILE)))["model"]["vocab"].items()}
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B_FILE)), names


def spelled(b, i):
    p = b.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and b.is_byte(i) else p.replace("▁", " ").encode()


def byte_letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(x): x for x in own}, 0
    for x in range(256):
        if x not in own:
            out[chr(256 + n)] = x
            n += 1
    return out


LETTERS = byte_letters()


def whole(text):
    """(A ids, B ids, their ends) of a whole text, or None."""
    a, b, names = tools()
    if not text:
        return None
    p, q = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    pa, qb = [bytes(LETTERS[c] for c in names[i]) for i in p], [spelled(b, i) for i in q]
    if not b"".join(pa) == b"".join(qb) == b" " + text.encode():
        return None
    return p, q, np.cumsum([len(x) for x in pa]).tolist(), np.cumsum([len(x) for x in qb]).tolist()


def plain(rows, by_documents=False):
    per, counts = [], Counter()
    for i, text in rows:
        own = whole(text)
        if own is None:
            per.append((i, 0, 0, 0, [], ""))
            continue
        p, q, pe, qe = own
        links, x, y = [], 0, 0
        while x < len(p) and y < len(q):
            links.append((p[x], q[y]))
            ends = pe[x], qe[y]
            x, y = x + (ends[0] <= ends[1]), y + (ends[1] <= ends[0])
        groups, la, lb = [], 0, 0
        for e in sorted(set(pe) & set(qe)):
            ga, gb = pe.index(e, la) + 1, qe.index(e, lb) + 1
            groups.append(",".join(map(str, p[la:ga])) + "|" + ",".join(map(str, q[lb:gb])))
            la, lb = ga, gb
        counts.update(links)
        per.append((i, len(p), len(q), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, t), n in counts.items():
        best[t] = max(best.get(t, 0), n)
    return [(i, a, b, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), s) for i, a, b, g, ls, s in per]


@pytest.fixture(scope="module")
def rows(spark):
    own = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return list(enumerate([*ODD, None, *own, own[3], own[3]])) + [(3, "twice the id"), (None, "no id")]


@pytest.mark.parametrize("target", [500, 1 << 22])
def test_equals_whole_texts(spark, rows, target):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "slice": F.lit("x"), "docs": F.lit(2)}).repartition(3)
    got = align(docs, target=target).documents().collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))
    assert sum(r.n_groups > 0 for r in got) > 100 and sum(r.n_groups == 0 for r in got) > 2


def test_no_rows(spark):
    out = align(spark.createDataFrame([], "doc_id long, text string")).documents()
    assert out.collect() == [] and out.columns[:3] == ["doc_id", "n_a", "n_b"]


def test_tables_of_links(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[1]][:60], "doc_id long, text string")
    found = align(docs)
    per = plain([r for r in rows if r[1]][:60])
    assert found.links.agg(F.sum("count")).first()[0] == sum(r[4] for r in per)
    assert found.groups.count() == found.groups.select("key").distinct().count()
    by_docs = align(docs, multiply="documents")
    # a group counts once for each text at most
    assert by_docs.groups.agg(F.max("freq")).first()[0] <= 60
    assert by_docs.links.filter("best").select("b").distinct().count() == found.links.select("b").distinct().count()


def test_memory_does_not_tell(rows):
    v = vocabulary(tokenizer_path(A_FILE), tokenizer_path(B_FILE))
    raw = [(t or "").encode() for _, t in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    small, large = Aligner(v, limit=5), Aligner(v)
    for _ in range(2):
        a, b = small.slice(data, offsets), large.slice(data, offsets)
        assert all((x == y).all() for x, y in zip(a[:4], b[:4], strict=True))
        assert [small.keys[i] for i in a[4]] == [large.keys[i] for i in b[4]]
