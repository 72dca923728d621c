import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from routeloom.llm._common import tokenizer_path
from routeloom.llm._tokens import Encoder
from routeloom.llm.packing import pack, plan
from routeloom.llm.token_files import Coder, read_tokens, scaled, write_tokens

PATH = tokenizer_path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\n", "It's   THE end.\tI'll see;they'd go...", "Ünïcode ÉÀ ñandú ΣΑΣ İstanbul ǅ ẞ ﬁ", "a<|endoftext|>b <|startoftext|>", "é ́a x̸",
    "12,345.67 #$%& word&&& THE!! don't''s", " nbsp em　x", "日本語 テキスト 한국어 한", "🙂👍🏽 a\x00b", "'s 's' ''ll", "x" * 5000, "| | |",
    "a<|EndOfText|>B", "<|ENDOFTEXT|> <|StartOfText|>", "T<", "|x", "ALİ, VELİ.", "don't DON'T I'LL we're 'ssss ''s '' 'v 've 'reX a's1 1's l'École x'll9 'S!", "a×b ÷ À× Þ.,!",
    "a\x1cb\x1fc\x85d", " \x01 a\x01b", "</w> x</w>y", "'r e 'v\ne '", "≮ a≠b é́.",
]


@pytest.fixture(scope="module")
def docs(spark):
    own = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return spark.createDataFrame(list(enumerate([*ODD, None, *own[:120]])), "doc_id long, text string")


@lru_cache(1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(text, end):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_the_tokenizer(docs):
    e = Encoder(PATH, limit=500, window=300)
    for r in docs.collect():
        assert [*e.encode(r.text), 0] == whole(r.text, 0).tolist(), r.text


def test_letters_before_signs_and_mixed_rows():
    r = random.Random(3)
    texts = [chr(c) + s for c in [*range(0x530), *range(0x900, 0xA40), *range(0x1E00, 0x2100)] for s in ("!", " !", "x.")]
    texts += ["".join(r.choice("abéÀß'sStTlLrReEvVmMdD 1!?<|>\n\t×İ\u0301 日'") for _ in range(r.randint(1, 60))) for _ in range(5000)]
    raw = [t.encode() for t in texts]
    for window in (3000, 1 << 20):
        ids, n = Encoder(PATH, limit=2000, window=window).encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [x.ids for x in library().encode_batch_fast(texts, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_printed_parts_pass_without_byte_level_spelling():
    e = Encoder(PATH)
    parts = pa.array([b"ofhablely", b"!!", b"\x02", b"7", "é".encode(), b"~#", b"\x7f"], pa.binary())
    places = e._learn(parts, np.zeros(len(parts), bool))
    at = np.cumsum(e.sizes) - e.sizes
    for s, k in zip(parts.to_pylist(), places.tolist(), strict=True):
        assert e.names[k].as_py() == s and e.ids[at[k] : at[k] + e.sizes[k]].tolist() == library().encode(s.decode(), add_special_tokens=False).ids
    assert sorted(places.tolist()) == list(range(len(parts)))
    assert e.printed.encode("of habl!!", add_special_tokens=False).ids == e.plain.encode("of habl!!", add_special_tokens=False).ids


def test_plan_places_everything_and_wastes_little():
    r = random.Random(1)
    for capacity in (10, 64, 2048):
        for _ in range(20):
            counts = {r.randint(1, capacity): r.randint(1, 500) for _ in range(r.randint(0, 60))}
            bins = plan(counts, capacity)
            have: dict = {}
            for many, each in bins:
                assert many > 0 and sum(n * m for n, m in each) <= capacity
                assert sum(m for n, m in each if 3 * n > capacity) <= 2
                for n, m in each:
                    have[n] = have.get(n, 0) + many * m
            assert have == counts
            least = max(-(-sum(n * c for n, c in counts.items()) // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))
            assert sum(many for many, _ in bins) <= 1.3 * least + 2


def test_pack(spark, docs):
    text = {r.doc_id: whole(r.text, 0) for r in docs.collect()}
    for capacity in (64, 2048):
        rows = pack(docs, capacity).collect()
        assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == sorted((d, s // capacity, s, min(capacity, len(t) - s)) for d, t in text.items() for s in range(0, len(t), capacity))
        by: dict = {}
        for r in rows:
            assert r.ids == text[r.doc_id][r.start : r.start + r.length].tobytes()
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in by.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= capacity
    twice = pack(spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (None, None, None, None)], "doc_id long, text string, ids string, rid int")).collect()
    assert len(twice) == 3 and {r.sequence_id for r in twice} == {0}
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_coder_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 70_001):
        ids = (r.zipf(1.3, n) % 40_000).astype(np.uint32)
        c = Coder(scaled(np.bincount(ids, minlength=1 << 16)))
        p = c.encode(ids, lanes=64, every=8)
        assert (c.decode(p) == ids).all()
        if n > 10_000:
            assert (c.decode(p, 3, 5) == ids[3 * 8 * 64 : 5 * 8 * 64]).all() and len(p) < 2 * n
            with pytest.raises(ValueError):
                c.decode(p[:-1] + bytes([p[-1] ^ 1]))
            wrong = Coder(scaled(np.bincount(ids[::-1][: n // 2], minlength=1 << 16) + 1))
            with pytest.raises(ValueError):
                wrong.decode(p, 3, 5)


def test_files(spark, docs, tmp_path):
    write_tokens(docs.repartition(3), f"file://{tmp_path}/t", block_tokens=5000)
    rows = read_tokens(spark, f"file://{tmp_path}/t").orderBy("doc_id").collect()
    at = 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = whole(d.text, 2)
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = read_tokens(spark, f"file://{tmp_path}/t", at // 3, at // 2).orderBy("doc_id").collect()
    assert some == [r for r in rows if r.start < at // 2 and r.start + r.n_tokens > at // 3] and len(some) > 2
    odd = spark.createDataFrame([(2, "b", 0), (2, "a", 1), (None, None, 2)], "doc_id long, text string, start int")
    write_tokens(odd, f"file://{tmp_path}/u")
    assert [(r.doc_id, r.start) for r in read_tokens(spark, f"file://{tmp_path}/u").orderBy("start").collect()] == [(None, 0), (2, 1), (2, 3)]
    write_tokens(odd.limit(0), f"file://{tmp_path}/v")
    assert read_tokens(spark, f"file://{tmp_path}/v").count() == 0
