"""Quality rules: measures of each text, and lines that too many documents of a host share.

Lines are normalised (letters and digits, A-Z lowered) and hashed; for each host the distinct
texts that hold a line are counted, so that copies of one text count once. Lines of more texts
than the limit allows are boilerplate there, however large the host is, and a document that has
next to nothing beside boilerplate is rejected.

Boilerplate lines are few beside texts: without_boilerplate hands them to every task, and texts
are judged and cut where they lie. Where they are many, verdicts go to the texts by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm._common import materialise, meet, scope, with_row_id
from routeloom.llm._words import NON_ALNUM, SPACES, Words, mix, pieces, spans

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_INSIDE = np.ones(256, bool)
_INSIDE[list(SPACES)] = False
#: Bytes that start a code point within a word.
_LETTER = (_INSIDE & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Boilerplate lines, counted, that go to every task.
_FEW = 200_000


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _again(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal an earlier one of their row, and which equal any other."""
    key = mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def measures(data: np.ndarray, offsets: np.ndarray, span: int = 5) -> tuple[list[np.ndarray], Words, Words]:
    words, lines = Words(data, offsets), Words(data, offsets, (0x0A,))
    line_rows, word_rows = lines.rows(), words.rows()
    full = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    dup = np.zeros(len(lines), bool)
    dup[full] = _again(line_rows[full], lines.hashes[full])[0]
    cover = np.zeros(len(words) + 1, np.int64)
    fits = np.flatnonzero(words.fits(span))
    twice = fits[_again(word_rows[fits], words.grams(span)[fits])[1]]
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + span, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    out = [words.counts, _within(_LETTER[data], offsets), _within(_SYMBOL[data], offsets), _within(dup, lines.first), _within(repeated, words.first)]
    return out, words, lines


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, Words, np.ndarray, np.ndarray]:
    """Lines, letter and digit words, and the first word and the number of words of each line."""
    lines, plain = Words(data, offsets, (0x0A,)), Words(data, offsets, NON_ALNUM, True)
    first = np.searchsorted(plain.starts, lines.starts)
    return lines, plain, first, np.searchsorted(plain.starts, lines.ends) - first


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[pa.ListArray]]:
    """Letter and digit words; for each row the hashes of its different lines, and the words in all copies of each."""
    lines, plain, first, n = _lines(data, offsets)
    some = np.flatnonzero(n)
    rows, h = lines.rows()[some], spans(plain.hashes, first[some], n[some], 4).view(np.int64)
    # one entry for each different line of a row, with the words of all its copies
    order = np.lexsort((h, rows))
    rows, h, n = rows[order], h[order], n[some][order]
    new = np.ones(len(h), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n, at) if len(at) else n
    bounds = pa.array(np.searchsorted(rows[at], np.arange(len(offsets))).astype(np.int32))
    return plain, [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (h[at], total.astype(np.int32))]


def _measure(batches):
    for b in batches:
        for i, j, data, offsets in pieces(b.column("text")):
            out = measures(data, offsets)[0]
            plain, lists = _distinct(data, offsets)
            keep = [b.column(c).slice(i, j - i) for c in ("doc_id", "host", "text_hash")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x, pa.int64()) for x in out), pa.array(plain.counts, pa.int64()), *lists], ["doc_id", "host", "text_hash", *MEASURES, "plain", "lines", "line_words"])


def _hold(batches):
    for b in batches:
        for i, j, data, offsets in pieces(b.column("text")):
            keep = [b.column(c).slice(i, j - i) for c in ("host", "text_hash")]
            yield pa.RecordBatch.from_arrays([*keep, _distinct(data, offsets)[1][0]], ["host", "text_hash", "lines"])


def _assessed(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, max_docs: int = 50, min_left: float = 0.1) -> DataFrame:
    """assess() with the columns host and lost_lines, the hashes of the text's boilerplate lines (null: none)."""
    with scope(docs.sparkSession):
        return materialise(_judged(docs, min_words, max_repeat, max_docs, min_left), "assessed", keep=True)


def _given() -> list[Column]:
    """Columns host, text_hash and text."""
    return [F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), F.col("text")]


def _judged(docs: DataFrame, min_words: int, max_repeat: int, max_docs: int, min_left: float) -> DataFrame:
    doc = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", *_given())
    schema = f"doc_id {doc}, host string, text_hash long, " + ", ".join(f"{m} long" for m in MEASURES) + ", plain long, lines array<long>, line_words array<int>"
    rows = materialise(given.mapInArrow(_measure, schema), "measures")
    texts = rows.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    held = texts.select("host", "text_hash", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host", "text_hash", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    # a line's texts in a few bundles, so that the commonest line brings no task all of them
    part = F.pmod(F.xxhash64("text_hash"), F.lit(256)).alias("part")
    bundles = materialise(held.groupBy("host", "line", part).agg(F.collect_list(F.struct("text_hash", "words")).alias("t")), "lines")
    common = bundles.groupBy("host", "line").agg(F.sum(F.size("t")).alias("n")).filter(F.col("n") > max_docs).select("host", "line")
    gone = bundles.join(common, ["host", "line"]).select("host", "line", F.explode("t").alias("t"))
    lost = gone.groupBy("host", F.col("t.text_hash").alias("text_hash")).agg(F.sum("t.words").alias("lost"), F.collect_list("line").alias("lost_lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("plain") - F.coalesce("lost", F.lit(0))
    # lost holds only texts with boilerplate; documents keep their rows whatever it says
    out = meet(rows.drop("lines", "line_words"), lost, ["host", "text_hash"], "doc_id", "left")
    return out.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & (left >= F.col("plain") * F.lit(min_left))).alias("kept"), left.alias("left_words"), "text_hash", "host", "lost_lines")


def assess(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, max_docs: int = 50, min_left: float = 0.1) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, left_words, text_hash) for each row of docs.

    A document fails the base rules with fewer than min_words words, or with over max_repeat
    per cent of its words in 5-word windows that occur twice in it. Beyond these, a line is
    boilerplate on its host (column source; null is a host too) if more than max_docs distinct
    texts hold it, at every host size; a document with less than min_left of its letter and digit words outside
    boilerplate (left_words) is rejected.
    text_hash is xxhash64 of the text, 0 for null. Null texts count as empty; empty ones fail.
    Rows with equal doc_id stay apart, equal ones too; no rows give no rows; columns other than
    doc_id, text and source aren't looked at, whatever their names.
    """
    return _assessed(docs, min_words, max_repeat, max_docs, min_left).drop("host", "lost_lines")


def _cut(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> str:
    """A text's bytes without some of its lines."""
    keep = np.ones(len(data), bool)
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        # a line goes with the end of line after it, the last one with that before it
        keep[begin : end + 1] = False
        if end == len(data):
            before = np.flatnonzero(keep[:begin])
            if len(before) and data[before[-1]] == 0x0A:
                keep[before[-1]] = False
    return data[keep].tobytes().decode()


def _without(text: pa.Array, lost: pa.Array) -> pa.Array:
    """Texts without the lines whose hashes are in lost; null where either is null."""
    out = []
    for t, gone in zip(text, lost, strict=True):
        if not t.is_valid or not gone.is_valid:
            out.append(None)
            continue
        data = np.frombuffer(t.as_py().encode(), np.uint8)
        lines, plain, first, n = _lines(data, np.array([0, len(data)]))
        some = np.flatnonzero(n)
        h = spans(plain.hashes, first[some], n[some], 4).view(np.int64)
        at = some[np.isin(h, gone.values.to_numpy())]
        out.append(_cut(data, lines.starts[at], lines.ends[at]))
    return pa.array(out, pa.string())


def _common(docs: DataFrame, max_docs: int) -> DataFrame:
    """Rows (host, line) of the boilerplate lines."""
    texts = docs.select(*_given()).mapInArrow(_hold, "host string, text_hash long, lines array<long>").groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    return texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select("host", "line")


def _cleaner(common: DataFrame, min_words: int, max_repeat: int, min_left: float):
    """A function of text and host: whether the text stays, and what is left of it (null: all)."""
    table = common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")).collect()
    box = common.sparkSession.sparkContext.broadcast(([r.host for r in table], [np.array(r.lines, np.int64) for r in table]))

    def run(text: pa.Array, host: pa.Array) -> pa.Array:
        hosts, gone = box.value
        of_row = pc.index_in(host, pa.array(hosts, host.type)).fill_null(-1).to_numpy()
        kept, out = [], []
        for i, j, data, offsets in pieces(text):
            base = dict(zip(MEASURES, measures(data, offsets)[0], strict=True))
            failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat * base["n_words"])
            lines, plain, first, n = _lines(data, offsets)
            some = np.flatnonzero(n)
            h, of = spans(plain.hashes, first[some], n[some], 4).view(np.int64), of_row[i:j][lines.rows()[some]]
            hit = np.zeros(len(lines), bool)
            for k in np.unique(of[of >= 0]):
                own = np.flatnonzero(of == k)
                hit[some[own]] = gone[k][np.searchsorted(gone[k][:-1], h[own])] == h[own]
            left = plain.counts - _within(np.where(hit, n, 0), lines.first)
            stays = ~failed & (left >= plain.counts * min_left)
            kept.append(stays)
            for r, cut in enumerate(stays & (left < plain.counts)):
                at = lines.first[r] + np.flatnonzero(hit[lines.first[r] : lines.first[r + 1]]) if cut else ()
                out.append(_cut(data[offsets[r] : offsets[r + 1]], lines.starts[at] - offsets[r], lines.ends[at] - offsets[r]) if cut else None)
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, bool), *kept])), pa.array(out, pa.string())], ["kept", "text"])

    # said to be nondeterministic so that a filter on its result doesn't run it a second time
    return F.arrow_udf(run, "kept boolean, text string").asNondeterministic()


def without_boilerplate(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, max_docs: int = 50, min_left: float = 0.1, few: int = _FEW, changed: str | None = None) -> DataFrame:
    """docs with all their columns, without the rows that assess() rejects and, in those kept, without boilerplate lines.

    Texts without such lines stay to the letter. docs need the columns that assess() needs. Up to
    few boilerplate lines go to every task, with more of them texts are shuffled; the result is the same.
    changed names a boolean column to add: whether the text has lost lines.
    """
    folded = docs.select("doc_id", "source", F.struct(*docs.columns).alias("routeloom_row"))
    text = F.col("routeloom_row")["text"].alias("text")
    more = [F.col("cut").isNotNull().alias(changed)] if changed else []
    out = [*(F.coalesce("cut", text).alias(c) if c == "text" else F.col("routeloom_row")[c].alias(c) for c in docs.columns), *more]
    with scope(docs.sparkSession):
        common = materialise(_common(folded.select("source", text), max_docs), "common")
        if common.count() <= few:
            clean = _cleaner(common, min_words, max_repeat, min_left)
            both = folded.select("routeloom_row", clean(text, _given()[0]).alias("made")).filter("made.kept").select(F.col("made.text").alias("cut"), "routeloom_row")
            # written here, where texts go to Python in small batches: later on, the session's size of batches would hold
            return materialise(both.select(*out), "cleaned", keep=True)
    rows = with_row_id(folded, ["source", "routeloom_row"])
    judged = _assessed(rows.select(F.col("rid").alias("doc_id"), text, "source"), min_words, max_repeat, max_docs, min_left)
    # verdicts go by row: copies of one text are many rows, never one key
    verdicts = judged.filter("NOT kept OR lost_lines IS NOT NULL").select(F.col("doc_id").alias("rid"), "kept", "lost_lines")
    both = rows.select("rid", "routeloom_row").join(verdicts, "rid", "left").filter("kept IS NULL OR kept")
    cut = F.arrow_udf(_without, "string")(F.when(F.col("lost_lines").isNotNull(), text), F.col("lost_lines"))
    return both.select(cut.alias("cut"), "routeloom_row").select(*out)
