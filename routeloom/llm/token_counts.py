"""Token counts of the sections of a text, from one encoding of the whole text.

The tokenizer is byte-level, so the bytes of the tokens add up to the text and give every
token its span of characters. Spans are joined with the sections' intervals (both are sorted,
so a binary search does it), and a token that crosses a boundary goes to one section by an
explicit rule.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from routeloom.llm._common import tokenizer_path

RULES = ("most", "first", "last")


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def allot(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary; spans run from 0 and are given by their ends.

    "most": the section with the most of the token, the earliest of equals; "first" and
    "last": the section of its first or last character.
    """
    starts = np.concatenate([[0], token_ends[:-1]])
    last = len(section_ends) - 1
    a = np.minimum(np.searchsorted(section_ends, starts, "right"), last)
    # a token without characters ends where it starts, and crosses nothing
    b = np.maximum(np.minimum(np.searchsorted(section_ends, token_ends, "left"), last), a)
    crosses = a != b
    out = b if rule == "last" else a
    if rule == "most" and crosses.any():
        out = a.copy()
        for t in np.flatnonzero(crosses):
            inner = section_ends[a[t] : b[t]]
            edges = np.concatenate([[starts[t]], inner, [token_ends[t]]])
            out[t] = a[t] + int(np.diff(edges).argmax())
    return out, crosses


def _count(path: str, pattern: str, rule: str, separator: str):
    cut = re.compile(separator)

    def run(batches):
        encoding, sizes = _encoding(path, pattern)
        for b in batches:
            rows, section, starts, ends, tokens, crossing = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                text = text or ""
                own = np.array([m.end() for m in cut.finditer(text) if m.end() < len(text)] + [len(text)], np.int64)
                n, over = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                if text:
                    data = text.encode()
                    at = np.cumsum(sizes[encoding.encode_to_numpy(text, disallowed_special=())])
                    if len(data) != len(text):
                        # characters up to each byte; a token that ends within a character counts it as its own
                        lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                        at = np.minimum(lead[at - 1], len(text))
                    which, crosses = allot(at, own, rule)
                    n = np.bincount(np.minimum(which, len(own) - 1), minlength=len(own))
                    over = np.bincount(which[crosses], minlength=len(own))
                rows.append(np.full(len(own), i))
                section.append(np.arange(len(own)))
                starts.append(np.concatenate([[0], own[:-1]]))
                ends.append(own)
                tokens.append(n)
                crossing.append(over)
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            parts = [pa.array(np.concatenate(x).astype(np.int64)) for x in (section, starts, ends, tokens, crossing)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), *parts], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return run


def count_tokens(docs: DataFrame, rule: str = "most", separator: str = "\n", tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows (doc_id, section, start, end, n_tokens, n_crossing), one for each section of each text.

    A section ends after each match of separator, and at the end; start and end are in code
    points. n_crossing of the tokens allotted to a section cross a boundary. A character whose
    bytes are in several tokens belongs to the first of them; the others then have no
    characters of their own and go where they start. Null and empty texts are one empty
    section without tokens. Rows with equal doc_id stay apart; other columns aren't looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    import public_tokenizers

    doc = docs.schema["doc_id"].dataType.simpleString()
    run = _count(tokenizer_path(tokenizer), public_tokenizers.PATTERN, rule, separator)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, section long, start long, end long, n_tokens long, n_crossing long")
