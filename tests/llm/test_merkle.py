import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from routeloom.llm._common import fresh_folder
from routeloom.llm.merkle import Store, build, check

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def h(values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(digests):
    """What remains of some nodes, and of each one the siblings to the left and to the right at every level."""
    paths = [[] for _ in digests]
    places, level = list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for n, p in enumerate(places):
            run = runs[p // 16]
            paths[n].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        places, level = [p // 16 for p in places], [h(r) for r in runs]
    return level[0], paths


def plain(rows, lowered):
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), by a plain loop."""
    out, trees = [], {}
    for r in rows:
        trees.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    subs = []
    for k in sorted(trees):
        own = sorted(trees[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append((own, *climb([leaf(r) for r in own])))
    if not subs:
        return []
    root, tops = climb([s[1] for s in subs])
    for (own, sub, paths), top in zip(subs, tops, strict=True):
        for r, p in zip(own, paths, strict=True):
            path = [*p, *top]
            d = leaf(r)
            if lowered(r[0]) and r[4] is not None:
                d = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                d = h([a, d, b])
            out.append((r[0], leaf(r), sub, root, h(a + b for a, b in path), d, d == root))
    return out


def some_rows():
    rows = [(i, f"s{i % 3}" if i % 7 else None, "en", 5, f"Text {i} É\n") for i in range(700)]
    rows += [(5000 + i, "long", None, None, f"ONE {i}") for i in range(300)]
    rows += [(i, f"lone{i}", "de", 1, None) for i in range(9000, 9040)]
    return [*rows, (3, "s0", "en", 5, "Again"), (3, "s0", "en", 5, "Again"), (None, "s0", None, None, "No ID"), (None, None, None, None, None), (77, "", "", 0, "")]


@pytest.mark.parametrize("rows", [[], [(1, "a", "b", 2, "C")], some_rows()], ids=["none", "lone", "many"])
def test_equals_a_plain_loop(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "at": F.lit(1), "digest": F.lit("y"), "seen": F.lit(0)})
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    with fresh_folder(spark, "manifest") as path:
        got = check(build(docs, path, F.when(tampered, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text")))).collect()
    want = plain(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_stored_manifest_is_read_again_and_sees_any_change(spark):
    rows = some_rows()
    with fresh_folder(spark, "manifest") as path, fresh_folder(spark, "other") as other:
        root = build(spark.createDataFrame(rows, SCHEMA), path).root()
        store = Store(spark, path)
        assert store.root() == root == plain(rows, lambda _: False)[0][3]
        assert store.subroots().count() == 46
        assert store.levels == {"documents": 4, "sources": 3}
        changed = [*rows[:10], (*rows[10][:4], "Text 10"), *rows[11:]]
        assert build(spark.createDataFrame(changed, SCHEMA), other).root() != root
        # without a claimed text all proofs lead to the root
        proofs = store.proofs()
        assert proofs.count() == len(rows)
        assert proofs.filter(F.size("path") == 5).count() > 0
