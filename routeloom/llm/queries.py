"""The registered query of each operator, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.pii import KINDS, find_personal_data, summarise

    out = summarise(*find_personal_data(read(spark, sf_dir, "documents")))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.decontaminate import find_contamination

    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.packing import pack

    out = pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.quality_rules import assess

    return assess(read(spark, sf_dir, "documents")).drop("text_hash")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.substring_dedup import remove_repeats

    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.quality_model import score, train

    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from routeloom.llm._common import scratch_root
    from routeloom.llm.token_files import read_tokens, write_tokens

    path = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    write_tokens(read(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.toxicity import score, train

    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm._common import fresh_folder
    from routeloom.llm.merkle import build, check

    lowered = F.translate("text", _UPPER, _UPPER.lower())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    with fresh_folder(spark, "manifest") as path:
        store = build(read(spark, sf_dir, "documents"), path, altered=F.when(tampered, lowered).otherwise(F.col("text")))
        return check(store)


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.alignment import align

    return align(read(spark, sf_dir, "documents")).documents()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.llm.pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_decontaminate": op2_decontaminate,
        "op3_token_counts": op3_token_counts,
        "op4_pack": op4_pack,
        "op5_quality_rules": op5_quality_rules,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_quality": op7_quality,
        "op8_token_files": op8_token_files,
        "op9_toxicity": op9_toxicity,
        "op10_near_dedup": op10_near_dedup,
        "op11_merkle": op11_merkle,
        "op12_mix": op12_mix,
        "op13_alignment": op13_alignment,
        "pipeline": pipeline,
    }


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

_OP2 = f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, {_PLAIN}), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all({_FOLDED}, {_PLAIN}), []) AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0)),
x AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN (SELECT DISTINCT n FROM k) l ON len(d.w) >= l.n)),
m AS (SELECT x.doc_id, x.s, x.n, k.item_id FROM x JOIN k ON k.n = x.n AND k.k = x.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_OP5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS host, {_WORDS} AS w, text AS raw FROM documents),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 5)) AS p FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, array_to_string(w[s : s + 4], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d)) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, raw, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, host, raw, regexp_extract_all({_FOLDED.replace("text", "line")}, {_PLAIN}) AS p FROM l),
c AS (SELECT host, p FROM f WHERE len(p) > 0 GROUP BY host, p HAVING count(DISTINCT raw) > 50),
g AS (SELECT f.doc_id, sum(len(f.p)) AS plain, sum(CASE WHEN c.p IS NULL THEN len(f.p) ELSE 0 END) AS left_words FROM f LEFT JOIN c ON c.host = f.host AND c.p = f.p GROUP BY f.doc_id),
m AS (SELECT d.doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, g.plain, g.left_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND left_words >= plain * 0.1 AS kept, left_words::bigint AS left_words FROM m"""

_OP6 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c FROM x) WHERE c > 1),
a AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) FILTER (g.p IS NULL) AS kept, count(g.p) AS n FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""



def _field(x: str) -> str:
    return f"coalesce(strlen(({x})::varchar)::varchar || ':' || ({x})::varchar, '-')"


def _tree(nodes: str, levels: int) -> str:
    """CTEs of a tree from {nodes}0 (tree, pos, n, digest) up: {nodes}K, and {nodes}sK with what stands left and right of a node."""
    out = []
    for k in range(levels):
        out.append(f"{nodes}{k + 1} AS (SELECT tree, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {nodes}{k} WHERE n > 1 GROUP BY tree, pos // 16)")
        run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        sides = ", ".join(f"coalesce(string_agg(digest, '') OVER ({run} {a}), '') AS {b}" for a, b in (("UNBOUNDED PRECEDING AND 1 PRECEDING", "l"), ("1 FOLLOWING AND UNBOUNDED FOLLOWING", "r")))
        out.append(f"{nodes}s{k} AS (SELECT tree, pos, {sides} FROM {nodes}{k} WHERE n > 1)")
    last = " UNION ALL ".join(f"SELECT tree, digest FROM {nodes}{k} WHERE n = 1" for k in range(levels + 1))
    return ",\n".join([*out, f"{nodes}last AS ({last})"])


def _climb(rows: str, nodes: str, levels: int) -> str:
    """CTEs {rows}K: rows (doc_id, of, leaf, tree, pos, fold, proof) after K levels of a tree."""
    out = []
    for k in range(levels):
        gone = "s.tree IS NULL"
        out.append(f"""{rows}{k + 1} AS (SELECT p.doc_id, p.of, p.leaf, p.tree, CASE WHEN {gone} THEN p.pos ELSE p.pos // 16 END AS pos, CASE WHEN {gone} THEN p.fold ELSE sha256(s.l || p.fold || s.r) END AS fold, p.proof || coalesce(s.l || s.r, '') AS proof
  FROM {rows}{k} p LEFT JOIN {nodes}s{k} s ON s.tree = p.tree AND s.pos = p.pos)""")
    return ",\n".join(out)


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint FOR c IN string_split(doc_id::varchar, '')]), lambda c, b : list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y : xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint)"
_LEAF = ["doc_id", "source", "lang", "n_chars"]
_DOC_LEVELS, _TOP_LEVELS = 6, 4
_OP11 = f"""WITH l AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({" || ".join(_field(c) for c in [*_LEAF, "text"])}) AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN sha256({" || ".join(_field(c) for c in [*_LEAF, _FOLDED])}) END AS seen FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
d0 AS (SELECT tree, pos, n, leaf AS digest FROM o),
{_tree("d", _DOC_LEVELS)},
t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest, tree AS of FROM dlast),
{_tree("t", _TOP_LEVELS)},
p0 AS (SELECT doc_id, tree AS of, leaf, tree, pos, coalesce(seen, leaf) AS fold, '' AS proof FROM o),
{_climb("p", "d", _DOC_LEVELS)},
q0 AS (SELECT p.doc_id, p.of, p.leaf, '' AS tree, t.pos, p.fold, p.proof FROM p{_DOC_LEVELS} p JOIN t0 t ON t.of = p.of),
{_climb("q", "t", _TOP_LEVELS)}
SELECT doc_id, leaf, dlast.digest AS subroot, tlast.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = tlast.digest AS verified FROM q{_TOP_LEVELS} q JOIN dlast ON dlast.tree = q.of CROSS JOIN tlast"""

_OP12 = f"""WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS tree, len({_WORDS})::bigint AS size, md5('mix:' || doc_id) AS key FROM documents),
s AS (SELECT tree, sum(size)::hugeint AS source_size, (row_number() OVER (ORDER BY tree) - 1) % 3 + 1 AS w FROM d GROUP BY tree),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS heavy, coalesce(sum(3 * source_size) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS heavier FROM s WINDOW o AS (ORDER BY 6 // w * source_size, tree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - caps) * w > cap * (heavy - heavier) AS capped FROM r),
t AS (SELECT tree, source_size::bigint AS source_size, CASE WHEN capped THEN cap::double ELSE ((total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * w)::double / (heavy - coalesce(sum(w) FILTER (capped) OVER (), 0))::double END AS target FROM f),
b AS (SELECT d.*, t.source_size, t.target, floor(t.target)::bigint AS budget, coalesce(sum(size) OVER (PARTITION BY d.tree ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM d JOIN t ON t.tree = d.tree),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint AS taken FROM e"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose results it can express; the others are tested against plain versions."""
    return {"op2_decontaminate": _OP2, "op5_quality_rules": _OP5, "op6_substring_dedup": _OP6, "op11_merkle": _OP11, "op12_mix": _OP12}
