"""Personal data by patterns, and by contexts that the found data teach.

Four kinds are found by their form. Their occurrences are seeds: the two words before one are
a lexical pattern, and patterns and instances (identifier-like strings, seeds and others)
make a bipartite graph. Scores go back and forth over it: a pattern is as good as the
share of its instances that are believed to be of its kind, an instance is believed as far as
some good pattern vouches for it. What a pattern with enough believed instances and a high score
stands before is a span of that kind, though its form says nothing.

All steps are DataFrame operations on built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm._common import materialise, meet, scope, with_row_id

KINDS = ("email", "ip", "card", "phone")
#: The forms, with possessive repeats and starts at the edge of a run only, so that no text takes more than linear time.
#: \G admits a start within a run, where the last match ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What can be an identifier: groups of digits joined by blanks, brackets and hyphens, or a stretch without white space
#: that holds a digit, an @ or an (at), to its end. What is scanned is matched, so no text takes more than linear time.
_GROUP = r"[0-9][0-9()./-]*+(?=[\s,;:!?\"'>\]}|]|$)"
CANDIDATE = rf"(?<!\S)(?:[+(]*+{_GROUP}(?:\x20[(]?{_GROUP})++|(?:[^\s0-9@(\[{{]++|[(\[{{](?![aA][tT][)\]}}]))*+(?:[0-9@]|[(\[{{][aA][tT][)\]}}])\S*+)"
#: Something that a form's text must hold, looked for first.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": "", "other": ""}


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")).otherwise(999) <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def find_forms(rows: DataFrame) -> DataFrame:
    """Rows (rid, kind, start, end, match, context, valid) of each form's matches and the identifier-like strings ("other") in rows (rid, text)."""
    forms = FORMS | {"other": CANDIDATE}
    found = rows.select("rid", "text", *(F.when(F.contains("text", F.lit(_NEEDS[k])), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(k) for k, p in forms.items()))
    found = found.filter(" OR ".join(f"size({k}) > 0" for k in forms))

    def each(kind: str, form: str) -> Column:
        pieces = F.arrays_zip(F.split("text", form, -1).alias("gap"), F.col(kind).alias("match"))
        own = F.transform(pieces, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p["gap"]).alias("gap"), p["match"].alias("match"), F.lower(F.reverse(F.regexp_extract(F.reverse(p["gap"]), r"^(\s++\S++\s++\S++)", 1))).alias("context")))
        return F.when(F.size(kind) > 0, F.filter(own, lambda x: x["match"].isNotNull()))

    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,context:string>>")
    flat = found.select("rid", F.explode(F.concat(*(F.coalesce(each(k, p), empty) for k, p in forms.items()))).alias("m")).select("rid", "m.*")
    flat = materialise(flat, "matches")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.col("gap") + F.length("match")).over(before)
    placed = flat.select("rid", "kind", (ends - F.length("match")).alias("start"), ends.alias("end"), "match", F.trim(F.regexp_replace(F.regexp_replace("context", "[0-9]", "0"), r"\s+", " ")).alias("context"))
    # signs around an identifier aren't part of it
    head = F.length(F.regexp_extract("match", r"^[\"'(<\[{]*", 0))
    tail = F.length(F.regexp_extract("match", r"[\"')>\]}.,;:!?|]*$", 0))
    other = F.col("kind") == "other"
    trimmed = placed.withColumns({"h": F.when(other, head).otherwise(0), "t": F.when(other, tail).otherwise(0)})
    trimmed = trimmed.select("rid", "kind", (F.col("start") + F.col("h")).alias("start"), (F.col("end") - F.col("t")).alias("end"), F.expr("substring(match, h + 1, length(match) - h - t)").alias("match"), "context")
    return trimmed.filter("end > start").withColumn("valid", _valid(F.col("kind"), F.col("match")))


def learn(seen: DataFrame, turns: int, least_seeds: int, least_score: float) -> DataFrame:
    """Rows (context, kind) of the patterns to trust, from occurrences (context, instance, kind; kind null: not a seed).

    A pattern needs least_seeds seeds in the first turn, later as much belief in its different
    instances, so that what one pattern discovers can teach the next.
    """
    edges = materialise(seen.filter("context <> ''").groupBy("context", "instance").agg(F.max("kind").alias("kind")), "edges")
    sizes = edges.groupBy("context").agg(F.count("*").alias("n"))
    belief = edges.filter("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("belief")).distinct()
    scores = None
    for turn in range(turns):
        known = meet(edges.select("context", "instance", F.col("kind").alias("seed")), belief, ["instance"], "context")
        scores = known.groupBy("context", "kind").agg(F.sum("belief").alias("s"), F.count_if(F.col("seed") == F.col("kind")).alias("seeds")).join(sizes, "context")
        scores = scores.select("context", "kind", "seeds", "s", (F.col("s") / (F.col("n") + 1)).alias("score")).filter(F.col("seeds" if turn == 0 else "s") >= least_seeds)
        scores = materialise(scores, "scores")
        vouched = meet(edges.filter("kind IS NULL").select("context", "instance"), scores.filter("score >= 0.5"), ["context"], "instance")
        vouched = vouched.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("belief"))
        belief = edges.filter("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("belief")).distinct().unionByName(vouched)
    best = scores.filter(F.col("score") >= least_score).groupBy("context").agg(F.max(F.struct("score", "kind")).alias("top"))
    return best.select("context", "top.kind")


def find_personal_data(docs: DataFrame, turns: int = 3, least_seeds: int = 5, least_score: float = 0.8, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (rid, doc_id, extra columns, text) of docs, and spans (rid, kind, start, end, base), in code points, end exclusive.

    base tells the spans that have a form from those that a context gave away. Null and empty
    texts have none. Rows with equal doc_id stay apart, by rid, which extra may not name; a span that overlaps one with
    a form is not added, and equal spans of one kind count once.
    """
    rows = with_row_id(docs, [*extra, "text"])
    with scope(docs.sparkSession):
        spans = materialise(_spans(rows.select("rid", "text"), turns, least_seeds, least_score), "spans", keep=True)
    return rows, spans


def _spans(texts: DataFrame, turns: int, least_seeds: int, least_score: float) -> DataFrame:
    found = find_forms(texts).filter("valid").drop("valid")
    # a span is taken if one with a form begins before its end and ends after its start
    is_base = F.col("kind") != "other"
    own = Window.partitionBy("rid").orderBy("start")
    before = F.max(F.when(is_base, F.col("end"))).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(is_base, F.col("start"))).over(own.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    taken = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    found = materialise(found.withColumn("taken", taken).filter(is_base | ~F.col("taken")).drop("taken"), "forms")
    base, free = found.filter("kind <> 'other'"), found.filter("kind = 'other'")
    seen = base.select("context", F.lower("match").alias("instance"), "kind").unionByName(free.select("context", F.lower("match").alias("instance"), F.lit(None).cast("string").alias("kind")))
    trusted = learn(seen, turns, least_seeds, least_score)
    added = meet(free.drop("kind"), trusted, ["context"], "rid").select("rid", "kind", "start", "end", F.lit(False).alias("base"))
    return base.select("rid", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added)


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted structs (order, start, end), joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["o"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summarise(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_spans), base and spans as kind:start:end lists; the first counts are of base spans."""
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    entry = F.struct(order.alias("o"), F.col("start"), F.col("end"))
    own = spans.groupBy("rid").agg(*(F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS), F.collect_list(F.when(F.col("base"), entry)).alias("b"), F.collect_list(entry).alias("s"))
    own = own.select("rid", *(f"n_{k}" for k in KINDS), _listed(F.col("b")).alias("base"), _listed(F.col("s")).alias("spans"), F.size("s").cast("long").alias("n_spans"))
    out = rows.select("rid", "doc_id").join(own, "rid", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS), F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"))


def mask(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (rid, text) with each span replaced by its kind in brackets; of overlapping spans the first names the stretch.

    Rows without spans, null and empty texts among them, stay to the letter.
    """
    order = Window.partitionBy("rid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.select("rid", "kind", "start", "end", F.coalesce(F.max("end").over(order), F.lit(0)).alias("at"))
    # a span that begins within what has gone already only moves the end of it
    first = F.when(F.col("start") >= F.col("at"), F.struct("start", "at", "kind"))
    own = cut.groupBy("rid").agg(F.array_sort(F.collect_list(first)).alias("s"), F.max("end").alias("last"))
    before = lambda s: F.substring(F.col("text"), (s["at"] + 1).cast("int"), (s["start"] - s["at"]).cast("int"))
    parts = F.transform("s", lambda s: F.concat(before(s), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    masked = F.concat(F.array_join(parts, ""), F.substring(F.col("text"), (F.col("last") + 1).cast("int"), F.length("text")))
    return rows.join(own, "rid", "left").withColumn("text", F.when(F.col("s").isNull(), F.col("text")).otherwise(masked)).drop("s", "last")
