"""Personal data: four base patterns, and a bootstrap that finds further identifiers by their context.

Spans of the base patterns are the seeds. The word before a span (or glued to its front) is its lexical
pattern; every identifier-like token that stands behind some pattern is an instance. On the graph of
patterns and instances Spark repeats: a pattern's confidence is the weighted share of its instances that
are of a kind, an unlabelled instance's confidence the mean over its patterns. Tokens behind patterns of
high confidence become spans of that kind. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.sources.storage import checkpointed

KINDS = ("email", "ip", "card", "phone")
# Each start is the start of a run or the end of the last match, and runs are possessive, so that no text takes quadratic time.
_LOCAL, _LABEL, _TOKEN = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++", "A-Za-z0-9@._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "token": rf"(?:\G|(?<![{_TOKEN}]))[A-Za-z._%+-]*+[0-9@][{_TOKEN}]*+",
}
#: A text without any of these characters holds no span and no identifier-like token.
ANY = "[0-9@]"
CONTEXT_CHARS = 48
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.7, 5


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    padded = F.lpad(digits, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    luhn = sum((F.substring(doubled if i % 2 else padded, i, 1).cast("int") for i in range(2, 21)), F.substring(doubled, 1, 1).cast("int"))
    parts_ok = found.rlike(r"^(?:(?:^|\.)0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){4}$")
    size = F.length(digits)
    return (
        F.when(kind == "ip", parts_ok)
        .when(kind == "card", size.between(12, 19) & (F.when(size <= 19, luhn % 10) == 0))
        .when(kind == "phone", size.between(9, 15))
        .when(kind == "token", (F.length(found) >= 6) & ((size >= 4) | F.contains(found, F.lit("@"))))
        .otherwise(F.lit(True))
    )


def _matches(kind: str, text: str) -> Column:
    """Matches of one pattern with the length of the text before each and its last word."""
    pattern = F.lit(PATTERNS[kind])
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, PATTERNS[kind], -1).alias("before"))

    def row(x: Column, i: Column) -> Column:
        near = F.lower(F.right(x["before"], F.lit(CONTEXT_CHARS)))
        left = F.regexp_replace(F.element_at(F.split(F.regexp_replace(near, r"\s++\z", " "), r"\s++(?=\S)"), -1), "[0-9]", "0")
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["before"]).alias("gap"), x["found"].alias("found"), left.alias("pattern"))

    return F.filter(F.transform(both, row), lambda x: x["found"].isNotNull())


def _spans(hot: DataFrame) -> DataFrame:
    """(rid, kind, start, end, found, pattern): valid base spans, and identifier-like tokens that meet none."""
    rows = hot.select("rid", F.explode(F.concat(*(_matches(k, "_text") for k in PATTERNS))).alias("m")).select("rid", "m.*").repartition("rid")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(before).cast("bigint")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("found")).where(_valid(F.col("kind"), F.col("found")))
    base = F.col("kind") != "token"
    by_start = Window.partitionBy("rid").orderBy("start", F.col("kind") == "token")
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"reach": reach, "ahead": ahead})
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    return rows.where(base | free).select("rid", "kind", "start", "end", F.when(F.length("found") > 64, F.sha2("found", 256)).otherwise(F.lower("found")).alias("found"), "pattern")


def learn_patterns(spans: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that stand before identifiers of one kind.

    ``spans`` is pre-aggregated to one row per (pattern, instance), so a pattern that stands before a third
    of all tokens costs as many rows as it has instances.
    """
    edges = checkpointed(spans.where("pattern <> ''").groupBy("pattern", "found").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("kind") != "token", F.col("kind"))).alias("seed")))
    seeds = edges.where("seed is not null").groupBy("found").agg(F.min("seed").alias("kind")).select("found", "kind", F.lit(1.0).alias("c"))
    known = checkpointed(seeds)
    total = checkpointed(edges.groupBy("pattern").agg(F.sum("n").alias("all")))
    weights = known
    for step in range(rounds):
        scored = edges.join(weights, "found").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("c")).alias("s"), F.sum((F.col("c") > 0.5).cast("int")).alias("backing"))
        patterns = checkpointed(scored.join(total, "pattern").select("pattern", "kind", (F.col("s") / (F.col("all") + 1)).alias("confidence"), "backing").where(F.col("backing") >= support))
        if step == rounds - 1 or patterns.isEmpty():
            break
        loose = edges.where("seed is null").join(patterns, "pattern", "left").groupBy("found", "kind").agg(F.sum(F.col("n") * F.coalesce("confidence", F.lit(0.0))).alias("s"))
        sizes = edges.where("seed is null").groupBy("found").agg(F.sum("n").alias("all"))
        fresh = loose.where("kind is not null").join(sizes, "found").join(known.select("found"), "found", "left_anti").select("found", "kind", (F.col("s") / F.col("all")).alias("c"))
        weights = checkpointed(known.unionByName(fresh))
    return patterns.where(F.col("confidence") >= confidence).groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("x")).select("pattern", "x.kind", "x.confidence")


def _marked(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rid, _text, row) of the rows that may hold identifiers, ``row`` with all their columns, and (rid, spans): all spans, by start."""
    text = docs[text_col].cast("string")
    row = F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    hot = checkpointed(docs.where(text.rlike(ANY)).select(F.monotonically_increasing_id().alias("rid"), text.alias("_text"), row.alias("row")))
    spans = checkpointed(_spans(hot.select("rid", "_text")))
    patterns = checkpointed(learn_patterns(spans))
    base = spans.where("kind <> 'token'").select("rid", "kind", "start", "end", F.lit(True).alias("base"))
    found = spans.where("kind = 'token'").drop("kind").join(patterns, "pattern").select("rid", "kind", "start", "end", F.lit(False).alias("base"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    per = base.unionByName(found).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("rank"), "end", "kind", "base"))).alias("spans"))
    return hot, per


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Counts and digest are of the base spans; ``spans`` lists all as kind:start:end (code points, end
    exclusive) by start; ``n_found`` counts those the bootstrap added. Null and empty texts hold none.
    Repeated rows keep a row each; other columns are ignored.
    """
    src = docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col].cast("string").alias("_t"))
    hot, per = _marked(src, "_t")
    marked = hot.select("rid", F.col("row.c0").alias(id_col)).join(per, "rid", "left").select(id_col, F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    count = lambda k: F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    full = marked.select(id_col, *(count(k) for k in KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"), F.size(F.filter("s", lambda s: ~s["base"])).cast("bigint").alias("n_found"))
    none = src.where(~F.coalesce(F.col("_t").rlike(ANY), F.lit(False)))
    zero = F.lit(0).cast("bigint")
    empty = none.select(id_col, *(zero.alias(f"n_{k}") for k in KINDS), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_found"))
    return full.unionByName(empty)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with each span written as [EMAIL], [IP], [CARD] or [PHONE]; spans that overlap share the first one's name.

    Other columns, and texts without spans, stay as they are; ``length_col`` is set to the new length.
    """
    hot, per = _marked(docs, text_col)
    step = lambda acc, s: F.when(s["start"] < F.element_at(acc, -1)["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind"))))).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    first = F.array(F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("kind")))
    merged = F.aggregate("spans", first, step)
    got = hot.join(per.select("rid", merged.alias("_spans")), "rid", "left")
    parts = F.transform(F.sequence(F.lit(1), F.size("_spans")), lambda i: F.concat(
        F.when(i > 1, F.concat(F.lit("["), F.upper(F.element_at("_spans", i)["kind"]), F.lit("]"))).otherwise(F.lit("")),
        F.substring(F.col("_text"), (F.element_at("_spans", i)["end"] + 1).cast("int"), F.when(i < F.size("_spans"), F.get("_spans", i)["start"] - F.element_at("_spans", i)["end"]).otherwise(F.length("_text")).cast("int")),
    ))
    clean = F.when(F.col("_spans").isNotNull(), F.array_join(parts, "")).otherwise(F.col("_text"))
    got = got.withColumn("_clean", clean)

    def column(i: int, c: str) -> Column:
        if c == text_col:
            return F.col("_clean").alias(c)
        own = F.col("row").getField(f"c{i}")
        if c == length_col:
            own = F.when(F.col("_spans").isNotNull(), F.length("_clean")).otherwise(own).cast(docs.schema[c].dataType)
        return own.alias(c)

    calm = docs.where(~F.coalesce(docs[text_col].cast("string").rlike(ANY), F.lit(False)))
    return got.select(*(column(i, c) for i, c in enumerate(docs.columns))).unionByName(calm)
