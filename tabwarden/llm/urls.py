"""URL filter: given rules first, then gradient-boosted trees on lexical features of the URL.

A rule is a host with an optional path prefix; it fits its host and all subdomains, and the longest
fitting rule decides. URLs that a rule decides are the labelled ones: trees fitted on a bounded sample
of the distinct ones judge all others.

The share of blocked URLs among those with the same suffix could stand for the label itself. A training
URL therefore gets it from the other folds only, and each is shown a second time with its suffix hidden,
so that the trees also learn to judge by the other features; that is how they see unknown suffixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.sources.storage import checkpointed

#: Training reads at most this many distinct labelled URLs of each verdict.
PER_VERDICT = 4_000
#: More than the error of the estimated number of distinct URLs.
MARGIN = 1.5
#: The sample is that small that its many passes run in few tasks.
SAMPLE_PARTITIONS = 8
FEATURES = ("length", "host_length", "host_parts", "depth", "digit_share", "entropy", "parameters", "value_length", "hyphens", "encoded", "fragment", "secure", "suffix_share", "suffix_known", "suffix_blocked")
#: Suffixes with a smaller share of the URLs count as unknown, so there are at most 1 / LEAST_SHARE others.
LEAST_SHARE = 1e-4
#: Labelled URLs of the average verdict that a suffix's own ones are weighed against.
SMOOTHING = 10
FOLDS = 5


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return _lower(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (host/path -> verdict) that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _count(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")


def lexical(pages: DataFrame) -> DataFrame:
    """Add the lexical features of columns url, host and path; a null url counts as empty."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    share = F.expr("transform(array_distinct(split(_url, '')), c -> (length(_url) - length(replace(_url, c, ''))) / greatest(length(_url), 1))")
    out = pages.withColumns({"_url": url, "_query": query, "suffix": F.element_at(F.split("host", r"\."), -1)})
    return out.withColumns(
        {
            "length": F.length("_url").cast("double"),
            "host_length": F.length("host").cast("double"),
            "host_parts": F.size(F.split("host", r"\.")).cast("double"),
            "depth": _count(F.col("path"), "/"),
            "digit_share": _count(F.col("_url"), "0123456789") / size,
            "entropy": F.coalesce(F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), F.lit(0.0)),
            "parameters": F.when(F.col("_query") == "", 0.0).otherwise(_count(F.col("_query"), "&") + 1),
            "value_length": F.length("_query").cast("double"),
            "hyphens": _count(F.col("_url"), "-_"),
            "encoded": _count(F.col("_url"), "%"),
            "fragment": F.contains("_url", F.lit("#")).cast("double"),
            "secure": F.startswith("_url", F.lit("https://")).cast("double"),
        }
    ).drop("_url", "_query")


def bounded_sample(rows: DataFrame, per_verdict: int) -> DataFrame:
    """The first ``per_verdict`` distinct URLs of each label by a hash of the URL, or all if there are fewer.

    All columns but _id must follow from the URL. Hashes under a bound, from the estimated number of
    distinct URLs, are made distinct; copies of a URL fall together before the shuffle.
    """
    labelled = rows.where(F.col("label").isNotNull())
    distinct = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    order = F.shiftrightunsigned(F.xxhash64("url"), 11)
    parts = []
    for label, n in sorted(distinct.items()):
        bound = int(min(1.0, MARGIN * max(per_verdict, 100) / max(n, 1)) * (1 << 53))
        urls = labelled.where((F.col("label") == label) & (order < F.lit(bound))).drop("_id").distinct()
        parts.append(urls.orderBy(order, "url").limit(per_verdict))
    return reduce(DataFrame.unionByName, parts)


def _with_suffix(rows: DataFrame, stats: DataFrame, rate: float) -> DataFrame:
    """Add suffix_share, suffix_known and suffix_blocked from ``stats`` (at most 1 / LEAST_SHARE suffixes); others are unknown."""
    got = rows.join(F.broadcast(stats), "suffix", "left")
    return got.withColumns({
        "suffix_share": F.coalesce("share", F.lit(0.0)),
        "suffix_known": (F.coalesce("known", F.lit(0)) > 0).cast("double"),
        "suffix_blocked": (F.coalesce("bad", F.lit(0.0)) + rate * SMOOTHING) / (F.coalesce("known", F.lit(0)) + SMOOTHING),
    })


def training_rows(drawn: DataFrame, folds: DataFrame, stats: DataFrame, rate: float) -> DataFrame:
    """Each drawn URL with its suffix's labels in the other folds, and again with its suffix hidden."""
    own = folds.join(F.broadcast(stats.select("suffix")), "suffix", "left_semi").select("suffix", "fold", F.col("known").alias("own_known"), F.col("bad").alias("own_bad"))
    seen = drawn.withColumn("fold", _fold("url")).join(F.broadcast(stats), "suffix", "left").join(F.broadcast(own), ["suffix", "fold"], "left")
    other = seen.withColumns({"known": F.col("known") - F.coalesce("own_known", F.lit(0)), "bad": F.col("bad") - F.coalesce("own_bad", F.lit(0.0))})
    known = F.coalesce("known", F.lit(0))
    shown = other.withColumns({"suffix_share": F.coalesce("share", F.lit(0.0)), "suffix_known": (known > 0).cast("double"), "suffix_blocked": (F.coalesce("bad", F.lit(0.0)) + rate * SMOOTHING) / (known + SMOOTHING)})
    hidden = drawn.withColumns({"suffix_share": F.lit(0.0), "suffix_known": F.lit(0.0), "suffix_blocked": F.lit(float(rate))})
    return shown.select(*FEATURES, "label").unionByName(hidden.select(*FEATURES, "label"))


def _fold(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", per_verdict: int = PER_VERDICT, rounds: int = 12, seed: int = 5) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, score (chance of block; null where a rule decides).

    Host and path of a null url, or one without ``://``, are empty. If the rules decide no URL, or always
    alike, there is nothing to learn: the rest gets that one verdict, or ``allow``. Suffix statistics are
    the share of all URLs with the host's last label, and the smoothed share of blocks among its labelled
    ones; both verdicts weigh alike in training. Repeated rows keep a row each; other columns are ignored.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r for r, v in rules.items() if v == "block"])
    label = F.when(F.col("rule").isNotNull(), blocked.cast("double"))
    rows = checkpointed(lexical(base).withColumn("label", label))
    folds = checkpointed(rows.groupBy("suffix", _fold("url").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.sum(F.coalesce("label", F.lit(0.0))).alias("bad")))
    total = folds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).first()
    good, bad = total["known"] - total["bad"], total["bad"]
    final = lambda df, verdict, score: df.select(F.col("_id").alias(id_col), "host", "path", "rule", F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow").otherwise(verdict).alias("verdict"), F.when(F.col("label").isNull(), score).alias("score"))
    if not good or not bad:
        return final(rows, F.lit("block" if bad else "allow"), F.lit(1.0 if bad else 0.0))
    rate = bad / (good + bad)
    sums = folds.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    stats = checkpointed(sums.where(F.col("n") >= LEAST_SHARE * total["n"]).select("suffix", "known", "bad", (F.col("n") / float(total["n"])).alias("share")))
    drawn = checkpointed(training_rows(bounded_sample(rows, per_verdict), folds, stats, rate).repartition(SAMPLE_PARTITIONS))
    sizes = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, sum(sizes.values()) / (2.0 * sizes[1.0])).otherwise(sum(sizes.values()) / (2.0 * sizes[0.0]))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    data = checkpointed(assembler.transform(drawn).select("features", "label", weight.alias("weight")))
    model = GBTClassifier(maxIter=rounds, maxDepth=4, seed=seed, weightCol="weight").fit(data)
    judged = model.transform(assembler.transform(_with_suffix(rows, stats, rate)))
    p = vector_to_array("probability")[1]
    return final(judged, F.when(p >= 0.5, "block").otherwise("allow"), p)
