"""Leakage risk per feature: signals, a learned score, advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.functions.expr import ratio, unranked, worst
from tabwarden.functions.labels import numeric_target
from tabwarden.functions.longform import long_values
from tabwarden.functions.ordering import order_buckets
from tabwarden.functions.selection import class_counts, order_statistics
from tabwarden.sources.storage import checkpointed
from tabwarden.functions.types import as_double, as_timestamp, col, micros, numeric_columns
from tabwarden.operators.profile import column_base, pair_moments
from tabwarden.plans.schemas import DEFAULTS, RISK_RANK
from tabwarden.sources.sampling import key_hash

HALVES = 5
BINS = 10
MIN_HALF = 10
UNIQUE_RISK = 0.9
LAG_FACTOR = 1.1

# The signals, in model order.
SIGNALS = (
    "correlation_abs", "mutual_info_proxy", "correlation_variance", "correlation_stability", "future_correlation_ratio",
    "temporal_suspicion", "unique_ratio", "high_cardinality_risk", "missing_pattern_correlation",
)

# Per risk class the uniform range of each continuous signal, and
# the probability of 1 of the two flags.
TRAINING_RANGES = {
    "high": {
        "correlation_abs": (0.85, 1.0), "mutual_info_proxy": (0.6, 1.0), "correlation_variance": (0.1, 0.5),
        "correlation_stability": (0.0, 0.4), "future_correlation_ratio": (1.0, 2.0), "temporal_suspicion": 0.7,
        "unique_ratio": (0.0, 1.0), "high_cardinality_risk": 0.3, "missing_pattern_correlation": (0.0, 0.5),
    },
    "medium": {
        "correlation_abs": (0.5, 0.85), "mutual_info_proxy": (0.3, 0.6), "correlation_variance": (0.05, 0.15),
        "correlation_stability": (0.4, 0.7), "future_correlation_ratio": (0.8, 1.2), "temporal_suspicion": 0.3,
        "unique_ratio": (0.0, 0.8), "high_cardinality_risk": 0.1, "missing_pattern_correlation": (0.0, 0.3),
    },
    "low": {
        "correlation_abs": (0.0, 0.5), "mutual_info_proxy": (0.0, 0.3), "correlation_variance": (0.0, 0.05),
        "correlation_stability": (0.7, 1.0), "future_correlation_ratio": (0.5, 1.0), "temporal_suspicion": 0.05,
        "unique_ratio": (0.0, 0.5), "high_cardinality_risk": 0.02, "missing_pattern_correlation": (0.0, 0.1),
    },
}
ROWS_PER_CLASS = 333
TREES, DEPTH, SEED = 100, 10, 42


def tie_key(df: DataFrame, key: str) -> Column:
    """Long that orders rows of equal value: the key itself, or its hash if it is text."""
    return col(key).cast("long") if key in numeric_columns(df) else key_hash(key)


def rank_cuts(df: DataFrame, values: dict[str, Column], key: str, bins: int = BINS) -> dict[str, list[tuple[float, int | None]]]:
    """Per column the (value, key) pairs that end bins 0..bins-2 in (value, key) order.

    The rank of a row is never computed. The value at each cut rank is selected
    exactly; where several rows share it, the key at the remaining rank among
    them is selected too, else the key is None.
    """
    k = tie_key(df, key)
    names = list(values)
    sizes = {r["g"]: r["n"] for r in long_values(df, [v.cast("double") for v in values.values()]).groupBy("g").agg(F.count("*").alias("n")).collect()}
    cuts = {n: [(b + 1) * (sizes[i] - 1) // bins for b in range(bins - 1)] for i, n in enumerate(names) if sizes.get(i, 0) > 1}
    at = order_statistics(df, {n: values[n].cast("double") for n in cuts}, cuts)
    below = class_counts(df, {n: values[n].cast("double") for n in cuts}, {n: [at[n, c] for c in cuts[n]] for n in cuts})
    shared = sorted({(n, at[n, c]) for n in cuts for c in cuts[n] if below[n][at[n, c]][1] > 1})
    tied = {f"{n}={v!r}": F.when(values[n] == F.lit(v), k) for n, v in shared}
    wanted: dict[str, list[int]] = {name: [] for name in tied}
    for n in cuts:
        for c in cuts[n]:
            if (n, at[n, c]) in shared:
                wanted[f"{n}={at[n, c]!r}"].append(c - below[n][at[n, c]][0])
    keys = order_statistics(df, tied, wanted)
    return {
        n: [(at[n, c], keys.get((f"{n}={at[n, c]!r}", c - below[n][at[n, c]][0]))) for c in cuts.get(n, [])]
        for n in names
    }


def rank_bin(value: Column, key: Column, cuts: Sequence[tuple[float, int | None]]) -> Column:
    """Bin of one value: the number of (value, key) cuts below it; NULL for a missing value."""
    number = F.lit(0)
    for v, k in cuts:
        after = value > F.lit(v)
        if k is not None:
            after = after | ((value == F.lit(v)) & (key > F.lit(k)))
        number = number + after.cast("int")
    return F.when(value.isNotNull(), number)


def rank_bins(df: DataFrame, values: dict[str, Column], key: str, bins: int = BINS) -> dict[str, Column]:
    """Bin 0..bins-1 of each column by the rank of its value, ties ordered by key."""
    cuts = rank_cuts(df, values, key, bins)
    return {n: rank_bin(values[n], tie_key(df, key), cuts[n]) for n in values}


def contingency(df: DataFrame, target: str, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, bin, cls, n): rank bins of each feature against the target's bins or classes.

    The cuts are joined to the rows as data, nine pairs per feature.
    """
    names = [c for c in (columns or numeric_columns(df, [target])) if c != target]
    values = {c: as_double(df, c) for c in names}
    numeric = target in numeric_columns(df)
    coded, y = (df, None) if numeric else numeric_target(df, target)
    cuts = rank_cuts(coded, values | ({target: as_double(df, target)} if numeric else {}), key)
    cls = rank_bin(as_double(df, target), tie_key(df, key), cuts[target]) if numeric else y.cast("int")
    rows = long_values(coded, [values[c] for c in names], [cls.alias("cls"), tie_key(df, key).alias("k")])
    width = BINS - 1
    table = [(g, c, *[x for v, k in (cuts[c] or [(None, None)] * width) for x in (v, k)]) for g, c in enumerate(names)]
    fields = "g int, feature string, " + ", ".join(f"v{j} double, k{j} long" for j in range(width))
    joined = rows.join(F.broadcast(df.sparkSession.createDataFrame(table, fields)), "g")
    number = F.lit(0)
    for j in range(width):
        after = (F.col("v") > F.col(f"v{j}")) | ((F.col("v") == F.col(f"v{j}")) & (F.col("k") > F.col(f"k{j}")))
        number = number + F.coalesce(after.cast("int"), F.lit(0))
    return joined.withColumn("bin", number).where("cls is not null").groupBy("feature", "bin", "cls").agg(F.count("*").alias("n"))


def association(table: DataFrame, rows: Column | int) -> DataFrame:
    """(feature, chi2, mutual_info_proxy, cramers_v) from a contingency table.

    Empty cells need no filling: chi2 = n * (sum of o^2 / (row * column) - 1).
    """
    table = checkpointed(table)
    sums = lambda name, *k: table.groupBy("feature", *k).agg(F.sum("n").alias(name))
    cells = table.join(sums("c", "cls"), ["feature", "cls"]).join(sums("r", "bin"), ["feature", "bin"]).join(sums("t"), "feature")
    n = F.col("n").cast("double")
    per = cells.groupBy("feature").agg(
        (F.max("t") * (F.sum(n * n / (F.col("r").cast("double") * F.col("c"))) - 1)).alias("chi2"),
        F.max("t").alias("t"), F.count_distinct("bin").alias("rows"), F.count_distinct("cls").alias("cols"),
    )
    chi2 = F.greatest(F.col("chi2"), F.lit(0.0))
    size = F.lit(rows) if isinstance(rows, int) else rows
    dof = F.least("rows", "cols") - 1
    return per.select(
        "feature", chi2.alias("chi2"),
        F.coalesce(F.least(ratio(chi2, size * 10), F.lit(1.0)), F.lit(0.0)).alias("mutual_info_proxy"),
        F.coalesce(F.sqrt(ratio(chi2, F.col("t") * dof)), F.lit(0.0)).alias("cramers_v"),
    )


def half_mask(key: str, seed: int) -> Column:
    """Repeatable random half of the rows."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(2)) == 1


def correlation_signals(df: DataFrame, target: str, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, correlation_abs, correlation_variance, correlation_stability, missing_pattern_correlation).

    The full-table correlation, those of five random halves and that of the
    missing flag are seven pairs per feature in one grouped aggregate.
    """
    names = [c for c in (columns or numeric_columns(df, [target])) if c != target]
    coded, y = numeric_target(df, target)
    values, pairs, label = {"y": y}, [], {}
    for i, c in enumerate(names):
        x = as_double(df, c)
        forms = {"all": x, "missing": x.isNull().cast("double")} | {f"half{s}": F.when(half_mask(key, s), x) for s in range(HALVES)}
        for form, v in forms.items():
            values[f"{i}/{form}"] = v
            pairs.append((f"{i}/{form}", "y"))
        label[i] = c
    moments = pair_moments(coded, pairs, values)
    parts = F.split("feature_a", "/")
    r = F.abs("value")
    form = F.col("form")
    total = F.max(F.when(form == "all", F.col("n")))
    wide = moments.select(parts[0].cast("int").alias("i"), parts[1].alias("form"), "n", r.alias("r")).groupBy("i").agg(
        F.coalesce(F.max(F.when(form == "all", F.col("r"))), F.lit(0.0)).alias("correlation_abs"),
        F.coalesce(F.max(F.when(form == "missing", F.col("r"))), F.lit(0.0)).alias("missing_pattern_correlation"),
        F.var_pop(F.when(form.like("half%") & (F.col("n") > MIN_HALF), F.col("r"))).alias("v"),
        total.alias("rows"),
    )
    names_table = df.sparkSession.createDataFrame([(i, c) for i, c in label.items()], "i int, feature string")
    return F.broadcast(names_table).join(wide, "i").select(
        "feature", "correlation_abs",
        F.coalesce("v", F.lit(0.0)).alias("correlation_variance"),
        F.when(F.col("v").isNull(), F.lit(0.5)).otherwise(1 - F.least(F.sqrt("v") * 2, F.lit(1.0))).alias("correlation_stability"),
        "missing_pattern_correlation",
    )


def with_next(df: DataFrame, value: str, order: str, key: str, out: str, target_rows: int | None = None) -> DataFrame:
    """Adds the value of the following row in (order, key) order, across the whole table.

    Inside a bucket a window finds it; for a bucket's last row it is the first
    value of the next bucket, from a table with one row per bucket.
    """
    cut = order_buckets(df, order, key, target_rows)
    inner = Window.partitionBy("bucket").orderBy(order, key)
    local = cut.withColumn("__next", F.lead(F.struct(F.col(value).alias("v"))).over(inner))
    border = Window.partitionBy(F.lit(0)).orderBy("bucket")
    firsts = cut.groupBy("bucket").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(order, key)).alias("first"))
    after = firsts.select("bucket", F.lead("first").over(border).alias("__after"))
    joined = local.join(F.broadcast(after), "bucket", "left")  # one row per bucket, 10,000 at most x tie splits
    return joined.withColumn(out, F.coalesce("__next", "__after")["v"]).drop("__next", "__after", "bucket")


def lag_signals(df: DataFrame, target: str, time_column: str, key: str, columns: Sequence[str] | None = None, target_rows: int | None = None) -> DataFrame:
    """(feature, current_correlation, future_correlation, future_correlation_ratio, temporal_suspicion)."""
    names = [c for c in (columns or numeric_columns(df, [target])) if c not in (target, time_column)]
    coded, y = numeric_target(df, target)
    flat = coded.select(
        *[as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)], y.alias("y"), micros(as_timestamp(df, time_column)).alias("t"), tie_key(df, key).alias("k")
    )
    nxt = with_next(flat, "y", "t", "k", "y_next", target_rows)
    values = {f"x{i}": F.col(f"x{i}") for i in range(len(names))} | {"y": F.col("y"), "y_next": F.col("y_next")}
    moments = pair_moments(nxt, [(f"x{i}", t) for i in range(len(names)) for t in ("y", "y_next")], values)
    at = lambda t: F.coalesce(F.max(F.when(F.col("feature_b") == t, F.abs("value"))), F.lit(0.0))
    per = moments.groupBy("feature_a").agg(at("y").alias("current"), at("y_next").alias("future"))
    names_table = df.sparkSession.createDataFrame([(f"x{i}", c) for i, c in enumerate(names)], "feature_a string, feature string")
    return F.broadcast(names_table).join(per, "feature_a").select(
        "feature", F.col("current").alias("current_correlation"), F.col("future").alias("future_correlation"),
        (F.col("future") / (F.col("current") + 0.001)).alias("future_correlation_ratio"),
        (F.col("future") > F.col("current") * LAG_FACTOR).cast("double").alias("temporal_suspicion"),
    )


def signals(df: DataFrame, target: str, key: str, time_column: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric feature with the nine signals (and Cramer's V)."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    names = [c for c in (columns or numeric_columns(df, [target, time_column or ""])) if c not in (target, time_column)]
    if not names:
        fields = ", ".join(f"{s} double" for s in SIGNALS)
        return df.sparkSession.createDataFrame([], f"feature string, {fields}, cramers_v double")
    n = df.count()
    base = column_base(df, names).select(
        F.col("column").alias("feature"), F.col("unique_pct").alias("unique_ratio"), (F.col("unique_pct") > UNIQUE_RISK).cast("double").alias("high_cardinality_risk")
    )
    out = correlation_signals(df, target, key, names).join(F.broadcast(base), "feature")
    out = out.join(F.broadcast(association(contingency(df, target, key, names), n).drop("chi2")), "feature", "left")
    if time_column and time_column in df.columns:
        out = out.join(F.broadcast(lag_signals(df, target, time_column, key, names).drop("current_correlation", "future_correlation")), "feature", "left")
    else:
        out = out.withColumn("future_correlation_ratio", F.lit(0.0)).withColumn("temporal_suspicion", F.lit(0.0))
    return out.select("feature", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SIGNALS], F.coalesce("cramers_v", F.lit(0.0)).alias("cramers_v"))


def training_set(spark: SparkSession, per_class: int = ROWS_PER_CLASS, seed: int = SEED) -> DataFrame:
    """Synthetic signal rows with a risk label, drawn from the ranges above."""
    rows = spark.range(3 * per_class, numPartitions=1).withColumn("label", (F.col("id") % 3).cast("double"))
    for j, s in enumerate(SIGNALS):
        draw, value = F.rand(seed + j), None
        for label, risk in enumerate(RISK_RANK):
            spec = TRAINING_RANGES[risk][s]
            v = (draw < spec).cast("double") if isinstance(spec, float) else F.lit(spec[0]) + draw * F.lit(spec[1] - spec[0])
            value = F.when(F.col("label") == label, v) if value is None else value.when(F.col("label") == label, v)
        rows = rows.withColumn(s, value)
    return rows.select(*SIGNALS, "label")


def risk_pipeline() -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(SIGNALS), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=2, seed=SEED),
        ]
    )


_MODELS: dict[str, PipelineModel] = {}


def risk_model(spark: SparkSession) -> PipelineModel:
    """The fitted model, trained once per application."""
    app = spark.sparkContext.applicationId
    if app not in _MODELS:
        _MODELS[app] = risk_pipeline().fit(training_set(spark))
    return _MODELS[app]


def risk_level(score: Column) -> Column:
    return F.when(score >= DEFAULTS["risk_high"], "high").when(score >= DEFAULTS["risk_medium"], "medium").otherwise("low")


def score_signals(wide: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Adds risk_score, risk_level and risk_percentage, highest score first."""
    fitted = model or risk_model(wide.sparkSession)
    p = vector_to_array("probability")
    scored = fitted.transform(wide.fillna(0.0, list(SIGNALS))).withColumn("risk_score", p[2] + p[1] * 0.5)
    score = F.col("risk_score")
    return scored.select(
        *wide.columns, "risk_score", risk_level(score).alias("risk_level"), F.floor(score * 100).cast("int").alias("risk_percentage")
    ).orderBy(F.desc("risk_score"), "feature")


# Advice texts.
ADVICE = {
    "safe": "Feature appears safe to use",
    "target": "CRITICAL: Extremely high correlation suggests direct target leakage. Verify this feature is not derived from the target.",
    "correlated": "High correlation detected. Investigate if this feature is available at prediction time.",
    "temporal": "Temporal leakage suspected. Feature may contain future information. Check feature engineering pipeline for time-travel bugs.",
    "identifier": "High cardinality suggests potential ID or unique identifier leak. Consider removing or encoding this feature.",
    "unstable": "Unstable correlation across splits. Feature may not generalize well.",
    "review": "Review feature definition and availability at prediction time.",
}


def advise(scored: DataFrame) -> DataFrame:
    """Adds ``recommendations``, an array of texts decided by level and signals."""
    r = F.col("correlation_abs")
    picks = F.array(
        F.when(r > 0.9, ADVICE["target"]).when(r > 0.7, ADVICE["correlated"]),
        F.when(F.col("temporal_suspicion") > 0, ADVICE["temporal"]),
        F.when(F.col("high_cardinality_risk") > 0, ADVICE["identifier"]),
        F.when(F.col("correlation_stability") < 0.5, ADVICE["unstable"]),
    )
    some = F.filter(picks, lambda x: x.isNotNull())
    review = F.when(F.size(some) == 0, F.array(F.lit(ADVICE["review"]))).otherwise(some)
    return scored.withColumn("recommendations", F.when(F.col("risk_level") == "low", F.array(F.lit(ADVICE["safe"]))).otherwise(review))


def overall_risk(scored: DataFrame) -> DataFrame:
    """One row: worst level, and the features at high and medium risk."""
    listed = lambda level: F.array_sort(F.collect_set(F.when(F.col("risk_level") == level, F.col("feature"))))
    return scored.agg(
        F.coalesce(unranked(RISK_RANK, F.max(worst(RISK_RANK, F.col("risk_level")))), F.lit("low")).alias("overall_risk"),
        listed("high").alias("high_risk_features"), listed("medium").alias("medium_risk_features"),
    )


def predict_risk(df: DataFrame, target: str, key: str, time_column: str | None = None, model: PipelineModel | None = None) -> DataFrame:
    """Signals, score, level and advice of every numeric feature."""
    return advise(score_signals(signals(df, target, key, time_column), model))
