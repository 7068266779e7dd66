"""Distribution drift between a reference and a current table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.functions.expr import ratio, value_identity
from tabwarden.functions.longform import long_values, names_table, with_bin
from tabwarden.functions.ordering import MAX_BROADCAST, running_totals, value_buckets
from tabwarden.functions.selection import exact_quantiles
from tabwarden.functions.types import as_double, categorical_columns, clean, common_columns, numeric_columns
from tabwarden.operators.profile import bin_edges, bounds, finite
from tabwarden.plans.schemas import DEFAULTS
from tabwarden.sources.storage import checkpointed

# Fixed values of the index: number of quantile bins and smallest share.
PSI_BINS = 10
PSI_FLOOR = 1e-4
SERIES_TERMS = 100
SERIES_MIN_LAMBDA = 0.3


def shared_numeric(ref: DataFrame, cur: DataFrame, exclude: Sequence[str] = (), target: str | None = None) -> list[str]:
    both = set(numeric_columns(ref)) & set(numeric_columns(cur))
    return [c for c in common_columns(ref, cur, exclude, target) if c in both]


def two_sided(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(side, c0, c1, ...) over both tables; side 0 is the reference, values are doubles."""
    def one(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.lit(side).alias("side"), *[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])

    return one(ref, 0).unionByName(one(cur, 1))


def _counts_by_bin(both: DataFrame, edges: dict[int, Sequence[float]], closed: bool = False, finite_only: bool = False) -> DataFrame:
    """(f, bin, n0, n1) by inner edges; with ``closed`` the first and last edge also bound the values."""
    width = max(edges) + 1
    rows = long_values(both, [F.col(f"c{i}") if i in edges else F.lit(None).cast("double") for i in range(width)], [F.col("side")])
    inner = {i: e[1:-1] for i, e in edges.items()}
    binned = with_bin(finite(rows) if finite_only else rows, inner)
    if closed:
        ends = F.broadcast(both.sparkSession.createDataFrame([(i, float(e[0]), float(e[-1])) for i, e in edges.items()], "g int, low double, high double"))
        binned = binned.join(ends, "g").where("v >= low and v <= high")
    n = lambda s: F.count_if(F.col("side") == s)
    return binned.groupBy(F.col("g").alias("f"), "bin").agg(n(0).alias("n0"), n(1).alias("n1"))


def _name_table(df: DataFrame, names: Sequence[str], sizes: dict[int, int]) -> DataFrame:
    """(f, feature, bin) with every bin of every feature."""
    rows = [(i, names[i], b) for i, k in sizes.items() for b in range(k)]
    return df.sparkSession.createDataFrame(rows, "f int, feature string, bin int")


def psi_open(ref: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, bins: int = PSI_BINS) -> DataFrame:
    """(feature, psi): reference quantile bins with open ends, shares floored at 1e-4.

    The bin borders are a few numbers per column, found exactly without a sort;
    both tables are then counted in one grouped aggregate.
    """
    names = list(columns or shared_numeric(ref, cur))
    borders = exact_quantiles(ref, {c: as_double(ref, c) for c in names}, [i / bins for i in range(1, bins)])
    both = two_sided(ref, cur, names)
    # An unbounded first and last edge: only the inner borders are compared.
    inside = {i: [-math.inf, *borders[c], math.inf] for i, c in enumerate(names) if borders[c]}
    if not inside:
        return ref.sparkSession.createDataFrame([], "feature string, psi double")
    counts = _counts_by_bin(both, inside)
    filled = F.broadcast(_name_table(ref, names, {i: bins for i in inside})).join(counts, ["f", "bin"], "left").fillna(0, ["n0", "n1"])
    w = Window.partitionBy("f")
    e = F.greatest(ratio(F.col("n0"), F.sum("n0").over(w)), F.lit(PSI_FLOOR))
    a = F.greatest(ratio(F.col("n1"), F.sum("n1").over(w)), F.lit(PSI_FLOOR))
    shares = filled.select("feature", e.alias("e"), a.alias("a"), F.sum("n1").over(w).alias("rows"))
    return shares.where("rows > 0").groupBy("feature").agg(F.sum((F.col("e") - F.col("a")) * F.log(F.col("e") / F.col("a"))).alias("psi"))


def psi_closed(ref: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, bins: int = PSI_BINS) -> DataFrame:
    """(feature, psi): distinct reference quantiles as closed bins, one added to each count.

    Values outside the reference range are left out; the last bin includes its
    upper border. Fewer than two distinct borders give 0.
    """
    names = list(columns or shared_numeric(ref, cur))
    quant = exact_quantiles(ref, {c: as_double(ref, c) for c in names}, [i / bins for i in range(bins + 1)])
    edges = {c: sorted(set(q)) for c, q in quant.items() if q}
    both = two_sided(ref, cur, names)
    inside, sizes = {}, {}
    for i, c in enumerate(names):
        e = edges.get(c, [])
        if len(e) >= 2:
            inside[i] = e
            sizes[i] = len(e) - 1
    flat = [(c, 0.0) for c in names if 0 < len(edges.get(c, [])) < 2]
    zero = ref.sparkSession.createDataFrame(flat, "feature string, psi double")
    if not inside:
        return zero
    counts = _counts_by_bin(both, inside, closed=True)
    filled = F.broadcast(_name_table(ref, names, sizes)).join(counts, ["f", "bin"], "left").fillna(0, ["n0", "n1"])
    w = Window.partitionBy("f")
    k = F.count(F.lit(1)).over(w)
    share = lambda n: (F.col(n) + 1) / (F.sum(n).over(w) + k)
    shares = filled.select("feature", share("n0").alias("e"), share("n1").alias("a"))
    return shares.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi")).unionByName(zero)


def ks_statistic(ref: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, target_rows: int | None = None) -> DataFrame:
    """(feature, n0, n1, ks): largest distance between the two distribution functions.

    Large tables are cut into value buckets first. Exact counts per bucket bound
    the distance reachable inside each one, and only buckets that could beat the
    best bucket border are opened; for clearly drifted columns that leaves
    almost nothing to shuffle.
    """
    names = list(columns or shared_numeric(ref, cur))
    both, ids = value_buckets(two_sided(ref, cur, names), [f"c{i}" for i in range(len(names))], target_rows)
    if ids == 1:
        rows = long_values(both, [F.col(f"c{i}") for i in range(len(names))], [F.col("side")]).withColumn("b", F.lit(0))
    else:
        entries = [F.struct(F.col(f"c{i}").alias("v"), F.col(f"c{i}__b").alias("b")) for i in range(len(names))]
        rows = long_values(both, entries, [F.col("side")]).select("side", "g", "v.*").where("v is not null")
    rows = rows.join(F.broadcast(names_table(ref, names)), "g").drop("g")
    n0, n1 = F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")
    if ids == 1:
        counts = rows.groupBy("feature", "b", "v").agg(n0, n1)
        run = running_totals(counts, ["feature"], "v", "b", ["n0", "n1"], split=False)
        everything = Window.partitionBy("feature")
        gap = F.abs(ratio(F.col("upto_n0"), F.sum("n0").over(everything)) - ratio(F.col("upto_n1"), F.sum("n1").over(everything)))
        return run.select("feature", "n0", "n1", gap.alias("gap")).groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("gap").alias("ks"))
    earlier = Window.partitionBy("feature").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("feature")
    t = rows.groupBy("feature", "b").agg(n0, n1).select(  # features x buckets rows
        "feature", "b", "n0", "n1",
        F.coalesce(F.sum("n0").over(earlier), F.lit(0)).alias("p0"), F.coalesce(F.sum("n1").over(earlier), F.lit(0)).alias("p1"),
        F.sum("n0").over(everything).alias("N0_"), F.sum("n1").over(everything).alias("N1_"),
    )
    left = ratio(F.col("p0"), F.col("N0_")) - ratio(F.col("p1"), F.col("N1_"))
    up, down = ratio(F.col("n0"), F.col("N0_")), ratio(F.col("n1"), F.col("N1_"))
    t = t.withColumn("edge", F.abs(left + up - down)).withColumn("reach", F.greatest(F.abs(left + up), F.abs(left - down)))
    t = t.withColumn("best", F.max("edge").over(everything))
    t = checkpointed(t)  # one row per feature and bucket, used three times
    open_ = t.where(F.col("reach") > F.col("best")).select("feature", "b", "p0", "p1", "N0_", "N1_")
    sized = F.broadcast if open_.count() <= MAX_BROADCAST else lambda x: x
    inner = Window.partitionBy("feature", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    fine = (
        rows.join(sized(open_.select("feature", "b")), ["feature", "b"], "left_semi").groupBy("feature", "b", "v").agg(n0, n1)
        .withColumn("u0", F.sum("n0").over(inner)).withColumn("u1", F.sum("n1").over(inner))
        .join(sized(open_), ["feature", "b"])
    )
    gap = F.abs(ratio(F.col("u0") + F.col("p0"), F.col("N0_")) - ratio(F.col("u1") + F.col("p1"), F.col("N1_")))
    inside = fine.groupBy("feature").agg(F.max(gap).alias("inside"))
    edges = t.groupBy("feature").agg(F.max("N0_").alias("n0"), F.max("N1_").alias("n1"), F.max("edge").alias("edge"))
    return edges.join(F.broadcast(inside), "feature", "left").select("feature", "n0", "n1", F.greatest(F.col("edge"), F.coalesce("inside", F.lit(0.0))).alias("ks"))


def ks_p_value(d: Column, n0: Column, n1: Column) -> Column:
    """Asymptotic two-sample p-value; 1 below lambda 0.3, where the series does not settle."""
    lam = d * F.sqrt(n0.cast("double") * n1 / (n0 + n1))
    terms = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    series = F.aggregate(
        terms, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(k.cast("double") * k * lam * lam * -2.0)
    )
    return F.when(lam < SERIES_MIN_LAMBDA, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series * 2)))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # power series of the lower part
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300  # continued fraction of the upper part
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, h * scale)


def with_chi2_p(df: DataFrame) -> DataFrame:
    """Adds ``p_value`` from ``chi2`` and ``dof``; meant for one row per feature."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p_value=[1.0 if k < 1 else upper_gamma(k / 2, x / 2) for x, k in zip(b["chi2"], b["dof"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(add, fields + ", p_value double")


def df_of_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n in names], "feature string")


def category_counts(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n0, n1) of categorical columns over both tables, one shuffle; a value is its 128-bit identity."""
    def one(df: DataFrame, side: int) -> DataFrame:
        value = {c: clean(df, c).cast("string") for c in columns}
        known = lambda v: F.when(v.isNotNull(), value_identity(v, True))
        entries = [F.struct(F.lit(c).alias("feature"), known(value[c]).alias("value"), F.lit(side).alias("side")) for c in columns]
        return df.select(F.inline(F.array(*entries))).where("value is not null")

    rows = one(ref, 0).unionByName(one(cur, 1))
    return rows.groupBy("feature", "value").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))


def chi2_drift(
    ref: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, p_threshold: float = DEFAULTS["chi2_p"],
    max_categories: int | None = None, min_values: int = 10,
) -> DataFrame:
    """Chi-squared comparison of category counts, with category novelty.

    Expected counts are the reference counts plus one, rescaled to the current
    total. A feature with too few values on a side, or with more reference categories than
    ``max_categories``, is a row with status ``skipped`` and no statistic.
    """
    shared = set(categorical_columns(ref)) & set(categorical_columns(cur))
    names = list(columns or sorted(shared))
    counts = category_counts(ref, cur, names)
    sums = counts.groupBy("feature").agg(
        F.sum("n0").alias("N0_"), F.sum("n1").alias("N1_"), F.count("*").alias("k"),
        F.count_if(F.col("n0") > 0).alias("train_categories"), F.count_if(F.col("n1") > 0).alias("test_categories"),
        F.count_if((F.col("n0") == 0) & (F.col("n1") > 0)).alias("new_categories"),
    )
    few = (F.col("N0_") < min_values) | (F.col("N1_") < min_values)
    many = F.lit(False) if max_categories is None else F.col("train_categories") > max_categories
    reason = F.when(few, f"fewer than {min_values} values").when(many, f"more than {max_categories} categories")
    sums = sums.withColumn("reason", reason)
    expected = (F.col("n0") + 1) / (F.col("N0_") + F.col("k")) * F.col("N1_")
    stat = counts.join(F.broadcast(sums), "feature").groupBy("feature", "train_categories", "test_categories", "new_categories", "k", "reason").agg(
        F.sum(F.try_divide((F.col("n1") - expected) * (F.col("n1") - expected), expected)).alias("chi2")
    )
    tested = F.col("reason").isNull()
    out = with_chi2_p(stat.select("feature", F.coalesce("chi2", F.lit(0.0)).alias("chi2"), (F.col("k") - 1).alias("dof"), "train_categories", "test_categories", "new_categories", "reason"))
    out = out.withColumns({"chi2": F.when(tested, F.col("chi2")), "p_value": F.when(tested, F.col("p_value"))})
    out = out.withColumns({"has_drift": F.col("p_value") < p_threshold, "status": F.when(tested, "tested").otherwise("skipped")})
    absent = df_of_names(ref, names).join(out.select("feature"), "feature", "left_anti")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields if f.name not in ("feature", "reason", "status")]
    return out.unionByName(absent.select("feature", *nulls, F.lit(f"fewer than {min_values} values").alias("reason"), F.lit("skipped").alias("status")))


def density_histograms(ref: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """(feature, bin, reference, current): densities over shared equal-width bins."""
    names = list(columns or shared_numeric(ref, cur))
    both = two_sided(ref, cur, names)
    found = bounds(both, {str(i): F.col(f"c{i}") for i in range(len(names))})
    edges = {int(i): bin_edges(lo, hi, bins) for i, (lo, hi) in found.items()}
    counts = _counts_by_bin(both, edges, finite_only=True)
    table = ref.sparkSession.createDataFrame(
        [(i, names[i], b, e[b + 1] - e[b]) for i, e in edges.items() for b in range(bins)], "f int, feature string, bin int, width double"
    )
    filled = F.broadcast(table).join(counts, ["f", "bin"], "left").fillna(0, ["n0", "n1"])
    w = Window.partitionBy("f")
    density = lambda n: ratio(F.col(n), F.sum(n).over(w) * F.col("width"))
    return filled.select("feature", "bin", density("n0").alias("reference"), density("n1").alias("current"))


def analyze_drift(
    ref: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None,
    psi_threshold: float = DEFAULTS["psi"], ks_threshold: float = DEFAULTS["ks_p"], histograms: bool = True,
) -> DataFrame:
    """One row per shared numeric feature: PSI, KS, verdict and density histograms.

    A feature without values on one side has status ``skipped`` and no verdict.
    """
    names = list(columns or shared_numeric(ref, cur))
    ks = ks_statistic(ref, cur, names).withColumn("p_value", ks_p_value(F.col("ks"), F.col("n0"), F.col("n1"))).where("n0 > 0 and n1 > 0")
    psi = psi_open(ref, cur, names)
    tested = F.broadcast(df_of_names(ref, names)).join(ks.join(F.broadcast(psi), "feature"), "feature", "left")
    out = tested.select(
        "feature", F.col("psi").alias("drift_score"), F.lit("PSI + KS-Test").alias("method"), "ks", "p_value",
        ((F.col("psi") >= psi_threshold) | (F.col("p_value") <= ks_threshold)).alias("is_drifted"), F.lit(psi_threshold).alias("threshold"),
        F.when(F.col("ks").isNull(), "skipped").otherwise("tested").alias("status"),
    )
    if not histograms:
        return out
    h = density_histograms(ref, cur, names).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "reference", "current"))).alias("h"))
    return out.join(F.broadcast(h), "feature", "left").select(
        *out.columns, F.col("h.reference").alias("distribution_reference"), F.col("h.current").alias("distribution_current")
    )


def numeric_drift(
    ref: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, target: str | None = None,
    psi_threshold: float = DEFAULTS["psi"], ks_threshold: float = DEFAULTS["ks_p"], min_values: int = 10,
) -> DataFrame:
    """Stricter variant for splits: closed-bin PSI, KS, moments of both sides.

    A feature with fewer than 10 values or a constant side is a row with status ``skipped`` and no verdict.
    """
    names = list(columns or shared_numeric(ref, cur, target=target))
    both = two_sided(ref, cur, names)
    rows = long_values(both, [F.col(f"c{i}") for i in range(len(names))], [F.col("side")]).join(F.broadcast(names_table(ref, names)), "g")
    at = lambda s: F.when(F.col("side") == s, F.col("v"))
    moments = rows.groupBy("feature").agg(
        F.avg(at(0)).alias("train_mean"), F.avg(at(1)).alias("test_mean"),
        F.stddev_samp(at(0)).alias("train_std"), F.stddev_samp(at(1)).alias("test_std"),
        (F.min(at(0)) < F.max(at(0))).alias("varies0"), (F.min(at(1)) < F.max(at(1))).alias("varies1"),
    )
    ks = ks_statistic(ref, cur, names).withColumn("p", ks_p_value(F.col("ks"), F.col("n0"), F.col("n1")))
    all_of = F.broadcast(df_of_names(ref, names)).join(ks, "feature", "left").join(F.broadcast(psi_closed(ref, cur, names)), "feature", "left").join(F.broadcast(moments), "feature", "left")
    enough = F.coalesce((F.col("n0") >= min_values) & (F.col("n1") >= min_values), F.lit(False))
    varies = F.coalesce(F.col("varies0") & F.col("varies1"), F.lit(False))
    told = lambda c: F.when(enough & varies, c)
    return all_of.select(
        "feature", told(F.col("ks")).alias("ks"), told(F.col("p")).alias("p_value"), told(F.col("psi")).alias("psi"),
        told((F.col("p") < ks_threshold) | (F.col("psi") > psi_threshold)).alias("has_drift"),
        "train_mean", "test_mean", "train_std", "test_std",
        F.when(enough & varies, "tested").otherwise("skipped").alias("status"),
        F.when(~enough, f"fewer than {min_values} values").when(~varies, "constant on one side").alias("reason"),
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    """One row over the result of ``analyze_drift``."""
    return drift.agg(
        (F.count_if("is_drifted") > 0).alias("drift_detected"),
        F.count_if("is_drifted").alias("drifted_features_count"),
        F.count_if(F.col("status") == "tested").alias("total_features_analyzed"),
        F.array_sort(F.collect_set(F.when(F.col("is_drifted"), F.col("feature")))).alias("drifted_features"),
        F.coalesce(F.avg("drift_score"), F.lit(0.0)).alias("overall_drift_score"),
    )
