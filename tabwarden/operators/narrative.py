"""Text in and out: profile to prompt, sectioned response to columns, rule-based text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the prompt and the headings of a response.
INTRO = "Below is an instruction that describes a data quality analysis task. Write a structured professional response."
INSTRUCTION = "Analyze the following data quality profile for a dataset and provide professional recommendations."
NO_RISKS = "None detected by automated rules."
HEADINGS = {
    "narrative": "1. Narrative Summary:",
    "top_risks": "2. Top Critical Risks:",
    "recommendations": "3. Actionable Recommendations:",
    "executive_summary": "4. Executive Summary:",
}
NO_NARRATIVE, NO_SUMMARY = "Insight summary unavailable.", "Summary unavailable."
EXCERPT = 500


def column_line(with_stats: Column) -> Column:
    """One profile line; numeric columns carry mean, std and skewness."""
    base = F.format_string("- %s (%s): %.1f%% missing, %d unique", "column", "type", F.col("missing_pct") * 100, "unique_count")
    stats = F.format_string(", mean=%.2f, std=%.2f, skewness=%.2f", "mean", "std", "skewness")
    return F.concat(base, F.when(with_stats, stats).otherwise(""))


def prompts(profiles: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset, prompt): one text per dataset.

    ``profiles`` has a row per dataset and column (dataset, position, column,
    type, missing_pct, unique_count, mean, std, skewness); ``datasets`` a row
    per dataset (rows, columns, memory_mb, duplicate_rows, duplicate_pct,
    health_score, risks). A group holds one dataset's columns.
    """
    line = column_line(F.col("mean").isNotNull())
    lines = profiles.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    header = F.format_string(
        "Dataset Name: %s\nShape: %d rows x %d columns\nMemory: %.1f MB\nDuplicate Rows: %d (%.1f%%)\nOverall Health Score: %.1f/100\n\n",
        "dataset", "rows", "columns", "memory_mb", "duplicate_rows", F.col("duplicate_pct") * 100, "health_score",
    )
    risks = F.when(F.size("risks") > 0, F.array_join("risks", ", ")).otherwise(NO_RISKS)
    body = F.concat(header, F.lit("Column Profiles:\n"), F.array_join(F.col("l.line"), "\n"), F.lit("\n\nDetected Risks:\n"), risks)
    prompt = F.concat(F.lit(f"{INTRO}\n\n### Instruction:\n{INSTRUCTION}\n\n### Input:\n"), body, F.lit("\n\n### Response:"))
    return datasets.join(lines, "dataset").select("dataset", prompt.alias("prompt"))


def _section(text: Column, name: str) -> Column:
    """Body of the last blank-line separated part whose first listed heading is this one."""
    heading = HEADINGS[name]
    earlier = list(HEADINGS.values())[: list(HEADINGS).index(name)]

    def belongs(part: Column) -> Column:
        mine = part.contains(heading)
        for other in earlier:
            mine = mine & ~part.contains(other)
        return mine

    parts = F.filter(F.split(text, "\n\n"), belongs)
    return F.when(F.size(parts) > 0, F.regexp_replace(F.replace(F.try_element_at(parts, F.lit(-1)), F.lit(heading), F.lit("")), r"^\s+|\s+$", ""))


def _items(section: Column) -> Column:
    """Lines without list marks; empty for a missing section."""
    kept = F.filter(F.split(section, "\n"), lambda x: F.trim(x) != "")
    bare = F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[- ]+|[- ]+$", ""), r"^[123. ]+|[123. ]+$", ""))
    return F.coalesce(bare, F.array().cast("array<string>"))


def parse_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """Adds narrative, top_risks, recommendations and executive_summary to each response."""
    t = F.col(text)
    narrative = _section(t, "narrative")
    excerpt = F.when(F.length(t) > 0, F.concat(F.substring(t, 1, EXCERPT), F.lit("...")))
    return responses.select(
        "*",
        F.coalesce(narrative, excerpt, F.lit(NO_NARRATIVE)).alias("narrative"),
        _items(_section(t, "top_risks")).alias("top_risks"),
        _items(_section(t, "recommendations")).alias("recommendations"),
        F.coalesce(_section(t, "executive_summary"), F.lit(NO_SUMMARY)).alias("executive_summary"),
    )


def fallback(findings: DataFrame, reason: str) -> DataFrame:
    """One row of rule-based text from the findings of a profile."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("risk", "column", F.col(c).alias("t")))), lambda x: x["t"])
    return findings.agg(ordered("message").alias("top_risks"), F.filter(ordered("recommendation"), lambda x: x.isNotNull()).alias("recommendations")).select(
        F.lit(f"Insights temporarily unavailable. (Error: {reason})").alias("narrative"), "top_risks", "recommendations", F.lit("fallback-rules").alias("model_name")
    )


# Limits that decide what a profile's main problem is.
MISSING_LIMIT, LEAK_LIMIT, DRIFT_LIMIT, SKEW_LIMIT, DUPLICATE_LIMIT = 0.3, 0.95, 0.2, 2.0, 0.05

# Per problem: what is wrong, the risk, the advice, the plain summary.
PROBLEM_TEXTS = {
    "high_missingness": ("column '%s' has many missing values", "Results may be biased by the rows that remain.", "Find out why values are missing before imputing them.", "Important values are missing."),
    "target_leakage": ("column '%s' repeats the target", "Accuracy in training will not carry over.", "Remove the column and look for others like it.", "One column gives the answer away."),
    "data_drift": ("column '%s' has drifted from its reference", "Predictions degrade as the data moves on.", "Retrain on recent data and watch the drift index.", "The data no longer looks as it did."),
    "feature_skew": ("column '%s' is strongly skewed", "A few large values dominate averages and linear models.", "Transform the column or use robust scaling.", "Some values are far from the rest."),
    "duplicate_contamination": ("column '%s' belongs to a table with many repeated rows", "Copies in train and test inflate the scores.", "Drop copies before splitting.", "Many rows appear more than once."),
    "multi_issue": ("several problems meet, first of all in column '%s'", "Each problem hides the others.", "Fix missing values first, then check again.", "Several repairs are needed in order."),
    "healthy": ("all columns look fine, '%s' included", "No critical risks.", "Go ahead and keep this profile as the baseline.", "The data is ready to use."),
}


def problem_examples(profiles: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset, problem, instruction, input, output): a sectioned text for each dataset's main problem.

    ``profiles`` may carry target_correlation and psi besides the columns
    ``prompts`` needs; the worst column of each kind decides the problem.
    """
    def worst_of(measure: Column, limit: float, name: str) -> Column:
        over = F.when(F.coalesce(measure, F.lit(0.0)) > limit, F.struct(F.lit(name).alias("problem"), "column"))
        return F.max_by(over, F.when(over.isNotNull(), measure)).alias(name)

    have = set(profiles.columns)
    given = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    per = profiles.groupBy("dataset").agg(
        worst_of(F.col("missing_pct"), MISSING_LIMIT, "high_missingness"), worst_of(given("target_correlation"), LEAK_LIMIT, "target_leakage"),
        worst_of(given("psi"), DRIFT_LIMIT, "data_drift"), worst_of(F.abs("skewness"), SKEW_LIMIT, "feature_skew"), F.min_by("column", "position").alias("first"),
    )
    joined = prompts(profiles, datasets).join(datasets.select("dataset", "duplicate_pct", "rows", "health_score"), "dataset").join(per, "dataset")
    copies = F.when(F.col("duplicate_pct") > DUPLICATE_LIMIT, F.struct(F.lit("duplicate_contamination").alias("problem"), F.col("first").alias("column")))
    found = F.filter(F.array("target_leakage", "high_missingness", copies, "data_drift", "feature_skew"), lambda x: x.isNotNull())
    healthy = F.struct(F.lit("healthy").alias("problem"), F.col("first").alias("column"))
    main = joined.withColumn("found", found).withColumn("main", F.coalesce(F.try_element_at("found", F.lit(1)), healthy))
    problem = F.when(F.size("found") > 1, "multi_issue").otherwise(F.col("main.problem"))
    texts = F.create_map(*[x for k, v in PROBLEM_TEXTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    main = main.withColumn("problem", problem).withColumn("t", F.element_at(texts, F.col("problem")))
    narrative = F.concat(F.format_string("Dataset %s (%d rows, health %.1f/100): ", "dataset", "rows", "health_score"), F.replace(F.col("t")[0], F.lit("%s"), F.col("main.column")), F.lit("."))
    output = F.concat_ws(
        "\n\n",
        *[F.concat(F.lit(HEADINGS[h] + "\n"), body) for h, body in (("narrative", narrative), ("top_risks", F.concat(F.lit("- "), F.col("t")[1])), ("recommendations", F.concat(F.lit("- "), F.col("t")[2])), ("executive_summary", F.col("t")[3]))],
    )
    body = F.regexp_extract("prompt", r"(?s)### Input:\n(.*)\n\n### Response:", 1)
    return main.select("dataset", "problem", F.lit(INSTRUCTION).alias("instruction"), body.alias("input"), output.alias("output"))
