"""Cohort statistics.

Everything is read off one small table, ``cohort_counts``: rows, score total and first
position by (sentiment, theme, level, department, action). It is built with one
map-side-combined aggregation; the reports then work on that table only.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from voxtally import constants as K

DIMENSIONS = {
    "sentiment": "sentiment",
    "theme": "primary_theme",
    "risk_level": "burnout_risk_level",
    "department": "department",
    "action": "action_signal",
}


def cohort_counts(analyzed: DataFrame, pos: str = "pos") -> DataFrame:
    # Scores have at most four decimals, so decimal totals are exact in any order.
    return analyzed.groupBy(*DIMENSIONS.values()).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("burnout_risk_score").cast("decimal(9,4)")).alias("score_total"),
        F.min(pos).alias("first_pos"),
    )


def frequencies(counts: DataFrame) -> DataFrame:
    """``(dim, value, n, first_pos)`` for the five dimensions; a department that is
    null or empty is not counted."""
    pairs = [F.struct(F.lit(d).alias("dim"), F.col(c).alias("value"))
             for d, c in DIMENSIONS.items()]
    return (
        counts.select("n", "first_pos", F.inline(F.array(*pairs)))
        .filter((F.col("dim") != "department") | (F.coalesce("value", F.lit("")) != ""))
        .groupBy("dim", "value")
        .agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    )


def top_values(frequencies: DataFrame, dim: str, n: int = K.TOP_N) -> DataFrame:
    """The n most frequent values of a dimension; ties go to the one seen first."""
    return (
        frequencies.filter(F.col("dim") == dim)
        .orderBy(F.desc("n"), F.asc("first_pos"))
        .limit(n)
        .select("value", "n", "first_pos")
    )


def value_counts(counts: DataFrame, column: str) -> DataFrame:
    return counts.groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n")).orderBy(
        F.desc("n"), "value"
    )


def _n_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _mean(places: int) -> Column:
    return F.round(F.sum("score_total") / F.sum("n"), places).cast("double")


def totals(counts: DataFrame) -> DataFrame:
    """Total, mean score, urgent rows and the number of high or critical rows."""
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        _mean(3).alias("avg_burnout_score"),
        _n_if(F.col("action_signal") == "urgent_action").alias("urgent_action_count"),
        _n_if(F.col("burnout_risk_level").isin("high", "critical")).alias("high_risk_count"),
        _n_if(F.col("sentiment").isin("negative", "very_negative")).alias("negative_count"),
    )


def kpi_tiles(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_analyzed"),
        _n_if(F.col("action_signal") == "urgent_action").alias("urgent_actions"),
        _n_if(F.col("burnout_risk_level").isin("high", "critical")).alias("high_critical_burnout"),
        _mean(2).alias("avg_burnout_score"),
    )


def _as_map(rows: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(rows)))


def cohort_stats(counts: DataFrame) -> DataFrame:
    """One row of nine statistics. No row at all for an empty cohort.

    The maps are collected from the frequency tables, whose values are label sets
    and the five largest departments.
    """
    freq = frequencies(counts)
    pair = F.struct("value", "n")

    def of(dim, name):
        return freq.filter(F.col("dim") == dim).agg(_as_map(pair).alias(name))

    ranked = F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("minus"), "first_pos", "value")
    ))
    parts = [
        of("sentiment", "sentiment_dist"),
        top_values(freq, "theme").agg(F.transform(ranked, lambda s: s["value"]).alias("top_themes")),
        of("theme", "theme_distribution"),
        of("risk_level", "burnout_summary"),
        of("action", "action_distribution"),
        top_values(freq, "department").agg(_as_map(pair).alias("department_distribution")),
    ]
    row = totals(counts).filter("total > 0")
    return reduce(
        lambda df, part: df.withColumn(part.columns[0], part.scalar()), parts, row
    ).select(
        "total", "sentiment_dist", "top_themes", "theme_distribution", "burnout_summary",
        "avg_burnout_score", "urgent_action_count", "action_distribution",
        "department_distribution",
    )


def require_cohort(counts: DataFrame) -> DataFrame:
    if counts.isEmpty():
        raise ValueError("Cannot generate insights from empty response list")
    return counts


def urgent_rows(analyzed: DataFrame) -> DataFrame:
    return analyzed.filter(F.col("action_signal") == "urgent_action").select(
        "response_id", "anonymized_text", "sentiment", "burnout_risk_score"
    )


def run_counters(columns: list[str]) -> list[Column]:
    """The counters that rows with ``columns`` have; the number of rows always."""
    of = {
        "burnout_high_risk": ("burnout_risk_level", lambda c: c.isin("high", "critical")),
        "urgent_actions": ("action_signal", lambda c: c == "urgent_action"),
        "pii_detected": ("pii_detected", lambda c: c),
    }
    return [F.count(F.lit(1)).alias("surveys_analyzed")] + [
        F.count_if(holds(F.col(column))).alias(name) for name, (column, holds) in of.items() if column in columns
    ]


def business_counters(analyzed: DataFrame, reports: DataFrame) -> DataFrame:
    """Counters of one run over rows that also carry ``pii_detected``, and how many reports
    there are."""
    written = reports.agg(F.count(F.lit(1)).alias("insights_generated"))
    return analyzed.agg(*run_counters(analyzed.columns)).withColumn("insights_generated", written.scalar())


def observe_counters(analyzed: DataFrame, observation: Observation) -> DataFrame:
    """The rows as they are; the counters come with whatever is done with them next."""
    return analyzed.observe(observation, *run_counters(analyzed.columns))


def labelled_counter(log: DataFrame, labels: list[str]) -> DataFrame:
    return log.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(log: DataFrame, value: str, bounds: list[float], labels: list[str]) -> DataFrame:
    """Cumulative buckets per label set: ``le``, ``bucket_count``, and the count and sum
    of all observations, which null and NaN are not. One pass with one counter per bound."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counters = [F.count_if(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = log.groupBy(*labels).agg(
        *counters,
        F.count(v).alias("observations"),
        F.sum(v.cast("decimal(38,9)")).cast("double").alias("total"),
    )
    buckets = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ]
    every = F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("bucket_count"))
    return wide.select(*labels, "observations", "total", F.inline(F.array(*buckets, every)))
