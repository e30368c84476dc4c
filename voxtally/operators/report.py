"""The cohort report: retrieval queries, findings and actions by rule."""

from pyspark.sql import Column, DataFrame, functions as F

from voxtally import constants as K
from voxtally.functions.text import literal_map
from voxtally.operators import retrieval, stats

OWNERS = {"high": "Leadership", "medium": "Management", "low": "HR"}


def _display(theme: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.THEMES), theme), theme)


def _ranked_themes(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent themes with their rank from 0."""
    top = stats.top_values(stats.frequencies(counts), "theme", n)
    listed = top.agg(F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("minus"), "first_pos", "value")
    )).alias("l"))
    return listed.select(F.posexplode("l").alias("ord", "t")).select(
        "ord", F.col("t")["value"].alias("theme"), (-F.col("t")["minus"]).alias("n")
    )


def queries(counts: DataFrame) -> DataFrame:
    """``(query_id, query)``: one per leading theme, and one on crises if the mean is high."""
    themes = _ranked_themes(counts, K.QUERY_THEMES).select(
        F.col("ord").alias("query_id"),
        F.format_string(K.QUERY_FORMAT, _display(F.col("theme"))).alias("query"),
    )
    crisis = stats.totals(counts).filter(F.col("avg_burnout_score") > K.CRISIS_MEAN).select(
        F.lit(K.QUERY_THEMES).alias("query_id"), F.lit(K.CRISIS_QUERY).alias("query")
    )
    return themes.unionByName(crisis)


def context(counts: DataFrame, kb: DataFrame) -> DataFrame:
    """Knowledge texts for the report's queries: ``(ord, text)``."""
    results = retrieval.text_topk(kb.select("id", "text"), queries(counts))
    return retrieval.merge_results(results, kb.select("id", "text"))


def references(context: DataFrame, n: int = K.REPORT_REFERENCES) -> DataFrame:
    return context.orderBy("ord").limit(n)


def _percent(part: str) -> Column:
    return F.round(F.col(part) * 100.0 / F.col("total"), 1)


def findings(counts: DataFrame) -> DataFrame:
    """``(ord, finding)`` sentences from the totals; nothing for an empty cohort."""
    lead = _ranked_themes(counts, 1).select(
        F.format_string("Most mentioned theme: %s (%d responses)", _display(F.col("theme")), "n")
    )
    level = (
        F.when(F.col("avg_burnout_score") <= K.RISK_CUTOFFS["low"], "low")
        .when(F.col("avg_burnout_score") <= K.RISK_CUTOFFS["medium"], "medium")
        .when(F.col("avg_burnout_score") <= K.RISK_CUTOFFS["high"], "high")
        .otherwise("critical")
    )
    lines = F.array(
        F.format_string("%.1f%% of %d responses are negative", _percent("negative_count"), "total"),
        F.col("lead"),
        F.format_string("%.1f%% show high or critical burnout risk", _percent("high_risk_count")),
        F.format_string("%d responses need urgent action", "urgent_action_count"),
        F.format_string("Mean burnout score is %.3f (%s)", "avg_burnout_score", level),
    )
    return (
        stats.totals(counts)
        .filter("total > 0")
        .withColumn("lead", lead.scalar())
        .select(F.posexplode(lines).alias("ord", "finding"))
    )


def actions(counts: DataFrame, kb: DataFrame) -> DataFrame:
    """One action per leading theme: ``(ord, priority, theme, action, owner)``. The text is
    the theme's first knowledge entry; themes without one get a review."""
    priority = (
        F.when(F.col("theme").isin(K.HIGH_RISK_THEMES), "high")
        .when(F.col("theme").isin(K.MEDIUM_RISK_THEMES), "medium")
        .otherwise("low")
    )
    first = kb.groupBy(F.col("topic").alias("theme")).agg(F.min_by("text", "id").alias("text"))
    # The themes are the five leading ones, whatever the cohort's size.
    leading = F.broadcast(_ranked_themes(counts, K.TOP_N))
    return (
        first.join(leading, "theme", "right")
        .withColumn("priority", priority)
        .select(
            "ord", "priority", "theme",
            F.coalesce(
                "text", F.format_string("Review the responses on %s", _display(F.col("theme")))
            ).alias("action"),
            F.try_element_at(literal_map(OWNERS), F.col("priority")).alias("owner"),
        )
    )


def report(counts: DataFrame, kb: DataFrame) -> DataFrame:
    """One row with the whole report."""
    def ordered(df, *fields):
        listed = F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x"))))
        return df.agg(F.transform(listed, lambda s: s["x"]).alias("l"))

    def texts(df, field):
        return ordered(df, field).select(F.transform("l", lambda s: s[field]))

    return stats.cohort_stats(counts).select(
        F.col("total").alias("total_responses"),
        F.col("sentiment_dist").alias("sentiment_distribution"),
        "top_themes",
        F.col("burnout_summary").alias("burnout_risk_summary"),
        F.format_string(
            "%d responses, mean burnout score %.3f, %d need urgent action. Leading theme: %s.",
            "total", "avg_burnout_score", "urgent_action_count", _display(F.col("top_themes")[0]),
        ).alias("executive_summary"),
        texts(findings(counts), "finding").scalar().alias("key_findings"),
        ordered(actions(counts, kb), "priority", "theme", "action", "owner").scalar()
        .alias("recommended_actions"),
        texts(references(context(counts, kb)), "text").scalar().alias("rag_references"),
    )
