"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its content: a blob is a SHA-256 digest and the text
itself. The ledger holds the (blob, rule, rule version) pairs scanned so far. A scan takes the
different blobs of all versions, drops the pairs in the ledger, runs each remaining rule once per
blob, and joins the findings to every path whose version has that content. A new rule version
rescans every blob by that rule alone; a copy of a known text is never scanned again.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtally.operators.joins import lookup_join

LEDGER = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start int, end int"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and apart, whose ``group`` has at least ``least``
    characters. ``marker`` is a text without which there is no match. With ``inner`` the span is
    that of the group, which ends the match."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    marker: str | None = None
    inner: bool = False


#: The kinds asked for, in their order; shorter runs are no match in any way, so the length of
#: ``access`` and ``hex`` is part of the pattern.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", marker="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE + (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", marker="PRIVATE KEY-----"),
    # The first eyJ of a run decides for all, as they share the run's end: one attempt for each run.
    Rule(
        "jwt",
        r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
        group=1, marker="eyJ", inner=True,
    ),
)


def address(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _contents(versions: DataFrame, path: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return versions.select(F.col(path).alias("_path"), text.alias("_text")).withColumn(
        "blob", address(F.col("_text"))
    )


def _matches(text: Column, rule: Rule) -> Column:
    """[(rule, nth, gap, length, ok)] of the matches: the characters before each since the one
    before, its own, and whether it is long enough."""
    pattern = F.lit(rule.pattern)

    def lead(x: Column) -> Column:
        return F.length(x["w"]) - F.length(x["v"]) if rule.inner else F.lit(0)

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    listed = F.transform(
        F.arrays_zip(whole.alias("w"), value.alias("v"), F.split(text, rule.pattern, -1).alias("g")),
        lambda x, i: F.struct(
            F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), i.alias("nth"),
            (F.length(x["g"]) + lead(x)).alias("gap"), (F.length(x["w"]) - lead(x)).alias("length"),
            (F.length(x["v"]) >= rule.least).alias("ok"),
        ),
    )
    there = text.rlike(rule.pattern)
    if rule.marker:
        there = F.contains(text, F.lit(rule.marker)) & there
    return F.when(there, F.filter(listed, lambda x: x["length"].isNotNull()))


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
    path: str = "path",
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) that the versions (``path``, text) add to ``ledger``: what the unseen
    pairs hold, and those pairs. Append both to what is stored. A null text is empty; spans are
    in code points, the end exclusive. Neither has a row for a blob seen before."""
    blobs = _contents(versions, path).groupBy("blob", "_text").agg(F.count(F.lit(1)).alias("_copies"))
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("_todo", F.transform(pairs, lambda p: p["rule"]))
        unseen = todo.select("blob", F.explode(pairs).alias("_p")).select("blob", "_p.rule", "_p.version")
    else:
        wanted = blobs.select("blob").distinct().select("blob", F.explode(pairs).alias("_p"))
        unseen = wanted.select("blob", "_p.rule", "_p.version").join(
            ledger, ["blob", "rule", "version"], "left_anti"
        )
        todo = blobs.join(unseen.groupBy("blob").agg(F.collect_set("rule").alias("_todo")), "blob")
    found = F.concat(*[
        F.coalesce(
            F.when(F.array_contains("_todo", r.name), _matches(F.col("_text"), r)),
            F.array().cast("array<struct<rule:string,version:int,nth:int,gap:int,length:int,ok:boolean>>"),
        )
        for r in rules
    ])
    # Outer: the filter that Spark infers for explode would run the patterns once more.
    rows = todo.select("blob", F.explode_outer(found).alias("_m")).select("blob", "_m.*")
    before = Window.partitionBy("blob", "rule").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("length")).over(before)
    spans = rows.withColumn("end", end.cast("int")).filter("ok").select(
        "blob", "rule", "version", (F.col("end") - F.col("length")).alias("start"), "end"
    )
    return spans, unseen.distinct()


def findings_by_path(
    versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "path"
) -> DataFrame:
    """One row per version: ``path``, blob and ``findings``, an array of (start, kind, rule,
    end) ordered by start and the place of the rule in ``rules``; empty for none. Findings of
    other rules or rule versions are left out."""
    kinds = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.name}:{r.version}"), F.lit(i))])
    per_blob = (
        findings.withColumn("kind", F.try_element_at(kinds, F.concat_ws(":", "rule", "version")))
        .filter("kind is not null")
        .groupBy("blob")
        .agg(F.sort_array(F.collect_set(F.struct("start", "kind", "rule", "end"))).alias("findings"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,rule:string,end:int>>")
    return (
        lookup_join(_contents(versions, path).select("_path", "blob"), per_blob, "blob", "left")
        .select(F.col("_path").alias(path), "blob", F.coalesce("findings", none).alias("findings"))
    )


def joined_spans(findings: Column) -> Column:
    """kind:start:end, comma-joined, of an array of findings."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ","
    )
