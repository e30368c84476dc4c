"""Language of web pages by Bayesian evidence fusion.

Four pieces of evidence make one posterior over the languages that labelled documents have:

* the text of the page: log-likelihood of its letter trigrams, counted over all labelled
  documents in ``BINS`` hashed cells, tempered because neighbouring trigrams overlap;
* the language its markup declares, weighed by how often pages that read like each language
  declare it;
* the suffix of its address, weighed the same way;
* its host: a prior smoothed from the other pages of the host to the other hosts of its domain
  and on to all pages.

Counts of the last three are sums of text posteriors by grouped aggregation, without the page
itself. Addresses are aggregated once, by host; domains and suffixes are sums over hosts, so pages
meet one table, by one skew-split join.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.sources.checkpoints import settle

BINS = 1 << 14
#: Most languages: with ``BINS`` numbers of eight bytes each they take 64 MB.
LANGUAGES = 512
#: Trigrams that a text is worth at most, however long.
WORTH = 60.0
#: Pages that a level of the address hierarchy borrows from the one above.
BORROWED = 4.0

_TAG = re.compile(r"<!--|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9]*+)([^<>]*+)>")
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?+\s*+([a-zA-Z]{2,3})(?![a-zA-Z])")
_ADDRESS = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_RAW = ("script", "style", "noscript", "template", "textarea")
_AROUND = ("nav", "header", "footer", "aside", "form", "select", "button")
_ENTITY = re.compile(r"&[#a-zA-Z0-9]{1,10};")


def visible_text(html: str) -> tuple[str, str]:
    """(declared language or "", text) of a page, without what stands around its content."""
    out, declared, at, skip = [], "", 0, ""
    position = 0
    while True:
        tag = _TAG.search(html, position)
        if not skip:
            out.append(html[at : tag.start() if tag else len(html)])
        if not tag:
            break
        position = at = tag.end()
        if tag.group(2) is None:
            if tag.group() == "<!--":
                end = html.find("-->", position)
                position = at = len(html) if end < 0 else end + 3
            continue
        name, closes = tag.group(2).lower(), bool(tag.group(1))
        if name == "html" and not closes and not declared:
            found = _LANG.search(tag.group(3))
            declared = found.group(1).lower() if found else ""
        elif name in _RAW and not closes:
            end = re.compile(f"</{name}", re.I).search(html, position)
            position = at = end.start() if end else len(html)
        elif skip:
            # Its own end, or content that can't be part of it.
            skip = "" if name in (skip, "article", "main") else skip
        elif name in _AROUND and not closes:
            skip = name
    return declared, _ENTITY.sub(" ", " ".join(out))


def address(url: str) -> tuple[str, str, str]:
    """(host, domain, suffix) in lower case, empty where there is none."""
    found = _ADDRESS.match(url)
    host = found.group(1).lower().strip(".") if found else ""
    parts = host.split(".")
    suffix = parts[-1] if len(parts) > 1 and parts[-1].isalpha() else ""
    return host, ".".join(parts[-2:]), suffix


def trigrams(text: str) -> np.ndarray:
    """Cells of the trigrams of a text's letters, runs of anything else being one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
    other = (codes < 97) | ((codes > 122) & (codes < 192))
    codes = np.where(other, np.uint32(32), codes)
    codes = codes[np.append(True, ~(other[1:] & other[:-1]))] if len(codes) else codes
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    mixed = (first * np.uint32(0x9E3779B1)) ^ (second * np.uint32(0x85EBCA77))
    mixed ^= third * np.uint32(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BINS)).astype(np.int64)


def likelihoods(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of ``docs`` (text, lang) in order, and the logarithm of the share of each cell.
    There are as many numbers as languages times ``BINS``, whatever the input; more than
    ``LANGUAGES`` different values are an error, as they would not fit a driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                own = counts.setdefault(lang, np.zeros(BINS, np.int64))
                own += np.bincount(trigrams(text.as_py()), minlength=BINS)
        for lang, own in counts.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(own[cells])],
                ["lang", "cell", "n"],
            )

    labelled = docs.select("text", "lang").filter("text is not null and lang is not null")
    found = labelled.select("lang").distinct().limit(LANGUAGES + 1).count()
    if found > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different values of lang; is it a column of languages?")
    rows = (
        labelled.mapInArrow(run, "lang string, cell long, n long")
        .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    )
    names, which = np.unique(np.array(rows.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    counts = np.full((len(names), BINS), 0.5)
    np.add.at(counts, (which, rows.column("cell").to_numpy()), rows.column("n").to_numpy())
    return names.tolist(), np.log(counts / counts.sum(axis=1, keepdims=True))


def evidence(pages: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared ("" for none, "?" for no known language), and
    ``text``, the tempered log-likelihood for each language."""
    known = set(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html")):
                declared, text = visible_text(html.as_py() or "")
                cells = trigrams(text)
                n = len(cells)
                weight = WORTH / (n + WORTH)
                found = np.bincount(cells, minlength=BINS) @ logs.T * weight
                declared = declared if declared in known or not declared else "?"
                rows.append((*address(url or ""), declared, (found - found.max()).tolist()))
            host, domain, suffix, declared, text = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), *(pa.array(x, pa.string()) for x in (host, domain, suffix, declared)),
                    pa.array(text, pa.list_(pa.float64())),
                ],
                ["page_id", "host", "domain", "suffix", "declared", "text"],
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(
        run, "page_id long, host string, domain string, suffix string, declared string, text array<double>"
    )


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _sums(column: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(size)])


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def _minus(a, b) -> Column:
    """Elementwise difference, without what rounding leaves below zero."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))


def _smoothed(counts: Column, above: Column) -> Column:
    """Shares of ``counts`` after adding ``BORROWED`` pages like ``above``."""
    total = _sum(counts) + BORROWED
    return F.zip_with(counts, above, lambda c, p: (c + BORROWED * p) / total)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, lang, confidence, text_lang,
    declared, host; languages are those of ``docs`` (text, lang).

    ``confidence`` is the posterior of ``lang``, ``text_lang`` the best by text alone; of equal
    ones the first by name. A page without text is decided by its other evidence, one with none
    (null url and html) by the share of each language over all pages. Null ids and repeated
    rows stay. Without labelled documents lang and confidence are null. Other columns are not
    read; an empty table gives an empty result.
    """
    languages, logs = likelihoods(docs)
    size = len(languages)
    if not size:
        return pages.select(
            F.col("page_id").cast("long"), F.lit(None).cast("string").alias("lang"),
            F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"),
            F.lit("").alias("declared"), F.lit("").alias("host"),
        )
    read = settle(evidence(pages, languages, logs).withColumn("soft", _softmax(F.col("text"))))
    hosts = settle(read.groupBy("host", "domain", "suffix").agg(_sums("soft", size).alias("h")))
    domains = settle(hosts.groupBy("domain").agg(_sums("h", size).alias("d")))
    suffixes = settle(hosts.groupBy("suffix").agg(_sums("h", size).alias("s")))
    totals = suffixes.agg(_sums("s", size).alias("t"), F.count(F.lit(1)).alias("n")).first()
    every = np.array(totals.t if totals.t and totals.t[0] is not None else [0.0] * size) + 0.5
    overall = F.array(*[F.lit(float(x)) for x in every / every.sum()])
    # As many declarations as languages and two.
    said = {r.declared: np.array(r.c) for r in read.groupBy("declared").agg(_sums("soft", size).alias("c")).collect()}
    declarations = F.create_map(*[
        x for name in (*languages, "?", "")
        for x in (F.lit(name), F.array(*[
            F.lit(float(np.log((c + 0.5) / t))) if name else F.lit(0.0)
            for c, t in zip(said.get(name, np.zeros(size)), every + 0.5 * (size + 1))
        ]))
    ])
    placed = hosts.join(domains, "domain").join(suffixes, "suffix").select(
        "host", "domain", "suffix", "h", "s", _smoothed(_minus(F.col("d"), F.col("h")), overall).alias("above")
    )
    placed = settle(placed)
    joined = read.join(placed, ["host", "domain", "suffix"])
    prior = _smoothed(_minus(F.col("h"), F.col("soft")), F.col("above"))
    whole = F.array(*[F.lit(float(x)) for x in every])
    suffix = F.zip_with(
        _minus(F.col("s"), F.col("soft")), whole, lambda s, t: F.log((s + 0.5) / (t + 0.5 * int(totals.n or 1)))
    )
    parts = F.arrays_zip(
        F.col("text").alias("a"), F.element_at(declarations, F.col("declared")).alias("b"),
        F.when(F.col("suffix") != "", suffix).otherwise(F.transform(whole, lambda x: F.lit(0.0))).alias("c"),
        prior.alias("d"),
    )
    posterior = _softmax(F.transform(parts, lambda p: p["a"] + p["b"] + p["c"] + F.log(p["d"])))
    names = F.array(*[F.lit(x) for x in languages])

    def best(shares: str) -> Column:
        return F.element_at(names, F.array_position(shares, F.array_max(shares)).cast("int"))

    return joined.withColumn("posterior", posterior).select(
        "page_id", best("posterior").alias("lang"), F.array_max("posterior").alias("confidence"),
        best("soft").alias("text_lang"), "declared", "host",
    )
