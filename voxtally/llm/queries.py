"""The corpus operators over whole tables, with production parameters: (spark, folder) -> DataFrame."""

import public_tokenizers
from pyspark.sql import functions as F

from voxtally.llm import byte_bpe, pii_crf, quality, secret_scan, toxicity
from voxtally.llm.alignment import alignment
from voxtally.llm.common import table
from voxtally.llm.decontaminate import contained
from voxtally.llm.exact_dedup import exact_groups
from voxtally.llm.language_id import identify
from voxtally.llm.lm import scored
from voxtally.llm.packing import pack
from voxtally.llm.simhash import near_groups
from voxtally.llm.vector_codes import vector_codes


def op1_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_language_model(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.predictions(quality.scored(documents, model), folds=5, held=0)


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    grammar = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return quality.predictions(toxicity.scored(documents, grammar), folds=4, held=2)


def op8_secrets(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    nothing = spark.createDataFrame([], secret_scan.LEDGER)  # the branch of an incremental run
    findings, _ = secret_scan.scan(documents, nothing, path="doc_id")
    by_path = secret_scan.findings_by_path(documents, findings, path="doc_id")
    base = F.filter("findings", lambda f: f["kind"] < len(secret_scan.BASE))

    def count(rule):
        return F.size(F.filter("findings", lambda f: f["rule"] == rule)).cast("long").alias(f"n_{rule}")

    counts = [count(r.name) for r in secret_scan.BASE]
    return by_path.select(
        "doc_id", *counts, secret_scan.address(secret_scan.joined_spans(base)).alias("base_sha256"),
        secret_scan.joined_spans(F.col("findings")).alias("spans"),
    )


def op9_pii(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = pii_crf.personal_data(documents, pii_crf.potentials(documents))
    kinds = F.array(*[F.lit(k) for k in pii_crf.KINDS])

    def count(kind):
        has = F.filter("base", lambda s: s["kind"] == pii_crf.KINDS.index(kind))
        return F.size(has).cast("long").alias(f"n_{kind}")

    def joined(spans):
        text = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
        return F.array_join(text, ",")

    return found.select(
        "doc_id", *[count(k) for k in pii_crf.KINDS],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def op10_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned, _ = alignment(table(spark, sf_dir, "documents"), *paths)
    return aligned


def op12_vector_codes(spark, sf_dir):
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    entries = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    return codes.select(
        "vec_id", digits.alias("code"), "error", "label_error",
        F.sha2(F.lit(entries).cast("binary"), 256).alias("codebooks_sha256"),
    )


def op13_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_language_id, op3_language_model, op4_quality, op5_packing,
        op6_decontamination, op7_toxicity, op8_secrets, op9_pii, op10_simhash,
        op11_alignment, op12_vector_codes, op13_byte_bpe,
    )
}
