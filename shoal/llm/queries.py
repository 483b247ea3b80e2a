"""Queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, exact, lines, mixing, passages, simhash, syncmers, tokens, toxicity, urls, warc
from .shared import table


#: (verdict, host and path prefix)
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_url_filter(spark, sf_dir):
    """Outcomes: the label of the same number marks a page; good is of quality and not toxic."""
    labels = table(spark, sf_dir, "labels")
    labels = labels.select(F.col("doc_id").alias("page_id"), "quality", "toxic")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    out = urls.judge(table(spark, sf_dir, "pages"), labels, good, URL_RULES)
    bounds = [F.round(c, 9).alias(c) for c in ("good_mean", "good_upper")]
    return out.select("page_id", "host", "path", "rule", "verdict", "n", *bounds)


def line_counts(out):
    """The operator's two counts come last, whatever columns the table has."""
    had, lost = out.columns[-2:]
    return out.select("doc_id", F.col(had).alias("n_lines"), F.col(lost).alias("n_removed"), "text")


def op3_line_dedup(spark, sf_dir):
    return line_counts(lines.without_repeats(table(spark, sf_dir, "documents")))


def op3_shared_passages(spark, sf_dir):
    return line_counts(passages.without_passages(table(spark, sf_dir, "documents")))


def op4_syncmers(spark, sf_dir):
    return syncmers.with_next(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return tokens.count_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_warc(spark, sf_dir):
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark, sf_dir):
    return bpe.digest_table(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op6_mixing(spark, sf_dir):
    plan, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op7_exact_dedup(spark, sf_dir):
    out = exact.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_simhash(spark, sf_dir):
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op10_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = [
        op1_url_filter, op2_bpe, op3_line_dedup, op4_syncmers, op5_token_counts, op6_mixing, op7_exact_dedup, op8_simhash,
        op9_warc, op10_toxicity, pipeline, op3_shared_passages,
    ]
    return {f.__name__: f for f in found}
