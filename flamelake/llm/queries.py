"""Registered queries of the text operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from flamelake.llm import bpe, decontaminate, language_id, licenses, line_dedup, near_dup, quality_mil, quality_rules, repeats, secret_scan, spelling, token_counts, transducer, whitening
from flamelake.llm.common import held_out, table
from flamelake.llm.oracles import ORACLES  # noqa: F401  the SQL of those that SQL can express


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()).select("text", "lang"))
    spans = language_id.spans(docs, model)
    lang, score = language_id.predicted(spans)
    n_spans = F.size("spans").cast("bigint").alias("n_spans")
    return spans.select("doc_id", held_out().alias("held_out"), lang.alias("lang_pred"), score.alias("score"), n_spans)


def op2_license_scan(spark, sf_dir):
    scanned = licenses.scan(table(spark, sf_dir, "documents"))
    return scanned.withColumns({c: F.array_join(c, ",") for c in ("licenses", "sentence_ids")})


def op3_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_bpe(spark, sf_dir):
    ids = bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = transducer.encode(table(spark, sf_dir, "documents"), ids, public_tokenizers.PATTERN)
    return transducer.digests(transducer.decode(encoded, ids))


def op5_repeats(spark, sf_dir):
    return repeats.digests(repeats.dedup(table(spark, sf_dir, "documents")))


def op6_near_duplicates(spark, sf_dir):
    return near_dup.groups(table(spark, sf_dir, "documents"), shingle=4)


def op7_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = quality_mil.score(docs, quality_mil.fit(docs.where(~held_out()), known))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontaminate(spark, sf_dir):
    hits = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(hits)


def op9_line_dedup(spark, sf_dir):
    left = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "line_dedup.*", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_quality_rules(spark, sf_dir):
    judged = quality_rules.rules(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op11_whitening(spark, sf_dir):
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_secret_scan(spark, sf_dir):
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_token_counts, op4_bpe, op5_repeats, op6_near_duplicates, op7_quality_classifier, op8_decontaminate, op9_line_dedup, op10_quality_rules, op11_whitening, op12_spelling_variants, op13_secret_scan)}
