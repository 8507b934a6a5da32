"""Registered queries over the smallest tables, against SQL, brute force or held-out labels."""

import brute
import oracle
import public_tokenizers as P
import pytest
import tiktoken
from flamelake.llm import bpe, queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, spark, con):
    assert oracle.difference(queries.QUERIES[name], queries.ORACLES[name], spark, con, SF) is None


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_languages_held_out(spark):
    rows = queries.op1_language_id(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and 20 < len(held) < len(rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_token_counts(spark, given):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = by_id(queries.op3_token_counts(spark, SF))
    for doc, text in given:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (rows[doc]["n_bytes"], rows[doc]["n_tokens"], rows[doc]["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_bpe(spark, given):
    ranks = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(queries.op4_bpe(spark, SF))
    for doc, text in given:
        ids = library.encode_ordinary(text)
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        assert (rows[doc]["n_tokens"], rows[doc]["ids_sha256"], rows[doc]["decoded_sha256"]) == (len(ids), brute.sha(packed), brute.sha(text))


def test_repeats(spark, given):
    rows = by_id(queries.op5_repeats(spark, SF))
    for doc, (kept, runs) in brute.repeats(given).items():
        r = rows[doc]
        assert (r["n_bytes"] - r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(kept), runs, brute.sha(kept))


def test_near_duplicates(spark, given):
    rows = by_id(queries.op6_near_duplicates(spark, SF))
    for doc, (size, component) in brute.groups(given, 4).items():
        r = rows[doc]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (size, component, doc == component)


def test_quality_held_out(spark):
    rows = by_id(queries.op7_quality_classifier(spark, SF))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [d for d in labels if rows[d]["held_out"]]
    assert sum(rows[d]["predicted"] == labels[d] for d in held) >= 0.85 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def test_line_dedup(spark, given):
    rows = by_id(queries.op9_line_dedup(spark, SF))
    for doc, text in brute.lines(given).items():
        assert rows[doc]["text_sha256"] == brute.sha(text)
