"""The pipeline against its stages in plain Python."""

import brute
import corpus_pipeline
import oracle
import public_tokenizers as P
import tiktoken
from flamelake.llm import bpe, queries, transducer

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark, given, items):
    # The rules are held against SQL; the stages after them against plain code.
    verdicts = oracle.duck(SF).execute(f"select doc_id, kept from ({queries.ORACLES['op10_quality_rules']})").fetchall()
    kept = {d for d, stays in verdicts if stays}
    rows = [(d, t) for d, t in given if d in kept]
    left = brute.lines(rows)
    rows = [(d, t) for d, t in left.items() if brute.words(t) or not brute.words(dict(given)[d])]
    found = brute.groups(rows, 5)
    rows = [(d, t) for d, t in rows if found[d][1] == d]
    hits = brute.contaminated(rows, items)
    rows = [(d, t) for d, t in rows if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])]
    ranks = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {d: (t, library.encode_ordinary(t)) for d, t in rows}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == set(expected) and len(out) == len(expected)
    for r in out:
        text, ids = expected[r["doc_id"]]
        assert r["text"] == text and r["n_tokens"] == len(ids)
        assert bytes(r["ids"]) == b"".join(n.to_bytes(4, "little") for n in ids)


def test_stage_names():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "decontaminate", "bpe"]


def test_a_task_of_bpe_has_one_worker(spark, given):
    """Encoding and decoding in two workers took twice their number of processes; the columns stay the same."""
    docs = spark.createDataFrame([*given[:40], (900, None), (901, ""), (902, "größer 日本 \U0001f600 \0 x")], "doc_id bigint, text string")
    ranks = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    one = corpus_pipeline.encoded(spark, docs, SF)
    two = transducer.decode(transducer.encode(docs, ranks, P.PATTERN), ranks)
    assert one.schema == two.schema
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
