"""Spelling variants against plain counting and comparison of all pairs."""

import re
import zlib
from collections import Counter

import brute
import pytest
from flamelake.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def counts(rows, each=199):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if each and h % each == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    """Exactly one letter inserted, deleted or replaced, by trying all of them."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:n] + b[n + 1 :] == a for n in range(len(b)))


def variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def rows_of(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, given):
    rows = rows_of(queries.op12_spelling_variants(spark, SF))
    assert rows == sorted(variants(counts(given)), key=str) and len(rows) > 100


@pytest.mark.parametrize("seed", range(2))
def test_dense_words(spark, seed):
    import random

    pick = random.Random(seed)
    words = {"".join(pick.choice("abé") for _ in range(pick.choice((6, 7, 8, 9)))): pick.choice((5, 6, 30, 31, 200, 5000)) for _ in range(500)}
    got = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)))
    assert got == sorted(variants(words), key=str)


def test_chain_ties_and_long_words(spark):
    text = "x" * 40
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "zzzzzz": 5, "zzzzzy": 25, "zzzzzx": 25}
    words |= {text: 5, text[1:] + "y": 30, text + "x": 26, "y" * 32: 5, "y" * 33: 25, "y" * 31: 5, "w" * 50_000: 5, "w" * 25_000 + "v" + "w" * 25_000: 5}
    got = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    # All pairs of the two longest by hand: one letter more is one edit.
    assert got == sorted(variants(words), key=str)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][2] == "abbbbb" and by["zzzzzz"][1] == "zzzzzx"


CASES = [
    (1, "Letter LETTER letterÉ cafÉs×÷ Letterb " * 3),
    (1, "other text under one id: letters letters letters"),
    (2, None),
    (3, ""),
    (None, "letters letters \U0001f600letter naïveté " * 5),
    (4, "12345 ---"),
    (5, ("wordly " * 30_000)),
    (5, ("wordly " * 30_000)),
]


def test_vocabulary_cases(spark):
    frame = spark.createDataFrame([(*r, 7, "w") for r in CASES], "doc_id long, text string, n int, word string")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(frame).collect()}
    assert got == counts(CASES) and got["wordly"] >= 59_000
    assert {r["word"]: r["n"] for r in spelling.vocabulary(frame, remove_each=None).collect()} == counts(CASES, None)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(empty)).collect() == []
