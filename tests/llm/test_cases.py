"""Null, empty, very long, tied, repeated and clashing input of every operator and stage."""

import random

import brute
import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from flamelake.llm import (
    bpe,
    components,
    decontaminate,
    language_id,
    licenses,
    line_dedup,
    near_dup,
    quality_mil,
    quality_rules,
    repeats,
    token_counts,
    transducer,
)

SF = "/root/testdata/sf0.001"
# Names that operators use inside, as extra columns of the input.
EXTRA = "row string, body string, _row string, spans string, n_lines bigint, node bigint, value string, digest string"


def prose(seed, count):
    rng = random.Random(seed)
    return " ".join(rng.choice(["of", "the", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(count))


BASE = prose(1, 120)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE + " tail"), (4, None), (5, ""), (6, " \n\t \n"), (7, "one"), (8, "one"), (9, "Two words"),
    (10, prose(2, 60) + "\n" + prose(3, 70)), (11, prose(2, 60) + "\n" + prose(4, 70)), (12, prose(5, 30000)),
    (13, "é" * 40 + " 中文字符 " + "😀" * 30), (14, "Released under the MIT License."), (15, "###$$$ &&& " * 40),
    (16, "a b c d e f g h"), (17, "a b c d e f g h i"), (18, "a b c d e f g h\n" * 5), (19, "x" * 49), (20, "x" * 50), (21, "x" * 51),
    (22, "²½Ⅻ"), (23, prose(1, 119) + " changed"),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
    langs = [None, "en", "en", "de"]
    rows = [(i, t, langs[i % 4], "s", len(t or "")) + ("r", "b", "q", "p", 1, 2, "v", "d") for i, t in ROWS]
    rows.append((None, "no id at all, but some words", "en", None, None) + (None,) * 8)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def repeated(docs):
    """Every row twice."""
    return docs.unionByName(docs)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_languages(spark, docs, none, repeated):
    model = language_id.fit(docs.select("text", "lang"))
    assert set(model["langs"]) == {"de", "en"}
    for given, times in ((docs, 1), (repeated, 2), (none, 0)):
        lang, score = language_id.predicted(language_id.spans(given, model))
        out = language_id.spans(given, model).select("doc_id", lang.alias("lang"), score.alias("score")).collect()
        assert len(out) == times * (len(ROWS) + 1)
        for r in out:
            assert (r["lang"] == "und") == (r["doc_id"] in (4, 5, 6, 15, 22)), r
    assert language_id.fit(none.select("text", "lang")) is None
    lang, _ = language_id.predicted(language_id.spans(docs, None))
    assert {r[0] for r in language_id.spans(docs, None).select(lang).collect()} == {"und"}


def test_language_spans_of_mixed_text(spark):
    sample = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(sample.where("lang in ('en', 'de')").select("text", "lang"))
    english = "that the thing and therein with the other "
    german = "der schein und die einung der schen heitung ist "
    rows = spark.createDataFrame([(1, english * 4 + german * 4), (2, "İ " + english), (3, "слово Wort")], "doc_id bigint, text string")
    out = by_id(language_id.spans(rows, model))
    assert [s["lang"] for s in out[1]["spans"]] == ["en", "de"]
    assert abs(out[1]["spans"][1]["first"] - len(english) * 4) <= 12
    assert out[1]["spans"][-1]["end"] == len(english * 4 + german * 4)


def test_every_language_is_learned(spark, monkeypatch):
    # More languages than one byte counts, each with words of its own letters; the last by name is rarest.
    letters = "bcdfghjklmnpqrstvwxz"
    words = [f"{a}a{b}o{a}{b}" for a in letters for b in letters][:150]
    rows = [(n, f"{w} " * 30, f"l{n:03}") for n, w in enumerate(words) for _ in range(1 + (n < 149))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs.select("text", "lang"))
    assert model["langs"] == [f"l{n:03}" for n in range(150)]
    for cells in (language_id.CELLS, 1):
        monkeypatch.setattr(language_id, "CELLS", cells)
        lang, _ = language_id.predicted(language_id.spans(docs, model))
        out = language_id.spans(docs, model).select("doc_id", lang.alias("lang")).collect()
        assert len(out) == len(rows) and all(r["lang"] == f"l{r['doc_id']:03}" for r in out)


def test_licenses(docs, none, repeated):
    out = by_id(licenses.scan(docs))
    assert out[14]["licenses"] == ["MIT"] and out[4]["licenses"] == [] and out[12]["n_unmatched"] == 0
    assert licenses.scan(none).count() == 0 and licenses.scan(repeated).count() == 2 * (len(ROWS) + 1)


def test_license_rules(spark):
    import re

    assert all(re.search(licenses.TRIGGER, s) for s in licenses.known())
    full = "\n".join(licenses.SENTENCES[n] + "." for n in ("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liable"))
    wrapped = licenses.SENTENCES["gpl-redistribute"].replace(" ", "\n", 12) + ".\n" + licenses.SENTENCES["gpl-hope"] + "."
    both = licenses.SENTENCES["bsd-grant"] + ".\nSPDX-License-Identifier: MIT\nSome other license applies here.\n"
    rows = spark.createDataFrame([(1, full), (2, wrapped), (3, both)], "doc_id bigint, text string")
    out = by_id(licenses.scan(rows))
    assert out[1]["licenses"] == ["MIT"] and out[1]["n_unmatched"] == 0
    assert out[2]["licenses"] == ["GPL-3.0-or-later"]
    assert out[3]["licenses"] == ["MIT"] and out[3]["n_unmatched"] == 1 and out[3]["n_unknown"] == 1


def test_token_counts(docs, none, repeated):
    count = lambda given: token_counts.count(given, P.path("byte_bpe_50k.json"), P.PATTERN)
    out = by_id(count(docs))
    assert out[4]["n_tokens"] == out[5]["n_tokens"] == 0 and out[12]["over_limit"] and not out[7]["over_limit"]
    assert count(none).count() == 0 and count(repeated).count() == 2 * (len(ROWS) + 1)


def test_round_trip(docs, none):
    ids = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    run = lambda given: transducer.decode(transducer.encode(given, ids, P.PATTERN), ids)
    out = by_id(run(docs))
    assert all(out[i]["text"] == (t or "") for i, t in ROWS)
    assert run(none).count() == 0


@pytest.mark.parametrize("block", [repeats.BLOCK, 1])
def test_repeats(docs, none, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    out = by_id(repeats.dedup(docs))
    for doc, (kept, runs) in brute.repeats(ROWS).items():
        assert (bytes(out[doc]["kept"]), len(out[doc]["spans"])) == (kept, runs), doc
    assert out[None]["spans"] == [] and repeats.dedup(none).count() == 0


def test_repeated_rows_do_not_remove_each_other(spark):
    rows = spark.createDataFrame([(1, BASE), (1, BASE), (2, BASE)], "doc_id bigint, text string")
    out = sorted((r["doc_id"], len(r["kept"])) for r in repeats.dedup(rows).collect())
    assert out == [(1, len(BASE)), (1, len(BASE)), (2, 0)]


@pytest.mark.parametrize("block", [repeats.BLOCK, 1])
def test_repeats_of_texts_that_share_an_id(spark, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    part = [prose(80 + n, 60) for n in range(6)]
    rows = [
        (1, part[0] + part[1]), (1, part[2] + "x" + part[3]), (1, "short"), (2, part[4] + part[1][7:]), (2, part[5] * 2),
        (2, part[2][:200] + "y" + part[3][5:]), (3, "z" * 9 + part[4][3:]), (3, part[3] + part[0]), (3, "w"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = sorted((r["doc_id"], bytes(r["kept"])) for r in repeats.dedup(df).collect())
    expected = []
    for doc, text in rows:
        data, gone = text.encode(), set()
        for at in range(len(data) - 49):
            if any(d < doc and data[at : at + 50] in t.encode() for d, t in rows):
                gone.update(range(at, at + 50))
        expected.append((doc, bytes(b for n, b in enumerate(data) if n not in gone)))
    assert out == sorted(expected)


def test_run_index_statistics():
    import numpy as np

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(6, 40))).encode() for _ in range(60)]
    docs = np.array([rng.randrange(30) for _ in texts])
    index, context, first, run = repeats.marked(texts, docs, 5)
    assert len(context) == sum(len(t) - 4 for t in texts)
    assert len(index.run_start) < sum(len(t) + 1 for t in texts)
    for c, f, r in zip(context, first, run):
        window = texts[c][f : f + 5]
        assert index.sample[r] == min(d for t, d in zip(texts, docs) if window in t)


def test_near_duplicates(docs, none, repeated):
    expected = brute.groups(ROWS, 4)
    for given in (docs, repeated):
        out = by_id(near_dup.groups(given, shingle=4))
        for doc, (size, component) in expected.items():
            assert (out[doc]["n_shingles"], out[doc]["component_id"], out[doc]["kept"]) == (size, component, doc == component), doc
        assert out[None]["kept"] and out[None]["component_id"] is None
    assert near_dup.groups(none).count() == 0


def test_near_duplicate_chains_and_shared_passages(spark):
    rng = random.Random(5)
    chain = [prose(50, 300).split()]
    for n in range(12):  # each differs from the one before, the ends are far apart
        following = chain[-1][:]
        for _ in range(6):
            following[rng.randrange(300)] = f"new{n}x{rng.randrange(10**6)}"
        chain.append(following)
    passage = prose(51, 90)
    rows = [(n, " ".join(c)) for n, c in enumerate(chain)]
    rows += [(100 + n, passage + " " + prose(60 + n, 20 + 3 * n)) for n in range(25)]
    rows += [(200 + n, prose(90, 400) + f" end{n}") for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = {r["doc_id"]: r["component_id"] for r in near_dup.groups(df, shingle=4).collect()}
    assert out == {d: c for d, (_, c) in brute.groups(rows, 4).items()}


def test_near_duplicates_above_whole_sets_in_long_lists(spark):
    """A passage of 420 words in 60 documents: their lists are long, and pairs lie on both sides of 0.8."""
    rng = random.Random(8)
    passage = prose(700, 420)
    rows = [(n, passage + " " + prose(800 + n, 30 + 4 * n)) for n in range(30)]
    for n in range(30, 60):  # copies of the first ones with a few words changed, so groups grow in these lists
        words = rows[rng.randrange(30)][1].split()
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    expected = brute.groups(rows, 4)
    assert all(size > near_dup.WHOLE for size, _ in expected.values()) and len({c for _, c in expected.values()}) > 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = {r["doc_id"]: r["component_id"] for r in near_dup.groups(df, shingle=4).collect()}
    assert out == {d: c for d, (_, c) in expected.items()}


def test_edited_copies_are_not_paired_in_list_after_list(spark, monkeypatch):
    """Copies of one text with many edits share hashes in dozens of lists, but few of their pairs are near 0.8."""
    rng = random.Random(21)
    rows = []
    for n in range(80):
        words = prose(900, 400).split()
        for _ in range(rng.randrange(3, 40)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    expected = brute.groups(rows, 4)
    counted, real = {}, near_dup.stage

    def counting(df, label):
        counted[label] = real(df, label)
        return counted[label]

    monkeypatch.setattr(near_dup, "stage", counting)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = {r["doc_id"]: r["component_id"] for r in near_dup.groups(df, shingle=4).collect()}
    assert out == {d: c for d, (_, c) in expected.items()}
    sets = {d: brute.shingles(text, 4) for d, text in rows}
    near = sum(len(sets[a] & sets[b]) >= 0.72 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    assert counted["second-pairs"].count() <= near
    assert near < 80 * 79 / 2 / 4


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (20, 3), (30, 31), (31, 30), (5, 5)] + [(100 + n, 101 + n) for n in range(40)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    expected = {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30} | {100 + n: 100 for n in range(41)}
    assert out == expected
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_quality_scores(spark, docs, none, repeated):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in ROWS] + [(None, 1), (999, None)], "doc_id bigint, label int")
    model = quality_mil.fit(docs, labels)
    out = quality_mil.score(repeated, model).collect()
    assert len(out) == 2 * (len(ROWS) + 1)
    assert all(0 <= r["score"] <= 1 and abs(sum(r["attention"]) - 1) < 1e-3 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert quality_mil.score(none, model).count() == 0
    assert quality_mil.fit(docs, labels.where("false")) == {"constant": 0.5}
    assert quality_mil.fit(docs, labels.where("label = 1")) == {"constant": 1.0}
    assert {r["score"] for r in quality_mil.score(docs, {"constant": 1.0}).collect()} == {1.0}


def test_quality_passages_do_not_depend_on_neighbours():
    texts = ["  lead blanks", "", " \n ", None, "one", "\n\n two words " * 70, "one"]
    made, counts = quality_mil.passages(texts)
    alone = [quality_mil.passages([t]) for t in texts]
    assert counts.tolist() == [c for _, own in alone for c in own.tolist()]
    assert made.tolist() == [row for own, _ in alone for row in own.tolist()]


def test_quality_fit_reads_every_passage(spark, monkeypatch):
    bags = []
    train = lambda found, *rest: bags.append([len(b) for b in found]) or {"constant": 0.5}
    monkeypatch.setattr(quality_mil, "train", train)
    rows = [(1, prose(1, 20_000)), (2, prose(2, 700)), (3, "few words"), (4, None), (5, prose(5, 6400)), (6, prose(6, 64))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, label int")
    quality_mil.fit(docs, labels)
    assert sorted(bags.pop()) == [1, 1, 1, 11, 100, 313]
    # Less room: whole documents stay away, and one of each label is left.
    for room in (300, 2):
        monkeypatch.setattr(quality_mil, "FIT_PASSAGES", room)
        quality_mil.fit(docs, labels)
        found = bags.pop()
        assert 2 <= len(found) < 6 and set(found) <= {1, 11, 100, 313}


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 1])
def test_decontamination(spark, docs, none, given, items, block_bytes):
    items = [*items[:30], (900, "One"), (901, "two, words!"), (902, None), (903, "..."), (904, items[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = ROWS + [(1000 + d, t) for d, t in given[:40]] + [(5000, items[2][1]), (5001, "A b. " + items[3][1].upper() + " c")]
    given_docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = by_id(decontaminate.judged(decontaminate.scan(given_docs, bench, block_bytes=block_bytes)))
    for doc, (n, hit, found) in brute.contaminated(rows, items).items():
        r = out[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(found), brute.sha(",".join(found))), doc
    assert out[5000]["contaminated"] and not out[12]["contaminated"]
    spans = by_id(decontaminate.scan(given_docs, bench))[5001]["byte_spans"]
    assert [rows[-1][1].encode()[s["first"] : s["end"]].decode().lower() for s in spans][0].startswith(items[3][1].lower()[:20])
    assert decontaminate.scan(none, bench).count() == 0
    assert decontaminate.clean(docs, bench.where("false")).columns == docs.columns


def test_benchmark_blocks_are_scanned_one_by_one(spark, items, monkeypatch):
    staged, write = [], decontaminate.stage
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(decontaminate, "stage", lambda df, label: staged.append(label) or write(df, label))
    items = [*items[:12], (900, prose(40, 1500)), (901, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    blocks = list(decontaminate.pattern_blocks(bench, 13, 20_000))
    assert len(blocks) > 3 and all(sum(map(len, b)) <= 20_000 + 1000 for b in blocks)
    assert {k for b in blocks for k in b} == {k for _, t in items for k in decontaminate.windows(t, 13)}
    # The long item is in several blocks; its text twice, and one with null id.
    rows = ROWS + [(5000, items[2][1]), (5001, items[12][1]), (5001, items[12][1]), (None, items[12][1] + " x")]
    hits = decontaminate.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), bench, block_bytes=20_000)
    assert staged == ["block-hits"] * (len(blocks) - 1) + ["hits"]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    out = decontaminate.judged(hits).collect()
    assert len(out) == len(rows) and [r["n_hit"] for r in out if r["doc_id"] == 5001] == [1500, 1500]
    assert [(r["n_hit"], r["n_words"]) for r in out if r["doc_id"] is None] == [(1500, 1501)]
    expected = brute.contaminated(rows, items)
    for r in out:
        if r["doc_id"] is not None:
            n, hit, found = expected[r["doc_id"]]
            assert (r["n_words"], r["n_hit"], r["items_sha256"]) == (n, hit, brute.sha(",".join(found))), r


def test_lines(docs, none, repeated):
    expected = brute.lines(ROWS)
    for given in (docs, repeated):
        out = by_id(line_dedup.dedup(given))
        assert {i: out[i]["text"] for i, _ in ROWS} == expected
        assert out[None]["text"] == "no id at all, but some words" and out[1]["row"] == "r"
    assert line_dedup.dedup(none).count() == 0


def test_similar_lines_in_long_lists(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(70, 40).split()
    lines = []
    for n in range(120):
        own = base[:]
        for _ in range(n % 14):
            own[rng.randrange(40)] = f"z{rng.randrange(60)}"
        lines.append(" ".join(own))
    rows = [(n, "\n".join(lines[n * 4 : n * 4 + 4])) for n in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for share, bounds in ((line_dedup.SHARE, (48, 20_000, 16)), (5, (48, 20_000, 16)), (10**9, (3, 10, 2)), (10**9, (3, 10**6, 10**6))):
        for name, bound in zip(("SHORT", "SOURCES", "PARTNERS"), bounds):
            monkeypatch.setattr(line_dedup, name, bound)
        monkeypatch.setattr(line_dedup, "SHARE", share)
        out = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()}
        assert out == brute.lines(rows)


def test_quality_rules(docs, none, repeated):
    out = by_id(quality_rules.rules(docs))
    assert out[4]["n_words"] == 0 and out[4]["base_failed"] and not out[4]["kept"]
    assert out[18]["n_dup_lines"] == 4 and out[15]["n_symbols"] > 300 and not out[15]["kept"]
    assert quality_rules.rules(none).count() == 0
    kept = quality_rules.clean(repeated)
    assert kept.columns == docs.columns and kept.where("doc_id = 12").count() == 2


def test_stages_keep_columns(spark, docs, none):
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns, name
        assert step(spark, none, SF).count() == 0, name


def test_lines_of_texts_that_share_an_id(spark):
    import hashlib

    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (2, a), (2, b), (5, b + "\nalpha beta gamma"), (6, b + " z\nalone here"), (6, "other words only"), (6, "other words only"), (6, None), (7, "other words only")]
    rows += [(9, f"shared line of all\nown line number {n} word{n} and word{n + 100} more{n}") for n in range(60)]
    order = sorted({(doc, text) for doc, text in rows}, key=lambda r: (r[0], hashlib.md5((r[1] or "").encode()).hexdigest()))
    plain = brute.lines([(n, text) for n, (_, text) in enumerate(order)])
    expected = {key: plain[n] for n, key in enumerate(order)}
    frame = spark.createDataFrame([(doc, text, 3) for doc, text in rows], "doc_id long, text string, base int").repartition(4)
    packed = frame.withColumn("given", F.col("text"))
    got = [((r["doc_id"], r["given"]), r["text"]) for r in line_dedup.dedup(packed).collect()]
    assert sorted(got, key=str) == sorted(((key, expected[key]) for key in rows), key=str)
    assert expected[6, "other words only"] == "other words only" and expected[2, b] == b and expected[7, "other words only"] == ""
