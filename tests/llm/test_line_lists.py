"""Line dedup: lines as flat arrays, and what leaves a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flamelake.llm import hashing, line_dedup

TEXTS = ["a b a\n\n c d\te \n", None, "", "\n\nz", "q", "a  A\r\nb a\n \x0b\nlast line here"]


def test_lines_of_texts(monkeypatch):
    bases = [0, 0, 5, 10, 0, 100]
    expected = []
    for doc, (text, base) in enumerate(zip(TEXTS, bases, strict=True)):
        for number, line in enumerate((text or "").split("\n")):
            if words := {w.lower() for w in line.split()}:
                expected.append((doc, base + number, len(words), frozenset(words)))
    # With 62 bits of a word's hash, four lines at a time have room.
    for bits in (line_dedup.WORD, 62):
        monkeypatch.setattr(line_dedup, "WORD", bits)
        found = line_dedup.Lines(TEXTS, bases)
        assert [*zip(found.doc, found.number, found.size, strict=True)] == [e[:3] for e in expected]
        same = [[a == b for b in found.digest] for a in found.digest]
        assert same == [[a[3] == b[3] for b in expected] for a in expected]
        assert (found.word[found.start] == np.minimum.reduceat(found.word, found.start)).all()
    assert not len(line_dedup.Lines([None, " \n "], [0, 0]).size)


def test_listed_words_leave_packed(spark):
    texts = [" ".join(f"w{(n * 7 + k * k) % 900}" for k in range(30)) for n in range(200)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").withColumn("base", F.lit(0).cast("bigint"))
    rows, counts = rows.coalesce(1), np.zeros(line_dedup.BUCKETS, np.int64)
    plain = line_dedup._postings(rows, counts, 80).collect()
    packed = line_dedup._postings(rows, counts, 80, 4).collect()
    assert len(plain) > 1000 and sorted(r["bucket"] for r in packed) == [0, 1, 2, 3]
    lists = [pa.ipc.open_stream(bytes(r["lists"])).read_all().to_pylist() for r in packed]
    places = [{(r["word"], r["share"]) for r in own} for own in lists]
    assert all(not a & b for n, a in enumerate(places) for b in places[:n])
    assert sorted(map(str, (r for own in lists for r in own))) == sorted(str(r.asDict()) for r in plain)


def test_text_is_shuffled_once(spark, monkeypatch):
    seen, real = [], line_dedup._based
    monkeypatch.setattr(line_dedup, "_based", lambda rows, starts: seen.append(rows) or real(rows, starts))
    docs = spark.createDataFrame([(1, "one two three", 5), (2, "one two three", 6)], "doc_id bigint, text string, `a.b` int")
    out = line_dedup.dedup(docs)
    assert seen[-1].schema["row"].dataType.names == ["doc_id", "a.b"]
    assert out.columns == ["doc_id", "text", "a.b", "line_dedup"]
    assert sorted((r["doc_id"], r["text"], r[2]) for r in out.collect()) == [(1, "one two three", 5), (2, "", 6)]


def test_second_step_works_on_lines_with_open_words_only(spark):
    """Of the other lines nothing but the hashes of their words is made, and the listed words are the same."""
    texts = [f"a{n} b{n} c{n} d{n} e{n} f{n}\nsome words of every text\n\nlast{n % 3} line of six words here" for n in range(40)] + [None, ""]
    places = np.arange(line_dedup.BUCKETS, dtype=np.uint64)
    whole = line_dedup.Lines(texts, [0] * len(texts), places)
    slots = np.zeros(1 << line_dedup.FILTER_BITS, bool)
    slots[line_dedup._slot(whole.word[whole.of == 3])] = True
    open_lines = np.unique(whole.of[slots[line_dedup._slot(whole.word)]])
    some = line_dedup.Lines(texts, [0] * len(texts), places, slots)
    assert 0 < len(some.size) == len(open_lines) < len(whole.size)
    for name in ("size", "doc", "number", "digest"):
        assert (getattr(some, name) == getattr(whole, name)[open_lines]).all(), name
    assert not len(line_dedup.Lines(texts, [0] * len(texts), places, np.zeros_like(slots)).size)

    rows = spark.createDataFrame([(n, t, 0) for n, t in enumerate(texts)], "doc_id bigint, text string, base bigint").coalesce(1)
    counts = np.zeros(line_dedup.BUCKETS, np.int64)
    every = line_dedup._postings(rows, counts, 80).collect()
    wanted = np.zeros_like(slots)
    wanted[line_dedup._slot(np.array([every[5]["word"]]).view(np.uint64))] = True
    expected = [r for r in every if wanted[line_dedup._slot(np.array([r["word"]]).view(np.uint64))[0]]]
    assert sorted(line_dedup._postings(rows, counts, 80, wanted=wanted).collect()) == sorted(expected) != []


def test_hashes_of_words():
    """Equal words have equal hashes wherever they stand, other words others, also by a byte far behind or by length."""
    words = [bytes([97 + n % 26]) * n for n in range(1, 40)] + [b"x" * k + y + b"x" * 30 for k in (0, 7, 8, 9, 16, 24) for y in (b"y", b"z")]
    words += [b"a\0", b"a\0\0", b"\0", b"\0" * 8, b"\0" * 9, b"\0" * 17, b"abcdefgh12345678", b"12345678abcdefgh", "größer".encode(), b"q" * 100_003]
    assert len(set(words)) == len(words)
    for blank in (b" ", b"   ", b"\n"):
        data = np.frombuffer(blank.join(words + words[::-1]), np.uint8)
        first, end = hashing.word_bounds(data)
        found = hashing.word_hashes(data, first, end)
        assert len(found) == 2 * len(words) and len(set(found.tolist())) == len(words)
        assert (found == found[::-1]).all()
    none = np.zeros(0, np.int64)
    assert not len(hashing.word_hashes(np.zeros(0, np.uint8), none, none))


def test_hashes_of_words_take_memory_by_words():
    """A step's hashes took more than 32 bytes a byte of text, and a worker kept 16 of them."""
    data = np.frombuffer(b" ".join([b"abcdefghijk"] * 250_000), np.uint8)
    first, end = hashing.word_bounds(data)
    hashing._powers.clear()
    tracemalloc.start()
    hashing.words([data.tobytes().decode()])
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 24 * len(data) and kept < len(data), (most / len(data), kept / len(data))


def test_texts_are_rebuilt_in_small_steps():
    """A whole Arrow batch (10,000 texts) was held as lists of lines at once."""
    n = 1500
    columns = {
        "doc_id": pa.array(range(n), pa.int64()), "text": pa.array([f"a {k}\nb\nc" for k in range(n)]), "base": pa.array([0] * n, pa.int64()),
        "lines": pa.array([[0, 2]] * n, pa.list_(pa.int64())), "row": pa.array([{"x": k} for k in range(n)]),
    }
    out = [*line_dedup._rebuild(iter([pa.RecordBatch.from_pydict(columns)]))]
    assert max(b.num_rows for b in out) <= 4 * line_dedup.ROWS
    rows = pa.Table.from_batches(out).to_pylist()
    assert rows == [{"row": {"x": k}, "text": f"a {k}\nc", "n_lines": 3, "n_removed": 1} for k in range(n)]


def test_lists_are_sorted_by_size():
    rng = np.random.default_rng(5)
    for many, longest in ((1, 5), (3000, 9), (3000, 100_000)):
        rows = {"word": rng.integers(0, 40, many) << 30, "share": rng.integers(-1, 3, many), "n": rng.integers(1, longest, many)}
        # Digests that differ in the first or only in the last bits.
        rows["digest"] = (rng.integers(-2, 2, many) << 61) + rng.integers(0, 2, many)
        rows |= {"doc_id": rng.integers(-(1 << 62), 1 << 62, many) * rng.integers(0, 2, many), "line": rng.integers(0, 9, many)}
        found = np.stack([rows[c][line_dedup._by_size(rows)] for c in ("word", "share", "n", "digest", "doc_id", "line")])
        lists = (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])
        assert lists.sum() + 1 == len({*zip(rows["word"].tolist(), rows["share"].tolist(), strict=True)})
        unsigned = [(w, s, n, d % 2**64, doc, line) for w, s, n, d, doc, line in found.T.tolist()]
        assert unsigned == sorted(unsigned)


def test_only_texts_of_a_pair_are_shuffled(spark, monkeypatch):
    """The sets of a few lines took every text through a shuffle."""
    seen, real = [], line_dedup.map_rows
    monkeypatch.setattr(line_dedup, "map_rows", lambda df, *a: seen.append(df) or real(df, *a))
    texts = [(n, f"a{n} b{n} c{n} d{n} e{n} f{n} g{n}") for n in range(3000)]
    texts += [(9000, "a5 b5 c5 d5 e5 f5 g5 x"), (9001, "nothing like it")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert left == dict(texts) | {9000: ""}
    joined = seen[0]
    assert set(joined.columns) >= {"doc_id", "text", "lines"} and {r["doc_id"] for r in joined.collect()} == {5, 9000}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "might_contain" in plan, plan
