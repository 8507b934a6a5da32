"""As-of, interval, address and skewed joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from flamelake.functions.ids import dense_ids
from flamelake.functions.skew import skew_join
from flamelake.operators import addresses as a
from flamelake.operators.asof import asof_lookup
from flamelake.operators.rangejoin import interval_lookup
from flamelake.operators.segments import disjoint_segments
from flamelake.operators.symbolize import closest_symbols, needs_symbols, attach_lines
from flamelake.schema import FRAME

BIG = 1 << 62


def positions(rng, n):
    """Near and far values, so that every level of the range split is used."""
    return {rng.choice([rng.randrange(100), rng.randrange(1 << 30), rng.randrange(-BIG, BIG)]) for _ in range(n)}


def test_asof(spark):
    rng = random.Random(1)
    entries = [(k, p, f"{k}{p}") for k in "ab" for p in positions(rng, 60)]
    probes = [(k, p) for k in "abc" for p in positions(rng, 80)] + [("a", entries[0][1])]
    got = asof_lookup(
        spark.createDataFrame(probes, "k string, p long"),
        spark.createDataFrame(entries, "k string, p long, v string"),
        ["k"],
        "p",
        ["v"],
    ).collect()
    assert len(got) == len(set(probes))
    for row in got:
        before = [e for e in entries if e[0] == row["k"] and e[1] <= row["p"]]
        best = max(before, key=lambda e: e[1], default=None)
        assert (row["matched_p"], row["v"]) == ((best[1], best[2]) if best else (None, None))


def test_unsigned_symbol_order(spark):
    kernel = -2130706432  # 0xffffffff81000000
    symbols = spark.createDataFrame([("k", 4096, "user"), ("k", kernel, "kernel")], "build_id string, address long, name string")
    probes = spark.createDataFrame([("k", kernel + 5), ("k", 5000), ("k", 1)], "build_id string, address long")
    got = {r["address"]: r["symbol"] for r in closest_symbols(probes, symbols).collect()}
    assert got == {kernel + 5: "kernel", 5000: "user", 1: None}


def test_intervals(spark):
    rng = random.Random(2)
    intervals = []
    for i in range(120):
        low = rng.choice([rng.randrange(5000), rng.randrange(1 << 40), rng.randrange(-BIG, BIG)])
        intervals.append((rng.choice("ab"), low, low + rng.choice([0, 1, 7, 300, 1 << 17, 1 << 33, 1 << 61]), i))
    points = {(rng.choice("ab"), p) for p in positions(rng, 150)} | {("a", x[1]) for x in intervals}
    got = interval_lookup(
        spark.createDataFrame(sorted(points), "k string, p long"),
        spark.createDataFrame(intervals, "k string, low long, high long, i int"),
        ["k"],
        "p",
    ).select("k", "p", "i")
    expected = sorted((k, p, i) for k, p in points for kk, low, high, i in intervals if k == kk and low <= p < high)
    assert sorted(map(tuple, got.collect())) == expected


def covering(intervals, key, point):
    return sorted(i for k, low, high, i in intervals if k == key and low <= point < high)


def test_segments_are_disjoint_and_complete(spark):
    rng = random.Random(7)
    intervals = [("a", -BIG, BIG - 1, 0), ("c", 4096, 8192, 1), ("c", 8192, 12288, 2), ("d", 5, 5, 3)]
    for i in range(10, 160):
        low = rng.choice([rng.randrange(9000), rng.randrange(1 << 30), rng.randrange(-BIG, BIG - (1 << 40))])
        intervals.append((rng.choice("ab"), low, low + rng.choice([0, 1, 7, 300, 4096, 1 << 17, 1 << 33]), i))
    frame = spark.createDataFrame(intervals, "k string, low long, high long, i int")
    segments = disjoint_segments(frame, ["k"], F.struct("i"))
    got = {(r["k"], r["start"]): [e["i"] for e in r["entries"]] for r in segments.collect()}
    ends = {(k, p) for k, low, high, _ in intervals if low < high for p in (low, high)}
    assert got == {(k, p): covering(intervals, k, p) for k, p in ends}
    # One point meets one segment, also under a range over everything.
    points = {(rng.choice("abcde"), p) for p in positions(rng, 150)} | {(k, p) for k, p in ends}
    found = asof_lookup(spark.createDataFrame(sorted(points), "k string, p long"), segments.withColumnRenamed("start", "p"), ["k"], "p", ["entries"])
    rows = {(r["k"], r["p"]): [e["i"] for e in r["entries"] or []] for r in found.collect()}
    assert rows == {(k, p): covering(intervals, k, p) for k, p in points}


def test_segments_of_a_binary_with_one_range_over_everything(spark):
    """Work follows range ends: pages in use each get the large range once, however many points there are."""
    ranges = spark.range(5000).select(F.lit("b").alias("k"), (F.col("id") * 5000).alias("low"), (F.col("id") * 5000 + 100).alias("high"), F.col("id").alias("i"))
    whole = spark.createDataFrame([("b", -1, 1 << 62, -1)], "k string, low long, high long, i long")
    segments = disjoint_segments(ranges.unionByName(whole), ["k"], F.struct("i"))
    sizes = {r["n"]: r["c"] for r in segments.groupBy(F.size("entries").alias("n")).agg(F.count("*").alias("c")).collect()}
    assert sizes == {2: 5000, 1: 5001, 0: 1}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how):
    rows = [(1, "hot", i) for i in range(500)] + [(i, "x", i) for i in range(40)] + [(None, "null", i) for i in range(30)]
    left = spark.createDataFrame(rows, "a long, t string, n long")
    right = spark.createDataFrame([(1, "one"), (1, "uno"), (2, "two"), (99, "no")], "a long, v string")
    got = skew_join(left, right, ["a"], how, hot_rows=50)
    plain = left.join(right, ["a"], how)
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_dense_ids(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("key"))
    ids = dense_ids(df, ["g"], "key", "n").groupBy("g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("n").alias("d"), F.count("*").alias("c")
    )
    for r in ids.collect():
        assert r["lo"] == 1 and r["hi"] == r["d"] == r["c"]


CASES = [
    ("exe", a.EXECUTABLE, 0x400000, 0x464000, 0, [(0, 0x400000, 0x64000)], 0x463781, a.OK, 0x463781),
    ("dyn", a.DYNAMIC, 0x55D0C0001000, 0x55D0C0003000, 0x1000, [(0x1000, 0x1000, 0x1F00)], 0x55D0C0001234, a.OK, 0x1234),
    ("rel", a.RELOCATABLE, 0x1000, 0x2000, 0x1000, [(0x1000, 0x1000, 0x1000)], 0x1800, a.RELOCATABLE_OFFSET, None),
    ("empty", a.DYNAMIC, 0x2000, 0x2000, 0, [(0, 0, 0x1000)], 0x2000, a.INVALID_MAPPING, None),
    ("far", a.DYNAMIC, 0x1000, 0x8000000000000001 - (1 << 64), 0, [(0, 0, 0x1000)], 0x1234, a.INVALID_MAPPING, None),
    ("none", a.DYNAMIC, 0x1000, 0x5000, 0, [], 0x1234, a.OK, 0x1234),
    # Two headers cover the mapping, none the file offset of the address.
    ("gap", a.DYNAMIC, 0x10000, 0x16000, 0, [(0, 0, 0x100), (0, 0x1000, 0x200)], 0x13000, a.NO_HEADER_AT_OFFSET, None),
    ("two", a.DYNAMIC, 0x10000, 0x16000, 0, [(0, 0, 0x3000), (0, 0x1000, 0x3000)], 0x10010, a.SECOND_HEADER, None),
    ("kind", 7, 0x10000, 0x16000, 0, [(0, 0, 0x6000)], 0x10010, a.UNKNOWN_KIND, None),
]


def test_addresses(spark):
    probes = spark.createDataFrame(
        [(c[0], c[6], c[2], c[3], c[4]) for c in CASES],
        "build_id string, address long, mapping_start long, mapping_limit long, mapping_offset long",
    )
    segments = spark.createDataFrame(
        [(c[0], c[1], i, *s) for c in CASES for i, s in enumerate(c[5])],
        "build_id string, elf_kind int, segment int, offset long, vaddr long, memsz long",
    )
    got = {r["build_id"]: (r["status"], r["normalized"]) for r in a.normalize_addresses(probes, segments).collect()}
    assert got == {c[0]: (c[7], c[8]) for c in CASES}


def test_attach_keeps_order_and_present_lines(spark):
    line = [(7, "f", "f", "f.c", 1)]
    stack = [(16, 0, 100, 0, "a", "b1", []), (32, 0, 100, 0, "a", "b1", line), (48, 0, 100, 0, "a", "b1", [])]
    schema = f"stacktrace array<{FRAME.simpleString()}>, value long"
    stacks = spark.createDataFrame([(stack, 1), (stack, 2), (None, 3)], schema)
    resolved = spark.createDataFrame(
        [("b1", 0, 100, 0, 16, [(1, "leaf", "leaf", "l.c", 1)])],
        "build_id string, mapping_start long, mapping_limit long, mapping_offset long, address long, "
        f"lines {FRAME['lines'].dataType.simpleString()}",
    )
    rows = {r["value"]: r["stacktrace"] for r in attach_lines(stacks, resolved).collect()}
    assert rows[3] is None
    for value in (1, 2):
        assert [f["address"] for f in rows[value]] == [16, 32, 48]
        assert [[x["function_name"] for x in f["lines"]] for f in rows[value]] == [["leaf"], ["f"], []]
    assert stacks.where(F.exists("stacktrace", needs_symbols)).count() == 2


def test_many_hot_keys(spark):
    left = spark.range(6000).selectExpr("id % 1500 as a", "id as x")
    right = spark.range(1500).selectExpr("id as a", "id * 2 as y")
    got = skew_join(left, right, ["a"], "inner", hot_rows=2)
    assert got.count() == 6000 and got.where("y <> a * 2").count() == 0


def test_wrapping_arithmetic(spark):
    from flamelake.functions import u64
    from pyspark.sql import functions as F

    edges = [0, 1, -1, 2**63 - 1, -(2**63), 0xFFFFFFFF, -0xFFFFFFFF, 4096, 1 << 32]
    rows = spark.createDataFrame([(a, b) for a in edges for b in edges], "a bigint, b bigint")
    out = rows.select("a", "b", u64.wrapping_add(F.col("a"), F.col("b")).alias("s"), u64.wrapping_subtract(F.col("a"), F.col("b")).alias("d"))
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    assert all((r["s"], r["d"]) == (signed(r["a"] + r["b"]), signed(r["a"] - r["b"])) for r in out.collect())


def test_attach_repeats_a_frame_for_repeated_lines(spark):
    stack = [(16, 0, 100, 0, "a", "b1", []), (32, 0, 100, 0, "a", "b1", [])]
    stacks = spark.createDataFrame([(stack, 1)], f"stacktrace array<{FRAME.simpleString()}>, value long")
    lines = [("b1", 0, 100, 0, 16, [(n, "leaf", "leaf", "l.c", 1)]) for n in (1, 2)]
    resolved = spark.createDataFrame(
        lines,
        "build_id string, mapping_start long, mapping_limit long, mapping_offset long, address long, "
        f"lines {FRAME['lines'].dataType.simpleString()}",
    )
    (row,) = attach_lines(stacks, resolved).collect()
    assert [(f["address"], [x["line"] for x in f["lines"]]) for f in row["stacktrace"]] == [(16, [1]), (16, [2]), (32, [])]


def test_attach_moves_no_frames_to_look_them_up(spark):
    stacks = spark.createDataFrame([([(16, 0, 100, 0, "a", "b1", [])], 1)], f"stacktrace array<{FRAME.simpleString()}>, value long")
    resolved = spark.createDataFrame(
        [], f"build_id string, mapping_start long, mapping_limit long, mapping_offset long, address long, lines {FRAME['lines'].dataType.simpleString()}"
    )
    plan = attach_lines(stacks, resolved)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 0 and "Distinct" not in plan


def test_a_join_without_hot_keys_moves_each_side_once(spark):
    left, right = spark.range(100).selectExpr("id % 10 as a", "id as x"), spark.range(10).selectExpr("id as a", "id as y")
    joined = skew_join(left, right, ["a"])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and joined.count() == 100
