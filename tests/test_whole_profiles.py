"""Profiles gathered in one row against the joins, and what is left to the joins."""

import pytest
from pyspark.sql import functions as F

from flamelake.operators import normalize
from test_pprof import blob, decoded, profile


def many(samples, strings):
    """A profile with several samples, stacks and labels."""
    rows = [m for m in profile(strings=["", "samples", "count", "main", "/bin/app", "id1", "tid", *strings]) if m[0] != "sample"]
    rows.append(("location", {"id": 2, "address": 7, "line": [{"function_id": 1, "line": 3}, {"line": 4}]}))
    labels = [[{"key": 6, "str": 3}, {"key": 6, "num": 8}], [], [{"key": 6, "str": 7}, {"key": 6, "str": 3}]]
    stacks = [[1, 2], [], [2, 2, 1]]
    return rows + [("sample", {"location_id": stacks[i % 3], "value": [i], "label": labels[i % 3]}) for i in range(samples)]


def series(spark, ids):
    rows = [(i, [("__name__", "cpu"), ("node", "n")]) for i in ids]
    return spark.createDataFrame(rows, "profile_id string, labels array<struct<name:string,value:string>>")


def text(rows):
    return sorted(map(str, rows.drop("ingest_date").collect()))


def both(spark, monkeypatch, messages, query, whole):
    found = text(query(messages))
    monkeypatch.setattr(normalize, "WHOLE", 0)
    joined = text(query(messages))
    monkeypatch.setattr(normalize, "WHOLE", whole)
    return found, joined


QUERIES = {
    "normalize": lambda spark, m: normalize.normalize(m, series(spark, ["p0", "p1", "p2"])),
    "stacks": lambda spark, m: normalize.sample_stacks(m),
    "labels": lambda spark, m: normalize.sample_labels(m),
}


@pytest.mark.parametrize("name", QUERIES)
def test_whole_profiles_equal_the_joins(spark, monkeypatch, name):
    messages = decoded(spark, blob(profile()), blob(many(6, ["a", "b"])), blob(many(1, ["c"])))
    found, joined = both(spark, monkeypatch, messages, lambda m: QUERIES[name](spark, m), 1 << 14)
    assert found == joined and found


@pytest.mark.parametrize("name", QUERIES)
def test_large_and_repeated_profiles_go_through_joins(spark, monkeypatch, name):
    messages = decoded(spark, blob(profile()), blob(many(6, ["a", "b"])), blob(many(1, ["c"])))
    twice = messages.unionByName(messages.where("profile_id = 'p0' and kind in ('sample', 'string')"))
    monkeypatch.setattr(normalize, "WHOLE", 9)  # p1 has a string at 8, p2 one at 7
    whole, rest = normalize.whole_profiles(twice, ("string", "sample"))
    assert {r["profile_id"] for r in whole.collect()} == {"p1", "p2"} and {r["profile_id"] for r in rest.collect()} == {"p0"}
    monkeypatch.setattr(normalize, "WHOLE", 8)
    whole, rest = normalize.whole_profiles(twice, ("string", "sample"))
    assert {r["profile_id"] for r in whole.collect()} == {"p2"} and {r["profile_id"] for r in rest.collect()} == {"p0", "p1"}
    found, joined = both(spark, monkeypatch, twice, lambda m: QUERIES[name](spark, m), 8)
    assert found == joined


def test_messages_of_ordinary_profiles_are_not_joined(spark):
    plan = normalize.sample_stacks(decoded(spark, blob(profile())))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_gap_is_not_a_whole_profile(spark):
    messages = decoded(spark, blob(many(3, []))).where(~((F.col("kind") == "string") & (F.col("pos") == 2)))
    whole, rest = normalize.whole_profiles(messages, ("string",))
    assert whole.isEmpty() and not rest.isEmpty()
