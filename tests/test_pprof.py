"""Wire format, rejects, validation rules and ordered parts."""

import gzip

import pytest
from pyspark.sql import functions as F

from flamelake.operators.normalize import normalize, violations
from flamelake.sources import pprof, wire


def blob(messages):
    return gzip.compress(b"".join(wire.write_field(k, m) for k, m in messages))


def profile(**changes):
    """A minimal valid profile as (kind, message) pairs; ``changes`` replace single messages."""
    strings = changes.get("strings", ["", "samples", "count", "main", "/bin/app", "id1", "tid"])
    return [
        ("sample_type", {"type": 1, "unit": 2}),
        ("mapping", {"id": 1, "memory_start": 4096, "memory_limit": 8192, "filename": 4, "build_id": 5} | changes.get("mapping", {})),
        ("function", {"id": 1, "name": 3, "system_name": 3, "filename": 4} | changes.get("function", {})),
        ("location", {"id": 1, "mapping_id": 1, "address": -16, "line": [{"function_id": 1, "line": 9}]} | changes.get("location", {})),
        ("sample", {"location_id": [1], "value": [-5], "label": [{"key": 6, "str": 3}]} | changes.get("sample", {})),
        *[("string", s) for s in strings],
        ("header", {"time_nanos": 1734496663875999999, "duration_nanos": 10, "period_type": {"type": 1, "unit": 2}}),
    ]


def decoded(spark, *blobs):
    raw = spark.createDataFrame([(f"p{i}", bytearray(b)) for i, b in enumerate(blobs)], "profile_id string, raw_profile binary")
    return pprof.decode(raw)


def rules(spark, messages):
    return {r["rule"] for r in violations(decoded(spark, blob(messages))).collect()}


def test_read_back():
    data = b"".join(wire.write_field(k, m) for k, m in profile())
    read = list(wire.read_profile(data))
    assert [k for k, _, _ in read] == [k for k, _ in profile()]
    sample = next(m for k, _, m in read if k == "sample")
    assert sample["value"] == [-5] and sample["label"][0]["str"] == 3
    location = next(m for k, _, m in read if k == "location")
    assert location["address"] == -16
    unpacked = wire._put_varint(2 << 3) + wire._put_varint(7)
    assert wire.read_message(wire.SAMPLE, unpacked)["value"] == [7]


def test_rejects(spark):
    good = blob(profile())
    rows = decoded(spark, good, b"plain", good[:20], gzip.compress(b"\x0a\xff\xff"), gzip.compress(b""))
    bad = {r["profile_id"]: r["reason"] for r in pprof.rejects(rows).collect()}
    assert set(bad) == {"p1", "p2", "p3"} and bad["p1"] == "not gzip"
    assert {r["profile_id"] for r in violations(rows).collect()} == {"p1", "p2", "p3"}


def test_valid(spark):
    assert rules(spark, profile()) == set()


@pytest.mark.parametrize(
    "rule, changes",
    [
        ("V1", {"strings": ["x", "samples", "count", "main", "/bin/app", "id1", "tid"]}),
        ("V2", {"mapping": {"id": 2}}),
        ("V3", {"mapping": {"filename": 7}}),
        ("V3", {"mapping": {"filename": -1}}),
        ("V4", {"mapping": {"build_id": 7}}),
        ("V6", {"function": {"id": 3}}),
        ("V7", {"function": {"name": 7}}),
        ("V8", {"function": {"system_name": 7}}),
        ("V9", {"function": {"filename": 7}}),
        ("V10", {"location": {"id": 2}}),
        ("V11", {"location": {"mapping_id": 2}}),
        ("V12", {"location": {"line": [{"function_id": 2}]}}),
        ("V14", {"sample": {"value": [1, 2]}}),
        ("V15", {"sample": {"location_id": [2]}}),
        ("V15", {"sample": {"location_id": [0]}}),
        ("V16", {"sample": {"label": [{"key": 7, "str": 1}]}}),
        ("V16", {"sample": {"label": [{"str": 1}]}}),
        ("V17", {"sample": {"label": [{"key": 6, "str": 7}]}}),
    ],
)
def test_rules(spark, rule, changes):
    assert rule in rules(spark, profile(**changes))


def test_last_index_is_allowed(spark):
    assert rules(spark, profile(function={"name": 6}, sample={"label": [{"key": 6, "str": 6}]})) == set()


def test_no_sample_type_and_executables(spark):
    untyped = [m for m in profile() if m[0] != "sample_type"]
    assert "V13" in rules(spark, untyped)
    messages = decoded(spark, blob(profile()))
    counts = spark.createDataFrame([("p0", 2)], "profile_id string, executables long")
    assert [r["rule"] for r in violations(messages, counts).collect()] == ["V5"]


def test_normalize(spark):
    labels = [("__name__", "cpu"), ("node", "n1"), ("team", "t")]
    raw = spark.createDataFrame([("p0", labels)], "profile_id string, labels array<struct<name:string,value:string>>")
    rows = normalize(decoded(spark, blob(profile())), raw).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["name"], row["timestamp"], row["value"], row["labels.node"]) == ("cpu", 1734496663875, -5, "n1")
    assert row["series_labels"] == {"node": "n1", "team": "t"} and row["sample_labels"] == {"tid": "main"}
    frame = row["stacktrace"][0]
    assert frame["address"] == -16 and frame["mapping_build_id"] == "id1"
    assert frame["lines"][0]["function_start_line"] == 9
    assert str(row["date"]) == "2024-12-18"


@pytest.mark.parametrize("part_messages", [1, 2, 50_000])
def test_parts_are_read_as_they_are_and_joined_as_a_file(spark, part_messages):
    messages = decoded(spark, blob(profile()))
    parts = pprof.pprof_files(pprof.pprof_parts(messages, part_messages=part_messages))
    plain = lambda rows: sorted(map(str, rows.drop("profile_id").collect()))
    assert plain(pprof.decode(parts)) == plain(messages)
    joined = b"".join(bytes(r["raw_profile"]) for r in parts.orderBy("part").collect())
    assert plain(decoded(spark, joined)) == plain(messages)


def test_read_blobs(spark, tmp_path):
    (tmp_path / "a.pb.gz").write_bytes(blob(profile()))
    messages = pprof.decode(pprof.read_blobs(spark, str(tmp_path)))
    assert messages.where(F.col("kind") == "sample").count() == 1
