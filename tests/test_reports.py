"""Properties of reports, empty input and the store."""

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from flamelake.operators import discovery, layout, metastore, reports, select, timeseries
from flamelake.operators.status import targets_by_state
from flamelake.schema import FRAME

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return fx.samples(spark, SF)


def test_flamegraph_properties(rows):
    nodes = reports.flamegraph(rows)
    total = rows.agg(F.sum("value")).first()[0]
    assert nodes.where("depth = 0").agg(F.sum("cumulative")).first()[0] == total
    assert nodes.agg(F.sum("flat")).first()[0] == total
    child = nodes.select(F.col("parent_id").alias("node_id"), F.col("cumulative").alias("c")).groupBy("node_id").agg(F.sum("c").alias("c"))
    over = nodes.join(child, "node_id").where("c > cumulative or cumulative - flat <> c")
    assert over.count() == 0
    summary = reports.flamegraph_summary(nodes).first()
    assert (summary["total"], summary["trimmed"]) == (total, 0)


@pytest.mark.parametrize("threshold", [0, 1])
def test_layout_nests(rows, threshold):
    nodes = reports.trim_flamegraph(reports.flamegraph(rows), threshold)
    placed = {r["record"]: r for r in layout.flamegraph_layout(nodes).collect()}
    assert sorted(placed) == list(range(nodes.count()))
    for record, r in placed.items():
        edge, last = r["left"], record
        for n, child in enumerate(r["children"]):
            c = placed[child]
            assert c["parent_id"] == r["node_id"] and c["left"] == edge and child > last
            assert n > 0 or child == record + 1
            edge, last = edge + c["cumulative"], child
        assert edge <= r["left"] + r["cumulative"]
    assert sum(len(r["children"]) for r in placed.values()) == sum(r["depth"] > 0 for r in placed.values())


def test_layout_of_deep_and_empty_trees(spark):
    from flamelake.schema import STACKTRACE

    def stack(*names):
        return [(n, 0, 0, 0, "", "", [(1, name, name, "f", 0)]) for n, name in enumerate(names)]

    deep = [f"f{n}" for n in range(77)]
    rows = [(stack(*deep), 5), (stack("x", *deep[40:]), 2), (stack("solo"), 1)]
    profile = spark.createDataFrame(rows, f"stacktrace {STACKTRACE.simpleString()}, value long")
    placed = layout.flamegraph_layout(reports.flamegraph(profile)).orderBy("record").collect()
    assert [r["record"] for r in placed] == list(range(79))
    assert [(r["name"], r["left"]) for r in placed if r["name"] in ("f76", "f0", "x", "solo")] == [("f76", 0), ("f0", 0), ("x", 5), ("solo", 7)]
    assert layout.flamegraph_layout(reports.flamegraph(profile.where("false"))).count() == 0


def test_functions_of_one_name_in_two_binaries(spark):
    def frame(build, binary, name, file="f.c"):
        return (1, 0, 0, 0, binary, build, [(1, name, name, file, 0)] if name else None)

    app, other, raw = frame("a", "/bin/a", "main"), frame("b", "/bin/b", "main"), frame(None, None, None)
    rows = [([raw, app], 5, 1), ([app, app], 2, -2), ([other], 4, 4), ([app, other, app], 1, 0)]
    profile = spark.createDataFrame(rows, f"stacktrace array<{FRAME.simpleString()}>, value long, diff long")
    top = {(r["build_id"], r["function"]): r for r in reports.top_functions(profile, places=True).collect()}
    assert {k: (r["cumulative"], r["flat"], r["cumulative_diff"], r["flat_diff"]) for k, r in top.items()} == {
        ("a", "main"): (8, 3, -1, -2), ("b", "main"): (5, 4, 4, 4), ("", "0x1"): (5, 5, 1, 1)
    }
    assert top["", "0x1"]["binary"] == top["", "0x1"]["file"] == ""
    assert reports.top_functions(profile).count() == 2
    nodes = reports.flamegraph(profile, places=True)
    roots = {r["binary"]: (r["cumulative"], r["cumulative_diff"]) for r in nodes.where("depth = 0").collect()}
    assert roots == {"/bin/a": (8, -1), "/bin/b": (4, 4)}
    assert [r["left"] for r in layout.flamegraph_layout(nodes).where("depth = 0").orderBy("record").collect()] in ([0, 8], [0, 4])
    edges = reports.callgraph_edges(profile, places=True).collect()
    assert {(e["caller"]["build_id"], e["callee"]["build_id"]): (e["cumulative"], e["cumulative_diff"]) for e in edges} == {
        ("a", ""): (5, 1), ("a", "a"): (2, -2), ("a", "b"): (1, 0), ("b", "a"): (1, 0)
    }
    # At half the total only the first binary's function is left, and edges jump over the other's.
    trimmed = reports.callgraph_edges(profile, 50.0, places=True).collect()
    assert {(e["caller"]["build_id"], e["callee"]["build_id"], e["is_collapsed"]): e["cumulative"] for e in trimmed} == {
        ("a", "a", False): 2, ("a", "a", True): 1
    }


def test_fields_that_differ_only_in_their_borders_are_two_nodes(spark):
    stacks = [([(1, 0, 0, 0, binary, "", [(1, name, name, "", 0)])], 1) for binary, name in [("a|1|b", "c"), ("a", "b|1|c"), ("a", "b")]]
    profile = spark.createDataFrame(stacks, f"stacktrace array<{FRAME.simpleString()}>, value long")
    assert reports.flamegraph(profile, places=True).select("node_id").distinct().count() == 3


def test_group_by_label_of_a_map(spark, rows):
    grouped = reports.flamegraph(fx.team_samples(spark, SF), group_by=["labels.team"]).where("depth = 0")
    assert {r["name"] for r in grouped.collect()} == {"", "odd", "even"}
    assert grouped.agg(F.sum("cumulative")).first()[0] == rows.agg(F.sum("value")).first()[0]
    with pytest.raises(ValueError, match="unknown label"):
        reports.flamegraph(rows, group_by=["labels.team"])


def test_unsymbolized_frames_show_their_address(spark):
    df = spark.createDataFrame([([(-16, 0, 0, 0, "", "", [])], 5)], f"stacktrace array<{FRAME.simpleString()}>, value long")
    assert reports.top_functions(df).first()["function"] == "0xfffffffffffffff0"


def test_empty_input(rows):
    none = rows.where("false")
    assert reports.flamegraph(none).count() == reports.top_functions(none).count() == reports.callgraph_edges(none).count() == 0
    assert discovery.label_names(none).count() == 0
    assert select.single_profile(rows, fx.CPU, 1).count() == 0
    with pytest.raises(LookupError):
        select.single_profile(rows, fx.CPU, 1, require_rows=True)


def test_range_limit_and_diff_of_nothing(rows):
    assert timeseries.profiles_in_range(rows, None, *fx.ALL_TIME, limit=7).count() == 7
    diff = select.diff_profile(rows, F.lit(False), F.col("`labels.arch`") == "x86_64", absolute=False)
    assert diff.where("diff <> value").count() == 0 and diff.count() > 0


def test_time_and_labels_reach_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    rows.withColumn("date", F.trunc("date", "year")).repartition("date").write.partitionBy("date").parquet(path)
    stored = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = select.merge_profile(stored, fx.CPU, 852076800000, 883612799999)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    for pushed in ("EqualTo(`labels.arch`", "EqualTo(name", "GreaterThanOrEqual(timestamp"):
        assert pushed.replace("`", "") in plan.replace("`", "")


def test_pages_cover_all(spark):
    locations = spark.createDataFrame(
        [(f"{i:03d}", i + 1, "b", []) for i in range(10)],
        f"id string, address long, mapping_build_id string, lines {FRAME['lines'].dataType.simpleString()}",
    )
    seen, key = [], ""
    while page := metastore.unsymbolized_page(locations, 4, key).collect():
        seen += [r["id"] for r in page]
        key = page[-1]["id"]
    assert seen == [f"{i:03d}" for i in range(10)]


def test_get_or_create_is_stable(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "name string, n int")
    first = metastore.get_or_create(df, spark.createDataFrame([], "id string"), ["name", "n"])
    assert first.where("created").count() == 2
    again = metastore.get_or_create(df, first, ["name", "n"])
    assert again.where("created").count() == 0 and again.count() == 2


def test_unknown_state(spark):
    with pytest.raises(ValueError):
        targets_by_state(spark.range(1), "gone")
