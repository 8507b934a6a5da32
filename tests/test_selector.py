import pytest

from flamelake.plans.selector import label_equals, parse_selector

WALL = ("wall", "samples", "count", "wall", "nanoseconds")


def test_parts_of_a_selector():
    found = parse_selector("node=berlin-7,arch=riscv64|" + ":".join(WALL))
    assert found.matchers == (("node", "berlin-7"), ("arch", "riscv64"))
    assert found.profile_type == WALL


def test_blanks_around_matchers_are_dropped_and_inside_kept():
    found = parse_selector("\t node=a b , pod=  |  heap:inuse:bytes:space:bytes\n")
    assert found.matchers == (("node", "a b"), ("pod", ""))
    assert found.profile_type == ("heap", "inuse", "bytes", "space", "bytes")


def test_empty_profile_fields_are_values(spark):
    found = parse_selector("node=x|heap::::")
    assert found.profile_type == ("heap", "", "", "", "")


@pytest.mark.parametrize(
    "text",
    [
        "",
        "node=x",
        "node=x|heap:a:b:c:d|",
        "node|heap:a:b:c:d",
        "node=x=y|heap:a:b:c:d",
        "node=x,|heap:a:b:c:d",
        "node=x|heap:a:b:c",
        "node=x|heap:a:b:c:d:e",
    ],
)
def test_malformed_selectors_are_refused(text):
    with pytest.raises(ValueError):
        parse_selector(text)


def test_labels_without_a_column_need_a_label_map(spark):
    rows = spark.createDataFrame(
        [("a", {"team": "search"}), ("b", {}), (None, None)], "`labels.node` string, series_labels map<string,string>"
    )
    assert rows.where(label_equals("team", "search", rows.columns)).count() == 1
    assert rows.where(label_equals("node", "b", rows.columns)).count() == 1
    with pytest.raises(ValueError, match="unknown label"):
        label_equals("team", "search")


def test_missing_label_never_matches(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "`labels.node` string")
    assert df.where(label_equals("node", "a")).count() == 1
    assert df.where(label_equals("node", "")).count() == 1
