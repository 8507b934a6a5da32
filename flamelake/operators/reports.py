"""Top table, flame graph, call graph and source report over a profile.

Input is a profile ``(stacktrace, value[, diff])``.  It is first summed per
list of function names, the smallest form that still answers the question, and
only then expanded to functions, tree nodes or edges.

A function is its name, or with ``places`` its name in a binary and a file, so
that functions of one name in two binaries stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.functions.frames import function_names, function_places
from flamelake.plans.selector import label_column
from flamelake.schema import quoted


def _measures(profile: DataFrame) -> list[str]:
    return [c for c in ("value", "diff") if c in profile.columns]


def _group(profile: DataFrame, field: str) -> Column:
    """A column, or a label that has none and is kept in the label maps."""
    if field in profile.columns:
        return F.col(quoted(field))
    return label_column(field.removeprefix("labels."), profile.columns)


def by_function_names(profile: DataFrame, group_by: Sequence[str] = (), places: bool = False) -> DataFrame:
    """Sum a profile (or samples) per list of function names, or of functions with their places."""
    names = function_places() if places else function_names()
    keys = [_group(profile, field).alias(f"group_{i}") for i, field in enumerate(group_by)]
    return profile.groupBy(names.alias("names"), *keys).agg(*[F.sum(c).alias(c) for c in _measures(profile)])


def _sums(profile: DataFrame, own: Column) -> list[Column]:
    sums = [
        F.sum("value").alias("cumulative"),
        F.sum(F.when(own, F.col("value")).otherwise(F.lit(0))).alias("flat"),
    ]
    if "diff" in profile.columns:
        sums += [
            F.sum("diff").alias("cumulative_diff"),
            F.sum(F.when(own, F.col("diff")).otherwise(F.lit(0))).alias("flat_diff"),
        ]
    return sums


def top_functions(profile: DataFrame, places: bool = False) -> DataFrame:
    """Per function: value of stacks that hold it (recursion counts once) and value of its leaves.

    With ``places``, ``build_id``, ``binary`` and ``file`` are columns beside ``function``.
    """
    rows = _top(profile, places)
    if not places:
        return rows
    sums = [c for c in rows.columns if c != "function"]
    return rows.select("function.*", *sums).withColumnRenamed("name", "function")


def _top(profile: DataFrame, places: bool) -> DataFrame:
    stacks = by_function_names(profile, places=places)
    return (
        stacks.where(F.size("names") > 0)
        .select(
            F.explode_outer(F.array_distinct("names")).alias("function"),
            F.get("names", F.lit(0)).alias("leaf"),
            *_measures(stacks),
        )
        .groupBy("function")
        .agg(*_sums(stacks, F.col("function") == F.col("leaf")))
    )


def _identity(function: Column, places: bool) -> Column:
    """Text of a function; with places, fields behind their lengths, so that no two functions share one."""
    if not places:
        return function
    fields = [function[c] for c in ("build_id", "binary", "name", "file")]
    return F.concat_ws("|", *[part for f in fields for part in (F.length(f).cast("string"), f)])


def flamegraph(
    profile: DataFrame, group_by: Sequence[str] = (), invert: bool = False, places: bool = False
) -> DataFrame:
    """Tree nodes, one per path from the root (from the leaf when inverted).

    A node id is the running digest of the path, so it needs no path array, no
    numbering pass and no self join; the parent id comes with it.  Nodes shared
    by many stacks are summed in partial aggregates before the shuffle.  With
    ``places``, nodes have ``build_id``, ``binary`` and ``file`` too.

    ``group_by`` puts a node a group above the functions, for columns and for
    labels of the label maps; as in selectors of label sets, an empty label is no
    label, so a missing one and an empty one are one group.
    """
    stacks = by_function_names(profile, group_by, places)
    path = F.col("names") if invert else F.reverse("names")
    if group_by:
        groups = [F.coalesce(F.col(f"group_{i}").cast("string"), F.lit("")) for i in range(len(group_by))]
        if places:
            nowhere = [F.lit("").alias(c) for c in ("build_id", "binary", "file")]
            groups = [F.struct(*nowhere[:2], g.alias("name"), nowhere[2]) for g in groups]
        path = F.concat(F.array(*groups), path)
    function = "struct<build_id:string,binary:string,name:string,file:string>" if places else "string"
    none = F.expr(f"cast(array() as array<struct<node_id:string,parent_id:string,name:{function}>>)")

    def step(nodes: Column, name: Column) -> Column:
        parent = F.coalesce(F.get(nodes, F.size(nodes) - 1)["node_id"], F.lit(""))
        node = F.struct(
            F.md5(F.concat(parent, F.lit("|"), _identity(name, places))).alias("node_id"),
            parent.alias("parent_id"),
            name.alias("name"),
        )
        return F.array_append(nodes, node)

    measures = _measures(stacks)
    sized = stacks.select(path.alias("path"), F.size(path).alias("length"), *measures).where("length > 0")
    # The outer form spares the planner's not-empty filter, which would evaluate
    # the digests again; empty paths are already gone.
    rows = sized.select(
        F.posexplode_outer(F.aggregate("path", none, step)).alias("depth", "node"), "length", *measures
    )
    nodes = (
        rows.select("depth", "node.*", (F.col("depth") + 1 == F.col("length")).alias("own"), *measures)
        .groupBy("node_id", "parent_id", "depth", "name")
        .agg(*_sums(stacks, F.col("own")))
    )
    if not places:
        return nodes
    sums = [c for c in nodes.columns if c not in ("node_id", "parent_id", "depth", "name")]
    return nodes.select("node_id", "parent_id", "depth", "name.*", *sums)


def trim_flamegraph(nodes: DataFrame, threshold_percent: float) -> DataFrame:
    """Drop nodes below a share of the total; a child never exceeds its parent, so subtrees go whole."""
    total = nodes.where("depth = 0").agg(F.sum("cumulative").alias("total")).scalar()
    share = F.col("cumulative").cast("double") * 100
    return nodes.where(share >= F.lit(float(threshold_percent)) * total)


def flamegraph_summary(nodes: DataFrame, threshold_percent: float = 0.0) -> DataFrame:
    """One row: total, height and the value lost to trimming.

    Each stack is lost exactly when its last node is removed, so the lost value
    is the total minus the own values of the kept nodes; no parent join.
    """
    total = nodes.where("depth = 0").agg(F.sum("cumulative").alias("total")).scalar()
    kept = F.col("cumulative").cast("double") * 100 >= F.lit(float(threshold_percent)) * total
    return nodes.agg(
        F.sum(F.when(F.col("depth") == 0, F.col("cumulative"))).alias("total"),
        F.max(F.when(kept, F.col("depth") + 1)).alias("height"),
        F.sum(F.when(kept, F.lit(0)).otherwise(F.col("flat"))).alias("trimmed"),
    )


def callgraph_nodes(profile: DataFrame, threshold_percent: float = 0.0, places: bool = False) -> DataFrame:
    """Functions of the call graph with cumulative and own value."""
    nodes = _callgraph_nodes(profile, threshold_percent, places)
    if not places:
        return nodes
    return nodes.select("name.*", *[c for c in nodes.columns if c != "name"])


def _callgraph_nodes(profile: DataFrame, threshold_percent: float, places: bool) -> DataFrame:
    nodes = _top(profile, places).withColumnRenamed("function", "name")
    if threshold_percent <= 0:
        return nodes
    total = profile.where(F.size("stacktrace") > 0).agg(F.sum("value").alias("total")).scalar()
    return nodes.where(F.col("cumulative").cast("double") * 100 >= F.lit(float(threshold_percent)) * total)


def _edges(stacks: DataFrame) -> DataFrame:
    """Sum caller/callee pairs of ``frames`` (leaf first structs of pos, name), once per stack."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("frames") - 1),
        lambda i: F.struct(
            F.get("frames", i)["name"].alias("caller"),
            F.get("frames", i - 1)["name"].alias("callee"),
            (F.get("frames", i)["pos"] - F.get("frames", i - 1)["pos"] > 1).alias("is_collapsed"),
        ),
    )
    names = {"value": "cumulative", "diff": "cumulative_diff"}
    return (
        stacks.where(F.size("frames") > 1)
        .select(F.explode_outer(F.array_distinct(pairs)).alias("edge"), *_measures(stacks))
        .groupBy("edge.caller", "edge.callee", "edge.is_collapsed")
        .agg(*[F.sum(c).alias(names[c]) for c in _measures(stacks)])
    )


def callgraph_edges(profile: DataFrame, threshold_percent: float = 0.0, places: bool = False) -> DataFrame:
    """Caller/callee edges; an edge that bridges trimmed functions is collapsed.

    A diff adds ``cumulative_diff``.  With ``places``, ``caller`` and ``callee`` are
    structs ``(build_id, binary, name, file)``.

    Trimming joins the frames with the kept functions.  That side is planned by
    its size at run time: broadcast below the session's limit, else a shuffle
    join whose skewed partitions (a root function is in every stack) are split.
    """
    stacks = by_function_names(profile, places=places).where(F.size("names") > 0)
    measures = _measures(stacks)
    if threshold_percent <= 0:
        numbered = F.transform("names", lambda name, i: F.struct(i.alias("pos"), name.alias("name")))
        return _edges(stacks.select(numbered.alias("frames"), *measures))
    kept = _callgraph_nodes(profile, threshold_percent, places).select("name")
    frames = stacks.select(
        F.sha2(F.to_json("names"), 256).alias("stack"), *measures, F.posexplode("names").alias("pos", "name")
    ).join(kept, "name", "left_semi")
    # One group is one stack, so the collected list is no longer than the stack is deep.
    relinked = frames.groupBy("stack", *measures).agg(
        F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("frames")
    )
    return _edges(relinked)


def source_report(profile: DataFrame, build_id: str | None = None, filename: str | None = None) -> DataFrame:
    """Own and cumulative value per source line of one file of one binary (or of all)."""

    def places(frame: Column) -> Column:
        return F.transform(
            F.coalesce(frame["lines"], F.array()),
            lambda line: F.struct(
                frame["mapping_build_id"].alias("build_id"),
                line["function_filename"].alias("filename"),
                line["line"].alias("line"),
            ),
        )

    rows = profile.select(
        F.explode_outer(F.array_distinct(F.flatten(F.transform("stacktrace", places)))).alias("place"),
        F.get(places(F.get("stacktrace", F.lit(0))), F.lit(0)).alias("leaf"),
        *_measures(profile),
    ).where("place is not null")
    if build_id is not None:
        rows = rows.where(F.col("place.build_id") == build_id)
    if filename is not None:
        rows = rows.where(F.col("place.filename") == filename)
    own = F.coalesce(F.col("place") == F.col("leaf"), F.lit(False))
    return (
        rows.withColumn("own", own)
        .groupBy("place.build_id", "place.filename", "place.line")
        .agg(*_sums(profile, F.col("own")))
    )
