"""Registered queries: each reads whole tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable

import fixtures as fx
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flamelake.functions.frames import function_names, joined
from flamelake.functions.workdir import fresh_path, stage
from flamelake.functions.demangle import demangle
from flamelake.operators import (
    addresses,
    catalog,
    discovery,
    layout,
    metastore,
    normalize,
    report,
    reports,
    select,
    status,
    symbolize,
    timeseries,
)
from flamelake.schema import LABEL_COLUMNS, SAMPLES
from flamelake.sources import dictionary, labelindex, pprof, store
from flamelake.streaming import ingest, lifecycle, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MONTH_MS = 30 * 24 * 3600 * 1000


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def shown(profile: DataFrame) -> DataFrame:
    """A profile as scalars: the stack as text and the address of its leaf."""
    measures = [c for c in ("value", "diff") if c in profile.columns]
    return profile.select(
        joined(function_names()).alias("stack"),
        F.col("stacktrace")[0]["address"].alias("leaf_address"),
        *measures,
    )


def plain_labels(df: DataFrame) -> DataFrame:
    """Drop the label columns the fixture leaves empty and the prefix of the others."""
    used = {"labels.node": "node", "labels.pod": "pod", "labels.arch": "arch"}
    return df.drop(*[c for c in LABEL_COLUMNS if c not in used]).withColumnsRenamed(used)


@register
def single_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.samples(spark, sf)
    busiest = fx.busiest(fx.table(spark, sf, "lineitem").select(fx.epoch_ms("l_shipdate").alias("timestamp")))
    return shown(select.single_profile(rows, fx.CPU, busiest))


@register
def merge_profile(spark: SparkSession, sf: str) -> DataFrame:
    return shown(select.merge_profile(fx.samples(spark, sf), fx.CPU, *fx.ALL_TIME))


@register
def query_range(spark: SparkSession, sf: str) -> DataFrame:
    return plain_labels(timeseries.query_range(fx.samples(spark, sf), fx.CPU, *fx.ALL_TIME, MONTH_MS))


@register
def query_range_sum_by(spark: SparkSession, sf: str) -> DataFrame:
    return plain_labels(
        timeseries.query_range(fx.samples(spark, sf), None, *fx.ALL_TIME, MONTH_MS, sum_by=["labels.node"])
    )


@register
def query_range_limit(spark: SparkSession, sf: str) -> DataFrame:
    return plain_labels(
        timeseries.query_range(
            fx.samples(spark, sf), None, *fx.ALL_TIME, MONTH_MS, sum_by=["labels.node"], limit=100
        )
    )


@register
def profile_types(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.profile_types(fx.samples(spark, sf))


@register
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.label_names(fx.samples(spark, sf))


@register
def label_values(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.label_values(fx.samples(spark, sf), "node")


@register
def label_values_of_map(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.label_values(fx.team_samples(spark, sf), "team")


@register
def label_values_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Values of all labels from an index kept over three batches, of which one comes twice."""
    index, rows = fresh_path(spark, "labels"), fx.team_samples(spark, sf)
    year = F.year("date")
    batches = (year < 1994, (year >= 1994) & (year < 1997), year >= 1997)
    for number in (0, 1, 1, 2):
        labelindex.write(rows.where(batches[number]), index, number)
    return labelindex.totals(labelindex.read(spark, index)).withColumnsRenamed({"label": "label_name", "value": "label_value"})


@register
def query_range_map_labels(spark: SparkSession, sf: str) -> DataFrame:
    series = timeseries.query_range(fx.team_samples(spark, sf), fx.TEAM_CPU, *fx.ALL_TIME, MONTH_MS, sum_by=["team", "labels.node"])
    return plain_labels(series).withColumnRenamed("labels.team", "team")


@register
def profile_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.profile_metadata(fx.samples(spark, sf))


@register
def top_functions(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_functions(fx.samples(spark, sf))


@register
def flamegraph(spark: SparkSession, sf: str) -> DataFrame:
    return reports.flamegraph(fx.samples(spark, sf))


@register
def flamegraph_inverted(spark: SparkSession, sf: str) -> DataFrame:
    return reports.flamegraph(fx.samples(spark, sf), invert=True)


@register
def flamegraph_layout(spark: SparkSession, sf: str) -> DataFrame:
    placed = layout.flamegraph_layout(reports.flamegraph(fx.samples(spark, sf)))
    return placed.withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@register
def flamegraph_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return reports.trim_flamegraph(reports.flamegraph(fx.samples(spark, sf)), 0.5)


@register
def flamegraph_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.flamegraph_summary(reports.flamegraph(fx.samples(spark, sf)), 0.5)


@register
def flamegraph_group_by(spark: SparkSession, sf: str) -> DataFrame:
    return reports.flamegraph(fx.samples(spark, sf), group_by=["labels.arch", "labels.pod"])


@register
def callgraph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.callgraph_nodes(fx.samples(spark, sf))


@register
def callgraph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return reports.callgraph_edges(fx.samples(spark, sf))


@register
def callgraph_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return reports.callgraph_edges(fx.samples(spark, sf), 4.0)


def _diff(spark: SparkSession, sf: str, absolute: bool) -> DataFrame:
    arch = F.col("`labels.arch`")
    return shown(
        select.diff_profile(fx.samples(spark, sf), arch == "aarch64", arch == "x86_64", absolute=absolute)
    )


@register
def diff_absolute(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf, True)


@register
def diff_relative(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf, False)


def _cpu_diff(spark: SparkSession, sf: str) -> DataFrame:
    """One profile type on two architectures, relative to their totals."""
    arch = F.col("`labels.arch`")
    rows = fx.samples(spark, sf).where("name = 'process_cpu'")
    return select.diff_profile(rows, arch == "aarch64", arch == "x86_64", absolute=False)


@register
def top_diff(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_functions(_cpu_diff(spark, sf))


@register
def flamegraph_diff(spark: SparkSession, sf: str) -> DataFrame:
    return reports.flamegraph(_cpu_diff(spark, sf))


@register
def top_places(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_functions(_cpu_diff(spark, sf), places=True)


@register
def flamegraph_places(spark: SparkSession, sf: str) -> DataFrame:
    return reports.flamegraph(_cpu_diff(spark, sf), places=True)


@register
def flamegraph_group_by_map_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.team_samples(spark, sf).where("name = 'process_cpu'")
    return reports.flamegraph(rows, group_by=["labels.team", "sample_type"], places=True)


def _edge_ends(edges: DataFrame) -> DataFrame:
    ends = [F.col(f"{end}.{field}").alias(f"{end}_{field}") for end in ("caller", "callee") for field in ("build_id", "binary", "name", "file")]
    return edges.select(*ends, *[c for c in edges.columns if c not in ("caller", "callee")])


@register
def callgraph_places(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_ends(reports.callgraph_edges(_cpu_diff(spark, sf), places=True))


@register
def callgraph_places_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_ends(reports.callgraph_edges(_cpu_diff(spark, sf), 4.0, places=True))


@register
def source_lines_diff(spark: SparkSession, sf: str) -> DataFrame:
    return reports.source_report(_cpu_diff(spark, sf))


@register
def stack_filter(spark: SparkSession, sf: str) -> DataFrame:
    return shown(select.stack_filter(select.aggregate_stacks(fx.samples(spark, sf)), "WIDGET"))


@register
def frame_filter(spark: SparkSession, sf: str) -> DataFrame:
    return shown(select.frame_filter(select.aggregate_stacks(fx.samples(spark, sf)), ["libbrand.so", "app"]))


@register
def runtime_filter(spark: SparkSession, sf: str) -> DataFrame:
    return shown(select.runtime_filter(select.aggregate_stacks(fx.samples(spark, sf))))


@register
def runtime_interpreted_only(spark: SparkSession, sf: str) -> DataFrame:
    profile = select.aggregate_stacks(fx.samples(spark, sf))
    return shown(select.runtime_filter(profile, show_interpreted_only=True))


@register
def filter_totals(spark: SparkSession, sf: str) -> DataFrame:
    return select.filter_totals(fx.samples(spark, sf), F.col("`labels.pod`") == "A")


@register
def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.source_report(fx.samples(spark, sf))


# --- symbolisation -----------------------------------------------------------


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbolize.symbol_table(*fx.symbol_sources(spark, sf))


@register
def symbol_table(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf)


@register
def symbol_asof(spark: SparkSession, sf: str) -> DataFrame:
    return symbolize.closest_symbols(fx.probes(spark, sf), _symbols(spark, sf))


@register
def normalize_address(spark: SparkSession, sf: str) -> DataFrame:
    return addresses.normalize_addresses(fx.mapped_addresses(spark, sf), fx.supplier_segments(spark, sf))


@register
def line_lookup(spark: SparkSession, sf: str) -> DataFrame:
    segments = symbolize.line_segments(fx.line_ranges(spark, sf), fx.dictionary(spark, sf))
    lines = symbolize.segment_lines(fx.probes(spark, sf), segments)
    return lines.select("build_id", "address", joined_lines("lines").alias("lines"))


def joined_lines(column: str):
    text = F.transform(
        column,
        lambda x: F.concat_ws(":", x["function_name"], x["function_filename"], x["line"].cast("string")),
    )
    return F.array_join(text, ";")


@register
def resolver_choice(spark: SparkSession, sf: str) -> DataFrame:
    return symbolize.resolver_choice(fx.binaries(spark, sf)).select("build_id", "resolver")


@register
def demangle_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.functions(spark, sf).select(
        "p_partkey", F.when(F.col("p_size") > 45, F.lit("given")).alias("name"), "system_name"
    )
    return demangle(rows, fx.dictionary(spark, sf))


def _resolved(spark: SparkSession, sf: str, stacks: DataFrame) -> DataFrame:
    return symbolize.resolve_addresses(
        symbolize.unresolved_addresses(stacks),
        fx.binary_segments(spark, sf),
        fx.binaries(spark, sf),
        _symbols(spark, sf),
        fx.line_ranges(spark, sf),
        fx.dictionary(spark, sf),
    )


@register
def unresolved_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return symbolize.unresolved_addresses(fx.raw_samples(spark, sf))


@register
def resolved_addresses(spark: SparkSession, sf: str) -> DataFrame:
    rows = _resolved(spark, sf, fx.raw_samples(spark, sf))
    return rows.select("build_id", "address", "status", joined_lines("lines").alias("lines"))


@register
def symbolized_stacks(spark: SparkSession, sf: str) -> DataFrame:
    profile = stage(select.aggregate_stacks(fx.raw_samples(spark, sf)), "profile")
    named = symbolize.attach_lines(profile, _resolved(spark, sf, profile))
    return named.select(joined(function_names()).alias("stack"), "value")


# --- catalog -------------------------------------------------------------------


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest(fx.catalog_writes(spark, sf), "written_at", "seq")


def flat_catalog(rows: DataFrame) -> DataFrame:
    return rows.select(
        "build_id",
        "type_key",
        "source",
        F.col("upload.id").alias("upload_id"),
        F.col("upload.hash").alias("hash"),
        F.col("upload.started_at").alias("started_at"),
        F.col("upload.finished_at").alias("finished_at"),
        F.col("upload.state").alias("state"),
        F.col("quality.not_valid_elf").alias("not_valid_elf"),
    )


@register
def catalog_latest(spark: SparkSession, sf: str) -> DataFrame:
    return flat_catalog(_catalog(spark, sf))


def _decisions(spark: SparkSession, sf: str, mode: str, requests: DataFrame | None = None) -> DataFrame:
    return catalog.upload_decisions(
        fx.upload_requests(spark, sf) if requests is None else requests, _catalog(spark, sf), fx.server_index(spark, sf), F.expr(fx.NOW), mode
    )


@register
def upload_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf, "observed").select("build_id", "type", "should_initiate", "reason")


@register
def upload_decision_documented(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf, "documented").select("build_id", "type", "should_initiate", "reason")


@register
def initiate_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.initiate_uploads(_decisions(spark, sf, "observed"), F.expr(fx.NOW))
    return rows.select("build_id", "type", "status", F.col("upload_id").isNotNull().alias("initiated"))


@register
def initiate_same_key(spark: SparkSession, sf: str) -> DataFrame:
    """Several requests of one batch for one catalog key, under types that share it."""
    rows = _decisions(spark, sf, "observed", fx.repeated_requests(spark, sf))
    rows = catalog.initiate_uploads(rows, F.expr(fx.NOW))
    return rows.select("build_id", "type", "hash", "size", "status", F.col("upload_id").isNotNull().alias("initiated"))


@register
def server_availability(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.server_availability(fx.server_index(spark, sf))
    return rows.select("build_id", F.array_join("servers", ",").alias("servers"))


@register
def source_routing(spark: SparkSession, sf: str) -> DataFrame:
    objects = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("upload_id")
    )
    return catalog.source_route(_catalog(spark, sf), objects).select("build_id", "type_key", "route")


@register
def chunk_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.assemble_uploads(fx.document_chunks(spark, sf), part_bytes=4000)
    shown_part = lambda p: F.concat_ws(":", p["offset"].cast("string"), p["digest"])
    return rows.withColumn("parts", F.array_join(F.transform("parts", shown_part), ","))


@register
def upload_streams(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.accept_uploads(*fx.upload_streams(spark, sf), _catalog(spark, sf), part_bytes=40)
    shown_part = lambda p: F.concat_ws(":", p["offset"].cast("string"), p["digest"])
    return rows.withColumn("parts", F.array_join(F.transform("parts", shown_part), ","))


@register
def upload_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = catalog.upload_parts(fx.document_chunks(spark, sf), part_bytes=1500)
    return parts.select("upload_id", "part", "offset", F.sha2("content", 256).alias("digest"))


@register
def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.chunk_offsets(fx.document_chunks(spark, sf))
    return rows.select("upload_id", "seq", "size", "offset", F.md5("chunk").alias("digest"))


@register
def upload_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    events = catalog.keyed_events(fx.lifecycle_events(spark, sf))
    return flat_catalog(catalog.fold_events(events))


@register
def lifecycle_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.event_outcomes(fx.lifecycle_events(spark, sf))


# --- pprof and normalisation ----------------------------------------------------


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    counts = fx.series(spark, sf).select("profile_id", "executables")
    return normalize.valid_messages(fx.messages(spark, sf), counts)


def shown_frames(column: str = "stacktrace"):
    """Every field of every frame as text."""
    line = lambda x: F.concat_ws(
        "|",
        x["line"].cast("string"),
        x["function_name"],
        x["function_system_name"],
        x["function_filename"],
        x["function_start_line"].cast("string"),
    )
    frame = lambda f: F.concat_ws(
        ",",
        f["address"].cast("string"),
        f["mapping_start"].cast("string"),
        f["mapping_limit"].cast("string"),
        f["mapping_offset"].cast("string"),
        f["mapping_file"],
        f["mapping_build_id"],
        F.array_join(F.transform(f["lines"], line), "&"),
    )
    return F.array_join(F.transform(column, frame), ";")


def shown_map(column: str):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@register
def series_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.split_series(fx.series(spark, sf))
    return rows.select("profile_id", "name", shown_map("labels").alias("labels"), "error")


@register
def pprof_violations(spark: SparkSession, sf: str) -> DataFrame:
    counts = fx.series(spark, sf).select("profile_id", "executables")
    return normalize.violations(fx.messages(spark, sf), counts)


@register
def ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Refused blobs, series and profiles of the batch form."""
    return normalize.rejects(fx.messages_with_faults(spark, sf), fx.series(spark, sf))


@register
def sample_explode(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.explode_samples(_valid(spark, sf))


@register
def profile_meta(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.profile_meta(_valid(spark, sf))


@register
def sample_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.sample_labels(_valid(spark, sf))
    return rows.select(
        "profile_id",
        "sample_no",
        shown_map("sample_labels").alias("sample_labels"),
        shown_map("num_labels").alias("num_labels"),
    )


@register
def label_name_collection(spark: SparkSession, sf: str) -> DataFrame:
    series = normalize.split_series(fx.series(spark, sf)).where("error is null")
    return normalize.label_names(_valid(spark, sf), series)


@register
def stack_denormalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.sample_stacks(_valid(spark, sf))
    return rows.select("profile_id", "sample_no", shown_frames().alias("stack"))


@register
def label_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize.split_series(fx.series(spark, sf)).where("error is null")
    return plain_labels(rows.select("profile_id", *normalize.label_columns("labels"))).drop("pod", "arch")


def shown_samples(rows: DataFrame) -> DataFrame:
    return rows.select(
        "name",
        "timestamp",
        "duration",
        "period",
        "period_type",
        "period_unit",
        "sample_type",
        "sample_unit",
        "value",
        shown_frames().alias("stack"),
        F.col("`labels.node`").alias("node"),
        shown_map("series_labels").alias("series_labels"),
        shown_map("sample_labels").alias("sample_labels"),
        shown_map("num_labels").alias("num_labels"),
    )


@register
def normalized_samples(spark: SparkSession, sf: str) -> DataFrame:
    return shown_samples(normalize.normalize(fx.messages(spark, sf), fx.series(spark, sf)))


@register
def pprof_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Encode every profile to a gzipped blob, decode the blobs and normalise them."""
    blobs, staged = fresh_path(spark, "pprof"), fresh_path(spark, "messages")
    pprof.write_pprof(fx.derived_messages(spark, sf), blobs)
    pprof.write_messages(pprof.decode(spark.read.parquet(blobs)), staged)
    return shown_samples(normalize.normalize(pprof.read_messages(spark, staged), fx.series(spark, sf)))


@register
def pprof_parts_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """As ``pprof_roundtrip``, with parts of three messages that different tasks read."""
    blobs, staged = fresh_path(spark, "pprof"), fresh_path(spark, "messages")
    pprof.write_pprof(fx.derived_messages(spark, sf), blobs, part_messages=3)
    pprof.write_messages(pprof.decode(spark.read.parquet(blobs).repartition(8)), staged)
    return shown_samples(normalize.normalize(pprof.read_messages(spark, staged), fx.series(spark, sf)))


# --- reports back to pprof ---------------------------------------------------------


def _report(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    stacks, meta = fx.report_inputs(spark, sf)
    return stage(stacks, "stacks"), stage(meta, "meta")


@register
def string_table(spark: SparkSession, sf: str) -> DataFrame:
    stacks, meta = _report(spark, sf)
    return report.string_table(report.report_strings(report.frames_of(stacks), meta))


@register
def mapping_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.mappings(report.frames_of(_report(spark, sf)[0]))
    return rows.drop("mapping_key")


@register
def function_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.functions(report.frames_of(_report(spark, sf)[0]))
    return rows.drop("function_key")


@register
def location_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.locations(report.frames_of(_report(spark, sf)[0]))
    return rows.select("report_id", "relative", "address", F.size("lines").alias("lines"))


@register
def sample_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.merged_samples(_report(spark, sf)[0])
    return rows.select("report_id", F.size("location_keys").alias("locations"), "value")


@register
def report_export(spark: SparkSession, sf: str) -> DataFrame:
    """All reports as gzipped pprof, read back and normalised."""
    stacks, meta = _report(spark, sf)
    blobs, messages = fresh_path(spark, "reports"), fresh_path(spark, "messages")
    pprof.write_pprof(report.report_messages(stacks, meta), blobs)
    pprof.write_messages(pprof.decode(spark.read.parquet(blobs)), messages)
    name = F.struct(F.lit("__name__").alias("name"), F.col("report_id").alias("value"))
    raw = meta.select(F.col("report_id").alias("profile_id"), F.array(name).alias("labels"))
    rows = normalize.normalize(pprof.read_messages(spark, messages), raw)
    return rows.select(
        F.col("name").alias("report_id"), "timestamp", "sample_type", "period_unit", shown_frames().alias("stack"), "value"
    )


# --- metastore and status -------------------------------------------------------------


def _returned(rows: DataFrame) -> DataFrame:
    return rows.where("`labels.pod` is not null")


def _stacks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All stacks, and those of returned items as the ones already stored."""
    rows = fx.samples(spark, sf)
    return rows.select("stacktrace"), _returned(rows).select("stacktrace")


def _stored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(metastore.content_id(*columns).alias("id")).distinct()


@register
def get_or_create_stacks(spark: SparkSession, sf: str) -> DataFrame:
    wanted, known = _stacks(spark, sf)
    rows = metastore.get_or_create(wanted, _stored(known, ["stacktrace"]), ["stacktrace"])
    return rows.select(shown_frames().alias("stack"), "created")


@register
def get_or_create_functions(spark: SparkSession, sf: str) -> DataFrame:
    wanted, known = (metastore.functions_of(s) for s in _stacks(spark, sf))
    columns = ["start_line", "name", "system_name", "filename"]
    return metastore.get_or_create(wanted, _stored(known, columns), columns).drop("id")


@register
def get_or_create_mappings(spark: SparkSession, sf: str) -> DataFrame:
    wanted, known = (metastore.mappings_of(s) for s in _stacks(spark, sf))
    columns = ["start", "limit", "offset", "file", "build_id"]
    return metastore.get_or_create(wanted, _stored(known, columns), columns).drop("id")


@register
def get_or_create_locations(spark: SparkSession, sf: str) -> DataFrame:
    wanted, known = (metastore.locations_of(s) for s in _stacks(spark, sf))
    columns = wanted.columns
    rows = metastore.get_or_create(wanted, _stored(known, columns), columns)
    return rows.select(
        "address", "mapping_file", "mapping_build_id", F.col("lines")[0]["function_name"].alias("function"), "created"
    )


@register
def unknown_stacks(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.with_stack_ids(fx.samples(spark, sf))
    known = metastore.stacktraces_of(_returned(rows))
    missing = metastore.unknown_stacktraces(rows, known)
    dictionary = metastore.stacktraces_of(rows).distinct()
    return metastore.lookup(dictionary, missing, "stacktrace_id").select(shown_frames().alias("stack"))


def _locations(spark: SparkSession, sf: str) -> DataFrame:
    """Raw locations under a readable key."""
    key = F.concat_ws(":", "mapping_build_id", F.col("address").cast("string"))
    return metastore.locations_of(fx.raw_samples(spark, sf)).distinct().select(key.alias("id"), "*")


@register
def unsymbolized_page(spark: SparkSession, sf: str) -> DataFrame:
    return metastore.unsymbolized_page(_locations(spark, sf), 500, "b2").select("id", "address")


@register
def location_lines(spark: SparkSession, sf: str) -> DataFrame:
    locations = _locations(spark, sf)
    line = F.struct(
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("function_name"),
        F.lit(None).cast("string").alias("function_system_name"),
        F.lit("late.c").alias("function_filename"),
        F.lit(0).cast("bigint").alias("function_start_line"),
    )
    updates = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("blibc:"), F.expr("cast(4194304 + l_suppkey * 12288 + 2500 as string)")).alias("id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.array(line).cast(locations.schema["lines"].dataType).alias("lines"),
    )
    return metastore.create_location_lines(locations, updates).select("id", joined_lines("lines").alias("lines"))


@register
def agents_status(spark: SparkSession, sf: str) -> DataFrame:
    return status.agents_status(fx.pushes(spark, sf), "pushed_at", "event_id")


@register
def targets_by_state(spark: SparkSession, sf: str) -> DataFrame:
    return status.targets_by_state(fx.targets(spark, sf), "active")


@register
def target_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return status.jobs(status.targets_by_state(fx.targets(spark, sf)))


# --- store and streams ------------------------------------------------------------------


@register
def store_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Write samples and their stacks to the store, then merge by stack id over two years."""
    none = F.lit(None)
    rows = fx.with_stack_ids(fx.samples(spark, sf)).select(
        "*",
        *[none.cast(SAMPLES[c].dataType).alias(c) for c in ("series_labels", "sample_labels", "num_labels")],
        F.col("date").alias("ingest_date"),
    )
    # The table spans years with few rows a day, so the folders of this query are years.
    rows = rows.withColumn("date", F.trunc("date", "year"))
    samples_path, stacks_path = fresh_path(spark, "store"), fresh_path(spark, "stacks")
    store.write_samples(rows, samples_path)
    store.write_stacks(rows, stacks_path)
    kept = store.read_samples(spark, samples_path).where("date between '1997-01-01' and '1998-12-31'")
    return shown(select.aggregate_stacks(kept, spark.read.parquet(stacks_path)))


@register
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving pprof files through the micro-batched ingest, read back from the store."""
    blobs, source = fresh_path(spark, "pprof"), fresh_path(spark, "arriving")
    pprof.write_pprof(fx.derived_messages(spark, sf), blobs)
    raw = pprof.joined_files(spark.read.parquet(blobs)).join(fx.series(spark, sf), "profile_id")
    raw.select(*ingest.RAW.names).write.parquet(source)
    target = fresh_path(spark, "store")
    ingest.ingest_stream(
        spark, source, target, fresh_path(spark, "staging"), fresh_path(spark, "checkpoint")
    ).awaitTermination()
    return shown_samples(ingest.read_stream_store(spark, target))


@register
def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The same refusals as the second output of the micro-batched ingest."""
    source, refused = fresh_path(spark, "arriving"), fresh_path(spark, "rejects")
    fx.arriving_blobs(spark, sf).select(*ingest.RAW.names).write.parquet(source)
    ingest.ingest_stream(
        spark, source, fresh_path(spark, "store"), fresh_path(spark, "staging"), fresh_path(spark, "checkpoint"), rejects=refused
    ).awaitTermination()
    return ingest.read_rejects(spark, refused)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = fx.table(spark, sf, "events").schema
    return ingest.file_stream(spark, f"{sf}/events*.parquet", schema, ingest.FILES_PER_BATCH)


@register
def stream_range(spark: SparkSession, sf: str) -> DataFrame:
    out, step = fresh_path(spark, "rollup"), 3_600_000
    ingest.rollup_stream(
        fx.event_samples(_events(spark, sf)), out, fresh_path(spark, "checkpoint"), step, ["type"]
    ).awaitTermination()
    return ingest.read_rollup(spark, out, ["type"], step)


@register
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly sums by type from three loads, of which the later bring late events; the stream is restarted for each."""
    arriving, out, checkpoint = fresh_path(spark, "arriving"), fresh_path(spark, "windows"), fresh_path(spark, "checkpoint")
    events, step, by = fx.table(spark, sf, "events"), 3_600_000, ["type"]
    place = F.col("user_id") % 10
    for arrives in (place < 7, (place >= 7) & (place < 9), place == 9):
        load = fx.event_samples(events.where(arrives))
        load.repartition(ingest.FILES_PER_BATCH).write.mode("append").parquet(arriving)
        stream = ingest.file_stream(spark, arriving, load.schema, ingest.FILES_PER_BATCH)
        windows.write_windows(stream, out, checkpoint, step, "2 hours", by).awaitTermination()
    sums = [windows.read_windows(spark, out, load.schema, by, late).withColumn("late", F.lit(late)) for late in (False, True)]
    return sums[0].unionByName(sums[1])


@register
def stream_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    events, log = fresh_path(spark, "events"), fresh_path(spark, "log")
    rows = fx.lifecycle_events(spark, sf)
    rows.write.parquet(events)
    arriving = ingest.file_stream(spark, events, rows.schema, ingest.FILES_PER_BATCH)
    ingest.lifecycle_stream(arriving, log, fresh_path(spark, "checkpoint")).awaitTermination()
    return flat_catalog(ingest.read_lifecycle(spark, log))


@register
def stream_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to events that arrive in three loads, the stream restarted for each, and stale uploads."""
    events, out, checkpoint = fresh_path(spark, "events"), fresh_path(spark, "outcomes"), fresh_path(spark, "checkpoint")
    rows, files = fx.timed_events(spark, sf), 4
    for first, past in (("1900-01-01", "1994-07-01"), ("1994-07-01", "1996-03-01"), ("1996-03-01", "2100-01-01")):
        load = rows.where((F.col("at") >= first) & (F.col("at") < past))
        load.repartition(files).write.mode("append").parquet(events)
        arriving = ingest.file_stream(spark, events, rows.schema, files)
        lifecycle.write_outcomes(arriving, out, checkpoint, catalog.STALE_MS).awaitTermination()
    return lifecycle.read_outcomes(spark, out)


@register
def stream_unknown_stacks(spark: SparkSession, sf: str) -> DataFrame:
    """Stacks asked for in each of two loads of samples, of which those with a pod bring their stack."""
    rows = fx.with_stack_ids(fx.samples(spark, sf)).select(
        "stacktrace_id", F.when(F.col("`labels.pod`").isNotNull(), F.col("stacktrace")).alias("stacktrace"), "value", "date"
    )
    arriving, requests, stacks, target, checkpoint = (fresh_path(spark, x) for x in ("arriving", "requests", "stacks", "store", "checkpoint"))
    for early in (True, False):
        load = rows.where((F.col("date") < "1995-01-01") == early).drop("date")
        load.repartition(ingest.FILES_PER_BATCH).write.mode("append").parquet(arriving)
        stream = ingest.file_stream(spark, arriving, load.schema, ingest.FILES_PER_BATCH)
        ingest.stacks_stream(stream, stacks, target, requests, checkpoint).awaitTermination()
    known = metastore.stacktraces_of(fx.with_stack_ids(fx.samples(spark, sf))).distinct()
    asked = spark.read.schema("stacktrace_id string, batch bigint").parquet(requests)
    return asked.join(known, "stacktrace_id").select(F.col("batch").cast("bigint").alias("batch"), shown_frames().alias("stack"))


@register
def stored_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The function dictionary after two overlapping loads, the second one twice."""
    columns = ["start_line", "name", "system_name", "filename"]
    wanted, known = (
        metastore.functions_of(s).select(metastore.content_id(*columns).alias("id"), *columns) for s in _stacks(spark, sf)
    )
    path = fresh_path(spark, "functions")
    dictionary.create(spark, path, wanted.schema)
    for load in (known, wanted, wanted):
        dictionary.extend(load, path, wanted.schema)
    dictionary.compact(spark, path, wanted.schema, 1)
    return dictionary.read(spark, path, wanted.schema).select(*columns)
