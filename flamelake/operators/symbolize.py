"""Symbolisation: raw frame addresses to functions, files and lines, as joins.

Addresses are made distinct before any lookup, so each (binary, address) is
resolved once however many stacks hold it; the result is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.functions import u64
from flamelake.functions.demangle import demangled_names
from flamelake.functions.frames import stacktrace_id
from flamelake.functions.skew import skew_join
from flamelake.functions.workdir import stage
from flamelake.operators.addresses import OK, normalize_addresses
from flamelake.operators.asof import asof_lookup
from flamelake.operators.segments import disjoint_segments
from flamelake.schema import LINE, STACKTRACE

PROBE = ("build_id", "mapping_start", "mapping_limit", "mapping_offset", "address")

# Suffix of procedure-linkage stubs, and their unknown file.
PLT_SUFFIX = "@plt"
UNKNOWN_FILE = "?"

# Codes of where debug information comes from and how far its upload is.
SOURCE_UPLOAD, SOURCE_DEBUGINFOD = 1, 2
STATE_UPLOADING, STATE_UPLOADED = 1, 2

_LINES = f"array<{LINE.simpleString()}>"


def needs_symbols(frame: Column) -> Column:
    """Frame with an address and a build id but no lines yet."""
    return (
        (F.coalesce(frame["address"], F.lit(0)) != 0)
        & (F.coalesce(frame["mapping_build_id"], F.lit("")) != "")
        & (F.size(F.coalesce(frame["lines"], F.array())) == 0)
    )


def unresolved_addresses(stacks: DataFrame) -> DataFrame:
    """Distinct (build id, mapping, address) of the frames that need symbols."""
    return (
        stacks.select(F.explode(F.filter("stacktrace", needs_symbols)).alias("f"))
        .select(
            F.col("f.mapping_build_id").alias("build_id"),
            "f.mapping_start",
            "f.mapping_limit",
            "f.mapping_offset",
            "f.address",
        )
        .distinct()
    )


def symbol_table(symtab: DataFrame, dynsym: DataFrame, plt: DataFrame) -> DataFrame:
    """Union of three ``(build_id, address, name)`` tables, one name per address.

    Equal addresses prefer the symbol table, then the dynamic table, then the
    stubs, then the smallest name.
    """
    ranked = [
        table.select("build_id", "address", F.struct(F.lit(rank).alias("rank"), name.alias("name")).alias("best"))
        for rank, (table, name) in enumerate(
            [
                (symtab, F.col("name")),
                (dynsym, F.col("name")),
                (plt, F.concat(F.col("name"), F.lit(PLT_SUFFIX))),
            ]
        )
    ]
    return (
        ranked[0]
        .unionByName(ranked[1])
        .unionByName(ranked[2])
        .groupBy("build_id", "address")
        .agg(F.min("best").alias("best"))
        .select("build_id", "address", F.col("best.name").alias("name"))
    )


def closest_symbols(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per distinct (build id, address) the symbol with the greatest address at or below it."""
    key = u64.order_key(F.col("address"))
    found = asof_lookup(
        probes.select("build_id", key.alias("key")),
        symbols.select("build_id", key.alias("key"), F.col("name").alias("symbol")),
        ["build_id"],
        "key",
        ["symbol"],
    )
    return found.select(
        "build_id",
        u64.order_key(F.col("key")).alias("address"),
        u64.order_key(F.col("matched_key")).alias("symbol_address"),
        "symbol",
    )


def symbol_lines(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Line rows from the closest symbol; the stub suffix is put back after demangling."""
    hits = closest_symbols(probes, symbols).where("symbol is not null")
    stub = F.col("symbol").endswith(PLT_SUFFIX)
    return hits.select(
        "build_id",
        "address",
        F.lit(0).alias("depth"),
        F.lit(0).cast("bigint").alias("line"),
        F.when(stub, F.regexp_replace("symbol", PLT_SUFFIX + "$", "")).otherwise(F.col("symbol")).alias("system_name"),
        F.lit(UNKNOWN_FILE).alias("filename"),
        F.lit(0).cast("bigint").alias("start_line"),
        F.when(stub, PLT_SUFFIX).otherwise("").alias("suffix"),
    )


def line_segments(line_ranges: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``(build_id, key, lines)``: ranges flattened once, for any number of lookups.

    ``line_ranges`` is ``(build_id, low, high, depth, line, system_name, filename)``; depth 0 is the
    innermost inlined function.  Rows that lack a line, a name or a file are
    left out.  ``key`` is the order key of a segment's first address.
    """
    complete = line_ranges.where("line is not null and system_name is not null and filename is not null").select(
        "build_id",
        u64.order_key(F.col("low")).alias("low"),
        u64.order_key(F.col("high")).alias("high"),
        "depth",
        F.col("line").cast("bigint").alias("line"),
        "system_name",
        "filename",
        F.col("line").cast("bigint").alias("start_line"),
    )
    # Rows of ranges, not of samples: names are joined before the lookups multiply them.
    named = complete.join(demangled_names(complete, dictionary), "system_name", "left").withColumnRenamed("name", "function_name")
    segments = disjoint_segments(named, ["build_id"], _line_entry())
    return stage(segments.select("build_id", F.col("start").alias("key"), _without_depth("entries").alias("lines")), "line-segments")


def segment_lines(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """``(build_id, address, lines)`` of each distinct address that a segment covers."""
    points = probes.select("build_id", u64.order_key(F.col("address")).alias("key"))
    found = asof_lookup(points, segments, ["build_id"], "key", ["lines"])
    return found.where(F.size("lines") > 0).select("build_id", u64.order_key(F.col("key")).alias("address"), "lines")


def named_lines(rows: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Add the readable ``function_name``, demangling each distinct system name once."""
    names = demangled_names(rows, dictionary)
    return skew_join(rows, names, ["system_name"], "left").withColumn("function_name", F.concat("name", "suffix"))


def _line_entry() -> Column:
    return F.struct(
        "depth",
        "line",
        "function_name",
        F.col("system_name").alias("function_system_name"),
        F.col("filename").alias("function_filename"),
        F.col("start_line").alias("function_start_line"),
    )


def _without_depth(entries: str) -> Column:
    return F.transform(entries, lambda e: e.dropFields("depth")).cast(_LINES)


def collect_lines(rows: DataFrame) -> DataFrame:
    """``lines`` of each (build id, address), innermost first; as long as the inlining is deep."""
    return (
        rows.groupBy("build_id", "address")
        .agg(F.sort_array(F.collect_list(_line_entry())).alias("entries"))
        .select("build_id", "address", _without_depth("entries").alias("lines"))
    )


def resolver_choice(catalog: DataFrame) -> DataFrame:
    """Per catalog row: quality and source gates, then which resolver serves it.

    ``catalog(build_id, source, upload_state, quality)`` where quality is null or
    a struct of ``not_valid_elf, has_dwarf, has_go_pclntab, has_symtab, has_dynsym``.
    """
    quality = F.col("quality")
    symbols = quality["has_symtab"] | quality["has_dynsym"]
    uploaded = (F.col("source") == SOURCE_UPLOAD) & (F.col("upload_state") == STATE_UPLOADED)
    return catalog.withColumn(
        "resolver",
        F.when(quality["not_valid_elf"], "error: not a valid ELF file")
        .when(
            ~(quality["has_dwarf"] | quality["has_go_pclntab"] | symbols),
            "error: no usable debug information",
        )
        .when(
            (F.col("source") == SOURCE_UPLOAD) & ~F.coalesce(uploaded, F.lit(False)),
            "error: not uploaded yet",
        )
        .when(~F.col("source").isin(SOURCE_UPLOAD, SOURCE_DEBUGINFOD), "error: unsupported source")
        .when(quality.isNull(), "error: no quality")
        .when(quality["has_dwarf"], "line ranges")
        .when(symbols, "symbols")
        .otherwise("error: no resolver"),
    )


def resolve_addresses(
    probes: DataFrame,
    segments: DataFrame,
    catalog: DataFrame,
    symbols: DataFrame,
    line_ranges: DataFrame,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """``PROBE`` columns with ``status`` and ``lines`` (null when unresolved)."""
    choice = resolver_choice(catalog).select("build_id", "resolver")
    placed = normalize_addresses(probes, segments).join(choice, "build_id", "left")
    gate = F.coalesce("resolver", F.lit("error: debug information not found"))
    usable = gate.isin("line ranges", "symbols") & (F.col("status") == OK)
    placed = stage(
        placed.withColumn("resolver", gate).withColumn("normalized", F.when(usable, F.col("normalized"))),
        "placed-addresses",
    )
    target = placed.where("normalized is not null").select(
        "build_id", F.col("normalized").alias("address"), "resolver"
    )
    rows = stage(symbol_lines(target.where("resolver = 'symbols'"), symbols), "resolved-rows")
    ranged = segment_lines(target.where("resolver = 'line ranges'"), line_segments(line_ranges, dictionary))
    # A binary has one resolver, so no address is in both.
    lines = collect_lines(named_lines(rows, dictionary)).unionByName(ranged).withColumnRenamed("address", "normalized")
    status = (
        F.when(F.col("resolver").startswith("error"), F.col("resolver"))
        .when(F.col("status") != OK, F.concat(F.lit("error: "), F.col("status")))
        .when(F.col("lines").isNull(), "error: no symbol")
        .otherwise("ok")
    )
    return skew_join(placed, lines, ["build_id", "normalized"], "left").select(
        *PROBE, status.alias("status"), "lines"
    )


def attach_lines(stacks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Put resolved lines back into the frames, keeping order, addresses and present lines.

    Only what is looked up moves: of a distinct stack the places and addresses of the frames that need lines, and back
    the lines found; the frames stay in the rows.
    """
    identified = stacks.withColumn(
        "_stack", F.col("stacktrace_id") if "stacktrace_id" in stacks.columns else F.unhex(stacktrace_id())
    )
    asked = F.filter(
        F.transform(
            "stacktrace",
            lambda frame, i: F.when(
                needs_symbols(frame),
                F.struct(
                    i.alias("pos"),
                    *[frame["mapping_build_id" if c == "build_id" else c].alias(c) for c in PROBE],
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    distinct = identified.select("_stack", asked.alias("asked")).where("size(asked) > 0 and _stack is not null").distinct()
    keyed = stage(distinct, "asked", compression="zstd").select("_stack", F.inline("asked"))
    found = resolved.where("lines is not null").select(*PROBE, F.col("lines").alias("_lines"))
    filled = (
        skew_join(keyed, found, list(PROBE))
        .groupBy("_stack")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "_lines"))).alias("_found"))
    )
    # A place has one entry, unless ``resolved`` has an address twice: then its frame stands there as often.
    once = F.size(F.array_distinct(F.col("_found.pos"))) == F.size("_found")
    with_lines = lambda frame, lines: frame.withField("lines", F.coalesce(lines, frame["lines"]))
    by_place = F.transform(
        F.array(F.map_from_entries("_found")),
        lambda found: F.transform("stacktrace", lambda frame, i: with_lines(frame, F.try_element_at(found, i))),
    )[0]
    repeated = F.flatten(
        F.transform(
            "stacktrace",
            lambda frame, i: F.when(
                F.array_contains(F.col("_found.pos"), i),
                F.transform(F.filter("_found", lambda x: x["pos"] == i), lambda x: with_lines(frame, x["_lines"])),
            ).otherwise(F.array(frame)),
        )
    )
    frames = F.when(F.col("_found").isNull(), F.col("stacktrace")).when(once, by_place.cast(STACKTRACE)).otherwise(repeated.cast(STACKTRACE))
    return identified.join(filled, "_stack", "left").withColumn("stacktrace", frames).select(*stacks.columns)


def symbolize(
    stacks: DataFrame,
    segments: DataFrame,
    catalog: DataFrame,
    symbols: DataFrame,
    line_ranges: DataFrame,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Symbolise the frames of every row's ``stacktrace``; the rows are evaluated once and written."""
    stacks = stage(stacks, "stacks")
    resolved = resolve_addresses(
        unresolved_addresses(stacks), segments, catalog, symbols, line_ranges, dictionary
    )
    return attach_lines(stacks, resolved)
