"""Inputs of the registered queries, derived from the given tables.

Each function reads whole tables of a scale-factor folder and returns a
DataFrame in one of the library's own schemas.  ``oracles.py`` derives the same
rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flamelake.functions.frames import stacktrace_id
from flamelake.schema import FRAME, LABEL_COLUMNS
from flamelake.functions.workdir import fresh_path
from flamelake.sources.pprof import MESSAGES, joined_files, read_messages, write_messages, write_pprof

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that has fewer files than the session has cores, over all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def epoch_ms(column: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, {column})")


def _frame(name: Column, binary: Column, build: Column, address: Column, line: Column, source: Column) -> Column:
    start = F.lit(4194304).cast("bigint")
    return F.struct(
        address.cast("bigint").alias("address"),
        start.alias("mapping_start"),
        (start + (1 << 40)).alias("mapping_limit"),
        F.lit(0).cast("bigint").alias("mapping_offset"),
        binary.alias("mapping_file"),
        build.alias("mapping_build_id"),
        F.array(
            F.struct(
                line.cast("bigint").alias("line"),
                name.alias("function_name"),
                name.alias("function_system_name"),
                source.alias("function_filename"),
                F.lit(0).cast("bigint").alias("function_start_line"),
            )
        ).alias("lines"),
    ).cast(FRAME)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per line item; the stack is part (unless unreturned), brand, nation, main."""
    joined = (
        spread(table(spark, sf, "lineitem").drop("l_extendedprice", "l_discount", "l_tax", "l_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    leaf = _frame(
        F.col("p_name"),
        F.concat(F.lit("/opt/shop/"), F.lower("p_type")),
        F.concat(F.lit("b"), F.lower("p_type")),
        F.expr("4194304L + cast(conv(substr(md5(concat(p_name, p_type, p_size)), 1, 8), 16, 10) as bigint) * 16L"),
        F.col("p_size"),
        F.concat(F.lower("p_type"), F.lit(".rs")),
    )
    brand = _frame(
        F.col("p_brand"),
        F.lit("/usr/lib/libbrand.so"),
        F.lit("blib"),
        F.expr("4198400 + cast(substr(p_brand, 7) as int) * 64"),
        F.lit(7),
        F.lit("brand.c"),
    )
    nation = _frame(
        F.col("n_name"),
        F.lit("/usr/bin/python3.11"),
        F.lit("bpy"),
        F.lit(4202496) + F.col("n_nationkey") * 16,
        F.col("n_nationkey"),
        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string"), F.lit(".py")),
    )
    main = _frame(F.lit("main"), F.lit("/usr/bin/app"), F.lit("bapp"), F.lit(4206592), F.lit(1), F.lit("main.c"))
    unreturned = F.col("l_returnflag") == "N"
    none = F.array().cast("array<" + FRAME.simpleString() + ">")
    stack = F.concat(
        F.when(unreturned, none).otherwise(F.array(leaf)),
        F.when(F.col("l_linenumber") == 7, F.array(brand, brand)).otherwise(F.array(brand)),
        F.array(nation, main),
    )
    odd = F.col("l_linenumber") % 2 == 1
    labels = {
        "labels.node": F.col("n_name"),
        "labels.pod": F.when(~unreturned, F.col("l_returnflag")),
        "labels.arch": F.when(F.col("l_linestatus") == "O", "x86_64").otherwise("aarch64"),
    }
    timestamp = epoch_ms("l_shipdate")
    return joined.select(
        F.lit(10_000_000_000).cast("bigint").alias("duration"),
        F.when(odd, "process_cpu").otherwise("process_mem").alias("name"),
        F.lit(52631578).cast("bigint").alias("period"),
        F.when(odd, "cpu").otherwise("space").alias("period_type"),
        F.when(odd, "nanoseconds").otherwise("bytes").alias("period_unit"),
        F.when(odd, "samples").otherwise("alloc").alias("sample_type"),
        F.when(odd, "count").otherwise("bytes").alias("sample_unit"),
        stack.alias("stacktrace"),
        timestamp.alias("timestamp"),
        F.col("l_quantity").cast("bigint").alias("value"),
        *[labels.get(c, F.lit(None).cast("string")).alias(c) for c in LABEL_COLUMNS],
        F.expr("cast(l_shipdate as date)").alias("date"),
    )


#: Profiles of one team; the team is a label without a column.
TEAM_CPU = "arch=aarch64,team=odd|process_cpu:samples:count:cpu:nanoseconds"


def team_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples whose series carry a label that has no column: the parity of the month."""
    team = F.when(F.month("date") % 2 == 1, "odd").when(F.month("date") != 12, "even")
    rows = samples(spark, sf)
    return rows.withColumn(
        "series_labels", F.when(team.isNotNull(), F.create_map(F.lit("team"), team)).otherwise(F.expr("map()").cast("map<string,string>"))
    )


def with_stack_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stacktrace_id", stacktrace_id())


def busiest(rows: DataFrame) -> int:
    """Timestamp with the most samples, the earliest of equals: one row comes back."""
    return (
        rows.groupBy("timestamp")
        .count()
        .orderBy(F.desc("count"), F.asc("timestamp"))
        .first()["timestamp"]
    )


CPU = "arch=aarch64|process_cpu:samples:count:cpu:nanoseconds"
CPU_NODE = "arch=aarch64,node=NATION_3|process_cpu:samples:count:cpu:nanoseconds"
ALL_TIME = (0, 4_102_444_800_000)


# --- symbols -----------------------------------------------------------------
# Every part is a function of a binary; a third of the parts sit in one binary.

_BUILD = "case when {k} % 3 = 0 then 'blibc' else concat('b', cast({k} % 11 as string)) end"
# Binary b7 is a kernel: its addresses have the top bit set.
_LOW = "(case when {k} % 3 <> 0 and {k} % 11 = 7 then -2130706432L else 0L end + {k} * 4096L)"
_PLAIN = "replace(p_name, ' ', '_')"
_MANGLED = (
    "concat('_ZN', length(split(p_name, ' ')[0]), split(p_name, ' ')[0], "
    "length(split(p_name, ' ')[1]), split(p_name, ' ')[1], "
    "'17h', substr(md5(cast(p_partkey as string)), 1, 16), 'E')"
)
# The newer form, a crate numbered by part; a generic one refers back to its crate, at place 3.
_NEWER = (
    "concat('NvCs', cast(p_partkey as string), '_', length(split(p_name, ' ')[0]), split(p_name, ' ')[0], "
    "length(split(p_name, ' ')[1]), split(p_name, ' ')[1])"
)
_SYSTEM = (
    f"case when p_size < 10 then concat('_Z', cast(p_partkey as string), 'v') "
    f"when p_size < 20 then {_PLAIN} when p_size < 35 then {_MANGLED} "
    f"when p_size < 40 then concat('_R', {_NEWER}) else concat('_RI', {_NEWER}, 'NtB2_4ItemRShE') end"
)


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """One function per part: binary, lowest address, size class and mangled name."""
    return table(spark, sf, "part").select(
        "p_partkey",
        "p_size",
        "p_type",
        F.expr(_BUILD.format(k="p_partkey")).alias("build_id"),
        F.expr(_LOW.format(k="p_partkey")).alias("low"),
        F.expr(_PLAIN).alias("plain"),
        F.expr(_SYSTEM).alias("system_name"),
    )


def symbol_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbol, dynamic and stub tables; some dynamic symbols share an address with the first."""
    part = functions(spark, sf)
    own = F.col("low") + F.col("p_size") * 32
    return (
        part.select("build_id", own.alias("address"), F.col("system_name").alias("name")),
        part.select(
            "build_id",
            F.when(F.col("p_size") > 25, own).otherwise(F.col("low") + 2048).alias("address"),
            F.concat(F.lit("dyn_"), "plain").alias("name"),
        ),
        part.select("build_id", (F.col("low") + 3000 + F.col("p_size")).alias("address"), F.col("plain").alias("name")),
    )


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Readable names of the functions that are not Rust."""
    return (
        functions(spark, sf)
        .where("p_size < 10")
        .select("system_name", F.concat(F.lit("cpp::"), F.lower("p_type"), F.lit("()")).alias("name"))
    )


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct addresses that line items touch."""
    return (
        table(spark, sf, "lineitem")
        .select(
            F.expr(_BUILD.format(k="l_partkey")).alias("build_id"),
            F.expr(f"{_LOW.format(k='l_partkey')} + l_linenumber * 500L").alias("address"),
        )
        .distinct()
    )


def line_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Nested ranges per part (depth 0 innermost) and one range over each whole binary."""
    part = functions(spark, sf)
    nested = part.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("p_size") % 3))).select(
        "build_id",
        (F.col("low") + (F.col("p_size") % 3 - F.col("depth")) * 256).alias("low"),
        (F.col("low") + 4096 - (F.col("p_size") % 3 - F.col("depth")) * 512).alias("high"),
        "depth",
        (F.col("p_size") + F.col("depth")).cast("bigint").alias("line"),
        "system_name",
        F.when((F.col("depth") == 1) & (F.col("p_size") == 13), F.lit(None))
        .otherwise(F.concat(F.lower("p_type"), F.lit(".rs")))
        .alias("filename"),
    )
    base = F.when(F.col("build_id") == "b7", F.lit(-2130706432)).otherwise(F.lit(0)).cast("bigint")
    units = part.groupBy("build_id").agg(F.max("p_partkey").alias("last")).select(
        "build_id",
        base.alias("low"),
        (base + (F.col("last") + 1) * 4096).alias("high"),
        F.lit(9).alias("depth"),
        F.lit(1).cast("bigint").alias("line"),
        F.concat(F.lit("unit_"), "build_id").alias("system_name"),
        F.lit("unit.c").alias("filename"),
    )
    return nested.unionByName(units)


def binaries(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog row per binary; b9 is unknown to the catalog."""
    build = F.col("build_id")

    def has(*names: str) -> Column:
        return build.isin(*names)

    quality = F.struct(
        has("b3").alias("not_valid_elf"),
        has("b0", "b3", "b7").alias("has_dwarf"),
        has("b8").alias("has_go_pclntab"),
        has("b1", "b6", "blibc").alias("has_symtab"),
        has("b2", "b10").alias("has_dynsym"),
    )
    return (
        functions(spark, sf)
        .select("build_id")
        .distinct()
        .where("build_id <> 'b9'")
        .select(
            "build_id",
            F.when(has("b10"), 2).otherwise(1).alias("source"),
            F.when(has("b10"), F.lit(None)).when(has("b6"), 1).otherwise(2).alias("upload_state"),
            F.when(~has("b5"), quality).alias("quality"),
        )
    )


_KIND = "case when build_id in ('b0', 'b7') then 0 when build_id = 'b10' then 1 else 2 end"


def binary_segments(spark: SparkSession, sf: str) -> DataFrame:
    """One header per binary; b1 has none."""
    return (
        functions(spark, sf)
        .select("build_id")
        .distinct()
        .where("build_id <> 'b1'")
        .select(
            "build_id",
            F.expr(_KIND).alias("elf_kind"),
            F.lit(0).alias("segment"),
            F.lit(0).cast("bigint").alias("offset"),
            F.expr("case when build_id in ('b0', 'b7') then 4194304L else 0L end").alias("vaddr"),
            F.lit(1 << 46).cast("bigint").alias("memsz"),
        )
    )


def _raw_frame(build: Column, address: Column) -> Column:
    start = F.lit(4194304).cast("bigint")
    shift = F.when(build.isin("b0", "b1", "b7"), F.lit(0)).otherwise(start).cast("bigint")
    return F.struct(
        (address + shift).cast("bigint").alias("address"),
        start.alias("mapping_start"),
        F.lit(1 << 46).cast("bigint").alias("mapping_limit"),
        F.lit(0).cast("bigint").alias("mapping_offset"),
        F.concat(F.lit("/usr/bin/"), build).alias("mapping_file"),
        build.alias("mapping_build_id"),
        F.array().cast(FRAME["lines"].dataType).alias("lines"),
    ).cast(FRAME)


def raw_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with two raw frames (a part, the hot library) and a named root."""
    leaf = _raw_frame(
        F.expr(_BUILD.format(k="l_partkey")),
        F.expr(f"{_LOW.format(k='l_partkey')} + l_linenumber * 500L"),
    )
    library = _raw_frame(F.lit("blibc"), F.expr("l_suppkey * 12288L + 2500L"))
    main = _frame(F.lit("main"), F.lit("/usr/bin/app"), F.lit("bapp"), F.lit(4206592), F.lit(1), F.lit("main.c"))
    return spread(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")).select(
        F.array(leaf, library, main).alias("stacktrace"), F.col("l_quantity").cast("bigint").alias("value")
    )


def supplier_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Three headers per supplier with a balance; the others have none."""
    unit, base = "4096L * (1 + s_nationkey % 4)", "case when s_suppkey % 3 = 0 then 4194304L else 0L end"
    headers = f"""array(
        named_struct('segment', 0, 'offset', 0L, 'vaddr', {base}, 'memsz', {unit} - 100L),
        named_struct('segment', 1, 'offset', {unit}, 'vaddr', {base} + {unit} + 4096L, 'memsz', 8192L),
        named_struct('segment', 2, 'offset', {unit} + 2048L, 'vaddr', {base} + {unit} + 10240L, 'memsz', 4096L))"""
    return (
        table(spark, sf, "supplier")
        .where("s_acctbal >= 0")
        .select(
            F.expr("concat('s', cast(s_suppkey as string))").alias("build_id"),
            F.expr("cast(s_suppkey % 3 as int)").alias("elf_kind"),
            F.explode(F.expr(headers)).alias("header"),
        )
        .select("build_id", "elf_kind", "header.*")
    )


def mapped_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct mappings and addresses of line items."""
    base = "(4194304L + (l_partkey % 16) * 65536L)"
    return (
        table(spark, sf, "lineitem")
        .selectExpr(
            "concat('s', cast(l_suppkey as string)) as build_id",
            f"case when l_linenumber = 6 then 0L else {base} end as mapping_start",
            f"case when l_linenumber = 7 then 4194304L else {base} + 12288L end as mapping_limit",
            "case when l_linenumber % 3 = 0 then 0L else 4096L * (l_linenumber % 4) end as mapping_offset",
            f"{base} + l_linenumber * 1500L as address",
        )
        .distinct()
    )


# --- catalog -------------------------------------------------------------------

NOW = "timestamp_ntz'2001-06-01 00:00:00'"


def catalog_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog writes in time order, one per order."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    state = F.when(priority.isin("1-URGENT", "2-HIGH"), 1).otherwise(2)
    upload = F.struct(
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("h"), (F.col("o_orderkey") % 5).cast("string")).alias("hash"),
        F.col("o_orderdate").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        state.alias("state"),
    )
    quality = F.struct(
        (F.col("o_orderkey") % 4 == 1).alias("not_valid_elf"),
        F.lit(True).alias("has_dwarf"),
        F.lit(False).alias("has_go_pclntab"),
        F.lit(False).alias("has_symtab"),
        F.lit(False).alias("has_dynsym"),
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("bid"), F.col("o_custkey").cast("string")).alias("build_id"),
        (F.col("o_orderkey") % 3).cast("int").alias("type"),
        F.when(status == "P", 2).otherwise(1).alias("source"),
        F.when(status != "P", upload).alias("upload"),
        F.when(F.col("o_orderkey") % 4 != 0, quality).alias("quality"),
        F.array().cast("array<string>").alias("servers"),
        F.col("o_orderdate").alias("written_at"),
        F.col("o_orderkey").alias("seq"),
    )


def upload_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per customer."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("bid"), key.cast("string")).alias("build_id"),
        (key % 3).cast("int").alias("type"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("h"), (key % 5).cast("string"))).alias("hash"),
        (F.col("c_nationkey") % 2 == 0).alias("force"),
        (key % 4).cast("int").alias("build_id_type"),
        F.when(F.col("c_acctbal") < 0, 0)
        .when(F.col("c_acctbal") > 9000, 2_000_000_000)
        .otherwise(1000)
        .cast("bigint")
        .alias("size"),
    )


def repeated_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's request again under two types, one that has no key of its own."""
    types = F.explode(F.array(F.lit(0), F.lit(3), F.lit(1)))
    again = upload_requests(spark, sf).withColumn("type", types)
    return again.withColumn("size", F.when(F.col("size") == 1000, 1000 + F.col("type")).otherwise(F.col("size")))


def server_index(spark: SparkSession, sf: str) -> DataFrame:
    """Build ids that two servers offer."""
    build = F.concat(F.lit("bid"), F.col("c_custkey").cast("string")).alias("build_id")
    server = F.concat(F.lit("srv"), (F.col("c_nationkey") % 2).cast("string"))
    customers = table(spark, sf, "customer")
    return customers.where("c_acctbal > 2000").select(server.alias("server"), build).unionByName(
        customers.where("c_acctbal > 6000").select(F.lit("srv0").alias("server"), build)
    )


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts cut into chunks of at most 500 characters."""
    return (
        table(spark, sf, "documents")
        .select(
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("upload_id"),
            "text",
            F.explode(F.sequence(F.lit(0), F.expr("cast((length(text) - 1) div 500 as int)"))).alias("seq"),
        )
        .select("upload_id", "seq", F.encode(F.expr("substring(text, seq * 500 + 1, 500)"), "UTF-8").alias("chunk"))
    )


def upload_streams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Upload streams, one per order: first messages, some with faults, and a chunk per line item, the sixth without data.

    Line numbers repeat in an order, so lines of one number have equal chunks.
    """
    key = F.col("o_orderkey")
    headers = table(spark, sf, "orders").select(
        key.alias("stream_id"),
        F.when(key % 11 == 3, None).when(key % 13 == 4, "chunk").otherwise("info").alias("kind"),
        F.when(key % 17 == 5, "b1")
        .when(key % 19 == 6, F.concat(F.lit("none"), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("bid"), F.col("o_custkey").cast("string")))
        .alias("build_id"),
        F.when(key % 23 == 7, 9).otherwise(key % 3).cast("int").alias("type"),
        F.concat(F.lit("u"), key.cast("string")).alias("upload_id"),
    )
    text = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.lit("line"), F.col("l_linenumber").cast("string"))
    chunks = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"),
        F.col("l_linenumber").alias("seq"),
        F.when(F.col("l_linenumber") != 6, F.encode(text, "UTF-8")).alias("chunk"),
    )
    return headers, chunks


def lifecycle_events(spark: SparkSession, sf: str) -> DataFrame:
    """One catalog event per order; the kind follows the priority."""
    priority = F.col("o_orderpriority")
    kind = (
        F.when(priority == "1-URGENT", "uploading")
        .when(priority == "3-MEDIUM", "quality")
        .when(priority == "4-NOT SPECIFIED", "debuginfod")
        .otherwise("uploaded")
    )
    quality = F.struct(
        (F.col("o_orderkey") % 4 == 1).alias("not_valid_elf"),
        F.lit(True).alias("has_dwarf"),
        F.lit(False).alias("has_go_pclntab"),
        F.lit(False).alias("has_symtab"),
        F.lit(False).alias("has_dynsym"),
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("bid"), F.col("o_custkey").cast("string")).alias("build_id"),
        (F.col("o_orderkey") % 3).cast("int").alias("type"),
        F.col("o_orderkey").alias("seq"),
        kind.alias("kind"),
        F.concat(F.lit("u"), (F.col("o_orderkey") % 2).cast("string")).alias("upload_id"),
        F.concat(F.lit("h"), (F.col("o_orderkey") % 5).cast("string")).alias("hash"),
        F.col("o_orderdate").alias("at"),
        F.array(F.lit("srv0")).alias("servers"),
        quality.alias("quality"),
    )


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog events in the order of their time."""
    day = F.datediff("at", F.lit("1970-01-01").cast("date")).cast("bigint")
    return lifecycle_events(spark, sf).withColumn("seq", day * 100_000_000_000 + F.col("seq"))


# --- pprof messages -------------------------------------------------------------
# One profile per order, one sample, location and function per line item.
# ``broken`` is the validation rule (1 to 17) that an order's customer breaks.

FIXED_STRINGS = ("", "samples", "count", "alloc", "bytes", "cpu", "nanoseconds", "thread", "size")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("profile_id"),
        "o_orderkey",
        (F.col("o_custkey") % 40).alias("broken"),
        epoch_ms("o_orderdate").alias("ms"),
        "o_orderstatus",
        "o_orderpriority",
    )


def _numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their line items, numbered from 0 within their order, and the parts of each.

    Every order has a row: without line items one whose ``pos`` is null, and a line item
    without part one whose ``part_no`` is null.  Parts are joined first, as lists, so that line items
    are moved twice, by part and by order, and stay together by order.
    """
    parts = (
        table(spark, sf, "part")
        .groupBy("p_partkey")
        .agg(F.collect_list(F.struct("p_name", "p_type", "p_size")).alias("parts"))
    )
    # The date comes last in the order and is no part of a message: it decides between equal messages only.
    lineitem = table(spark, sf, "lineitem").drop("l_shipdate")
    of_order = Window.partitionBy("l_orderkey")
    order = of_order.orderBy(*[c for c in lineitem.columns if c != "l_orderkey"])
    lines = (
        lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        .withColumn("pos", F.row_number().over(order).cast("bigint") - 1)
        .withColumn("n", F.count("*").over(of_order))
        .withColumn("found", F.max(F.col("parts").isNotNull()).over(of_order))
        .drop("l_suppkey", "l_extendedprice", "l_tax", "p_partkey")
    )
    columns = [c for c in lines.columns if c != "parts"]
    orders = _orders(spark, sf)
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(*orders.columns, *columns, F.posexplode_outer("parts").alias("part_no", "part"))
        .select(*orders.columns, *columns, "part_no", "part.*")
        .withColumn("n_string", F.when(F.col("found"), 13 + 3 * F.col("n")).otherwise(13))
    )


def _message(kind: str, pos: Column, body: Column) -> Column:
    """One row of the message table as a struct; the columns of other kinds are null."""
    columns = {"kind": F.lit(kind), "pos": pos, kind: body}
    fields = [f for f in MESSAGES.fields if f.name != "profile_id"]
    return F.struct(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _if_broken(rule: int, bad, good) -> Column:
    return F.when(F.col("broken") == rule, bad).otherwise(good)


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """The message table as ingest leaves it: written once, read by kind."""
    staged = fresh_path(spark, "messages")
    write_messages(derived_messages(spark, sf), staged)
    return read_messages(spark, staged)


def derived_messages(spark: SparkSession, sf: str) -> DataFrame:
    lines = _numbered_lines(spark, sf)
    pos, qty = F.col("pos"), F.col("l_quantity").cast("bigint")
    strings = [
        _if_broken(1, F.lit("x"), F.lit("")),
        *[F.lit(s) for s in FIXED_STRINGS[1:]],
        F.col("o_orderpriority"),
        F.col("o_orderstatus"),
        F.lit("/bin/app"),
        F.lit("buildapp"),
    ]
    no = F.lit(False)
    mapping = F.struct(
        _if_broken(2, _long(2), _long(1)),
        _long(4194304),
        _long(8388608),
        _long(0),
        _if_broken(3, F.col("n_string"), _long(11)),
        _if_broken(4, _long(-1), _long(12)),
        F.lit(True),
        no,
        no,
        no,
    )
    function = F.struct(
        _if_broken(6, pos + 2, pos + 1),
        _if_broken(7, F.col("n_string"), 13 + 3 * pos),
        F.when(F.col("broken") == 8, F.col("n_string") + 5)
        .when(F.col("p_size") < 10, _long(0))
        .otherwise(14 + 3 * pos),
        _if_broken(9, _long(-1), 15 + 3 * pos),
        F.col("p_size").cast("bigint"),
    )
    line_type = MESSAGES["location"].dataType["line"].dataType
    own_function = F.when(F.col("broken") == 12, F.col("n") + 1).when(
        F.col("l_linenumber") == 7, _long(0)
    ).otherwise(pos + 1)
    inlined = F.when(qty > 25, F.array(F.struct(_long(1), _long(99))).cast(line_type)).otherwise(
        F.array().cast(line_type)
    )
    location = F.struct(
        _if_broken(10, pos + 2, pos + 1),
        F.when(F.col("broken") == 11, _long(2)).when(F.col("l_returnflag") == "R", _long(0)).otherwise(_long(1)),
        F.col("l_partkey") * 4096,
        F.concat(F.array(F.struct(own_function, F.col("l_linenumber").cast("bigint"))).cast(line_type), inlined),
        no,
    )
    ids = F.array_compact(F.array(pos + 1, F.when(pos > 0, pos), _long(1)))
    stack = F.when(F.col("broken") == 15, F.array(F.col("n") + 1, _long(0))).when(
        F.col("l_discount") == 0, F.array().cast("array<bigint>")
    ).otherwise(ids)
    second = F.when(F.col("l_returnflag") == "N", _long(0)).otherwise(qty * 100)
    values = F.when(F.col("broken") == 14, F.array(qty)).otherwise(F.array(qty, second))
    priority = F.when(F.col("broken") == 17, F.col("n_string")).when(
        F.col("l_linestatus") == "F", _long(0)
    ).otherwise(_long(9))
    labels = F.array(
        F.struct(_if_broken(16, _long(0), _long(7)), priority, _long(0), _long(0)),
        F.struct(_long(7), _long(10), _long(0), _long(0)),
        F.struct(_long(8), _long(0), qty, _long(0)),
        F.struct(_long(8), _long(0), _long(5), _long(0)),
    )
    header = F.struct(
        _long(0),
        _long(0),
        F.col("ms") * 1_000_000 + 123_456,
        _long(10_000_000_000),
        F.when(F.col("o_orderstatus") != "P", F.struct(_long(5), _long(6))),
        _long(100),
        F.array().cast("array<bigint>"),
        _long(0),
    )
    of_line = [
        *[
            _message("string", 13 + 3 * pos + i, text)
            for i, text in enumerate([F.col("p_name"), F.concat(F.lit("_"), "p_name"), F.col("p_type")])
        ],
        _message("function", pos, function),
        _message("location", pos, location),
        _message("sample", pos, F.struct(stack, values, labels)),
    ]
    of_order = [
        *[_message("string", F.lit(i), text) for i, text in enumerate(strings)],
        _message("sample_type", F.lit(0), F.struct(_long(1), _long(2))),
        _message("sample_type", F.lit(1), F.struct(_long(3), _long(4))),
        _message("mapping", F.lit(0), mapping),
        _message("header", F.lit(0), header),
    ]
    # An order's own messages go with its first row.
    first = F.coalesce(pos, F.lit(0)) + F.coalesce("part_no", F.lit(0)) == 0
    none = F.array().cast(T.ArrayType(T.StructType([f for f in MESSAGES.fields if f.name != "profile_id"])))
    both = F.concat(
        F.when(first, F.array(*of_order)).otherwise(none), F.when(F.col("part_no").isNotNull(), F.array(*of_line)).otherwise(none)
    )
    rows = lines.select("profile_id", "broken", F.explode(both).alias("m"))
    return rows.where("broken <> 13 or m.kind <> 'sample_type'").select("profile_id", "m.*").select(*MESSAGES.names)


def _unreadable() -> Column:
    """Profiles whose blob arrives damaged."""
    return F.substring("profile_id", 2, 20).cast("bigint") % 50 == 3


def messages_with_faults(spark: SparkSession, sf: str) -> DataFrame:
    """The message table with a reject in place of the messages of damaged blobs."""
    sound = derived_messages(spark, sf).where(~_unreadable())
    refused = _orders(spark, sf).where(_unreadable()).select("profile_id", _message("reject", F.lit(0), F.lit("")).alias("m"))
    refused = refused.select("profile_id", "m.*").withColumn("string", F.lit("not gzip")).select(*MESSAGES.names)
    staged = fresh_path(spark, "messages")
    write_messages(sound.unionByName(refused), staged)
    return read_messages(spark, staged)


def arriving_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded profiles with their series, some of them damaged."""
    blobs = fresh_path(spark, "pprof")
    write_pprof(derived_messages(spark, sf), blobs)
    raw = joined_files(spark.read.parquet(blobs)).join(series(spark, sf), "profile_id")
    return raw.withColumn("raw_profile", F.when(_unreadable(), F.encode(F.lit("plain"), "UTF-8")).otherwise(F.col("raw_profile")))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Label list of every profile; some lists are wrong."""
    key = F.col("o_orderkey") % 50

    def label(name: str, value: Column | str) -> Column:
        return F.struct(F.lit(name).alias("name"), (F.lit(value) if isinstance(value, str) else value).alias("value"))

    usual = [
        label("node", F.col("o_orderpriority")),
        label("team", F.col("o_orderstatus")),
    ]
    name = label("__name__", "process_cpu")
    labels = (
        F.when(key == 0, F.array(name, *usual, label("node", "again")))
        .when(key == 1, F.array(*usual))
        .when(key == 2, F.array(label("__name__", "first"), *usual, name))
        .otherwise(F.array(name, *usual))
    )
    return _orders(spark, sf).select(
        "profile_id", labels.alias("labels"), _if_broken(5, _long(2), _long(1)).alias("executables")
    )


# --- reports, metastore, status, streams -----------------------------------------


def report_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One report per nation and profile type over all samples."""
    rows = samples(spark, sf).withColumn("report_id", F.concat_ws("/", "`labels.node`", "name"))
    stacks = rows.groupBy("report_id", "stacktrace").agg(F.sum("value").alias("value"))
    meta = rows.groupBy("report_id").agg(
        F.max("timestamp").alias("timestamp"),
        *[
            F.max(c).alias(c)
            for c in ("duration", "period", "sample_type", "sample_unit", "period_type", "period_unit")
        ],
    )
    return stacks, meta


def event_samples(events: DataFrame) -> DataFrame:
    """Samples of the event table: milliseconds, type label, value in cents."""
    return events.select(
        F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, ts)").alias("timestamp"),
        F.col("event_type").alias("type"),
        F.expr("cast(round(value * 100) as bigint)").alias("value"),
    )


def pushes(spark: SparkSession, sf: str) -> DataFrame:
    """Pushes of agents: the node name is known for some, the address for all."""
    user = F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("node"), user)).otherwise("").alias("node"),
        F.concat(F.lit("10.0.0."), user).alias("ip"),
        F.col("ts").alias("pushed_at"),
        F.when(F.col("event_type") == "error", F.lit("push failed")).alias("error"),
        F.expr("cast(round(value * 100) as bigint)").alias("duration"),
        "event_id",
    )


def targets(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select(
        F.col("n_name").alias("job"),
        F.col("s_name").alias("target"),
        F.when(F.col("s_suppkey") % 3 == 0, "dropped").otherwise("active").alias("state"),
        F.when(F.col("s_acctbal") < 0, "bad").when(F.col("s_acctbal") > 5000, "good").otherwise("unknown").alias("health"),
    )
