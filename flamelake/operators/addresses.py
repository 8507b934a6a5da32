"""Runtime address to file address, through the program headers of the binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.functions import u64

PAGE = 4096

# Kinds of ELF files in ``elf_kind``.
EXECUTABLE, RELOCATABLE, DYNAMIC = 0, 1, 2

# Outcomes of a normalisation.
OK = "ok"
INVALID_MAPPING = "invalid mapping"
NO_HEADER = "no program header matches mapping"
NO_HEADER_AT_OFFSET = "no program header matches file offset"
SECOND_HEADER = "second program header matches file offset"
RELOCATABLE_OFFSET = "relocatable file with mapping offset"
UNKNOWN_KIND = "unknown file kind"
OVERFLOW = "address overflow"


def segments_by_build(segments: DataFrame) -> DataFrame:
    """One row per build id with its program headers as an array.

    The list is short by format: an ELF file numbers its program headers in 16
    bits, and a set keeps one copy of each number already before the shuffle.
    """
    return segments.groupBy("build_id").agg(
        F.max("elf_kind").alias("elf_kind"),
        F.array_sort(F.collect_set(F.struct("segment", "offset", "vaddr", "memsz"))).alias("segments"),
    )


def _covers_mapping(segment: Column, offset: Column, limit: Column) -> Column:
    page = F.lit(PAGE).cast("bigint")
    segment_limit = u64.add(segment["offset"], segment["memsz"])
    in_page = segment["vaddr"].bitwiseAND(F.lit(PAGE - 1).cast("bigint"))
    aligned = F.when(u64.less(in_page, segment["offset"]), u64.subtract(segment["offset"], in_page)).otherwise(
        F.lit(0).cast("bigint")
    )
    overlaps = u64.less(offset, segment_limit) & u64.less(segment["offset"], limit)
    other_segment = (
        u64.less(segment["offset"], offset)
        & u64.less(segment_limit, u64.add(offset, page))
        & u64.less_equal(u64.add(segment_limit, page), limit)
    )
    return overlaps & u64.less_equal(aligned, offset) & ~other_segment


def normalize_addresses(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ``status`` and ``normalized`` to ``(build_id, address, mapping_start, _limit, _offset)``.

    The headers of a binary come in as one array, so a probe stays one row:
    candidates are filtered in place instead of being joined and counted.
    Only the candidates depend on the mapping; only a choice among several
    depends on the address.
    """
    start, limit, offset = F.col("mapping_start"), F.col("mapping_limit"), F.col("mapping_offset")
    joined = probes.join(segments_by_build(segments), "build_id", "left")
    # More than 2**63 as unsigned: negative, except the sign bit alone.
    invalid = u64.less_equal(limit, start) | ((limit < 0) & (limit != F.lit(u64.SIGN_BIT)))
    map_limit = u64.add(offset, u64.subtract(limit, start))
    file_offset = u64.add(u64.subtract(F.col("address"), start), offset)
    candidates = joined.withColumn(
        "_candidates", F.filter("segments", lambda s: _covers_mapping(s, offset, map_limit))
    ).withColumn(
        "_matches",
        F.when(F.size("_candidates") == 1, F.col("_candidates")).otherwise(
            F.filter(
                "_candidates",
                lambda s: u64.less_equal(s["offset"], file_offset)
                & u64.less(file_offset, u64.add(s["offset"], s["memsz"])),
            )
        ),
    )
    header = F.get("_matches", F.lit(0))
    kind = F.col("elf_kind")
    fixed = u64.subtract(u64.add(u64.subtract(start, offset), header["offset"]), header["vaddr"])
    relocated = u64.add(u64.subtract(header["vaddr"], header["offset"]), start)
    based = candidates.withColumn(
        "_base",
        F.when(F.col("segments").isNull(), F.lit(0).cast("bigint"))
        .when(kind.isin(EXECUTABLE, DYNAMIC), fixed)
        .when(kind == RELOCATABLE, relocated),
    ).withColumn("_normalized", u64.subtract(F.col("address"), F.col("_base")))
    status = (
        F.when(invalid, INVALID_MAPPING)
        .when(F.col("segments").isNull(), OK)
        .when(F.size("_candidates") == 0, NO_HEADER)
        .when(F.size("_matches") == 0, NO_HEADER_AT_OFFSET)
        .when(F.size("_matches") > 1, SECOND_HEADER)
        .when((kind == RELOCATABLE) & (offset != 0), RELOCATABLE_OFFSET)
        .when(~kind.isin(EXECUTABLE, RELOCATABLE, DYNAMIC), UNKNOWN_KIND)
        .when(F.col("_normalized").isNull(), OVERFLOW)
        .otherwise(OK)
    )
    return (
        based.withColumn("status", status)
        .withColumn("normalized", F.when(F.col("status") == OK, F.col("_normalized")))
        .select(*probes.columns, "status", "normalized")
    )
