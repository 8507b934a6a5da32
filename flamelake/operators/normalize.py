"""Normalisation: from pprof messages to the stored sample table.

All inputs are columns of the message table (see ``sources.pprof``) and
``series(profile_id, labels array<struct<name, value>>, executables)``.
A profile whose messages stand at 0, 1, 2, ... once each, with fewer than
``WHOLE`` of a kind, is gathered in one row, whose lists are looked up by position
(``whole_profiles``).  All others are looked up by ``(profile_id, index)`` in joins;
where one index is in every sample (the root frame, a label key, the sample type)
the join splits that hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.functions.frames import stacktrace_id
from flamelake.functions.skew import skew_join
from flamelake.functions.workdir import setting, stage
from flamelake.schema import FRAME, LABEL_COLUMNS, METADATA_LABELS, SAMPLES
from flamelake.sources.pprof import KINDS, REJECT

NAME_LABEL = "__name__"

#: Messages of one kind up to which a profile is gathered in one row.
WHOLE = 1 << 14
#: Profiles that a task gathers at a time before it sorts the others.
_GATHERED = ("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "8")
#: What is looked up by id; ids are positions from 1 on.
_NUMBERED = ("mapping", "location", "function")


#: Of a profile and sample type.
META = ("timestamp", "duration", "period", "sample_type", "sample_unit", "period_type", "period_unit")


# --- messages by kind ------------------------------------------------------------


def of_kind(messages: DataFrame, kind: str) -> DataFrame:
    rows = messages.where(F.col("kind") == kind)
    return rows.select("profile_id", "pos", f"{kind}.*")


def strings(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("kind") == "string").select(
        "profile_id", F.col("pos").alias("idx"), F.col("string").alias("text")
    )


def resolve_strings(
    rows: DataFrame, table: DataFrame, key: Sequence[str], indexes: dict[str, str], join=DataFrame.join
) -> DataFrame:
    """``key`` with one text per ``{new column: index column}``, in a single join.

    Index columns are stacked into rows, joined once and put back per key.
    ``key`` must hold ``profile_id`` and identify a row.  Rows per sample pass
    ``skew_join``; those per function or mapping leave a skewed partition to
    the adaptive split.
    """
    pairs = F.array(
        *[F.struct(F.lit(name).alias("field"), F.col(index).alias("idx")) for name, index in indexes.items()]
    )
    stacked = rows.select(*key, F.explode(pairs).alias("ref")).select(*key, "ref.field", "ref.idx")
    found = join(stacked, table, ["profile_id", "idx"], "left")
    return found.groupBy(*key).agg(
        *[F.max(F.when(F.col("field") == name, F.col("text"))).alias(name) for name in indexes]
    )


# --- series ------------------------------------------------------------------------


def split_series(raw: DataFrame) -> DataFrame:
    """Pull ``__name__`` out of the label list; ``error`` tells why a series is refused.

    A repeated ``__name__`` takes its last value, which must not be empty; any other repeated label is an error.
    """
    names = F.transform(F.filter("labels", lambda x: x["name"] != NAME_LABEL), lambda x: x["name"])
    named = F.filter("labels", lambda x: x["name"] == NAME_LABEL)
    rest = F.filter("labels", lambda x: x["name"] != NAME_LABEL)
    error = F.when(F.size(F.array_distinct(names)) < F.size(names), DUPLICATE_LABEL).when(
        (F.size(named) == 0) | (F.coalesce(F.get(named, F.size(named) - 1)["value"], F.lit("")) == ""), MISSING_NAME
    )
    return (
        raw.withColumn("error", error)
        .withColumn("name", F.when(F.col("error").isNull(), F.get(named, F.size(named) - 1)["value"]))
        .withColumn(
            "labels",
            F.when(
                F.col("error").isNull(),
                F.map_from_entries(F.transform(rest, lambda x: F.struct(x["name"], x["value"]))),
            ),
        )
    )


# --- validation ----------------------------------------------------------------------


# What each rule says of a refused profile.
REASONS = {
    "V1": "the first string is not empty",
    "V2": "a mapping id differs from its position",
    "V3": "a mapping file is not in the string table",
    "V4": "a mapping build id is not in the string table",
    "V5": "executables and mappings differ in number",
    "V6": "a function id differs from its position",
    "V7": "a function name is not in the string table",
    "V8": "a function system name is not in the string table",
    "V9": "a function file is not in the string table",
    "V10": "a location id differs from its position",
    "V11": "a location names an unknown mapping",
    "V12": "a line names an unknown function",
    "V13": "samples without a sample type",
    "V14": "a sample has another number of values than there are types",
    "V15": "a sample names an unknown location",
    "V16": "a label key is not in the string table",
    "V17": "a label text is not in the string table",
}
UNREADABLE = "unreadable"
DUPLICATE_LABEL, MISSING_NAME, NO_SERIES = "duplicate label", "missing __name__", "no series"


def _statistics(messages: DataFrame) -> DataFrame:
    """Counts and extreme indexes of each profile: one grouped aggregate, a row per task for a huge profile.

    All of them are numbers and flags, which a hash aggregate updates in place; a text among them would
    have every message sorted.
    """

    def when(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    def count(kind: str) -> Column:
        return F.coalesce(F.count(when(kind, F.lit(1))), F.lit(0))

    def bounds(name: str, kind: str, low: Column, high: Column) -> list[Column]:
        return [F.min(when(kind, low)).alias(f"{name}_low"), F.max(when(kind, high)).alias(f"{name}_high")]

    def index(name: str, kind: str, field: str) -> list[Column]:
        return bounds(name, kind, F.col(f"{kind}.{field}"), F.col(f"{kind}.{field}"))

    def listed(name: str, kind: str, values: Column) -> list[Column]:
        return bounds(name, kind, F.array_min(values), F.array_max(values))

    labels = F.col("sample.label")
    text_labels = F.filter(labels, lambda x: x["str"] != 0)
    return messages.groupBy("profile_id").agg(
        *[count(k).alias(f"n_{k}") for k in ("sample_type", "sample", "mapping", "location", "function", "string")],
        F.max(F.col("kind") == REJECT).alias("unreadable"),
        F.max(when("string", (F.col("pos") == 0) & (F.col("string") != ""))).alias("v1"),
        F.max(when("mapping", F.col("mapping.id") != F.col("pos") + 1)).alias("v2"),
        F.max(when("function", F.col("function.id") != F.col("pos") + 1)).alias("v6"),
        F.max(when("location", F.col("location.id") != F.col("pos") + 1)).alias("v10"),
        *index("v3", "mapping", "filename"),
        *index("v4", "mapping", "build_id"),
        *index("v7", "function", "name"),
        *index("v8", "function", "system_name"),
        *index("v9", "function", "filename"),
        *index("v11", "location", "mapping_id"),
        *listed("v12", "location", F.transform("location.line", lambda x: x["function_id"])),
        *bounds("v14", "sample", F.size("sample.value"), F.size("sample.value")),
        *listed("v15", "sample", F.col("sample.location_id")),
        *listed("v16", "sample", F.transform(labels, lambda x: x["key"])),
        *listed("v17", "sample", F.transform(text_labels, lambda x: x["str"])),
    )


def _broken_rules(v5: Column) -> Column:
    """Rules that a profile's statistics break; of a blob that cannot be read, nothing else is said."""

    def outside(name: str, length: str, first: int = 0, past: int = 0) -> Column:
        """An index below ``first`` or not below ``length + past``."""
        return (F.col(f"{name}_low") < first) | (F.col(f"{name}_high") >= F.col(length) + past)

    rules = {
        "V1": F.col("v1"),
        "V2": F.col("v2"),
        "V3": outside("v3", "n_string"),
        "V4": outside("v4", "n_string"),
        "V5": v5,
        "V6": F.col("v6"),
        "V7": outside("v7", "n_string"),
        "V8": outside("v8", "n_string"),
        "V9": outside("v9", "n_string"),
        "V10": F.col("v10"),
        "V11": outside("v11", "n_mapping", 0, 1),
        "V12": outside("v12", "n_function", 0, 1),
        "V13": (F.col("n_sample") > 0) & (F.col("n_sample_type") == 0),
        "V14": (F.col("v14_low") != F.col("n_sample_type")) | (F.col("v14_high") != F.col("n_sample_type")),
        "V15": outside("v15", "n_location", 1, 1),
        "V16": outside("v16", "n_string", 1),
        "V17": outside("v17", "n_string"),
    }
    broken = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    return F.when(F.col("unreadable"), F.array(F.lit(UNREADABLE))).otherwise(broken)


def violations(messages: DataFrame, executables: DataFrame | None = None) -> DataFrame:
    """``(profile_id, rule)`` for every rule a profile breaks.

    Each rule is a comparison of per-profile counts and extreme index values.
    ``executables(profile_id, executables)`` is the number of executable
    descriptions sent along.
    """
    stats = _statistics(messages)
    if executables is not None:
        stats = stats.join(executables, "profile_id", "left")
        v5 = F.col("executables") != F.col("n_mapping")
    else:
        v5 = F.lit(False)
    return stats.select("profile_id", F.explode(_broken_rules(v5)).alias("rule"))


def rejects(messages: DataFrame, raw: DataFrame) -> DataFrame:
    """Everything that keeps a profile out of the store: ``(profile_id, level, rule, reason)``.

    ``level`` is ``blob`` (bytes that cannot be read), ``series`` (a label list that is
    refused, or none) or ``profile`` (one row a broken rule).  A profile may have rows of
    several levels.  Profiles of ``raw`` without a row here are accepted, so accepted
    and refused profiles add up to what came in.
    """
    text = "string"
    series = split_series(raw).select(
        "profile_id",
        F.lit(True).alias("_sent"),
        F.col("error").alias("_error"),
        (F.col("executables") if "executables" in raw.columns else F.lit(None)).cast("bigint").alias("_executables"),
    )
    entry = lambda level, rule, reason: F.struct(
        F.lit(level).alias("level"), rule.cast(text).alias("rule"), reason.cast(text).alias("reason")
    )
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    broken = F.transform(
        F.coalesce(_broken_rules(F.coalesce(F.col("_executables") != F.col("n_mapping"), F.lit(False))), F.array().cast("array<string>")),
        lambda rule: entry("profile", rule, F.try_element_at(reasons, rule)),
    )
    broken = F.filter(broken, lambda r: r["rule"] != UNREADABLE)
    error = F.when(F.col("_sent").isNull(), NO_SERIES).otherwise(F.col("_error"))
    of_series = F.when(error.isNotNull(), F.array(entry("series", F.translate(error, " ", "_"), error)))
    both = _statistics(messages).join(series, "profile_id", "full")
    every = F.concat(broken, F.coalesce(of_series, F.array().cast(f"array<struct<level:{text},rule:{text},reason:{text}>>")))
    fault = F.min(F.coalesce("string", F.lit(""))).alias("reason")
    blobs = messages.where(F.col("kind") == REJECT).groupBy("profile_id").agg(fault)
    found = both.select("profile_id", F.explode(every).alias("r")).select("profile_id", "r.*").distinct()
    return found.unionByName(blobs.select("profile_id", F.lit("blob").alias("level"), F.lit(UNREADABLE).alias("rule"), "reason"))


def valid_messages(messages: DataFrame, executables: DataFrame | None = None) -> DataFrame:
    """Messages of the profiles that break no rule; the others are staged, since every kind is read against them."""
    bad = stage(violations(messages, executables).select("profile_id").distinct(), "refused")
    return messages.join(bad, "profile_id", "left_anti")


# --- whole profiles --------------------------------------------------------------------


def whole_profiles(
    messages: DataFrame, kinds: Sequence[str], series: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Profiles in one row each, and the messages of those that cannot be, if there are any.

    The row has a list of each of ``kinds`` in the order of positions, each entry with its ``pos``, and
    the columns of ``series``.  A position that is missing or repeated, an id that is not its
    position plus one, a second header and a position from ``WHOLE`` on leave a profile to the joins.
    Messages are moved once, by profile; no more than ``WHOLE`` of a kind and profile meet.
    """
    listed = messages.where(F.col("kind").isin(*kinds) & F.col("profile_id").isNotNull())
    large = stage(listed.where(F.col("pos") >= WHOLE).select("profile_id").distinct(), "large")
    any_large = not large.isEmpty()
    if any_large:
        listed = listed.join(large, "profile_id", "left_anti")

    def gathered(kind: str) -> Column:
        names = [] if kind == "string" else messages.schema[kind].dataType.names
        fields = [F.col(f"{kind}.{name}") for name in names] or [F.col("string").alias("text")]
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", *fields)))).alias(kind)

    def in_order(kind: str) -> Column:
        if kind == "header":
            return F.size(kind) < 2
        each = lambda x, i: (x["pos"] == i) & (x["id"] == i + 1) if kind in _NUMBERED else x["pos"] == i
        return F.coalesce(F.forall(F.transform(kind, each), lambda x: x), F.lit(False))

    rows = listed.groupBy("profile_id").agg(*[gathered(kind) for kind in kinds])
    plain = in_order(kinds[0])
    for kind in kinds[1:]:
        plain = plain & in_order(kind)
    rows = rows.withColumn("_plain", plain)
    if series is not None:
        rows = rows.join(series, "profile_id")
    with setting(messages.sparkSession, *_GATHERED):
        rows = stage(rows, "profiles", compression="zstd")
    odd = rows.where(~F.col("_plain")).select("profile_id").distinct()
    whole = rows.where("_plain").drop("_plain")
    if odd.isEmpty() and not any_large:
        return whole, None
    return whole, messages.join(odd.union(large).distinct(), "profile_id", "left_semi")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _at(entries: Column, index: Column) -> Column:
    """The entry at a position; null where there is none."""
    return F.get(entries, index.try_cast("int"))


def _with_ids(entries: Column) -> Column:
    """Entries such that the id of each is its position."""
    return _let(entries, lambda x: F.concat(F.slice(F.transform(x, lambda _: F.get(x, F.lit(-1))), 1, 1), x))


def _whole_frames(texts: Column) -> Column:
    """The finished frame of every location of a whole profile, by location id; as ``location_frames``."""
    text = lambda index: F.coalesce(_at(texts, index), F.lit(""))
    functions = F.transform(
        "function",
        lambda f: F.struct(
            text(f["name"]).alias("name"), text(f["system_name"]).alias("system_name"), text(f["filename"]).alias("filename")
        ),
    )
    mappings = F.transform(
        "mapping",
        lambda m: F.struct(
            m["memory_start"].alias("start"),
            m["memory_limit"].alias("limit"),
            m["file_offset"].alias("offset"),
            text(m["filename"]).alias("file"),
            text(m["build_id"]).alias("build_id"),
        ),
    )

    def line(entry: Column, functions: Column) -> Column:
        function = _at(functions, entry["function_id"])
        return F.struct(
            entry["line"].alias("line"),
            F.coalesce(function["name"], F.lit("")).alias("function_name"),
            F.coalesce(function["system_name"], F.lit("")).alias("function_system_name"),
            F.coalesce(function["filename"], F.lit("")).alias("function_filename"),
            entry["line"].alias("function_start_line"),
        )

    def frame(location: Column, functions: Column, mappings: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        lines = F.coalesce(F.transform(location["line"], lambda x: line(x, functions)), F.array())
        return _let(
            _at(mappings, location["mapping_id"]),
            lambda mapping: F.struct(
                location["address"].alias("address"),
                F.coalesce(mapping["start"], zero).alias("mapping_start"),
                F.coalesce(mapping["limit"], zero).alias("mapping_limit"),
                F.coalesce(mapping["offset"], zero).alias("mapping_offset"),
                F.coalesce(mapping["file"], F.lit("")).alias("mapping_file"),
                F.coalesce(mapping["build_id"], F.lit("")).alias("mapping_build_id"),
                lines.cast(FRAME["lines"].dataType).alias("lines"),
            ).cast(FRAME),
        )

    frames = _let(
        _with_ids(functions),
        lambda fs: _let(_with_ids(mappings), lambda ms: F.transform("location", lambda x: frame(x, fs, ms))),
    )
    return _with_ids(frames)


def _whole_stack(sample: Column, frames: Column) -> Column:
    """The frames of a sample, leaf first; null where there is none."""
    found = F.filter(F.transform(sample["location_id"], lambda x: _at(frames, x)), lambda x: x.isNotNull())
    return _let(found, lambda x: F.when(F.size(x) > 0, x))


def _whole_entries(sample: Column, texts: Column) -> Column:
    """The label entries of a sample with their texts, as ``sample_labels`` lists them; null where there is none."""
    known = F.transform(
        sample["label"],
        lambda x, i: F.when(
            x["key"].isNotNull() & x["str"].isNotNull(),
            F.struct(
                i.alias("label_no"),
                _at(texts, x["key"]).alias("name"),
                F.when(x["str"] != 0, _at(texts, x["str"])).alias("text"),
                x["num"].alias("num"),
            ),
        ),
    )
    return _let(F.filter(known, lambda x: x.isNotNull()), lambda x: F.when(F.size(x) > 0, x))


def _whole_meta(texts: Column) -> Column:
    """As ``profile_meta``, a list by sample type."""
    text = lambda index: F.coalesce(_at(texts, index), F.lit(""))
    header = F.get("header", F.lit(0))
    nanos = header["time_nanos"]
    return F.transform(
        "sample_type",
        lambda t: F.struct(
            F.call_function("div", nanos, F.lit(1_000_000)).alias("timestamp"),
            header["duration_nanos"].alias("duration"),
            header["period"].alias("period"),
            text(t["type"]).alias("sample_type"),
            text(t["unit"]).alias("sample_unit"),
            text(header["period_type"]["type"]).alias("period_type"),
            text(header["period_type"]["unit"]).alias("period_unit"),
        ),
    )


# --- samples -------------------------------------------------------------------------


def explode_samples(messages: DataFrame) -> DataFrame:
    """One row per sample and sample type with a value other than zero."""
    return (
        of_kind(messages, "sample")
        .select("profile_id", F.col("pos").alias("sample_no"), F.posexplode("value").alias("type_no", "value"))
        .where("value <> 0")
        .withColumn("type_no", F.col("type_no").cast("bigint"))
    )


def profile_meta(messages: DataFrame) -> DataFrame:
    """Type, unit and time per profile and sample type."""
    types = of_kind(messages, "sample_type").select(
        "profile_id", F.col("pos").alias("type_no"), F.col("type").alias("_type"), F.col("unit").alias("_unit")
    )
    header = messages.where(F.col("kind") == "header").select(
        "profile_id",
        F.expr("header.time_nanos div 1000000").alias("timestamp"),
        F.col("header.duration_nanos").alias("duration"),
        F.col("header.period").alias("period"),
        F.col("header.period_type.type").alias("_ptype"),
        F.col("header.period_type.unit").alias("_punit"),
    )
    rows = types.join(header, "profile_id", "left")
    texts = resolve_strings(
        rows,
        strings(messages),
        ["profile_id", "type_no"],
        {"sample_type": "_type", "sample_unit": "_unit", "period_type": "_ptype", "period_unit": "_punit"},
    )
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("sample_type", "sample_unit", "period_type", "period_unit")]
    return rows.join(texts, ["profile_id", "type_no"]).select(
        "profile_id", "type_no", "timestamp", "duration", "period", *empty
    )


def sample_labels(messages: DataFrame) -> DataFrame:
    """``sample_labels`` and ``num_labels`` per sample: the first text and the first number of each key."""
    whole, rest = whole_profiles(messages, ("string", "sample"))
    entries = _let(
        F.col("string.text"),
        lambda texts: F.transform(
            "sample", lambda x: F.struct(x["pos"].alias("sample_no"), _whole_entries(x, texts).alias("entries"))
        ),
    )
    listed = whole.select("profile_id", F.inline(entries)).where("entries is not null")
    if rest is not None:
        listed = listed.unionByName(_joined_entries(rest))
    return listed.select("profile_id", "sample_no", *_label_maps(F.col("entries")))


def _joined_entries(messages: DataFrame) -> DataFrame:
    """The label entries of every sample with their texts.

    Texts are looked up once per distinct (key, text) pair of a profile; the
    samples then join that short list.
    """
    entries = (
        of_kind(messages, "sample")
        .select("profile_id", F.col("pos").alias("sample_no"), F.posexplode("label").alias("label_no", "label"))
        .select("profile_id", "sample_no", "label_no", "label.key", F.col("label.str").alias("str"), "label.num")
    )
    pair = ["profile_id", "key", "str"]
    pairs = entries.select(*pair, F.when(F.col("str") != 0, F.col("str")).alias("_str")).distinct()
    texts = resolve_strings(pairs, strings(messages), pair, {"name": "key", "text": "_str"}, skew_join)
    # One group is one sample; its list is as long as the sample has labels.
    return (
        skew_join(entries, texts, pair)
        .groupBy("profile_id", "sample_no")
        .agg(F.sort_array(F.collect_list(F.struct("label_no", "name", "text", "num"))).alias("entries"))
    )


def _label_maps(entries: Column) -> list[Column]:
    def first_of_each_key(kept: Column, value: str) -> Column:
        def of(kept: Column) -> Column:
            names = F.transform(kept, lambda x: x["name"])
            first = _let(names, lambda n: F.filter(kept, lambda x, i: F.array_position(n, x["name"]) == i + 1))
            return F.map_from_entries(F.transform(first, lambda x: F.struct(x["name"], x[value])))

        return _let(kept, of)

    return [
        first_of_each_key(F.filter(entries, lambda x: x["text"].isNotNull()), "text").alias("sample_labels"),
        first_of_each_key(F.filter(entries, lambda x: x["num"] != 0), "num").alias("num_labels"),
    ]


def sample_label_names(messages: DataFrame) -> DataFrame:
    """Distinct keys of text labels per profile."""
    keys = (
        of_kind(messages, "sample")
        .select("profile_id", F.explode("label").alias("label"))
        .where("label.str <> 0")
        .select("profile_id", F.col("label.key").alias("idx"))
        .distinct()
    )
    return keys.join(strings(messages), ["profile_id", "idx"]).select("profile_id", F.col("text").alias("label_name"))


def label_names(messages: DataFrame, series: DataFrame) -> DataFrame:
    """Series label names and sample label keys, per profile."""
    of_series = series.select("profile_id", F.explode(F.map_keys("labels")).alias("label_name"))
    return of_series.unionByName(sample_label_names(messages)).distinct()


def location_frames(messages: DataFrame) -> DataFrame:
    """One finished frame per location: mapping texts and the functions of its lines.

    The start line of a function is the line number of its entry in the
    location, as the stored format defines it.
    """
    texts = strings(messages)
    locations = of_kind(messages, "location").select(
        "profile_id", F.col("id").alias("location_id"), "mapping_id", "address", F.col("line").alias("entries")
    )
    functions = of_kind(messages, "function")
    function_texts = resolve_strings(
        functions,
        texts,
        ["profile_id", "id"],
        {"function_name": "name", "function_system_name": "system_name", "function_filename": "filename"},
    ).withColumnRenamed("id", "function_id")
    mappings = of_kind(messages, "mapping")
    mapping_rows = mappings.join(
        resolve_strings(
            mappings, texts, ["profile_id", "id"], {"mapping_file": "filename", "mapping_build_id": "build_id"}
        ),
        ["profile_id", "id"],
    ).select(
        "profile_id",
        F.col("id").alias("mapping_id"),
        F.col("memory_start").alias("mapping_start"),
        F.col("memory_limit").alias("mapping_limit"),
        F.col("file_offset").alias("mapping_offset"),
        "mapping_file",
        "mapping_build_id",
    )
    lines = locations.select(
        "profile_id", "location_id", F.posexplode("entries").alias("line_no", "entry")
    ).select("profile_id", "location_id", "line_no", "entry.function_id", "entry.line")
    line = F.struct(
        "line",
        F.coalesce("function_name", F.lit("")).alias("function_name"),
        F.coalesce("function_system_name", F.lit("")).alias("function_system_name"),
        F.coalesce("function_filename", F.lit("")).alias("function_filename"),
        F.col("line").alias("function_start_line"),
    )
    # One group is one location; its list is as long as the inlining is deep.
    by_location = (
        lines.join(function_texts, ["profile_id", "function_id"], "left")
        .groupBy("profile_id", "location_id")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines"))
    )
    zero = F.lit(0).cast("bigint")
    frame = F.struct(
        "address",
        F.coalesce("mapping_start", zero).alias("mapping_start"),
        F.coalesce("mapping_limit", zero).alias("mapping_limit"),
        F.coalesce("mapping_offset", zero).alias("mapping_offset"),
        F.coalesce("mapping_file", F.lit("")).alias("mapping_file"),
        F.coalesce("mapping_build_id", F.lit("")).alias("mapping_build_id"),
        F.coalesce(F.transform("lines", lambda x: x["line"]), F.array()).cast(FRAME["lines"].dataType).alias("lines"),
    )
    return (
        locations.drop("entries")
        .join(mapping_rows, ["profile_id", "mapping_id"], "left")
        .join(by_location, ["profile_id", "location_id"], "left")
        .select("profile_id", "location_id", frame.cast(FRAME).alias("frame"))
    )


def sample_stacks(messages: DataFrame) -> DataFrame:
    """``(profile_id, sample_no, stacktrace)`` with the frames in order, leaf first."""
    whole, rest = whole_profiles(messages, ("string", "mapping", "function", "location", "sample"))
    stacks = _let(
        _let(F.col("string.text"), _whole_frames),
        lambda frames: F.transform(
            "sample", lambda x: F.struct(x["pos"].alias("sample_no"), _whole_stack(x, frames).alias("stacktrace"))
        ),
    )
    rows = whole.select("profile_id", F.inline(stacks)).where("stacktrace is not null")
    return rows if rest is None else rows.unionByName(_joined_stacks(rest))


def _joined_stacks(messages: DataFrame) -> DataFrame:
    refs = of_kind(messages, "sample").select(
        "profile_id", F.col("pos").alias("sample_no"), F.posexplode("location_id").alias("frame_no", "location_id")
    )
    # One group is one sample; its list is as long as the stack is deep.
    return (
        skew_join(refs, location_frames(messages), ["profile_id", "location_id"])
        .groupBy("profile_id", "sample_no")
        .agg(F.sort_array(F.collect_list(F.struct("frame_no", "frame"))).alias("frames"))
        .select("profile_id", "sample_no", F.transform("frames", lambda x: x["frame"]).alias("stacktrace"))
    )


def label_columns(labels: str = "series_labels") -> list[Column]:
    """The fixed label columns out of a label map; a label that is not there is null."""
    return [
        F.try_element_at(F.col(labels), F.lit(name)).alias(column)
        for name, column in zip(METADATA_LABELS, LABEL_COLUMNS, strict=True)
    ]


def _joined_samples(good: DataFrame, series: DataFrame) -> DataFrame:
    """A row per sample and sample type with everything but dates and label columns."""
    meta = profile_meta(good).join(series, "profile_id")
    return (
        skew_join(explode_samples(good), meta, ["profile_id", "type_no"])
        .join(_joined_stacks(good), ["profile_id", "sample_no"], "left")
        .join(_joined_entries(good), ["profile_id", "sample_no"], "left")
        .withColumn("stacktrace_id", stacktrace_id())
        .select("name", "labels", *META, "value", "stacktrace", "stacktrace_id", *_label_maps(F.col("entries")))
    )


def _whole_samples(whole: DataFrame) -> DataFrame:
    """The same rows of whole profiles; stack ids and label maps are made once a sample."""
    texts = F.col("string.text")
    samples = _let(
        texts,
        lambda texts: _let(
            _whole_frames(texts),
            lambda frames: F.transform(
                "sample",
                lambda x: F.struct(
                    x["value"].alias("values"),
                    _whole_stack(x, frames).alias("stacktrace"),
                    _whole_entries(x, texts).alias("entries"),
                ),
            ),
        ),
    )
    by_type = F.transform(
        "values", lambda value, i: F.when(value != 0, F.struct(value.alias("value"), F.get("meta", i).alias("meta")))
    )
    return (
        whole.select("name", "labels", _let(texts, _whole_meta).alias("meta"), F.inline(samples))
        .select(
            "name",
            "labels",
            "stacktrace",
            stacktrace_id().alias("stacktrace_id"),
            *_label_maps(F.col("entries")),
            F.explode(F.filter(by_type, lambda x: x["meta"].isNotNull())).alias("of_type"),
        )
        .select("name", "labels", "of_type.meta.*", "of_type.value", "stacktrace", "stacktrace_id", "sample_labels", "num_labels")
    )


def normalize(messages: DataFrame, raw: DataFrame, ingest_date: Column | None = None) -> DataFrame:
    """Stored sample rows of accepted profiles; see ``split_ingest``."""
    return split_ingest(messages, raw, ingest_date)[0]


def split_ingest(
    messages: DataFrame, raw: DataFrame, ingest_date: Column | None = None, refused: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Stored sample rows of accepted profiles, and the ``rejects`` of all others.

    ``raw(profile_id, labels[, executables])`` gives the series of each profile.
    Samples without frames keep a null stack.  ``refused`` is given by callers that have
    written the rejects; otherwise they are staged here, since both outputs read them.
    """
    series = split_series(raw).where("error is null").select("profile_id", "name", "labels")
    if refused is None:
        refused = stage(rejects(messages, raw), "rejects")
    good = messages.join(refused.select("profile_id").distinct(), "profile_id", "left_anti")
    whole, rest = whole_profiles(good, KINDS, series)
    rows = _whole_samples(whole)
    if rest is not None:
        rows = rows.unionByName(_joined_samples(rest, series))
    day = ingest_date if ingest_date is not None else F.current_date()
    rows = rows.withColumnRenamed("labels", "series_labels").withColumn("ingest_date", day)
    rows = rows.withColumn("date", F.expr("date_add(date'1970-01-01', cast(floor(timestamp / 86400000) as int))"))
    columns = [c for c in SAMPLES.names if c not in LABEL_COLUMNS]
    samples = rows.select(*columns, *label_columns()).select(*[F.col(f"`{c}`") for c in SAMPLES.names])
    return samples, refused
