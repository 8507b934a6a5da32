"""Column expressions over a stack trace (array of frames, leaf first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: str | Column) -> Column:
    return F.substring_index(_col(path), "/", -1)


def frame_labels(frame: Column) -> Column:
    """Display names of one frame: one per inlined line, innermost first.

    A frame that has no lines yet shows as its address.
    """
    by_line = F.transform(
        frame["lines"],
        lambda line: F.coalesce(
            F.nullif(line["function_name"], F.lit("")),
            F.nullif(line["function_system_name"], F.lit("")),
            F.lit("?"),
        ),
    )
    raw = F.array(F.concat(F.lit("0x"), F.lower(F.hex(frame["address"]))))
    return F.when(F.size(F.coalesce(frame["lines"], F.array())) > 0, by_line).otherwise(raw)


def function_names(stacktrace: str | Column = "stacktrace") -> Column:
    """Function names of a whole stack, leaf first."""
    return F.flatten(F.transform(_col(stacktrace), frame_labels))


def function_places(stacktrace: str | Column = "stacktrace") -> Column:
    """Functions of a whole stack, leaf first, each with where it is: ``build_id, binary, name, file``.

    The names are those of ``function_names``; what is unknown is an empty text.
    """

    def places(frame: Column) -> Column:
        text = lambda column: F.coalesce(column, F.lit(""))
        return F.transform(
            frame_labels(frame),
            lambda name, i: F.struct(
                text(frame["mapping_build_id"]).alias("build_id"),
                text(frame["mapping_file"]).alias("binary"),
                name.alias("name"),
                text(F.get(frame["lines"], i)["function_filename"]).alias("file"),
            ),
        )

    return F.flatten(F.transform(_col(stacktrace), places))


def stacktrace_id(stacktrace: str | Column = "stacktrace") -> Column:
    """Content id of a stack: equal stacks get equal ids on every executor."""
    return F.sha2(F.to_json(_col(stacktrace), {"ignoreNullFields": "false"}), 256)


def joined(names: Column, separator: str = ";") -> Column:
    return F.array_join(names, separator)
