"""Readable names for mangled symbols."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flamelake.functions.rust_names import demangle_v0
from flamelake.functions.skew import skew_join

# Escapes of the legacy Rust mangling.
RUST_ESCAPES = {
    "SP": "@",
    "BP": "*",
    "RF": "&",
    "LT": "<",
    "GT": ">",
    "LP": "(",
    "RP": ")",
    "C": ",",
}

_PREFIX = re.compile(r"_{0,2}ZN")
_LENGTH = re.compile(r"[0-9]+")
_HASH = re.compile(r"h[0-9a-f]{16}")
_LLVM = re.compile(r"\.llvm\.[0-9A-F@]+$")
_TOKEN = re.compile(r"\$(?P<escape>[^$]*)\$|(?P<path>\.\.)")


def _unescape(token: re.Match) -> str:
    if token["path"]:
        return "::"
    escape = token["escape"]
    if escape in RUST_ESCAPES:
        return RUST_ESCAPES[escape]
    if re.fullmatch(r"u[0-9a-f]{1,6}", escape) and int(escape[1:], 16) <= 0x10FFFF:
        return chr(int(escape[1:], 16))
    return token[0]


def demangle_rust(symbol: str | None) -> str | None:
    """Rust name of either mangling without its hash, or None when the symbol is not one."""
    if not symbol or not symbol.isascii():
        return None
    symbol = _LLVM.sub("", symbol)
    prefix = _PREFIX.match(symbol)
    if prefix is None:
        return demangle_v0(symbol)
    at, parts = prefix.end(), []
    while length := _LENGTH.match(symbol, at):
        at = length.end() + int(length[0])
        if at > len(symbol):
            return None
        parts.append(symbol[length.end() : at])
    suffix = symbol[at + 1 :]
    if not parts or symbol[at : at + 1] != "E" or (suffix and not suffix.startswith(".")):
        return None
    if len(parts) > 1 and _HASH.fullmatch(parts[-1]):
        parts.pop()
    return "::".join(_TOKEN.sub(_unescape, p[1:] if p.startswith("_$") else p) for p in parts) + suffix


@F.pandas_udf(T.StringType())
def _demangle_rust(symbols: pd.Series) -> pd.Series:
    return symbols.map(demangle_rust)


def demangled_names(system_names: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Distinct ``system_name`` with its readable ``name``.

    Rust first, then the ``dictionary(system_name, name)`` for other languages,
    else the name stays.  Python runs once per distinct mangled symbol.
    """
    distinct = system_names.select("system_name").where("system_name is not null").distinct()
    named = distinct.withColumn(
        "_rust", F.when(F.col("system_name").rlike("^(_{0,2}ZN|_{0,2}R[A-Z])"), _demangle_rust("system_name"))
    )
    if dictionary is None:
        return named.select("system_name", F.coalesce("_rust", "system_name").alias("name"))
    other = dictionary.groupBy("system_name").agg(F.min("name").alias("_other"))
    return named.join(other, "system_name", "left").select(
        "system_name", F.coalesce("_rust", "_other", "system_name").alias("name")
    )


def demangle(functions: DataFrame, dictionary: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Set ``name`` of ``(name, system_name, ...)`` rows.

    A name that already differs from the system name is kept (replaced by the
    system name when forced); otherwise the system name is demangled.
    """
    name, system = F.coalesce("name", F.lit("")), F.coalesce("system_name", F.lit(""))
    marked = functions.withColumn("_done", (name != "") & (system != name))
    names = demangled_names(marked.where("not _done"), dictionary).withColumnRenamed("name", "_readable")
    kept: Column = F.when(system != "", system).otherwise(name) if force else name
    return (
        skew_join(marked, names, ["system_name"], "left")
        .withColumn("name", F.when(F.col("_done"), kept).otherwise(F.coalesce("_readable", system)))
        .select(*functions.columns)
    )
