"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of each document, of character classes and of common words, are
compared with those of whole languages by Jensen-Shannon distance (base 2, 0 to
1).  The references are sums over all documents of a language, so they follow the
corpus.  A document is judged by its nearest language, and a histogram only
counts where the text is long enough for it.  Fixed counts (words, symbols,
repeated lines and windows) come with the verdict.

Cases: a null or empty text has no words and fails the base rule; a document
without a language is judged like the others but is in no reference; without any
reference (no language, empty table) no divergence is found.  Rows are judged
alone, so ties, repeated rows and null ids change nothing; further columns stay
untouched in ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.llm.common import stage


#: Frequent short words of each language, lower case.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "for",
    "de", "la", "le", "et", "les", "des", "un", "une",
    "der", "die", "und", "den", "das", "ein", "zu", "ist",
    "que", "el", "en", "los", "las", "y", "por", "con",
)
#: Character classes beside white space and "all others" (symbols): ASCII letters, beyond ASCII, marks of prose, digits.
CLASSES = {
    "lower": "a-z",
    "wide": r"\u0080-\x{10FFFF}",
    "marks": r".,;:?!'\"()\-",
    "upper": "A-Z",
    "digit": "0-9",
}
SYMBOLS = "#*$%&|<>"
_BLANKS = r"[\x20\x09-\x0D]+"

MIN_WORDS = 50
#: Guards and limits: characters or words that a histogram needs, and the distance that rejects.
MIN_CHARS, MIN_COMMON_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.26


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _BLANKS), "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are compared by 64-bit hash."""

    def covered(ordered: Column) -> Column:
        same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
        twice = F.filter(
            ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1))
        )
        return let(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            lambda at: F.aggregate(
                F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), b - a)),
                F.lit(0).cast("bigint"),
                lambda n, x: n + x,
            ),
        )

    def of(windows: Column) -> Column:
        pairs = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(F.sort_array(pairs), covered)).otherwise(
            F.lit(0).cast("bigint")
        )

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) >= 3, let(words, lambda w: let(windows(w), of))).otherwise(F.lit(0).cast("bigint"))


def _less(text: Column, members: str) -> Column:
    return F.regexp_replace(text, f"[{members}]+", "")


def measured(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, lang`` and ``keep`` with the base counts and both histograms as arrays of counts.

    Classes are counted by taking them away one after the other, so that each
    step reads what the ones before have left.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        *[F.col(f"`{c}`") for c in keep],
        text.alias("_text"),
        words_of(text).alias("_words"),
    )
    carried = ["doc_id", "lang", *keep]
    words = F.col("_words")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    frequent = F.filter(F.transform(words, F.lower), lambda w: w.isin(*COMMON))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in carried],
        F.size(words).cast("bigint").alias("n_words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.length("_text").alias("_chars"),
        F.concat(F.lit(" "), F.array_join(frequent, "  "), F.lit(" ")).alias("_spaced"),
        F.array_join(words, "").alias("_left"),
    )
    rows = rows.withColumn("_size", F.length("_left")).withColumn("word_chars", F.col("_size").cast("bigint"))
    counts = [F.col("_chars") - F.col("word_chars")]
    for name, members in CLASSES.items():
        rows = rows.withColumn("_next", _less(F.col("_left"), members))
        rows = rows.withColumn("_rest", F.length("_next")).withColumn(f"_{name}", F.col("_size") - F.col("_rest"))
        rows = rows.withColumn("_left", F.col("_next")).withColumn("_size", F.col("_rest")).drop("_next", "_rest")
        counts.append(F.col(f"_{name}"))
    times = lambda w: (
        F.octet_length("_spaced") - F.octet_length(F.replace(F.col("_spaced"), F.lit(f" {w} "), F.lit("")))
    ) / F.lit(len(w.encode()) + 2)
    rows = rows.select(
        *[F.col(f"`{c}`") for c in carried],
        "n_words",
        "word_chars",
        (F.col("_size") - F.length(_less(F.col("_left"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "_chars",
        F.array(*[c.cast("double") for c in (*counts, F.col("_size"))]).alias("chars"),
        F.array(*[times(w).cast("double") for w in COMMON]).alias("common"),
    )
    total = F.aggregate("common", F.lit(0.0), lambda n, x: n + x)
    return rows.withColumn("common", F.concat("common", F.array(F.col("n_words").cast("double") - total)))


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda n, x: n + x)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def references(rows: DataFrame) -> list[dict]:
    """Histograms of whole languages, one row each: sums over all documents of the language."""
    bins = {"chars": len(CLASSES) + 2, "common": len(COMMON) + 1}
    sums = [F.sum(F.get(F.col(c), F.lit(n))).alias(f"{c}_{n}") for c, size in bins.items() for n in range(size)]
    out = []
    for row in rows.where("lang is not null").groupBy("lang").agg(*sums).orderBy("lang").collect():
        totals = {c: [row[f"{c}_{n}"] for n in range(size)] for c, size in bins.items()}
        if sum(totals["chars"]) and sum(totals["common"]):
            out.append({"lang": row["lang"]} | {c: [x / sum(v) for x in v] for c, v in totals.items()})
    return out


def js_distance(p: Column, q: Column) -> Column:
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda n, x: n + x)))


def nearest(counts: Column, languages: list[list[float]]) -> Column:
    """Distance from the nearest language; 0 without any."""
    if not languages:
        return F.lit(0.0)
    known = F.array(*[F.array(*map(F.lit, q)) for q in languages])
    return let(_share(counts), lambda p: F.array_min(F.transform(known, lambda q: js_distance(p, q))))


def judged(rows: DataFrame, languages: list[dict]) -> DataFrame:
    """``measured`` rows with both distances, ``base_failed`` and ``kept``."""
    far_chars = (F.col("_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    far_words = (F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.withColumns(
            {
                "char_distance": nearest(F.col("chars"), [x["chars"] for x in languages]),
                "word_distance": nearest(F.col("common"), [x["common"] for x in languages]),
                "base_failed": base,
            }
        )
        .withColumn("kept", ~F.col("base_failed") & ~far_chars & ~far_words)
        .drop("chars", "common", "_chars", "lang")
    )


def rules(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict of every document; the counts are made once and written."""
    rows = stage(measured(docs), "measured")
    return judged(rows, references(rows))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    every = docs.columns
    packed = docs.select("doc_id", "lang", "text", F.struct(*[F.col(f"`{c}`") for c in every]).alias("_row"))
    rows = stage(measured(packed, ["_row"]), "measured")
    return judged(rows, references(rows)).where("kept").select("_row.*")
