"""Secret scans through an inverted trigram index, in DataFrame functions only.

Each rule is a regular expression.  From its syntax tree follows what trigrams
any match must hold, as a Boolean query: clauses of which one must hold, each a
set of trigrams that all occur (``trigram_clauses``).  ``postings`` turns texts into
(trigram, document) rows, ``candidates`` intersects the lists of each clause, and
only documents that remain meet the expression itself.  The index is over
lower-cased text, so a query never depends on case; the expression does.  Rules
whose matches share no trigram scan every text.

The candidates are a written table, so Spark knows its size: below its own limit it
is broadcast and no text moves; beyond, texts are joined by digest, behind the Bloom
filter that Spark puts before large joins.  Rows outside the candidates are shuffled
as digests and found spans alone.

Cases: a null or empty text has no spans; rows are judged alone, so repeated rows,
equal ids with different texts, null ids and ties change nothing, and every input
row is one output row.  An empty table gives an empty one.  Texts are read whole at
any length; other columns never enter.
"""

from __future__ import annotations

import re._constants as syntax
import re._parser as parser
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.llm.common import stage
from flamelake.llm.quality_rules import let

Clauses = frozenset[frozenset[str]]
#: No condition: one clause without trigrams.
ANY: Clauses = frozenset([frozenset()])
#: Strings that a part of an expression may stand for, characters of a class that are spelled out, clauses of a query.
STRINGS, CLASS, CLAUSES = 32, 8, 64
#: Positions summed at once when lengths become offsets.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans of ``pattern``; spans whose ``group`` has fewer than ``least`` characters are dropped.

    The pattern must mean the same to Java and to Python's parser.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The three base rules.
BASE = (
    Rule(
        "assign",
        "(" + "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")]) + ")"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", "AKIA[A-Z0-9]{14,}", least=18),
    Rule("hex", "[0-9a-f]{16,}", least=16),
)
# Published forms of keys and tokens.
FORMS = (
    Rule("private", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"[Bb]earer\x20{1,4}[A-Za-z0-9._~+/=-]{20,}"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/@]{1,64}@"),
)
RULES = (*BASE, *FORMS)


# --- trigram queries of an expression


def _least(clauses: Iterable[frozenset[str]]) -> Clauses:
    """Without clauses that another one implies."""
    every = set(clauses)
    return frozenset(c for c in every if not any(o < c for o in every))


def _both(a: Clauses, b: Clauses) -> Clauses:
    joined = _least(x | y for x, y in product(a, b))
    # Leaving one condition out only adds candidates.
    return joined if len(joined) <= CLAUSES else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Clauses:
    return _least(frozenset(s[n : n + 3] for n in range(len(s) - 2)) for s in strings)


def _class(items: list) -> set[str] | None:
    """The lower-cased characters of a class, or None where they are many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is syntax.LITERAL:
            out.add(chr(value).lower())
        elif kind is syntax.RANGE and value[1] - value[0] < 4 * CLASS:
            out |= {chr(n).lower() for n in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= CLASS else None


def _node(kind, value) -> tuple[set[str] | None, Clauses]:
    """All strings that a node can stand for (None: unknown), and what holds for its matches in any case."""
    if kind is syntax.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is syntax.IN:
        return _class(value), ANY
    if kind is syntax.SUBPATTERN:
        return _sequence(value[-1])
    if kind is syntax.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(strings is not None for strings, _ in parts):
            strings = set().union(*[s for s, _ in parts])
            if len(strings) <= STRINGS:
                return strings, ANY
        either = _least(c for s, q in parts for c in (q if s is None else _of_strings(s)))
        return None, either if len(either) <= CLAUSES else ANY
    if kind in (syntax.MAX_REPEAT, syntax.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and high == 1:
            return strings | ({""} if low == 0 else set()), ANY
        if low == 0:
            return None, ANY
        if strings is not None:
            times = set(map("".join, product(strings, repeat=low))) if len(strings) ** low <= STRINGS else strings
            return (times, ANY) if low == high and len(strings) ** low <= STRINGS else (None, _of_strings(times))
        return None, query
    return ({""}, ANY) if kind is syntax.AT else (None, ANY)


def _sequence(nodes) -> tuple[set[str] | None, Clauses]:
    run, query, whole = {""}, ANY, True
    for kind, value in nodes:
        strings, inner = _node(kind, value)
        longer = None if strings is None else {a + b for a in run for b in strings}
        if longer is not None and len(longer) <= STRINGS:
            run = longer
            continue
        query, whole = _both(_both(query, _of_strings(run)), inner), False
        run = strings if strings is not None else {""}
    return (run, ANY) if whole else (None, _both(query, _of_strings(run)))


def trigram_clauses(pattern: str) -> Clauses | None:
    """Clauses of trigrams of which each match holds one entirely; None where there is no such condition."""
    strings, query = _sequence(parser.parse(pattern))
    query = _of_strings(strings) if strings is not None else query
    return None if frozenset() in query else query


# --- the index


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, _text`` and ``_key``, a digest of both."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("bigint")
    key = F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return docs.select(doc.alias("doc_id"), text.alias("_text"), key.alias("_key"))


def postings(rows: DataFrame, trigrams: Sequence[str] | None = None) -> DataFrame:
    """``trigram, _key``: the inverted lists of ``trigrams``, or of every trigram of the lower-cased texts."""
    low = F.lower("_text")
    if trigrams is not None:
        found = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t))
    else:
        # Single characters once, then neighbours: a substring a place would read the text again for each.
        three = lambda c: F.transform(c, lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2)))
        found = F.array_compact(F.array_distinct(let(F.split(low, ""), three)))
    return rows.select(F.explode(found).alias("trigram"), "_key")


def candidates(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``_key, kinds``: documents in the intersection of all lists of a clause, with the kinds of these clauses."""
    terms = [
        (rule.kind, f"{rule.kind}-{number}", term, 1 << bit, min(len(clause), 62))
        for rule in rules
        for number, clause in enumerate(sorted(map(sorted, trigram_clauses(rule.pattern))))
        for bit, term in enumerate(clause[:62])
    ]
    spark = rows.sparkSession
    asked = spark.createDataFrame(terms, "kind string, clause string, trigram string, bit bigint, size int")
    lists = postings(rows, sorted({t[2] for t in terms}))
    # A row per term of the rules: its size is that of the rules, whatever the data.
    met = (
        lists.join(F.broadcast(asked), "trigram")
        .groupBy("_key", "kind", "clause", "size")
        .agg(F.bit_or("bit").alias("seen"))
        .where("bit_count(seen) = size")
    )
    return met.groupBy("_key").agg(F.collect_set("kind").alias("kinds"))


# --- verification


def _running(lengths: Column) -> Column:
    """Sums of all items up to each, in blocks, so that time follows the number of items."""
    zero = F.array().cast("array<bigint>")
    last = lambda sums: F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0).cast("bigint"))
    sums = lambda items: F.aggregate(items, zero, lambda s, x: F.array_append(s, last(s) + x))
    total = lambda items: F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def joined(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, total))
        return F.flatten(F.zip_with(blocks, ends, lambda b, end: let(end - total(b), lambda at: F.transform(sums(b), lambda x: x + at))))

    count = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    return let(F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.slice(lengths, n * BLOCK + 1, F.lit(BLOCK))), joined)


_SPANS = "array<struct<start: bigint, rank: int, kind: string, stop: bigint>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost matches of a rule that do not overlap, in code points, without those that are too short.

    What lies between the matches gives their places: ``split`` and
    ``regexp_extract_all`` cut a text at the same matches.
    """
    pattern = F.lit(rule.pattern)
    none = F.array().cast(_SPANS)

    def placed(matches: Column) -> Column:
        sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
        gaps = F.split(text, rule.pattern, -1)
        parts = F.arrays_zip(
            F.transform(matches, lambda m: F.length(m).cast("bigint")).alias("own"),
            F.transform(F.slice(gaps, F.lit(1), F.size(matches)), lambda g: F.length(g).cast("bigint")).alias("gap"),
            F.transform(sized, F.length).alias("size"),
        )

        def rows(p: Column) -> Column:
            ends = _running(F.transform(p, lambda x: x["own"] + x["gap"]))
            each = F.zip_with(
                p,
                ends,
                lambda x, end: F.when(
                    x["size"] >= rule.least,
                    F.struct((end - x["own"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("stop")),
                ),
            )
            return F.array_compact(each)

        return F.when(F.size(matches) > 0, let(parts, rows)).otherwise(none).cast(_SPANS)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id, spans`` of each row; spans are (start, rank, kind, stop), sorted, rank being the place of the rule."""
    rank = {rule.kind: n for n, rule in enumerate(rules)}
    if len(rank) < len(rules):
        raise ValueError("each rule needs a kind of its own")
    indexed = [r for r in rules if trigram_clauses(r.pattern) is not None]
    open_rules = [r for r in rules if trigram_clauses(r.pattern) is None]
    rows = keyed(docs)
    every = [spans(F.col("_text"), r, rank[r.kind]) for r in open_rules]
    scanned = rows.select("doc_id", "_key", (F.concat(*every) if every else F.array().cast(_SPANS)).alias("_open"))
    if not indexed:
        return scanned.select("doc_id", F.sort_array("_open").alias("spans"))
    chosen = stage(candidates(rows, indexed), "secret-candidates")
    none = F.array().cast(_SPANS)
    verified = (
        rows.join(chosen.where(F.size("kinds") > 0), "_key")
        .select(
            "_key",
            F.concat(
                *[F.when(F.array_contains("kinds", r.kind), spans(F.col("_text"), r, rank[r.kind])).otherwise(none) for r in indexed]
            ).alias("_more"),
        )
        .where(F.size("_more") > 0)
        .groupBy("_key")
        .agg(F.first("_more").alias("_more"))
    )
    return scanned.join(verified, "_key", "left").select(
        "doc_id", F.sort_array(F.concat("_open", F.coalesce("_more", none))).alias("spans")
    )


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    text = lambda found: F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    base = [r.kind for r in BASE]
    return scanned.select(
        "doc_id",
        *[F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(text(of(base)).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
