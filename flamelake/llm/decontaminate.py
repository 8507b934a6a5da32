"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; both sides become
words joined by single blanks, with a blank at each end, so that a pattern found
in the text is a sequence of whole words.  The patterns are all windows of
``window`` consecutive words of an item; an item with fewer words is one window.
A text is scanned once for each block of patterns, and hits are mapped back to byte
offsets of the original.  The hits of a block, by the digest of the text, are written
before the next block is read; only the last block is scanned with them at hand.

Cases: a null text has no words; an item without words has no window; a null item
text likewise.  Equal windows of several items count for each of them, repeated
item rows count once.  Rows are independent, so repeated documents and null ids
give one result row each.  Empty tables give no hits, or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flamelake.llm.common import map_rows, stage

WINDOW = 13
#: Bytes of distinct patterns and their items' ids that one automaton takes; more are scanned in blocks.
BLOCK_BYTES = 8 << 20

_WORD = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Byte to normalised byte: A-Z to lower case, all that is no part of a word to a blank.
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20) for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(text: str | None, window: int) -> Iterator[str]:
    own = words(text)
    for start in range(max(1, len(own) - window + 1) if own else 0):
        yield b" ".join([b"", *own[start : start + window], b""]).decode("latin-1")


def pattern_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[dict[str, list[str]]]:
    """Window text to the ids of the items that have it, in blocks of bounded size.

    A block ends with an item, or inside one whose patterns alone are above
    ``BLOCK_BYTES``; the driver holds two blocks at most.
    """
    found: dict[str, set[str]] = {}
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null")

    def done() -> dict[str, list[str]]:
        return {key: sorted(ids) for key, ids in found.items()}

    for item, text in rows.distinct().toLocalIterator():
        for key in windows(text, window):
            ids = found.get(key)
            if ids is None:
                found[key], size = {item}, size + len(key) + len(item)
            elif item not in ids:
                ids.add(item)
                size += len(item)
            if size >= max(block_bytes, BLOCK_BYTES):
                yield done()
                found, size = {}, 0
        if size >= block_bytes:
            yield done()
            found, size = {}, 0
    if found:
        yield done()


def automaton(found: dict[str, list[str]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for key, ids in found.items():
        machine.add_word(key, (key.count(" ") - 1, ids))
    machine.make_automaton()
    return machine


def offsets(text: str) -> list[tuple[int, int]]:
    """First and one-past-last byte of every word in the UTF-8 text."""
    flat, at, out = text.encode().translate(NORMAL), 0, []
    for word in flat.split():
        at = flat.index(word, at)
        out.append((at, at + len(word)))
        at += len(word)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


_SPAN = "array<struct<first:bigint,end:bigint>>"


def _found(machine, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges of all hits in the words of a text, and their items."""
    hits: list[tuple[int, int]] = []
    ids: set[str] = set()
    if machine is not None and own:
        flat = b" ".join([b"", *own, b""]).decode("latin-1")
        at = before = 0
        for end, (n, found) in machine.iter(flat):
            before += flat.count(" ", at, end + 1)
            at = end + 1
            hits.append((before - 1 - n, before - 1))
            ids.update(found)
    return hits, ids


def _block_hits(docs: DataFrame, block: dict[str, list[str]]) -> DataFrame:
    """``digest, spans, items`` of texts with hits of one block, written; the block's broadcast ends with it."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        machine = automaton(shared.value)

        def work(columns):
            for text in columns[0]:
                hits, ids = _found(machine, words(text))
                if hits:
                    digest = hashlib.sha256(text.encode()).hexdigest()
                    yield digest, [{"first": a, "end": b} for a, b in merged(hits)], sorted(ids)

        return work

    texts = docs.select(F.col("text").cast("string").alias("text"))
    hits = stage(map_rows(texts, make, f"digest string, spans {_SPAN}, items array<string>", 256), "block-hits")
    shared.destroy()
    return hits


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, text, n_words, spans, byte_spans, items, row``: hit words as merged word ranges, the same
    ranges as bytes of the original text, and the ids of the items with occurring windows; ``row`` holds the
    other columns, by their place.

    A benchmark of one block takes one pass without a shuffle.  The hits of the blocks before the last
    are joined by the digest of the text, by broadcast where Spark finds them small.
    """
    spark = docs.sparkSession
    others = [F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(c for c in docs.columns if c != "text")]
    out = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("row")
    )
    row = out.schema["row"].dataType.simpleString()
    schema = f"doc_id bigint, text string, n_words bigint, spans {_SPAN}, byte_spans {_SPAN}, items array<string>, row {row}"
    blocks = pattern_blocks(benchmark, window, block_bytes)
    block, before = next(blocks, {}), []
    for following in blocks:
        before.append(_block_hits(out, block))
        block = following
    known = {"spans": F.expr(f"cast(array() as {_SPAN})"), "items": F.expr("cast(array() as array<string>)")}
    if before:
        # One group is one text; equal rows of its copies are one.
        every = reduce(DataFrame.unionByName, before).groupBy("digest")
        every = every.agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
        out = out.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).join(stage(every, "hits"), "digest", "left")
        known = {c: F.coalesce(c, empty) for c, empty in known.items()}
    out = out.withColumns(known).select("doc_id", "text", "spans", "items", "row")
    shared = spark.sparkContext.broadcast(block)

    def make():
        machine = automaton(shared.value) if shared.value else None

        def work(columns):
            for doc_id, text, spans, items, row in zip(*columns, strict=True):
                own = words(text)
                hits, ids = _found(machine, own)
                hits = merged(hits + [(s["first"], s["end"]) for s in spans])
                ids.update(items)
                places = offsets(text) if hits else []
                yield (
                    doc_id, text, len(own), [{"first": a, "end": b} for a, b in hits],
                    [{"first": places[a][0], "end": places[b - 1][1]} for a, b in hits], sorted(ids), row,
                )

        return work

    return map_rows(out, make, schema, 256)


def _n_hit():
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def _contaminated():
    return (_n_hit() > 0) & (20 * _n_hit() >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    names = [c for c in docs.columns if c != "text"]
    back = {c: F.col(f"row.c{n}").alias(c) for n, c in enumerate(names)} | {"text": F.col("text")}
    return scan(docs, benchmark).where(~_contaminated()).select(*[back[c] for c in docs.columns])


def judged(hits: DataFrame) -> DataFrame:
    """``scan`` rows with ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    return hits.select(
        "doc_id",
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )
