"""Removal of lines that are similar to an earlier line: an exact set-similarity join.

A line is the set of its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased).  It goes if any
line before it, by document and line number, has a Jaccard similarity of
``percent`` or more; equal sets are the plain case of that.  Lines are judged on
the input, not on what is left, and lines without words stay.

Only the first line of every distinct set is joined.  Its words are ordered by
rarity; two similar sets share one of the first ``n - ceil(percent * n) + 1``, so
only those are listed.  Listed words leave a task as one row a bucket of words, and
a bucket's lists are worked on together.  Pairs from a list pass filters of length,
of position and of a parity signature (each exact: no similar pair is lost) and are
verified on whole sets.

Pairs of one list are not all made.  Lists are sorted by size of the sets, so that
only sets of similar size meet, and a line gets only some passing partners of a
list; words from buckets with very many rows are spread over shares with lists of
their own.  Lines that might have further partners, and that nothing has removed by
then, meet all earlier lines of their words in a join.

Rows that share a ``doc_id`` but not their text stand one after the other, by digest of
the text, and their lines are numbered on; equal rows have the same lines.

Cases: a null text has one empty line and stays null; repeated rows keep the same lines; rows with a null ``doc_id`` stay as they are
and remove nothing.  Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flamelake.llm import hashing
from flamelake.llm.common import BLOOM, arrow_schema, id_text, map_columns, map_rows, parse, stage

PERCENT = 80
#: Buckets in which words are counted; their table is what the rarity order needs.
BUCKETS = 1 << 16
#: Words of one bucket that a list of the first step may stand for.
SHARE = 500_000
#: In the first step a line gets about PARTNERS lines of a list; in lists above SHORT lines, which are worked on one
#: by one, it meets the first SOURCES lines only.  The second step has no bounds.
SHORT, SOURCES, PARTNERS = 1024, 20_000, 2
#: Listed words that leave a task together, and words for which there is a bucket of lists.
LEAVE, BUCKET = 1 << 18, 1 << 21
#: Size of the table that keeps words without open lines out of the second step: 1 MB, whatever the input.
FILTER_BITS = 20
#: Texts whose lines are worked on together: their arrays fit a processor's cache.
ROWS = 128
#: Bits of a word's hash that tell it from others, and of those the ones below its bucket.
WORD, BELOW = 44, 28


class Lines:
    """Lines of some texts with their distinct words, as flat arrays.

    With ``places``, the place of every word bucket by rarity, words are numbers that are
    sorted by rarity in each line.  With ``slots``, only lines with a word in one of them are there.
    """

    def __init__(
        self, texts: list[str | None], bases: list[int], places: np.ndarray | None = None, slots: np.ndarray | None = None
    ):
        encoded = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join(encoded).translate(hashing._LOWER), np.uint8)
        breaks = np.flatnonzero(data == 10)
        first, end = hashing.word_bounds(data)
        word = hashing.word_hashes(data, first, end) >> np.uint64(64 - WORD)
        if places is not None:
            word = places[word >> np.uint64(BELOW)] << np.uint64(BELOW) | word & np.uint64((1 << BELOW) - 1)
        line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(first, breaks), prepend=0, append=len(first)))
        if slots is not None:
            wanted = np.zeros(len(breaks) + 1, bool)
            wanted[line[slots[_slot(word)]]] = True
            stay = wanted[line]
            word, line = word[stay], line[stay]
        # Words come in the order of their lines.
        fresh = np.concatenate([[True], line[1:] != line[:-1]])[: len(line)]
        having, nth = line[fresh], np.cumsum(fresh) - 1
        keys = []
        # Number of the line and word in one integer; so many lines at a time as it has room for.
        cuts = np.searchsorted(nth, np.arange(0, len(having) + 1, 1 << 64 - WORD))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(word)], strict=True)):
            key = np.sort((nth[a:b] - (k << 64 - WORD)).astype(np.uint64) << np.uint64(WORD) | word[a:b])
            key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
            keys.append((key & np.uint64((1 << WORD) - 1), (key >> np.uint64(WORD)).astype(np.int64) + (k << 64 - WORD)))
        #: Distinct words and the line of each, by number among the lines with words; where a line's words begin.
        self.word, self.of = (np.concatenate(c) for c in zip(*keys, strict=True))
        self.size = np.bincount(self.of, minlength=len(having))
        self.start = np.cumsum(self.size) - self.size
        #: Document and number of the lines with words.
        starts = np.cumsum([0] + [len(e) + 1 for e in encoded])
        begins = np.concatenate([[0], breaks + 1])[having]
        self.doc = np.searchsorted(starts, begins, side="right") - 1
        self.number = having - np.searchsorted(breaks, starts[self.doc]) + np.array(bases, np.int64)[self.doc]
        if len(self.word):
            self.digest = hashing.mix(np.add.reduceat(hashing.mix(self.word + np.uint64(0x5851F42D4C957F2D)), self.start))
        else:
            self.digest = np.zeros(0, np.uint64)

    def parity(self) -> list[np.ndarray]:
        """Two halves of a signature of 128 bits: each word flips one, so two sets differ in no more bits than words."""
        bit, half = np.uint64(1) << (self.word & np.uint64(63)), (self.word >> np.uint64(6)) & np.uint64(1)
        return [np.bitwise_xor.reduceat(bit * (half == h), self.start).view(np.int64) for h in (0, 1)]


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(BELOW)).astype(np.int64)


def _table(rows: DataFrame) -> DataFrame:
    """``doc_id, line, digest`` of all lines with words; a row with line -1 holds a task's ``counts`` of word buckets."""

    def make():
        counts = np.zeros(BUCKETS, np.int64)

        def work(columns):
            ids, texts, bases = columns
            found = Lines(texts, bases)
            counts[:] += np.bincount(bucket_of(found.word), minlength=BUCKETS)
            digests = found.digest.view(np.int64)
            return [np.array(ids, np.int64)[found.doc], found.number, digests, pa.nulls(len(digests), pa.list_(pa.int64()))]

        def finish():
            return [[None], [-1], [None], [counts]]

        work.finish = finish
        return work

    return map_columns(rows, make, "doc_id bigint, line bigint, digest bigint, counts array<bigint>", ROWS)


def _needed(n, percent: int):
    """Words that a similar set shares with one of ``n`` words, at least."""
    return -(-percent * n // 100)


def _slot(words: np.ndarray) -> np.ndarray:
    """Place of a word in the filter of the second step."""
    return (hashing.mix(words) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(words: DataFrame) -> np.ndarray:
    """Which slots the words take: a table of fixed size."""

    def make():
        return lambda columns: [np.unique(_slot(np.array(columns[0], np.int64).view(np.uint64)))]

    found = map_columns(words.select("word"), make, "slot bigint", 1 << 16).distinct().toArrow()
    table = np.zeros(1 << FILTER_BITS, bool)
    table[found["slot"].to_numpy()] = True
    return table


def _postings(rows: DataFrame, counts: np.ndarray, percent: int, parts: int = 0, wanted: np.ndarray | None = None) -> DataFrame:
    """The rarest words of lines (``_FIELDS``), once a distinct set and batch; with ``wanted``, only words in slots
    that it names.  With ``parts``, so many buckets of words: ``bucket, lists``, packed.

    ``share`` is -1 for words whose list is not spread.
    """
    table = rows.sparkSession.sparkContext.broadcast(counts)
    slots = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)
    # Below this size only equal sets are similar.
    smallest = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1))
    out = arrow_schema(parse(_SCHEMA))

    def make():
        order = np.argsort(table.value, kind="stable")
        rarity, places = table.value[order], np.empty(BUCKETS, np.uint64)
        places[order] = np.arange(BUCKETS, dtype=np.uint64)
        held, seen = [], []

        def listed(ids, texts, bases) -> dict[str, np.ndarray] | None:
            found = Lines(texts, bases, places, None if slots is None else slots.value)
            if not len(found.word):
                return None
            place = np.arange(len(found.word)) - found.start[found.of]
            once = np.zeros(len(found.size), bool)
            docs = np.array(ids, np.int64)[found.doc]
            earliest = np.lexsort((found.number, docs, found.digest))
            once[earliest[np.unique(found.digest[earliest], return_index=True)[1]]] = True
            use = once & (found.size >= smallest)
            use = place < np.where(use, found.size - _needed(found.size, percent) + 1, 0)[found.of]
            if slots is not None:
                use &= slots.value[_slot(found.word)]
            line, word = found.of[use], found.word[use]
            shares = 1 + rarity[bucket_of(word)] // SHARE
            share = np.where(shares > 1, (found.digest[line] % shares.astype(np.uint64)).astype(np.int64), -1)
            p0, p1 = found.parity()
            made = word.view(np.int64), share, docs[line], found.number[line], found.size[line], place[use], p0[line], p1[line], found.digest.view(np.int64)[line]
            return dict(zip(_FIELDS, made, strict=True))

        def leave() -> list:
            if not sum(seen):
                return [[], []]
            rows = {c: np.concatenate([h[c] for h in held]) for c in _FIELDS}
            held.clear()
            seen.clear()
            bucket = (hashing.mix(rows["word"].view(np.uint64) + (rows["share"].view(np.uint64) << np.uint64(WORD))) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            used, cuts = np.unique(bucket[order], return_index=True)
            every = pa.RecordBatch.from_arrays([pa.array(rows[c][order], f.type) for c, f in zip(_FIELDS, out, strict=True)], schema=out)
            return [used, [_pack(every.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]]

        def work(columns):
            made = listed(*columns)
            if not parts:
                return [[]] * len(_FIELDS) if made is None else [made[c] for c in _FIELDS]
            if made is not None:
                held.append(made)
                seen.append(len(made["word"]))
            return leave() if sum(seen) >= LEAVE else [[], []]

        if parts:
            work.finish = leave
        return work

    return map_columns(rows, make, "bucket int, lists binary" if parts else _SCHEMA, ROWS)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _near(a: dict, b: dict, percent: int):
    """Filters that no similar pair fails: length, position of the shared word, parity signature.

    Works on arrays and on columns alike; ``b`` brings the functions that differ.
    """
    n, m = a["n"], b["n"]
    # Of all words that two sets share, the first in the order has the others behind it in both.
    shared = b["least"](n - a["place"], m - b["place"])
    return (
        (100 * n >= percent * m)
        & (100 * m >= percent * n)
        & ((100 + percent) * shared >= percent * (n + m))
        & ((100 + percent) * (b["apart"](a["p0"], b["p0"]) + b["apart"](a["p1"], b["p1"])) <= (100 - percent) * (n + m))
    )


_ARRAYS = {"least": np.minimum, "apart": lambda x, y: np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).astype(np.int64)}
_COLUMNS = {"least": F.least, "apart": lambda x, y: F.bit_count(x.bitwiseXOR(y))}
_FIELDS = ("word", "share", "doc_id", "line", "n", "place", "p0", "p1", "digest")
_SCHEMA = "word bigint, share int, doc_id bigint, line bigint, n int, place int, p0 bigint, p1 bigint, digest bigint"
_SIDE = ("n", "place", "p0", "p1")


def _by_size(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Order of listed words by list, size of the set, digest and place of the line.

    One sort by list, size and as much of the digest as 64 bits hold; only rows that are equal there are sorted by all.
    """
    lists = rows["word"].view(np.uint64) << np.uint64(64 - WORD) | (rows["share"] + 1).view(np.uint64)
    by = np.argsort(lists)
    number = np.empty(len(by), np.uint64)
    number[by] = np.cumsum(np.concatenate([[0], lists[by[1:]] != lists[by[:-1]]]))
    size = int(rows["n"].max()).bit_length()
    left = np.uint64(64 - int(number[by[-1]]).bit_length() - size)
    key = (number << np.uint64(size) | rows["n"].view(np.uint64)) << left | rows["digest"].view(np.uint64) >> (np.uint64(64) - left)
    order = np.argsort(key)
    key = key[order]
    equal = key[1:] == key[:-1]
    tied = np.flatnonzero(np.concatenate([[False], equal]) | np.concatenate([equal, [False]]))
    own = order[tied]
    order[tied] = own[np.lexsort((rows["line"][own], rows["doc_id"][own], rows["digest"][own], key[tied]))]
    return order


def _candidates(lists: DataFrame, percent: int, short: int, most: int, partners: int) -> DataFrame:
    """Pairs of lists that pass the filters: ``e`` and ``l`` as in ``_similar``.

    A line that passes with ``partners`` or more earlier lines of a list gets some
    of them only, and lines behind the first ``most`` of a long list meet only
    those; their rows come again with a null ``e``.
    """
    place = "struct<doc_id:bigint,line:bigint>"
    fields = parse(f"word bigint, n int, place int, p0 bigint, p1 bigint, e {place}, l {place}")

    def pairs_of(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Earlier and later rows of the pairs, and rows that may have further partners."""
        word, share = rows["word"], rows["share"]
        start = np.concatenate([[True], (word[1:] != word[:-1]) | (share[1:] != share[:-1])])
        first = np.flatnonzero(start)
        sizes = np.diff(np.concatenate([first, [len(word)]]))
        nth, n = np.arange(len(word)) - np.repeat(first, sizes), rows["n"]
        e, l, more = [], [], [np.flatnonzero(share >= 0)]  # noqa: E741

        def part(at, shape=()):
            return {c: rows[c][at][shape] if shape else rows[c][at] for c in _SIDE} | _ARRAYS

        # Each row with the one k places before it, of at most its size, while that is large enough.
        found = np.zeros(len(word), np.int64)
        at = np.flatnonzero(np.repeat(sizes <= short, sizes))
        for k in range(1, short):
            at = at[nth[at] >= k]
            at = at[100 * n[at - k] >= percent * n[at]]
            if not len(at):
                break
            near = at[_near(part(at - k), part(at), percent)]
            a, b = near - k, near
            swap = (rows["doc_id"][a] > rows["doc_id"][b]) | ((rows["doc_id"][a] == rows["doc_id"][b]) & (rows["line"][a] > rows["line"][b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            new = found[b] < partners
            e.append(a[new])
            l.append(b[new])
            np.add.at(found, b[new], 1)
        more.append(np.flatnonzero(found >= partners))
        for begin, count in zip(first[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
            own = np.arange(begin, begin + count)
            own = own[np.lexsort((rows["line"][own], rows["doc_id"][own]))]
            many = min(count, most)
            sources = part(own[:many], (None, slice(None)))
            for at in range(0, count, 32):
                rest = np.arange(at, min(at + 32, count))
                near = _near(sources, part(own[rest], (slice(None), None)), percent)
                near &= np.arange(many)[None, :] < rest[:, None]
                near &= np.cumsum(near, axis=1) <= partners
                t, s = np.nonzero(near)
                e.append(own[s])
                l.append(own[rest[t]])
                more.append(own[rest[(near.sum(axis=1) == partners) | (rest >= many)]])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + e), np.concatenate(none + l), np.unique(np.concatenate(more))

    def of_bucket(given: pa.Table) -> pa.Table:
        out = arrow_schema(fields)
        table = pa.concat_tables([pa.ipc.open_stream(packed.as_buffer()).read_all() for packed in given.column("lists")])
        rows = {c: table.column(c).to_numpy().astype(np.int64) for c in _FIELDS}
        del table
        # A set that a list has already is not the first of its kind.
        order = _by_size(rows)
        rows = {c: v[order] for c, v in rows.items()}
        stay = np.zeros(len(order), bool)
        for c in ("digest", "share", "word"):
            stay[1:] |= rows[c][1:] != rows[c][:-1]
        stay[:1] = True
        rows = {c: v[stay] for c, v in rows.items()}
        e, l, more = pairs_of(rows)  # noqa: E741

        def places(at: np.ndarray) -> pa.StructArray:
            return pa.StructArray.from_arrays([pa.array(rows["doc_id"][at]), pa.array(rows["line"][at])], ["doc_id", "line"])

        made = []
        for at, source in ((l, places(e)), (more, pa.nulls(len(more), out.field("e").type))):
            plain = [pa.array(rows[c][at], out.field(c).type) for c in ("word", *_SIDE)]
            made.append(pa.RecordBatch.from_arrays([*plain, source, places(at)], schema=out))
        return pa.Table.from_batches(made, out)

    return lists.groupBy("bucket").applyInArrow(of_bucket, fields)


def _similar(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (``e`` earlier, ``l`` later: ``doc_id, line``) whose whole sets are similar."""
    ends = pairs.select("e.*").unionByName(pairs.select("l.*")).distinct()
    # Written, so that Spark knows its size: only texts that hold such lines, or few others, are shuffled.
    wanted = stage(ends.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "wanted").where(F.size("lines") > 0)

    def sets():
        def work(columns):
            own, lines = [], []
            for doc_id, text, base, numbers in zip(*columns, strict=True):
                every = (text or "").split("\n")
                for line in numbers:
                    if 0 <= line - base < len(every):
                        own.append((doc_id, line))
                        lines.append(every[line - base])
            hashes, counts = hashing.words(lines)
            for (doc_id, line), words in zip(own, np.split(hashes, np.cumsum(counts))[:-1], strict=True):
                yield doc_id, line, np.unique(words).astype("<u8").tobytes()

        return work

    words = stage(map_rows(rows.join(wanted, "doc_id"), sets, "doc_id bigint, line bigint, words binary", ROWS), "line-words", **BLOOM)
    keyed = lambda x: words.select(F.struct("doc_id", "line").alias(x), F.col("words").alias(f"{x}w"))

    def verified():
        def work(columns):
            later, left, right = columns
            for place, x, y in zip(later, left, right, strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    yield place["doc_id"], place["line"]

        return work

    joined = pairs.join(keyed("e"), "e").join(keyed("l"), "l").select("l", "ew", "lw")
    return map_rows(joined, verified, "doc_id bigint, line bigint", 4096).distinct()


def bases(docs: DataFrame) -> DataFrame | None:
    """``doc_id, digest, base``: where the lines of rows that share an id begin; None where no two texts share one.

    Starts are sums inside ranges of the digest plus sums over ranges, so that an id of very
    many texts is not numbered in one task.
    """
    rows = id_text(docs).where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    hashed = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    shared = stage(hashed.where("a <> b").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return None
    size = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    texts = stage(rows.join(shared, "doc_id", "left_semi").select("doc_id", _digest("text").alias("digest"), size.alias("n")).distinct(), "shared-texts")
    texts = texts.withColumn("range", F.substring("digest", 1, 3))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = texts.groupBy("doc_id", "range").agg(F.sum("n").alias("n"))
    starts = starts.select("doc_id", "range", F.coalesce(F.sum("n").over(before(["doc_id"], "range")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(before(["doc_id", "range"], "digest")), F.lit(0))
    placed = texts.withColumn("inside", inside).join(starts, ["doc_id", "range"])
    return stage(placed.select("doc_id", "digest", (F.col("inside") + F.col("start")).alias("base")), "line-bases")


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _based(rows: DataFrame, starts: DataFrame | None) -> DataFrame:
    """``rows`` of ``doc_id`` and ``text`` with ``base``."""
    if starts is None:
        return rows.withColumn("base", F.lit(0).cast("bigint"))
    own = starts.withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"})
    met = rows.join(own, (F.col("doc_id") == F.col("_doc")) & (_digest("text") == F.col("_digest")), "left")
    return met.withColumn("base", F.coalesce("base", F.lit(0).cast("bigint"))).drop("_doc", "_digest")


def kept_lines(docs: DataFrame, percent: int = PERCENT, starts: DataFrame | None = None) -> DataFrame:
    """``doc_id, line`` of the lines with words that stay, numbered from ``base`` of ``starts``."""
    rows = _based(id_text(docs).where("doc_id is not null"), starts)
    table = stage(_table(rows), "lines")
    counts = np.zeros(BUCKETS, np.int64)
    found = table.where("line < 0").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).toArrow()
    counts[found["pos"].to_numpy()] = found["n"].to_numpy()
    firsts = stage(
        table.where("line >= 0").groupBy("digest").agg(F.min(F.struct("doc_id", "line")).alias("p")).select("p.*"), "first-lines"
    )
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // BUCKET)
    found = stage(_candidates(_postings(rows, counts, percent, parts), percent, SHORT, SOURCES, PARTNERS), "candidates")
    # Repeated rows give a line twice.
    found = found.where("e is null or e < l").withColumns({"doc_id": F.col("l.doc_id"), "line": F.col("l.line")})
    found = found.join(firsts.hint("merge"), ["doc_id", "line"], "left_semi")
    pairs = stage(found.where("e is not null").select("e", "l").distinct(), "pairs")
    gone = stage(_similar(pairs, rows, percent), "gone")
    # Lines that may have further partners and that nothing has removed so far.
    rest = stage(found.where("e is null").join(gone.hint("merge"), ["doc_id", "line"], "left_anti"), "rest")
    if not rest.isEmpty():
        sides = {x: {c: F.col(f"{x}.{c}").cast("bigint") for c in _SIDE} for x in "st"}
        source = F.struct(F.col("s.doc_id").alias("doc_id"), F.col("s.line").alias("line"))
        met = (
            _postings(rows, counts, percent, wanted=_filter(rest))
            .alias("s")
            .join(rest.alias("t"), F.col("s.word") == F.col("t.word"))
            .where(source < F.col("t.l"))
            .where(_near(sides["s"], sides["t"] | _COLUMNS, percent))
            .select(source.alias("e"), "t.l")
            .distinct()
        )
        gone = stage(gone.unionByName(_similar(stage(met, "pairs"), rows, percent)), "gone")
    return firsts.join(gone.hint("merge"), ["doc_id", "line"], "left_anti")


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with the text that is left, all other columns, and ``n_lines`` and ``n_removed`` in a
    struct ``line_dedup``."""
    name = "line_dedup"
    starts = bases(docs)
    kept = kept_lines(docs, percent, starts).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    # The text goes once through the join.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    packed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), others)
    joined = _based(packed, starts).join(kept.hint("merge"), "doc_id", "left")
    fields = T.StructType([joined.schema["row"], *parse("text string, n_lines bigint, n_removed bigint")])
    rebuilt = joined.mapInArrow(_rebuild, fields)
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != name]
    return rebuilt.select(*columns, F.struct("n_lines", "n_removed").alias(name))


def _rebuild(batches):
    for batch in (whole.slice(at, 4 * ROWS) for whole in batches for at in range(0, whole.num_rows, 4 * ROWS)):
        texts, counts, removed = [], [], []
        for doc_id, body, base, lines in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "base", "lines")), strict=True):
            own = (body or "").split("\n")
            stay = own
            if doc_id is not None:
                numbers = set(lines or ())
                stay = [x for n, x in enumerate(own) if n + base in numbers or not x.strip(" \t\n\x0b\x0c\r")]
            texts.append(None if body is None else "\n".join(stay))
            counts.append(len(own))
            removed.append(len(own) - len(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
            names=["row", "text", "n_lines", "n_removed"],
        )
