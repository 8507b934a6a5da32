"""Removal of byte strings that an earlier document has: run-compressed indexes over sampled contexts.

Every ``length``-byte window of a text has an anchor, the ``gram`` bytes in it with
the smallest hash; equal windows have equal anchors in equal places.  Consecutive
windows with one anchor form a context, about one for every 15 bytes.  A context
found in several documents is a repeat in all but the first of them, by its hash
alone.  Only where one anchor has several contexts, at the borders of repeated
passages and around edits, windows have to be compared: these contexts go, once
each, to the task of their anchor.

There a run-compressed Burrows-Wheeler transform of the contexts is built.  Runs
are also cut where the first ``length`` bytes of neighbouring suffixes differ, and
the end of each run keeps the smallest document of its rows.  All contexts then
stream through the index backwards, step by step by the LF mapping of the runs,
which at each byte gives the run of its suffix; a window is marked if its run's
sample is an earlier document.

An anchor with more than ``BLOCK`` contexts is spread over several tasks.  Each of
them gives the distinct windows of its index with their samples, which are
aggregated over all tasks and joined with the windows of the contexts, so that a
passage in a third of all documents is in no task as a whole.

Cases: a null text counts as empty; texts below ``length`` bytes have no window;
documents are ordered by ``doc_id``; rows that share one do not remove each other,
and each, told apart by a hash of its text (``row``), loses its own places only;
rows without one keep everything and remove nothing.  Anchors and contexts are
told apart by two 64-bit hashes, windows inside an index by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flamelake.llm import hashing
from flamelake.llm.common import arrow_schema, id_text, map_columns, map_rows, parse, stage

LENGTH, GRAM = 50, 20
#: Contexts of one anchor that one task indexes.
BLOCK = 1 << 16
#: Size of the table of bits that keeps places of contexts found once from being shuffled: 8 MB, whatever the input.
FILTER_BITS = 26
#: Bytes of contexts in one index, and documents whose anchors are found together.
INDEX_BYTES, ROWS = 4 << 20, 1024


class Contexts:
    """Contexts of some texts: document, first and one-past-last byte, anchor hash and context hash."""

    def __init__(self, texts: list[str | None], length: int, gram: int):
        encoded = [(t or "").encode() for t in texts]
        sizes = np.array([len(e) for e in encoded], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        data = np.frombuffer(b"\n".join(encoded), np.uint8)
        self.doc = self.first = self.end = self.place = np.zeros(0, np.int64)
        self.anchor = self.context = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        up, down = hashing.powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.BYTES[data] * up[: len(data)])])
        n = len(data) - gram + 1
        grams = hashing.mix((sums[gram:] - sums[:n]) * down[:n])
        # The smallest hash of each window; of equal ones the leftmost.
        key = (grams >> np.uint64(31) << np.uint64(31)) | np.arange(n, dtype=np.uint64)
        width, done = length - gram + 1, 1
        while done * 2 <= width:
            key, done = np.minimum(key[:-done], key[done:]), done * 2
        if done < width:
            key = np.minimum(key[: len(key) - (width - done)], key[width - done :])
        at = (key & np.uint64((1 << 31) - 1)).astype(np.int64)
        # Windows that lie in one text.
        inside = np.zeros(len(at) + 1, np.int8)
        has = sizes >= length
        np.add.at(inside, starts[has], 1)
        np.add.at(inside, starts[has] + sizes[has] - length + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        change = np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])])
        # Texts of exactly ``length`` - 1 bytes apart can't touch: a window never ends in another text.
        cut = np.flatnonzero(change)
        first, last = cut, np.concatenate([cut[1:], [len(at)]]) - 1
        use = inside[first]
        first, last = first[use], last[use]
        place = at[first]
        doc = np.searchsorted(starts, first, side="right") - 1
        end = last + length
        self.doc, self.first, self.end = doc, first - starts[doc], end - starts[doc]
        self.place = place - first
        self.anchor = grams[place]
        whole = hashing.mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
        self.context = hashing.mix(whole + (place - first).astype(np.uint64))


def _slot(contexts: np.ndarray) -> np.ndarray:
    return (contexts.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(known: DataFrame) -> np.ndarray:
    """Bits of all known contexts in a table of fixed size."""
    slot = F.shiftrightunsigned("context", 64 - FILTER_BITS)
    words = known.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(context, {64 - FILTER_BITS}) & 63 as int)))").alias("bits")
    )
    found = words.toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def _found(rows: DataFrame, length: int, gram: int, known: np.ndarray | None = None) -> DataFrame:
    """Each context once a batch for its first and once for its last document; or, with the bits of the
    known ones, all places of contexts that may be known."""
    every = known is not None
    bits = rows.sparkSession.sparkContext.broadcast(known) if every else None

    def make():
        def work(columns):
            ids, texts, own = columns
            c = Contexts(texts, length, gram)
            doc = np.array(ids, np.int64)[c.doc] if len(ids) else np.zeros(0, np.int64)
            a, x = c.anchor.view(np.int64), c.context.view(np.int64)
            if every:
                slot = _slot(x)
                use = (bits.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                row = np.array(own, np.int64)[c.doc] if len(own) else doc
                return [v[use] for v in (a, x, doc, row, c.first, (c.end - c.first).astype(np.int16), c.place.astype(np.int16))]
            order = np.lexsort((doc, x))
            a, x, doc = a[order], x[order], doc[order]
            cut = np.concatenate([[True], (x[1:] != x[:-1]) | (a[1:] != a[:-1])])[: len(x)]
            low = np.flatnonzero(cut)
            high = np.concatenate([low[1:], [len(x)]]).astype(int)[: len(low)] - 1
            use = np.concatenate([low, high[doc[high] != doc[low]]])
            return [a[use], x[use], doc[use]]

        return work

    schema = "anchor bigint, context bigint, "
    schema += "doc_id bigint, row bigint, first int, size smallint, place smallint" if every else "doc_id bigint"
    return map_columns(rows, make, schema, ROWS if every else 2 * ROWS)


def _suffix_order(text: np.ndarray, ctx_end: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each up to the end of its context; equal ones in the order of their contexts."""
    n = len(text)
    left = (ctx_end - np.arange(n)).astype(np.int64)  # symbols up to the end of the context
    padded = np.concatenate([text, np.zeros(8, np.uint16)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(6):  # six symbols of nine bits; past the end: 0
        key = (key << np.uint64(9)) | np.where(left > k, padded[k : k + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    width = 6
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        if width >= left.max() or rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        has = np.flatnonzero(left > width)
        follow[has] = rank[has + width] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        width *= 2


class RunIndex:
    """Run-compressed BWT of contexts with the smallest document at the end of every run.

    ``texts`` must come in the order of equal suffixes that the LF mapping
    expects: any fixed order does.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray, length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        self.ends = np.cumsum(sizes + 1) - 1  # place of each end mark
        self.starts = self.ends - sizes
        symbols = data.astype(np.uint16) + 1
        symbols[self.ends] = 0
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        # Suffixes that begin with an end mark stand first, in the order of their contexts.
        order = _suffix_order(symbols, self.ends[owner] + 1)
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        before = symbols[order - 1]
        before[order == self.starts[owner[order]]] = 0  # what stands before a context is an end mark
        # First ``length`` bytes of suffixes, where a context has so many.
        window = order + length <= self.ends[owner[order]]
        up, down = hashing.powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.BYTES[data] * up[: len(data)])])
        head = order[window]
        code = np.zeros(len(order), np.uint64)
        code[window] = hashing.mix((sums[head + length] - sums[head]) * down[head])
        border = np.concatenate([[True], (code[1:] != code[:-1]) | (window[1:] != window[:-1])])
        cut = border | np.concatenate([[True], before[1:] != before[:-1]])
        #: Runs: first row, symbol, and the row that LF maps it to; samples by class of equal windows.
        self.run_start = np.flatnonzero(cut)
        run_symbol = before[self.run_start]
        run_size = np.diff(np.concatenate([self.run_start, [len(order)]]))
        by_symbol = np.argsort(run_symbol, kind="stable")
        target = np.empty(len(run_size), np.int64)
        target[by_symbol] = np.concatenate([[0], np.cumsum(run_size[by_symbol])[:-1]])
        self.run_target, self.run_symbol = target, run_symbol
        sample = np.minimum.reduceat(docs[owner[order]], self.run_start)
        classes = np.flatnonzero(border[self.run_start])
        lowest = np.minimum.reduceat(sample, classes)
        of = np.cumsum(border[self.run_start]) - 1
        self.sample = np.where(window[self.run_start], lowest[of], np.iinfo(np.int64).max)
        self.window_code = code[self.run_start]

    def statistics(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stream all contexts backwards at once: (context, place of its byte from the end, run of that suffix)."""
        context = np.arange(len(self.ends))
        rows, back = context.copy(), 0  # the rows of the end marks
        length = self.ends - self.starts
        while len(context):
            run = np.searchsorted(self.run_start, rows, side="right") - 1
            if back:
                yield context, np.full(len(context), back), run
            rows = self.run_target[run] + rows - self.run_start[run]
            back += 1
            going = length[context] >= back
            context, rows = context[going], rows[going]


def marked(texts: list[bytes], docs: np.ndarray, length: int) -> tuple[RunIndex, np.ndarray, np.ndarray, np.ndarray]:
    """The index and, of all windows, their context, first byte and run."""
    index = RunIndex(texts, docs, length)
    found = [(c, b, r) for c, b, r in index.statistics()]
    context, back, run = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    first = index.ends[context] - index.starts[context] - back
    use = back >= length
    return index, context[use], first[use], run[use]


def _ranges(context: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined byte ranges of marked windows by context."""
    if not len(first):
        return context, first, first
    order = np.lexsort((first, context))
    context, first = context[order], first[order]
    cut = np.concatenate([[True], (context[1:] != context[:-1]) | (first[1:] > first[:-1] + length)])
    start = np.flatnonzero(cut)
    last = np.concatenate([start[1:], [len(first)]]) - 1
    return context[start], first[start], first[last] + length


def _worth(anchor: np.ndarray, spread: np.ndarray, texts: pa.Array, place: np.ndarray, gram: int, reach: int) -> np.ndarray:
    """Contexts that share the anchor and ``reach`` bytes on one side of it with another one.

    A window has ``2 * reach`` bytes beside its anchor or one more than that,
    so two contexts with a common window share so many on one side.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at = offsets[:-1] + place
    alone = hashing.mix(np.arange(len(place), dtype=np.uint64))
    keep = spread > 1
    for first, end, has in (
        (at - reach, at, place >= reach),
        (at + gram, at + gram + reach, at + gram + reach <= offsets[1:]),
    ):
        side = alone.copy()
        side[has] = hashing.span_hashes(data, first[has], end[has])
        order = np.lexsort((side, anchor))
        a, s, h = anchor[order], side[order], has[order]
        same = (a[1:] == a[:-1]) & (s[1:] == s[:-1]) & h[1:] & h[:-1]
        keep[order[1:][same]] = keep[order[:-1][same]] = True
    return keep


def _compared(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Index pass over contexts dealt by anchor (and salt): marked ranges, and windows of spread anchors.

    ``kind`` 0: range ``first, end`` of ``doc_id, row``.  1: distinct window with its
    smallest document in ``doc_id``.  2: window at ``first`` of ``doc_id, row``.
    """
    fields = parse("kind int, doc_id bigint, row bigint, first int, end int, window bigint, check bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(fields)
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor = table["anchor"].to_numpy()
            spread = table["spread"].to_numpy()
            texts, place = table["bytes"].combine_chunks().cast(pa.binary()), table["place"].to_numpy().astype(np.int64)
            use = np.flatnonzero(_worth(anchor, spread, texts, place, gram, (length - gram) // 2))
            if not len(use):
                return
            texts, spread = texts.take(pa.array(use)).to_pylist(), spread[use]
            docs, own = table["low"].to_numpy()[use], table["row"].to_numpy()[use]
            places = [np.array(p) for p in table["places"].combine_chunks().take(pa.array(use)).to_pylist()]
            many = np.array([len(p) for p in places])
            before, every = np.concatenate([[0], np.cumsum(many)]), np.concatenate(places)

            def at_all(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """For contexts ``c``: which of them, and a place, once for each of its places."""
                of = np.repeat(np.arange(len(c)), many[c])
                nth = np.arange(len(of)) - np.repeat(np.cumsum(many[c]) - many[c], many[c])
                return of, every[before[c][of] + nth]

            index, context, first, run = marked(texts, docs, length)
            whole = spread[context] == 1
            hit = whole & (index.sample[run] < docs[context])
            c, start, end = _ranges(context[hit], first[hit], length)
            of, base = at_all(c)
            zero = np.zeros(len(of), int)
            rows = [(zero, docs[c][of], own[c][of], base + start[of], base + end[of], zero, zero)]
            if not whole.all():
                c, f, r = context[~whole], first[~whole], run[~whole]
                codes = index.window_code[r].view(np.int64)
                # A second hash of the window, since these meet windows of other tasks.
                checks = np.array([hash_bytes(texts[n][p : p + length]) for n, p in zip(c.tolist(), f.tolist(), strict=True)], np.int64)
                _, one = np.unique(codes, return_index=True)
                zero = np.zeros(len(one), int)
                rows.append((zero + 1, index.sample[r][one], zero, zero, zero, codes[one], checks[one]))
                of, base = at_all(c)
                two = np.full(len(of), 2)
                rows.append((two, docs[c][of], own[c][of], base + f[of], base + f[of] + length, codes[of], checks[of]))
            columns = [np.concatenate([r[k] for r in rows]) for k in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= INDEX_BYTES:
                table = pa.Table.from_batches(held)
                # Up to the last change of anchor: an anchor's contexts stay together.
                key = table["anchor"].to_numpy() * 31 + table["salt"].to_numpy()
                change = np.flatnonzero(key[1:] != key[:-1])
                if len(change):
                    cut = int(change[-1]) + 1
                    for start, end in _parts(table, key, cut):
                        yield from work(table.slice(start, end - start))
                    held = table.slice(cut).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            table = pa.Table.from_batches(held)
            key = table["anchor"].to_numpy() * 31 + table["salt"].to_numpy()
            for start, end in _parts(table, key, len(key)):
                yield from work(table.slice(start, end - start))

    return contexts.mapInArrow(run, fields)


def _parts(table: pa.Table, key: np.ndarray, stop: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``INDEX_BYTES`` that end where the key changes."""
    step = max(1, INDEX_BYTES // 100)
    start = 0
    change = np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    while start < stop:
        end = int(change[min(np.searchsorted(change, min(start + step, stop)), len(change) - 1)])
        end = min(end, stop)
        yield start, end
        start = end


def hash_bytes(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data, seed=50) - (1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``: rows with one id and different texts differ in ``row``."""
    return id_text(docs).withColumn("row", F.xxhash64("text"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, row, first, end``: byte ranges to remove, not yet joined."""
    rows = _keyed(docs).where("doc_id is not null and text is not null")
    # One exchange: contexts of an anchor meet in one partition, where both groupings are local.
    each = (
        _found(rows, length, gram)
        .repartition("anchor")
        .groupBy("anchor", "context")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .withColumn("contexts", F.count("*").over(Window.partitionBy("anchor")))
    )
    known = stage(each.where("contexts > 1 or high > low").drop("high"), "contexts")
    placed = _found(rows, length, gram, _filter(known)).join(known.hint("merge"), ["anchor", "context"])
    placed = stage(
        placed.where("doc_id > low or contexts > 1").select(
            "anchor", "context", "doc_id", "row", "first", F.expr("cast(first + size as int)").alias("end"), "place", "low", "contexts"
        ),
        "places",
    )
    ranges = placed.where("doc_id > low").select("doc_id", "row", "first", "end")

    # All places of a context in its first document go with it.
    one = (
        placed.where("doc_id = low and contexts > 1")
        .groupBy("anchor", "context", "contexts", "doc_id", "row")
        .agg(F.collect_list("first").alias("places"), F.min(F.col("end") - F.col("first")).alias("size"), F.min("place").alias("place"))
    )
    wanted = one.groupBy("doc_id", "row").agg(
        F.collect_list(F.struct("anchor", "context", "contexts", "places", "size", "place")).alias("own")
    )

    def cut():
        def work(columns):
            for doc_id, row, text, own in zip(*columns, strict=True):
                data = text.encode()
                for c in own:
                    at = c["places"][0]
                    piece = data[at : at + c["size"]]
                    yield c["anchor"], c["context"], c["contexts"], doc_id, row, c["places"], c["place"], piece

        return work

    schema = "anchor bigint, context bigint, contexts bigint, low bigint, row bigint, places array<int>, place smallint, bytes binary"
    given = rows.join(wanted.hint("merge"), ["doc_id", "row"]).select("doc_id", "row", "text", "own")
    pieces = map_rows(given, cut, schema, 256).withColumn(
        "spread", F.ceil(F.col("contexts") / BLOCK).cast("bigint")
    )
    pieces = pieces.withColumn("salt", F.pmod("context", "spread"))
    dealt = pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    compared = stage(_compared(dealt, length, gram), "compared")
    lowest = compared.where("kind = 1").groupBy("window", "check").agg(F.min("doc_id").alias("low"))
    met = compared.where("kind = 2").join(lowest, ["window", "check"]).where("low < doc_id")
    return ranges.unionByName(compared.where("kind = 0").select("doc_id", "row", "first", "end")).unionByName(
        met.select("doc_id", "row", "first", "end")
    )


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte ranges, and the bytes that are left."""
    found = spans(docs, length, gram)
    range_ = F.shiftleft(F.col("first").cast("bigint"), 32) + F.col("end")
    packed = found.groupBy("doc_id", "row").agg(F.collect_list(range_).alias("own"))
    joined = _keyed(docs).join(packed.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "own")

    def make():
        def work(columns):
            for doc_id, text, own in zip(*columns, strict=True):
                data = (text or "").encode()
                ranges = np.sort(np.array(own or (), np.int64))
                first, end = ranges >> 32, np.maximum.accumulate(ranges & 0xFFFFFFFF) if len(ranges) else ranges
                cut = np.concatenate([[True], first[1:] > end[:-1]])[: len(ranges)]
                last = np.concatenate([cut[1:], [True]])[: len(ranges)]
                joined = list(zip(first[cut].tolist(), end[last].tolist(), strict=True))
                cuts = [0, *[x for span in joined for x in span], len(data)]
                kept = b"".join(data[cuts[n] : cuts[n + 1]] for n in range(0, len(cuts), 2))
                yield doc_id, len(data), [{"first": a, "end": b} for a, b in joined], kept

        return work

    return map_rows(joined, make, "doc_id bigint, n_bytes bigint, spans array<struct<first:int,end:int>>, kept binary", 256)


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
