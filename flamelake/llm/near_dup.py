"""Near-duplicate groups from bottom-k sketches of one hash function.

Every distinct shingle set is represented once.  Its sketch holds the smallest
shingle hashes: all of a set of up to ``WHOLE``, ``size`` of a larger one.  Two
similar sets share many of them, so they also share one of the rarest in an order
by rarity, a prefix of each sketch; only those are listed.  Lists propose pairs,
signatures of whole sets and the sketch of a pair's union estimate its similarity, and
exact Jaccard on full sets confirms it.

Pairs of one list are not all made.  First every list proposes its members to its
most central one, whose hashes most others hold; confirmed links are contracted to groups.  Then in lists whose
members lie in several groups, those outside of the largest group meet the members of other groups
that are of similar size.  A pair inside a group could change nothing, so no link is lost.  A pair is made only
if the places of the shared hash allow for the threshold, and signatures of both whole sets (exact) and both
sketches: edited copies of one text hold its hashes in many lists, but of their pairs only those near
the threshold or above it go on.

Sets of up to ``WHOLE`` are listed by the exact bound of set similarity.  Larger
ones, and those that can be similar to a larger one, are also listed by ``size``
hashes, of which two similar sets share ``shared``: at 0.8 of 96 hashes the mean is
77 or more and 50 lies almost seven deviations below.  So a passage that many
documents share is listed only for those that hardly hold anything else.

Cases: a null or empty text has an empty set, is linked with nothing and is its
own component; equal texts are linked; rows that share a ``doc_id`` count as one
document, whose links are those of all its rows; a row with a null ``doc_id`` is
kept and linked with nothing.  Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flamelake.llm import hashing
from flamelake.llm.common import id_text, map_columns, map_rows, stage
from flamelake.llm.components import components

SIZE, SHARED, WHOLE = 96, 50, 256
#: Bits of the signatures of a whole set and of a sketch, and the 64-bit columns that hold them.
SET_BITS, SKETCH_BITS = 512, 256
SIGNS = [f"b{k}" for k in range((SET_BITS + SKETCH_BITS) // 64)]
#: Sketch estimates below the threshold less this much (six deviations) are dropped.
MARGIN = 0.25
#: Texts whose shingles are made together: their arrays stay small, whatever the number of tasks beside them.
ROWS = 128
#: Buckets in which retained hashes are counted; their table is what the rarity order needs.
BUCKETS = 1 << 16


def sketches(docs: DataFrame, shingle: int, size: int) -> DataFrame:
    """``doc_id, n, digest, sketch, signs`` of every row; ``digest`` stands for the whole set."""

    def make():
        def work(columns):
            ids, texts = columns
            for doc_id, own in zip(ids, hashing.shingle_sets(texts, shingle), strict=True):
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                signs = parity(own, SET_BITS) + parity(own[:size], SKETCH_BITS)
                yield doc_id, len(own), digest, (own if len(own) <= WHOLE else own[:size]).tolist(), *signs

        return work

    schema = "doc_id bigint, n bigint, digest binary, sketch array<bigint>, " + ", ".join(f"{b} bigint" for b in SIGNS)
    rows = map_rows(id_text(docs), make, schema, ROWS)
    return rows.select("doc_id", "n", "digest", "sketch", F.struct(*SIGNS).alias("signs"))


def rarity(sets: DataFrame) -> np.ndarray:
    """Retained hashes in each bucket, over all sets: a table of fixed size."""

    def make():
        def work(columns):
            values = np.concatenate([np.array(s, np.int64) for s in columns[0]] or [np.zeros(0, np.int64)])
            counts = np.bincount(bucket_of(values), minlength=BUCKETS)
            for bucket in np.flatnonzero(counts).tolist():
                yield bucket, int(counts[bucket])

        return work

    counted = map_rows(sets.select("sketch"), make, "bucket int, n bigint", 16384).groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(BUCKETS, np.int64)
    rows = counted.toArrow()
    table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return table


def bucket_of(values: np.ndarray) -> np.ndarray:
    return (hashing.mix(values.view(np.uint64)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def prefixes(own: np.ndarray, n: int, counts: np.ndarray, percent: int, size: int, shared: int) -> list[tuple]:
    """Listed hashes of one sketch, rarest first, with the number retained: of the whole set, and of its
    ``size`` smallest.  The two kinds have different lists, so the second is told apart by flipped bits."""
    out = []
    if n <= WHOLE:
        out.append((_rarest(own, counts, n - -(-percent * n // 100) + 1), n, True))
    if 100 * n > percent * WHOLE:
        out.append((~_rarest(own[:size], counts, size - shared + 1), min(n, size), False))
    return out


def _rarest(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return values[np.lexsort((values, counts[bucket_of(values)]))[:n]]


def parity(values: np.ndarray, size: int) -> tuple[int, ...]:
    """Signature of ``size`` bits: each hash flips one of them, so two sets differ in no more bits than members."""
    bits = np.bincount((hashing.mix(values.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return tuple(np.packbits((bits & 1).astype(np.uint8)).view(np.int64).tolist())


def listed(sets: DataFrame, counts: np.ndarray, percent: int, size: int, shared: int) -> DataFrame:
    """``value, node, n, rest, whole``: the rarest retained hashes of every set; ``rest`` of its retained
    hashes are this one or come after it."""
    table = sets.sparkSession.sparkContext.broadcast(counts)

    def make():
        def work(columns):
            found = [
                (values, node, n, retained, whole)
                for node, n, own in ((node, n, np.array(own, np.int64)) for node, n, own in zip(*columns, strict=True))
                for values, retained, whole in prefixes(own, n, table.value, percent, size, shared)
            ]
            many = np.array([len(f[0]) for f in found], np.int64)
            values = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
            node, n, retained, whole = (np.repeat(np.array([f[k] for f in found], np.int64), many) for k in range(1, 5))
            place = np.arange(len(values)) - np.repeat(np.cumsum(many) - many, many)
            return [values, node, n, retained - place, whole.astype(bool)]

        return work

    schema = "value bigint, node bigint, n bigint, rest bigint, whole boolean"
    return map_columns(sets.select("node", "n", "sketch"), make, schema, 512)


def _shared(a: str, b: str, percent: int, size: int):
    """How many members two similar sets share at least, and how many hashes their sketches share: the first
    exact, the second seven deviations below the mean."""
    n, m = F.col(f"{a}.n").cast("double"), F.col(f"{b}.n").cast("double")
    share = percent / (100 + percent)
    p = share * (1 + F.least(n, m) / F.greatest(n, m))
    return F.ceil(share * (n + m) - 1e-6), size * p - 7 * F.sqrt(size * p * (1 - p))


def _enough(a: str, b: str, percent: int, size: int):
    """Can the shared hash be the first of as many as two similar sets share?"""
    members, sampled = _shared(a, b, percent, size)
    rest = F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest"))
    return F.when(F.col(f"{a}.whole"), rest >= members).otherwise(rest >= sampled)


def _sets_alike(a: str, b: str, percent: int, size: int):
    """Can so few bits of the signatures of two whole sets differ?  Exact: members of only one of them are all
    that they hold, less twice what they share."""
    members, _ = _shared(a, b, percent, size)
    return _apart(a, b, SIGNS[: SET_BITS // 64]) <= F.col(f"{a}.n") + F.col(f"{b}.n") - 2 * members


def _sketches_alike(a: str, b: str, percent: int, size: int):
    """The same for the sketches of sets that are listed by them."""
    _, sampled = _shared(a, b, percent, size)
    return F.col(f"{a}.whole") | (_apart(a, b, SIGNS[SET_BITS // 64 :]) <= 2 * (size - sampled))


def _apart(a: str, b: str, signs: list[str]):
    return sum(F.bit_count(F.col(f"{a}.signs.{k}").bitwiseXOR(F.col(f"{b}.signs.{k}"))) for k in signs)


def _similar_size(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, percent: int, size: int) -> DataFrame:
    """The pairs ``u, v`` that the estimate lets through and the full sets confirm."""
    side = lambda x: sets.select(
        F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.struct("n", "signs").alias(f"set_{x}")
    )
    union = F.slice(F.sort_array(F.array_union("su", "sv")), 1, size)
    both = F.size(F.array_intersect("union", F.array_intersect("su", "sv")))
    likely = (
        pairs.join(side("u"), "u")
        .join(side("v"), "v")
        .where(_sets_alike("set_u", "set_v", percent, size))
        .withColumn("union", union)
        .where(both >= (percent / 100 - MARGIN) * F.size("union"))
        .select("u", "v")
    )
    text = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    rows = stage(likely, "likely").join(text("u"), "u").join(text("v"), "v").select("u", "v", "tu", "tv")

    def make():
        def work(columns):
            u, v, left, right = columns
            left, right = hashing.shingle_sets(left, shingle), hashing.shingle_sets(right, shingle)
            for a, b, x, y in zip(u, v, left, right, strict=True):
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same and 100 * same >= percent * (len(x) + len(y) - same):
                    yield a, b

        return work

    return map_rows(rows, make, "u bigint, v bigint", ROWS)


def groups(
    docs: DataFrame, shingle: int = 5, percent: int = 80, size: int = SIZE, shared: int = SHARED
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for every input row."""
    every = stage(sketches(docs, shingle, size), "sketches")
    usable = every.where("doc_id is not null and digest is not null")
    sets = stage(
        usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sketch", "signs")).alias("s")).select(
            "digest", F.col("s.doc_id").alias("node"), "s.n", "s.sketch", "s.signs"
        ),
        "sets",
    )
    lists = listed(sets, rarity(sets), percent, size, shared)
    shared_values = lists.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    lists = stage(lists.join(shared_values, "value"), "shared")
    # The most central member of each list: the one whose hashes most others hold.
    weights = lists.groupBy("node").agg(F.sum("members").alias("weight"))
    lists = stage(lists.join(weights, "node").drop("members"), "lists")
    heads = lists.groupBy("value").agg(F.max(F.struct("weight", -F.col("node"), "node", "n", "rest")).alias("head"))
    headed = lists.select("value", F.struct("node", "n", "rest", "whole").alias("own")).join(heads, "value")
    texts = stage(
        id_text(docs).withColumnRenamed("doc_id", "node").join(lists.select("node").distinct().hint("merge"), "node", "left_semi"),
        "texts",
    )
    first = stage(
        headed.where((F.col("own.node") != F.col("head.node")) & _similar_size("own.n", "head.n", percent))
        .where(_enough("own", "head", percent, size))
        .select(F.col("head.node").alias("u"), F.col("own.node").alias("v"))
        .distinct(),
        "first-pairs",
    )
    links = stage(confirmed(first, sets, texts, shingle, percent, size), "first-links")
    grouped = components(links)

    # Lists that still hold several groups: pairs of different groups and similar size.
    placed = lists.join(grouped.withColumnRenamed("component", "own"), "node", "left").withColumn(
        "own", F.coalesce("own", "node")
    )
    held = placed.groupBy("value", "own").agg(F.count("*").alias("many"))
    mixed = (
        held.groupBy("value")
        .agg(F.max(F.struct("many", "own")).alias("largest"), F.count("*").alias("groups"))
        .where("groups > 1")
        .select("value", F.col("largest.own").alias("main"))
    )
    step = math.log(100 / percent)
    met = stage(
        placed.join(mixed, "value").select(
            "value", "node", "n", "rest", "whole", "own", (F.col("own") == F.col("main")).alias("main"),
            F.floor(F.log("n") / step + 1e-9).alias("band"),
        ),
        "met",
    )
    members = stage(
        met.join(sets.select("node", "signs"), "node").select(
            "value", "band", F.struct("node", "n", "rest", "whole", "own", "main", "signs").alias("set")
        ),
        "mixed",
    )
    # Members of the largest group of a list meet those outside; these meet each other once.
    outside = members.where("not set.main").select(
        "value", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("set").alias("u")
    )
    second = (
        outside.join(members.withColumnRenamed("set", "v"), ["value", "band"])
        .where(F.col("v.main") | (F.col("u.own") < F.col("v.own")))
        .where(_similar_size("u.n", "v.n", percent))
        .where(_enough("u", "v", percent, size))
        .where(_sets_alike("u", "v", percent, size))
        .where(_sketches_alike("u", "v", percent, size))
        .select(F.col("u.node").alias("u"), F.col("v.node").alias("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
        .join(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), ["u", "v"], "left_anti")
    )
    more = stage(confirmed(stage(second, "second-pairs"), sets, texts, shingle, percent, size), "second-links")
    # Rows that share an id tie their sets together.
    ties = usable.join(sets.select("digest", F.col("node").alias("v")), "digest").select(F.col("doc_id").alias("u"), "v")
    found = components(links.unionByName(more).unionByName(ties))
    named = (
        every.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return named.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def first_of_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns; rows without ``doc_id`` stay."""
    later = groups(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct()
    return docs.join(later.hint("merge"), F.col("doc_id").cast("bigint") == F.col("id"), "left_anti")
