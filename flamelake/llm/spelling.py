"""Spelling variants: words one edit apart, found by walking a trie that is a distributed table.

``vocabulary`` counts words, ``trie`` turns them into nodes with their outgoing
letters, forwards and backwards, and ``near_pairs`` moves a frontier of (word, position,
node, edits) states through that table, one join a level.  A state without an edit
sits on its own word's path; it leaves it by taking another letter (substitution)
or by leaving out one of its own (deletion, which from the other word is an insertion).  A state with its
edit follows its own letters.  A state whose word is used up is a candidate, and a
neighbour if a word ends at its node.

Edits are taken in the second half of a word only: those in the first half are in the second
half of the word read backwards, so the wide top of the trie is never branched
at.  Nodes are 64-bit digests of prefixes: equal digests would add candidates, and each candidate
is verified by edit distance.  A node has at most as many letters as the alphabet, and
nothing else is gathered.  Each level is a written table, so a lost executor costs one level.

Words of more than ``LONG`` letters (no words of a language) would need a level a
letter.  Their pairs are joined on rolling digests with one letter left out, one
row a letter, at any length.

Cases: null or empty texts have no words; null ids count as empty text in the deletion rule; repeated rows and ids
count like others; words of equal counts choose the smaller in code-point order; an
empty table gives no words.  Other columns never enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.llm.common import stage
from flamelake.llm.hashing import BYTES, mix, powers

#: The letters of words, their least length and count, the factor between a word and its form.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: Letters up to which words are in the trie.
LONG = 32
#: Depth of the first branching: half of the shortest word.
TOP = LEAST_LETTERS // 2
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, _ALPHABET.upper(), _ALPHABET))


def vocabulary(docs: DataFrame, remove_each: int | None = 199, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words of all whole texts with their counts, summed before the shuffle.

    Where ``remove_each`` divides h, the crc32 of ``<doc_id>:<word>``, the word loses its
    letter h % length; None leaves words as they are.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(runs).alias("run"))
    rows = rows.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run")
    if remove_each:
        own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")
        rows = rows.withColumn("_h", F.crc32(own))
        at = (F.col("_h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("_h") % remove_each == 0, cut).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- the trie


def _node(direction: Column | str, prefix: Column) -> Column:
    return F.xxhash64(F.col(direction) if isinstance(direction, str) else direction, prefix)


def _walks(words: DataFrame) -> DataFrame:
    """``way, key, size, start``: each word forwards and backwards, with the depth from which its edits count."""
    size = F.length("word")
    both = F.explode(
        F.array(
            F.struct(F.lit(0).alias("way"), F.col("word").alias("key"), F.floor(size / 2).cast("int").alias("start")),
            F.struct(F.lit(1).alias("way"), F.reverse("word").alias("key"), F.ceil(size / 2).cast("int").alias("start")),
        )
    )
    return words.select(both.alias("w"), size.alias("size")).select("w.*", "size")


def _letter(place: Column) -> Column:
    """Letter ``place`` (from 0) of ``key``."""
    return F.substring("key", place + 1, F.lit(1))


def trie(walks: DataFrame) -> DataFrame:
    """``depth, node, letters``: each node from depth ``TOP`` with (letter, child) of all words through it."""
    steps = walks.select("way", "key", F.explode(F.sequence(F.lit(TOP), F.col("size") - 1)).alias("depth"))
    edges = steps.select(
        "depth",
        _node("way", F.substring("key", F.lit(1), F.col("depth"))).alias("node"),
        F.struct(_letter(F.col("depth")).alias("letter"), _node("way", F.substring("key", F.lit(1), F.col("depth") + 1)).alias("child")).alias("edge"),
    )
    return edges.groupBy("depth", "node").agg(F.collect_set("edge").alias("letters")).sortWithinPartitions("depth")


def _advanced(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """One level: states without an edit take each greater letter, those with one their own.

    Of two words that differ in a letter, the one with the smaller finds the other;
    pairs are turned around at the end.
    """
    own = _letter(F.col("place"))
    allowed = F.filter("letters", lambda e: ((F.col("edits") == 0) & (e["letter"] > own)) | ((F.col("edits") == 1) & (e["letter"] == own)))
    met = states.join(nodes, "node").withColumn("taken", allowed).select("way", "key", "size", "place", F.explode("taken").alias("taken"))
    return met.select("way", "key", "size", (F.col("place") + 1).alias("place"), F.col("taken.child").alias("node"), F.lit(1).alias("edits"))


def walked(words: DataFrame) -> DataFrame:
    """``word, way, node``: candidates of all words, from the frontier's walk through their trie."""
    walks = stage(_walks(words), "spelling-walks")
    nodes = stage(trie(walks), "spelling-trie")
    deepest = walks.agg(F.max("size")).first()[0] or 0
    columns = ["way", "key", "size", "place", "node", "edits"]
    moved, finished = None, []
    for depth in range(TOP, deepest):
        here = walks.where((F.col("start") <= depth) & (F.col("size") > depth)).withColumn("node", _node("way", F.substring("key", 1, depth)))
        unedited = here.select("way", "key", "size", F.lit(depth).alias("place"), "node", F.lit(0).alias("edits"))
        # Leaving out a letter that is followed by an equal one gives what leaving out that one gives.
        shorter = here.where(_letter(F.lit(depth)) != _letter(F.lit(depth + 1))).select(
            "way", "key", "size", F.lit(depth + 1).alias("place"), "node", F.lit(1).alias("edits")
        )
        states = unedited.unionByName(shorter.where(F.col("place") < F.col("size")))
        if moved is not None:
            states = states.unionByName(moved.where(F.col("place") < F.col("size")).select(columns))
        finished.append(shorter.where(F.col("place") == F.col("size")).select("way", "key", "node"))
        moved = stage(_advanced(states, nodes.where(F.col("depth") == depth)), f"spelling-level-{depth}")
        finished.append(moved.where(F.col("place") == F.col("size")).select("way", "key", "node"))
    if not finished:
        return words.select("word", F.lit(0).alias("way"), F.lit(0).cast("bigint").alias("node")).limit(0)
    every = finished[0]
    for part in finished[1:]:
        every = every.unionByName(part)
    return every.select(F.when(F.col("way") == 0, F.col("key")).otherwise(F.reverse("key")).alias("word"), "way", "node")


# --- words beyond the trie


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, place) of each word with the letter at ``place`` left out, and of the whole word at place -1."""
    for batch in batches:
        for ident, word in zip(*[c.to_pylist() for c in batch.columns]):
            letters = np.frombuffer(word.encode("latin-1"), np.uint8)
            size = len(letters)
            up, down = powers(size + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[letters] * up[:size])])
            shorter = mix(sums[:-1] + (sums[-1] - sums[1:]) * down[1] + np.uint64(size - 1)).view(np.int64)
            digests = np.concatenate([mix(sums[-1:] + np.uint64(size)).view(np.int64), shorter])
            last = np.concatenate([[True], letters[1:] != letters[:-1], [True]])[1:]
            ends = np.concatenate([[True], last])
            for start in range(0, size + 1, 1 << 16):
                part = digests[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.arange(start - 1, start - 1 + len(part))), pa.array(ends[start : start + len(part)]), pa.array(np.full(len(part), ident))],
                    schema=_ARROW_LEFT_OUT,
                )


_LEFT_OUT = "digest bigint, place bigint, last boolean, ident bigint"
_ARROW_LEFT_OUT = pa.schema([("digest", pa.int64()), ("place", pa.int64()), ("last", pa.bool_()), ("ident", pa.int64())])


def long_pairs(words: DataFrame) -> DataFrame:
    """``word, near`` candidates among words of at least ``LONG`` letters.

    Words that differ in a letter agree without it, those with an additional one agree
    once it is left out.  Words that agree without the letter at one place
    differ in that letter alone, so there are no more than the alphabet has.
    """
    known = stage(words.select("word", F.xxhash64("word").alias("ident")), "spelling-long")
    keys = stage(known.select("ident", "word").mapInArrow(_left_out, _LEFT_OUT), "spelling-left-out")
    mine, other = keys.alias("a"), keys.alias("b")
    changed = mine.where("place >= 0").join(other.where("place >= 0"), ["digest", "place"]).where("a.ident < b.ident")
    added = mine.where("place >= 0 and last").join(other.where("place = -1"), "digest")
    both = changed.select("a.ident", F.col("b.ident").alias("other")).union(added.select("a.ident", F.col("b.ident").alias("other"))).distinct()
    names = known.select(F.col("ident").alias("other"), F.col("word").alias("near"))
    return both.join(known, "ident").join(names, "other").select("word", "near")


# --- results


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near``: all words one edit apart, each pair in both orders."""
    short = words.where(F.length("word") <= LONG)
    ends = _walks(short).select("way", _node("way", F.col("key")).alias("node"), F.when(F.col("way") == 0, F.col("key")).otherwise(F.reverse("key")).alias("near"))
    found = walked(short).join(ends, ["way", "node"]).select("word", "near")
    if words.where(F.length("word") > LONG).limit(1).count():
        found = found.unionByName(long_pairs(words.where(F.length("word") >= LONG)))
    found = found.where(F.levenshtein("word", "near", 1) == 1)
    pair = F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))))
    return found.select(pair.alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of ``word, form``.

    Each round doubles the way covered; forms grow by ``FACTOR`` a step, so that the rounds
    are as many as the logarithm of a logarithm of the largest count.
    """
    at = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        at = stage(
            at.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("_moved")),
            "spelling-roots",
        )
        if not at.where("_moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of a ``word, n`` table."""
    counted = stage(words, "spelling-words")
    pairs = near_pairs(counted.select("word"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = pairs.join(counted.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(F.count("*").alias("n_near"), best)
    chosen = -F.col("best.less") >= FACTOR * F.col("n")
    rows = stage(
        counted.join(near, "word", "left").select(
            "word",
            F.when(chosen, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(chosen, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-variants",
    )
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
