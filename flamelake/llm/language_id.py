"""Language identification of spans: script ranges, per-word scores, Viterbi with a switching penalty.

The script of a word leaves the languages seen in that script as candidates.
Each candidate's score of the word is the sum of the log frequencies of its
3-byte sequences, border marks included.  A Viterbi pass over the words of a
text, in which a change of language costs ``penalty``, labels spans; the text's
language is the one with most letters.

Every language of the labelled rows is learned.  Fitting counts sequences in a
sample of these rows, at most about ``FIT_ROWS`` documents of each language and
``FIT_TOTAL`` of all, chosen by a hash of the text; with many languages each has an
equal part of the total, ``LEAST_ROWS`` at least.  Counting runs in Spark and only
the table of counts (``BUCKETS`` a language) is gathered.

Cases: a null text or one without a letter has no span and language ``und``;
words in a script that no learned language uses leave all languages as
candidates; equal sums choose the first language by name; without any labelled
row all texts are ``und``.  Rows are judged alone: repeated rows, null ids and
extra columns change nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.llm.common import map_rows

#: Labelled documents that a model is fitted on: most of each language, most of all, least of each that has so many.
FIT_ROWS, FIT_TOTAL, LEAST_ROWS = 20_000, 2_400_000, 100
BUCKETS = 1 << 16
PENALTY = 12.0
#: Share of a language's words in a script that makes it a candidate there.
SCRIPT_SHARE = 0.005
#: Characters of text that are labelled together, times languages; a longer text is labelled alone.
CELLS = 1 << 25

#: First code point of each script range, by the Unicode blocks.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"),
    (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "other"), (0x20000, "han"),
)
_STARTS, _NAMES = [s for s, _ in SCRIPTS], sorted({n for _, n in SCRIPTS})
_SCRIPT = [_NAMES.index(n) for _, n in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> int:
    return _SCRIPT[bisect_right(_STARTS, ord(word[0])) - 1]


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-byte sequences of all words in a row, and where each word's begin."""
    data = np.frombuffer(("_" + "_".join(words) + "_").encode(), np.uint8).astype(np.uint32)
    marks = np.flatnonzero(data == 0x5F)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    inner = data[1:-1] != 0x5F  # a mark in the middle belongs to two words
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)[inner]
    before = np.concatenate([[0], np.cumsum(inner)])
    return bucket, before[marks[:-1]]


def lowered(text: str | None) -> str:
    """Lower case of the same length: one letter alone would become two characters."""
    return (text or "").replace("\u0130", "i").lower()


def lettered(word: str) -> bool:
    """Numerals such as fractions are word characters too; alone they are no word."""
    return word.isalpha() or any(map(str.isalpha, word))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lowered(text))


def sample(labelled: DataFrame, rows: int) -> tuple[list[str], DataFrame]:
    """All languages by name, and ``text, n`` of a sample of their rows, chosen by a hash of the text.

    ``n`` is the language's place; each has about ``rows`` rows at most, or its part of ``FIT_TOTAL``.
    """
    usable = labelled.where("text is not null and lang is not null").select("text", "lang")
    counts = sorted((r["lang"], r["count"]) for r in usable.groupBy("lang").count().collect())
    each = min(rows, max(LEAST_ROWS, FIT_TOTAL // max(1, len(counts))))
    shares = [(lang, n, min(1.0, each / count)) for n, (lang, count) in enumerate(counts)]
    table = labelled.sparkSession.createDataFrame(shares, "lang string, n int, share double")
    chosen = usable.join(F.broadcast(table), "lang").where(
        F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    )
    return [lang for lang, _ in counts], chosen.select("text", "n")


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """Languages, log frequencies (language by bucket) and candidates (script by language)."""
    names, chosen = sample(labelled, rows)

    def make():
        def work(columns):
            own: dict[int, list[str]] = {}
            for text, n in zip(*columns, strict=True):
                if found := [w for w in words_of(text) if lettered(w)]:
                    own.setdefault(n, []).extend(found)
            for n, found in own.items():
                sums = np.bincount(sequences(found)[0], minlength=BUCKETS + len(_NAMES))
                sums[BUCKETS:] += np.bincount([script_of(w) for w in found], minlength=len(_NAMES))
                for bucket in np.flatnonzero(sums).tolist():
                    yield n, bucket, int(sums[bucket])

        return work

    counted = map_rows(chosen, make, "lang int, bucket int, n bigint", 4096)
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    table = table.sort_values("lang", kind="stable")
    found, first = np.unique(table["lang"].to_numpy(), return_index=True)
    logs, candidates = np.empty((BUCKETS, len(found)), np.float32), np.empty((len(_NAMES), len(found)), bool)
    # One language at a time: only the table of 4-byte values grows with their number.
    for k, (start, end) in enumerate(zip(first, [*first[1:], len(table)], strict=True)):
        part = table.iloc[start:end]
        counts = np.bincount(part["bucket"], weights=part["n"], minlength=BUCKETS + len(_NAMES))
        grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
        logs[:, k] = np.log(grams / grams.sum())
        candidates[:, k] = scripts / max(scripts.sum(), 1) >= SCRIPT_SHARE
    return {"langs": [names[n] for n in found], "logs": logs, "candidates": candidates}


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Score of every word (row) in every language; no candidate: far below the others."""
    bucket, starts = sequences(words)
    scores = np.add.reduceat(model["logs"][bucket], starts, axis=0)
    open_to = model["candidates"][[script_of(w) for w in words]]
    open_to[~open_to.any(axis=1)] = True
    best = np.where(open_to, scores, -np.inf).max(axis=1, keepdims=True)
    return np.where(open_to, scores - best, np.float32(-1e4)).astype(np.float32)


def viterbi(docs: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best language of every word; all documents advance together, the longest first."""
    order = sorted(range(len(docs)), key=lambda n: -len(docs[n]))
    lengths = np.array([len(docs[n]) for n in order])
    flat = np.concatenate([docs[n] for n in order]) if order else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    size = scores.shape[1]
    stays, tops = np.empty((len(flat), size), bool), np.empty(len(flat), np.int32)
    value = np.zeros((len(order), size), np.float32)
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    for step, count in enumerate(active.tolist()):
        at = starts[:count] + step
        own = value[:count]
        top = own.argmax(axis=1)
        moved = own[np.arange(count), top][:, None] - np.float32(penalty)
        stays[at], tops[at] = own >= moved, top
        value[:count] = np.maximum(own, moved) + scores[flat[at]]
    label = np.empty(len(flat), np.int32)
    current = value.argmax(axis=1)
    for step in range(len(active) - 1, -1, -1):
        count = active[step]
        at = starts[:count] + step
        label[at] = now = current[:count]
        current[:count] = np.where(stays[at, now], now, tops[at])
    out: list[np.ndarray] = [label[:0]] * len(docs)
    for place, n in enumerate(order):
        out[n] = label[starts[place] : starts[place] + lengths[place]]
    return out


def _labelled(texts: list[str], model: dict, penalty: float):
    """Spans and letters by language of each text."""
    seen: dict[str, int] = {}
    docs = [np.array([seen.setdefault(w, len(seen)) for w in words_of(t)], np.int64) for t in texts]
    words = [*seen]
    empty = [n for n, w in enumerate(words) if not lettered(w)]
    if empty:
        docs = [d[~np.isin(d, empty)] for d in docs]
    if len(empty) == len(words):
        return [([], []) for _ in texts]
    letters = np.array([len(w) for w in words])
    labels = viterbi(docs, word_scores(words, model), penalty)
    out = []
    for text, doc, label in zip(texts, docs, labels, strict=True):
        sums = np.bincount(label, weights=letters[doc], minlength=len(model["langs"]))
        shares = sorted(
            ({"lang": model["langs"][n], "letters": int(sums[n])} for n in np.flatnonzero(sums)),
            key=lambda x: (-x["letters"], x["lang"]),
        )
        cuts = np.flatnonzero(np.diff(label)) + 1 if len(label) else []
        spans = []
        if len(cuts):
            places = [m.start() for m in _WORD.finditer(lowered(text)) if lettered(m[0])]
            borders = [0, *[places[c] for c in cuts], len(text)]
            firsts = [0, *cuts]
            spans = [
                {"first": borders[n], "end": borders[n + 1], "lang": model["langs"][label[f]]} for n, f in enumerate(firsts)
            ]
        elif len(label):
            spans = [{"first": 0, "end": len(text), "lang": model["langs"][label[0]]}]
        out.append((spans, shares))
    return out


def spans(docs: DataFrame, model: dict | None, penalty: float = PENALTY) -> DataFrame:
    """``doc_id, spans, shares``: character ranges with a language, and letters by language, most first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = (
        "doc_id bigint, spans array<struct<first:bigint,end:bigint,lang:string>>, "
        "shares array<struct<lang:string,letters:bigint>>"
    )

    def make():
        known = shared.value
        most = CELLS // len(known["langs"]) if known else CELLS

        def work(columns):
            ids, texts = columns
            start, size = 0, 0
            for n in range(len(ids) + 1):
                if n == len(ids) or size > most:
                    part = [t or "" for t in texts[start:n]]
                    made = _labelled(part, known, penalty) if known else [([], [])] * len(part)
                    yield from ((i, *m) for i, m in zip(ids[start:n], made, strict=True))
                    start, size = n, 0
                size += len(texts[n] or "") if n < len(ids) else 0

        return work

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, schema, 16384)


def predicted(labelled: DataFrame) -> tuple[Column, Column]:
    """Language and score (its share of all letters) from ``shares``."""
    total = F.aggregate("shares", F.lit(0).cast("bigint"), lambda n, s: n + s["letters"])
    top = F.get(F.col("shares"), F.lit(0))
    return F.coalesce(top["lang"], F.lit("und")), F.when(total > 0, top["letters"] / total).otherwise(F.lit(0.0))
