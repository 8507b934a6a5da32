"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages, runs of ``PASSAGE`` words that cover the whole
text.  Each passage becomes statistics of its bytes and words: shares of pairs of
neighbouring byte classes, repeated words, word lengths.  A small encoder maps
them to a vector, gated attention weighs the passages of a document, and the
weighted mean is scored.  Weights of passages are learned from document labels
alone.

Passage statistics of the labelled rows are made in Spark; the fit takes at most
``FIT_DOCS`` documents, chosen by a hash of the id, with all their passages.  Where
these are more than ``FIT_PASSAGES`` together, fewer documents are taken, in the order
of the hash and one of each label at least.  Scoring reads whole texts.

Cases: a null text counts as empty; a text without words is one passage without
content and gets a score like any other; without labelled rows, or with one label
only, every score is the share of label 1 (one half without labels).  Rows are
judged alone: repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flamelake.llm import hashing
from flamelake.llm.common import map_rows, stage

PASSAGE = 64
#: Bounds of the sample that a model is fitted on: documents, and passages of all of them.
FIT_DOCS, FIT_PASSAGES = 8000, 1 << 20
WIDTH, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 24, 12, 30, 128, 0.01, 1e-4

#: Byte classes: lower, upper, digit, blank, line end, marks of prose, symbols, beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
for _n, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 11, 12, 13), b".,;:?'\"()-")):
    _CLASS[[*_members]] = _n
_CLASS[128:] = 7
FEATURES = 64 + 5


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all passages in a row and the number of passages of each text (one at least)."""
    encoded = [(t or "").encode() for t in texts]
    # A line end after every text, also the last: a text's statistics don't depend on its neighbours.
    data = np.frombuffer(b"".join(e + b"\n" for e in encoded), np.uint8)
    first, end = hashing.word_bounds(data)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    doc = np.searchsorted(ends, first, side="right")
    words = np.bincount(doc, minlength=len(texts)).astype(np.int64) if len(first) else np.zeros(len(texts), np.int64)
    counts = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((base[-1], FEATURES), np.float32)
    if not len(first):
        return out, counts
    before = np.concatenate([[0], np.cumsum(words)])
    of_word = base[doc] + (np.arange(len(first)) - before[doc]) // PASSAGE
    # A byte belongs to the passage of the last word begun in its text, before any word to the first one.
    of_byte = of_word[np.maximum(0, np.searchsorted(first, np.arange(len(data)), side="right") - 1)]
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    of_byte = np.maximum(of_byte, base[text_of])
    codes = _CLASS[data]
    same = (of_byte[1:] == of_byte[:-1]) & (words[text_of[1:]] > 0)
    pair = codes[:-1].astype(np.int64) * 8 + codes[1:]
    shares = np.bincount(of_byte[1:][same] * 64 + pair[same], minlength=len(out) * 64).reshape(len(out), 64)
    total = np.maximum(1, shares.sum(axis=1))
    held = np.bincount(of_word, minlength=len(out))
    size = np.maximum(1, held)
    hashes, lengths = hashing.span_hashes(data, first, end), end - first
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])])
    order = np.lexsort((hashes, of_word))
    fresh = np.concatenate(
        [[True], (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])]
    )
    out[:, :64] = np.sqrt(shares / total[:, None])
    out[:, 64] = np.bincount(of_word, weights=again, minlength=len(out)) / size
    out[:, 65] = np.bincount(of_word[order], weights=fresh, minlength=len(out)) / size
    out[:, 66] = np.log1p(np.bincount(of_word, weights=lengths, minlength=len(out)) / size)
    out[:, 67] = np.bincount(of_word, weights=lengths > 20, minlength=len(out)) / size
    out[:, 68] = held / PASSAGE
    return out, counts


def sample(labels: DataFrame, docs: int) -> DataFrame:
    """``doc_id, label`` of at most ``docs`` labelled documents, half of each label, chosen by a hash of the id."""
    usable = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    halves = [usable.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs // 2) for x in (0, 1)]
    return halves[0].unionByName(halves[1])


def _last_places(sampled) -> dict[int, int]:
    """Last place of each label, in the order of the hash, up to which half of ``FIT_PASSAGES`` has room."""
    last = {}
    for label, own in sampled.sort_values("place").groupby("label"):
        room = own["passages"].cumsum().to_numpy() <= FIT_PASSAGES // 2
        last[int(label)] = int(own["place"].iloc[max(0, int(room.sum()) - 1)])
    return last


def fit(docs: DataFrame, labels: DataFrame, size: int = FIT_DOCS, seed: int = 7) -> dict:
    """Model from ``doc_id, text`` and ``doc_id, label``.

    The sample has ``size`` rows of two numbers at most, so it is broadcast; texts are read in place.
    Their passages are written, and of these the chosen documents' are gathered whole.
    """
    totals = {r["label"]: r["count"] for r in labels.where("label in (0, 1)").groupBy("label").count().collect()}
    if not totals:
        return {"constant": 0.5}

    def make():
        def work(columns):
            texts, labels, places = columns
            made, counts = passages(texts)
            at = 0
            for label, place, count in zip(labels, places, counts.tolist(), strict=True):
                own = made[at : at + count]
                at += count
                yield int(label), place, count, own.astype("<f4").tobytes()

        return work

    rows = docs.select("doc_id", "text").join(F.broadcast(sample(labels, size)), "doc_id")
    rows = rows.select("text", "label", F.xxhash64("doc_id").alias("place"))
    made = stage(map_rows(rows, make, "label int, place bigint, passages bigint, bag binary", 512), "bags")
    last = _last_places(made.groupBy("label", "place").agg(F.sum("passages").alias("passages")).toPandas())
    chosen = [(F.col("label") == label) & (F.col("place") <= place) for label, place in last.items()]
    bags = made.where(reduce(Column.__or__, chosen, F.lit(False))).select("label", "bag").toPandas()
    bags = bags.iloc[np.argsort([b[:4096] for b in bags["bag"]], kind="stable")] if len(bags) else bags
    labels = bags["label"].to_numpy(np.float64)
    share = totals.get(1, 0) / sum(totals.values())
    if len(set(labels)) < 2:
        return {"constant": share}
    return train([np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in bags["bag"]], labels, share, seed)


def _forward(model: dict, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> dict:
    h = np.tanh(x @ model["encode"] + model["encode_b"])
    t = np.tanh(h @ model["focus"])
    g = 1 / (1 + np.exp(-(h @ model["gate"])))
    e = (t * g) @ model["weigh"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[of])
    a = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ model["out"] + model["out_b"])))}


def train(bags: list[np.ndarray], labels: np.ndarray, share: float, seed: int) -> dict:
    """Encoder, gated attention and score by Adam on weighted cross-entropy."""
    rng = np.random.default_rng(seed)
    # One bag at a time: all passages in eight bytes would be a second copy of the sample.
    count = sum(map(len, bags))
    center = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / count
    scale = np.sqrt(sum(((b - center) ** 2).sum(axis=0) for b in bags) / count) + 1e-3
    shapes = {
        "encode": (FEATURES, WIDTH), "encode_b": (WIDTH,), "focus": (WIDTH, ATTENTION), "gate": (WIDTH, ATTENTION),
        "weigh": (ATTENTION,), "out": (WIDTH,), "out_b": (1,),
    }
    model = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if not k.endswith("_b") else np.zeros(s) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            sizes = np.array([len(bags[n]) for n in part])
            starts, of = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(part)), sizes)
            x = (np.concatenate([bags[n] for n in part]) - center) / scale
            f = _forward(model, x, starts, of)
            error = (f["p"] - labels[part]) * weight[part] / len(part)
            dz = error[:, None] * model["out"]
            da = (dz[of] * f["h"]).sum(axis=1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[of])
            both = de[:, None] * model["weigh"]
            dt, dg = both * f["g"] * (1 - f["t"] ** 2), both * f["t"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dz[of] + dt @ model["focus"].T + dg @ model["gate"].T
            dx = dh * (1 - f["h"] ** 2)
            slopes = {
                "encode": x.T @ dx, "encode_b": dx.sum(axis=0), "focus": f["h"].T @ dt, "gate": f["h"].T @ dg,
                "weigh": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ error, "out_b": error.sum(keepdims=True),
            }
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, slope in slopes.items():
                slope = slope + DECAY * model[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                model[k] = model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    # The weights of the labels are taken back, so that scores are probabilities.
    model["out_b"] = model["out_b"] + np.log(share / (1 - share))
    return model | {"center": center, "scale": scale}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score, attention``: score 0 to 1 and the weight of every passage, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def work(columns):
            ids, texts = columns
            if "constant" in known:
                yield from ((i, known["constant"], []) for i in ids)
                return
            made, counts = passages(texts)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            f = _forward(known, (made - known["center"]) / known["scale"], starts, np.repeat(np.arange(len(ids)), counts))
            weights = np.split(f["a"].astype(np.float32), starts[1:])
            for doc_id, p, own in zip(ids, f["p"].tolist(), weights, strict=True):
                yield doc_id, p, own.tolist()

        return work

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "doc_id bigint, score double, attention array<float>", 256)
