"""Token counts with a whole-token shortcut.

The driver proves once, by merging each vocabulary string from its bytes, which
strings encode alone as one token.  Pre-tokens in that set count one without any
merging; only the rest are merged, and remembered in bounded memory.

Cases: a null text counts as empty, an empty text has no tokens; special strings
inside texts count one each and split the text, as the library has it by default.
A text of one unbroken piece is merged in n log n time and not remembered.
Rows are independent: repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flamelake.llm import bpe
from flamelake.llm.common import id_text, map_rows


def vocabulary(path: str) -> dict:
    """Merges, special strings and the proven whole tokens of a byte-level .json file."""
    data = bpe.json_vocabulary(path)
    ids, merges = data["ids"], data["merges"].get
    single = [ids[bytes([b])] for b in range(256)]
    whole = bpe.whole_tokens(ids, lambda token: bpe.merge([single[b] for b in token], merges))
    texts = set()
    for token in whole:
        try:
            texts.add(token.decode())
        except UnicodeDecodeError:
            pass  # a part of a character is never a whole pre-token
    return {"merges": data["merges"], "single": single, "whole": texts, "special": data["special"]}


def counter(known: dict, pattern: str, memory: int = bpe.MEMORY):
    """Function from text to number of tokens."""
    merges, single, whole = known["merges"].get, known["single"], known["whole"]

    def of_piece(piece: str) -> int:
        return 1 if piece in whole else len(bpe.merge([single[b] for b in piece.encode()], merges))

    cut, parts = bpe.Cutter(pattern, of_piece, sum, memory), bpe.around(known["special"])
    return lambda text: sum(1 if special else cut(part) for part, special in parts(text))


_KEPT: dict[str, object] = {}


def count(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        if path not in _KEPT:  # a worker keeps what it remembers for its next tasks
            _KEPT[path] = counter(shared.value, pattern)
        tokens = _KEPT[path]

        def work(columns):
            for doc_id, text in zip(*columns, strict=True):
                yield doc_id, len((text or "").encode()), tokens(text or "")

        return work

    counted = map_rows(id_text(docs), make, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
