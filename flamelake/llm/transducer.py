"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly if every adjacent pair
of tokens encodes to itself.  So each prefix of a piece has one last token, and
the transducer only follows the places where a token may still begin: those from
which the bytes read since spell a path in the vocabulary.  These are the
suffixes of the longest such path, that is an Aho-Corasick node and its failure
chain.  A state is that node with the last token before each place; states and
transitions are made when a text first needs them and are kept in bounded memory.
A token is emitted once all living places have it behind them; no place lies
further back than the longest vocabulary string.

A vocabulary string that merges don't reach is still one token when it is a
whole piece; those few strings are listed apart.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flamelake.llm import bpe
from flamelake.llm.common import id_text, map_rows

#: States and pair verdicts that one worker keeps.
STATES, PAIRS = 200_000, 100_000
#: Bytes of one piece between two emissions.
EMIT_EVERY = 4096


class Transducer:
    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        self.token = {number: token for token, number in ids.items()}
        self.size = {number: len(token) for token, number in ids.items()}
        self.last_rank = max(self.token)
        #: The two tokens that the last merge of a token joins.
        self.halves: dict[int, tuple[int, int]] = {}
        self.alone: dict[bytes, int] = {}
        for token, number in ids.items():
            if len(token) > 1 and self._merged(token) != [number]:
                self.alone[token] = number
        self._vocabulary_paths([t for t in ids if t not in self.alone])
        self.pairs = bpe.Memo(self._stays, PAIRS)
        self._forget()

    def _merged(self, text: bytes) -> list[int]:
        """Plain merging of one vocabulary string; notes its halves."""
        get, numbers = self.ids.get, self.ids

        def joined(pair):
            both = pair[0] + pair[1]
            rank = get(both)
            if both == text:
                self.halves[rank] = numbers[pair[0]], numbers[pair[1]]
            return None if rank is None else (rank, both)

        return [numbers[p] for p in bpe.merge([text[n : n + 1] for n in range(len(text))], joined)]

    def _stays(self, pair: tuple[int, int]) -> bool:
        """Do two tokens side by side encode to themselves?

        Their merges are undone from the latest to the earliest.  If the parts
        that then touch could merge before the merge just undone, that merge
        would have come first.  Of equal ranks the left one comes first.
        """
        left, right = pair
        before = self.last_rank + 1
        while True:
            rank = self.ids.get(self.token[left] + self.token[right])
            if rank is not None and rank < before:
                return False
            late, early = self.halves.get(left), self.halves.get(right)
            if late is not None and (early is None or left > right):
                before, left = left, late[1]
            elif early is not None:
                before, right = right + 1, early[0]
            else:
                return True

    def _vocabulary_paths(self, tokens: list[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.ends, self.depth = [None], [0]
        for token in tokens:
            node = 0
            for byte in token:
                child = self.next[node].get(byte)
                if child is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = child
            self.ends[node] = self.ids[token]
        self.fail = [0] * len(self.next)
        queue = [*self.next[0].values()]
        for node in queue:
            for byte, child in self.next[node].items():
                back = self.fail[node]
                while back and byte not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(byte, 0) if node else 0
                queue.append(child)

    def _forget(self) -> None:
        self.states: list[tuple[int, tuple]] = [(0, (None,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and the last token after ``byte``; last tokens run from the longest path's start to here."""
        node, before = self.states[state]
        places = {}
        at = node
        for last in before:
            places[self.depth[at]] = last
            at = self.fail[at]
        target = node
        while target and byte not in self.next[target]:
            target = self.fail[target]
        target = self.next[target][byte]
        at, found = target, None
        while at and found is None:
            token = self.ends[at]
            if token is not None and self.depth[at] - 1 in places:
                last = places[self.depth[at] - 1]
                if last is None or self.pairs[last, token]:
                    found = token
            at = self.fail[at]
        chain, at = [], target
        while at:
            chain.append(places[self.depth[at] - 1])
            at = self.fail[at]
        key = (target, (*chain, found))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = number, found
        return number, found

    def _walk(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= self.size[lasts[end - 1]]
        return out[::-1]

    def _settled(self, lasts: list[int], state: int) -> int:
        """Length of the prefix whose tokens all living places have behind them."""
        node, common = self.states[state][0], None
        while True:
            ends, at = {0}, len(lasts) - self.depth[node]
            while at:
                ends.add(at)
                at -= self.size[lasts[at - 1]]
            common = ends if common is None else common & ends
            if not node:
                return max(common)
            node = self.fail[node]

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Tokens of one piece, emitted while its bytes arrive."""
        if len(self.states) > STATES:
            self._forget()
        state, lasts, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            state, last = move if move is not None else self._move(state, byte)
            lasts.append(last)
            if len(lasts) >= EMIT_EVERY:
                done = self._settled(lasts, state)
                yield from self._walk(lasts, done)
                del lasts[:done]
        yield from self._walk(lasts, len(lasts))

    def encode(self, piece: bytes) -> list[int]:
        number = self.alone.get(piece)
        if number is not None:
            return [number]
        if len(piece) >= EMIT_EVERY:
            return [*self.stream(piece)]
        if len(self.states) > STATES:
            self._forget()
        state, lasts, get = 0, [], self.moves.get
        for byte in piece:
            move = get(state << 8 | byte)
            state, last = move if move is not None else self._move(state, byte)
            lasts.append(last)
        return self._walk(lasts, len(lasts))


class Utf8Stream:
    """Incremental UTF-8 machine: bytes in, whole characters out; at most three bytes wait for the rest."""

    def __init__(self):
        self.waiting = b""

    def push(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a lead byte: is its character complete?
                if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], token: dict[int, bytes], step: int = 8192) -> Iterator[str]:
    """Text of a stream of ids in pieces of whole characters."""
    machine = Utf8Stream()
    for part in batched(ids, step):
        yield machine.push(b"".join(map(token.__getitem__, part)))
    yield machine.end()


_KEPT: dict[str, object] = {}


def _machine(shared) -> Transducer:
    """The worker's machine, kept for its next tasks."""
    ids = shared.value
    key = hashlib.sha256(repr(sorted(ids.items())[:: max(1, len(ids) // 997)]).encode()).hexdigest()
    if key not in _KEPT:
        _KEPT[key] = Transducer(ids)
    return _KEPT[key]


def encode(docs: DataFrame, ids: dict[bytes, int], pattern: str, keep: bool = True, decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids.  With ``keep`` a worker keeps its
    states and segments for its next tasks, else they go with the task.  With ``decoded``
    the same worker decodes the ids: ``text`` as ``decode`` gives it, without a second worker a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def make():
        machine = _machine(shared) if keep else Transducer(shared.value)
        if not hasattr(machine, "cut"):
            memory = bpe.MEMORY if keep else bpe.MEMORY // 3
            machine.cut = bpe.Cutter(pattern, lambda p: array("I", machine.encode(p.encode())).tobytes(), b"".join, memory)

        def work(columns):
            for doc_id, text in zip(*columns, strict=True):
                packed = machine.cut(text or "")
                back = ("".join(decode_stream(array("I", packed), machine.token)),) if decoded else ()
                yield doc_id, len(packed) // 4, packed, *back

        return work

    return map_rows(id_text(docs), make, "doc_id bigint, n_tokens bigint, ids binary" + ", text string" * decoded, 128)


def decode(encoded: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """``doc_id, n_tokens, ids, text`` of packed ids; a null or empty value gives an empty text."""
    token = {number: text for text, number in ids.items()}
    shared = encoded.sparkSession.sparkContext.broadcast(token)

    def make():
        def work(columns):
            for doc_id, n_tokens, packed in zip(*columns, strict=True):
                numbers = array("I", packed or b"")
                yield doc_id, n_tokens, packed, "".join(decode_stream(numbers, shared.value))

        return work

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return map_rows(rows, make, "doc_id bigint, n_tokens bigint, ids binary, text string", 128)


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
