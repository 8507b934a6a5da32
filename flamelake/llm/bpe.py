"""Byte-pair merges, vocabulary files and the cutting of texts, shared by the two tokenizer operators."""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import regex

#: Segments that one worker remembers at a time; older ones are forgotten and worked out again.
MEMORY = 300_000
#: Longest text in characters that is remembered; longer ones are rare and would fill the memory.
REMEMBERED = 64
#: Longest list of parts in which each merge is searched for from the start.
SCANNED = 32

_UNCLEAR = re.compile(r" (?:\s|$)")


class Memo(dict):
    """Results by text in two generations, so that frequent texts outlive the clearing of rare ones.

    Bounded by the number of texts and by their length, hence by bytes.
    """

    def __init__(self, compute: Callable, limit: int = MEMORY):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) > REMEMBERED:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def merge(parts: list, joined: Callable) -> list:
    """Merge the leftmost pair of lowest rank until none is left; ``joined((a, b))`` gives ``(rank, part)`` or None.

    Short lists are searched for each merge.  Longer ones keep their pairs in a heap
    by rank and place, so that time grows with n log n.
    """
    if len(parts) > SCANNED:
        return _merge_long(parts, joined)
    while len(parts) > 1:
        best = None
        for at in range(len(parts) - 1):
            found = joined((parts[at], parts[at + 1]))
            if found is not None and (best is None or found[0] < best[0]):
                best = (found[0], at, found[1])
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [best[2]]
    return parts


def _merge_long(parts: list, joined: Callable) -> list:
    """``merge`` over a linked list.  A merged pair stays at its left place; its right place becomes None.

    Entries of the heap name the two parts that they were made for and are passed over
    when either has changed since.
    """
    end = len(parts)
    after, before = [*range(1, end + 1)], [*range(-1, end - 1)]

    def pair(left: int, right: int):
        found = joined((parts[left], parts[right]))
        return found and (found[0], left, parts[left], parts[right], found[1])

    heap = [found for at in range(end - 1) if (found := pair(at, at + 1))]
    heapq.heapify(heap)
    while heap:
        _, left, first, second, whole = heapq.heappop(heap)
        right = after[left]
        if right == end or parts[left] != first or parts[right] != second:
            continue
        parts[left], parts[right], after[left] = whole, None, after[right]
        if after[left] < end:
            before[after[left]] = left
            if found := pair(left, after[left]):
                heapq.heappush(heap, found)
        if before[left] >= 0 and (found := pair(before[left], left)):
            heapq.heappush(heap, found)
    return [part for part in parts if part is not None]


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by the public rule: printable Latin-1
    characters stand for themselves, the other bytes follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def json_vocabulary(path: str) -> dict:
    """Ids by bytes, merges ``(id, id) -> (rank, id)`` and special strings of a tokenizer .json file."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters, vocabulary = byte_letters(), data["model"]["vocab"]
    special = [t["content"] for t in data.get("added_tokens", [])]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    return {
        "ids": {bytes(letters[c] for c in k): v for k, v in vocabulary.items() if k not in special},
        "merges": {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)},
        "special": special,
    }


def ranks(path: str) -> dict[bytes, int]:
    """Ids by bytes of a rank file, one base64 string and number a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in file if line.strip()}


class Cutter:
    """Cuts texts at blanks that begin a piece, so that the results of whole segments can be remembered.

    Before a blank that a visible character follows there is always a piece
    border: no alternative of the pattern holds a blank after its first
    character but runs of white space, and those give their last blank back.
    A text with other blanks is taken piece by piece.
    """

    def __init__(self, pattern: str, of_piece: Callable, join: Callable, memory: int = MEMORY):
        self.find = regex.compile(pattern).findall
        # Frequent pieces are enough here: whole segments are remembered beside them.
        self.pieces = Memo(of_piece, memory // 8)
        self.join = join
        self.after_blank = Memo(lambda rest: self.direct(" " + rest), memory)

    def direct(self, text: str):
        return self.join(map(self.pieces.__getitem__, self.find(text)))

    def __call__(self, text: str):
        if _UNCLEAR.search(text):
            return self.direct(text)
        first, *rest = text.split(" ")
        return self.join((self.direct(first), self.join(map(self.after_blank.__getitem__, rest))))


def around(special: list[str]) -> Callable[[str], Iterator[tuple[str, bool]]]:
    """Split a text into ordinary parts and special strings (flagged), longest match first."""
    strings = sorted(special, key=len, reverse=True)
    if not strings:
        return lambda text: iter([(text, False)])
    split = re.compile("(" + "|".join(map(re.escape, strings)) + ")").split

    def parts(text: str) -> Iterator[tuple[str, bool]]:
        if not any(s in text for s in strings):
            return iter([(text, False)])
        return ((part, bool(n % 2)) for n, part in enumerate(split(text)))

    return parts


def whole_tokens(ids: dict[bytes, int], encode: Callable[[bytes], list[int]]) -> Iterable[bytes]:
    """The vocabulary strings that provably encode alone as their own token."""
    return (token for token, number in ids.items() if encode(token) == [number])
