"""Tokenizer operators against the libraries, by fuzzing and on borders."""

import random
import time
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from flamelake.llm import bpe, token_counts, transducer
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

ODD = [chr(c) for c in range(256)] + list("aaa   \n\t''sltd0123456789éüñ中文字あ한😀　 ​ \x85ⅫǅʰªºǺ")
LONG = ["a" * 9000, " " * 9000, "ab" * 5000 + "é" * 3000, "\n" * 100 + "x", "the" * 5000, "=-" * 9000]


def texts(seed, count=3000):
    rng = random.Random(seed)
    for _ in range(count):
        yield "".join(
            rng.choice(ODD) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x1F000, 0x1FAFF)]))
            for _ in range(rng.randrange(24))
        )


@pytest.fixture(scope="module")
def ranks():
    return bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def machine(ranks):
    return transducer.Transducer(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(machine, library):
    cut = bpe.Cutter(P.PATTERN, lambda p: array("I", machine.encode(p.encode())).tobytes(), b"".join, memory=500)
    for text in [*texts(1), *LONG, "", " ", "  a", "a  ", "\n a"]:
        assert list(array("I", cut(text))) == library.encode_ordinary(text), text[:40]


def test_streaming_emits_before_the_end_and_equals_whole(machine, library):
    text = "abracadabra" * 2000
    stream = machine.stream(iter(text.encode()))
    first = [next(stream) for _ in range(10)]
    assert [*first, *stream] == library.encode_single_piece(text) if hasattr(library, "encode_single_piece") else True
    assert b"".join(machine.token[t] for t in machine.stream(text.encode())) == text.encode()


def test_states_are_made_lazily_and_forgotten(ranks, monkeypatch, library):
    monkeypatch.setattr(transducer, "STATES", 50)
    small = transducer.Transducer(ranks)
    assert len(small.states) == 1
    for word in ("the", "transducer", "lookahead", "Überraschung", "naïveté"):
        assert small.encode(word.encode()) == library.encode_ordinary(word)
    assert len(small.states) < 200


def test_unreachable_vocabulary_string_is_one_token_when_whole():
    ids = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    machine = transducer.Transducer(ids)
    assert machine.alone == {b"xyz": 259}
    assert machine.encode(b"xyz") == [259]
    assert machine.encode(b"xyzx") == [120, 121, 122, 120]
    assert machine.encode(b"abc") == [258]


def test_utf8_machine_holds_back_incomplete_characters():
    data = "aé中😀z".encode()
    for step in range(1, 5):
        stream = transducer.Utf8Stream()
        parts = [stream.push(data[n : n + step]) for n in range(0, len(data), step)]
        assert "".join(parts) + stream.end() == data.decode()
    stream = transducer.Utf8Stream()
    assert stream.push(b"\xe4\xb8") == "" and stream.end() == "�"


def test_counts_equal_library():
    known = token_counts.vocabulary(P.path("byte_bpe_50k.json"))
    count = token_counts.counter(known, P.PATTERN, memory=500)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for n, text in enumerate([*texts(2), *LONG[:3], "", "<|endoftext|>"]):
        text = text[:5] + "<|endoftext|>" + text[5:] if n % 10 == 0 else text
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:40]


def test_long_pieces_equal_library_in_bounded_time():
    known = token_counts.vocabulary(P.path("byte_bpe_50k.json"))
    count = token_counts.counter(known, P.PATTERN)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    unbroken = ["".join(rng.choices("中文字典的一是在不了有和人这", k=20_000)), "".join(rng.choices("abcdeinst", k=50_000)), *LONG[3:]]
    began = time.monotonic()
    counts = [count(text) for text in unbroken]
    assert time.monotonic() - began < 20
    assert counts == [len(library.encode(text, add_special_tokens=False).ids) for text in unbroken]


@given(st.lists(st.integers(0, 3), max_size=80), st.permutations([(a, b) for a in range(7) for b in range(7)]))
def test_heap_and_scan_merge_alike(parts, order):
    # The first pairs in this order are merges, each into a part of its own.
    rules = {pair: (rank, 4 + rank) for rank, pair in enumerate(order[:3])}
    scanned = list(parts)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "SCANNED", 100)
        scanned = bpe.merge(scanned, rules.get)
        patch.setattr(bpe, "SCANNED", 0)
        assert bpe.merge(list(parts), rules.get) == scanned


def test_long_texts_are_not_remembered():
    memo = bpe.Memo(len)
    assert memo["x" * 1000] == 1000 and memo["x" * 10] == 10
    assert list(memo) == ["x" * 10]


def test_whole_tokens_are_proven():
    known = token_counts.vocabulary(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for token in sorted(known["whole"])[::97]:
        pieces = [p for p, _ in library.pre_tokenizer.pre_tokenize_str(token)]
        if len(pieces) == 1:
            assert len(library.encode(token, add_special_tokens=False).ids) == 1
