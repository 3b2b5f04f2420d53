"""Token counts and the codec against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from salesloom.llm import bpe, bpe_codec, token_count
from salesloom.llm.common import slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = list(" \n\t\r  'abstdmlrevLRE012!?.éß漢字🙂́²½Ⅷ\x1c\x85​")
SCHEMA = "doc_id long, text string, _text string, ids string"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    out += ["".join(r.choice("aeinorstthe ") for _ in range(200)) for _ in range(100)]
    out += ["", " ", "<|endoftext|>", "a<|endoftext|>  b <|endoftext|><|endoftext|>", "x" * 5000, " " * 999 + "x", "aaaaaaab" * 500]
    return out


def test_words_are_cut_as_the_library_does(library, texts):
    letters = bpe.byte_letters()
    data, offsets, first = bpe.split_words(texts)
    words = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    for i, text in enumerate(texts):
        expected = [bytes(letters[c] for c in w) for w, _ in library.pre_tokenizer.pre_tokenize_str(text)]
        assert words[first[i] : first[i + 1]] == expected


def test_ids_and_text_as_the_library_gives_them(library, texts):
    for a, b in slices([len(t) for t in texts], 10_000):
        for text, packed in zip(texts[a:b], bpe_codec.encode_texts(texts[a:b], PATH)):
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(packed, "<u4").tolist() == ids
            assert bpe_codec.decode_ids(packed, PATH) == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("chunk_bytes", [16_384, 64, 5])
def test_counts_do_not_depend_on_chunks(library, texts, chunk_bytes):
    some = [t[:400] for t in texts]
    expected = [(len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in some]
    assert token_count.count_texts(some, PATH, chunk_bytes) == expected


def test_state_maps_compose_in_any_grouping():
    machine = token_count.Transducer(bpe.vocabulary(PATH))
    state, n = machine.run(machine.start, b"tionha")
    maps = [
        token_count.StateMap(b"ing", 4, state),
        token_count.StateMap(b"there"),
        token_count.StateMap(b"by", n, machine.run(machine.start, b" wh")[0]),
        token_count.StateMap(b"", 2, state),
    ]
    a, b, c, d = maps
    left = a.then(b, machine).then(c, machine).then(d, machine)
    right = a.then(b.then(c.then(d, machine), machine), machine)
    assert left == right == token_count.prefix_scan(maps, machine)[-1]


def test_a_full_state_table_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    machine = token_count.Transducer(bpe.vocabulary(PATH))
    r = random.Random(2)
    for _ in range(300):
        word = "".join(r.choice("aeinorstth") for _ in range(r.randint(1, 30)))
        assert machine.run(machine.start, word.encode())[1] == len(library.encode(word, add_special_tokens=False).ids)


def test_decode_replaces_broken_utf8():
    vocab = bpe.vocabulary(PATH)
    lead = next(t for t, raw in vocab.bytes_of.items() if raw == b"\xc3")
    assert bpe_codec.decode_ids(lead.to_bytes(4, "little"), PATH) == "�"


ROWS = [(1, None, "x", "y"), (2, "", None, None), (2, "", None, None), (None, "hello <|endoftext|> there", "", ""), (5, "don't " * 9000, "z", None)]


def test_rows_with_nulls_repeats_and_clashing_names(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    expected = sorted(
        ((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS), key=str
    )
    got = token_count.token_counts(docs, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=str) == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.collect())

    rows = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.decoded, r.n_tokens) for r in rows), key=str) == sorted(
        ((i, t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS), key=str
    )
    digests = bpe_codec.round_trip(docs, PATH).collect()
    assert sorted(r.decoded_sha256 for r in digests) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
    assert sorted(r.ids_sha256 for r in digests) == sorted(
        hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for _, t, *_ in ROWS
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert token_count.token_counts(docs, PATH).count() == 0
    assert bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH).count() == 0
    assert bpe_codec.round_trip(docs, PATH).count() == 0


def test_one_word_of_ten_megabytes_is_counted_in_linear_time(library):
    import time

    small = ["ab" * 40_000 + " c", "x" + "é" * 30_000, "a " + "b" * 70_000]
    assert token_count.count_texts(small, PATH, 64) == [(len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in small]
    begin = time.process_time()
    ((size, tokens),) = token_count.count_texts(["a" * 10_000_000], PATH, 16_384)
    assert size == 10_000_000 and 0 < tokens < size and time.process_time() - begin < 60


def test_the_tree_gives_the_end_of_the_scan():
    machine = token_count.Transducer(token_count.vocabulary(PATH))
    maps = [token_count.StateMap(b) for b in (b"th", b"er", b"e", b"", b"fore", b"in", b"g")]
    maps.insert(3, token_count.StateMap(b"x", 2, machine.run(machine.start, b" wor")[0]))
    for n in range(1, len(maps) + 1):
        assert token_count.composed(maps[:n], machine) == token_count.prefix_scan(maps[:n], machine)[-1]


def test_a_words_last_byte_makes_no_state(library):
    machine = token_count.Transducer(bpe.vocabulary(PATH))
    words = [b" zqxv" + bytes([c]) for c in range(0x61, 0x7B)]
    machine.run(machine.start, b" zqxv")
    before = len(machine.states)
    expected = [len(library.encode(w.decode(), add_special_tokens=False).ids) for w in words]
    assert [machine.count(w) for w in words] == expected and len(machine.states) == before
    token_count._worker.cache_clear()
    token_count.count_texts([w.decode() for w in words], PATH, 16_384)
    assert len(token_count._worker(PATH)[0].states) <= len(words[0])


def test_long_and_short_words_over_chunk_borders(library):
    texts = ["ab " * 40 + "q" * n + " tail 12345" * 9 for n in (1, 63, 64, 65, 200)] + ["", "x" * 64 + " " + "y" * 65]
    expected = [(len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts]
    for chunk in (1, 7, 64, 16_384):
        assert token_count.count_texts(texts, PATH, chunk) == expected
    assert max(map(len, token_count._worker(PATH)[1])) <= token_count.LONG_WORD


def test_the_codec_keeps_few_words(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "MAX_WORDS", 50)
    bpe_codec.release(PATH)
    texts = [" ".join(f"w{i}x{k}" for i in range(30)) for k in range(20)]
    for t in texts:
        (got,) = bpe_codec.encode_texts([t], PATH)
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(bpe_codec._worker(PATH)[1]) <= 100
    (got,) = bpe_codec.encode_texts([" ".join(texts)], PATH)
    assert np.frombuffer(got, "<u4").tolist() == library.encode(" ".join(texts), add_special_tokens=False).ids
    assert len(bpe_codec._worker(PATH)[1]) <= 100
