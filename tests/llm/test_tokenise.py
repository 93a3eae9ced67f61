import os
import random

import pytest

from evidentia.llm.tokenise import TOKENIZER_DIR, LiveText, PrefixEncoder, encode_column

FILE = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")
LETTERS = "ab c'sldtre  \n\t\r19é中😀.,!- ​ İßABCthe"


@pytest.fixture(scope="module")
def encoder():
    with open(FILE, encoding="utf-8") as f:
        return PrefixEncoder.from_json(f.read())


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def _random(rng, most):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randrange(most)))


def test_equals_the_public_tokenizer(encoder, public):
    rng = random.Random(3)
    texts = [_random(rng, 60) for _ in range(3000)] + ["", " ", "a" * 4000, "-" * 3000, " " * 2000, "<|endoftext|> x", "word " * 5000]
    for t in texts:
        assert encoder.encode(t) == public.encode(t, add_special_tokens=False).ids


def test_round_trip(encoder):
    names = {i: t for t, i in encoder.ids.items()}
    rng = random.Random(4)
    for _ in range(300):
        t = _random(rng, 80)
        assert b"".join(names[i] for i in encoder.encode(t)).decode() == t


def test_appends_and_edits_equal_encoding_anew(encoder):
    rng = random.Random(5)
    for _ in range(800):
        t = _random(rng, 40)
        live = LiveText(encoder, t)
        for _ in range(4):
            a = rng.randrange(len(t) + 1)
            b = rng.randrange(a, min(len(t), a + 4) + 1)
            if rng.random() < 0.4:
                a = b = len(t)
            new = _random(rng, 6)
            live.edit(a, b, new)
            t = t[:a] + new + t[b:]
            assert live.text == t
            assert live.ids() == encoder.encode(t)


def test_an_edit_touches_its_surroundings_only(encoder):
    t = "the quick brown fox jumps over the lazy dog. " * 200
    live = LiveText(encoder, t)
    live.edit(4000, 4003, "cat")
    assert live.recut < 60
    live.append("x")
    assert live.recut < 10


def test_column(spark, encoder):
    rows = [(1, "Hello world", "a"), (2, None, "b"), (3, "", "c"), (4, "x" * 100_000, "d"), (5, "Hello world", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_column(df, "doc_id", "text").collect()}
    assert got == {i: encoder.encode(t) for i, t, _ in rows}
    assert encode_column(df.where("false"), "doc_id", "text").count() == 0


def test_latin_texts_are_cut_alike():
    from evidentia.llm.tokenise import _CUT, _LATIN_CUT, _NOT_LATIN, cut

    for c in map(chr, range(0x3000)):
        for text in (c, f"a{c}b", f" {c} ", f"1{c}{c}2", f"'{c}s  {c}x"):
            assert cut(text) == _CUT.findall(text), (hex(ord(c)), text)
            if not _NOT_LATIN.search(text):
                assert _LATIN_CUT.findall(text) == _CUT.findall(text), (hex(ord(c)), text)
