"""Token ids of the packing operator against the tokenizer itself, where the two could part."""

import numpy as np
import public_tokenizers
import pytest

from coursegrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def same(encoder, texts):
    want = [e.ids for e in encoder.plain.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(i, "<u4").tolist() for i in encoder.ids(texts)]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_mixtures_of_tokens(encoder):
    tokens = [encoder.fast.decode_single_token_bytes(i).decode("utf-8", "ignore") for i in range(50_256)]
    rng = np.random.default_rng(1)
    same(encoder, ["".join(tokens[k] for k in rng.integers(0, len(tokens), 4)) for _ in range(20_000)])


def test_letters_without_a_sense(encoder):
    rng = np.random.default_rng(2)
    same(encoder, ["".join(rng.choice(list("etaoinshrdlucm"), rng.integers(3, 40))) for _ in range(10_000)])


def test_every_kind_of_code_point(encoder):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 31 == 0)]
    same(encoder, [f"a{chr(c)} {chr(c)}1 {chr(c)}.b{chr(c)}{chr(c)}" for c in points])


def test_long_runs_go_to_the_tokenizer(encoder):
    mixed = [" \n", "\u3000 ", "x", "漢", ".", "1", "\u3000", "\n", "é"]
    same(encoder, [c * 20_000 for c in mixed] + ["word " * 3 + c * 5000 + " end" for c in mixed])
    for c in mixed:
        assert packing._has_run("a b " * 2000 + c * 5000 + " end")
    assert not packing._has_run("a word, or two. " * 10_000)
    assert not packing._has_run("")


def test_only_byte_level_files(tmp_path):
    with pytest.raises(ValueError):
        packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
