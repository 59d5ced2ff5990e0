"""The streaming BPE codec against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioforge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Codec(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("theringanosd 's'll 12.,!?\n\t<|>éßΣİ½中🙂\x1c　"), st.characters(codec="utf-8")), max_size=80))
def test_encode_and_decode(both, text):
    codec, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.ids(text) == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "the" * 3000, "ing" * 500 + "!?" * 900, "<|startoftext|>hi<|endoftext|>x", "x " * 90000, "İstanbul ΣΑΣ", "", "".join(f"a{chr(c)}b" for c in range(0xA000, 0xD800)), "".join(f"1{chr(c)} " for c in range(0x10000, 0x20000))])
def test_long_words_in_a_window(both, text):
    codec, library = both
    assert codec.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_window_stays_bounded(both):
    t, rnd = bpe.Transducer(both[0].m), random.Random(1)
    for _ in range(200):
        t.feed("".join(rnd.choice("theaning") for _ in range(50)))
        assert len(t.text) < 8 * both[0].m.lookahead


def test_raw_decoder_holds_unfinished_characters(both):
    codec, _ = both
    d, ids = bpe.Decoder(codec.m, raw=True), codec.ids("naïve 中🙂 text")
    assert "".join(d.feed([i]) for i in ids) + d.finish() == "naïve 中 🙂 text "


def test_digests(spark, both, odd_docs):
    _, library = both
    for r in bpe.digests(spark, odd_docs, PATH).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").distinct().collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(spark, odd_docs, PATH).count() == 6


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    got = bpe.digests(spark, odd_docs, PATH).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 6 and {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id == 8} == {(0, nothing, nothing)}
    assert len({tuple(r) for r in got if r.doc_id == 7}) == 1
    assert bpe.digests(spark, no_docs, PATH).count() == 0 and bpe.encode(spark, no_docs, PATH).count() == 0


def test_codecs_are_known_by_content(both):
    text = bpe.read_vocabulary(PATH)
    first = bpe.codec_of(text)
    assert bpe.codec_of("".join(text)) is first
    other = bpe.codec_of(text + " ")
    assert other is not first and bpe.codec_of(text) is not other
