"""The BPE encoder and decoder against the tokenizers library."""

import hashlib
import struct
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_CHECK
from regiflow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(PATH, cache_pieces=50)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()}
    assert got == {d: want(library, t) for d, t in texts.items()}


CASES = ["", " ", "Hello World's it'S we'll", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>x", "<|ENDOFTEXT|> <|end",
         "İstanbul ΣΑΣ ΟΔΟΣ ß ﬁ é é ñ Å", "x\x1cy\x85z\xa0q r　s​t", "１２３ 12a ## ...!!", "日本語テキスト", "👍🏽 emoji 🇩🇪",
         "\0\x01\x7f", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "́ͅ", "'s't 're", "a b c", "tab\there\r\nnew\x0bv\x0cf"]


@pytest.mark.parametrize("text", CASES)
def test_cases(own, library, text):
    e = library.encode(text, add_special_tokens=False)
    assert own.encode(text) == e.ids
    assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcthering's .,!<|>éÄßñçΣς\n\t"), st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"))), max_size=60))
def test_random_texts(own, library, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_every_code_point(own, library):
    """Between letters, so its class, lower case and bytes all show."""
    points = [c for c in [*range(0x20000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c <= 0xDFFF]      # the rest is Han or unassigned
    texts = [f"a{chr(c)}b" for c in points] + [f"{chr(c)}{chr(c)}." for c in points if unicodedata.category(chr(c)) in ("Cn", "Nd", "No", "Lu")]
    wrong = []
    for at in range(0, len(texts), 50_000):
        part = texts[at:at + 50_000]
        wrong += [t for t, e in zip(part, library.encode_batch_fast(part, add_special_tokens=False)) if own.encode(t) != e.ids]
    assert wrong == []


def test_null_rows_and_extra_columns(spark, library):
    rows = [(1, None), (None, "a b"), (2, ""), (2, ""), (3, "word " * 50_000)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, data string")
    got = sorted([tuple(r) for r in bpe.round_trip(df, PATH).collect()], key=str)
    assert got == sorted([(d, *want(library, t)) for d, t in rows], key=str)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_cache_is_bounded():
    from regiflow.llm.tokens import PieceCache
    cache = PieceCache(lambda p: p, 10)
    for i in range(1000):
        assert cache[b"%d" % (i % 37)] == b"%d" % (i % 37)
        assert len(cache) <= 10 and len(cache.old) <= 10
