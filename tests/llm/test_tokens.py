import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ontoweave.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul don't CAN'T x's straße Ǆ ſ ŒUVRE", "áb é ẛ̣", "ab<|endoftext|>cd <|startoftext|> x", "1234 a1b2 ½ ² ⅷ", "\x1c\x85a\xa0b c\tq\r\n", "ΣΑΣ Σ", "(x) [y]! 'tis it's!! ..'s a.b,c", "日本語 한국어 ไทย", "𝒳 😀😀 e😀x", None, "", " ", "ª º µ Å", "word " * 30000]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_any_token_is_addressed_directly(ids):
    a = np.array(ids, np.uint32)
    f = tokens.TokenFile(tokens.pack(a, [5, None], [len(a) // 2, len(a)]))
    assert [f.token(i) for i in range(0, len(a), 7)] == a[::7].tolist()
    assert f.tokens(3, len(a) - 2).tolist() == a[3 : max(3, len(a) - 2)].tolist() if len(a) > 5 else True
    assert f.doc_ids == [5, None]


def test_damage_is_found():
    data = bytearray(tokens.pack(np.arange(1000, dtype=np.uint32), [1], [1000]))
    data[200] ^= 1
    with pytest.raises(ValueError):
        tokens.TokenFile(bytes(data))


def test_words_give_what_whole_texts_give():
    t = Tokenizer.from_file(PATH)
    ids, sizes = tokens.Encoder(PATH)(pa.array(ODD))
    at = 0
    for text, n in zip(ODD, sizes, strict=True):
        assert ids[at : at + n].tolist() == t.encode(text or "", add_special_tokens=False).ids
        at += n


@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_any_texts(texts):
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    t = Tokenizer.from_file(PATH)
    ids, sizes = tokens.encoder(PATH)(pa.array(texts))
    assert ids.tolist() == [i for x in texts for i in t.encode(x, add_special_tokens=False).ids]
    assert sizes.sum() == len(ids)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = tokens.Encoder(path)
    assert not e.by_word
    assert e(pa.array(["a b", None]))[0].tolist() == Tokenizer.from_file(path).encode("a b", add_special_tokens=False).ids


def test_round_trip(spark):
    rows = [(i, x, "extra") for i, x in enumerate(ODD)] + [(3, "again", "x"), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = tokens.token_output(docs, PATH, 2, file_tokens=1000).orderBy("start").collect()
    t = Tokenizer.from_file(PATH)
    assert len(got) == len(rows) and len({r["file"] for r in got}) > 1
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] not in (3, None):
            ids = np.array(t.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    assert tokens.token_output(docs.limit(0), PATH, 2).count() == 0
