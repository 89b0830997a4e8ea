import random
import zlib

import edge
import numpy as np
import pyarrow as pa
import pytest
from chronoveil.llm import token_codec, tokens


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    odd = [None, "", " ", "a", "Word.", " .x. \n", "À. É! ÀÇ?b", "×. ÷.", "<|endoftext|> x", "don't it's", "ÿ.\x0b", "été İIſ"]
    return odd + ["".join(rng.choices("ab .,!?;:\n\tAÀéß×<|'1İſKǺ世", k=rng.randrange(0, 60))) for _ in range(300)]


def test_ids_are_the_tokenizers(texts):
    encoder = tokens.WordEncoder(tokens.public_tokenizer(), remembered=20)
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for part in (texts, texts[5:9], texts[12:]):  # the same words again, forgotten or not
        ids, offsets = encoder.encode(pa.array(part, pa.string()))
        at = texts.index(part[0])
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want[at:at + len(part)]


def test_plain_words_skip_the_normaliser():
    encoder = tokens.WordEncoder(tokens.public_tokenizer())
    assert encoder.plain is not encoder.tokenizer and encoder.plain.normalizer is None
    words = ["plain", "été", "ÀB", "straße", "x" * 300]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder._ids(words)] == [encoder.tokenizer.encode(w).ids for w in words]


def test_round_trip(spark, texts):
    docs = edge.documents(spark, list(enumerate(texts)))
    found = token_codec.round_trip(docs, rows_per_range=40).orderBy("doc_id").collect()
    plain, start = tokens.word_encoder(tokens.public_tokenizer()).tokenizer, 0
    for row, text in zip(found, texts, strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, token_codec.END_ID], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
