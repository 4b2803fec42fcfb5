"""Texts that hold an added token of the vocabulary, against the plain call of tokenizers."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hemtally.llm import encode, packing, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [
    f"{END} k", END, END * 3, f"a {END}\n\n{END} b", f"one  {END}  two\n", f"<|{END}|> <|endoftext", f"café　{END}\xa0z\r\n{END}", "plain text", "", None,
    f"a\n{END}b\n", f"x \n\n {END}", f"don{END}'t", f"\ud7ff{END}\U0001f600", "<|ENDOFTEXT|>", f"12{END}34 " * 50,
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("vocabulary", [None, JSON])
def test_ids_are_those_of_the_plain_call(plain, vocabulary):
    own = encode.encoder(vocabulary, added=True)
    for text, ids in zip(TEXTS, own.batch(TEXTS)):
        assert ids.tolist() == plain(text) and ids.dtype == np.uint32
        assert own.widths[ids].sum() == len((text or "").encode())


def test_operators_count_and_pack_the_plain_ids(spark, plain):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    sections = token_counts.section_tokens(df).collect()
    pieces = {r["doc_id"]: r for r in packing.token_pieces(df, 2048).collect()}
    for i, text in enumerate(TEXTS):
        ids = plain(text)
        assert {r["doc_tokens"] for r in sections if r["doc_id"] == i} == {len(ids)} == {sum(r["n_tokens"] for r in sections if r["doc_id"] == i)}
        assert pieces[i]["ids_crc32"] == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
