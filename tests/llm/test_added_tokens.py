"""Added tokens' contents in texts against an unmodified library tokenizer."""

import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm import token_files as F
from fathomline.llm.tokens import encoder

PATHS = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
LIBRARIES = {p: Tokenizer.from_file(p) for p in PATHS}
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "|>", " ", "\n", "a", "é", "́", "word", "'s"]


def ids(library, text):
    return b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", PATHS, ids=["words", "bytes"])
@given(parts=st.lists(st.sampled_from(PARTS), max_size=12))
@settings(max_examples=300, deadline=None)
def test_encoder_is_the_library_by_default(path, parts):
    text = "".join(parts)
    assert encoder(path).encode(text) == ids(LIBRARIES[path], text)


def test_token_files(spark):
    rows = [(1, "a b <|endoftext|> c"), (2, "after it")]
    expected, at = [], 0
    for d, t in rows:
        data = ids(LIBRARIES[PATHS[0]], t) + b"\1\0\0\0"
        expected.append((d, at, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    assert expected[1][1] == 5
    got = F.encode_to_files(spark.createDataFrame(rows, "doc_id long, text string"), PATHS[0]).collect()
    assert sorted(map(tuple, got)) == expected
