"""Encoding, token files and packing against the library and brute force."""

import io
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm import packing as P
from fathomline.llm import token_files as F
from fathomline.llm import tokens
from fathomline.llm.tokens import PieceEncoder

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module", params=[WORDS, BYTES], ids=["words", "bytes"])
def pair(request):
    library = Tokenizer.from_file(request.param)
    library.encode_special_tokens = True
    return PieceEncoder(request.param, limit=50), library


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(text=st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sST1.É 　​﻿᠎İΣ́日😀<|>")), st.characters(codec="utf-8")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_pieces_encode_like_the_library(pair, text):
    fast, library = pair
    assert fast.encode(text) == ids(library, text)


def test_special_names_and_long_texts(pair):
    fast, library = pair
    for text in ("a <|endoftext|> b", "<|startoftext|>", "x" * 3000, "word " * 3000, " a  b ", ""):
        assert fast.encode(text) == ids(library, text)


class Split:
    """A split column whose distinct pieces can't be taken out by ``to_pylist``, which is slow."""

    def __init__(self, lists):
        self.offsets, self.coded = lists.offsets, lists.flatten().dictionary_encode()
        self.indices, self.dictionary = self.coded.indices, self

    def flatten(self):
        return self

    dictionary_encode = flatten

    def to_numpy(self, **options):
        return self.coded.dictionary.to_numpy(**options)


def test_many_texts_leave_arrow_at_once(pair, monkeypatch):
    fast, library = pair
    split = pc.split_pattern
    monkeypatch.setattr(tokens, "pc", SimpleNamespace(split_pattern=lambda a, by: split(a, by) if by == "\n" else Split(split(a, by)), replace_substring=pc.replace_substring, match_substring=pc.match_substring))
    texts = ["", "a b\nc a", "naïve  café 日", "\n", "x" * 100 + " b."]
    assert [i.tobytes() for i in fast.encode_many(pa.array(texts))] == [ids(library, t) for t in texts]
    assert fast.encode_many(pa.array([], pa.string())) == []


@given(st.lists(st.integers(0, 2**40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    ef = F.EliasFano.of(np.array(values, np.uint64))
    assert [ef.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 4000, 50_000)).astype(np.uint64)
    size = sum(map(len, F.EliasFano.of(ends).parts()))
    assert size * 8 / len(ends) < 2.3 + np.log2(ends[-1] / len(ends))


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


class Counted(F.EliasFano):
    selected = 0

    def select(self, i):
        self.selected += 1
        return super().select(i)


def test_shard_round_trip(monkeypatch):
    monkeypatch.setattr(F, "EliasFano", Counted)
    docs = [(None, b"\1\0\0\0"), (-5, np.array([7, 60_000, 1], "<u4").tobytes()), (-5, b"\1\0\0\0"), (90, np.arange(3000, dtype="<u4").tobytes())]
    out = io.BytesIO()
    F.write_shard(out, iter(docs), 2)
    reader = F.ShardReader(File(out.getvalue()))
    starts = np.cumsum([0] + [len(b) // 4 for _, b in docs])
    assert list(reader.documents(block_ids=100)) == [(d, int(s), len(b) // 4, zlib.crc32(b)) for (d, b), s in zip(docs, starts, strict=False)]
    assert reader.ends.selected >= 4 and reader.ids.selected >= 3
    assert [reader.doc_id(i) for i in range(4)] == [None, -5, -5, 90]
    assert reader.read(*reader.span(1)).tolist() == [7, 60_000, 1]


ROWS = [(7, "Hello world"), (3, None), (5, ""), (-2, "naïve café " * 900), (None, "no id"), (7, "Hello world"), (7, "Another text"), (11, "z" * 9000)]


def test_token_files(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, shard int")
    library = Tokenizer.from_file(WORDS)
    order = sorted(((d, t or "") for d, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, at = [], 0
    for d, t in order:
        data = ids(library, t) + b"\1\0\0\0"
        expected.append((d, at, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    got = sorted((tuple(r) for r in F.encode_to_files(docs, WORDS).collect()), key=lambda r: r[1])
    assert got == expected
    assert F.encode_to_files(docs.limit(0), WORDS).count() == 0


def check_packing(rows, texts, window, library):
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    wanted = {}
    for d, t in texts:
        data = ids(library, t or "") + b"\1\0\0\0"
        wanted.setdefault((d, len(data) // 4), []).append(data)
    assert by_doc.keys() == wanted.keys()
    for key, pieces in by_doc.items():
        copies = len(wanted[key])
        spans = sorted((p["start"], p["length"]) for p in pieces)
        ends = {}
        for start, length in spans:
            assert start == 0 or ends.get(start, 0) > 0
            ends[start] = ends.get(start, copies) - 1
            ends[start + length] = ends.get(start + length, 0) + 1
        assert sum(length for _, length in spans) == copies * key[1]
        if copies == 1:
            for p in pieces:
                assert zlib.crc32(wanted[key][0][4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"]
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    return windows


def test_packing(spark):
    rng = random.Random(3)
    texts = ROWS + [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(400)))) for i in range(300)]
    docs = spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, sequence_id string")
    library = Tokenizer.from_file(BYTES)
    packed = P.pack_documents(docs, BYTES, window=256, group_items=100_000)
    rows = packed.collect()
    windows = check_packing(rows, texts, 256, library)
    total = sum(r["length"] for r in rows)
    assert total / (256 * len(windows)) > 0.98
    many = P.pack_documents(docs, BYTES, window=256, group_items=40).collect()
    check_packing(many, texts, 256, library)
    assert P.pack_documents(docs.limit(0), BYTES).count() == 0
    unique = docs.filter("doc_id >= 100")
    own = P.pack_documents(unique, BYTES, window=256)
    for row in P.sequences(unique, own, BYTES, window=256).limit(5).collect():
        assert len(row["ids"]) == 256 and all(row["ids"][: row["n_tokens"]]) and not any(row["ids"][row["n_tokens"] :])


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_matches_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 200)
    place, offset = P.best_fit_decreasing(lengths, 100)
    left, expected = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [(c, k) for k, c in enumerate(left) if c >= lengths[i]]
        if fits:
            expected[i] = min(c for c, _ in fits)
            k = place[i]
            assert left[k] == expected[i]
        else:
            left.append(100)
            k = len(left) - 1
            assert place[i] == k
        assert offset[i] == 100 - left[k]
        left[k] -= lengths[i]
