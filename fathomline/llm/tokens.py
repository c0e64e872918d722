"""Exact encoding with a ``tokenizers`` file, made fast by remembering the ids of pieces.

Both vocabularies in use split text before merging and never merge across a single space or line end
between two visible characters.  A text is therefore cut there, each piece is encoded once with the
library's own BPE model, and its ids are kept in a bounded table.  Many texts are cut and their distinct
pieces found by Arrow, so that a table is asked once for each of them.  A text in which white space
touches a cut takes a slower road with the same result.  The contents of the file's added tokens (special
ones) are found first, as the library does, and their ids stand between those of the parts around them.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: The public split patterns of the two pre-tokenizers in use.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WORD_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: A single space between two visible characters; characters that engines class differently don't count as visible.
_CUT = re.compile("(?<=[^\\s᠎​﻿]) (?=[^\\s᠎​﻿])")


#: Classes and forms of characters before this one are the same for every engine.
_FAR = "\u0250"
#: Characters that engines class differently: white space to some.
_DOUBTFUL = frozenset("\u180e\u200b\ufeff")
#: Marks that no pattern joins with the letters before them.
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as one printable letter: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


class _Table(dict):
    """Text to id bytes; computes what is missing, and starts anew (keeping one older table) when full.

    None stands for a piece that isn't independent of its neighbours, as white space touches a cut; it isn't kept.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.compute(text)
        if ids is not None and len(text) <= 48:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class PieceEncoder:
    """Encodes texts to little-endian uint32 id bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    With ``added`` that is the library's default, which gives added tokens' contents in a text their own ids; without
    it, it is the library with ``encode_special_tokens`` on: they are ordinary text.
    ``limit`` bounds the tables of pieces and of words (about 200 bytes an entry; each has an older table of that size).
    """

    def __init__(self, path: str, limit: int = 150_000, *, added: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        tokens = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for _, t in tokens.values()):
            raise ValueError("added tokens that take more than their content out of a text are not known here")
        self.added = {content: array("I", [i]).tobytes() for content, (i, _) in tokens.items()}
        # of contents that start at one place the longest counts
        self.cut_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        normalizer, self.pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        kind = repr(self.pre)
        self.spaced = normalizer is None and kind.startswith("ByteLevel(")
        self.lowers = normalizer is not None and "Lowercase" in repr(normalizer)
        pattern = BYTE_LEVEL_SPLIT if self.spaced else WORD_SPLIT if self.lowers and WORD_SPLIT in kind else None
        if pattern is None:
            raise ValueError(f"pieces of this tokenizer are not known to be independent: {kind[:200]}")
        self.split = regex.compile(pattern).findall
        self.letters = {b: ord(c) for b, c in _byte_letters().items()}
        self.space = chr(self.letters[32])
        self.words = _Table(self._ids, limit // 4)
        self.first = _Table(self._first, limit // 10 if self.spaced else limit)
        self.rest = _Table(self._after_space, limit) if self.spaced else self.first
        self.line_end = self._ids("\n") if self.spaced else b""

    def _ids(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            letters = word.replace(" ", self.space)
        else:
            letters = word.encode().decode("latin1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _first(self, piece: str) -> bytes | None:
        return self._compute(piece, self.first, "")

    def _after_space(self, piece: str) -> bytes | None:
        return self._compute(piece, self.rest, " ")

    def _compute(self, piece: str, table: _Table, lead: str) -> bytes | None:
        """The ids of a piece, a space leading it or none; pieces that it is made of come from the tables."""
        if not piece or piece[0].isspace() or piece[-1].isspace() or piece[0] in _DOUBTFUL or piece[-1] in _DOUBTFUL:
            return None
        if not piece.isascii() and max(piece) >= _FAR:
            return self._split(lead + piece)
        shown = piece.lower() if self.lowers else piece
        if shown.isalpha():
            return self._ids(lead + shown)
        if shown[-1] in _MARKS and shown[:-1].isalpha():
            return table[shown[:-1]] + self.words[shown[-1]]
        return self._split(lead + piece)

    def _split(self, text: str) -> bytes:
        """The ids of any text that isn't cut any more."""
        if not text.isascii() and max(text) >= _FAR:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, self.split(text.lower() if self.lowers else text)))

    def encode(self, text: str) -> bytes:
        if self.added and any(content in text for content in self.added):
            return b"".join([self.added[p] if k % 2 else self._plain(p) for k, p in enumerate(self.cut_added(text))])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """The ids of a text in which nothing counts as an added token."""
        space = " " if self.spaced else ""
        return b"".join([self._split(p if k == 0 else space + p) for k, p in enumerate(_CUT.split(text))]) if text else b""

    def encode_many(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text as uint32, equal to ``encode``: distinct pieces of all texts are looked up once."""
        if self.spaced:  # a line end is a token of its own, and no space leads what follows
            lines = pc.split_pattern(texts, "\n")
            split, line_bounds = pc.split_pattern(lines.flatten(), " "), _bounds(lines)
        else:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded, bounds = split.flatten().dictionary_encode(), _bounds(split)
        # strings come out of Arrow many times faster through numpy than by to_pylist
        at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.rest.__getitem__, words))
        if self.spaced:
            starts = bounds[:-1]
            distinct, which = np.unique(at[starts], return_inverse=True)
            leading = [self.first[words[k]] for k in distinct.tolist()]
            at[starts] = len(parts) + which
            at[np.delete(starts, line_bounds[:-1])] += len(leading)
            parts += leading + [p if p is None else self.line_end + p for p in leading]
            bounds = bounds[line_bounds]
        slow = np.zeros(len(parts), bool)
        for k in [k for k, p in enumerate(parts) if p is None]:
            slow[k], parts[k] = True, b""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids, begins = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        flat = ids[np.repeat(begins[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])[bounds].tolist()
        alone = np.logical_or.reduceat(slow[at], bounds[:-1]) if len(texts) else np.zeros(0, bool)
        for content in self.added:
            alone |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        return [np.frombuffer(self.encode(texts[k].as_py()), "<u4") if odd else flat[a:b] for k, (odd, a, b) in enumerate(zip(alone.tolist(), ends[:-1], ends[1:], strict=True))]


def _bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins and ends among all values."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and file, equal to the library's default."""
    return PieceEncoder(path, added=True)
