"""Tokenisation of whole texts in Arrow batches, by cached units.

A cut between a character that is no white space and white space after it never changes the ids of
either side: every match of the pre-tokenisers' pattern is either white space alone or starts at
most one space before its word.  So a text is cut there to units, whose concatenation it is; each unit's
ids are made once by the given encoder and kept in a bounded cache of the worker, and a text's ids are
its units' ids in order.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import parts

#: The characters that are white space to the pre-tokenisers.
_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Texts that aren't cut at every space alike: a space after white space, and the mark that is put in for lines.
_LOOSE = rf"[{_BLANK}] |\x00"
_LINE, _CUT_LINE = rf"([^{_BLANK}])\n", "\\1 \x00\n"
#: Common marks after a letter or digit begin a match of their own, so they are cut off too: a word is one unit with and without them.
_MARK, _CUT_MARK = r"([\pL\pN])([.,;:!?])", "\\1 \x00\\2"
_UNITS = re.compile(r"\s*\S+|\s+")
#: Marks that stand alone at the end of a word under the pattern.
_MARKS = frozenset(".,;:!?")
#: Longer units are made each time they come, so that the caches' bytes are bounded with their entries.
_LONG = 64


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist, but in one call."""
    return column.to_numpy(zero_copy_only=False).tolist()


class UnitEncoder:
    """encode: one match of `pattern` -> its ids.  Units and matches are kept in two
    generations of `limit` at most: when the younger is full it becomes the older one, from which what
    is still in use comes back, so memory stays bounded (about 150 bytes an entry) and common words are
    never made twice.  added: strings that are one id wherever they stand; texts are cut at them first,
    the leftmost and longest."""

    def __init__(self, encode: Callable[[str], list[int]], pattern: str, limit: int = 300_000, added: dict[str, int] | None = None):
        self.encode, self.matches, self.limit = encode, regex.compile(pattern).findall, limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older_spaced: dict[str, bytes] = {}
        self.size = 1 << 16  # ids are below it
        self.added = {s: array("H", [k]).tobytes() for s, k in (added or {}).items()}
        any_added = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.cut = re.compile(f"({any_added})").split if self.added else None

    def _pieces(self, unit: str) -> list[str]:
        """The pattern's matches.  Letters, after a space or one line's end or not and before one common
        mark or not, are told without it."""
        head = unit[0]
        word = unit[1:] if head in " \n" else unit
        mark = word[-1:] in _MARKS
        if not (word[:-1] if mark else word).isalpha():
            return self.matches(unit)
        lead = ["\n"] if head == "\n" else []
        word = word if head == "\n" else unit
        return [*lead, word[:-1], word[-1]] if mark else [*lead, word]

    def _unit(self, unit: str) -> bytes:
        return b"".join(map(self._piece, self._pieces(unit)))

    def _piece(self, piece: str) -> bytes:
        """A word without its mark is common: it is kept like one that stands alone."""
        if piece[0] != " " or len(piece) == 1:
            return self._kept(piece, self._encoded)
        ids = self.spaced.get(piece[1:]) or self.older_spaced.get(piece[1:]) or self._encoded(piece)
        if len(piece) <= _LONG:
            self.spaced[piece[1:]] = ids
        return ids

    def _encoded(self, piece: str) -> bytes:
        return array("H", self.encode(piece)).tobytes()

    def _kept(self, unit: str, make: Callable[[str], bytes]) -> bytes:
        ids = self.known.get(unit)
        if ids is None:
            if len(self.known) > self.limit // 6:
                self.older, self.known = self.known, {}
            ids = self.older.get(unit) or make(unit)
            if len(unit) <= _LONG:
                self.known[unit] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 16-bit integers."""
        return next(self.batch(pa.array([text], pa.string())))

    def batch(self, texts: pa.Array, most: int = 1 << 21) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null counts as empty.  At most about `most` bytes of text, or one
        text, are in hand at a time: their words are told apart by a hash table of Arrow's, each distinct
        word's ids come from the cache or are made, and all texts' ids are gathered from those at once."""
        for b in parts([pa.RecordBatch.from_arrays([texts], names=["text"])], 0, most):
            yield from self._slice(b.column(0).fill_null(""))

    def _slice(self, part: pa.Array) -> Iterator[np.ndarray]:
        loose = pc.or_(pc.match_substring_regex(part, _LOOSE), pc.starts_with(part, " "))
        for s in self.added:
            loose = pc.or_(loose, pc.match_substring(part, s))
        if not pc.any(loose).as_py():
            yield from self._words(part)
            return
        rest, plain = iter(part.filter(loose).to_pylist()), self._words(part.filter(pc.invert(loose)))
        for x in loose.to_pylist():
            yield self._loose(next(rest)) if x else next(plain)

    def _loose(self, text: str) -> np.ndarray:
        found = []
        for k, piece in enumerate(self.cut(text) if self.cut else (text,)):
            found += [self.added[piece]] if k % 2 else [self._kept(u, self._unit) for u in _UNITS.findall(piece)]
        return np.frombuffer(b"".join(found), dtype=np.uint16)

    def _words(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Of texts whose units are the words with the one space before them, but for the first, and
        those that begin with a line's end or a mark."""
        if not len(texts):
            return
        split = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring_regex(texts, _MARK, _CUT_MARK), _LINE, _CUT_LINE), " ")
        starts = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        first = _strings(split.flatten().take(pa.array(starts[:-1])))
        words, which = _strings(coded.dictionary), coded.indices.to_numpy().copy()
        del split, coded
        if len(self.spaced) > self.limit:
            self.older_spaced, self.spaced = self.spaced, {}
        spaced, older, encode = self.spaced, self.older_spaced, self.encode
        found = list(map(spaced.get, words))
        for k, ids in enumerate(found):
            if ids is None:
                w = words[k]
                ids = older.get(w)
                if ids is None:
                    if w.isalpha():
                        ids = array("H", encode(" " + w)).tobytes()
                    else:
                        ids = self._unit(w[1:] if w[:1] == "\0" else " " + w)
                found[k] = ids
                if len(w) <= _LONG:
                    spaced[w] = ids
        found += [self._kept(w, self._unit) if w else b"" for w in first]
        which[starts[:-1]] = len(words) + np.arange(len(first))
        del words
        sizes = np.fromiter(map(len, found), np.int32, len(found)) >> 1
        table = np.frombuffer(b"".join(found), dtype=np.uint16)
        n = sizes[which]
        ends = np.cumsum(n, dtype=np.int64)
        place = (np.cumsum(sizes, dtype=np.int64) - sizes)[which] - ends + n
        # documents in turn, so that no array of places is longer than a document
        edges = [0, *ends[starts[1:] - 1].tolist()]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            own = slice(starts[k], starts[k + 1])
            yield table[np.repeat(place[own], n[own]) + np.arange(lo, hi)]


def byte_alphabet() -> dict[int, str]:
    """The characters by which byte-level vocabularies write the bytes: printable ones as they are,
    the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def library_encoder(path: str, added: bool = False) -> UnitEncoder:
    """The worker's encoder by the tokenizers library's model of a tokenizer file.  added: the strings of
    the file's added tokens are those tokens, as in the library; else they are ordinary text.  Ids must
    be under 65,536."""
    if (path, added) not in _encoders:
        import public_tokenizers
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        if tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        own = tok.get_added_tokens_decoder() if added else {}
        if any(t.lstrip or t.rstrip or t.single_word for t in own.values()):
            raise ValueError("added tokens that depend on what stands beside them")
        tokenize, written = tok.model.tokenize, byte_alphabet()
        blank = written[32]

        def encode(piece: str) -> list[int]:
            plain = piece.isascii() and piece.isprintable()  # then only the space is written otherwise
            text = piece.replace(" ", blank) if plain else piece.encode().decode("latin-1").translate(written)
            return [t.id for t in tokenize(text)]

        _encoders[path, added] = UnitEncoder(encode, public_tokenizers.PATTERN, added={t.content: k for k, t in own.items()})
        _encoders[path, added].size = tok.get_vocab_size()
    return _encoders[path, added]
