"""Whole texts to token ids with a public tokenizer file, one encoding per distinct piece.

Both supported files split a text before they merge bytes, so a text's ids are the
concatenated ids of its pieces. Texts are cut only where the file's own rules always cut;
each distinct piece is encoded once per worker with the ``tokenizers`` library and its ids
are kept in a table of bounded size.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode White_Space, as in the tokenizers' \s (Python's own \s has four more).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run with its leading space, or white space: the byte-level pattern never joins across.
_RUNS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_WORDS = re.compile(f"[^{_WS}]+")
#: Letters, then ASCII punctuation: a cut between them is always made.
_TAIL = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_LETTERS = "".join(c for c in map(chr, range(256)) if _TAIL.fullmatch(c))
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if _TAIL.fullmatch("a" + c) and c not in _LETTERS)


def _shown() -> dict[int, int]:
    """Byte-level files write a byte as itself if it can be printed, the others in order
    as the characters from 256 on."""
    table, n = {}, 256
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            table[b], n = n, n + 1
    return table


_SHOWN = _shown()
_SPACE = chr(_SHOWN[32])
if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 32-bit integers")
_PLAIN = re.compile("[\\t-\\r -~\\xa0-\\u024f\\u2010-\\u2027\\u20ac]*")


class PieceEncoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids; the mapping holds the ids of
    pieces, and learns a piece when it is first asked for.

    ``mode`` is ``bytes`` for a byte-level file that keeps white space, ``words`` for one
    that normalises (NFC, lower case) and drops white space. The table is emptied when it
    has more than ``most`` pieces.
    """

    def __init__(self, path: str, mode: str, most: int = 1_200_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        self._merge = self._tok.model.tokenize
        self._mode, self._most = mode, most

    def _whole(self, text: str) -> bytes:
        return array("I", self._tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of letters with at most one space before them: one word to the model,
        which takes bytes as the characters that the byte-level files use for them."""
        if self._mode == "words":
            word = word.lower()
        if word.isascii():
            word = word.replace(" ", _SPACE)
        else:
            word = word.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self._merge(word)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        m = _TAIL.fullmatch(piece)
        if m is None:
            ids = self._whole(piece)
        elif m[2]:
            ids = self[m[1]] + self[m[2]]
        else:
            ids = self._word(piece)
        self[piece] = ids
        return ids

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        get, words = self.__getitem__, self._mode == "words"
        find = _WORDS.findall if words else _RUNS.findall
        for text in texts:
            if len(self) > self._most:
                self.clear()
            if words and not _PLAIN.fullmatch(text):
                yield self._whole(text)  # normalisation may act across pieces
            else:
                yield b"".join(map(get, find(text)))

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an array one after another, and how many each text has,
        in the mode ``words``. Arrow splits the texts, so the table is asked only for what is
        distinct in them: words in lower case, without punctuation after letters."""
        if self._mode != "words":
            raise ValueError("a byte-level file keeps white space")
        if len(self) > self._most:
            self.clear()
        plain = [_PLAIN.fullmatch(text) is not None for text in texts.to_pylist()]
        whole = [k for k, ok in enumerate(plain) if not ok]
        # a text that is encoded as a whole is an empty word, which gets a number of its own
        cut = pc.if_else(pa.array(plain, pa.bool_()), texts, pa.scalar("", texts.type))
        split = pc.utf8_split_whitespace(pc.ascii_lower(cut))
        begun = split.offsets.to_numpy()
        named = split.flatten().dictionary_encode()
        known, numbers = self._known(named.dictionary), named.indices.to_numpy()
        if whole:
            numbers = numbers.copy()
            numbers[begun[whole]] = np.arange(len(known), len(known) + len(whole))
            known = pa.concat_arrays([known, pa.array([self._whole(texts[k].as_py()) for k in whole], known.type)])
        ids = known.take(pa.array(numbers))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // 4
        return np.frombuffer(ids.buffers()[2] or b"", "<u4", ends[-1]), np.diff(ends[begun])

    def _known(self, words: pa.Array) -> pa.Array:
        """The ids of each word: those of its letters, then those of what follows them."""
        stems = pc.ascii_rtrim(words, _PUNCTUATION)
        cut = pc.match_substring_regex(stems, f"^[{_LETTERS}]+$")
        stems = pc.if_else(cut, stems, words)
        tails = pc.if_else(cut, pc.utf8_ltrim(words, _LETTERS), pa.scalar("", words.type))
        found = []
        for pieces in (stems, tails):
            named = pieces.dictionary_encode()
            ids = map(self.__getitem__, named.dictionary.to_numpy(zero_copy_only=False).tolist())
            found.append(pa.array(list(ids), pa.large_binary()).take(named.indices))
        return pc.binary_join_element_wise(*found, pa.scalar(b"", pa.large_binary()))


_encoders: dict[tuple[str, str, int], PieceEncoder] = {}


def encoder(path: str, mode: str, most: int = 1_200_000) -> PieceEncoder:
    """This worker's encoder of the file, made once and kept, with its table of about
    ``most`` pieces (300 bytes each), for its later tasks."""
    if (path, mode, most) not in _encoders:
        _encoders[path, mode, most] = PieceEncoder(path, mode, most)
    return _encoders[path, mode, most]
