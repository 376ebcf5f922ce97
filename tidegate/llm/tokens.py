"""Token ids of whole texts from a public vocabulary file, with a bounded cache of words.

The vocabulary's pre-tokenizer cuts a text into pieces that are tokenized on their own, so ids can
be kept by piece: the model only sees each worker's new pieces. Texts of printable ASCII and Latin-1
letters are cut here; in any other text each word between ASCII white space (which is dropped and
never joined across) goes through the whole tokenizer. Long texts are cut at white space into stretches of
about ``STRETCH`` characters, so memory is that of a text's ids and of one stretch's pieces.
"""
from __future__ import annotations

import os
import re
from array import array

PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
GAP = re.compile(r"[\x20\x09-\x0D]").search
STRETCH = 1 << 18
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: The vocabulary file's pre-tokenizer on lower-case PLAIN texts, and the byte-to-character table of byte-level BPE.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\s]+").findall


def _byte_chars() -> dict[int, str]:
    """Printable Latin-1 stands for itself; the other bytes follow from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class _Recent:
    """The values of keys used lately: two generations of at most ``limit`` keys each."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class WordTokenizer:
    """ids(text) equals encode(text, add_special_tokens=False).ids; special strings are plain text."""

    def __init__(self, path: str, cache: int = 120_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model, self.table = self.whole.model, _byte_chars()
        self.pieces, self.words = _Recent(cache), _Recent(cache // 8)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.old.get(piece)
        if ids is None:
            coded = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
            ids = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
        return self.pieces.put(piece, ids)

    def _word(self, word: str) -> bytes:
        ids = self.words.old.get(word)
        if ids is None:
            ids = array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        return self.words.put(word, ids)

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit numbers in the machine's order."""
        out, at = [], 0
        while len(text) - at > STRETCH:
            gap = GAP(text, at + STRETCH)
            if not gap:
                break
            out.append(self._stretch(text[at:gap.start()]))
            at = gap.end()
        return b"".join([*out, self._stretch(text[at:] if at else text)])

    def _stretch(self, text: str) -> bytes:
        if PLAIN(text):
            parts, kept, new = PIECES(text.lower()), self.pieces, self._piece
        else:
            parts, kept, new = WORDS(text), self.words, self._word
        ids = list(map(kept.young.get, parts))
        if None in ids:
            for i in [i for i, x in enumerate(ids) if x is None]:
                ids[i] = kept.young.get(parts[i]) or new(parts[i])
        return b"".join(ids)

    def ids(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
