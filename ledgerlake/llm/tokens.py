"""Token ids of the tokenizers library for whole texts, at the speed of a table look-up.

A byte-level tokenizer cuts a text into pieces that it encodes one by one. Texts of ordinary characters (PLAIN) are cut
here by the same rule, said for those characters alone; each distinct piece goes to the library's model once and is
remembered in a bounded per-worker table. Any other text, and one with the string of a special token, goes to the library
whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

from .bpe import Known, byte_symbols

#: Pieces that a worker remembers in each generation.
PIECES = 150_000
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SPACES = "\\t-\\r "
#: ASCII without the separators 1C-1F, Latin letters, and signs that are neither letters, numbers nor white space.
PLAIN = re.compile("[\x00-\x1b\x20-\x7e\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*").fullmatch
CUT = re.compile(f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{_SPACES}{_LETTERS}0-9]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+").findall


class ByteTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        cutter = self.tokenizer.pre_tokenizer
        if type(cutter).__name__ != "ByteLevel" or not cutter.use_regex or cutter.add_prefix_space or self.tokenizer.normalizer is not None:
            raise ValueError(f"{path} is not a byte-level tokenizer without normal form and prefix space")
        self.model, self.symbols = self.tokenizer.model, dict(enumerate(byte_symbols()))
        self.pieces = Known(self._piece, PIECES)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[0] == " " and piece[1:].isalpha():
            shown = self.symbols[32] + piece[1:]
        else:  # bytes as characters of the same number, then as the vocabulary's symbols
            shown = piece.encode().decode("latin-1").translate(self.symbols)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not PLAIN(text) or self.special is not None and self.special.search(text):
            return self.direct(text)
        pieces = self.pieces
        return b"".join([pieces[q] for q in CUT(text)])


@lru_cache(2)
def loaded(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)
