"""BPE encoding by dynamic programming over prefixes, and decoding.

Each task builds, from the tokenizer's file, an automaton over the vocabulary. Walking a word through it gives, at
every prefix, the tokens that end there. Exactly one of them is the last token of that prefix's own encoding: the
one whose rest of the prefix is empty, or ends (by the entry already stored for that shorter prefix) in a token
that is pair-compatible with it. Following the stored tokens back from the word's end gives the exact ids, in time
linear in the word and with no merge loop.

Two tokens are pair-compatible if no merge ever crosses the border between them. The pieces that touch the border
are those on the right spine of the left token and on the left spine of the right one; a piece lives until the
merge that swallows it. A crossing merge happens if its rank is lower than the end of the left piece's life, and
not higher than the end of the right one's: of equal ranks the leftmost merge goes first.

Words that were encoded before come from a bounded per-worker table, which is only a matter of speed.

Edge cases. Null text is empty: no ids, and the hashes of nothing. Strings of special tokens in a text become their
ids, as in the tokenizers library. A text may be of any length and have no spaces at all. Each input row gives one
row, whatever its id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import ids_and_texts, ids_back, table

TOKENIZER = "word_bpe_49k.json"
#: Entries in each of the two generations of a worker's tables of known words, chunks and token pairs, and the longest
#: key that is remembered, in characters.
REMEMBERED, LONGEST = 150_000, 48
#: Stands for the end of a word inside the automaton; a private-use character that byte symbols never use.
END = ""
#: White space to str.split() that is none to the tokenizer's pattern.
ODD_GAPS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Known(dict):
    """A bounded table: when the young generation is full it becomes the old one, and entries still in use move on.

    Keys of more than `longest` characters are made anew each time, so bytes are bounded and not only entries.
    """

    def __init__(self, make, most: int = REMEMBERED, longest: int | None = LONGEST):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class PrefixBpe:
    """The model part: words of byte symbols to ids."""

    def __init__(self, model: dict):
        import ahocorasick

        suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.end = END if suffix else ""
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, rank)
            halves.setdefault(made, (*pair, rank))
        self.halves = halves
        self.spines: dict[int, tuple] = {}
        self.fits = Known(lambda key: self._apart(key >> 24, key & 0xFFFFFF), longest=None)
        whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.size: dict[int, int] = {}
        for t, i in sorted(vocab.items(), key=lambda x: halves[x[1]][2] if x[1] in halves else -1):
            if i in halves:
                a, b, rank = halves[i]
                whole[i] = whole.get(a, False) and whole.get(b, False) and self._apart(a, b, rank)
            else:
                whole[i] = True
            if whole[i]:  # a token that no word ever merges to is no last token of a prefix
                key = t[: -len(suffix)] + END if suffix and t.endswith(suffix) and t != suffix else t
                self.automaton.add_word(key, (i, len(key)))
                self.size[i] = len(key)
        self.automaton.make_automaton()

    def _spine(self, token: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
        """The pieces at the token's left and right edge, each with the rank of the merge that ends it."""
        found = self.spines.get(token)
        if found is None:
            edges = []
            for side in (0, 1):
                piece, ends, pieces = token, float("inf"), []
                while True:
                    pieces.append((piece, ends))
                    if piece not in self.halves:
                        break
                    ends, piece = self.halves[piece][2], self.halves[piece][side]
                edges.append(pieces)
            found = self.spines[token] = tuple(edges)
        return found

    def _apart(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """No merge of a rank under `limit` crosses the border between the two tokens."""
        rank = self.rank
        for x, x_ends in self._spine(left)[1]:
            for y, y_ends in self._spine(right)[0]:
                crossing = rank.get((x, y))
                if crossing is not None and crossing < limit and crossing < x_ends and crossing <= y_ends:
                    return False
        return True

    def encode(self, word: str) -> list[int]:
        """ids of one word of byte symbols."""
        word += self.end
        last: list[int] = [-1] * (len(word) + 1)
        fits = self.fits
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                before = end - size
                if not before or (last[before] >= 0 and fits[last[before] << 24 | token]):
                    last[end] = token
        ids, at, sizes = [], len(word), self.size
        while at:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        return ids[::-1]


def late_letters(pattern: str) -> frozenset[str]:
    """Letters and digits of newer Unicode versions, that Python's tables and the tokenizers library's may take differently."""
    import regex
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(pattern), "removed", invert=True)
    kinds = {"L": "a", "N": "!"}
    late = []
    for kind, beside in kinds.items():
        for c in regex.findall(rf"\p{{{kind}}}", "".join([chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"])):
            if (len(split.pre_tokenize_str(beside + c)) == 1) != (kind == "L") or Lowercase().normalize_str(c) != c:
                late.append(c)
    return frozenset(late)


class WordTokenizer:
    """The whole tokenizer: special tokens, normal form, words, ids, and back."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if steps != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or spec["decoder"] is not None:
            raise ValueError(f"{path} is not a lower-case word tokenizer of the kind read here")
        self.bpe = PrefixBpe(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pattern = splits[0]["pattern"]["Regex"]
        self.pieces = regex.compile(self.pattern).findall
        self.late = late_letters(self.pattern)
        self.symbol = byte_symbols()
        self.names = self.bpe.token | {i: t for t, i in self.special.items()}
        self.chunks = Known(self._run)
        self.words = Known(self._word)

    def _word(self, piece: str) -> tuple[bytes, str]:
        ids = self.bpe.encode(piece if piece.isascii() and piece.isprintable() else "".join([self.symbol[b] for b in piece.encode()]))
        return b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([self.names[i] for i in ids])

    def _late_pieces(self, text: str) -> list[str]:
        from tokenizers import Regex
        from tokenizers.normalizers import NFC, Lowercase, Sequence
        from tokenizers.pre_tokenizers import Split

        text = Sequence([NFC(), Lowercase()]).normalize_str(text)
        return [piece for piece, _ in Split(Regex(self.pattern), "removed", invert=True).pre_tokenize_str(text)]

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Lower case goes character by character: a final sigma is like any other.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _run(self, text: str) -> tuple[bytes, str]:
        words = self.words
        pieces = self.pieces(self.normal(text)) if text.isascii() or self.late.isdisjoint(text) else self._late_pieces(text)
        parts = [words[piece] for piece in pieces]
        return parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        """Tokens never reach over white space, and it gives none: what stands between can be encoded by itself."""
        if ODD_GAPS.search(text):
            return [self._run(text)]
        chunks = self.chunks
        return [chunks[chunk] for chunk in text.split()]

    def encode(self, text: str) -> tuple[bytes, str]:
        """ids as little-endian unsigned 32-bit integers, and the decoded text."""
        parts: list[tuple[bytes, str]] = []
        for piece in self.cut.split(text) if "<|" in text else [text]:
            if piece in self.special:
                parts.append((self.special[piece].to_bytes(4, "little"), piece))
            else:
                parts += self._plain(piece)
        parts = [p for p in parts if p[0]]
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(2)
def loaded(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded, or where keep_ids is false only n_tokens and digests."""
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = loaded(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids, decoded = tokenizer.encode(text or "")
                digests = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*digests, ids, decoded) if keep_ids else digests)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep_ids else ())])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return ids_back(ids_and_texts(docs, id_col, text_col).mapInPandas(run, schema))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), keep_ids=False)
