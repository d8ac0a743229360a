"""Encoding with the tokenizers library: every distinct word of a batch is encoded once."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

# Characters whose normal form, lower case and class no Unicode version changes: printable ASCII,
# tab, line ends, and Latin letters and signs up to U+024F without the dotted capital I.
ODD = r"[^\t\n\r -~\x{00a1}-\x{012f}\x{0131}-\x{024f}]|<\|"
# A blank next to other white space, or at an end: the byte pattern does not cut right before it.
LOOSE_BLANK = r"^ | $| [ \t\n\r]|[\t\n\r] "
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ascii_pattern(pattern: str) -> re.Pattern:
    """The same cuts for texts of ASCII only, in the faster standard library."""
    return re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()
BLANK = BYTE_LETTERS[32]


def letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(BYTE_LETTERS)


def gather(index: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenate the slices ``flat[starts[i] : starts[i] + sizes[i]]`` for i in ``index``."""
    n = sizes[index]
    ends = np.cumsum(n)
    shift = np.repeat(starts[index] - (ends - n), n)
    return flat[np.arange(len(shift)) + shift]


def csr(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and the flat values of lists of integers."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
    return np.cumsum(sizes) - sizes, sizes, flat


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 23):
    """Consecutive slices of a batch with about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def by_parts(texts: pa.Array, lists: pa.ListArray, encode_parts) -> list[np.ndarray]:
    """Ids of each text from its parts; ``encode_parts`` gets the distinct parts."""
    parts = lists.flatten().dictionary_encode()
    index = parts.indices.to_numpy().astype(np.int64)
    starts, sizes, flat = encode_parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
    ids = gather(index, starts, sizes, flat)
    ends = np.concatenate([[0], np.cumsum(sizes[index])])
    offsets = lists.offsets.to_numpy()
    return np.split(ids, ends[offsets - offsets[0]][1:-1]) if len(texts) else []


class Encoder:
    """Encodes as ``Tokenizer.encode`` does, without special tokens being added.

    The two public layouts (words, bytes) cut a text at places that no merge crosses, so the
    library's model runs once per distinct piece.  Results are kept in two generations of about
    ``keep`` parts: a full one becomes the older one, and parts that are met again move on.
    Texts with unusual characters, loose blanks or the strings of special tokens, and every text
    of another layout, go to the library whole.
    """

    def __init__(self, path: str, keep: int = 125_000):
        with open(path, encoding="utf-8") as f:
            self.tokenizer = Tokenizer.from_str(f.read())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.keep, self.known, self.older = self.tokenizer.model, keep, {}, {}
        told = json.loads(self.tokenizer.to_str())
        self.size = self.tokenizer.get_vocab_size()
        norm = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        pre = told["pre_tokenizer"] or {}
        split = pre.get("pretokenizers", [{}])
        self.layout = None
        if told["model"].get("dropout") is None:
            if norm == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": WORD_PATTERN}:
                self.layout, self.pattern = "words", regex.compile(WORD_PATTERN)
            elif told["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
                self.layout, self.pattern = "bytes", regex.compile(BYTE_PATTERN)
        if self.layout:
            self.ascii = ascii_pattern(WORD_PATTERN if self.layout == "words" else BYTE_PATTERN)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a part that starts and ends at certain cuts."""
        ids = self.known.get(text)
        return self._met(text) if ids is None else ids

    def _met(self, text: str) -> tuple[int, ...]:
        """Ids of a part that this generation has not met."""
        known, older = self.known, self.older
        ids = older.get(text)
        if ids is None:
            # a blank and letters are one piece in either layout
            if text.lstrip(" ").isalpha():
                ids = self.piece(text)
            else:
                ids = ()
                for piece in (self.ascii if text.isascii() else self.pattern).findall(text):
                    own = known.get(piece)
                    if own is None:
                        own = known[piece] = older.get(piece) or self.piece(piece)
                    ids += own
        known[text] = ids
        return ids

    def all_parts(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct parts; those of this generation are looked up in one go."""
        out = list(map(self.known.get, texts))
        return [self._met(text) if ids is None else ids for text, ids in zip(texts, out)]

    def piece(self, text: str) -> tuple[int, ...]:
        # letters of ASCII stand for themselves
        body = text.removeprefix(" ")
        if body.isascii() and body.isalpha():
            spelt = text if body == text else BLANK + body
        else:
            spelt = letters(text)
        return tuple([t.id for t in self.model.tokenize(spelt)])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; NULL counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.layout is None:
            return [self.whole(t) for t in texts.to_pylist()]
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        odd = pc.match_substring_regex(texts, ODD if self.layout == "words" else f"{ODD}|{LOOSE_BLANK}")
        easy = texts.filter(pc.invert(odd))
        if self.layout == "words":
            done = by_parts(easy, pc.ascii_split_whitespace(pc.utf8_lower(easy)), lambda parts: csr(self.all_parts(parts)))
        else:
            done = self._bytes(easy)
        out, hard = iter(done), iter(texts.filter(odd).to_pylist())
        return [self.whole(next(hard)) if o else next(out) for o in odd.to_pylist()]

    def _bytes(self, texts: pa.Array) -> list[np.ndarray]:
        """Parts begin at single blanks; the blank belongs to the part after it."""
        lists = pc.split_pattern(texts, " ")
        ids = by_parts(texts, lists, self._after_blank)
        heads = lists.values.take(lists.offsets[:-1]).to_pylist() if len(texts) else []
        # the first part of a text has no blank before it
        return [
            np.concatenate([np.asarray(self.part(h), np.int32), x[len(self.part(" " + h)) :]]) if h else x
            for x, h in zip(ids, heads)
        ]


    def _after_blank(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts with a blank before them; the part of an empty text has none."""
        out = self.all_parts([" " + p for p in parts])
        return csr([ids if p else () for p, ids in zip(parts, out)])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)
