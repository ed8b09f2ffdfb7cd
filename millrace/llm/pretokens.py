"""Byte-level BPE by whole pre-tokens: a shared table, a bounded cache in each Python worker, the tokenizers library for the rest.

A byte-level BPE encodes each pre-token on its own, so a text's ids are its pre-tokens' ids one after
another. The pattern and the letters that stand for bytes are the public ones of this tokenizer family. Texts for which that isn't known to
hold go to the library whole: those that hold the string of an added token, and those with a code point
that the two regular-expression engines may class differently (unassigned in this Python's Unicode), or a lone surrogate.
"""

from __future__ import annotations

import gc
import os
import unicodedata

import regex

from millrace.llm.common import held

#: Fixed value: the public pre-token pattern of byte-level BPE vocabularies with 50k entries.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The first code point at or above which a text's code points are looked at one by one.
FIRST_DOUBTFUL = 0x530


def vocabulary_path(vocabulary: str) -> str:
    """A vocabulary's file on this machine: a path as it is, a bare name among the installed public files."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def load(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> str:
    """The letter that stands for each byte in such vocabularies: printable Latin-1 characters for themselves, the others by the letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


#: Characters of the longest key that a cache keeps: what is longer is hardly met again, and would let a cache of a bounded number of keys grow without bound.
KEPT_KEY = 64


class _Cache(dict):
    """Key to value in two generations: at its bound the present one becomes the old one, from which what is met again is taken over."""

    def __init__(self, most: int, table: dict | None = None):
        super().__init__(table or {})
        self.most, self.old = most, {}

    def put(self, key: str, value):
        if len(key) > KEPT_KEY:
            return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Pretokens(_Cache):
    """Pre-token to value; encodes what it misses."""

    def __init__(self, encode, most: int, table: dict | None = None):
        super().__init__(most, table)
        self.encode = encode

    def __missing__(self, pretoken: str):
        value = self.old.get(pretoken)
        return self.put(pretoken, self.encode(pretoken) if value is None else value)


#: Marks that make a pre-token of their own behind a letter.
MARKS = frozenset(",.;:!?)")


class _Uneven(Exception):
    """A text with a white-space run that holds a space and more: its spaces don't all begin a pre-token."""


class _Units(_Cache):
    """What stands between two spaces to the value of it with the space before it: the sum of its pre-tokens' values.

    A single space before anything else always begins a pre-token, so a text falls apart there. A unit of letters is one pre-token and kept; so is one of letters with a
    mark at its end, put together from both. Others are taken to pieces and kept; those that go over a line's end are not: such are rarely met again.
    """

    def __init__(self, pieces, value: _Pretokens, add, most: int):
        super().__init__(most, {w[1:]: v for w, v in value.items() if w[0] == " " and w[1:].isalpha()})
        self.pieces, self.value, self.add = pieces, value, add

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            if unit.isalpha():
                value = self.value.encode(" " + unit)
            elif unit[-1:] in MARKS and unit[:-1].isalpha():
                value = self[unit[:-1]] + self.value[unit[-1]]
            elif not unit or unit[0].isspace() or unit[-1].isspace():
                raise _Uneven
            elif "\n" in unit:
                return self.lines(unit)
            else:
                value = self.add(map(self.value.__getitem__, self.pieces(" " + unit)))
        return self.put(unit, value)

    def lines(self, unit: str):
        """The value of a unit that goes over line ends. A line end with no white space beside it is a pre-token, and what follows begins without a space."""
        first, *rest = unit.split("\n")
        if not all(rest) or first[-1].isspace() or any(x[0].isspace() or x[-1].isspace() for x in rest):
            return self.add(map(self.value.__getitem__, self.pieces(" " + unit)))
        end = self.value["\n"]
        return self.add((self[first], *(end + (self.value[x] if x.isalpha() else self.add(map(self.value.__getitem__, self.pieces(x)))) for x in rest)))

    def of(self, text: str):
        first, *rest = text.split(" ")
        try:
            return self.add((self.add(map(self.value.__getitem__, self.pieces(first))), self.add(map(self.__getitem__, rest))))
        except _Uneven:
            return self.add(map(self.value.__getitem__, self.pieces(text)))


class Encoder:
    """Counts and encodes texts in one worker. table: lengths of frequent pre-tokens (tier one)."""

    def __init__(self, vocabulary: str, table: dict[str, int] | None = None, most: int = 340_000):
        import numpy as np

        self.tokenizer = load(vocabulary)
        self.pieces = regex.compile(PATTERN).findall
        self.doubtful = regex.compile(f"[{chr(FIRST_DOUBTFUL)}-{chr(0x10FFFF)}]")
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        model, letters = self.tokenizer.model.tokenize, byte_letters()
        space, width = letters[0x20], self.dtype.itemsize

        def tokens(pretoken: str) -> list:
            if pretoken.isascii() and pretoken.isprintable():  # all bytes but the space stand for themselves
                return model(pretoken.replace(" ", space))
            return model(pretoken.encode().decode("latin-1").translate(letters))

        # each id's bytes once: cached values of one id share them
        packed = [i.to_bytes(width, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]

        self.length = _Pretokens(lambda w: len(tokens(w)), most // 4, table)
        self.bytes = _Pretokens(lambda w: b"".join([packed[t.id] for t in tokens(w)]), most // 4)
        self.length_units = _Units(self.pieces, self.length, sum, most)
        self.bytes_units = _Units(self.pieces, self.bytes, b"".join, most)

    def plain(self, text: str) -> bool:
        """Whether the text may be encoded by its pre-tokens."""
        if any(x in text for x in self.added):
            return False
        if text.isascii() or not self.doubtful.search(text):
            return True
        return all(unicodedata.category(c) not in ("Cn", "Cs") for c in set(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.plain(text):
            return self.length_units.of(text)
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def ids(self, text: str | None) -> bytes:
        """The text's ids as little-endian integers of self.dtype."""
        import numpy as np

        if not text:
            return b""
        if self.plain(text):
            return self.bytes_units.of(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def worker_encoder(vocabulary: str, packed: tuple[str, bytes] | None = None) -> Encoder:
    """This worker's encoder. packed: a table as pack_table() gives it."""

    def make() -> Encoder:
        encoder = Encoder(vocabulary, dict(zip(packed[0].split("\0"), packed[1], strict=True)) if packed else None)
        gc.freeze()  # the tables hold no cycles: the collector needn't go through them again and again
        return encoder

    return held(("encoder", vocabulary, packed is not None), make)


def frequent_lengths(vocabulary: str) -> dict[str, int]:
    """Tier one: each vocabulary entry that is a whole pre-token, with its number of ids.

    BPE made its entries from the most frequent strings of its corpus, so the list needs no pass over
    ours, and the vocabulary bounds it whatever the input's size.
    """
    tokenizer = load(vocabulary)
    whole = regex.compile(PATTERN).fullmatch
    words = sorted({tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())})
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    words = [w for w in words if w and "\0" not in w and "�" not in w and w not in added and whole(w)]
    return {w: len(e) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}


def pack_table(table: dict[str, int]) -> tuple[str, bytes]:
    """The table as one string of keys and one byte a length: what is broadcast."""
    return "\0".join(table), bytes(table.values())
