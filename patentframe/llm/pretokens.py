"""Whole texts to token ids with the tokenizers library, a distinct pre-token at a time.

A tokenizer of this kind maps each pre-token alone, so a task needs the library only for pre-tokens it has not met:
texts are split by the tokenizer's own pattern, a bounded memo holds the ids by pre-token, and misses are encoded in
batches. Texts with characters beyond Latin, odd white space or a special token's string go to the library whole.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np

#: The letters and numbers among the code points that the quick way takes.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t\n\r \xa0"
ODD = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")
# the tokenizers' patterns for those; words come first here, as no other alternative can begin where they do
BYTE_LEVEL = re.compile(rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
WORD_END = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{SPACES}{LETTERS}{NUMBERS}]+")


def _printable() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onward in turn."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(others)}


PRINTABLE = _printable()


class Codes(dict):
    """Numbers new keys as they are first looked up and keeps them in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, key):
        self[key] = code = len(self)
        self.pending.append(key)
        return code


class Ragged:
    """Growing list of id rows in one flat array: ``take`` joins the rows of many codes at once."""

    def __init__(self):
        self.flat, self.ends, self.n, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, rows: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.extend(np.fromiter(itertools.chain.from_iterable(rows), np.uint32, int(lengths.sum())), lengths)

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Rows of these lengths, end to end."""
        n, total = len(lengths), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + total] = flat
        self.ends[self.n + 1 : self.n + 1 + n] = self.used + np.cumsum(lengths)
        self.n += n
        self.used += total

    def take_all(self, codes: np.ndarray, parts: list[int]) -> tuple[np.ndarray, list[int]]:
        """The rows of codes end to end, and where the rows of each part, so many codes long, end."""
        lengths = np.concatenate([[0], np.cumsum(self.ends[codes + 1] - self.ends[codes])])
        return self.take(codes), lengths[np.cumsum(parts)].tolist()

    def take(self, codes: np.ndarray) -> np.ndarray:
        starts = self.ends[codes]
        lengths = self.ends[codes + 1] - starts
        at = np.cumsum(lengths)
        total = int(at[-1]) if len(at) else 0
        return self.flat[np.repeat(starts - (at - lengths), lengths) + np.arange(total)]


class TextEncoder:
    """``encode(texts)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` of each as uint32.

    As in that call, a special token's string in a text gives the special token's id; with ``special_as_text`` (the
    library's ``encode_special_tokens``) it is ordinary text. The memo forgets at ``most`` pre-tokens.
    """

    def __init__(self, path: str, most: int = 600_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.path, self._whole, self.special_as_text = path, None, special_as_text
        self.special = [] if special_as_text else [t["content"] for t in spec["added_tokens"]]
        self.lower = spec["normalizer"] is not None
        self.pattern = WORD_END if self.lower else BYTE_LEVEL
        self.most = most
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []})).model
        self._clear()

    def _clear(self) -> None:
        self.codes, self.rows = Codes(), Ragged()
        self.again = np.zeros(2 * self.most + (1 << 20), bool)  # a group of texts may overrun the bound; more is grown

    def _forget(self) -> None:
        """Keep what was met again since the last time, unless that is most of the memo."""
        kept = np.flatnonzero(self.again[: self.rows.n])
        if len(kept) > self.most // 2:
            self._clear()
            return
        keys, flags, rows = list(self.codes), self.again, self.rows
        self._clear()
        for key in (k for k, again in zip(keys, flags.tolist()) if again):
            self.codes[key]
        self.codes.pending = []
        self.rows.extend(rows.take(kept), rows.ends[kept + 1] - rows.ends[kept])

    def _miss(self, pending: list[str]) -> None:
        """Ids of new pre-tokens, by the library's model alone: its input is the bytes as printable characters."""
        spelled = [x.encode().decode("latin-1").translate(PRINTABLE) for x in pending]
        self.rows.add([[t.id for t in self.model.tokenize(x)] for x in spelled])

    def whole(self, text: str) -> np.ndarray:
        """A text by the library alone."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = self.special_as_text
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > self.most:
            self._forget()
        before = self.rows.n
        codes: list[np.ndarray] = []
        odd: dict[int, np.ndarray] = {}
        for k, text in enumerate(texts):
            plain = text.lower() if self.lower else text  # some letters' lower case is beyond those the pattern knows
            if ODD.search(plain) or any(s in text for s in self.special):
                odd[k] = self.whole(text)
                found = []
            else:
                found = self.pattern.findall(plain)
            codes.append(np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found)))
        if self.codes.pending:
            self._miss(self.codes.pending)
            self.codes.pending = []
            if self.rows.n > len(self.again):
                self.again = np.concatenate([self.again, np.zeros(self.rows.n, bool)])
        every = np.concatenate(codes)
        self.again[every[every < before]] = True
        flat, ends = self.rows.take_all(every, [len(c) for c in codes])
        return [odd[k] if k in odd else flat[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends))]


def groups(column, most: int = 64, chars: int = 1 << 20):
    """Texts of an Arrow column in lists of at most ``most``, or fewer with about ``chars`` characters."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1])
        if len(held) == most or size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> TextEncoder:
    """One encoder for each Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = path, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, special_as_text=special_as_text)
    return _ENCODERS[key]
