"""Ids of whole texts by a tokenizer file, with the ids of repeated chunks remembered.

A text is cut where the tokenizer's own pre-tokenizer always cuts, so the ids of the
chunks in a row are the ids of the text, and each chunk is encoded once per worker process.
Texts with "<|" may hold special tokens and go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

import numpy as np

#: Chunks remembered in one worker; beyond it the memory starts anew.
REMEMBERED = 1_000_000

#: Chunks that are encoded as one text: parted by a special token, or where words begin.
JOINED, JOINED_WORDS = 2000, 200

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACED = re.compile(r" ?[^ ]+")
_ODD_SPACE = re.compile(r" \s|\s | \Z|\A ")
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")


#: White space but the space, in ASCII and beyond, and what of it touches a space.
_ASCII_WHITE, _OTHER_WHITE = (tuple(c for c in map(chr, codes) if c.isspace() and c != " ") for codes in (range(128), range(128, 0x3001)))
_TOUCHING = ("  ", *(pair for c in _ASCII_WHITE for pair in (f" {c}", f"{c} ")))


def _has_odd_space(text: str) -> bool:
    """Whether a space touches other white space or an end of the text: by plain searches, the pattern only where there is white space beyond ASCII."""
    if text.startswith(" ") or text.endswith(" "):
        return True
    for pair in _TOUCHING:
        if pair in text:
            return True
    if not text.isascii():
        for c in _OTHER_WHITE:
            if c in text:
                return _ODD_SPACE.search(text) is not None
    return False


def cut_at_whitespace(text: str) -> list[str]:
    """For tokenizers that drop white space."""
    return _WORDS.findall(text)


def cut_before_words(text: str) -> list[str]:
    """For byte-level tokenizers: cuts before a single space between two other characters; loses nothing."""
    if _has_odd_space(text):
        return _BEFORE_WORD.split(text)
    return _SPACED.findall(text)


class _Codes(dict):
    """Numbers for chunks in order of first sight; new holds those seen since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        n = self[chunk] = len(self)
        return n


def _flat(ids: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids in a row, and how many each has."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x, np.uint32) for x in ids)]), size


class ChunkEncoder:
    def __init__(self, path: str, cut: Callable[[str], list[str]], remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.remembered = cut, remembered
        special = sorted((k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and "<|" in t.content)
        self.parted = special[0] if special and cut is cut_at_whitespace else None  # byte-level ones gain nothing by it
        # By id how many bytes a token of a byte-level vocabulary has: a character each.
        self.bytes_of = None
        if cut is cut_before_words and "ByteLevel" in repr(self.tokenizer.pre_tokenizer):
            vocabulary = self.tokenizer.get_vocab()
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))
        self.forget()

    def forget(self) -> None:
        self.codes = _Codes()
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        ids, size = self._encoded(new) if self.bytes_of is None else self._words(new)
        start = np.cumsum(size) - size + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.size, self.start = np.concatenate([self.size, size]), np.concatenate([self.start, start])

    def _words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has. Of chunks that begin with a space and a word and end with one many are encoded in a row: the tokenizer cuts between them, and where it did so follows from the tokens' bytes."""
        plain = np.fromiter((len(c) > 1 and c[0] == " " and not c[1].isspace() and not c[-1].isspace() for c in chunks), bool, len(chunks))
        words, others = ([chunks[k] for k in np.flatnonzero(rows).tolist()] for rows in (plain, ~plain))
        joined = ["".join(words[at : at + JOINED_WORDS]) for at in range(0, len(words), JOINED_WORDS)]
        ids, _ = _flat([x.ids for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in words), np.int64, len(words)))
        reached = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(reached, ends)
        if len(words) and (last[-1] >= len(reached) or (reached[last] != ends).any()):
            raise ValueError("a token runs over the beginning of a word")
        more, more_size = self._encoded(others)
        ids, size = np.concatenate([ids, more]), np.concatenate([np.diff(last, prepend=-1), more_size])
        # Back in the order of the chunks.
        back = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), kind="stable")
        start, size = (np.cumsum(size) - size)[back], size[back]
        return ids[np.arange(len(ids)) + np.repeat(start - (np.cumsum(size) - size), size)], size

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has. Many chunks are one text where a special token can part them: the library encodes what lies between special tokens on its own."""
        if self.parted is None:
            return _flat([x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])
        number, token = self.parted
        joined = [token.join(chunks[at : at + JOINED]) for at in range(0, len(chunks), JOINED)]
        ids, _ = _flat([[*x.ids, number] for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        size = np.diff(np.flatnonzero(ids == number), prepend=-1) - 1
        return ids[ids != number], size

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has. A null text has none."""
        if len(self.codes) > self.remembered:
            self.forget()
        look, codes, chunks, whole = self.codes.__getitem__, [], np.zeros(len(texts), np.int64), {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text:
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            before = len(codes)
            codes.extend(map(look, self.cut(text)))
            chunks[k] = len(codes) - before
        if self.codes.new:
            self._learn()
        code = np.array(codes, np.int64)
        size = self.size[code]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.start[code] - (ends - size), size)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(chunks)])]
        count = np.diff(edges)
        if whole:
            parts = [whole[k] if k in whole else ids[edges[k] : edges[k + 1]] for k in range(len(texts))]
            ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, count


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, cut: Callable[[str], list[str]]) -> ChunkEncoder:
    """One encoder per worker process; Spark keeps the process for later tasks."""
    key = (path, cut.__name__)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, cut)
    return _encoders[key]


def forget() -> None:
    """Gives up what this worker process remembers of texts, for stages that need the memory and no ids."""
    for known in _encoders.values():
        known.forget()


def append_end(ids: np.ndarray, count: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends an end id to the ids of each text."""
    return np.insert(ids, np.cumsum(count), end).astype(np.uint32), count + 1
