"""Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit integers, all from the ``tokenizers`` library.

The library spends most of its time on words it has encoded before. So a text is cut where the library's pattern always
ends a pre-token, each different piece is encoded by the library once a worker, and a text's ids are its pieces' ids in
order. Two kinds of place are such ends, whatever stands around them, since no branch of the pattern holds both
characters and its only look-ahead asks about white space: before white space that follows anything else, and between an
ASCII letter or digit and a mark of ``MARKS``.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from tokenizers import Tokenizer


def bytes_of_unicode() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    table, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in table.values():
            table[chr(256 + extra)] = b
            extra += 1
    return table


#: White space as the library has it; Python's own class has four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = r""".,;:!?"()"""
_PIECE = re.compile(f"[{SPACE}]*+(?:[A-Za-z0-9]++(?=[{MARKS}{SPACE}]|\\Z)|[^{SPACE}]+)|[{SPACE}]+")
_JOINS = re.compile(f"[{SPACE}].*[^{SPACE}]\\Z", re.DOTALL)
#: New pieces that the library gets as one text.
JOINED = 2_000
#: Characters of texts that are cut at once, and pieces of a longer text.
GROUP, PART = 250_000, 50_000
#: Longest piece whose ids are kept.
KEPT_CHARS = 64

_ASSIGNED: set[str] = set()


def all_assigned(text: str) -> bool:
    """Are all code points of ``text`` assigned ones? Those seen before are kept."""
    if text.isascii():
        return True
    new = set(text) - _ASSIGNED
    _ASSIGNED.update(c for c in new if unicodedata.category(c) != "Cn")
    return new <= _ASSIGNED


class ByteBpe:
    """Encoder for one vocabulary file; ``ids(text)`` gives 4 bytes for each id.

    Keeps the ids of at most ``cap`` pieces of up to ``KEPT_CHARS`` characters; beyond that the older half goes. A file
    whose pattern, normaliser or special tokens could make a cut unsafe has its texts encoded uncut.
    """

    def __init__(self, path: str, cap: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        whole = all(len(_PIECE.findall(t["content"])) == 1 for t in spec["added_tokens"])
        bare = not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self._cut = plain and whole and bare and not spec["normalizer"]
        vocab = self._library.get_vocab(with_added_tokens=True)
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # of each id's token; in the file a character is a byte
        for token, i in vocab.items():
            self._bytes[i] = len(token)
        for t in spec["added_tokens"]:
            self._bytes[t["id"]] = len(t["content"].encode())
        self._known: dict[str, bytes] = {}
        self._cap = cap

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        found = (e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def _learn(self, new: list[str]) -> None:
        """Keep the ids of new pieces. Those from white space to anything else can stand in one text, where each begins
        at a cut; the bytes that ids stand for tell which piece they belong to."""
        apart = [p for p in new if not _JOINS.match(p)]
        self._known.update(zip(apart, self._library_ids(apart), strict=True))
        joined = [p for p in new if _JOINS.match(p)]
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            raw = self._library_ids(["".join(part)])[0]
            ends = np.cumsum(self._bytes[np.frombuffer(raw, "<u4")])
            wanted = np.cumsum([len(p.encode()) for p in part])
            last = np.searchsorted(ends, wanted)
            if ends[-1] == wanted[-1] and (ends[last] == wanted).all():
                stops = ((last + 1) * 4).tolist()
                found = [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)]
            else:  # a vocabulary that lacks some bytes
                found = self._library_ids(part)
            self._known.update(zip(part, found, strict=True))

    def _encoded(self, lists: list[list[str]]) -> list[bytes]:
        known = self._known
        new = list(set().union(*lists).difference(known))
        self._learn(new)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in lists]
        for p in new:
            if len(p) > KEPT_CHARS:
                del known[p]
        if len(known) > self._cap:
            for p in list(islice(known, len(known) - self._cap // 2)):
                del known[p]
        return out

    def _long(self, text: str) -> bytes:
        found, parts = (m[0] for m in _PIECE.finditer(text)), []
        while pieces := list(islice(found, PART)):
            parts += self._encoded([pieces])
        return b"".join(parts)

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text; strings of special tokens become those tokens, as the library does by default."""
        if not self._cut:
            yield from (self._library_ids([text])[0] for text in texts)
            return
        lists, held = [], 0
        for text in texts:
            if lists and held + len(text) > GROUP:
                yield from self._encoded(lists)
                lists, held = [], 0
            if len(text) > GROUP:
                yield self._long(text)
            else:
                lists.append(_PIECE.findall(text))
                held += len(text)
        yield from self._encoded(lists)

    def ids(self, text: str) -> bytes:
        """Ids of one text."""
        return next(self.each([text]))


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe:
    """One encoder for each Python worker and file."""
    return ByteBpe(path)
