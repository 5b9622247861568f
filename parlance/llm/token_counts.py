"""Token counts by rank-synchronous array merging, for word vocabularies with word-end symbols.

Pre-tokens are kept as ragged numpy arrays of symbols. In each round every sequence finds its lowest-ranked adjacent
pair and all occurrences of that pair in it are merged at once, which is the order in which one-pair-at-a-time merging
works; sequences without a ranked pair are done. The count of a pre-token is the number of symbols that survive.

A very long pre-token would pass over all its symbols once for each of its merges. There the same rounds, one rank at a
time, touch only the places of that rank: symbols are a linked list in arrays, and places wait in a queue by rank.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.bpe import SPACE, all_assigned, bytes_of_unicode

#: The pattern on lower-cased ASCII without an apostrophe, where white space is as the library has it.
_PLAIN = re.compile(r"[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: Pre-tokens of more bytes are merged by themselves.
LONG = 256


class RankMerger:
    """Counts of pre-tokens for one tokenizers JSON file with lower-casing, byte-level symbols and a word-end suffix."""

    def __init__(self, path: str, cap: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not suffix:
            raise ValueError("only lower-casing word vocabularies with a word-end suffix are supported")
        vocab = model["vocab"]
        stand_in = {b: c for c, b in bytes_of_unicode().items()}
        self.inner = np.array([vocab[stand_in[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[stand_in[b] + suffix] for b in range(256)], np.int64)
        self.size = len(vocab)
        left, right, new = zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])), strict=True)
        pairs = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank, self.new = pairs[order], order, np.array(new, np.int64)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}")).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special, self.marks = re.compile("|".join(map(re.escape, special))), tuple(special)
        self.cap, self.known = cap, {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * self.size + b
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.rank[at], len(self.pairs))

    def merged(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = np.zeros(len(raw), np.int64)
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        out[short] = self._batch([raw[i] for i in short])
        for i, r in enumerate(raw):
            if len(r) > LONG:
                out[i] = self._single(r)
        return out

    def _single(self, raw: bytes) -> int:
        """Symbols that survive in one long word; a round takes the places of the lowest rank that is left."""
        data, n, none = np.frombuffer(raw, np.uint8), len(raw), len(self.pairs)
        symbol = self.inner[data]
        symbol[-1] = self.final[data[-1]]
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        queue: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            of = self._ranks(symbol[places], symbol[after[places]])
            places, of = places[of < none], of[of < none]
            order = np.argsort(of, kind="stable")
            places, of = places[order], of[order]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            for rank, part in zip(of[starts].tolist(), np.split(places, starts[1:]), strict=False):
                if rank not in queue:
                    queue[rank] = []
                    heapq.heappush(ranks, rank)
                queue[rank].append(part)

        wait(np.arange(n - 1))
        while ranks:
            rank = heapq.heappop(ranks)
            at = np.unique(np.concatenate(queue.pop(rank)))
            at = at[alive[at] & (after[at] < n)]
            at = at[(symbol[at] == self.left[rank]) & (symbol[after[at]] == self.right[rank])]
            if not len(at):
                continue
            run = np.append(True, after[at[:-1]] != at[1:])  # of overlapping places (aaa) every second one, from the left
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0]
            gone = after[at]
            symbol[at], alive[gone] = self.new[rank], False
            after[at] = beyond = after[gone]
            before[beyond[beyond < n]] = at[beyond < n]
            wait(np.unique(np.concatenate([at[beyond < n], before[at][before[at] >= 0]])))
        return int(alive.sum())

    def _batch(self, raw: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of many short words, all merged in the same rounds."""
        words = raw
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbol, owner = self.inner[data], np.repeat(np.arange(len(words)), lengths)
        symbol[ends] = self.final[data[ends]]
        out, none = np.zeros(len(words), np.int64), len(self.pairs)
        while len(symbol):
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            inside = owner[1:] == owner[:-1]
            ranks = np.full(len(symbol), none)
            ranks[:-1][inside] = self._ranks(symbol[:-1][inside], symbol[1:][inside])
            best = np.minimum.reduceat(ranks, start)
            size = np.diff(np.append(start, len(symbol)))
            out[owner[start[best == none]]] = size[best == none]
            hit = (ranks == np.repeat(best, size)) & (ranks < none)
            where = np.flatnonzero(hit)
            if len(where):  # of a run of overlapping hits (aaa) every second one, from the left
                run = np.diff(where, prepend=-2) != 1
                first = where[run][np.cumsum(run) - 1]
                where = where[(where - first) % 2 == 0]
            keep = np.repeat(best != none, size)
            symbol[where] = self.new[ranks[where]]
            keep[where + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return _PLAIN.findall(text) if text.isascii() and "'" not in text else self.words(text)

    def counts(self, texts: list[str | None], block: int = 2 << 20) -> list[int]:
        """Tokens of each whole text, 0 for null; a special token's string in it is one token.

        Texts are taken in blocks of about ``block`` characters, so that many new pre-tokens are merged at once.
        """
        out: list[int] = []
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts, 1):
            text = text or ""
            marks, words = 0, []
            if not all_assigned(text):  # libraries differ in the classes of code points that they don't know
                marks = len(self.library.encode(text, add_special_tokens=False).ids)
            elif any(mark in text for mark in self.marks):
                marks = len(self.special.findall(text))
                words = [w for part in self.special.split(text) for w in self.pre_tokens(part)]
            else:
                words = self.pre_tokens(text)
            held.append((marks, words))
            size += len(text)
            if size >= block or i == len(texts):
                lookup = self._lookup({w for _, words in held for w in words})
                out += [marks + sum(map(lookup, words)) for marks, words in held]
                held, size = [], 0
        return out

    def _lookup(self, words: set[str]):
        """A function from pre-token to count, for all of ``words``."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.cap:
            self.known = {w: self.known[w] for w in words if w in self.known}
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.known.update(zip(part, self.merged(part).tolist(), strict=True))
        return self.known.__getitem__


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    """One merger for each Python worker and file."""
    return RankMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every whole text; null texts count as empty.

    Rows with null or repeated ids keep their row; an empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = merger(vocabulary).counts
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts(batch.column(2).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
