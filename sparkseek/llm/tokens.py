"""p6: encoding of texts with a public byte-level BPE vocabulary, by a pair occurrence index.

Every batch of a partition is cut into pieces (the vocabulary's published pre-split pattern), and each different piece
is written once, as its bytes' ids, into one long array. An index maps every adjacent pair that the vocabulary can merge
to all its positions. The active ranks are then applied in ascending order: one step merges all positions of one pair
with array operations, takes the pairs that vanish out of the lists and adds the new ones. A text's ids are its pieces'
ids in order. Because a merged token only takes part in merges of higher rank, ascending order over the whole batch
gives the same ids as merging every piece by itself.

Defined cases
    null and empty texts give an empty list; special tokens are ordinary text; one row per input row, so repeated
    documents count as often as they occur unless ``encode`` is given distinct ids (p6_ids keeps one row per ``doc_id``);
    very long texts and very long pieces are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter, and never copied into the repository.
VOCABULARIES = os.environ.get("SPARKSEEK_TOKENIZERS", "/opt/tokenizers")
#: The pre-split pattern published with the 50k byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts of ASCII characters only, which are most; the faster engine then suffices.
ASCII_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
#: Characters of different pieces that are indexed together, and pieces whose ids a worker remembers.
INDEX_CHARS, REMEMBERED = 2_000_000, 200_000


class PairIndex:
    """The vocabulary of one ``.tiktoken`` file, and the merging of many pieces at once."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        words = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            words[rank] = word
        self.size = len(words)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # every split of a word into two words of the vocabulary is a pair that merges into it
        left, right, made = [], [], []
        for word, rank in self.ranks.items():
            for i in range(1, len(word)):
                a, b = self.ranks.get(word[:i]), self.ranks.get(word[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        codes = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.made = codes[order], np.array(made, dtype=np.int64)[order]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, or -1."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.made[at], -1)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        # one cell per byte and one empty cell (-1) after every piece
        ends = np.cumsum(sizes + 1) - 1
        token = np.full(int(ends[-1]) + 2 if len(ends) else 1, -1, dtype=np.int64)
        where = np.arange(len(flat)) + np.repeat(np.arange(len(pieces)), sizes)
        token[where] = self.of_byte[flat]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        positions: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Index the pairs that begin at these positions, by the token they merge into."""
            rank = self.merged(token[at], token[np.minimum(after[at], n - 1)])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [*np.flatnonzero(np.diff(rank, prepend=-1)), len(rank)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = int(rank[a])
                if key not in positions:
                    positions[key] = []
                    heapq.heappush(active, key)
                positions[key].append(at[a:b])

        add(where)
        while active:
            rank = heapq.heappop(active)
            at = np.unique(np.concatenate(positions.pop(rank)))
            # positions whose pair has changed since it was listed no longer merge into this token
            at = at[token[at] >= 0]
            at = at[self.merged(token[at], token[after[at]]) == rank]
            # of overlapping pairs (a a a) the leftmost merges first
            if len(at) > 1 and (after[at[:-1]] == at[1:]).any():
                run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            token[at], token[gone] = rank, -2
            after[at] = beyond
            before[beyond] = at
            touched = np.concatenate([at, before[at]])
            touched = np.unique(touched[touched >= 0])
            add(touched[token[touched] >= 0])
        kept = token[token != -2]
        stops = np.flatnonzero(kept == -1)
        ids = kept.tolist()
        return [ids[a:b] for a, b in zip([0, *(stops[:-1] + 1).tolist()], stops.tolist(), strict=False)][: len(pieces)]


_LOADED: dict[str, tuple[PairIndex, dict[str, list[int]]]] = {}


def _encode_batches(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _LOADED:
            _LOADED[path] = PairIndex(path), {}
        index, known = _LOADED[path]
        split, split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        for pdf in batches:
            pieces = [(split_ascii if t.isascii() else split)(t) if t else [] for t in pdf["text"]]

            def flush(new: list[str]) -> None:
                if new:
                    for piece, ids in zip(new, index.encode([p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
                        known[piece] = ids

            new, size = [], 0
            for piece in set(itertools.chain.from_iterable(pieces)).difference(known):
                new.append(piece)
                size += len(piece)
                if size > INDEX_CHARS:
                    flush(new)
                    new, size = [], 0
            flush(new)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [[*itertools.chain.from_iterable(map(known.__getitem__, own))] for own in pieces]})
            if len(known) > REMEMBERED:
                known.clear()

    return run


def encode(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: each text as the ids of a public byte-level vocabulary. No shuffle; see the module text."""
    path = f"{folder or VOCABULARIES}/{vocabulary}.tiktoken"
    rows = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(_encode_batches(path), "doc_id long, ids array<long>")


def encode_once(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``encode`` with one row per id: repeated rows count once, and of different texts of an id the smallest is taken.

    Only ids are compared first. Where every id is unique no text is shuffled at all; otherwise the texts of repeated ids are.
    """
    rows = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return encode(rows, **options)
    return encode(rows.groupBy("doc_id").agg(F.min("text").alias("text")), **options)
