"""p7: evaluation texts inside training texts, by template canonicalisation and a hash join of template windows.

Texts are reduced to words without case, markup, punctuation, line prefixes and layout (characters for Han script).
Numbers, names and units become typed placeholders, and every window of five such words is hashed; a Han character is a
word, so windows are the same in texts of mixed scripts. The windows of all documents are joined with those of the items;
pairs that share as many as any run within the exchange tolerance keeps (``least_hits``) are aligned word by word. The slots under
the placeholders are compared along the alignment: equal slots make a copy, slots renamed one-to-one make a re-parameterised copy,
other slots count as exchanged words.

How the work is laid out
    Documents pass once through the scan stage, where their windows are exploded and joined with the items' windows. These are
    broadcast if a count and their bytes find them small, and both sides are shuffled by window otherwise (adaptive execution then
    splits windows that many texts share). Only (document, item) counts are shuffled, summed before. The candidate pairs, ids only, and
    the item texts are broadcast to the documents under the same check. For each pair the shifts at which enough trigrams agree are
    found first, by counting; only those are aligned.

Defined cases
    null, empty and blank texts hold nothing and leak nothing; an item of fewer than WINDOW words has no window, so it leaks nothing,
    and a run has WINDOW words at least; repeated documents and items count once (an id with several texts is searched in all of
    them); columns of other names are ignored.
"""

from __future__ import annotations

import html
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.session import broadcast_if_small, cut

#: Words (or Han characters) of a window.
WINDOW = 5
#: Items that a worker remembers.
REMEMBERED = 8_000
#: Share of an item's words that a leaked run has, exchanged words within it, and how far the alignment may drift.
LEAKED, EXCHANGED, DRIFT = 0.4, 0.1, 4

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--|-->")
_PREFIX = re.compile(r"^[ \t]*(?:(?:[>|*+#;%-]|//|--)+[ \t]*)*(?:[A-Za-z]?\d+[.:)|\]]+[ \t]+)?", re.M)
_WORD = re.compile(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+(?:_+[^\W_㐀-鿿豈-﫿]+)*")
#: The same for texts of ASCII characters only, which are most; it is the faster one.
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:_+[A-Za-z0-9]+)*")
_UNITS = frozenset("ms s sec secs second seconds minute minutes hour hours day days week weeks byte bytes kb mb gb tb percent rows row lines line tage tag zeilen minuten sekunden prozent".split())


def words(text: str | None) -> list[str]:
    """The words of a text in their original case: markup, line prefixes and punctuation are gone."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = _PREFIX.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text)
    return _WORD.findall(unicodedata.normalize("NFKC", text))


def placeholder(word: str) -> str:
    """The typed placeholder of a number, name or unit; the folded word otherwise."""
    if word.isdigit():
        return "#"
    if "_" in word or (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)) or re.search(r"[a-z][A-Z]", word):
        return "@"
    low = word.casefold()
    return "%" if low in _UNITS else low


class Codes:
    """Stable 64-bit codes of words and of their placeholders, remembered by the worker."""

    def __init__(self) -> None:
        self.exact: dict[str, int] = {}
        self.typed: dict[str, int] = {}

    def of(self, tokens: list[str], typed: bool) -> np.ndarray:
        known = self.typed if typed else self.exact
        if len(known) > 2_000_000:
            known.clear()
        fresh = list(set(tokens).difference(known))
        if fresh:
            as_words = pd.Series([placeholder(w) if typed else w.casefold() for w in fresh], dtype=object)
            known.update(zip(fresh, pd.util.hash_array(as_words.to_numpy()).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


_CODES = Codes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(texts: list[list[str]]) -> list[np.ndarray]:
    """The hashes of the template windows that begin at each word of each text; all texts are hashed at once."""
    codes = _CODES.of(list(itertools.chain.from_iterable(texts)), typed=True)
    n = max(0, len(codes) - WINDOW + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        out ^= codes[i : i + n]
        out *= _MIX
        out ^= out >> np.uint64(29)
    out, hashes, at = out.view(np.int64), [], 0
    for text in texts:
        hashes.append(out[at : max(at, at + len(text) - WINDOW + 1)])
        at += len(text)
    return hashes


def least_run(n: int) -> int:
    """The fewest words of an item of ``n`` words that are a leak."""
    return min(n, max(WINDOW, math.ceil(LEAKED * n - 1e-9)))


def least_hits(n: int, repeated: int = 0) -> int:
    """The fewest different windows of an item of ``n`` words that a leaked run shares with it, wherever its exchanged words stand:
    each takes WINDOW windows at most. ``repeated``: windows of the item that occur before."""
    runs = range(least_run(n), n + 1)
    return max(1, min(size - WINDOW + 1 - WINDOW * int(EXCHANGED * size + 1e-9) for size in runs) - repeated)


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different template windows of each item that is long enough, and how many of them a candidate has to hold."""
    for pdf in batches:
        tokens = [words(t) for t in pdf["item_text"]]
        hashes = window_hashes(tokens)
        different = [np.unique(h) for h in hashes]
        least = [least_hits(len(t), len(h) - len(d)) if len(t) >= WINDOW else 0 for t, h, d in zip(tokens, hashes, different, strict=True)]
        yield pd.DataFrame({"item_id": pdf["item_id"], "windows": different, "least": least})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each different template window of each text."""
    for pdf in batches:
        different = [np.unique(h) for h in window_hashes([words(t) for t in pdf["text"]])]
        if different:
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), [len(h) for h in different]), "h": np.concatenate(different)})


def trigrams(codes: np.ndarray) -> np.ndarray:
    """A code for every three words that follow one another."""
    return (codes[:-2] * np.uint64(3) + codes[1:-1]) * _MIX + codes[2:]


class Text:
    """The codes of a text, and its trigrams in order."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        own = trigrams(codes) if len(codes) >= 3 else np.zeros(0, dtype=np.uint64)
        self.order = np.argsort(own, kind="stable")
        self.trigrams, self.sorted = own, own[self.order]
        self.padded = np.r_[self.sorted, self.sorted[-1:], np.zeros(1, dtype=np.uint64)]


def shifts(doc: Text, item: Text) -> tuple[np.ndarray, np.ndarray]:
    """(shifts, trigrams that agree at each shift from -n on): the shifts of the document against the item near which so many
    trigrams agree as a leaked run keeps. Of m words every tenth may be exchanged, each of which takes three trigrams, and a few more
    may go where words are put in or left out."""
    n = len(item.codes)
    need = max(1, 0.6 * least_run(n) - 3)
    lo = doc.sorted.searchsorted(item.trigrams)
    there = np.flatnonzero(doc.padded[lo] == item.trigrams)
    if len(there) < need:
        return there[:0], there
    lo = lo[there]
    size = doc.sorted.searchsorted(item.trigrams[there], "right") - lo
    counts = np.zeros(len(doc.codes) + n + 1, dtype=np.int64)  # of the shifts from -n on
    if len(there) == size.sum():
        counts += np.bincount(doc.order[lo] - there + n, minlength=len(counts))
    else:  # in parts, as trigrams that both texts repeat often make many
        for part in np.split(np.arange(len(there)), np.flatnonzero(np.diff(np.cumsum(size) // 2_000_000)) + 1):
            own = size[part]
            at = doc.order[np.repeat(lo[part] - np.cumsum(own) + own, own) + np.arange(own.sum())]
            counts += np.bincount(at - np.repeat(there[part], own) + n, minlength=len(counts))
    total = np.zeros(len(counts) + 2 * DRIFT + 1, dtype=np.int64)
    np.cumsum(counts, out=total[DRIFT + 1 : len(counts) + DRIFT + 1])
    total[len(counts) + DRIFT + 1 :] = total[len(counts) + DRIFT]
    near = total[2 * DRIFT + 1 :] - total[: -2 * DRIFT - 1]
    if near.max() < need:
        return there[:0], counts
    return np.flatnonzero((near >= need) & (counts > 0)) - n, counts


def aligned_run(doc: Text, item: Text) -> tuple[float, int, int]:
    """The longest run of the item's words that the document holds with at most EXCHANGED of them changed: its share of
    the item, its first word and the document's shift against the item there."""
    n = len(item.codes)
    found, counts = shifts(doc, item)
    best = (0.0, 0, 0)
    for s in found:
        same = np.zeros(n, dtype=bool)
        for d in range(-DRIFT, DRIFT + 1):
            if d and not (0 <= s + d + n < len(counts) and counts[s + d + n]):
                continue
            a, b = max(0, -int(s + d)), min(n, len(doc.codes) - int(s + d))
            if a >= b:
                continue
            eq = np.zeros(n, dtype=bool)
            eq[a:b] = item.codes[a:b] == doc.codes[a + s + d : b + s + d]
            if d:  # off the main shift only whole trigrams count
                t = eq[:-2] & eq[1:-1] & eq[2:]
                eq = np.zeros(n, dtype=bool)
                eq[:-2] |= t
                eq[1:-1] |= t
                eq[2:] |= t
            same |= eq
        # longest [a, b) with misses <= EXCHANGED * length: prefix sums of (miss - EXCHANGED) must not rise
        run = np.r_[0.0, np.cumsum((~same) - EXCHANGED)]
        low = np.maximum.accumulate(run)
        starts = np.searchsorted(low, run - 1e-9)
        length = np.arange(n + 1) - starts
        end = int(np.argmax(length))
        if length[end] / n > best[0]:
            best = (float(length[end] / n), int(starts[end]), int(s))
    return best


def slots(doc: list[str], item: list[str], first: int, size: int, shift: int) -> dict[str, str]:
    """The item's slots and what stands in their places along an alignment, if they are renamed one-to-one and differ at all;
    nothing otherwise."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for i in range(first, first + size):
        j = i + shift
        if not 0 <= j < len(doc):
            continue
        kind = placeholder(item[i])
        if kind not in "#@" or kind != placeholder(doc[j]):
            continue
        a, b = item[i].casefold(), doc[j].casefold()
        if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
            return {}
    return there if any(a != b for a, b in there.items()) else {}


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple[list[str], Text, Text]] = {}
    for pdf in batches:
        out = []
        tokens = {t: words(t) for t in pdf["text"].unique()}
        _CODES.of(list(set(itertools.chain.from_iterable(tokens.values()))), typed=True)  # new words are hashed together
        for doc_text, own in pdf.groupby("text", sort=False):
            doc = tokens[doc_text]
            typed, exact = Text(_CODES.of(doc, True)), None
            for row in own.itertuples():
                if row.item_text not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    own_words = words(row.item_text)
                    known[row.item_text] = own_words, Text(_CODES.of(own_words, True)), Text(_CODES.of(own_words, False))
                item, item_typed, item_exact = known[row.item_text]
                least = least_run(len(item)) / len(item)
                # the template has to hold first; then its slots and words are compared
                template, first, shift = aligned_run(typed, item_typed)
                share, renamed = 0.0, {}
                if template >= least:
                    exact = Text(_CODES.of(doc, False)) if exact is None else exact
                    share = aligned_run(exact, item_exact)[0]
                    if share < least:
                        renamed = slots(doc, item, first, round(template * len(item)), shift)
                kind = "copy" if share >= least else "renamed" if renamed else "none"
                out.append((row.id, row.item_id, kind, share, template, [f"{a} -> {b}" for a, b in renamed.items() if a != b]))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "share", "template_share", "slots"])


_PAIRS = "doc_id long, item_id long, kind string, share double, template_share double, slots array<string>"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, kind, share, template_share, slots)`` of every candidate pair.

    ``kind`` is ``copy`` (the run holds with the exchange tolerance), ``renamed`` (only the template holds, its slots renamed
    one-to-one: ``slots`` says how) or ``none``. A pair occurs once per different text of the document.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_text is not null").distinct()
    there = wanted.mapInPandas(_item_windows, "item_id long, windows array<long>, least long").select("item_id", "least", F.explode("windows").alias("h"))
    windows = docs.mapInPandas(_windows, "id long, h long")
    hits = windows.join(broadcast_if_small(there, 1_000_000), "h").groupBy("id", "item_id").agg(F.count("*").alias("hits"), F.min("least").alias("least"))
    # pairs of ids only; written once, as they are counted and then joined
    pairs = cut(hits.filter(F.col("hits") >= F.col("least")).select("id", "item_id"))
    candidates = docs.join(broadcast_if_small(pairs), "id").join(broadcast_if_small(wanted), "item_id")
    return candidates.mapInPandas(_verify, _PAIRS)


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of the documents that hold an item's text, or a run of 40 % of it, up to small changes."""
    return leaks(documents, items).filter("kind = 'copy'").select("doc_id", "item_id").distinct()


def renamed(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, template_share, slots)`` of the documents that hold an item with other numbers and names, renamed one-to-one
    throughout: a re-parameterised item."""
    found = leaks(documents, items).filter("kind = 'renamed'")
    return found.select("doc_id", "item_id", F.round("template_share", 4).alias("template_share"), F.array_join("slots", ", ").alias("slots")).distinct()
