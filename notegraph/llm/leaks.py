"""Evaluation texts in training text: pigeonhole pieces, then Myers' bit-parallel distance.

Texts are compared as words (maximal runs of letters or digits, lower-cased) after markup and invisible
characters are gone and Unicode is NFC. A passage is a window of ``min_words`` words of an
item. With an error budget of e word edits a passage is split into e + 1 pieces, of which at least one
stands unchanged in any text within the budget; texts are searched for all pieces at once, and
each hit's passage is verified by the bit-parallel edit distance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import strip

WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
LINK = re.compile(r"\[([^\[\]\n]*)\]\(<?[^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)")
ALIAS = re.compile(r"\[\[[^\[\]|\n]*\|([^\[\]\n]*)\]\]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words of a text without its markup and invisible characters."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    text = strip(text)
    if "](" in text:
        text = LINK.sub(r"\1 ", text)
    if "[[" in text:
        text = ALIAS.sub(r"\1", text)
    return WORD.findall(text.lower())


def _codes(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    value = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for j in range(size):
        value = value * _MIX + codes[j : len(codes) - size + 1 + j]
    return value


def myers(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each row the least edit distance of ``pattern[row]`` (up to 62 words) to any part of ``text[row]``."""
    rows, m = pattern.shape
    bits = np.int64(1) << np.arange(m, dtype=np.int64)
    full = np.int64((1 << m) - 1)
    pv, mv = np.full(rows, full), np.zeros(rows, np.int64)
    score = np.full(rows, m)
    best = score.copy()
    for j in range(text.shape[1]):
        eq = (pattern == text[:, j : j + 1]) @ bits
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        score = score + ((ph >> (m - 1)) & 1) - ((mh >> (m - 1)) & 1)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        best = np.minimum(best, score)
    return best


class PassageIndex:
    """The pieces of all passages of the items, as sorted hashes with the places they stand at."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = 13, max_edits: int = 1):
        self.min_words, self.max_edits = min_words, max_edits
        self.piece = min_words // (max_edits + 1)
        words = [(key, w) for key, text in items if len(w := words_of(text)) >= min_words]
        self.keys = np.array([key for key, _ in words], np.int64)
        self.vocabulary: dict[str, int] = {}
        ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for _, w in words for x in w]
        sizes = np.array([len(w) for _, w in words], np.int64)
        self.ids = np.array(ids, np.int64)
        self.item = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        self.begin, self.end = ends - sizes, ends
        hashes = _rolling(_codes(self.ids), self.piece) if len(self.ids) >= self.piece else np.zeros(0, np.uint64)
        inside = np.flatnonzero(self.item[: len(hashes)] == self.item[self.piece - 1 :][: len(hashes)])
        order = np.argsort(hashes[inside], kind="stable")
        self.hashes, self.places = hashes[inside][order], inside[order]

    def search(self, texts: list[str], part_hits: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text and item with a passage within the budget: text, item, the least distance, and
        the number of words of the item that unchanged passages cover."""
        get = self.vocabulary.get
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        # gaps longer than a passage keep windows within their text
        gap, ends = self.min_words + self.max_edits, np.cumsum(sizes)
        ids = np.zeros(int(sizes.sum()) + gap * (len(texts) + 1), np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(int(sizes.sum())) + gap * (doc + 1)
        ids[place] = np.fromiter(map(get, chain.from_iterable(words), repeat(0)), np.int64, len(place))
        owner = np.zeros(len(ids), np.int64)
        owner[place] = doc
        known = np.cumsum(np.r_[0, ids > 0])
        starts = np.flatnonzero(known[self.piece :] - known[: -self.piece] == self.piece)
        none = np.zeros(0, np.int64)
        if not len(starts) or not len(self.hashes):
            return none, none, none, none
        codes = _codes(ids)
        value = np.zeros(len(starts), np.uint64)
        for j in range(self.piece):
            value = value * _MIX + codes[starts + j]
        low, high = np.searchsorted(self.hashes, value, "left"), np.searchsorted(self.hashes, value, "right")
        times = high - low
        got = []
        # in parts, so that a common piece doesn't blow up memory
        cut = np.r_[0, np.flatnonzero(np.diff(np.cumsum(times) // part_hits)) + 1, len(starts)]
        for a, b in zip(cut[:-1], cut[1:]):
            n = times[a:b]
            if n.sum():
                at = np.repeat(starts[a:b], n)
                to = self.places[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                got += [self._verify(ids, at, to, k) for k in range(self.max_edits + 1)]
        if not got:
            return none, none, none, none
        at, item, distance, start = (np.concatenate(x) for x in zip(*got))
        return owner[at], item, distance, start

    def _verify(self, ids: np.ndarray, at: np.ndarray, to: np.ndarray, k: int):
        """Hits taken as the k-th piece of a passage: position, item, distance and begin of the passages within the budget."""
        m, e = self.min_words, self.max_edits
        # pieces lie at even steps, the last one at the passage's end
        offset = 0 if k == 0 else m - self.piece if k == e else k * self.piece
        start = to - offset
        item = self.item[to]
        ok = (start >= self.begin[item]) & (start + m <= self.end[item])
        at, start, item = at[ok], start[ok], item[ok]
        first = at - offset
        # beside the piece, of 2e + 1 words of the passage at most e are changed; the others stand on nearby diagonals
        beside = offset + self.piece if offset + self.piece < m else offset - min(2 * e + 1, offset)
        seen = np.zeros(len(at), np.int64)
        width = min(2 * e + 1, m - self.piece)
        for i in range(beside, min(beside + width, m)):
            word = self.ids[start + i]
            found = np.zeros(len(at), bool)
            for shift in range(-e, e + 1):
                found |= ids[np.clip(first + i + shift, 0, len(ids) - 1)] == word
            seen += found
        ok = seen >= min(beside + width, m) - beside - e
        at, start, item, first = at[ok], start[ok], item[ok], first[ok]
        # each edit changes at most one word of the passage; the others stand on nearby diagonals
        near = np.zeros((len(at), m), bool)
        span = np.arange(m)
        wanted = self.ids[start[:, None] + span] if len(at) else np.zeros((0, m), np.int64)
        for shift in range(-e, e + 1):
            near |= ids[np.clip(first[:, None] + span + shift, 0, len(ids) - 1)] == wanted
        ok = near.sum(1) >= m - e
        at, start, item, first, wanted = at[ok], start[ok], item[ok], first[ok], wanted[ok]
        text = ids[np.clip(first[:, None] + np.arange(-e, m + e), 0, len(ids) - 1)]
        distance = myers(wanted, np.where(text > 0, text, -1))
        ok = distance <= e
        return at[ok], item[ok], distance[ok], start[ok]


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 13, max_edits: int = 1, max_index_words: int = 1_000_000, part_chars: int = 500_000) -> DataFrame:
    """doc_id, item_id, distance (of the nearest passage), n_words (of the item, in unchanged passages) of each leak.

    Every document is searched whole against all items. The index is sent to the tasks in
    blocks of items of at most ``max_index_words`` words each (one item may be longer), one pass over the documents per block;
    the held-out items are read to the driver, as their number doesn't grow with the corpus. Items of
    fewer than ``min_words`` words hold no passage. Null texts hold nothing.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks: list[list[tuple[int, str]]] = [[]]
    words = 0
    for row in items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct().orderBy("item_id", "text").toLocalIterator():
        size = len(row.text) // 4
        if words and words + size > max_index_words:
            blocks.append([])
            words = 0
        blocks[-1].append((row.item_id, row.text))
        words += size
    schema = f"doc_id {kind}, item_id bigint, distance int, n_words int"

    def scan(index: PassageIndex):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                texts, keys = f["text"].tolist(), f["doc_id"].to_numpy()
                begin, chars = 0, 0
                for i, t in enumerate(texts):
                    chars += len(t)
                    if chars >= part_chars or i == len(texts) - 1:
                        yield found(index, texts[begin : i + 1], keys[begin : i + 1])
                        begin, chars = i + 1, 0

        return run

    def found(index: PassageIndex, texts: list[str], keys: np.ndarray) -> pd.DataFrame:
        doc, item, distance, start = index.search(texts)
        hits = pd.DataFrame({"doc": doc, "item": item, "distance": distance, "start": start})
        rows = []
        for (d, i), g in hits.groupby(["doc", "item"], sort=False):
            exact = np.unique(g.loc[g["distance"] == 0, "start"].to_numpy())
            covered = int(np.minimum(np.diff(np.r_[exact, exact[-1] + index.min_words]), index.min_words).sum()) if len(exact) else 0
            rows.append((keys[d], index.keys[i], int(g["distance"].min()), covered))
        out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "n_words"])
        return out.astype({"item_id": "int64", "distance": "int32", "n_words": "int32"}) if rows else out.astype({"doc_id": keys.dtype, "item_id": "int64", "distance": "int32", "n_words": "int32"})

    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    result = None
    for block in blocks:
        part = texts.mapInPandas(scan(PassageIndex(block, min_words, max_edits)), schema)
        result = part if result is None else result.unionByName(part)
    return result.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("n_words").alias("n_words"))


def leaked(documents: DataFrame, items: DataFrame, min_words: int = 13, **options) -> DataFrame:
    """doc_id, item_id where the document holds ``min_words`` consecutive words of the item unchanged."""
    return leaks(documents, items, min_words, **options).where("distance = 0").select("doc_id", "item_id")
