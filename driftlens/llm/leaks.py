"""Problem 6: passages of held-out evaluation items inside documents.

SimHash over item-sized windows: every window of ``WINDOW`` words of a document and of an item's own text has a
64-bit fingerprint of its weighted words. Fingerprints are looked up by blocks: with four blocks of 16 bits, two
fingerprints within ``RADIUS`` bits agree in some block up to a quarter of it. A block's table has a fingerprint under the values within
some bits of its own, and a window looks up the values within the bits that are left of the three: what is within three bits meets, so no
pair within the radius is missed. Few fingerprints are stored under all 697 values, which is quickest; more of them under the 17
within one bit, which takes some 300 bytes a fingerprint. Candidates are then verified by the exact similarity of their weighted shingles, and by aligning the
item's words with the document's.

The items are the stated query set: they are collected, what is each item's own and the weights of words are worked out
over all of them, and the own runs are broadcast in blocks of at most ``BLOCK_PRINTS`` fingerprints, which bounds a block whatever the
length of its items. Documents are the large side; they are read once, whole, for all blocks, and never shuffled. A document's
work depends on its own words alone, so no source or copy can become a hot key.

A window is looked up if at least ``GRAMS`` of its runs of ``GRAM`` words are some item's. An edit touches four runs at most, so of the 27
runs of 30 words seven are left after five edits, and of the 23 of 26 words as many after the four that verification allows: nothing it
would accept is lost, and most windows of other texts are never looked up.

Text that several items share (runs of ``SHARED_RUN`` words or more that another item has too) isn't an item's own.

Defined results: null and empty texts contain nothing; an item with fewer own words than ``LEAST`` in a row can't
be found. Case, accents, punctuation, mark-up, line breaks, quote marks, soft hyphens and compatibility forms
don't count. Repeated documents are listed each. Rows with a null id are left out; duplicate (document,
item) pairs come once.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.sources.tables import spread

WINDOW = 30
#: Every third window of an item has a fingerprint; a document has one at each word, so all offsets are met.
STRIDE = 3
RADIUS = 12
BLOCKS = 4
#: Words of an item's own text, in a row, that make a case; edits at the ends of a passage may hide a few of 30.
LEAST = 26
#: Edits per word within a passage: about one in nine, and room for their uneven spread.
EDITS = 0.17
#: Weighted-shingle similarity that a window pair must have.
SIMILARITY = 0.68
SHARED_RUN = 14
#: Fingerprints of a block of items at most: some 150 MB of tables.
BLOCK_PRINTS = 500_000
#: Bytes of tables up to which all of a block's distance is stored; beyond, one bit of it is, and the lookup covers the rest.
TABLE_BYTES = 150_000_000
GRAM, GRAMS = 4, 5
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|<!--.*?-->", re.S)
_BREAK = re.compile(r"(?<=[^\W\d_])-\n[>*\s]*(?=[a-zà-ÿ])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text in one spelling."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text:
        text = _BREAK.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = re.sub("[­​-‍⁠﻿]", "", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("ß", "ss")
    return _WORD.findall(text.lower())


def own_segments(items: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """(item, words): the runs of each item's words that no other item has."""
    split = [(i, words_of(t or "")) for i, t in items]
    owners: dict[tuple[str, ...], set[int]] = {}
    for k, (_, w) in enumerate(split):
        for a in range(len(w) - SHARED_RUN + 1):
            owners.setdefault(tuple(w[a : a + SHARED_RUN]), set()).add(k)
    out = []
    for i, w in split:
        shared = np.zeros(len(w), dtype=bool)
        for a in range(len(w) - SHARED_RUN + 1):
            if len(owners[tuple(w[a : a + SHARED_RUN])]) > 1:
                shared[a : a + SHARED_RUN] = True
        start = None
        for a in range(len(w) + 1):
            if a < len(w) and not shared[a]:
                start = a if start is None else start
            elif start is not None:
                if a - start >= LEAST:
                    out.append((i, w[start:a]))
                start = None
    return out


#: Own runs of a block's items, the number of runs of all items, and in how many of these each of the block's words is.
Block = tuple[list[tuple[int, list[str]]], int, dict[str, int]]


def blocks_of(segments: list[tuple[int, list[str]]], size: int | None = None) -> list[Block]:
    """The runs by blocks of about ``size`` fingerprints, an item's runs together, with weights' counts over all of them; one block without a size."""
    counts = Counter(w for _, ws in segments for w in set(ws))
    parts: list[list[tuple[int, list[str]]]] = [[]]
    held, last = 0, None
    for i, ws in sorted(segments, key=lambda s: s[0]):
        n = len(ws) // STRIDE + 2
        if size and held and held + n > size and i != last:
            parts.append([])
            held = 0
        parts[-1].append((i, ws))
        held, last = held + n, i
    return [(part, max(1, len(segments)), {w: counts[w] for _, ws in part for w in ws}) for part in parts]


class Index:
    """Fingerprints of the items' windows, their block tables, and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], own: Block | None = None) -> None:
        self.segments, n, used = own or blocks_of(own_segments(items))[0]
        seen = {w: used[w] for _, ws in self.segments for w in ws}
        self.vocabulary = {w: k for k, w in enumerate(sorted(seen))}
        self.weight = np.array([1 + math.log(n / seen[w]) for w in sorted(seen)] + [0.0], dtype=np.float32)
        digests = [np.frombuffer(hashlib.blake2b(w.encode(), digest_size=8).digest(), dtype=np.uint8) for w in sorted(seen)]
        signs = np.array([np.unpackbits(d) for d in digests], dtype=np.float32).reshape(-1, 64) * 2 - 1
        self.vectors = np.vstack([signs * self.weight[:-1, None], np.zeros((1, 64), dtype=np.float32)])
        self.ids = [np.array([self.vocabulary[w] for w in ws]) for _, ws in self.segments]
        grams = [self.grams(ids) for ids in self.ids if len(ids) >= GRAM]
        self.own_grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, dtype=np.uint64)
        prints, owner = [], []
        for k, ids in enumerate(self.ids):
            f = self.prints(ids)
            at = sorted({*range(0, len(f), STRIDE), len(f) - 1})
            prints.append(f[at])
            owner.append(np.full(len(at), k))
        self.fingerprints = np.concatenate(prints) if prints else np.empty(0, dtype=np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, dtype=np.int64)
        self._build()

    def _build(self) -> None:
        """Per block, for each 16-bit value, the fingerprints whose block is within the stored bits of it."""
        bits = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
        reach = RADIUS // BLOCKS
        stored = reach if len(self.fingerprints) * int((bits <= reach).sum()) * 4 * BLOCKS <= TABLE_BYTES else 1
        kept = np.flatnonzero(bits <= stored).astype(np.uint16)
        self.masks = np.flatnonzero(bits <= reach - stored).astype(np.uint16)
        self.tables = []
        for b in range(BLOCKS):
            part = ((self.fingerprints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            values = (part[:, None] ^ kept[None, :]).ravel()
            which = np.repeat(np.arange(len(part), dtype=np.int32), len(kept))
            starts = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << 16))])
            self.tables.append((starts, which[np.argsort(values, kind="stable")]))

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """A number for each run of GRAM words; other runs may have the same one, which costs a lookup."""
        code = np.zeros(len(ids) - GRAM + 1, dtype=np.uint64)
        for k in range(GRAM):
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - GRAM + 1 + k].astype(np.uint64) + np.uint64(1)
        return code

    def prints(self, ids: np.ndarray) -> np.ndarray:
        """Fingerprints of all windows of a text's word numbers; of the whole text if it is shorter."""
        sums = np.cumsum(self.vectors[ids], axis=0)
        if len(ids) > WINDOW:
            sums = np.vstack([sums[WINDOW - 1 : WINDOW], sums[WINDOW:] - sums[:-WINDOW]])
        else:
            sums = sums[-1:]
        return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) pairs within RADIUS bits: all of them, some more than once."""
        rows, cols = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)]
        for b, (starts, which) in enumerate(self.tables):
            part = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            for lo in range(0, len(part), 1024):  # bounds what is held at once
                v = (part[lo : lo + 1024, None] ^ self.masks[None, :]).ravel().astype(np.int32)
                begin, n = starts[v], starts[v + 1] - starts[v]
                some = np.flatnonzero(n)
                count = n[some]
                row = np.repeat(lo + some // len(self.masks), count)
                col = which[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[some], count)]
                ok = np.bitwise_count(prints[row] ^ self.fingerprints[col]) <= RADIUS
                rows.append(row[ok])
                cols.append(col[ok])
        return np.concatenate(rows), np.concatenate(cols)

    def similar(self, doc: np.ndarray, item: np.ndarray) -> float:
        """Share by weight of the shingles (words and pairs) of the item's best stretch that the document's part has."""
        w, k = self.weight, min(LEAST, len(item))
        have = np.zeros(len(w), dtype=bool)
        have[doc] = True
        own = w[item]
        one = own * have[item]
        sums = np.cumsum(np.concatenate([[0.0], one])), np.cumsum(np.concatenate([[0.0], own]))
        words = float(((sums[0][k:] - sums[0][:-k]) / np.maximum(sums[1][k:] - sums[1][:-k], 1e-9)).max())
        if words < SIMILARITY:  # pairs can only lower it
            return words
        pairs = np.isin(item[:-1].astype(np.int64) * len(w) + item[1:], doc[:-1].astype(np.int64) * len(w) + doc[1:])
        both = np.append((own[:-1] + own[1:]) / 2, 0.0)
        got = np.cumsum(np.concatenate([[0.0], one + both * np.append(pairs, False)]))
        all_ = np.cumsum(np.concatenate([[0.0], own + both]))
        return float(((got[k:] - got[:-k]) / np.maximum(all_[k:] - all_[:-k], 1e-9)).max())

    def contained(self, doc: list, item: list) -> int:
        """Item words in the longest stretch that the document follows with at most EDITS edits a word."""
        blocks = [(a, b, n) for a, b, n in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if n]
        # positions in matched words, and edits between neighbouring blocks
        best = 0
        for i, (a0, _, _) in enumerate(blocks):
            edits = 0
            for j in range(i, len(blocks)):
                a, b, n = blocks[j]
                if j > i:
                    pa, pb, pn = blocks[j - 1]
                    edits += max(a - pa - pn, b - pb - pn)
                length = a + n - a0
                if edits <= EDITS * length:
                    best = max(best, length)
                elif edits > EDITS * len(item) + 1:
                    break
        return best

    def leaks(self, words: list[str]) -> list[int]:
        """The items that a text's words contain."""
        if len(words) < LEAST * (1 - EDITS) or not self.segments:
            return []
        get, none = self.vocabulary.get, len(self.vocabulary)
        ids = np.array([get(w, none) for w in words])
        at = np.searchsorted(self.own_grams, codes := self.grams(ids))
        shared = np.cumsum(np.concatenate([[0], self.own_grams[np.minimum(at, len(self.own_grams) - 1)] == codes]))
        span = min(WINDOW, len(ids))
        enough = shared[span - GRAM + 1 :] >= shared[: len(ids) - span + 1] + GRAMS
        if not enough.any():
            return []
        at = np.flatnonzero(enough)
        rows, cols = self.near(self.prints(ids)[at])
        if not len(rows):
            return []
        codes = np.unique(self.owner[cols] * (len(ids) + 1) + at[rows])
        owners, spots = codes // (len(ids) + 1), codes % (len(ids) + 1)
        found = set()
        for k, rs in zip(owners[np.flatnonzero(np.diff(owners, prepend=-1))].tolist(), np.split(spots, np.flatnonzero(np.diff(owners)) + 1), strict=True):
            item_id = self.segments[k][0]
            if item_id in found:
                continue
            breaks = np.flatnonzero(np.diff(rs) > 2 * WINDOW)
            clusters = list(zip(rs[np.concatenate([[0], breaks + 1])].tolist(), rs[np.concatenate([breaks, [len(rs) - 1]])].tolist(), strict=True))
            item = self.ids[k]
            for lo, hi in clusters:
                lo, hi = max(0, lo - len(item)), min(len(ids), hi + WINDOW + len(item))
                if self.similar(ids[lo:hi], item) < SIMILARITY:
                    continue
                # words outside the vocabulary differ from all others
                doc = [x if x != none else -1 - p for p, x in enumerate(ids[lo:hi].tolist())]
                if self.contained(doc, item.tolist()) >= LEAST:
                    found.add(item_id)
                    break
        return sorted(found)


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id)``: the documents that contain a passage of an item's own text."""
    spark = documents.sparkSession
    rows = sorted((r[0], r[1]) for r in items.select(F.col(item_id), F.col(text)).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct().toLocalIterator())
    docs = spread(documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")))
    found = _finder([spark.sparkContext.broadcast(block) for block in blocks_of(own_segments(rows), BLOCK_PRINTS)])
    return docs.select("doc_id", F.explode(found(F.col("_t"))).alias("item_id")).distinct()


_BUILT: dict[int, Index] = {}
#: Indexes that a worker keeps built; with more blocks than that they are built again for each batch of documents.
KEPT = 4


def _index(block: Broadcast) -> Index:
    """The index of a block, built once in each Python worker."""
    segments, n, _ = block.value
    key = hash((n, tuple((i, tuple(ws)) for i, ws in segments)))
    if key not in _BUILT:
        if len(_BUILT) >= KEPT:
            _BUILT.clear()
        _BUILT[key] = Index([], block.value)
    return _BUILT[key]


def _finder(blocks: list[Broadcast]) -> Callable[[Column], Column]:
    """A function of a text column: the items of all blocks that it contains. A batch's words are split once, and asked block by block."""

    @F.pandas_udf("array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            words = [words_of(t) if t else [] for t in texts.tolist()]
            out: list[list[int]] = [[] for _ in words]
            for block in blocks:
                index = _index(block)
                for k, w in enumerate(words):
                    out[k] += index.leaks(w)
            yield pd.Series(out)

    return found


def p6_found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaked(documents, eval_items)
