"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The words of every benchmark item give its seeds: n-grams, keyed by hash; an item of fewer than n words has one, itself,
and texts are searched for grams of its length as well. A text that holds a seed of an item is a candidate for it, however
common the seed is.

Candidates are aligned with the item, word by word (match 2, mismatch -1, gap -1), around the seeds. A pair is reported
when the local alignment scores at least `least` of the score of a full match. Places that hold too few of the item's
words to reach that score, as around a common phrase, are not aligned: the bound is exact, so nothing is lost.

The benchmark is the query set: it is dealt into blocks of about MOST_WORDS words, each block is broadcast in turn, and all
texts are searched for it where they lie. So nothing of the texts is shuffled or gathered, no seed is a key that could be
hot, and a benchmark of any size has the same plan, with a scan for each block.

Null, empty and wordless texts hold nothing. Every row is judged by itself: rows that repeat a doc_id, or have none, each
give rows of their own, and only rows that hold an item leave clean output. Items that share an item_id are aligned one by
one and reported once, with the best; those without an id are reported with a null one. Null and wordless items, an empty
benchmark and an empty table give no pairs. An item of one word is found wherever the word is. Other columns don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_WORDS, LEAST = 4, 0.5
#: Words of a block of the benchmark, on average: some 10 MB in a task.
MOST_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
_words = re.compile(r"\w+").findall
_FOUND = "array<struct<item_id long, score long, share double, first_word long, last_word long>>"


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_word_hash = _WordHash()
_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_word_hash.__getitem__, found), np.uint64, len(found))


def seeds(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram at every position."""
    many = len(word_hashes) - n + 1
    if many <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros(many, np.uint64)
    for k in range(n):
        total = (total ^ (total >> np.uint64(29))) * _TURN[k % 5] + word_hashes[k : many + k]
    return total.view(np.int64)


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (score, start, end) of the best local alignment, as positions in text.

    Row by row over the text; gaps along the item are taken in one pass, since a running maximum of score plus distance
    gives the best place to open one.
    """
    m = len(item)
    far = np.arange(1, m + 1) * -GAP
    before, start_before = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(text.tolist()):
        score, start = np.zeros(m + 1, np.int64), np.full(m + 1, i + 1)
        diagonal = before[:-1] + np.where(item == word, MATCH, MISMATCH)
        up = before[1:] + GAP
        here = np.maximum(diagonal, up)
        came = np.where(diagonal >= up, np.where(before[:-1] > 0, start_before[:-1], i), start_before[1:])
        level = here + far
        top = np.maximum.accumulate(level)
        left = top - far
        at = np.maximum.accumulate(np.where(level == top, np.arange(m), 0))
        came = came[at]
        alive = left > 0
        score[1:] = np.where(alive, left, 0)
        start[1:] = np.where(alive, came, i + 1)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), i + 1)
        before, start_before = score, start
    return best


@dataclass
class Items:
    """A block of the benchmark; for each length of seeds, their sorted hashes and the items of each."""

    ids: list[int | None]
    texts: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    least: float

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], n: int, least: float) -> Items:
        kept = [(i, h) for i, h in ((i, hashes(t)) for i, t in rows) if len(h)]
        by_length: dict[int, list[int]] = {}
        for k, (_, h) in enumerate(kept):
            by_length.setdefault(min(n, len(h)), []).append(k)
        grams = {}
        for size, items in by_length.items():
            own = [np.unique(seeds(kept[k][1], size)) for k in items]
            every, of = np.concatenate(own), np.repeat(np.array(items), [len(x) for x in own])
            order = np.argsort(every, kind="stable")
            distinct, first = np.unique(every[order], return_index=True)
            grams[size] = distinct, np.append(first, len(every)), of[order]
        return cls([i for i, _ in kept], [h for _, h in kept], grams, least)

    def hits(self, own: np.ndarray) -> dict[int, np.ndarray]:
        """Positions in a text at which seeds of each item stand."""
        out: dict[int, np.ndarray] = {}
        for size, (known, first, of) in self.grams.items():
            at = seeds(own, size)
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(known, at), len(known) - 1)
            where = np.flatnonzero(known[place] == at)
            if not len(where):
                continue
            low, many = first[place[where]], first[place[where] + 1] - first[place[where]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            item, position = of[np.repeat(low, many) + step], np.repeat(where, many)
            order = np.argsort(item, kind="stable")
            item, position = item[order], position[order]
            edges = np.flatnonzero(np.diff(item)) + 1
            for part, k in zip(np.split(position, edges), item[np.concatenate(([0], edges))].tolist()):
                out[k] = part
        return out

    def copies(self, own: np.ndarray, any_one: bool = False) -> list[tuple]:
        """(item_id, score, share, first word, end word) of the items that a text holds; with any_one, of one of them."""
        best: dict = {}
        for k, hit in self.hits(own).items():
            item = self.texts[k]
            reach, least, found = 2 * len(item), self.least * MATCH * len(item), (0, 0, 0)
            edges = np.flatnonzero(np.diff(hit) > reach)
            for low, high in zip(hit[np.concatenate(([0], edges + 1))], hit[np.concatenate((edges, [len(hit) - 1]))]):
                low = max(0, int(low) - reach)
                part = own[low : int(high) + reach + SEED_WORDS]
                # each match takes a word of the item of its own
                if MATCH * np.isin(item, part).sum() < least:
                    continue
                score, start, end = align(part, item)
                if score > found[0]:
                    found = (score, low + start, low + end)
            if found[0] >= least:
                row = (self.ids[k], found[0], found[0] / (MATCH * len(item)), found[1], found[2])
                key = ("no id", k) if row[0] is None else row[0]
                if key not in best or (row[2], row[1]) > (best[key][2], best[key][1]):
                    best[key] = row
                if any_one:
                    break
        return list(best.values())


def blocks(benchmark: DataFrame, n: int, least: float, most_words: int):
    """The benchmark's items in blocks, broadcast one by one; texts of one item_id are in one block."""
    spark = benchmark.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    many = max(1, -(-total // most_words))
    block = F.pmod(F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id")), F.lit(many))
    for b in range(many if total else 0):
        rows = items.where(block == b).distinct().collect()  # a block of about most_words words
        made = Items.of([(r["item_id"], r["text"]) for r in rows], n, least)
        if made.ids:
            yield spark.sparkContext.broadcast(made)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, least: float = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, item_id, score, share, first_word, last_word: documents that hold a copy, exact or edited, of an item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(known):
        def copies(text: pd.Series) -> pd.Series:
            return pd.Series([known.value.copies(hashes(t)) for t in text], dtype=object)

        return rows.select("doc_id", F.explode(F.pandas_udf(copies, _FOUND)("text")).alias("found")).select("doc_id", "found.*")

    out = rows.where("false").select("doc_id", F.inline(F.lit(None).cast(_FOUND)))
    for known in blocks(benchmark, n, least, most_words):
        out = out.unionByName(search(known))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, least: float = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """docs without the rows that hold an item."""

    def clean(known):
        def run(text: pd.Series) -> pd.Series:
            return pd.Series([not known.value.copies(hashes(t), any_one=True) for t in text], dtype=bool)

        return F.pandas_udf(run, "boolean")

    for known in blocks(benchmark, n, least, most_words):
        docs = docs.where(clean(known)(F.col("text").cast("string")))
    return docs
