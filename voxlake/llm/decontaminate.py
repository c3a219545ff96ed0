"""Benchmark decontamination: edit distance embedded in Hamming distance by random walks, sampled, then verified exactly.

The random walk over a window of words reads the word it stands on at every step, and a random bit of that word's hash for the
step says whether it moves on. Walks over two windows at a small edit distance fall back into step after each edit, so
the words read agree at most steps; sampling a few steps gives keys that often collide. Items give a key for the window
at each of their words, documents for windows half a window apart, in as many repetitions as a target recall takes. Windows have about half
of an item's words, LONGEST at most: a longer walk falls out of step, while a longer item has more windows. A collision only proposes
a place: the edit distance of the whole item to the best run of words there decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import textops

#: Sampled steps of a walk, the largest share of an item's words that may be edited, and the most words of a window.
SAMPLED, EDITED, LONGEST = 4, 0.2, 16
#: The share of items edited as much as they may be that has to be found. For each window size it is measured on edited copies of PLANTED items at most, and
#: repetitions are added until it is reached.
RECALL, PLANTED, MOST_REPETITIONS = 0.99, 100, 64
#: Words of benchmark items that are sent to the tasks at once; a larger benchmark is matched in blocks of so many.
BLOCK_WORDS = 400_000


def symbols(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of ASCII letters and digits and of non-ASCII characters), and where each text's begin."""
    w = textops.words(raw, textops.NOT_ALNUM)
    return w.hashes(), w.offset


def window_of(n_words: int) -> int:
    """Words of an item's windows: the largest power of two within half of the item and LONGEST."""
    return min(LONGEST, 1 << max(0, int(math.log2(max(n_words / 2, 1)))))


def step_of(window: int) -> int:
    return max(1, window // 2)


def keys(x: np.ndarray, start: np.ndarray, window: int, repetition: int, seed: int = 3) -> np.ndarray:
    """Keys of the walks that begin at ``start``; ``x`` ends with as many zeros as a walk has steps."""
    steps = 2 * window
    rng = np.random.default_rng([seed, window, repetition])
    salt = np.uint64(rng.integers(1, 1 << 63))
    sampled = set(rng.choice(max(1, steps - 2), min(SAMPLED, max(1, steps - 2)), replace=False).tolist())
    at, key, bits = start.copy(), np.full(len(start), salt, np.uint64), None
    for j in range(max(sampled) + 1):
        if j % 64 == 0:
            bits = textops.mix(x ^ (salt + np.uint64(j)))
        if j in sampled:
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[at]
        at += (bits[at] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
    return textops.mix(key)


def nearest(item: dict[int, int], n: int, words: list[int]) -> tuple[int, int]:
    """Least edit distance of an item (its words' places as bit masks) to a run of ``words``, and the end of the first such run."""
    every, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = every, 0, n, (n, 0)
    for j, w in enumerate(words):
        eq = item.get(w, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        up, down = minus | ~(xh | plus) & every, plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & every, down << 1 & every
        plus, minus = down | ~(xv | up) & every, up & xv
        if score < best[0]:
            best = score, j + 1
    return best


def edited(words: np.ndarray, rng: np.random.Generator, kind: int) -> np.ndarray:
    """A copy with a share EDITED of its words replaced (kind 0), more put in (1), left out (2), or all three mixed (3)."""
    x = words.tolist()
    for _ in range(int(EDITED * len(words))):
        at, what = int(rng.integers(len(x))), int(rng.integers(3)) if kind == 3 else kind
        x[at : at + (what != 1)] = [int(rng.integers(1 << 62))] if what != 2 else []
    return np.array(x, np.uint64)


def regions(places: np.ndarray, n: int, most: int, length: int) -> list[tuple[int, int]]:
    """Ranges of a text of ``length`` words that hold every run of words within ``most`` edits of an item of ``n``; ``places``: where the text has any of the item's words, in order.

    Such a run has n - most words of the item at least, in the item's order, and no more than n + most words.
    """
    need = max(1, n - most)
    first = places[: len(places) - need + 1]
    first = first[places[need - 1 :] - first < n + most]
    if not len(first):
        return []
    low, high = np.maximum(first - n - most, 0), np.minimum(first + 2 * (n + most), length)
    new = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return [*zip(low[new].tolist(), high[np.append(new[1:], len(high)) - 1].tolist(), strict=True)]


class Items:
    """A block of items as the tasks need it: words, and for each window size and repetition the sorted keys with item and offset."""

    def __init__(self, ids: list, texts: list[str]):
        x, offset = symbols([t.lower().encode() for t in texts])
        size = np.diff(offset)
        self.ids = ids
        self.words = [x[a:b].tolist() for a, b in zip(offset[:-1], offset[1:], strict=True)]
        self.distinct = [frozenset(w) for w in self.words]
        self.unique = [np.unique(x[a:b]) for a, b in zip(offset[:-1], offset[1:], strict=True)]
        self.places: list[dict[int, int]] = []
        for w in self.words:
            p: dict[int, int] = {}
            for i, s in enumerate(w):
                p[s] = p.get(s, 0) | 1 << i
            self.places.append(p)
        self.tables: list[tuple] = []
        self.recall: dict[int, float] = {}
        windows = np.array([window_of(n) for n in size])
        for window in sorted({*windows[size > 0].tolist()}):
            self._index(window, np.flatnonzero((windows == window) & (size > 0)), x, offset)

    def _index(self, window: int, mine: np.ndarray, x: np.ndarray, offset: np.ndarray) -> None:
        """Tables of one window size, one repetition after the other, until enough of the planted copies are proposed."""
        size = np.diff(offset)
        item = np.concatenate([np.full(size[i] - window + 1, i) for i in mine])
        first = np.concatenate([np.arange(size[i] - window + 1) for i in mine])
        padded, base, at = [], {}, 0
        for i in mine:  # each item ends in zeros of its own, so no walk runs into the next
            base[i] = at
            padded += [x[offset[i] : offset[i + 1]], np.zeros(2 * window, np.uint64)]
            at += int(size[i]) + 2 * window
        laid, start = np.concatenate(padded), np.array([base[i] for i in item]) + first
        rng = np.random.default_rng([7, window])
        planted = [(int(i), kind) for i in (mine if len(mine) <= PLANTED else np.sort(rng.choice(mine, PLANTED, replace=False))) for kind in range(4)]
        copies = [np.concatenate([rng.integers(0, 1 << 62, int(rng.integers(window)), np.uint64), edited(x[offset[i] : offset[i + 1]], rng, kind)]) for i, kind in planted]
        text, edge = np.concatenate(copies), np.append(0, np.cumsum([len(c) for c in copies]))
        found: set[int] = set()
        for r in range(MOST_REPETITIONS):
            k = keys(laid, start, window, r)
            order = np.argsort(k, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(k & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((window, r, k[order], item[order], first[order], seen))
            found |= {d for d, i, _ in self.propose(text, edge, self.tables[-1:]) if d >= 0 and i == planted[d][0]}
            self.recall[window] = len(found) / len(planted)
            if self.recall[window] >= RECALL:
                break

    def propose(self, x: np.ndarray, offset: np.ndarray, tables: list[tuple]) -> set[tuple[int, int, int]]:
        """(text, item, place): where an item may begin, in steps of a quarter of it, among texts' words."""
        out: set[tuple[int, int, int]] = set()
        doc_of = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
        n = len(x)
        last = None
        for window, r, key, item, first, seen in tables:
            if window != last:
                padded = np.concatenate([x, np.zeros(2 * window + 1, np.uint64)])
                step = step_of(window)
                counts = -(-np.diff(offset) // step)
                owner = np.repeat(np.arange(len(counts)), counts)
                start = offset[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
                last = window
            k = keys(padded, start, window, r)
            some = np.flatnonzero(seen[(k & np.uint64((1 << 20) - 1)).astype(np.int64)])
            a, b = np.searchsorted(key, k[some]), np.searchsorted(key, k[some], side="right")
            some, a, b = some[b > a], a[b > a], b[b > a]
            for s, lo, hi in zip(start[some].tolist(), a.tolist(), b.tolist(), strict=True):
                d = int(doc_of[s]) if s < n else -1
                for t in range(lo, hi):
                    i = int(item[t])
                    quarter = max(1, len(self.words[i]) // 4)
                    out.add((d, i, (s - int(offset[d]) - int(first[t])) // quarter))
        return out

    def matches(self, raw: list[bytes]) -> list[list[tuple]]:
        """For each text: (item, distance, item words, end) of each item that it holds, from the whole text."""
        x, offset = symbols(raw)
        out: list[list[tuple]] = [[] for _ in raw]
        found, of, words = set(), None, []
        for d, i, q in sorted(self.propose(x, offset, self.tables)):
            if (d, i) in found:
                continue
            if d != of:
                of, own = d, x[offset[d] : offset[d + 1]]
                words, by_word = own.tolist(), np.argsort(own, kind="stable")
                in_order = own[by_word]
            n = len(self.words[i])
            most, quarter = int(EDITED * n), max(1, n // 4)
            a, b = max(0, q * quarter - most), (q + 1) * quarter + n + most
            # every edit takes away one of the item's words at most
            if len(self.distinct[i].intersection(words[a:b])) >= len(self.distinct[i]) - most and nearest(self.places[i], n, words[a:b])[0] <= most:
                found.add((d, i))
                # the least distance over the whole text, from where enough of the item's words stand close together
                low, high = np.searchsorted(in_order, self.unique[i]), np.searchsorted(in_order, self.unique[i], side="right")
                places = np.sort(by_word[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])])
                best = (n, 0)
                for a, b in regions(places, n, most, len(words)):
                    distance, end = nearest(self.places[i], n, words[a:b])
                    if distance < best[0]:
                        best = distance, a + end
                out[d].append((self.ids[i], best[0], n, best[1]))
        return out


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of a bounded number of words, by ascending id; only one block is on the driver at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(symbols([row[1].encode()])[0])
        if size >= BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def _matcher(sent: Broadcast, schema: str):
    @F.pandas_udf(schema)
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for _, raw in textops.chunks([t.lower() if isinstance(t, str) else None for t in texts]):
                rows += [[dict(zip(("item", "distance", "item_words", "end"), m, strict=True)) for m in ms] for ms in sent.value.matches(raw)]
            yield pd.Series(rows, dtype=object)

    # so that a filter on the result does not run it a second time
    return matched.asNondeterministic()


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``leaks``: array of (item, distance, item_words, end) for the items that its text holds.

    Words are compared in lower case. A text holds an item if some run of its words is within a fifth of the item's words in edit distance (words inserted, deleted,
    replaced). ``distance`` is the least over the whole text, ``end`` the word after the first such run. What is reported is
    exact; an item at the full distance is found with a probability of about RECALL, of any kind of edits and at any length, and nearly always at half of it.

    Items are sent to the tasks in blocks of BLOCK_WORDS words, built one after the other on the driver, and every block is one more pass
    over a text's words: meant for benchmarks of up to some millions of words.

    Null and empty texts hold nothing; items that are null or have no words are in none. Repeated items are reported each.
    Repeated rows get equal results each; empty tables give empty lists or no rows. A column ``leaks`` that was there is replaced.
    """
    spark, kind = docs.sparkSession, items.schema[item_id_col].dataType.simpleString()
    schema = f"array<struct<item: {kind}, distance: int, item_words: int, end: int>>"
    out = docs.withColumn("leaks", F.expr(f"cast(array() as {schema})"))
    for block in blocks_of(items, item_id_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)  # bounded by BLOCK_WORDS

        out = out.withColumn("leaks", F.concat("leaks", _matcher(sent, schema)(F.col(text_col))))
    return out


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs.select("doc_id", "text"), items).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item").alias("item_id"), F.col("leak.distance").cast("long").alias("distance"), F.col("leak.item_words").cast("long").alias("item_words"), F.col("leak.end").cast("long").alias("end_word"))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with their own columns.

    Null and empty texts hold none and stay; repeated rows stay or go together; null and empty items are in no text. An empty table gives none, an
    empty benchmark all documents. Other columns do not matter.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("own_text"))
    return contamination(held, items, "own_text").where(F.size("leaks") == 0).select("row.*")
