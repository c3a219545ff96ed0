"""Hard negatives: rows of another label whose score with an anchor lies just below a positive's.

Rows are laid out in Parquet blocks of one label each, along a Hilbert curve, with the least and greatest value of every dimension (a zone map). From an anchor and a zone map interval
arithmetic bounds every score in the block; an anchor reads only the blocks that may hold one of its positives, then those that may hold a score in one of its windows.
Anchors come in rounds of a bounded number, which every task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.storage import cut, stored

#: Rows of a block, bits of a dimension on the curve, anchors of a round (32 MB at 64 dimensions), and anchors compared with a block at once.
BLOCK, CURVE_BITS, MOST_ANCHORS, SLICE = 512, 2, 1 << 16, 1024
#: Stands for a null id: it is the smallest, so that it comes first among equal scores.
NO_ID = -(1 << 63)
NEVER = -(1 << 62)


def curve_key(cells: np.ndarray, bits: int) -> list[bytes]:
    """Where cells (rows of ``bits``-bit coordinates) stand along the Hilbert curve, as bytes in order of the curve."""
    x = cells.T.astype(np.uint32).copy()
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(len(x)):
            flip = (x[d] & bit) != 0  # reflect the first axis, or exchange it with this one
            swap = np.where(flip, np.uint32(0), (x[0] ^ x[d]) & below)
            x[0] ^= np.where(flip, below, swap)
            x[d] ^= swap
    for d in range(1, len(x)):  # Gray code
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    return [r.tobytes() for r in np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)]


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Rows of integers; a shorter vector ends in zeros."""
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _rows(blob: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, dims)


def laid_out(vectors: DataFrame, dims: int, low: int, high: int) -> DataFrame:
    """The table of blocks (block, label, n, ids, marks, vectors, low, high) of rows (id, label, v, anchor), by label and along the curve."""
    n_cells = 1 << CURVE_BITS

    @F.pandas_udf("binary")
    def key(v: pd.Series) -> pd.Series:
        cells = ((_matrix(v, dims) - low).astype(float) * (n_cells / (high - low + 1))).astype(np.int64).clip(0, n_cells - 1)
        return pd.Series(curve_key(cells, CURVE_BITS), dtype=object)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, None

        def done(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            m = _matrix(part["v"], dims)
            number += 1
            row = (number, part["label"].iloc[0], len(part), part["id"].to_numpy(np.int64).tobytes(), part["anchor"].to_numpy(bool).tobytes(), m.tobytes(), m.min(0).tobytes(), m.max(0).tobytes())
            return pd.DataFrame([row], columns=["block", "label", "n", "ids", "marks", "vectors", "low", "high"])

        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held):
                same = int(np.argmax(np.append(held["label"].to_numpy() != held["label"].iloc[0], True)))
                if same == len(held) and same < BLOCK:
                    break
                yield done(held.iloc[: min(same, BLOCK)])
                held = held.iloc[min(same, BLOCK) :].reset_index(drop=True)
        if held is not None and len(held):
            yield done(held)

    ordered = vectors.withColumn("key", key("v"))
    ordered = ordered.repartitionByRange("label", "key", "id").sortWithinPartitions("label", "key", "id")
    label = vectors.schema["label"].dataType.simpleString()
    table = ordered.select("id", "label", "v", "anchor").mapInPandas(blocks, f"block long, label {label}, n int, ids binary, marks binary, vectors binary, low binary, high binary")
    return stored(table, "negatives-blocks")


class Anchors:
    """Anchors of a round as columns, in the order of their numbers; ``lower`` and ``upper``: their parts below and above zero, for bounds."""

    def __init__(self, rows: pd.DataFrame, dims: int, kind: type):
        self.block, self.place, self.label, self.id = (rows[c].to_numpy() for c in ("block", "place", "label", "id"))
        self.at_least = rows["at_least"].to_numpy(np.int64)
        self.v = np.concatenate([_rows(b, dims) for b in rows["vector"]]).astype(kind) if len(rows) else np.zeros((0, dims), kind)
        self.lower, self.upper = np.minimum(self.v, 0), np.maximum(self.v, 0)

    def bounds(self, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that anchors ``of`` can have within zone maps: a row for each anchor, a column for each zone map."""
        return self.upper[of] @ low.T + self.lower[of] @ high.T, self.upper[of] @ high.T + self.lower[of] @ low.T


def anchors_of(blocks: DataFrame, dims: int, kind: type, n_positives: int) -> DataFrame:
    """(block, place, label, id, vector, at_least) of the rows marked as anchors; ``at_least``: what the last of its positives scores at least, by those in its own block."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, label, ids, marks, vectors in zip(pdf["block"], pdf["label"], pdf["ids"], pdf["marks"], pdf["vectors"], strict=True):
                at = np.flatnonzero(np.frombuffer(marks, bool))
                if not len(at):
                    continue
                v = _rows(vectors, dims)
                least = np.full(len(at), NEVER)
                if len(v) > n_positives:
                    for s in range(0, len(at), SLICE):
                        scores = v[at[s : s + SLICE]].astype(kind) @ v.astype(kind).T
                        scores[np.arange(len(scores)), at[s : s + SLICE]] = NEVER
                        least[s : s + SLICE] = np.sort(scores, axis=1)[:, -n_positives].astype(np.int64)
                yield pd.DataFrame({"block": block, "place": at, "label": label, "id": np.frombuffer(ids, np.int64)[at], "vector": [v[i].tobytes() for i in at], "at_least": least})

    label = blocks.schema["label"].dataType.simpleString()
    return blocks.select("block", "label", "ids", "marks", "vectors").mapInPandas(found, f"block long, place int, label {label}, id long, vector binary, at_least long")


def to_read(blocks: DataFrame, sent: Broadcast, dims: int, kind: type, positives: Broadcast | None, window: tuple[int, int, int]) -> DataFrame:
    """(block, anchors): the anchors, packed, that have to read each block. Reads the zone maps only.

    Without ``positives``: blocks of an anchor's label that may hold scores of its positives. With their scores (a row for each anchor): blocks of other labels
    that may hold a score in one of their windows.
    """
    least, most, of = window

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = sent.value
        for pdf in batches:
            low, high = (np.concatenate([_rows(b, dims) for b in pdf[c]]).astype(kind) if len(pdf) else np.zeros((0, dims), kind) for c in ("low", "high"))
            wanted: list[list[np.ndarray]] = [[] for _ in range(len(pdf))]
            for s in range(0, len(a.id), SLICE):
                mine = np.arange(s, min(s + SLICE, len(a.id)))
                lowest, highest = a.bounds(mine, low, high)
                same = a.label[mine][:, None] == pdf["label"].to_numpy()[None, :]
                if positives is None:
                    need = same & (highest >= a.at_least[mine][:, None])
                else:
                    need = np.zeros_like(same)
                    for p in positives.value[mine].T:
                        need |= (p != NEVER)[:, None] & (of * highest >= (least * p)[:, None]) & (of * lowest <= (most * p)[:, None])
                    need &= ~same
                for k in np.flatnonzero(need.any(axis=0)):
                    wanted[k].append(mine[need[:, k]])
            some = [k for k, w in enumerate(wanted) if w]
            yield pd.DataFrame({"block": pdf["block"].to_numpy()[some], "anchors": pd.Series([np.concatenate(wanted[k]).astype(np.int32).tobytes() for k in some], dtype=object)})

    return blocks.select("block", "label", "low", "high").mapInPandas(chosen, "block long, anchors binary")


class Best:
    """The best ``k`` of each of ``n`` lists: higher scores first, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.worst = k, [np.zeros(0, np.int64) for _ in range(3)], np.full(n, NEVER)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        of, score, ids = (np.concatenate([h, x.astype(np.int64)]) for h, x in zip(self.held, (of, score, ids), strict=True))
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        first = np.searchsorted(of, of)
        place = np.arange(len(of)) - first
        keep = place < self.k
        self.held = [of[keep], score[keep], ids[keep]]
        last = place == self.k - 1
        self.worst[of[last]] = score[last]


def _read(joined: DataFrame, sent: Broadcast, dims: int, kind: type, positives: Broadcast | None, window: tuple[int, int, int], k: int) -> DataFrame:
    """(list, score, id): of each list (an anchor, or an anchor and one of its positives) the best ``k`` that a task has met."""
    least, most, of = window

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = sent.value
        width = 1 if positives is None else positives.value.shape[1]
        found = Best(len(a.id) * width, k)
        for pdf in batches:
            for block, ids, vectors, wanted in zip(pdf["block"], pdf["ids"], pdf["vectors"], pdf["anchors"], strict=True):
                ids, v, wanted = np.frombuffer(ids, np.int64), _rows(vectors, dims).astype(kind), np.frombuffer(wanted, np.int32)
                for s in range(0, len(wanted), SLICE):
                    mine = wanted[s : s + SLICE]
                    scores = a.v[mine] @ v.T
                    for j in range(width):
                        lists = mine.astype(np.int64) * width + j
                        good = scores >= found.worst[lists][:, None]
                        if positives is None:
                            own = np.flatnonzero(a.block[mine] == block)
                            good[own, a.place[mine[own]]] = False
                        else:
                            p = positives.value[mine, j]
                            good &= (p != NEVER)[:, None] & (of * scores >= (least * p)[:, None]) & (of * scores <= (most * p)[:, None])
                        r, c = np.nonzero(good)
                        if len(r):
                            found.add(lists[r], scores[r, c], ids[c])
        yield pd.DataFrame(dict(zip(("list", "score", "id"), found.held, strict=True)))

    return joined.select("block", "ids", "vectors", "anchors").mapInPandas(best, "list long, score long, id long")


def _ranked(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "v", n_positives: int = 5, n_negatives: int = 5, window: tuple[int, int, int] = (80, 100, 100)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which ``anchor`` holds.

    Vectors are arrays of integers, a score is the inner product with the anchor. Higher scores come first, ties by the smaller id (null first). Positives are the first ``n_positives``
    other rows of the anchor's label; of each, the negatives are the first ``n_negatives`` rows of other labels with least * positive <= of * negative <= most * positive,
    where ``window`` is (least, most, of).

    Rows with a null label or vector, or a null in it, take no part; of two vectors the shorter one ends in zeros. Rows with equal ids are rows of their own, and
    anchors of their own. Anchors without positives, and positives without negatives, give no rows; nor does an empty table. Other columns do not matter. Scores that need more than
    53 bits are computed in integers of any size, slowly; they have to fit in 62.
    """
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    dims, low, high = rows.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    spark, dims, low, high = vectors.sparkSession, max(int(dims or 0), 1), min(int(low or 0), 0), max(int(high or 0), 0)
    kind = np.float64 if max(-low, high) ** 2 * dims * max(window) < 1 << 53 else object
    blocks = laid_out(rows, dims, low, high)
    anchors = stored(anchors_of(blocks, dims, kind, n_positives).withColumn("draw", F.xxhash64("block", "place")), "negatives-anchors")
    rounds = max(1, -(-anchors.count() // MOST_ANCHORS))
    out = None
    for r in range(rounds):
        own = anchors.where(F.pmod("draw", F.lit(rounds)) == r).orderBy("block", "place").toPandas()  # about MOST_ANCHORS rows
        sent = spark.sparkContext.broadcast(Anchors(own, dims, kind))
        near = to_read(blocks, sent, dims, kind, None, window)
        positives = _ranked(_read(blocks.join(near, "block"), sent, dims, kind, None, window, n_positives), n_positives).toPandas()
        scores = np.full((len(own), n_positives), NEVER)
        scores[positives["list"].to_numpy(np.int64), positives["rank"].to_numpy(np.int64) - 1] = positives["score"].to_numpy(np.int64)
        sent_scores = spark.sparkContext.broadcast(scores if kind is not object else scores.astype(object))
        far = to_read(blocks, sent, dims, kind, sent_scores, window)
        found = _ranked(_read(blocks.join(far, "block"), sent, dims, kind, sent_scores, window, n_negatives), n_negatives)
        named = positives.assign(list=positives["list"] * n_positives + positives["rank"] - 1, anchor_id=own["id"].to_numpy()[positives["list"].to_numpy(np.int64)])[["list", "anchor_id", "id", "score"]]
        of = spark.createDataFrame(named.astype("int64"), "list long, anchor_id long, positive_id long, positive_score long")
        part = cut(found.join(of, "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        out = part if out is None else out.union(part)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(real("anchor_id"), real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.where(finite).select("vec_id", label.cast("int").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return mine(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label AS own, t.vec_id AS id, t.label, CAST(list_inner_product(a.v, t.v) AS BIGINT) AS s FROM t a JOIN t ON a.vec_id % 100 = 0 AND a.vec_id <> t.vec_id),
pos AS (SELECT anchor_id, own, id AS positive_id, s AS positive_score FROM p WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5),
neg AS (SELECT pos.anchor_id, positive_id, positive_score, id AS negative_id, s AS negative_score, row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY s DESC, id) AS rank
  FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND p.label <> pos.own AND 80 * positive_score <= 100 * s AND s <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
