"""Katz backoff language model: Good-Turing discounted bigram counts with exactly normalised backoff weights.

P(w | h) = d2(c) c(h, w) / c(h) where the pair was seen c > 0 times in training, and a(h) P(w) otherwise; P(w) = d1(c) c(w) / N, and what the
discounts leave over where w was never seen. a(h) shares what the discounts of h's pairs leave over among the words not seen after h, so that
each history's probabilities add up to one. Discounts are Good-Turing's, of smoothed counts of counts, up to a count of K; above it counts keep LARGE of themselves, so
that every history has something to give.

Pairs are dealt by their word, so a bucket knows c(w) and c(h, w) of all of its pairs. Frequent words, whose counts are counted first, are dealt by word and
history. From one pass over a bucket come a document's sums that do not depend on the discounts, the sums per
history, and pairs not seen; the two latter are dealt by history. All are kept as tables of packed columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import textops
from voxlake.storage import new_path

K, LARGE = 5, 0.999
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Frequent words dealt by history as well; tokens of a packed batch, and of a bucket.
FREQUENT, BATCH_TOKENS, BUCKET_TOKENS = 1024, 3_000_000, 4_000_000
#: Bytes of texts tokenized at a time, and rows of sums of texts, or of pairs not seen, handed over at a time.
TEXT_BYTES, FLUSH = 1 << 18, 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows for which temporary columns are made at a time: when dealt, when counted.
SLICE, RANGE = 1 << 19, 1 << 18
#: Bytes of packed columns handed over at a time.
PART_BYTES = 4 << 20
#: Bits of a text's number within its batch, and of a batch's within its task.
TEXT_BITS, BATCH_BITS = 22, 17


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal or different lengths as bytes, each byte plane apart, compressed."""
    out = []
    for c in columns:
        c = np.ascontiguousarray(c)
        planes = c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()
        body = zstandard.ZstdCompressor(level=1).compress(planes)
        out.append(struct.pack("<4sII", c.dtype.str[1:].encode(), len(c), len(body)) + body)
    return b"".join(out)


def unpack(blob: bytes | memoryview) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n, size = struct.unpack_from("<4sII", blob, at)
        at += 12
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at : at + size], max_output_size=max(1, n * dtype.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.zeros(0, dtype))
        at += size
    return out


def pack_sorted(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, x.dtype))


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned integers that hold them."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def discounts(n: list[int]) -> list[float]:
    """Good-Turing's d(1)..d(K) from the numbers n of things seen 1..K+1 times, smoothed by a line through log n(r) over log r.

    The line keeps every d(r) within (0, 1) if its slope is below -1. Otherwise, or if some n(r) is zero, as in tiny tables, those of absolute discounting.
    """
    if all(n):
        slope = np.polyfit(np.log(np.arange(1, K + 2)), np.log(n), 1)[0]
        if slope < -1:
            common = (K + 1) ** (slope + 1)
            return [float(((1 + 1 / r) ** (slope + 1) - common) / (1 - common)) for r in range(1, K + 1)]
    amount = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [1 - amount / r for r in range(1, K + 1)]


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes with an end after each text, token offsets) of runs of rows, about TEXT_BYTES each; ``text`` has no nulls.

    Only a run's texts become Python's: those of a whole batch would stay beside the task's own columns.
    """
    texts = batch.column("text")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        past = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, past + TEXT_BYTES, "right")))
        run = texts.slice(first, last - first)
        raw = [x.lower() for x in run.cast(pa.large_binary() if pa.types.is_large_string(run.type) else pa.binary()).to_pylist()]
        w = textops.words(raw)
        offset = w.offset + np.arange(len(raw) + 1)
        out = np.full(offset[-1], END)
        at = np.ones(len(out), bool)
        at[offset[1:] - 1] = False
        out[at] = w.hashes()
        del raw, w, at
        yield first, out, offset
        first = last


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Hashes and exact training counts of the most frequent words of a part of the documents; tokens of training, of all, and training texts.

    Which words these are decides only how pairs are dealt, not what is counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, _ in _tokens(batch):
                u, n = np.unique(x, return_counts=True)
                yield pa.RecordBatch.from_pydict({"w": u.view(np.int64), "n": n.astype(np.int64)})
            textops.release()

    part = docs.where(F.pmod(F.xxhash64("uid"), F.lit(64)) == 0)
    top = part.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(FREQUENT).collect()
    hot = np.unique(np.array([r.w for r in top] + [int(END)], np.int64).view(np.uint64))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, train, every, texts = np.zeros(len(hot), np.int64), 0, 0, 0
        for batch in batches:
            held = _column(batch, "held")
            for first, x, offset in _tokens(batch):
                mine = ~held[first : first + len(offset) - 1]
                x_train = x[np.repeat(mine, np.diff(offset))]
                at = np.minimum(np.searchsorted(hot, x_train), len(hot) - 1)
                counts += np.bincount(at[hot[at] == x_train], minlength=len(hot))
                train, every, texts = train + len(x_train), every + len(x), texts + int(mine.sum())
            textops.release()
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(hot) + 3, dtype=np.int32), "n": np.array([*counts, train, every, texts], np.int64)})

    rows = docs.select("text", "held").mapInArrow(exact, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # as many as FREQUENT, and four
    n = np.zeros(len(hot) + 3, np.int64)
    for r in rows:
        n[r.k] = r.n
    return hot, n[:-3], int(n[-3]), int(n[-2]), int(n[-1])


def _bucket(word: np.ndarray, history: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
    spread = np.where(hot[at] == word, textops.mix(word * MIX + history), word * MIX)
    return ((spread >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _pairs(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, blob): packed (word, history, text, times) of batches of texts, by bucket; from ``buckets`` on, packed (text, uid).

    Texts are numbered by task, batch and place, so that the numbers of a blob lie close together and pack to a byte each.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        number = TaskContext.get().partitionId() << BATCH_BITS

        def done() -> Iterator[pa.RecordBatch]:
            lengths = np.concatenate([np.diff(o) for _, _, o, _, _ in held])
            uid, out_of = np.concatenate([u for _, _, _, u, _ in held]), np.concatenate([h for _, _, _, _, h in held])
            u = np.unique(np.concatenate([*(own for own, _, _, _, _ in held), [START]]))
            code = np.concatenate([np.searchsorted(u, own).astype(np.int32)[c] for own, c, _, _, _ in held])
            held.clear()
            key = code.astype(np.int64) * len(u)
            key[1:] += code[:-1]
            first = np.cumsum(lengths) - lengths
            key[first] += np.searchsorted(u, START) - np.where(first > 0, code[first - 1], 0)
            del code
            key *= len(lengths)  # below 2**63 for 2**21 words and texts
            key += np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            key.sort()
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.int32)
            times = narrow(np.diff(at, append=np.int32(len(key))))
            key = key[at]
            del at
            doc, w, h = (np.empty(len(key), np.int32) for _ in range(3))
            np.remainder(key, len(lengths), out=doc, casting="unsafe")
            key //= len(lengths)
            np.remainder(key, len(u), out=h, casting="unsafe")
            np.floor_divide(key, len(u), out=w, casting="unsafe")
            del key
            b = np.concatenate([_bucket(u[w[i : i + SLICE]], u[h[i : i + SLICE]], hot, buckets).astype(np.int32) for i in range(0, len(w), SLICE)])
            ids = (np.int64(number) << TEXT_BITS) + np.arange(len(lengths))
            edge = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=buckets))])
            order = np.argsort(b, kind="stable").astype(np.int32)
            del b
            blobs = [(buckets + k, blob) for _, k, blob in _split("", ids, buckets, [ids, uid], wide=2)]
            for k in range(buckets):
                if sum(len(blob) for _, blob in blobs[-64:]) > PART_BYTES or len(blobs) >= 64:
                    yield _batch(blobs, bucket=pa.int32(), blob=pa.binary())
                    blobs = []
                at = order[edge[k] : edge[k + 1]]
                if len(at):
                    uw, iw = np.unique(w[at], return_inverse=True)
                    uh, ih = np.unique(h[at], return_inverse=True)
                    ud, id_ = np.unique(doc[at], return_inverse=True)
                    blobs.append((k, pack(pack_sorted(u[uw]), narrow(pack_sorted(iw)), pack_sorted(u[uh]), narrow(ih), pack_sorted(ids[ud]), out_of[ud].astype(np.uint8), narrow(id_), narrow(times[at]))))
            yield _batch(blobs, bucket=pa.int32(), blob=pa.binary())
            blobs.clear()
            textops.release()

        for batch in batches:
            uid, out_of = _column(batch, "uid"), _column(batch, "held")
            for first, x, offset in _tokens(batch):
                rows = slice(first, first + len(offset) - 1)
                if held and size + len(x) > BATCH_TOKENS:
                    yield from done()
                    held, size, number = [], 0, number + 1
                own, code = np.unique(x, return_inverse=True)
                held.append((own, code.astype(np.int32), offset, uid[rows].copy(), out_of[rows].copy()))
                size += len(x)
        if held:
            yield from done()

    return docs.select("uid", "held", "text").mapInArrow(deal, "bucket int, blob binary")


def _batch(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=[*types])


def _split(kind: str, by: np.ndarray, buckets: int, columns: list[np.ndarray], wide: int = 1) -> Iterator[tuple[str, int, bytes]]:
    """Packed columns by bucket of ``by``; all integers but the first ``wide`` columns are counts."""
    b = ((by.view(np.uint64) * MIX >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    edge = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        if edge[k] < edge[k + 1]:
            yield kind, k, pack(*(narrow(c[order[edge[k] : edge[k + 1]]]) if i >= wide and c.dtype == np.int64 else c[order[edge[k] : edge[k + 1]]] for i, c in enumerate(columns)))


def _blobs(rows: list[tuple[str, int, bytes]]) -> pd.DataFrame:
    """Rows (kind, bucket, blob); columns without rows have no type that Arrow could tell, so they are named."""
    kind, bucket, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pd.DataFrame({"kind": pd.Series(kind, dtype=object), "bucket": np.array(bucket, np.int32), "blob": pd.Series(blob, dtype=object)})


def _word_ranges(rows: np.ndarray, size: int) -> list[int]:
    """Edges of runs of words of about ``size`` rows each, from the rows of each word; a word stays whole."""
    before = np.cumsum(rows) - rows
    edges = np.searchsorted(before, np.arange(0, int(rows.sum()), size))
    return np.unique(np.append(edges, len(rows))).tolist()  # a long last word gives its own end among them


def _count(blobs: list[list[np.ndarray]], hot: np.ndarray, hot_counts: np.ndarray, buckets: int) -> Iterator[tuple[str, int, bytes]]:
    """All that one bucket of pairs yields; see the module. ``blobs`` is used up.

    Runs of words are taken one after the other, as a blob's rows are ordered by word, and give the pairs' and the words' counts.
    With these each blob gives its texts' sums: no text is in two blobs, so no more texts than a blob's are summed at a time.
    """
    for x in blobs:
        x[0], x[2], x[4] = np.cumsum(x[0]), np.cumsum(x[2]), np.cumsum(x[4])
    words_, histories = (np.unique(np.concatenate([x[i] for x in blobs])) for i in (0, 2))
    rows_of = np.zeros(len(words_), np.int64)
    for x in blobs:
        x[1] = np.concatenate([[0], np.flatnonzero(x[1]), [len(x[1])]])  # where a blob's words begin
        rows_of[np.searchsorted(words_, x[0])] += np.diff(x[1])
    n_h = len(histories)
    times_in_all = sum(int(x[7].sum(dtype=np.int64)) for x in blobs)
    counts = [np.zeros(len(x[7]), np.uint32 if times_in_all < 1 << 32 else np.uint64) for x in blobs]  # of each row's pair
    stats, counts_of = np.zeros(2 * (K + 1) + 1, np.int64), np.zeros(len(words_), np.int64)
    # of each history: pairs that count 1..K and the sum of larger counts, then the same of the pairs' words
    of_history = [np.zeros(n_h, np.int64 if r == K else np.int32) for _ in range(2) for r in range(K + 1)]
    edges = _word_ranges(rows_of, RANGE)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        w, h, times, parts = [], [], [], []
        for uw, begin, uh, ih, _, out_of, id_, m in blobs:
            i, j = np.searchsorted(uw, words_[low]), np.searchsorted(uw, words_[high - 1], "right")
            part = slice(begin[i], begin[j])
            parts.append(part)
            w.append(np.repeat(np.searchsorted(words_, uw[i:j]), np.diff(begin[i : j + 1])))
            h.append(np.searchsorted(histories, uh).astype(np.int32)[ih[part]])
            times.append(np.where(out_of[id_[part]], 0, m[part].astype(np.int64)))  # in training
        key = np.concatenate(w) * n_h + np.concatenate(h)
        w.clear()
        h.clear()
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        c2 = np.add.reduceat(np.concatenate(times)[order], first)
        times.clear()
        pw, ph = np.divmod(key[first], n_h)
        del key
        first_w = np.flatnonzero(np.concatenate([[True], pw[1:] != pw[:-1]]))
        c1 = np.add.reduceat(c2, first_w)
        words = words_[pw[first_w]]
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        is_hot = hot[at] == words
        c1 = np.where(is_hot, hot_counts[at], c1)
        counts_of[pw[first_w]] = c1
        cold = c1[~is_hot]
        stats += [*np.bincount(c2[c2 <= K + 1], minlength=K + 2)[1:], *np.bincount(cold[cold <= K + 1], minlength=K + 2)[1:], (cold > 0).sum()]
        seen = c2 > 0
        at, place = np.unique(ph[seen], return_inverse=True)
        yield "pairs", 0, pack(pack_sorted(words), narrow(c1), narrow(np.add.reduceat(seen, first_w, dtype=np.int64)), pack_sorted(histories[at]), narrow(place), narrow(c2[seen]))

        c1 = np.repeat(c1, np.diff(np.append(first_w, len(first))))  # of each pair
        for row, c in ((0, c2[seen]), (K + 1, c1[seen])):
            for r in range(1, K + 1):
                of_history[row + r - 1][at] += np.bincount(place[c == r], minlength=len(at))
            of_history[row + K][at] += np.rint(np.bincount(place, np.where(c > K, c, 0), minlength=len(at))).astype(np.int64)

        of_row = np.empty(len(order), counts[0].dtype)
        of_row[order] = c2[np.cumsum(new, dtype=np.int32) - 1]
        ends = np.cumsum([part.stop - part.start for part in parts])
        for c, part, end in zip(counts, parts, ends, strict=True):
            c[part] = of_row[end - (part.stop - part.start) : end]
    yield "stats", 0, stats.tobytes()
    some = np.logical_or.reduce([c > 0 for c in of_history[: K + 1]])
    of_history = [narrow(c[some]) for c in of_history]
    yield from _split("history", histories[some].view(np.int64), buckets, [histories[some].view(np.int64), *of_history])
    del histories, of_history

    text: list[tuple] = []
    unseen: list[tuple] = []
    while blobs:
        uw, begin, uh, ih, uid, _, id_, times = blobs.pop()
        c2, c1 = counts.pop(), np.repeat(counts_of[np.searchsorted(words_, uw)], np.diff(begin))
        times, ended = times.astype(np.int64), np.repeat(uw == END, np.diff(begin))
        # what a token adds to its text's sum: log10 of its pair's count, less that of its own as the next one's history
        log_pair = np.log10(np.maximum(c2, 1)) - np.where(ended, 0.0, np.log10(np.maximum(c1, 1)))
        add_up = lambda x: np.bincount(id_, times * x, minlength=len(uid))  # noqa: E731, B023
        whole = lambda keep: np.rint(add_up(keep)).astype(np.int64)  # noqa: E731, B023
        text.append((uid, whole(c1 > 0), add_up(np.log10(c1 + 1)), add_up(log_pair), *(whole(c2 == r) for r in range(1, K + 1)), whole(c2 > K)))
        e = np.flatnonzero(c2 == 0)
        unseen.append((uh[ih[e]].view(np.int64), uid[id_[e]], c1[e], times[e]))
        for kind, rows, wide in (("text", text, 1), ("unseen", unseen, 2)):
            if not blobs or sum(len(x[0]) for x in rows) >= FLUSH:
                columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                rows.clear()
                yield from _split(kind, columns[0], buckets, columns, wide=wide)


def _mass(counts: list[np.ndarray], d: list[float]) -> np.ndarray:
    """Discounted counts in total, from how many have each count up to K and the sum of those above."""
    return sum((d[r] * (r + 1) * counts[r].astype(float) for r in range(K)), LARGE * counts[K].astype(float))


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """Every row's (id, held_out, n_tokens, n_known, train_tokens, base_score, score), with a model of the rows that are not held out.

    ``score``: the text's log10 probability, of its words (A-Z lower-cased) and its end. ``base_score``: the same under add-one
    unigrams. Bigrams and histories are tables in the shared folder.

    Null and empty texts consist of their end. A null ``held_col`` counts as not held out. Rows that are equal in id and text count
    as often as they are there, and get equal results each. Texts are read whole. Without training rows all words are new, and
    scores are null. An empty table gives none. Other columns do not matter.

    ``docs`` has to yield its rows in the same order whenever a task runs again, as tables and checkpoints do: texts are numbered by it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(held_col), F.lit(False)).alias("held"), text.alias("text"))
    own = own.withColumn("uid", F.xxhash64("id", "held", "text"))
    hot, hot_counts, n_train, n_all, n_texts = _frequent(own)
    buckets = max(1, -(-n_all // BUCKET_TOKENS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            b = batch.column("bucket")[0].as_py()
            blobs += [unpack(memoryview(x.as_buffer())) for x in batch.column("blob")]
        del batch
        if b >= buckets:
            found = iter([("ids", b - buckets, pack(*(np.concatenate(c) for c in zip(*blobs, strict=True))))])
        else:
            found = _count(blobs, hot, hot_counts, buckets)
        rows: list[tuple] = []
        for row in found:
            rows.append(row)
            if sum(len(blob) for _, _, blob in rows[-64:]) > PART_BYTES or len(rows) >= 64:
                yield _batch(rows, kind=pa.string(), bucket=pa.int32(), blob=pa.binary())
                rows = []
        textops.release()
        yield _batch(rows, kind=pa.string(), bucket=pa.int32(), blob=pa.binary())

    path = new_path(spark, "katz")
    # a partition for each bucket: by a hash several would share one
    pairs = _pairs(own, hot, buckets).repartitionById(buckets, F.col("bucket"))
    pairs.groupBy("bucket").applyInArrow(count, "kind string, bucket int, blob binary").write.partitionBy("kind").parquet(path)
    tables = spark.read.schema("bucket int, blob binary, kind string").parquet(path)

    # the rows of counts of counts: one for each bucket, added in the tasks first
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * (K + 1) + 1, np.int64)
        for pdf in batches:
            for blob in pdf["blob"]:
                total += np.frombuffer(blob, np.int64)
        yield pd.DataFrame({"k": np.arange(len(total)), "n": total})

    stats = dict(tables.where("kind = 'stats'").mapInPandas(add, "k int, n long").groupBy("k").agg(F.sum("n")).collect())
    n2, n1 = [stats.get(r, 0) for r in range(K + 1)], [stats.get(K + 1 + r, 0) + int((hot_counts == r + 1).sum()) for r in range(K + 1)]
    vocabulary = stats.get(2 * (K + 1), 0) + int((hot_counts > 0).sum())
    d2, d1 = discounts(n2), discounts(n1)

    # unigrams: what is left over goes to all that was never seen
    small = sum((r + 1) * n1[r] for r in range(K))
    p_new = 1 - (sum(d1[r] * (r + 1) * n1[r] for r in range(K)) + LARGE * (n_train - small)) / max(n_train, 1)

    def back_off(pdf: pd.DataFrame) -> pd.DataFrame:
        """log10(a(h) P(w) c(h)) for pairs not seen; c(h) cancels what the text's sums hold."""
        history = [unpack(b) for b in pdf.loc[pdf["kind"] == "history", "blob"]]
        unseen = [unpack(b) for b in pdf.loc[pdf["kind"] == "unseen", "blob"]]
        if not unseen:
            return _blobs([])
        h, uid, c1, times = (np.concatenate([u[i] for u in unseen]) for i in range(4))
        c1 = c1.astype(np.int64)
        p = np.where(c1 > K, LARGE * c1, np.take([0.0, *(d1[r] * (r + 1) for r in range(K))], np.minimum(c1, K))) / max(n_train, 1)
        value = np.log10(np.where(c1 > 0, p, p_new))
        if history:
            columns = [np.concatenate([x[i] for x in history]) for i in range(1 + 2 * (K + 1))]
            hs, ih = np.unique(columns[0], return_inverse=True)
            columns = [np.bincount(ih, c.astype(float), minlength=len(hs)) for c in columns[1:]]
            times_h = sum((r + 1) * columns[r] for r in range(K)) + columns[K]
            left = 1 - _mass(columns[: K + 1], d2) / times_h
            free = 1 - _mass(columns[K + 1 :], d1) / max(n_train, 1)
            weight = np.log10(left) - np.log10(free)
            at = np.minimum(np.searchsorted(hs, h), len(hs) - 1)
            value = value + np.where(hs[at] == h, weight[at] + np.where(h.view(np.uint64) == START, 0.0, np.log10(times_h[at])), 0.0)
        docs_, d = np.unique(uid, return_inverse=True)
        n = len(docs_)
        zero = np.zeros(n, np.int64)
        rows = _split("text", docs_, buckets, [docs_, zero, np.zeros(n), np.bincount(d, value * times, minlength=n), *[zero] * (K + 1), np.bincount(d, np.where(h.view(np.uint64) == START, times, 0).astype(float), minlength=n)])
        rows = [*rows]
        textops.release()
        return _blobs(rows)

    backed = tables.where("kind in ('history', 'unseen')").repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInPandas(back_off, "kind string, bucket int, blob binary")
    log_d = np.log10([*d2, LARGE])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = [unpack(b) for b in pdf.loc[pdf["kind"] == "text", "blob"]]
        ids, uid = (np.concatenate(c) for c in zip(*map(unpack, pdf.loc[pdf["kind"] == "ids", "blob"]), strict=True))
        order = np.argsort(ids)
        columns = [np.concatenate([b[i] for b in blobs]) for i in range(4 + K + 1)]
        new_start = np.concatenate([b[-1] if len(b) > 4 + K + 1 else np.zeros(len(b[0])) for b in blobs])
        textops.release()
        docs_, d = np.unique(columns[0], return_inverse=True)
        add_up = lambda c: np.bincount(d, c.astype(float), minlength=len(docs_))
        score = add_up(columns[3]) + sum(add_up(columns[4 + r]) * log_d[r] for r in range(K + 1))
        return pd.DataFrame({"uid": uid[order[np.searchsorted(ids[order], docs_)]], "n_known": np.rint(add_up(columns[1])).astype(np.int64), "base": add_up(columns[2]), "score": score, "new_start": add_up(new_start)})

    columns = ["kind", "bucket", "blob"]
    sums = tables.where("kind in ('text', 'ids')").select(columns).union(backed.select(columns)).repartitionById(buckets, F.col("bucket"))
    sums = sums.groupBy("bucket").applyInPandas(total, "uid long, n_known long, base double, score double, new_start double")
    sums = sums.groupBy("uid").agg(*(F.sum(c).alias(c) for c in ("n_known", "base", "score", "new_start")))
    n_tokens = (F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")
    rows = own.select("id", "held", "uid", n_tokens.alias("n_tokens"))
    copies = rows.groupBy("uid", "id", "held", "n_tokens").agg(F.count("*").alias("copies"))
    out = copies.join(sums, "uid")
    start = np.log10(n_texts) if n_texts else 0.0
    # the first token's history is the start, seen in every training text
    score = F.col("score") / F.col("copies") - (1 - F.col("new_start") / F.col("copies")) * F.lit(float(start))
    base = F.col("base") / F.col("copies") - F.col("n_tokens") * F.lit(float(np.log10(n_train + vocabulary + 1)))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias(held_col), "n_tokens", (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), F.when(F.lit(n_train > 0), score).alias("score")
    )


def op3_katz(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return fit_and_score(docs.withColumn("held_out", held))
