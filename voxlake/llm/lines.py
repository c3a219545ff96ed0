"""Line dedup: two bitmaps tell lines that may repeat, and only those are exchanged, counted exactly, and dropped.

A line's key is the line without white space at its ends, A-Z in lower case. Every document puts the hashes of its distinct keys into a
Bloom filter of keys seen once; a bit that was set before is set in a second filter, of keys seen twice. Filters of tasks are merged block by block: what two
of them hold in common was seen twice. A key whose bits are not all in the second filter stands in one document. The rest, the suspects, are exchanged as
128-bit digests, counted exactly, and the first document that holds each is chosen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import textops
from voxlake.operators.skew import join_unique
from voxlake.storage import cut

#: Bits of a filter for each line, bits that a key sets, and the bounds of a filter's size (64 MB at most). Beyond the bound more lines are suspects, which costs exchange only.
BITS_PER_LINE, PROBES, LEAST_BITS, MOST_BITS = 8, 2, 1 << 18, 1 << 29
#: Blocks in which filters are merged, each by one task at most.
BLOCKS = 256
#: Common keys, of 16 bytes each, that are sent to all tasks; more are joined.
MOST_SENT = 1 << 22
_LOWER = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


class Lines:
    """Lines of several texts: their keys' bounds in ``raw``, hashes, and the text of each line."""

    def __init__(self, raw: list[bytes]):
        w = textops.words([b.translate(_LOWER) for b in raw])
        self.buf = w.buf
        # the newline before each text and those within it begin its lines
        first = np.flatnonzero(self.buf[:-1] == 0x0A) + 1
        last = np.append(first[1:] - 1, len(self.buf) - 1)
        self.doc = np.searchsorted(w.bounds, first, side="right") - 1
        a, b = np.searchsorted(w.start, first), np.searchsorted(w.start, last)
        full = b > a
        start, end = np.append(w.start, 0), np.append(w.end, 0)
        self.start, self.end = np.where(full, start[np.minimum(a, len(w.start))], 0), np.where(full, end[np.maximum(b - 1, 0)], 0)
        self.hash = w.hashes(self.start, self.end)
        points = textops.code_points(self.buf)
        self.size = points[self.end] - points[self.start]

    def digest(self, i: int) -> bytes:
        return hashlib.blake2b(self.buf[self.start[i] : self.end[i]].tobytes(), digest_size=16).digest()

    def once(self, lines: np.ndarray) -> np.ndarray:
        """The first of each text's lines with one key, among ``lines``."""
        order = lines[np.lexsort((lines, self.hash[lines], self.doc[lines]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.doc[order[1:]] != self.doc[order[:-1]]) | (self.hash[order[1:]] != self.hash[order[:-1]])
        return np.sort(order[new])


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash in a filter: one row for each probe."""
    step = textops.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]).astype(np.int64)


def suspects(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are in a filter."""
    return _bits(held, places(hashes, 8 * len(held))).all(axis=0)


def _bits(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _runs(texts: pd.Series, min_chars: int) -> Iterator[tuple[int, list[bytes], Lines, np.ndarray]]:
    """(first text, texts, lines, those that have a key) of runs of texts."""
    for first, raw in textops.chunks(texts.tolist()):
        lines = Lines(raw)
        yield first, raw, lines, np.flatnonzero((lines.size >= min_chars) & (lines.end > lines.start))


def twice_seen(docs: DataFrame, text_col: str, min_chars: int) -> np.ndarray:
    """The filter of keys that two documents hold, and of few others, as bytes. Only this one comes to the driver."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_LINE * int(n)).bit_length()))
    size = bits // 8 // BLOCKS

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for pdf in batches:
            for _, _, lines, some in _runs(pdf["text"], min_chars):
                at = np.sort(places(lines.hash[lines.once(some)], bits).ravel())
                again = np.concatenate([at[1:][at[1:] == at[:-1]], at[_bits(once, at)]])
                for held, x in ((once, at), (twice, again)):
                    np.bitwise_or.at(held, x >> 3, np.left_shift(1, x & 7).astype(np.uint8))
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(BLOCKS):
            part = slice(k * size, (k + 1) * size)
            if once[part].any():
                yield pd.DataFrame({"block": [k], "once": [pack(once[part].tobytes())], "twice": [pack(twice[part].tobytes())]})
        textops.release()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, once, twice = None, None, None
        pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for pdf in batches:
            for block, a, b in pdf.itertuples(index=False):
                if block != last:
                    if last is not None and twice.any():
                        yield pd.DataFrame({"block": [last], "twice": [pack(twice.tobytes())]})
                    last, once, twice = block, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                new = np.frombuffer(unpack(a), np.uint8)
                twice |= np.frombuffer(unpack(b), np.uint8) | (once & new)
                once |= new
        if last is not None and twice.any():
            yield pd.DataFrame({"block": [last], "twice": [pack(twice.tobytes())]})

    filled = docs.select(F.col(text_col).alias("text")).mapInPandas(fill, "block int, once binary, twice binary")
    merged = filled.repartition("block").sortWithinPartitions("block").mapInPandas(merge, "block int, twice binary")
    held = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():  # BLOCKS rows at most, of MOST_BITS in all
        held[r.block * size : (r.block + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.twice)), np.uint8)
    return held


def suspected(docs: DataFrame, id_col: str, text_col: str, min_chars: int, held: Broadcast) -> DataFrame:
    """(id, t0, t1, key): a row for each document and key that may stand in others as well; t0 and t1 name the document's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), text).alias("t0"), F.xxhash64(F.lit(2), text).alias("t1"), text.alias("text"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = pdf.drop(columns="text")
            for first, _, lines, some in _runs(pdf["text"], min_chars):
                mine = lines.once(some)
                mine = mine[suspects(held.value, lines.hash[mine])]
                out = names.iloc[first + lines.doc[mine]].reset_index(drop=True)
                out["key"] = pd.Series([lines.digest(i) for i in mine.tolist()], dtype=object)
                yield out
            textops.release()

    kind = docs.schema[id_col].dataType.simpleString()
    return named.mapInPandas(emit, f"id {kind}, t0 long, t1 long, key binary")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Every row of ``docs`` with one more column, the struct ``lines``: n_lines, n_dropped, and ``kept``, the text without its common lines.

    A key of ``min_chars`` code points or more that stands in ``min_docs`` documents or more loses its lines everywhere; with ``keep_first``, its first line
    stays in the first document that holds it: the one with the smallest id (null first), then with the smallest hash of its text; rows equal in both keep it each.

    Null and empty texts are one empty line. A line without a key (white space only) stays. A row is a document, so repeated rows count as several; they
    get equal results each. Texts are read whole. An empty table gives none. A column named ``lines`` that was there before is replaced.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(twice_seen(docs, text_col, min_chars) if min_docs > 1 else np.full(LEAST_BITS // 8, 255, np.uint8))  # MOST_BITS at most
    seen = suspected(docs, id_col, text_col, min_chars, held)
    counted = [F.count("*").alias("n")]
    if keep_first:
        counted.append(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "t0", "t1")).alias("first"))
    common = seen.groupBy("key").agg(*counted).where(F.col("n") >= min_docs)
    common = cut(common.select("key", "n", *(F.col(f"first.{c}").alias(c) for c in ("t0", "t1") if keep_first)))
    n_common = common.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    schema = "n_lines long, n_dropped long, kept string"
    if n_common <= MOST_SENT:
        first = ["t0", "t1"] if keep_first else []
        sent = spark.sparkContext.broadcast({bytes(r.key): tuple(r[c] for c in first) for r in common.select("key", *first).toLocalIterator()})  # MOST_SENT at most

        @F.pandas_udf(schema)
        def dropped(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, t0, t1 in batches:
                names = [*zip(t0.tolist(), t1.tolist(), strict=True)]
                yield _without(texts, min_chars, held, lambda d, key: sent.value.get(key), lambda d, found: found == names[d])

        return docs.withColumn("lines", dropped(text, F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)))

    # too many to send: the common keys of each text that has any, by joins; rows of equal texts share them
    of_text = seen.select("t0", "t1", "key").distinct()
    is_first = F.array(*(F.col(c) for c in ("f0", "f1"))) == F.array("t0", "t1") if keep_first else F.lit(False)
    right = common.select("key", "n", *((F.col("t0").alias("f0"), F.col("t1").alias("f1")) if keep_first else ()))
    marks = join_unique(of_text, right, ["key"], "n", of_text.count()).select("t0", "t1", F.struct("key", is_first.alias("first")).alias("m"))
    marks = marks.groupBy("t0", "t1").agg(F.collect_list("m").alias("common"))  # as many as the text has lines

    @F.pandas_udf(schema)
    def parted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, of in batches:
            own = [{} if x is None else {bytes(m["key"]): m["first"] for m in x} for x in of]
            yield _without(texts, min_chars, held, lambda d, key: own[d].get(key), lambda d, found: found)

    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.lit(1), text).alias("t0"), F.xxhash64(F.lit(2), text).alias("t1"))
    joined = keyed.join(marks, ["t0", "t1"], "left")
    out = joined.withColumn("lines", parted(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), F.col("common")))
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "lines"), "lines")


def _without(texts: pd.Series, min_chars: int, held: Broadcast, find, stays) -> pd.DataFrame:
    """Texts without their common lines: ``find(text, key)`` is None for a key that is not common; the first line of one for which ``stays`` holds is kept."""
    n_lines, n_dropped, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), texts.tolist()
    for first, raw, lines, some in _runs(texts, min_chars):
        n_lines[first : first + len(raw)] = np.bincount(lines.doc, minlength=len(raw))
        begins = np.searchsorted(lines.doc, np.arange(len(raw) + 1))
        gone: dict[int, set[int]] = {}
        met: set[tuple[int, bytes]] = set()
        for i in some[suspects(held.value, lines.hash[some])].tolist():
            d, key = int(lines.doc[i]), lines.digest(i)
            found = find(first + d, key)
            if found is None:
                continue
            if stays(first + d, found) and (d, key) not in met:
                met.add((d, key))
                continue
            gone.setdefault(d, set()).add(i - int(begins[d]))
        for d, rows in gone.items():
            n_dropped[first + d] = len(rows)
            kept[first + d] = b"\n".join(x for k, x in enumerate(raw[d].split(b"\n")) if k not in rows).decode()
    textops.release()
    return pd.DataFrame({"n_lines": n_lines, "n_dropped": n_dropped, "kept": kept})


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_lines(docs)
    return out.select("doc_id", F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_dropped").alias("n_dropped"), F.sha2(F.encode(F.col("lines.kept"), "UTF-8"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, i, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS s
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT doc_id, i, line, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
