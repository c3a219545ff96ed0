"""Token ids in length-delimited binary records, with masked checksums and an offset index for shuffled reads.

A record: the length of its payload (8 bytes, little-endian), the masked CRC-32 of those 8 bytes (4), the payload, and
its masked CRC-32 (4). A payload: the ids, each as 2 or 4 bytes, little-endian. A file ``part-NNNNN.rec`` holds the documents of
one range of ids in ascending order. Its index, beside it, holds for each record: number, document, offset, ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm import textops
from voxlake.storage import new_path

#: Fixed value of the record format: the constant that masks a checksum, after a rotation by 15 bits.
MASK_DELTA = 0xA282EAD8
HEAD, FOOT = 12, 4
#: A word that a tokenizer encodes as one id of its own, and in which nothing else ends.
BETWEEN = b"\x7f"
#: Words that a task keeps the ids of; beyond that it starts anew.
CACHE_WORDS = 2_000_000
FILE_BYTES = 64 << 20


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes | memoryview) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(buf: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at``, and where the next begins; an error where a checksum differs."""
    head = buf[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", buf, at + 8)[0] != masked(head):
        raise ValueError(f"bad length at byte {at}")
    end = at + HEAD + struct.unpack("<Q", head)[0]
    payload = buf[at + HEAD : end]
    if struct.unpack_from("<I", buf, end)[0] != masked(payload):
        raise ValueError(f"bad payload at byte {at}")
    return payload, end + FOOT


class WordEncoder:
    """Ids of texts by the ids of their distinct words, kept for the words seen of late.

    The tokenizer cuts at white space, so a text's ids are its words' ids; it also cuts between a letter and punctuation. Words are
    found and told apart by 64-bit hashes in numpy (at most CACHE_WORDS of them are known at once); each new one is encoded by the
    tokenizer, many in one call with a word between them that stands in none of them.
    """

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        (between,) = self._ids([BETWEEN.decode()])
        self.between = between[0] if len(between) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.hash, self.first, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        plain = np.array([self.between is not None and BETWEEN not in w and b"<|" not in w for w in words], bool)
        together, alone = [w for w, p in zip(words, plain, strict=True) if p], [w for w, p in zip(words, plain, strict=True) if not p]
        lines = [(b" " + BETWEEN + b" ").join([*together[i : i + 500], b""]).decode() for i in range(0, len(together), 500)]
        flat = np.array([x for ids in self._ids(lines) for x in ids], self.dtype)
        cut = np.flatnonzero(flat == (self.between or 0)) if together else np.zeros(0, np.int64)
        if len(cut) != len(together):
            raise ValueError("the separating word occurs in a word's ids")
        of_plain = np.delete(flat, cut)
        single = self._ids([w.decode() for w in alone])
        length = np.empty(len(words), np.int64)
        length[plain], length[~plain] = np.diff(cut, prepend=-1) - 1, [len(x) for x in single]
        ids = np.empty(int(length.sum()), self.dtype)
        mine = np.repeat(plain, length)
        ids[mine], ids[~mine] = of_plain, [i for x in single for i in x]
        return ids, length

    @staticmethod
    def _units(w: textops.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte bounds of words, those that end in punctuation after a letter cut in two there, and where each text's begin."""
        mark = np.isin(w.buf, np.frombuffer(b".,!?;:", np.uint8))
        stem_end = np.maximum.accumulate(np.where(mark, 0, np.arange(1, len(w.buf) + 1)))[w.end - 1]
        last, before = w.buf[np.maximum(stem_end - 1, 0)], w.buf[np.maximum(stem_end - 2, 0)]
        letter = ((last | 0x20) >= 0x61) & ((last | 0x20) <= 0x7A)
        letter |= (before == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
        cut = (stem_end > w.start) & (stem_end < w.end) & letter
        more = np.cumsum(cut) - cut
        at = np.arange(len(cut)) + more
        start, end = np.empty(len(cut) + int(cut.sum()), np.int64), np.empty(len(cut) + int(cut.sum()), np.int64)
        start[at], end[at] = w.start, np.where(cut, stem_end, w.end)
        start[at[cut] + 1], end[at[cut] + 1] = stem_end[cut], w.end[cut]
        return start, end, np.append(at, len(start))[w.offset]

    def encode(self, raw: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each with ``end_id`` at its end, and where each text's begin."""
        w = textops.words(raw)
        start, end, offset = self._units(w)
        h, at, which = np.unique(w.hashes(start, end), return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_WORDS:
            self._clear()
        place = np.searchsorted(self.hash, h)
        known = place < len(self.hash)
        known[known] = self.hash[place[known]] == h[known]
        new = np.flatnonzero(~known)
        ids, length = self._words_ids([bytes(w.buf[s:e]) for s, e in zip(start[at[new]], end[at[new]], strict=True)])
        self.first = np.insert(self.first, place[new], len(self.ids) + np.cumsum(length) - length)
        self.length, self.hash = np.insert(self.length, place[new], length), np.insert(self.hash, place[new], h[new])
        self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.hash, h)[which]
        first, length = self.first[place], self.length[place]
        done = np.zeros(len(place) + 1, np.int64)  # ids before each unit, without the texts' ends
        np.cumsum(length, out=done[1:])
        out = self.ids[np.repeat(first - done[:-1], length) + np.arange(done[-1])]
        return np.insert(out, done[offset[1:]], end_id), done[offset] + np.arange(len(offset))


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordEncoder(path, dtype)
    return _encoders[path, dtype]


def _lowered(text: bytes | None) -> bytes:
    """A-Z lower-cased, as the tokenizer does, so that fewer words differ; not where a special token may stand."""
    return b"" if text is None else text if b"<|" in text else text.lower()


def _runs(texts: list[bytes], limit: int = textops.CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Texts in runs of ``limit`` bytes at most; a longer text alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if first < i and size + len(t) > limit:
            yield texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield texts[first:]


def _open(path: str):
    from pyarrow import fs

    # Hadoop's names of schemes, as pyarrow knows them
    scheme, colon, rest = path.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def write_records(docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, width: int = 2, files: int | None = None) -> DataFrame:
    """Write the files and their index below ``out``; returns the index: (file, number, doc, offset, n_tokens).

    Documents are dealt to files by ranges of their id (nulls first) and sorted by id, then text, within each. A file is written
    under another name and then moved, so a task that runs again replaces it whole. ``width``: bytes of an id.

    Null and empty texts have the end id only. Repeated rows are records of their own; ties of id and text stay in any order, as their
    records are equal. Ids keep their type and value. An empty table gives one file without records. ``out`` is a folder that pyarrow's
    file systems can open on every executor (file, hdfs, s3, gs, abfs).
    """
    dtype = {2: "<u2", 4: "<u4"}[width]
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    if files is None:
        size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES))

    kind = own.schema["doc"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId()
        system, base = _open(out)
        system.create_dir(base, recursive=True)
        name, attempt = f"{base}/part-{n:05d}.rec", TaskContext.get().taskAttemptId()
        encode = encoder(tokenizer_path, dtype).encode
        at = number = 0
        with system.open_output_stream(f"{name}.{attempt}") as f:
            for batch in batches:
                offsets, lengths = [], []
                for part in _runs([*map(_lowered, batch.column("text").cast(pa.large_binary()).to_pylist())]):
                    ids, edge = encode(part, end_id)
                    payloads = memoryview(ids.tobytes())
                    for a, b in zip((edge[:-1] * width).tolist(), (edge[1:] * width).tolist(), strict=True):
                        record = frame(payloads[a:b])
                        f.write(record)
                        offsets.append(at)
                        at += len(record)
                    lengths.append(np.diff(edge))
                rows = len(offsets)
                length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
                numbers = np.arange(number, number + rows)
                # ids pass as they came, so that none is rounded beside a null
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, n, np.int32)), pa.array(numbers), batch.column("doc"), pa.array(offsets, pa.int64()), pa.array(length)], ["file", "number", "doc", "offset", "n_tokens"])
                number += rows
        system.move(f"{name}.{attempt}", name)

    index = own.repartitionByRange(files, "doc").sortWithinPartitions("doc", "text").mapInArrow(write, f"file int, number long, doc {kind}, offset long, n_tokens long")
    # the index is written once, in the same pass as the files
    path = f"{out}/index"
    index.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(index.schema).parquet(path)


def read_records(spark, index: DataFrame, out: str, width: int = 2, run_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, number, n_tokens, ids_crc32) of every record, read back from the files by their index; checksums are verified.

    Runs of neighbouring records are read by offset, so a file's runs are read side by side. A record whose checksum differs is an
    error. Repeated documents are records of their own; an empty index gives no rows.
    """
    runs = index.groupBy("file", F.floor(F.col("offset") / run_bytes).alias("run")).agg(F.min("offset").alias("first"), F.max_by(F.struct("offset", "n_tokens"), "offset").alias("last"), F.min("number").alias("number"), F.count("*").alias("n"))
    runs = runs.select("file", "number", "n", "first", (F.col("last.offset") + HEAD + FOOT + F.col("last.n_tokens") * width).alias("end"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                system, base = _open(out)
                rows = []
                with system.open_input_file(f"{base}/part-{r.file:05d}.rec") as f:
                    f.seek(r.first)
                    buf = f.read(r.end - r.first)
                at = 0
                for k in range(r.n):
                    payload, at = unframe(buf, at)
                    ids = np.frombuffer(payload, f"<u{width}")
                    rows.append((r.file, r.number + k, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pd.DataFrame(rows, columns=["file", "number", "n_tokens", "ids_crc32"])

    return runs.repartition("file", "number").mapInPandas(read, "file int, number long, n_tokens long, ids_crc32 long")


def read_shuffled(spark, index: DataFrame, out: str, seed: int, width: int = 2) -> DataFrame:
    """(doc, ids) of every record once, in a random order: index rows are shuffled, and each record is read by its offset.

    The order is a function of the seed and the records' places, so reruns agree. Checksums are verified; a record that differs is
    an error. Null and repeated documents are records like others; an empty index gives no rows.
    """
    kind = index.schema["doc"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            system, base = _open(out)
            file, offset, n = (batch.column(c).to_numpy() for c in ("file", "offset", "n_tokens"))
            ids: list = [None] * len(file)
            order = np.lexsort((offset, file))  # each file is opened once, and read forwards
            for rows in np.split(order, np.flatnonzero(np.diff(file[order])) + 1) if len(order) else []:
                with system.open_input_file(f"{base}/part-{file[rows[0]]:05d}.rec") as f:
                    for r in rows.tolist():
                        f.seek(int(offset[r]))
                        ids[r] = np.frombuffer(unframe(f.read(int(HEAD + FOOT + n[r] * width)), 0)[0], f"<u{width}").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(ids, pa.list_(pa.int64()))], ["doc", "ids"])

    order = F.xxhash64(F.lit(seed), "file", "number")
    return index.repartitionByRange(order).sortWithinPartitions(order, "file", "number").mapInArrow(read, f"doc {kind}, ids array<long>")


def op5_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = new_path(spark, "records")
    index = write_records(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    read = read_records(spark, index, out)
    per_file = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_file.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row for each file
    within = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.select("file", "number", "doc", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("at"))
    placed = placed.join(bases, "file").join(read.hint("merge"), ["file", "number"])
    return placed.select(F.col("doc").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
