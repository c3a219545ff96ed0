"""Scores against a plain recursive backoff model, whose probabilities add up to one."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlake.llm import katz

START, END = object(), "</s>"


class Plain:
    """Katz backoff of order 2 over lists of tokens."""

    def __init__(self, texts):
        self.c1 = Counter(w for t in texts for w in t)
        self.c2 = Counter((h, w) for t in texts for h, w in zip([START, *t], t))
        self.ch = Counter(h for t in texts for h in [START, *t[:-1]])
        self.n = sum(self.c1.values())
        counts = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
        self.d1, self.d2 = katz.discounts(counts(self.c1)), katz.discounts(counts(self.c2))
        self.new = 1 - sum(self.one(w) for w in self.c1)

    def one(self, w):
        c = self.c1[w]
        return (self.d1[c - 1] if c <= katz.K else katz.LARGE) * c / self.n if c else self.new

    def seen(self, h, w):
        c = self.c2[h, w]
        return (self.d2[c - 1] if c <= katz.K else katz.LARGE) * c / self.ch[h]

    def weight(self, h):
        after = [w for g, w in self.c2 if g == h]
        return (1 - sum(self.seen(h, w) for w in after)) / (1 - sum(self.one(w) for w in after)) if after else 1.0

    def two(self, h, w):
        return self.seen(h, w) if self.c2[h, w] else self.weight(h) * self.one(w)


def tokens(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").split()] + [END]


def rows(rng):
    word = lambda n: " ".join(f"W{int(x)}" for x in rng.zipf(1.4, n) % 60)
    out = [(i, word(int(rng.integers(1, 40)))) for i in range(150)]
    return out + [(200, None), (201, ""), (202, "never seen words"), (202, "never seen words"), (None, "w1 w2 w3"), (203, "w1 " * 3000)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("bucket,batch", [(4_000_000, 3_000_000), (500, 900)])
def test_scores_equal_the_plain_model(spark, monkeypatch, tmp_path, bucket, batch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(katz, "BATCH_TOKENS", batch)
    data = rows(np.random.default_rng(5))
    mark = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    spark.createDataFrame(data, "doc_id long, text string").select("*", mark.alias("held_out"), F.lit("clash").alias("uid"), F.lit("c").alias("bucket")).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    model = Plain([tokens(t) for i, t in data if not held(i)])
    vocabulary = [*model.c1]
    for h in [START, "w1", "w2", "w59", "never"]:
        assert sum(model.two(h, w) for w in vocabulary) + model.weight(h) * model.new == pytest.approx(1)
    wanted = []
    for i, t in data:
        x = tokens(t)
        base = sum(math.log10((model.c1[w] + 1) / (model.n + len(vocabulary) + 1)) for w in x)
        score = sum(math.log10(model.two(h, w)) for h, w in zip([START, *x], x))
        wanted.append((str(i), t or "", held(i), len(x), sum(model.c1[w] > 0 for w in x), model.n, base, score))
    got = katz.fit_and_score(docs)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(((str(r.doc_id), *r[1:]) for r in got.collect()), key=lambda r: (r[0], r[2], r[6]))
    wanted = sorted(((r[0], *r[2:]) for r in wanted), key=lambda r: (r[0], r[2], r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.array([r[5:] for r in got]) == pytest.approx(np.array([r[5:] for r in wanted]), rel=1e-9)
    assert katz.fit_and_score(docs.where("false")).count() == 0


def test_without_training_rows_scores_are_null(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = katz.fit_and_score(docs).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in sorted(got)] == [(3, 0, 0, None), (1, 0, 0, None)]


@pytest.mark.parametrize(
    "data",
    [
        [(1, "a c", False), (2, "b c", True), (3, "b c", False)],
        [(1, "a c", False)],
        [(1, "a c", False), (2, "a c", True)],
        [(1, "a\0 b", False), (2, "b b", True), (3, None, False)],
        [(i, "a c", i % 3 == 0) for i in range(40)] + [(50, "z q", True)],
    ],
)
@pytest.mark.parametrize("bucket", [4_000_000, 3])
def test_tables_of_few_pairs(spark, monkeypatch, tmp_path, data, bucket):
    """Buckets without a pair that was not seen, one row only, words with control characters."""
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket)
    spark.createDataFrame(data, "doc_id long, text string, held_out boolean").write.parquet(f"{tmp_path}/t")
    got = {r.doc_id: r for r in katz.fit_and_score(spark.read.parquet(f"{tmp_path}/t")).collect()}
    assert len(got) == len(data)
    model = Plain([tokens(t) for _, t, out in data if not out])
    for i, t, _ in data:
        x = tokens(t)
        base = sum(math.log10((model.c1[w] + 1) / (model.n + len(model.c1) + 1)) for w in x)
        assert (got[i].n_tokens, got[i].n_known) == (len(x), sum(model.c1[w] > 0 for w in x))
        assert (got[i].base_score, got[i].score) == pytest.approx((base, sum(math.log10(model.two(h, w)) for h, w in zip([START, *x], x))))


def bucket(rng, blobs, texts, rows, words):
    """Packed rows of one bucket as ``_pairs`` deals them; every third text is held out."""
    name = np.unique(rng.integers(0, 1 << 63, words, np.uint64))
    out = []
    for b in range(blobs):
        key = np.unique(rng.integers(0, len(name) ** 2 * texts, rows))
        codes = key // (len(name) * texts), key // texts % len(name), key % texts
        (w, iw), (h, ih), (d, id_) = (np.unique(c, return_inverse=True) for c in codes)
        times = rng.integers(1, 4, len(key))
        columns = [katz.pack_sorted(name[w]), katz.narrow(katz.pack_sorted(iw)), katz.pack_sorted(name[h]), katz.narrow(ih)]
        out.append(katz.pack(*columns, katz.pack_sorted((b << katz.TEXT_BITS) + d), (d % 3 == 0).astype(np.uint8), katz.narrow(id_), katz.narrow(times)))
    return out


def counted(packed):
    hot = np.array([katz.END])
    return katz._count([katz.unpack(memoryview(x)) for x in packed], hot, np.array([5]), 4)


def test_a_bucket_gives_the_same_in_small_parts(monkeypatch):
    packed = bucket(np.random.default_rng(3), 7, 40, 900, 60)

    def totals():
        out = {"text": Counter(), "history": Counter(), "unseen": Counter()}
        n = Counter()
        for kind, _, blob in counted(packed):
            n[kind] += 1
            if kind == "stats":
                out[kind] = np.frombuffer(blob, np.int64).tolist()
            elif kind == "unseen":
                out[kind].update(zip(*(c.tolist() for c in katz.unpack(blob)), strict=True))
            elif kind != "pairs":
                by, *columns = katz.unpack(blob)
                for i, c in enumerate(columns):
                    for k, v in zip(by.tolist(), c.tolist(), strict=True):
                        out[kind][k, i] += v
        return out, n

    whole, n = totals()
    monkeypatch.setattr(katz, "RANGE", 50)
    monkeypatch.setattr(katz, "FLUSH", 60)
    parts, more = totals()
    assert more["text"] > n["text"] and more["unseen"] > n["unseen"] and more["pairs"] > n["pairs"]
    assert parts.pop("text") == pytest.approx(whole.pop("text"))
    assert parts == whole

    # against plain counting
    c2, rows = Counter(), []
    for uw, iw, uh, ih, uid, out_of, id_, times in map(katz.unpack, packed):
        uw, iw, uh, uid = (np.cumsum(c) for c in (uw, iw.astype(int), uh, uid))
        rows += zip(uw[iw].tolist(), uh[ih].tolist(), uid[id_].tolist(), out_of[id_].tolist(), times.tolist(), strict=True)
    for w, h, _, out, t in rows:
        c2[w, h] += 0 if out else t
    c1 = Counter()
    for (w, _), c in c2.items():
        c1[w] += c
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    assert whole["unseen"] == Counter((signed(h), d, c1[w], t) for w, h, d, _, t in rows if not c2[w, h])
    seen = Counter()
    for w, h, d, _, t in rows:
        seen[d, min(c2[w, h], katz.K + 1)] += t
    got = {(k, i): v for (k, i), v in totals()[0]["text"].items() if i > 2 and v}
    assert got == {(d, c + 2): t for (d, c), t in seen.items() if c}


def test_runs_of_words_end_with_a_long_word():
    assert katz._word_ranges(np.array([10, 30, 500]), 50) == [0, 3]
    assert katz._word_ranges(np.array([60, 30, 500]), 50) == [0, 1, 3]
    assert katz._word_ranges(np.array([5]), 50) == [0, 1]


def test_a_bucket_takes_no_memory_for_all_of_its_texts_at_once(monkeypatch):
    """As in large tables, where a bucket's rows are nearly all of different texts."""
    monkeypatch.setattr(katz, "RANGE", 1 << 14)
    monkeypatch.setattr(katz, "FLUSH", 1 << 14, raising=False)
    packed = bucket(np.random.default_rng(4), 30, 1 << 20, 10_000, 2000)
    tracemalloc.start()
    try:
        rows = sum(kind == "text" for kind, *_ in counted(packed))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 4
    assert peak < 70 * 300_000


def test_runs_of_texts(monkeypatch):
    texts = ["B a", "", "a" * 50, "\u00c4 b", " ", "c d e"]
    monkeypatch.setattr(katz, "TEXT_BYTES", 9)
    batch = pa.RecordBatch.from_pydict({"text": ["never read", *texts]}).slice(1)
    got = [(first, np.diff(offset).tolist(), x) for first, x, offset in katz._tokens(batch)]
    assert [first for first, *_ in got] == [0, 2, 3, 5]
    assert [n for _, lengths, _ in got for n in lengths] == [len(t.split()) + 1 for t in texts]
    x = np.concatenate([x for *_, x in got])
    assert x[0] == x[[*katz._tokens(pa.RecordBatch.from_pydict({"text": ["b"]}))][0][1].size - 2] and (x == katz.END).sum() == len(texts)


def test_a_batch_of_texts_is_tokenized_in_little_memory():
    batch = pa.RecordBatch.from_pydict({"text": ["some words of a text " * 100] * 8000})
    tracemalloc.start()
    try:
        n = sum(len(x) for _, x, _ in katz._tokens(batch))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 8000 * 501
    assert peak < 25 << 20  # the texts are 16 MB
