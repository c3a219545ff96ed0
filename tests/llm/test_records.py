import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm import records
from voxlake.storage import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = ["It's fine.", "<|endoftext|>.", "<|ENDOFTEXT|>", "a\x7fb c", "\x7f", "é. È, ñ!", "don't.", "x)).", "1,2. 3", "ﬁ².", "÷. ×,"]


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(ODD)), max_size=6).map(" ".join), min_size=1, max_size=3))
def test_words_encode_as_the_whole_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, edge = records.encoder(PATH, "<u2").encode([records._lowered(t.encode()) for t in texts], 2)
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [ids_of(t) for t in texts]


def test_frames_round_trip_and_notice_damage():
    buf = records.frame(b"abc") + records.frame(b"")
    first, at = records.unframe(buf, 0)
    second, end = records.unframe(buf, at)
    assert (first, second, end) == (b"abc", b"", len(buf))
    with pytest.raises(ValueError):
        records.unframe(buf[:13] + b"x" + buf[14:], 0)


BIG = 2**53 + 1
ROWS = [(None, "no id"), (BIG, "one"), (BIG, None), (BIG - 1, ""), (3, "Same, text."), (3, "Same, text."), (5, "long word " * 60000), (None, None), *((i, f"text {i} <|endoftext|> naïve!") for i in range(10, 60))]


@pytest.mark.parametrize("files", [None, 5])
def test_odd_rows_are_records_once(spark, files):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", F.lit("x").alias("offset"), F.lit("x").alias("file"))
    out = new_path(spark, "records")
    index = records.write_records(docs, out, PATH, files=files)
    rows = sorted(index.collect(), key=lambda r: (r.file, r.number))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    wanted = [(i, ids_of(t)) for i, t in sorted(ROWS, key=key)]
    assert [(r.doc, r.n_tokens) for r in rows] == [(i, len(t)) for i, t in wanted]
    read = sorted(records.read_records(spark, index, out, run_bytes=100).collect(), key=lambda r: (r.file, r.number))
    assert [(r.file, r.number, r.n_tokens, r.ids_crc32) for r in read] == [(r.file, r.number, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for r, (_, t) in zip(rows, wanted, strict=True)]
    orders = []
    for seed in (1, 2, 1):
        got = [(r.doc, list(r.ids)) for r in records.read_shuffled(spark, index, out, seed).collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)
        orders.append(got)
    assert orders[0] == orders[2] and orders[0] != orders[1] and orders[0] != wanted


def test_empty_table(spark):
    docs, out = spark.createDataFrame([], "doc_id long, text string"), new_path(spark, "records")
    index = records.write_records(docs, out, PATH)
    assert index.count() == records.read_records(spark, index, out).count() == records.read_shuffled(spark, index, out, 1).count() == 0


def test_shuffled_read_notices_damage(spark):
    out = new_path(spark, "records")
    index = records.write_records(spark.createDataFrame(ROWS[1:2], "doc_id long, text string"), out, PATH)
    path = out.removeprefix("file://") + "/part-00000.rec"
    with open(path, "r+b") as f:
        f.seek(records.HEAD)
        f.write(b"\xff")
    with pytest.raises(Exception, match="bad payload"):
        records.read_shuffled(spark, index, out, 1).collect()
