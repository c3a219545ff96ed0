"""Quality rules by repetition coverage: the share of a text's characters inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import textops

#: Largest share, in percent, of a text's word characters inside n-grams that occur twice
#: or more, by n, and inside lines equal to an earlier line.
NGRAM_LIMITS = {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20}
LINE_LIMIT = 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
ROLL = np.uint64(0xA24BAED4963EE407 | 1)


def measure(raw: list[bytes], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text of one chunk; ``lengths`` ascend."""
    w = textops.words(raw)
    h, doc, off = w.hashes(), w.doc(), w.offset
    cp = textops.code_points(w.buf)
    chars = cp[w.end] - cp[w.start]
    out = {"n_words": np.diff(off), "word_chars": textops.sums(chars, off)}
    out["n_symbols"] = textops.sums(SYMBOLS[w.buf], w.bounds)

    stop = np.flatnonzero(w.buf[1:] == 10) + 1  # each line's end; the first byte is a line end of its own
    begin = np.concatenate([[1], stop[:-1] + 1])
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    begin, stop, a, b = begin[b > a], stop[b > a], a[b > a], b[b > a]
    owner = np.searchsorted(w.bounds, begin, side="right") - 1
    _, again = textops.repeated(textops.mix(w.hashes(begin, stop) + owner.astype(np.uint64) * ROLL))
    out["n_dup_lines"] = np.bincount(owner[again], minlength=len(raw)).astype(np.int64)
    at = np.zeros(len(h) + 1, np.int64)
    np.cumsum(chars, out=at[1:])
    out["dup_line_chars"] = np.bincount(owner[again], (at[b] - at[a])[again], minlength=len(raw)).astype(np.int64)

    salt = doc.astype(np.uint64) * ROLL
    left = np.arange(len(h))
    rolled = np.zeros(len(h), np.uint64)
    done = 0
    for n in lengths:
        left_ok = left + n <= off[doc[left] + 1] if len(left) else np.zeros(0, bool)
        left, rolled = left[left_ok], rolled[left_ok]
        for j in range(done, n):
            rolled = rolled * ROLL + h[left + j]
        done = n
        twice, _ = textops.repeated(textops.mix(rolled + salt[left]))
        left, rolled = left[twice], rolled[twice]  # a longer repeat begins with a shorter one
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, left, 1)
        np.add.at(cover, left + n, -1)
        inside = np.cumsum(cover)[:-1] > 0
        out[f"dup_{n}gram_words"] = textops.sums(inside, off)
        out[f"dup_{n}gram_chars"] = textops.sums(chars * inside, off)
    return out


def repetition(docs: DataFrame, text_col: str = "text", ngram_limits: dict[int, int] = NGRAM_LIMITS, line_limit: int = LINE_LIMIT) -> DataFrame:
    """Every row of ``docs`` with one more column, the struct ``repetition``: counts, shares and verdicts.

    Rolling hashes of n consecutive words, for each n of ``ngram_limits`` (5 is always measured), are
    compared within the text; a repeat counts from its first occurrence on. ``base_failed``: fewer than
    10 words, or over 20 % of the words in repeated 5-grams. ``kept``: not that, and no share above its limit.

    Null and empty texts have no words and fail. Texts are read whole. Repeated rows get equal results
    each; an empty table gives none. A column named ``repetition`` that was there before is replaced.
    """
    limits = dict(sorted({5: 100, **ngram_limits}.items()))
    lengths = tuple(limits)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", *(f"dup_{n}gram_{k}" for n in lengths for k in ("words", "chars"))]

    @F.pandas_udf(", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, score double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [measure(raw, lengths) for _, raw in textops.chunks(texts.tolist())]
            out = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in counts}
            total = out["word_chars"]
            out["base_failed"] = (out["n_words"] < 10) | (100 * out["dup_5gram_words"] > 20 * out["n_words"])
            good = 100 * out["dup_line_chars"] <= line_limit * total
            worst = out["dup_line_chars"]
            for n, most in limits.items():
                good &= 100 * out[f"dup_{n}gram_chars"] <= most * total
                worst = np.maximum(worst, out[f"dup_{n}gram_chars"])
            out["kept"] = good & ~out["base_failed"]
            out["score"] = 1 - worst / np.maximum(total, 1)
            yield pd.DataFrame(out)

    return docs.withColumn("repetition", measured(F.col(text_col)))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = repetition(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    dup = [f"repetition.dup_{n}gram_chars" for n in NGRAM_LIMITS]
    return r.select("doc_id", *(f"repetition.{c}" for c in names), F.col("repetition.dup_5gram_words").alias("n_repeat_words"), "repetition.base_failed", "repetition.kept", "repetition.dup_line_chars", *dup)


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their own columns.

    Null, empty and short texts fail and go; repeated rows stay or go together; texts at a limit stay. An empty table gives none. Other columns do not matter.
    """
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("own_text"))
    return repetition(held, "own_text").where("repetition.kept").select("row.*")


OP9_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
led AS (SELECT *, {", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, max(NGRAM_LIMITS)))} FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS ({" UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, concat_ws(' ', w, {', '.join(f'w{k}' for k in range(1, n))}) AS g FROM led WHERE w{n - 1} IS NOT NULL" for n in NGRAM_LIMITS)}),
twice AS (SELECT doc_id, n, g FROM grams GROUP BY ALL HAVING count(*) > 1),
hits AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM grams JOIN twice USING (doc_id, n, g)),
cover AS (SELECT h.doc_id, n, count(*) AS cw, sum(length(w)) AS cc FROM hits h JOIN tok t ON t.doc_id = h.doc_id AND t.i = h.p GROUP BY ALL),
wide AS (SELECT doc_id, max(cw) FILTER (n = 5) AS r5, {", ".join(f"max(cc) FILTER (n = {n}) AS c{n}" for n in NGRAM_LIMITS)} FROM cover GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dl AS (SELECT doc_id, line, count(*) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
d AS (SELECT doc_id, sum(k - 1) AS n, sum((k - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS c FROM dl GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines,
  coalesce(r5, 0) AS n_repeat_words, CAST(coalesce(d.c, 0) AS BIGINT) AS dup_line_chars, {", ".join(f"CAST(coalesce(c{n}, 0) AS BIGINT) AS dup_{n}gram_chars" for n in NGRAM_LIMITS)}
  FROM w LEFT JOIN wide USING (doc_id) LEFT JOIN d USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND {" AND ".join(f"100 * dup_{n}gram_chars <= {p} * word_chars" for n, p in NGRAM_LIMITS.items())} AS kept FROM b
"""
