"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

A protected entity is a matched value (an address, a number). Over the distinct texts of the corpus, co-occurrence of
entities with the terms of the same text estimates the pointwise mutual information of a term t with an entity c,
PMI = log2(p(c, t) / (p(c) p(t))), against the entity's own information, IC = -log2 p(c). A term whose
PMI is at least ``alpha`` of the IC discloses the entity: wherever it stands, in any text, it is replaced by its shape class where the class does not
disclose the entity itself, and removed otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxlake.llm import filters, textops
from voxlake.llm.sharding import sent_whole
from voxlake.storage import cut

#: Parts of the base patterns. Kinds stand in the order in which spans are listed. The patterns are
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+ and phone \+[0-9][\x20().0-9-]+[0-9], leftmost and not overlapping; these parts find the same in linear time.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Classes of term shapes: what a disclosing term is generalised to. A term has a digit, or else begins with A-Z or a capital of Latin-1, or else neither.
SHAPES = ("<NUMBER>", "<NAME>", "<WORD>")
#: Disclosing terms that may be broadcast, and the places of each beyond.
SENT_TERMS, SALTS = 200_000, 16
TERM_SPANS = "array<struct<action: string, start: int, end: int, shape: string>>"
BASE_SPANS = "array<struct<kind: string, start: int, end: int>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses: from each @, the run of local characters before it, not further than the last match, and the domain after it."""
    end = at = 0
    for piece in text.split("@")[:-1]:
        begin, at = at, at + len(piece)
        # an address may begin within the last one's run of characters, but not before its end
        run = len(LOCAL.match(piece[max(0, end - begin) :][::-1])[0])
        domain = DOMAIN.match(text, at + 1)
        if run and domain:
            end = domain.end()
            yield at - run, end
        at += 1


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of four parts of digits, from the left in each run of parts."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i : i + 4])) + 3
                yield at, at + size
                at += size + 1


def _ip(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def _card(s: str) -> bool:
    digits = [ord(c) - 48 for c in s if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[::-2]) + doubled) % 10 == 0


def _phone(s: str) -> bool:
    return 9 <= sum(c.isdigit() for c in s) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches that pass their check, by kind, then start; positions in code points, the end exclusive."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out += [("ip", s, e) for s, e in addresses(text) if _ip(text[s:e])]
        out += [("card", *m.span()) for m in CARD.finditer(text) if _card(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if _phone(m[0])]
    return out


def _hashes(terms: list[str]) -> np.ndarray:
    """The words' hashes, as in ``textops``, as signed 64-bit integers."""
    return textops.words([t.encode() for t in terms]).hashes().view(np.int64) if terms else np.zeros(0, np.int64)


CLASS_HASHES = _hashes([*SHAPES])


def terms_of(raw: list[bytes]) -> textops.Words:
    """Terms: runs of ASCII letters and digits and of non-ASCII characters."""
    return textops.words(raw, textops.NOT_ALNUM)


def shapes_of(w: textops.Words) -> np.ndarray:
    """The position in SHAPES of each term's class."""
    digits = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum((w.buf >= 0x30) & (w.buf <= 0x39), out=digits[1:])
    first, second = w.buf[w.start], w.buf[w.start + 1]
    upper = (first >= 0x41) & (first <= 0x5A) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    return np.where(digits[w.end] > digits[w.start], 0, np.where(upper, 1, 2))


def find_base(keyed: DataFrame) -> DataFrame:
    """(k0, k1, h0, h1, spans, entities, terms) of each text that has a base span. Entities: hashes of kind and value. Terms: hashes of the distinct
    terms that touch no span, each with the hash of its class; the classes are listed as terms of themselves."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k0, k1, h0, h1, text in zip(*(pdf[c] for c in ("k0", "k1", "h0", "h1", "text")), strict=True):
                spans = base_spans(text)
                if not spans:
                    continue
                entity = np.unique(_hashes([k + re.sub(r"[\x20\x09-\x0D]", "_", text[s:e]) for k, s, e in spans]))
                w = terms_of([text.encode()])
                place = np.append(np.flatnonzero((w.buf[1:-1] & 0xC0) != 0x80) + 1, len(w.buf) - 1)  # the byte of each code point
                inside = np.zeros(len(w.buf) + 1, np.int64)
                for _, s, e in spans:
                    inside[place[s]] += 1
                    inside[place[e]] -= 1
                covered = np.append(0, np.cumsum(np.cumsum(inside) > 0))
                free = covered[w.end] == covered[w.start]
                term, at = np.unique(w.hashes()[free].view(np.int64), return_index=True)
                kind = CLASS_HASHES[shapes_of(w)[free][at]]
                own = np.unique(kind)
                listed = [*zip(term.tolist(), kind.tolist(), strict=True), *zip(own.tolist(), own.tolist(), strict=True)]
                rows.append((k0, k1, h0, h1, [dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans], entity.tolist(), [{"term": t, "class": c} for t, c in listed]))
            yield pd.DataFrame(rows, columns=["k0", "k1", "h0", "h1", "spans", "entities", "terms"])

    schema = f"k0 long, k1 long, h0 long, h1 long, spans {BASE_SPANS}, entities array<long>, terms array<struct<term: long, class: long>>"
    return keyed.select("k0", "k1", "h0", "h1", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(find, schema)


def text_counts(keyed: DataFrame, wanted: np.ndarray, several: np.ndarray) -> DataFrame:
    """(term, n): in how many distinct texts each term and class occurs, of those that bitmap ``wanted`` lets pass.

    Texts are counted within batches first; only those that may have copies, by bitmap ``several`` of their hashes, are listed with their terms.
    """
    spark = keyed.sparkSession
    sent = spark.sparkContext.broadcast((wanted, several))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, several = sent.value
        for pdf in batches:
            h0, h1 = pdf["h0"].to_numpy(), pdf["h1"].to_numpy()
            again = filters.may_hold(several, h0)
            for first, raw in textops.chunks(pdf["text"].tolist()):
                w = terms_of(raw)
                h, doc = w.hashes(), w.doc()
                term = np.concatenate([h.view(np.int64), CLASS_HASHES[shapes_of(w)]])
                doc = np.concatenate([doc, doc])
                keep = filters.may_hold(wanted, term)
                term, doc = term[keep], doc[keep]
                order = np.lexsort((doc, term))
                term, doc = term[order], doc[order]
                once = np.ones(len(term), bool)
                once[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                term, doc = term[once], doc[once] + first
                alone = ~again[doc]
                u, n = np.unique(term[alone], return_counts=True)
                yield pd.DataFrame({"term": u, "h0": np.int64(0), "h1": np.int64(0), "n": n})
                yield pd.DataFrame({"term": term[~alone], "h0": h0[doc[~alone]], "h1": h1[doc[~alone]], "n": -1})

    found = keyed.select("h0", "h1", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "term long, h0 long, h1 long, n long")
    # a listed text counts once
    per = found.groupBy("term", "h0", "h1").agg(F.when(F.min("n") < 0, 1).otherwise(F.sum("n")).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(found: DataFrame, keyed: DataFrame, alpha: float, support: int) -> DataFrame:
    """(term, general): terms that disclose an entity; general: whether their shape class discloses none of these entities.

    Counts are numbers of distinct texts. An entity and a term need ``support`` texts in common. Entities are told apart by the sets of their texts only (by 128 bits of hash), so a text
    with many of them gives as many pairs as it has different sets, times its terms.
    """
    hashes = cut(keyed.groupBy("h0", "h1").agg(F.count("*").alias("n")))
    n_texts = hashes.count()
    once = found.groupBy("h0", "h1").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    once = cut(once)
    holds = once.select("h0", "h1", F.explode("entities").alias("entity"))
    # entities of the same texts, as those of a list and its near copies, disclose and are disclosed alike: one of them stands for all
    entity = holds.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor("h0").alias("s0"), F.bit_xor("h1").alias("s1")).where(F.col("n_entity") >= support)
    entity = cut(entity.groupBy("s0", "s1", "n_entity").agg(F.min("entity").alias("entity")).select("entity", "n_entity"))
    told_of = holds.join(sent_whole(entity.select("entity"), entity.count()), "entity").groupBy("h0", "h1").agg(F.collect_list("entity").alias("known"))
    pairs = once.select("h0", "h1", "terms").join(told_of, ["h0", "h1"]).select("terms", F.explode("known").alias("entity")).select("entity", F.inline("terms"))
    both = pairs.groupBy("entity", "term", "class").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    # PMI >= alpha IC bounds the term's own count from above; the texts with spans that hold it bound it from below, and rule out most terms
    most = F.col("n_both") * F.pow(F.lit(float(n_texts)) / F.col("n_entity"), F.lit(1 - alpha)) * (1 + 1e-9)
    least = once.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n_held"))
    both = cut(both.join(entity, "entity").join(least, "term").where(F.col("n_held") <= most).drop("n_held"))
    counts = text_counts(keyed, filters.bitmap(both.select("term"), "term"), filters.bitmap(hashes.where("n > 1"), "h0"))
    info = F.log2(F.lit(float(n_texts)) / F.col("n_entity"))
    share = F.log2(F.col("n_both") * F.lit(float(n_texts)) / (F.col("n_entity") * F.col("n")))
    told = cut(both.join(counts, "term").where((info > 0) & (share >= alpha * info)).select("entity", "term", "class"))
    classes = told.where(F.col("term") == F.col("class")).select("entity", "class", F.lit(False).alias("general"))
    terms = told.where(F.col("term") != F.col("class")).join(classes, ["entity", "class"], "left")
    return cut(terms.groupBy("term").agg(F.min(F.coalesce("general", F.lit(True))).alias("general")))


def term_hits(keyed: DataFrame, told: DataFrame) -> DataFrame:
    """(k0, k1, term_spans): every occurrence of a disclosing term in every text."""
    sent = keyed.sparkSession.sparkContext.broadcast(filters.bitmap(told, "term"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k0, k1 = pdf["k0"].to_numpy(), pdf["k1"].to_numpy()
            for first, raw in textops.chunks(pdf["text"].tolist()):
                w = terms_of(raw)
                h = w.hashes()
                at = np.flatnonzero(filters.may_hold(sent.value, h))
                doc = np.searchsorted(w.offset, at, side="right") - 1
                cp = textops.code_points(w.buf)
                begin = cp[w.bounds[doc]]
                shape = shapes_of(w)[at]
                yield pd.DataFrame({"k0": k0[doc + first], "k1": k1[doc + first], "term": h[at].view(np.int64), "start": cp[w.start[at]] - begin, "end": cp[w.end[at]] - begin, "shape": shape})

    found = keyed.select("k0", "k1", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(find, "k0 long, k1 long, term long, start int, end int, shape int")
    n = told.count()
    if n > SENT_TERMS:  # a term may be frequent: its occurrences are dealt to SALTS places
        told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.withColumn("salt", F.pmod(F.xxhash64("k0", "start"), F.lit(SALTS)).cast("int"))
    hits = found.join(F.broadcast(told) if n <= SENT_TERMS else told, ["term", "salt"] if n > SENT_TERMS else "term")
    term = F.struct(F.when(F.col("general"), "generalise").otherwise("remove").alias("action"), "start", "end", F.element_at(F.array(*map(F.lit, SHAPES)), F.col("shape") + 1).alias("shape"))
    by_start = F.sort_array(F.collect_set(F.struct("start", term.alias("t"))))
    return hits.groupBy("k0", "k1").agg(F.transform(by_start, lambda x: x["t"]).alias("term_spans"))


@F.pandas_udf(StringType())
def cleaned(texts: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
    done = []
    for text, b, t in zip(texts, base, terms, strict=True):
        cuts = sorted([(x["start"], x["end"], f"<{x['kind'].upper()}>") for x in b] + [(x["start"], x["end"], x["shape"] if x["action"] == "generalise" else "") for x in t])
        parts, at = [], 0
        for s, e, new in cuts:
            if s >= at:
                parts += [text[at:s], new]
            at = max(at, e)
        done.append("".join(parts) + text[at:])
    return pd.Series(done, dtype=object)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.95, support: int = 2) -> DataFrame:
    """Every row of ``docs`` with ``base_spans``, ``term_spans`` and ``clean_text``.

    ``term_spans``: array of (action, start, end, shape) for all occurrences, in any text, of terms that disclose an entity and touch no
    base span; the action is ``generalise`` or ``remove``. ``clean_text``: the text with base spans
    replaced by their kind in angle brackets, generalised terms by their shape class, and removed terms left out.

    Co-occurrence is counted over whole distinct texts, so copies of a text are no evidence. An entity of a single text gives none either: every rare term
    of that text would seem to disclose it. So terms are learnt for entities of ``support`` texts at least, and base spans are replaced always.

    Null texts are empty and stay null in ``clean_text``. Rows that are equal in id and text get equal results
    each, and count as one text; null ids are ids. Texts are read whole; positions are code points. An empty table gives none.
    Columns named as the new ones are replaced; other columns do not matter.
    """
    docs = docs.drop("base_spans", "term_spans", "clean_text")
    others = [c for c in docs.columns if c != text_col]
    ids = {f"k{i}": F.xxhash64(F.lit(i), F.col(id_col), F.col(text_col)) for i in (0, 1)} | {f"h{i}": F.xxhash64(F.lit(i), F.col(text_col)) for i in (0, 1)}
    keyed = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in ids.items()))
    found = cut(find_base(keyed))
    told = disclosures(found, keyed.select("text", "h0", "h1"), alpha, support)
    base = found.select("k0", "k1", F.col("spans").alias("base_spans")).dropDuplicates(["k0", "k1"])
    empty = {"base_spans": F.expr(f"cast(array() as {BASE_SPANS})"), "term_spans": F.expr(f"cast(array() as {TERM_SPANS})")}
    per = base.join(term_hits(keyed, told), ["k0", "k1"], "full").withColumns({c: F.coalesce(F.col(c), e) for c, e in empty.items()})
    touches = lambda t: F.exists("base_spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    per = cut(per.withColumn("term_spans", F.filter("term_spans", lambda t: ~touches(t))))
    # texts without spans go past the exchange
    marked = keyed.withColumn("maybe", filters.tester(per, "k0")(F.col("k0")))
    held = marked.where("maybe").join(per, ["k0", "k1"], "left").withColumns({c: F.coalesce(F.col(c), e) for c, e in empty.items()})
    some = (F.size("base_spans") > 0) | (F.size("term_spans") > 0)
    held = held.withColumn("clean_text", F.when(some, cleaned("text", "base_spans", "term_spans")).otherwise(F.col("text")))
    plain = marked.where("not maybe").withColumns(empty).withColumn("clean_text", F.col("text"))
    names = [*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns), "base_spans", "term_spans", "clean_text"]
    return held.select(names).union(plain.select(names))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    r = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = lambda c, kind: F.transform(c, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"]))
    base = listed("base_spans", lambda x: x["kind"])
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.concat(base, listed("term_spans", lambda x: x["action"]))
    return r.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"), F.size("term_spans").cast("long").alias("n_terms"), F.sha2(F.col("clean_text"), 256).alias("clean_sha256"))
