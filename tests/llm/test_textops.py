"""Words of odd bytes: their hashes tell them apart as plain Python does."""

from itertools import product

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxlake.llm import quality, records, simhash, textops

ODD_TEXT = st.text(alphabet="\0\x01\x02ab \n\x7f\x1f\xa0é", max_size=60)
WHOLE = Tokenizer.from_file(PATH := public_tokenizers.path("word_bpe_49k.json"))


def test_words_that_differ_in_nul_bytes_differ():
    words = {bytes(w) for n in range(1, 5) for w in product(b"\0\x01\x02ab\xff", repeat=n)} | {b"the", b"the\0", b"uhe", b"\0the"}
    raw = sorted(words)
    assert len(np.unique(textops.words(raw).hashes())) == len(raw)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD_TEXT, min_size=1, max_size=4))
def test_hashes_equal_when_words_do(texts):
    w = textops.words([t.encode() for t in texts])
    plain = [x for t in texts for x in t.encode().translate(bytes(32 if textops.SPACES[i] else i for i in range(256))).split(b" ") if x]
    assert len(np.unique(w.hashes())) == len(set(plain)) and len(w.start) == len(plain)


@settings(max_examples=200, deadline=None)
@given(ODD_TEXT)
def test_counts_and_ids_of_odd_words(text):
    n5 = quality.measure([text.encode()], (5,))
    ws = [x for x in text.encode().translate(bytes(32 if textops.SPACES[i] else i for i in range(256))).split(b" ") if x]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    assert n5["dup_5gram_words"].tolist() == [len(covered)]
    ids, edge = records.encoder(PATH, "<u2").encode([records._lowered(text.encode())], 2)
    assert ids.tolist() == WHOLE.encode(text, add_special_tokens=False).ids + [2]
    low = [bytes(x).lower() for x in ws]
    distinct = {tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))}
    assert len(simhash.shingles([text], 5)[1]) == len(distinct)
