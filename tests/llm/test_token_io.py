"""Token blocks: exact round trips, and ids equal to the tokenizer's own."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import token_io as t

PATH = public_tokenizers.path(t.VOCABULARY)


def whole(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, t.END_ID]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=9), max_size=9))
def test_pack_unpack(docs):
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    control, data = t.pack(np.array([x for d in docs for x in d], dtype=np.uint32), counts)
    assert t.unpack(b"".join(control), b"".join(data), counts).tolist() == [x for d in docs for x in d]
    assert [len(c) for c in control] == [(n + 3) // 4 for n in counts]


def test_pieces_equal_whole_texts():
    t.CACHED, old = 3, t.CACHED  # both generations turn over
    try:
        coder = t.PieceEncoder(PATH, t.END_ID)
        for text in ["", "Hello World's  end\n\nnew\tline", "café é ́x ΣΑΣ ς", "<|endoftext|> a<|startoftext|>b", "a b c 12345 #!?", "İstanbul ﬁ", " x " * 50, "Über, Straße. ÉTÉ! naïve; zoë\x27s it\x27s don\x27t: ß? ÿŸ a,b x.. the,the", "µ ª º ×÷ 1a b2, \u00a0x\x1cy"]:
            assert coder.encode(pa.array([text]))[0].tolist() == whole(text), text
    finally:
        t.CACHED = old


def test_round_trip(spark):
    texts = {5: "The cat sat.", 1: None, 3: "", 2: "été " * 30_000, 9: "The cat sat."}
    rows = [(i, x, 7) for i, x in texts.items()] + [(5, "other", 7), (None, "none", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = sorted(t.round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5, 9]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id in texts and r.doc_id != 5:
            ids = whole(texts[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert t.round_trip(docs.limit(0)).count() == 0
