"""The agenda against the library, on odd texts; digests of the query."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from panelweave.llm.sentencepiece_codec import Codec, encode_decode

ODD = ["", " ", "  a", "a  b ", "▁x", "\x00a", "<s>hi</s>", "a\tb\nc", "\n\n a\n", "日本語😀", "▁▁", "ﬁ é", "  ", "�", "a" * 3000, "the" * 500, "   " * 40 + "x", "x\n" * 50]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def test_ids_and_texts_equal_the_library(model):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abt he ▁\n\té😀日<s>0xyz.,") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    codec, library = Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for _ in range(2):  # the second time from what is kept
        got = codec.encode(texts)
        want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert codec.decode(got) == library.decode(want)


def test_one_agenda_equals_many(model):
    v = Codec(model).vocabulary
    units = ["▁the", "▁internationalization", "▁a", "▁zzzqqq", "▁éà", "▁日x", "x", "▁▁▁▁▁a"]
    assert [np.frombuffer(b, "<u4").tolist() for b in v.merge_all(units)] == [v.merge(u) for u in units]


def test_digests(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = [(i, t, "clash") for i, t in enumerate([*ODD, None])] + [(0, "again", "clash"), (0, "again", "clash"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(str, encode_decode(df, model).collect()))
    assert encode_decode(df, model).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(str(tuple(r)) for r in encode_decode(df, model).collect()) == sorted(map(str, want)) and len(got) == len(rows)
    kept = encode_decode(df, model, keep=("ids", "decoded")).filter("doc_id = 7").first()
    assert kept["decoded"] == "a\tb\nc" and kept["ids"][0] == 1 and kept["ids"][-1] == 2
    assert encode_decode(df.limit(0), model).count() == 0


def test_what_is_encoded_at_a_time_is_bounded(spark, model, monkeypatch):
    """Workers keep the memory of their largest block for all later stages."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run))
    encode_decode(docs, model)
    text = "some words " * 10_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(25)), "text": [text] * 25})
    rows = [made.num_rows for made in taken[0]([batch])]
    assert sum(rows) == 25 and max(rows) * len(text) <= (1 << 20) + len(text)
