import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regionloom.llm import tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = ["", None, " \n\t", "It's fun, don't!!", "'s S. a's. b's*", "<|startoftext|>Hi <|STARTOFTEXT|>.", "Éa. ñ. İx é́ İ̇ K ﬁ Ǆ.", "a b c, d\x1ce\x85f g", "123. a1. 1a, ...", 'word-- (x) "y" -a- a-b a.b.', "x" * 5000 + " y" * 3000, "日本語 テスト。 हिन्दी"]


@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 70000) | st.just(0), max_size=700), st.sampled_from([1, 7, 64, 4096]))
@settings(max_examples=60, deadline=None)
def test_round_trip(values, block):
    ids = np.array(values, np.uint64)
    words, offsets, escapes = tokens.pack(ids, block)
    assert (tokens.unpack(words, escapes) == ids).all()
    at = 0
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        want = ids[k * block : (k + 1) * block]
        n = int((want >= (1 << 60) - 1).sum())
        assert (tokens.unpack(words[a:b], escapes[at : at + n]) == want).all()
        at += n


def test_zeros_are_dense():
    words, _, _ = tokens.pack(np.zeros(4096, np.uint64))
    assert len(words) <= 4096 // 240 + 4


def test_damage_is_seen():
    data = tokens.chunk_bytes([1], np.array([3]), np.array([5, 6, 7])) + b"\n"
    assert [x.tolist() for _, _, x in tokens.read_chunks(data)] == [[5, 6, 7]]
    with pytest.raises(ValueError):
        list(tokens.read_chunks(b"x" * 80))


@pytest.mark.parametrize("pieces", [True, False])
def test_files_hold_what_the_tokenizer_gives(spark, tmp_path, pieces):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    rows = [(i * 3, t, "a", "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "b", "x"), (3, "again", "c", "x"), (3, "again", "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens string").repartition(3)
    tokens.encode_files(docs, str(tmp_path / "t"), PATH, pieces=pieces)
    got = tokens.digest(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    assert len(got) == len(want)
    for r, (doc_id, text, *_) in zip(got, want, strict=True):
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    ids = {tuple(r.ids) for r in tokens.read_files(spark, str(tmp_path / "t")).collect()}
    assert (1,) in ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_and_digest(docs, PATH).count() == 0
