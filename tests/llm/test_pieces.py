import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from barwright.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return pieces.Codec(file.read())


def plain(codec, texts):
    return [np.array(ids, "<u4").tobytes() for ids in codec.library.encode(texts, add_bos=True, add_eos=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab etion▁  \n\té漢ﬁ<s>0x.")), max_size=8))
def test_any_texts(codec, texts):
    assert codec.encode(texts) == plain(codec, texts)


def test_pieces_side_by_side(codec):
    """Sequences of pieces, so that most neighbours can be merged across; long stretches without spaces, which go on one by one."""
    rng, every = random.Random(3), list(codec.score)
    texts = ["".join(rng.choices(every, k=rng.randint(1, 7))).replace("▁", " ") for _ in range(4000)]
    texts += ["".join(rng.choices(every, k=300)).replace("▁", "") for _ in range(20)]
    texts += [" " * 3000, "ab" * 3000 + "x" * 1001, "e" * 2001, "漢字" * 500]
    assert codec.encode(texts) == plain(codec, texts)
    assert codec.encode(texts) == plain(codec, texts)  # now out of what is remembered


def test_pairs_that_stay_apart(codec):
    rng, every = random.Random(4), [i for i, p in codec.text_of.items() if len(p) > 1]
    alone = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for left, right in zip(rng.choices(every, k=3000), rng.choices(every, k=3000), strict=True):
        if codec._history(left) and codec._history(right) and codec.text_of[left].startswith("▁"):
            text = (codec.text_of[left] + codec.text_of[right]).replace("▁", " ")[1:]
            assert codec._apart(left, right) == (alone.encode(text) == [left, right])


def test_little_is_remembered(codec, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    texts = [f"word{k} other{k % 7}" for k in range(200)]
    assert codec.encode(texts) == plain(codec, texts) and len(codec.remembered) <= 400
    assert codec.encode(texts[:10]) == plain(codec, texts[:10]) and len(codec.remembered) <= 400


def test_query(spark, sf_dir, texts, codec):
    got = {r["doc_id"]: r for r in queries.op11_pieces(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for k, packed in zip(texts, plain(codec, list(texts.values())), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        back = hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
        assert tuple(got[k])[1:] == (len(ids), hashlib.sha256(packed).hexdigest(), back)


def test_odd_rows(spark, odd_docs, clashing, empty_docs, codec):
    rows = [r.asDict() for r in odd_docs.collect()]
    want = sorted(zip([str(r["doc_id"]) for r in rows], plain(codec, [r["text"] or "" for r in rows]), [r["text"] or "" for r in rows], strict=True))
    for df in (odd_docs, clashing):
        got = pieces.encode(df, PATH)
        assert sorted((str(r["id"]), bytes(r["ids"])) for r in got.collect()) == [w[:2] for w in want]
        assert sorted((str(r["id"]), r["text"]) for r in pieces.decode(got, PATH).collect()) == sorted((w[0], w[2]) for w in want)
    assert pieces.encode(empty_docs, PATH).count() == 0
    nulls = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert pieces.decode(nulls, PATH).first()["text"] is None
