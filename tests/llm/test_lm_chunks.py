"""Texts of op4 are split once; later steps read codes, and sort numbers instead of places."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.llm import lm_scoring
from lacewing.llm._shared import id_remainder


def test_later_steps_read_codes_and_split_no_text(spark, messy_rows, monkeypatch):
    docs = spark.createDataFrame(messy_rows, "doc_id long, text string")
    rows = lm_scoring._chunks(docs.withColumn("held_out", id_remainder(F.col("doc_id")) == 1)).collect()

    def fail(*_):
        raise AssertionError("a text is split again")

    monkeypatch.setattr(lm_scoring, "split", fail)
    found = []
    for row in rows:
        t = lm_scoring._tokens(row)
        assert len(set(t.words)) == len(t.words) == t.end + 1
        for k, (a, n) in enumerate(zip(t.first.tolist(), t.n.tolist())):
            assert (t.train[a : a + n] == (not t.held[k])).all()
            found.append((int(t.ids[k]) if t.known[k] else None, tuple(t.words[c] for c in t.flat[a : a + n])))
    lower = lambda text: (text or "").encode().lower()
    want = [(i, (*re.findall(rb"[^\x20\x09-\x0d]+", lower(text)), b"")) for i, text in messy_rows]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(found, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("texts", [[b""], [b"", b""], [b"a"], [b"a b", b"", b" b a\x0b\x0c", b"\x0e\x1f\x08 \xc2\xa0"], [b" \n\t", b"x"]])
def test_split(texts):
    joined, n, flat = lm_scoring.split(np.array([len(t) + 1 for t in texts]), b"\n".join([*texts, b""]))
    words = joined.split(b" ")
    want = [[*re.findall(rb"[^\x20\x09-\x0d]+", t), b""] for t in texts]
    assert n.tolist() == [len(x) for x in want]
    assert [words[k] for k in flat] == [w for x in want for w in x]
    assert len(set(words)) == len(words) and words[-1] == b""


@pytest.mark.parametrize("bits", [1, 20, 44, 63])
def test_orders_and_places_of_keys(bits):
    rng = np.random.default_rng(bits)
    keys = rng.integers(0, 1 << bits, 5000, dtype=np.uint64)
    keys[:2000] = keys[2000:4000]
    train = rng.random(keys.size) < 0.7
    unique, back = np.unique(keys, return_inverse=True)
    assert (lm_scoring._order(keys) == np.argsort(keys, kind="stable")).all()
    assert lm_scoring._order(keys[:1]).tolist() == [0]
    size, at = lm_scoring._inverse(keys)
    assert size == unique.size and (at == back).all()
    found, counts = lm_scoring._counted(keys, train)
    assert (found == unique).all() and (counts == np.bincount(back[train], minlength=unique.size)).all()
