"""What Python workers keep: they live on for the next stage, several on an executor."""

import numpy as np
import pyarrow as pa
import pytest

from lociq.llm import packing, text, wu_manber
from lociq.llm.queries import WORD_BPE


@pytest.fixture
def task(spark, monkeypatch):
    """The function that a plan gives to its tasks."""
    given, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a: (given.append(f), plain(self, f, *a))[1])
    return given


def test_powers_are_as_long_as_needed(monkeypatch):
    monkeypatch.setattr(text, "_powers", {b: np.ones(1, np.uint64) for b in (text._BASE, text.INVERSE)})
    for n in (1, 2, 1000, 700, 1500):
        for base in (text._BASE, text.INVERSE):
            assert text.powers(n, base).tolist() == [pow(base, k, 1 << 64) for k in range(n)]
    assert max(map(len, text._powers.values())) <= 3000


def test_texts_are_encoded_a_few_at_a_time(spark, task, monkeypatch):
    texts = ["word and other words " * 5_000] * 12
    sizes, back = [], []
    whole = packing.encoder(WORD_BPE, True).column
    monkeypatch.setattr(packing, "encoder", lambda *_: type("Watched", (), {"column": staticmethod(lambda c: (sizes.append(c.nbytes), whole(c))[1])}))
    monkeypatch.setattr(packing, "release", lambda: back.append(1))
    packing.pieces(spark.createDataFrame([(0, "")], "doc_id long, text string"), WORD_BPE)
    batch = pa.RecordBatch.from_pydict({"id": list(range(12)), "text": texts})
    made = pa.Table.from_batches(task[0](iter([batch, batch.slice(0, 2)])))
    assert max(sizes) < 400_000 and len(back) == 2
    one, first = whole(pa.array(texts[:1]))
    assert sum(made.column("length").to_pylist()) == 14 * (len(one) + 1) and first.tolist() == [0, len(one)]


def test_searches_hand_memory_back(spark, task, monkeypatch):
    back = []
    monkeypatch.setattr(wu_manber, "release", lambda: back.append(1))
    docs = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    wu_manber.occurrences(docs, spark.createDataFrame([(7, "b")], "item_id long, text string"))
    batch = pa.RecordBatch.from_pydict({"id": [0, 1], "text": ["a b", None], "row": [0, 0]})
    made = pa.Table.from_batches(task[0](iter([batch, batch])))
    assert made.column("items").to_pylist() == [[7], [], [7], []] and len(back) == 2
