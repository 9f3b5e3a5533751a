"""What a Python worker holds after a task, as it stays beside later steps."""

import gc
import re
import weakref
from pathlib import Path

import pyarrow as pa


class Docs:
    """Takes the function that a frame is mapped by."""

    schema = None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def held() -> float:
    """MB of this process."""
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def after(run) -> float:
    """MB that are held after ``run`` over some 320 MB of texts beyond those before."""

    def batches():
        for k in range(4):
            yield pa.RecordBatch.from_pydict({"doc_id": list(range(20_000)), "text": [f"{i} {k} " * 400 for i in range(20_000)]})

    gc.collect()
    pa.default_memory_pool().release_unused()
    before = held()
    assert sum(b.num_rows for b in run(batches())) == 80_000
    return held() - before


def test_a_task_gives_its_memory_back(spark):
    from loomspark.llm.common import keep_rows, map_text

    assert after(keep_rows(Docs(), lambda texts: [True] * len(texts)).run) < 40
    assert after(map_text(Docs(), lambda ids, texts: {"doc_id": ids, "n": [len(t) for t in texts]}, "doc_id long, n long", "doc_id", "text").run) < 40


def test_what_a_task_knows_of_tokens_ends_with_it(monkeypatch):
    import numpy as np

    from loomspark.llm import toxicity

    class Model:
        value = np.zeros((28,) * 4, np.float32)

    made = []

    class Reader(toxicity.Reader):
        def __init__(self, *given):
            super().__init__(*given)
            made.append(weakref.ref(self))

    monkeypatch.setattr(toxicity, "Reader", Reader)
    monkeypatch.setattr(toxicity, "language_model", lambda docs: Model.value)
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels, model: {"bad$": 0.9})
    docs = Docs()
    docs.sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": staticmethod(lambda x: Model)})})
    run = toxicity.keep_clean(docs, None).run
    texts = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["all is well", "a bad word", None]})
    for _ in range(2):  # tasks
        assert [x for b in run(iter([texts])) for x in b.column(0).to_pylist()] == [1, 3]
        assert made and all(r() is None for r in made)
