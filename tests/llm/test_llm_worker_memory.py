"""What Python workers keep between stages, and how they count and write."""

import pyarrow as pa

from snipquarry.llm import common, toxicity


class _Rows:
    def mapInArrow(self, run, schema):
        return run


class _Stage:
    number = 1

    @staticmethod
    def get():
        return _Stage

    @staticmethod
    def stageId():
        return _Stage.number


def test_a_stage_that_keeps_nothing_lets_go(spark, monkeypatch):
    monkeypatch.setattr(common, "TaskContext", _Stage)
    batch = pa.RecordBatch.from_pydict({"x": pa.array([1], pa.int64())})
    keep = common.per_batch(_Rows(), lambda b: {"y": [len(common.worker_state("known", lambda: [1, 2]))]}, "y bigint")
    plain = common.per_batch(_Rows(), lambda b: {"y": [len(common.forget())]}, "y bigint")
    _Stage.number = 1
    assert [b.column("y").to_pylist() for b in keep([batch])] == [[2]]
    assert [b.column("y").to_pylist() for b in plain([batch])] == [[1]]
    _Stage.number = 2
    list(plain([]))
    _Stage.number = 1
    assert common.forget() == {}


def test_few_known_words(monkeypatch):
    texts = [f"word{i} word{i % 7} common".encode() for i in range(50)]
    want = [toxicity.buckets_of(w) for t in texts for w in t.split()]
    monkeypatch.setattr(toxicity, "KNOWN_BUCKETS", 5)
    known = toxicity._Buckets()
    assert [known[w] for t in texts for w in t.split()] == want and len(known) <= 5
