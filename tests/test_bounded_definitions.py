"""Files are cut into definitions a few at a time."""

import pyarrow as pa

from snipquarry.operators import chunking


def test_definitions_of_a_few_files_at_a_time(monkeypatch):
    sources = pa.array(["def f():\n    pass", None, "x y", "class A:\n    def g(self): pass"] * 10)
    whole = chunking._definitions(sources)
    cut, sizes, array = chunking._cut, [], pa.array
    monkeypatch.setattr(chunking, "FILES", 3)
    monkeypatch.setattr(chunking.pa, "array", lambda rows, *a: sizes.append(len(rows)) or array(rows, *a))
    assert chunking._definitions(sources).equals(whole) and max(sizes) == 3
    assert whole.to_pylist()[3][1]["content"] == cut(sources[3].as_py())[1]["content"]
