"""Texts are cut into tokens a few at a time."""

import pyarrow as pa

from snipquarry.operators import inference


def test_tokens_of_a_few_texts_at_a_time(monkeypatch):
    texts = pa.array(["a b " * 50, None, "", "c", "d " * 300, "a"] * 20, pa.string())
    whole, split, seen = inference._token_counts(8)(texts), inference.pc.utf8_split_whitespace, []
    monkeypatch.setattr(inference.pc, "utf8_split_whitespace", lambda t: seen.append(t.nbytes) or split(t))
    assert (inference._token_counts(8, slice_bytes=500)(texts) == whole).all()
    assert len(seen) >= 20 and [s for s, _ in inference._slices(texts, 500)][-1] < len(texts)
