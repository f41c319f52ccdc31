"""What stays in a worker after a task."""

import pytest
from public_tokenizers import path

from loomwell.llm import byte_tokens, workers


def test_kept_tables_go_when_another_stage_begins():
    """A stage's tasks share its tables, and a function of another stage, which uses none, finds none left in its worker."""
    file = path("byte_bpe_50k.json")

    def encode(batches):
        for _ in batches:
            yield byte_tokens.coder(file).texts(["some words"])

    encoded = workers.lean(encode, uses_kept=True)
    (first,) = encoded(iter([0]))
    held = byte_tokens.coder(file)
    assert list(encoded(iter([0]))) == [first] and byte_tokens.coder(file) is held

    def other(batches):
        assert byte_tokens.coder.cache_info().currsize == 0
        yield from batches

    assert list(workers.lean(other)(iter([1, 2]))) == [1, 2]


def test_free_memory_is_given_back_after_errors_too(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append(1))

    def fails(batches):
        yield from batches
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        list(workers.lean(fails, uses_kept=True)(iter([1])))
    assert calls == [1]
