"""Python steps give their workers' memory back, at the end and after an error."""

import pyarrow as pa
import pytest

from answerframe.llm import common


def test_lean_gives_memory_back(monkeypatch):
    trims = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(trims.append)}))
    assert list(common.lean(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4] and trims == [0]

    def fails(batches):
        yield from batches
        raise ValueError("x")

    with pytest.raises(ValueError):
        list(common.lean(fails)([pa.array([1])]))
    assert trims == [0, 0]
