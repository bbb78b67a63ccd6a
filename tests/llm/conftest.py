import pytest

pytest.importorskip("tallyrook.llm")
