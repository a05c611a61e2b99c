import pytest

pytest.importorskip("attestra.llm")
