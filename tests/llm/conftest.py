import pytest

pytest.importorskip("public_tokenizers")
