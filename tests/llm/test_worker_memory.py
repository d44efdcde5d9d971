import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tripleloom.llm import common, packing  # noqa: E402


def test_workers_drop_the_memo_of_another_operator():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        packing._worker_memo(file.read(), 0)
    common.release("packing")
    assert packing._MEMOS
    common.release()
    assert not packing._MEMOS
