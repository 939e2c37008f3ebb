"""What a Python worker loads and keeps."""

import re
from pathlib import Path

import pytest

from docloom.llm import packing
from docloom.llm.common import give_back


def held() -> int:
    """KB of this process."""
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1])


def test_workers_load_one_encoder(monkeypatch):
    """Before, each worker loaded the tokenizer beside the ranks, only to compare them."""
    from public_tokenizers import path

    probe = packing.probe_ids(path("byte_bpe_50k.json"))

    def loaded(*_):
        raise AssertionError("the tokenizer was loaded")

    monkeypatch.setattr(packing, "tokenizer_of", loaded)
    e = packing.IdEncoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), probe=probe)
    assert e.encode(["a b"]) and e.fast
    with pytest.raises(AssertionError, match="loaded"):  # other ids: the tokenizer is needed
        packing.IdEncoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), probe=(1, 2))


def test_free_memory_goes_back():
    blocks = [bytes(600) for _ in range(200_000)]
    last = blocks[-1]  # keeps the end of the heap in use
    full = held()
    del blocks
    give_back()
    assert held() < full - 60_000 and len(last) == 600
