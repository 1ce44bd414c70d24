"""Findings of round 3."""

import ctypes
import gc
import sys

import pytest

from relyframe.llm import sentencepiece_codec as codec
from relyframe.llm.text import trim


class Malloc(ctypes.Structure):
    _fields_ = [(name, ctypes.c_size_t) for name in ("arena", "ordblks", "smblks", "hblks", "hblkhd", "usmblks", "fsmblks", "uordblks", "fordblks", "keepcost")]


def held():
    """Bytes that the C library has given out and not got back, over all threads."""
    ask = ctypes.CDLL(None).mallinfo2
    ask.restype = Malloc
    found = ask()
    return found.uordblks + found.hblkhd


@pytest.mark.skipif(not sys.platform.startswith("linux") or not hasattr(ctypes.CDLL(None), "mallinfo2"), reason="needs glibc 2.33")
def test_a_codec_leaves_nothing_behind():
    with open(codec.MODEL, "rb") as f:
        data = f.read()

    def task(k):
        own = codec.Codec(data)
        texts = [" ".join(f"word{k}x{i * 50 + j}qu" for j in range(50)) for i in range(400)]
        ids = own.encode(texts)
        assert all(own.parity(texts, ids)) and [own.decode(i) for i in ids] == texts
        del own, ids, texts
        gc.collect()
        trim()
        return held()

    first = task(0)
    assert max(task(k) for k in (1, 2)) - first < 6 << 20
