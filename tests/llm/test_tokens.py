from pathlib import Path

import pytest

from tabflow.llm import packing

if not Path(packing.TOKENIZER).is_file():
    pytest.skip("no tokenizer files", allow_module_level=True)


@pytest.mark.parametrize("text", ["日本語の文章です。" * 500, "plain prose before " * 50 + "QUJDREVG" * 600 + " and prose after it " * 200, "a" + " " * 5001 + "b c", "a\n" + "\t" * 4000, " " * 3000, "x　" * 50 + " " * 2500 + "é" + "\x1c" * 3000 + "z"])
def test_ids_are_the_tokenizers(text):
    assert packing.encode(text).tolist() == packing.encoding(packing.TOKENIZER).encode_ordinary(text)


def test_very_long_white_space():
    text = "a" + " " * 2_000_000 + "b"
    ids = packing.encode(text).tolist()
    assert packing.encoding(packing.TOKENIZER).decode(ids) == text
    assert ids[-1:] == packing.encoding(packing.TOKENIZER).encode_ordinary(" b")
