"""Packing ids against the tokenizers library, with the file's added tokens in the text."""

from __future__ import annotations

import pytest

from cohortline.llm import packing
from cohortline.llm.queries import VOCABULARY

END = "<|endoftext|>"
TEXTS = [
    f"a {END} b", END, END * 3, f"two  spaces {END}\n\n  end ", f"{END}{END[:-1]}", "no token, 'll é\t\t1", "", f"x{END}y <|end {END} of|>", f"  {END}  ",
]


@pytest.mark.parametrize("text", TEXTS)
def test_added_tokens_have_their_ids(text):
    tokenizers = pytest.importorskip("tokenizers")
    assert packing.encoder(VOCABULARY)(text) == tokenizers.Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
