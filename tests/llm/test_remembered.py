"""What the token encoder remembers: pieces that come again, not those seen once; ids stay those of whole texts."""

import pyarrow as pa
import pytest

from lattica.llm import tokens
from lattica.llm.queries import vocabulary


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_seen_once_are_dropped(name):
    e = tokens.Encoder(vocabulary(name))
    for k in range(4 * tokens.TRIED):
        text = " ".join(["again and again, once:", *(f"zq{k}x{i}" for i in range(500))])
        ((ids, ends),) = e.groups(pa.array([text]))
        assert ids[ends[0] : ends[1]].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(e.known) < 500 * (2 * tokens.TRIED) and "again" in {x.strip() for x in e.known.to_pylist()}
