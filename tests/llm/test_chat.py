import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PIECES = st.sampled_from(["\\", "### User:", "### Assistant:", "### Role:", "</role>", "</turn>", "#", " ", "\n", "é🙂", "ok", "<", "/turn>"])
TEXTS = st.lists(PIECES, max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_escaping_is_undone_and_leaves_no_bare_control(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert all(len(m[1]) % 2 for m in chat.CONTROL.finditer(safe))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a </role> b"]), TEXTS), max_size=6))
def test_tokens_read_back(turns):
    codec = test_tokens_read_back.__dict__.setdefault("codec", chat.Codec.read(chat.VOCABULARY))
    tool = test_tokens_read_back.__dict__.setdefault("tool", codec.encoding())
    ids = lambda t: np.array(tool.encode_ordinary(chat.escape(t)), np.int32)
    tokens, mask = chat.assemble([(r, ids(r), ids(t)) for r, t in turns], codec.reserved)
    back = chat.read_back(tokens, mask, tool, codec.reserved)
    assert back.turns == turns and len(tokens) == len(mask)
    assert back.loss == "".join(t for r, t in turns if r == "assistant")


def test_formatted_table(spark):
    rows = [
        (1, 1, "assistant", "second"),
        (1, 0, "user", "first"),
        (1, 1, "assistant", "second"),
        (2, None, None, None),
        (2, 0, "assistant", ""),
        (None, 3, "tool", "</turn>"),
        (3, 0, "assistant", "x " * 50_000),
    ]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, name int, ids int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table.repartition(4))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nfirst\nassistant\nsecond\nassistant\nsecond\n")
    assert (got[1].loss_chars, got[1].loss_sha256, got[1].n_turns) == (12, sha("secondsecond"), 3)
    assert got[2].turns_sha256 == sha("\n\nassistant\n\n") and got[2].loss_chars == 0
    assert got[None].turns_sha256 == sha("tool\n</turn>\n")
    assert got[3].loss_chars == 100_000
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0
