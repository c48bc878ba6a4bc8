"""The tokenizer's ids against the tokenizers library and a greedy merge of one word at a time."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trellis.llm import tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.json"
TEXTS = [
    None, "", " ", "Hello world", "aaaaaaaaaaa bbbb ------ ======", "naïve café – 東京 🙂​ x", "a\r\n\r\n  b\t\tc  ", "<|endoftext|> it's WE'LL they're", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 50,
    "x" * 5000, "\x00\x85 　", "1234567890 ½ ² 3.14", "Hello world",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encode_matches_the_library(spark, reference):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {k: reference(t) for k, t in enumerate(TEXTS)} and got[0] == got[1] == []
    assert tokens.encode(df.limit(0)).count() == 0


def greedy(word: bytes, m: tokens.Merges) -> list[int]:
    ids = [int(m.byte_ids[b]) for b in word]
    while len(ids) > 1:
        ranks = m.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        k = int(ranks.argmin())
        if ranks[k] == tokens.NONE:
            break
        ids[k : k + 2] = [int(m.results[ranks[k]])]
    return ids


MERGES = tokens.Merges(PATH)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=30), st.text("aeinrst ", min_size=1, max_size=40).map(str.encode)), min_size=1, max_size=30))
def test_pair_index_matches_greedy_merging(words):
    offsets = np.r_[0, np.cumsum([len(w) for w in words])]
    ids, starts = tokens.encode_pieces(np.frombuffer(b"".join(words), np.uint8), offsets, MERGES)
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [greedy(w, MERGES) for w in words]
