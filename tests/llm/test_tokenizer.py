import base64
import random

import pytest

from cuemill.llm.tokenizer import DEFAULT_VOCABULARY, Encoder, encode_corpus

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


EDGES = [
    "", " ", "\n", "  \n\n  a  　b \x1c c\x85d", "it's we'll've 'tis 'S  x", "'s's's", "''ll", "x'", "x' 's", " 'll", "we'llll", "'ve'", "12 345½ ²", "!'s", "!!'s", " ' s", "<|endoftext|>", "aaa" * 3000, "日本語" * 400, "ab" * 700, "퟿\U0001f600é́", " " * 2000,
]


def test_edges(public):
    e = Encoder(DEFAULT_VOCABULARY)
    ids, off = e.encode(EDGES)
    for i, x in enumerate(EDGES):
        assert ids[off[i] : off[i + 1]].tolist() == public.encode_ordinary(x), x[:40]


def test_random_texts_and_a_cache_that_overflows(public):
    rng = random.Random(2)
    alphabet = "ab's  \n\tl'vedtmr1½é雨　!😀\x1c '"
    e = Encoder(DEFAULT_VOCABULARY, cache=200)
    for _ in range(20):
        xs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(150)]
        ids, off = e.encode(xs)
        assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(xs))] == [public.encode_ordinary(x) for x in xs]


def test_mergers_rank_behind_their_parts():
    """What merging all pairs of least rank at once in a long piece rests on."""
    e = Encoder(DEFAULT_VOCABULARY)
    used = e.pairs.keys >= 0
    left, right, to = e.pairs.keys[used] >> 20, e.pairs.keys[used] & ((1 << 20) - 1), e.pairs.values[used]
    byte = set(e.byte.tolist())
    bad = [(a, b, c) for a, b, c in zip(left.tolist(), right.tolist(), to.tolist()) if (a not in byte and a >= c) or (b not in byte and b >= c)]
    assert not bad


def test_table(spark, public):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Guten Tag", "x"), (3, "Guten Tag", "x"), (4, "b" * 100_000, "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got[:4] == [(1, []), (2, []), (3, public.encode_ordinary("Guten Tag")), (3, public.encode_ordinary("Guten Tag"))]
    assert public.decode(got[4][1]) == "b" * 100_000
    assert encode_corpus(df.limit(0)).collect() == []
    with pytest.raises(FileNotFoundError):
        encode_corpus(df, vocabulary="/nowhere")
