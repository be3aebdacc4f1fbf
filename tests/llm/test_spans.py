import random

import pytest

from cuemill.llm.spans import shared_spans


def brute(docs, span):
    docs = sorted({(i, x) for i, x in docs if i is not None and x is not None}, key=str)
    seen = {}
    for i, x in docs:
        for k in range(len(x) - span + 1):
            seen.setdefault(x[k : k + span], set()).add(i)
    out = []
    for i, x in docs:
        cur = None
        for k in range(len(x) - span + 1):
            if len(seen[x[k : k + span]]) > 1:
                if cur and k <= cur[1]:
                    cur[1] = k + span
                else:
                    out += [(i, *cur)] if cur else []
                    cur = [k, k + span]
        out += [(i, *cur)] if cur else []
    return sorted(out)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, x, 1, "b") for i, x in docs], "doc_id bigint, text string, block int, body string")
    return sorted(map(tuple, shared_spans(df, **kw).collect()))


@pytest.mark.parametrize("alphabet, span, seed", [("ab", 20, 12), ("abcdefgh", 20, 8), ("日本語😀é", 16, 16), ("a", 24, 9)])
def test_random_texts(spark, alphabet, span, seed):
    rng = random.Random(alphabet + str(span))
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(span - 6, 3 * span))) for _ in range(12)]
    docs = []
    for i in range(70):
        x = "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5)))
        docs.append((i, x))
    docs += [(1000 + i, docs[i][1]) for i in range(8)]  # whole copies under other ids
    docs += docs[:5]  # rows delivered twice
    docs += [(2000, None), (2001, ""), (None, docs[0][1]), (2002, "z" * span * 3)]
    want = brute(docs, span)
    assert run(spark, docs, span=span, seed=seed) == want
    assert run(spark, docs, span=span, seed=seed, hot=3) == want  # many anchors hot
    assert run(spark, docs, span=span, seed=seed, hot=0) == want


def test_seed_doesnt_change_the_result(spark):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice(["the cat sat ", "on a mat ", "while rain fell "]) for _ in range(12))) for i in range(30)]
    assert run(spark, docs, span=40, seed=16) == run(spark, docs, span=40, seed=40) == brute(docs, 40)


def test_a_hot_group_of_copies_and_a_hot_passage(spark):
    passage = "".join(random.Random(5).choice("abcdefghij ") for _ in range(120))
    docs = [(i, "x" * 10 + passage) for i in range(200)] + [(1000 + i, f"{i:05}" + passage + f"{i:05}") for i in range(200)]
    assert run(spark, docs, span=80, seed=56) == brute(docs, 80)


def test_empty_and_short(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a" * 79), (2, "a" * 79)]) == []
    assert run(spark, [(1, "a" * 80), (2, "a" * 80), (3, "a" * 200)]) == [(1, 0, 80), (2, 0, 80), (3, 0, 200)]
    with pytest.raises(ValueError):
        run(spark, [], span=80, seed=81)


def test_long_text(spark):
    rng = random.Random(6)
    x = "".join(chr(rng.randrange(97, 123)) for _ in range(400_000))
    assert run(spark, [(1, x), (2, "0" + x[123_456:123_556] + "0")]) == [(1, 123_456, 123_556), (2, 1, 101)]
