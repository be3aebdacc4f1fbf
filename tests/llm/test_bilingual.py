import random

import numpy as np
import pytest

from cuemill.llm.bilingual import Originals, aligned_lines, clauses, lines_of, romanise, skeleton, tokens, train

RNG = random.Random(21)
N = 140
LEFT = ["".join(RNG.choice("bdfgklmnprstvz") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 4))) for _ in range(N)]
RIGHT = ["".join(RNG.choice("aeiouy") + RNG.choice("bcdfghjklmnpqrst") for _ in range(RNG.randint(2, 4))) for _ in range(N)]


def sentence(n=7):
    ws = [RNG.randrange(N) for _ in range(n)]
    number = [str(RNG.randrange(100))] if RNG.random() < 0.3 else []
    swapped = ws[:]
    k = RNG.randrange(len(ws) - 1)
    swapped[k], swapped[k + 1] = swapped[k + 1], swapped[k]
    return " ".join([LEFT[w] for w in ws] + number), " ".join(number + [RIGHT[w] for w in swapped])


def corpus(songs):
    rows, want = [], set()
    for r in range(songs):
        pairs = [sentence() for _ in range(14)]
        og, en, true = [], [], set()
        for k, (a, b) in enumerate(pairs):
            what = RNG.random()
            if what < 0.08:
                og.append(a)  # left out in the translation
            elif what < 0.16:
                en.append(b)
            elif what < 0.26:  # divided
                w = b.split()
                og.append(a)
                en += [" ".join(w[:4]), " ".join(w[4:])]
                true |= {(len(og) - 1, len(en) - 2), (len(og) - 1, len(en) - 1)}
            elif what < 0.34 and en:  # joined
                og.append(a)
                en[-1] += " / " + b
                true.add((len(og) - 1, len(en) - 1))
            else:
                og.append(a)
                en.append(b)
                true.add((len(og) - 1, len(en) - 1))
            if RNG.random() < 0.06:
                en.append("[Chorus]")
        if r % 3 == 0 and len(en) > 4:  # moved
            i = RNG.randrange(len(en) - 3)
            en[i], en[i + 2] = en[i + 2], en[i]
            swap = {i: i + 2, i + 2: i}
            true = {(a, swap.get(b, b)) for a, b in true}
        rows.append((r, "\n".join(og), "\r\n\r\n".join(en)))
        want |= {(r, a, b) for a, b in true}
    return rows, want


def run(spark, rows, glossary=None, **how):
    df = spark.createDataFrame(rows, "id bigint, og string, en string").selectExpr("*", "1 f", "2 e", "'x' record")
    return set(map(tuple, aligned_lines(df, "id", "og", "en", glossary, **how).collect()))


def test_held_out_accuracy(spark):
    rows, want = corpus(150)
    got = run(spark, rows + rows[:10])
    hit = len(got & want)
    assert hit / len(want) > 0.93 and hit / len(got) > 0.93, (hit, len(want), len(got))


def test_other_songs_pair_with_nothing(spark):
    rows, _ = corpus(120)
    wrong = [(1000 + i, rows[i][1], rows[(i + 50) % 120][2]) for i in range(20)]
    got = [x for x in run(spark, rows + wrong) if x[0] >= 1000]
    assert len(got) < 12


def test_nulls_and_empties(spark):
    glossary = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None), ("a", "b")], "og_term string, en_term string")
    assert run(spark, []) == set()
    assert run(spark, [(1, None, "x"), (2, "x", None), (3, "", ""), (4, " \n", "x"), (None, "x", "x")], glossary) == set()
    assert run(spark, [(1, "[Intro]\n" + "same line 7", "same line 7\n(x2)")] * 2, glossary) == {(1, 1, 0)}


def test_recurrences_pair_first_with_first(spark):
    rows, _ = corpus(60)
    a = [sentence() for _ in range(4)]
    og = [a[0][0], a[1][0], a[0][0], a[2][0], a[0][0]]
    en = [a[0][1], a[1][1], a[2][1], a[0][1]]
    got = {x[1:] for x in run(spark, rows + [(500, "\n".join(og), "\n".join(en))]) if x[0] == 500}
    assert got == {(0, 0), (1, 1), (2, 3), (3, 2)}


def test_parts():
    assert lines_of("a\\r\\n\\n b \n\n") == ["a", "b"] and lines_of(None) == []
    assert clauses(["[Intro]", "a b / c d; e f, and g"]) == [(1, "a b"), (1, "c d"), (1, "e f"), (1, "g")]
    assert skeleton(romanise("ピグリティ")) == skeleton("Pigriti") and skeleton(romanise("クアハル")) == skeleton("Quahal") and skeleton(romanise("ヴェシャ")) == skeleton("Vesha")
    assert tokens("ネ１２回") == ["ネ", "12", "回"] and tokens("Él, Straße!") == ["el", "strasse"]


@pytest.mark.parametrize("n", [40, 5000])
def test_long_texts(spark, n):
    line = sentence()[0]
    assert (1, 0, 0) in run(spark, [(1, line * 50 + "\nx" * n, line * 50)])


def test_a_text_of_very_many_lines_is_aligned_piece_by_piece(spark):
    rows, want = corpus(400)
    og, en, true, o, e = [], [], set(), 0, 0
    for r, a, b in rows[:130]:
        la, lb = lines_of(a), lines_of(b)
        true |= {(o + i, e + j) for k, i, j in want if k == r}
        og, en, o, e = og + la, en + lb, o + len(la), e + len(lb)
    got = {x[1:] for x in run(spark, [*rows, (999, "\n".join(og), "\n".join(en))]) if x[0] == 999}
    assert o > 1500 and len(got & true) > 0.9 * len(true) and len(got & true) > 0.9 * len(got)


def test_a_lexicon_too_large_to_send_gives_the_same_rows(spark):
    rows, _ = corpus(60)
    assert run(spark, rows) == run(spark, rows, small=0)


def test_all_originals_of_a_word_are_kept():
    keys = (np.arange(60, dtype=np.int64) << 32) | 7
    of = Originals(keys, np.full(60, 0.5), np.full(60, 3.0)).of(np.array([3, 7]))
    assert sorted(of[1]) == list(range(60)) and set(of[0]) == {1}


def test_the_way_a_lexicon_goes_changes_no_bit_of_it(spark):
    rng = random.Random(3)
    cuts = set()
    for _ in range(400):  # among them the same words cut at different places into the two sides
        words = sorted(rng.sample(range(9), rng.randint(2, 6)))
        k = rng.randint(1, len(words) - 1)
        cuts.add((tuple(words[:k]), tuple(words[k:])))
    pairs = spark.createDataFrame([(list(f), list(e), float(rng.randint(1, 3)), i) for i, (f, e) in enumerate(sorted(cuts))], "f array<bigint>, e array<bigint>, n double, pair bigint")
    sent, joined = ({r[0]: tuple(r)[1:] for r in train(x, small=k).collect()} for x, k in ((pairs, 1000), (pairs.repartition(3), 0)))
    assert len(sent) > 20 and sent == joined


@pytest.mark.parametrize("piece", [1, 5, 11])
def test_the_number_of_clauses_at_once_changes_no_row(spark, piece):
    rows, _ = corpus(60)
    rows += [(100 + k, "\n".join(x[1] for x in rows[k : k + 4]) + "\n" + rows[k][1], "\n".join(x[2] for x in rows[k : k + 4][:: (-1) ** k])) for k in range(10)]
    assert run(spark, rows, piece=piece) == run(spark, rows)


def test_a_long_text_whose_first_half_is_not_translated(spark):
    rows, _ = corpus(300)
    pairs = [sentence() for _ in range(1600)]
    rows.append((999, "\n".join(a for a, _ in pairs), "\n".join(b for _, b in pairs[800:])))
    got = {x[1:] for x in run(spark, rows) if x[0] == 999}
    assert len(got & {(800 + i, i) for i in range(800)}) > 780 and len(got) < 820
