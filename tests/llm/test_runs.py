import random

import pytest
from pyspark.sql import functions as F

from cuemill.llm.runs import collapse_runs, misspelt, same_utterance, utterance

SCHEMA = "seg string, attempt int, pos int, id bigint, text string, s bigint, e bigint, part int, edge int, entity int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = collapse_runs(df, "seg", "attempt", "pos", "text", "s", "e", "id")
    return sorted(map(tuple, got.collect()), key=str)


def brute(rows):
    top, out = {}, []
    for r in rows:
        if None not in r[:3]:
            top[r[0]] = max(top.get(r[0], r[1]), r[1])
    last, seg = None, None
    for seg_, a, pos, i, text, s, e in sorted({r for r in rows if None not in r[:3] and r[1] == top[r[0]]}, key=lambda r: (r[0], r[2], str(r[3]))):
        u = utterance(text)
        if u is None:
            last = None
        elif last and seg == seg_ and last == u:
            o = out[-1]
            o[3], o[4] = pos, o[4] + 1
            o[5], o[6] = min((x for x in (o[5], s) if x is not None), default=None), max((x for x in (o[6], e) if x is not None), default=None)
        else:
            out.append([seg_, a, pos, pos, 1, s, e])
            last = u
        seg = seg_
    return sorted(map(tuple, out), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    for words in (["ja"], ["ja", "nein", None, " "], ["a", "b"]):
        rows = []
        for i in range(700):
            seg = "hot" if rng.random() < 0.7 else f"s{rng.randrange(20)}"
            rows.append((seg, rng.randrange(2), rng.randrange(900), i, rng.choice(words), rng.choice([None, rng.randrange(99)]), rng.choice([None, rng.randrange(99)])))
        rows += rng.sample(rows, 50) + [(None, 1, 1, 1, "x", 1, 2), ("n", None, 1, 1, "x", 1, 2), ("n", 0, None, 1, "x", 1, 2)]
        assert run(spark, rows) == brute(rows)


def test_one_run_over_all_partitions(spark):
    rows = [("a", 1, i, i, "so weit", i, i + 1) for i in range(500)] + [("a", 0, i, 1000 + i, "alt", 0, 1) for i in range(500)]
    assert run(spark, rows) == [("a", 1, 0, 499, 500, 0, 500)]


RNG = random.Random(3)
FORMS = ["the silver bridge was open", *(f"the {x} bridge was open" for x in ("siver", "silvr", "silve", "ilver", "slver"))]


def test_the_clean_form_stays_among_many_misspelt_ones(spark):
    order = [0, 1, 2, 3, 4, 5, 1, 0, 3]  # misspelt ones are alike only by the clean one
    rows = [("a", 1, k, k, FORMS[i], k, k + 1) for k, i in enumerate(order)]
    assert [x[2:5] for x in run(spark, rows)] == [(0, 8, 9)]


@pytest.mark.parametrize("parts", ["1", "2", "5", "9"])
def test_torn_runs_are_compared_by_all_their_forms(spark, parts):
    order = [0, 1, 2, 3, 4, 5] + [RNG.choice([1, 2, 3, 4, 5]) for _ in range(60)]
    rows = [("a", 1, k, k, FORMS[i], k, k + 1) for k, i in enumerate(order)]
    rows += [("a", 1, 66, 66, None, 0, 1), ("a", 1, 67, 67, FORMS[1], 0, 1), ("a", 1, 68, 68, "another cue", 0, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert [x[2:5] for x in run(spark, rows)] == [(0, 65, 66), (67, 67, 1), (68, 68, 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def in_order(rows):
    """The definition, one event after the other."""
    top, out, forms, seg = {}, [], [], None
    for r in rows:
        top[r[0]] = max(top.get(r[0], r[1]), r[1])
    for name, attempt, pos, _, text, s, e in sorted({r for r in rows if r[1] == top[r[0]]}, key=lambda r: (r[0], r[2], str(r[3]))):
        u = utterance(text)
        if u is not None and seg == name and any(same_utterance(x, u) for x in forms):
            o = out[-1]
            o[3:] = [pos, o[4] + 1, min(o[5], s), max(o[6], e)]
            forms.append(u)
        else:
            forms = [u] if u is not None else []
            if u is not None:
                out.append([name, attempt, pos, pos, 1, s, e])
        seg = name
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("parts", ["1", "2", "8", "64"])
def test_the_number_of_partitions_changes_nothing(spark, parts):
    rng = random.Random(11)
    rows = []
    for seg in ("a", "b", *"cdefg"):
        for k in range(150 if seg in "ab" else 9):
            text = rng.choice(FORMS + FORMS + ["another cue", None])
            rows += [(seg, 2, k, len(rows), text, k, k + 3), (seg, 1, k, len(rows) + 1, FORMS[0], 0, 1)]
    rows += rng.sample(rows, 30)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert run(spark, rows) == in_order(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_letter_by_letter(spark):
    df = spark.createDataFrame([("a", 0, i, i, t, 0, 1) for i, t in enumerate(["x y", "x y", "X y", " ", "x y", None, "x y"])], "seg string, attempt int, pos int, id int, text string, s bigint, e bigint")
    assert sorted(x[2:5] for x in collapse_runs(df, "seg", "attempt", "pos", "text", "s", "e", "id", exact=True).collect()) == [(0, 1, 2), (2, 2, 1), (4, 4, 1), (6, 6, 1)]


def test_empty(spark):
    assert run(spark, []) == []


SAME = [
    ("Wait!", "WAIT…"), ("T-They swear it", "They swear it"), ("Olvido... Olvido un mapa", "olvido un mapa"), ("T-They, T-They rinse a cup", "They rinse a cup"), ("sooner than planneeeed", "Sooner than planned"),
    ("千っ、千日のあいだ渡る", "千日のあいだ渡る"), ("待…待合室で灯している", "待合室で 灯しているーーー"), ("１３回描いている", "13回描いている."), ("Ｔｏｄａｖíａ ｎｏ", "todavía no"), ("waehrend der Parade", "während der Parade"),
    ("Strasse am See", "Straße am See"), ("a curtain of velvt", "a curtain of velvet"), ("Er flikct die Zeitung", "Er flickt die Zeitung"), ("「待って」", "待って"), ("♪", "♪"), ("since yestedray noon", "since yetserday noon"), ("die muede Burecke", "die müde Brücke"), ("durante reucerdo un vaso", "durante recuerdo un vaso"),
]
OTHER = [
    ("a barco de papel", "a banco de papel"), ("13 times", "14 times"), ("11 mal", "1 mal"), ("北風を", "南風を"), ("私の影", "君の影"), ("the third evening", "the first evening"), ("Wir gehen heim", "Ihr gehen heim"), ("bitteren Tee", "bitteren See"),
    ("I inter the door", "inter the door"), ("No. Nothing", "thing"), ("♪", "…"), ("el caballo de", "el cabello de"), ("eine müde Biene", "eine müde Birne"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert same_utterance(utterance(a), utterance(b))


@pytest.mark.parametrize("a, b", OTHER)
def test_other(a, b):
    assert not same_utterance(utterance(a), utterance(b))


def test_blank_is_none():
    assert utterance(None) is None and utterance(" 　\n") is None and utterance("") is None
    assert misspelt("velvet", "velvt") and not misspelt("barco", "banco") and not misspelt("abc", "ab")


def test_long_text(spark):
    rows = [("a", 0, 0, 0, "word " * 50_000, None, None), ("a", 0, 1, 1, "WORD " * 50_000, None, None)]
    assert run(spark, rows) == [("a", 0, 0, 1, 2, None, None)]
