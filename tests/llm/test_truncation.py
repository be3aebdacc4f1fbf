import random

import pytest

from cuemill.llm.truncation import anatomy, truncated, unclosed

RNG = random.Random(11)
NOUNS = ["river", "garden", "umbrella", "telephone", "newspaper", "pigeon", "lantern", "bridge", "chimney", "mirror"]
PLACES = ["in the kitchen", "at the lighthouse", "on the rooftop", "behind the station", "near the fountain"]


def line():
    return f"{RNG.choice(['We', 'They', 'You'])} {RNG.choice(['leave', 'follow', 'remember', 'polish'])} the {RNG.choice(['blue', 'narrow', 'broken', 'silent'])} {RNG.choice(NOUNS)} {RNG.choice(PLACES)}"


def prose(n):
    return " ".join(line() + "." for _ in range(n))


def run(spark, rows):
    df = spark.createDataFrame(rows, "table_name string, record_id bigint, field_name string, source string, text string").selectExpr("*", "'x' kind", "'y' line", "1 chars")
    return {(r.table_name, r.record_id): r.reason for r in truncated(df).collect()}


def test_limits_words_and_decoys(spark):
    rows, want, free = [], set(), set()
    for i in range(150):
        x = prose(RNG.randint(1, 9))
        kind = i % 6
        if kind == 0:
            cut = prose(9)[:300]
            rows.append(("r", i, "content", "limit.test", cut))
            (free if cut.rstrip().endswith(".") else want).add(("r", i))
        elif kind == 1:
            rows.append(("r", i, "content", "limit.test", prose(RNG.randint(1, 4))[:-1] + RNG.choice(["…", "...", ".", "!"])))
            free.add(("r", i))
        elif kind == 2:
            rows.append(("r", i, "content", "free.test", x + RNG.choice(["\n1. The river\n2. The garden", " — Wofera", " #Kora #live", " (2 min read)", " Home > Songs > The river"])))
            free.add(("r", i))
        elif kind == 3:
            rows.append(("r", i, "content", "free.test", x[:-9] + RNG.choice(["<br", "&quo", "�", " [...]", "… read more"])))
            want.add(("r", i))
        elif kind == 4:
            rows.append(("r", i, "content", None, x[: -len(x.split()[-1]) - 2]))
            want.add(("r", i))
        else:
            rows.append(("r", i, "content", None, x))
            free.add(("r", i))
    for i in range(120):
        song = [line() for _ in range(12)]
        text = "\n".join(song)
        if i % 3 == 0:
            rows.append(("s", i, "og", "verse.test", text[:200]))
            want.add(("s", i)) if text[:200].split("\n")[-1] not in song else free.add(("s", i))
        elif i % 3 == 1:
            rows.append(("s", i, "og", "verse.test", "\n".join(song[:3])) if i % 2 else ("s", i, "og", "whole.test", text))
            free.add(("s", i))
        else:
            at = text.rindex(" ", 0, len(text) - 30)
            rows.append(("s", i, "og", "whole.test", text[: at + 4]))
    rows += [("r", 900, "content", "free.test", None), ("r", 901, "content", "free.test", ""), ("r", 902, "content", "free.test", " \n"), ("r", None, "content", "free.test", "cut in the mid"), ("r", 903, "content", "free.test", prose(4000)), *rows[:9]]
    free |= {("r", 900), ("r", 901), ("r", 902), ("r", 903)}
    got = run(spark, rows)
    assert {k: rows for k in want if k not in got} == {}
    assert {k: got[k] for k in free if k in got} == {}


def test_byte_limit_that_splits_no_character(spark):
    """Most texts stop at 300 bytes, those in kana at 298 to 300; a source that cuts at 100 characters has no such slack."""
    kana = [chr(c) for c in range(0x3042, 0x3092)]
    song = lambda n: "\n".join("".join(RNG.choice(kana) for _ in range(RNG.randint(9, 17))) + "x" * RNG.randint(0, 2) for _ in range(n))
    rows, want, free = [], set(), set()
    for i in range(150):
        rows.append(("a", i, "og", "bytes.test", "\n".join(line() for _ in range(9))[:300]))
        rows.append(("c", i, "og", "chars.test", song(9)[:100]))
    for i in range(150, 192):
        whole = song(12)
        cut = whole.encode()[:300].decode(errors="ignore")
        rows.append(("a", i, "og", "bytes.test", cut))
        if cut.split("\n")[-1] not in ["", *whole.split("\n")]:
            want.add(("a", i))
        rows += [("a", 1000 + i, "og", "bytes.test", song(RNG.randint(2, 5))), ("c", i, "og", "chars.test", "".join(RNG.choice(kana) for _ in range(20)) + "\n" + "y" * RNG.randint(20, 34))]
        free |= {("a", 1000 + i), ("c", i)}
    assert {len(r[4].encode()) for r in rows if (r[0], r[1]) in want} == {298, 299, 300}
    got = run(spark, rows)
    assert {k for k in want if got.get(k) != "limit"} == set()
    assert {k: got[k] for k in free if k in got} == {}


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize(
    "text, state",
    [
        ("Whole.", "done"), ("He said “so” (twice).", "done"), ("cut <b", "broken"), ("cut &amp", "broken"), ("cut �", "broken"), ("cut \\u30", "broken"), ("and (so on", "broken"), ("a [...]", "marked"), ("a … read more", "marked"), ("the ...", "marked"), ("night...", "ellipsis"),
        ("no end", "open"), ("line\n", "done"), ("", "done"), (" ", "done"), ("Ende。", "done"), ("1. a\n2.", "open"),
    ],
)
def test_anatomy(text, state):
    assert anatomy(text)["state"] == state


def test_stack():
    assert unclosed("a (b [c]") and not unclosed("a (b [c])") and not unclosed("it's") and unclosed("(open\nnext line")
    assert unclosed("<div><p>Hello") and not unclosed("<div><p>Hello</div> <br> <i>so</i> 1 < 2, 3 > 2") and not unclosed("a) b ] c")


HUNG = ["He said (see below\nand then he went home.", 'She said "I never\nwanted that at all.', "<div><p>Hello there.\nAnd so on.", "「今日は\n何もない。"]


def test_what_an_earlier_line_opens(spark):
    rows = [("r", i, "content", "a.test", t) for i, t in enumerate(HUNG)]
    rows += [("r", 100 + i, "content", "a.test", t) for i, t in enumerate(['She said "so\nand so."', "(one\ntwo).", "<b>bold\ntext</b>.", "Whole."] * 5)]
    assert run(spark, rows) == {("r", i): "unclosed" for i in range(4)}


def test_a_sign_that_is_usually_left_open_tells_nothing(spark):
    rows = [("r", i, "content", "a.test", f"„so it goes {i}\nand goes.") for i in range(60)]
    assert run(spark, rows) == {}


def test_short_limits_and_long_lines(spark):
    whole = line()
    cut = [("t", i, "title", "short.test", (line() + " and so on")[:30]) for i in range(60)]
    long = "so " * 90 + "it goes"
    known = [("s", i, "og", "long.test", f"{line()}\n{long}\n{line()}") for i in range(20)] + [("s", 99, "og", "long.test", f"{whole}\n{long}")]
    got = run(spark, cut + known)
    assert sum(k[0] == "t" for k in got) > 50 and ("s", 99) not in got
