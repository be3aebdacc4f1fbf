import random

import pytest

from cuemill.llm.template import Leaf, classify, lines_of, masked, residue
from pyspark.sql import functions as F

BAD = {
    "slot": ["{{ artist }}", "{{body | safe}}", "${city}", "#{track}", "{% block x %}{% endblock %}", "{song.title}", "%(name)s", "at noon %repeat%", "%s / %s / TRACK", "<%= title %>", "<<lyrics>>", "<track goes here>", "we sing <line_2>", "__city__", "@@name", "@@body | safe@@", "[[title]]", "[insert name]", "[word?]", "<!-- LYRICS placeholder -->", "[object Object] X", "INSERT LYRICS HERE", "xxx SONG.TITLE xxx", "TBD (TRACK)", "TODO: add CONTENT", "Lyrics for undefined by undefined"],
    "error": ["502 Bad Gateway", "Too Many Requests (429)", "HTTP/1.1 500 サーバー内部エラー", "Error 503: Servicio no disponible. Request id 54845b75f8", '{"error":{"code":502,"message":"Bad Gateway"}}', "<html><head><title>Zugriff verweigert</title></head><body>403</body></html>", "Traceback (most recent call last): ReadError: x", "Fetch failed for https://a.example/1: Forbidden", "Oops! Página no encontrada.", "Forbidden"],
    "notice": ["Please enable JavaScript to view this page.", "You need to turn on scripts in your browser to read these lyrics.", "JavaScriptを有効にしてください。 Ref a3c5", "<noscript>JS must be on</noscript>", "Ihr Browser blockiert Skripte. Ohne sie kann der Text nicht angezeigt werden."],
    "filler": ["Lorem ipsum dolor sit amet consectetur", "blah blah, blah blah, blah blah", "texto de ejemplo texto de ejemplo texto de ejemplo", "ダミーテキスト", "asdf asdf asdf asdf"],
    "stand-in": ["Hier den Songtext einfügen", "歌詞は準備中です。", "Aún no tenemos la letra de X.", "Checking your browser before you continue to x.test"],
}
GOOD = [
    "Please enable me to dance, I lost the script", "Access denied, you said, and closed the window", "アクセス拒否と君は言って窓を閉めた", "Error cuatro cero cuatro, no hallé tu corazón", "Lorem was her name, or ipsum, I was never sure", "Too many requests for one small heart", "la la la la la la la", "[Chorus]", "(x2)",
    "Null and void, undefined, that is what we became", "Insert a coin here, the title screen glows", "100% of me", "a < b", "I said {1}", "Service is closed tonight, try again tomorrow, baby", "You are still loading, loading in my head", "<i>soft</i>", "A cookie and a captcha, prove to me you are human", "translated by a fan",
]


def run(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, og string, en string").selectExpr("*", "'x' text", "'y' leaf", "1 line")
    return {(r.record_id, r.field_name): r.verdict for r in residue(df, "id", ["og", "en"]).collect()}


def test_cases_alone_and_amid_lyrics(spark):
    rows, want, n = [], {}, 0
    song = "We cross the river at noon\nYou hum to a grey pigeon\n%s\nThey leave the last train"
    for kind, xs in BAD.items():
        for x in xs:
            rows += [(n, x, GOOD[n % len(GOOD)]), (n + 1, song % GOOD[n % len(GOOD)], song % x)]
            want |= {(n, "og"): [kind], (n + 1, "en"): [kind]}
            n += 2
    for x in GOOD:
        rows.append((n, x, (song % x).replace("\n", "\\r\\n")))
        n += 1
    rows += [(n, None, ""), (n + 1, " ", "\n"), (None, "502 Bad Gateway", None), (n + 2, "x " * 100_000, "{{x}} " * 1000), *rows[:4]]
    want[(n + 2, "en")] = ["slot"]
    want[(n + 2, "og")] = ["filler"]
    got = run(spark, rows)
    assert {k: v for k, v in got.items() if k not in want} == {}
    assert {k for k in want if k not in got} == set()
    assert {k: (v, got[k]) for k, v in want.items() if not set(v) <= set(got[k])} == {}


def test_lines_and_masks(spark):
    text = "　 a\u00a0 b\t12 \r\n\\n\u2003x.example  0a1b2c3d4 \x85\n \u3000\n"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(lines_of(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == [["a\u00a0 b\t12", "x.example  0a1b2c3d4"], None, []]
    assert [r[0] for r in df.select(F.explode("l").alias("x")).select(masked(F.col("x"))).collect()] == ["a b <n>", "<host> <hex>"]


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("x", GOOD)
def test_content_is_no_case(x):
    assert classify(x) is None


def test_leaf_makes_wildcards():
    leaf = Leaf()
    for x in ("a b c d", "a b c e", "a x y z", "a b c f"):
        leaf.add(x.split())
    assert leaf.templates == [["a", "b", "c", "<*>"], ["a", "x", "y", "z"]]


@pytest.mark.parametrize("errors, lyrics", [(1, 1), (3, 1), (1, 5), (4, 4)])
def test_a_message_and_a_lyric_that_begin_alike(spark, errors, lyrics):
    """Neither takes the other's verdict, whichever is more frequent."""
    pairs = [("Something went wrong on our side", "Something went wrong on our wedding"), ("You need to enable JavaScript", "You need to leave tonight")]
    rows, want = [], {}
    for message, lyric in pairs:
        for k in range(errors):
            rows.append((len(rows), message, f"We sing\n{lyric}\nall night {k}"))
            want[(len(rows) - 1, "og")] = ["error" if "wrong" in message else "notice"]
        for k in range(lyrics):
            rows.append((len(rows), f"{lyric}\nand so we sing {k}", None))
    assert run(spark, rows) == want


#: Messages that no list knows, with the parts that vary.
UNSEEN = [
    "Error 10{n}: proxy gave up after {n} ms", "Erreur {n} : page introuvable", "This site can't be reached ({n})", "Texto de relleno {n}", "Sorry, {h} took too long to respond", "Your session {x} has expired, sign in again", "Cloud edge {n} says no. Ray {x}", "Verify you are human, case {x}",
    "We moved! Find us at {h}", "Contenu indisponible, code {n}", "Limite de {n} pages atteinte", "Quota used up: {n} of {n}", "このサイトは一時停止中 {n}", "Licence for these words ran out on {n}", "Seite wird gerade umgebaut, Vorgang {n}", "This copy was removed after a claim ({x})",
]
MORE_LYRICS = ["We count {n} stars above the station", "You wait for {n} letters", "Halgri carries {n} apples home", "I call the number {n} again", "Erase page {n} of my diary"]


def test_unseen_messages_with_numbers_and_slots(spark):
    """Templates without known words are found by where they stand, alone and amid lyrics, in at least 0.9 of the fields."""
    rng = random.Random(5)
    fill = lambda t: t.replace("{n}", str(rng.randrange(100, 999))).replace("{x}", f"{rng.randrange(1 << 40):010x}0a1").replace("{h}", f"h{rng.randrange(99)}.example")
    rows, want = [], set()
    for t in UNSEEN:
        for _ in range(4):
            rows.append((len(rows), fill(t), None))
            want.add(len(rows) - 1)
        rows.append((len(rows), "\n".join([fill(MORE_LYRICS[0]), fill(t), fill(MORE_LYRICS[2])]), None))
        want.add(len(rows) - 1)
    for _ in range(60):
        rows.append((len(rows), "\n".join(map(fill, rng.sample(MORE_LYRICS, 4))), None))
    rows += [(len(rows), fill(MORE_LYRICS[0]), None)]  # cut to one line, and still a lyric
    got = {k for k, _ in run(spark, rows)}
    assert got <= want and len(got) >= 0.9 * len(want)
