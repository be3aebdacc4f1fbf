"""Template residue, filler, error pages and script notices instead of real content.

Method: messages that sites and tools put in place of content repeat with varying parts, so message templates are mined with
a prefix tree of fixed depth: a line, its numbers, hosts and hexadecimal ids masked, goes down by its kind, its number of
tokens and its first tokens to a leaf, where it joins the first template that agrees in enough tokens; disagreeing tokens
become wildcards. Trees are grown where the lines lie, over distinct lines only, and merged leaf by leaf.

A template is judged once. One whose lines have the words of a message (the seeds below) is a message by these: the
kind is part of the path down the tree, so that a message never joins a lyric that begins alike. Any other template is
judged by where it stands: its lines are whole fields, for different songs or sites, at least twice as often as they stand
among other lines, which lyrics, headings and notes don't. Its verdict goes to every line it matches, so also to
those amid real lyrics. Unresolved slots are looked for separately in all lines, since they occur inside ordinary ones.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

WILD = "<*>"
DEPTH = 3
SIMILAR = 0.6
#: Lines of the longest error page that is taken as a whole.
PAGE = 4
_URL, _HOST, _HEX = r"https?://\S+", r"\b[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|net|org|io)\b", r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b"

# ---- fixed values: how unfilled slots are written -------------------------------------------------------------------
_NAME = r"[A-Za-z_][\w.]*(?: ?\| ?\w+)?"
SLOT = "|".join(
    (
        rf"\{{\{{\s*{_NAME}\s*\}}\}}",
        rf"[$#]\{{\s*{_NAME}\s*\}}",
        r"\{%[^%{}]{1,60}%\}",
        rf"\{{\s*{_NAME}\s*\}}",
        rf"%\(\s*{_NAME}\s*\)[sd]",
        r"%[A-Za-z_]\w*%",
        r"(?:%s\s*/\s*)+",
        r"<%[-=]?[^%<>]{1,60}%>",
        rf"<<\s*{_NAME}\s*>>",
        rf"<{_NAME} goes here>",
        r"<(?!/?(?:i|b|u|s|p|br|em|strong|font|span|div|a|q|ruby|rt|rp|small|sup|sub|html|head|title|body|noscript|h[1-6]|li|ul|ol|pre|code|hr|img)\b)[A-Za-z_]\w*>",
        r"__[A-Za-z]\w*?(?:\.\w+)?(?: ?\| ?\w+)?__",
        rf"@@{_NAME}(?:@@)?",
        rf"\[\[\s*{_NAME}\s*\]\]",
        rf"\[insert {_NAME}(?: here)?\]",
        r"\[[A-Za-z_]\w*\?\]",
        r"<!--[^<>]{0,60}placeholder[^<>]{0,20}-->",
        r"\[object Object\]",
        rf"\bINSERT {_NAME} HERE\b",
        rf"\bxxx {_NAME} xxx\b",
        rf"\bTBD \({_NAME}\)",
        rf"\bTODO: add {_NAME}",
        r"\bfor undefined by undefined\b",
    )
)

#: What every slot has in it; a quick look before the long one.
SLOT_SIGN = r"[{<%_@\[]|INSERT |xxx |TBD |TODO|undefined by"

# ---- fixed values: words of the messages ----------------------------------------------------------------------------
#: What a failed page says, in the languages of the sites, as whole messages.
ERRORS = (
    "bad gateway",
    "gateway time-out",
    "gateway timeout",
    "service unavailable",
    "service temporarily unavailable",
    "too many requests",
    "slow down! rate limit reached",
    "rate limit exceeded",
    "internal server error",
    "page not found",
    "not found",
    "forbidden",
    "access denied",
    "unauthorized",
    "bad request",
    "request timeout",
    "the page you requested does not exist",
    "you have no permission to view this resource",
    "nothing to see here: this address leads nowhere",
    "the upstream did not answer",
    "read timed out while fetching the page",
    "down for maintenance, be right back",
    "something went wrong on our side",
    "something went wrong",
    "dienst nicht verfügbar",
    "zu viele anfragen",
    "interner serverfehler",
    "zugriff verweigert",
    "seite nicht gefunden",
    "error interno del servidor",
    "servicio no disponible",
    "demasiadas solicitudes",
    "acceso prohibido",
    "acceso denegado",
    "página no encontrada",
    "サーバー内部エラー",
    "アクセスが拒否されました",
    "ページが見つかりません",
    "リクエストが多すぎます",
    "ただいまメンテナンス中です",
    "サービスは利用できません",
)
#: Sentences that stand in for content that isn't there yet.
STAND_INS = (
    r"your text goes here",
    r"click to edit this (?:block|text)",
    r"(?:type|paste|enter)(?: or paste)? (?:the |your )?(?:lyrics|text) (?:into|in|here)",
    r"we do not have the lyrics",
    r"be the first to add them",
    r"lyrics (?:are )?(?:coming soon|not available|will be added)",
    r"songtext folgt in kürze",
    r"hier den songtext einfügen",
    r"(?:noch )?kein songtext vorhanden",
    r"escribe aquí la letra",
    r"aún no tenemos la letra",
    r"letra (?:no disponible|próximamente)",
    r"ここに歌詞を入力",
    r"歌詞は準備中",
    r"歌詞はまだ(?:登録|あり)",
    r"checking your browser before you continue",
)
FILLER_WORDS = frozenset(
    "blah asdf qwerty foo bar baz text sample dummy placeholder verse lyric lyrics here test line of xxx beispieltext zeile platzhalter texto de ejemplo letra línea verso "
    "サンプル歌詞 ダミーテキスト ダミー サンプル テスト 歌詞 テキスト".split()
)
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur".split()
)
#: A notice that scripts are required names scripts and says what about them.
SCRIPTS = r"java ?script|\bscripts\b|\bscripting\b|\bnoscript\b|\bskripte\b|スクリプト|\bjs must be on\b"
SCRIPT_NEED = r"enabl|turn on|switched (?:off|on)|disabled|require|must be on|runs only|allow|block|aktivier|einschalten|ohne sie|activar|active|necesita|ejecuta|permit|有効|許可|オン|必要"
SUNG = frozenset("la na oh ooh ah hey yeah da doo hm mm ラ ララ ナ オー".split())

_ERROR = "|".join(re.escape(x) for x in sorted(ERRORS, key=len, reverse=True))
#: Frames round an error message; the masked line must be nothing but frame and message.
_FRAMES = [
    re.compile(x)
    for x in (
        rf"(?:{_ERROR})[.!。]?",
        rf"<n>[ :-]+(?:{_ERROR})[.!。]?",
        rf"(?:{_ERROR}) \(<n>\)[.!。]?",
        r"http/<n>\.<n> <n> .*",
        r"error:? <n>:? .*request id.*",
        rf"(?:error|fehler|エラー):? ?(?:<n>)?[: ]+(?:{_ERROR})[.!。]?",
        r"oops!? .{0,10}(?:" + _ERROR + r")[.!。]?.*",
        r"\{\"?error\"?:.*\}.*",
        r"<html><head><title>.*</title></head>.*",
        r"traceback \(most recent call last\).*",
        r"fetch failed for \S+ .*",
        rf"(?:{_ERROR})[.!。]? (?:<n> )?(?:reference|request id|host)\b.*",
    )
]
_NOTICE = re.compile(SCRIPTS)
_NEED = re.compile(SCRIPT_NEED)
_STAND_IN = re.compile("|".join(STAND_INS))


def classify(template: str) -> str | None:
    """What a masked line, or a template of such lines, is: error, notice, stand-in, filler, or None for content."""
    s = template.strip().casefold()
    if any(p.fullmatch(s) for p in _FRAMES):
        return "error"
    if _NOTICE.search(s) and _NEED.search(s):
        return "notice"
    if _STAND_IN.search(s):
        return "stand-in"
    words = re.findall(r"[^\W\d_]+", s)
    if len(words) >= 4 and sum(w in LATIN_FILLER for w in words) >= 0.75 * len(words):
        return "filler"
    if words and all(w in FILLER_WORDS for w in words) and (len(words) > 1 and not s.startswith(("[", "(")) or any(len(w) >= 5 and ord(w[0]) > 0x3000 for w in words)):
        return "filler"
    unit = next((k for k in range(1, 5) if words[k:] == words[:-k]), None)  # a phrase of up to four words over and over
    if unit and not set(words) <= SUNG and len(words) >= unit * (3 if set(words) <= FILLER_WORDS else 6) and len(words) >= 4:
        return "filler"
    return None


#: Marks of what editors add to lyrics: headings, notes, rules. No template of these is a message.
_ADDED = re.compile(r"^(?:[\[(*~=_\-–—#♪].*|.*translat.*|.*[:：])$")


class Leaf:
    """Templates of one leaf of the prefix tree, found by the tokens they have at a place, so that a leaf with many
    templates isn't searched through for each line."""

    def __init__(self):
        self.templates: list[list[str]] = []
        self.at: dict[tuple[int, str], list[int]] = {}

    def add(self, tokens: list[str]) -> None:
        votes = Counter(i for p, t in enumerate(tokens) for i in self.at.get((p, t), ()))
        for i in sorted(votes):  # the first that agrees enough
            mine = self.templates[i]
            same = sum(a == b != WILD for a, b in zip(mine, tokens))
            if same >= 0.5 * len(tokens) and same + sum(a == WILD for a in mine) >= SIMILAR * len(tokens):
                for p, (a, b) in enumerate(zip(mine, tokens)):
                    if a != b and a != WILD:
                        mine[p] = WILD
                        self.at[p, a].remove(i)
                return
        for p, t in enumerate(tokens):
            if t != WILD:
                self.at.setdefault((p, t), []).append(len(self.templates))
        self.templates.append(list(tokens))


def leaf_key(tokens: list[str], kind: str | None = None) -> str:
    return "\x1f".join([kind or "", str(len(tokens)), *tokens[:DEPTH]])


_TREE = "leaf string, kind string, tokens array<string>"
_TREE_TYPES = (pa.string(), pa.string(), pa.list_(pa.string()))


def _batch(rows: list[tuple], schema: str, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in schema.split(", ")])


def _rows(leaves: dict[str, tuple]) -> pa.RecordBatch:
    return _batch([(k, kind, t) for k, (kind, leaf) in leaves.items() for t in leaf.templates], _TREE, _TREE_TYPES)


def _grow(batches):
    """Local trees over distinct masked lines of messages; handed on and begun anew when they have grown large."""
    leaves: dict[str, tuple] = {}
    held = 0
    for b in batches:
        for line, kind in zip(b.column("masked").to_pylist(), b.column("kind").to_pylist()):
            tokens = line.split()
            leaves.setdefault(leaf_key(tokens, kind), (kind, Leaf()))[1].add(tokens)
            held += 1
        if held > 200_000:
            yield _rows(leaves)
            leaves, held = {}, 0
    if leaves:
        yield _rows(leaves)


def _merge(batches):
    """Rows come sorted by leaf: a leaf is handed on as soon as the next one begins."""
    key, kind, leaf, out = None, None, Leaf(), []
    for b in batches:
        for k, c, t in zip(*(b.column(x).to_pylist() for x in ("leaf", "kind", "tokens"))):
            if k != key:
                out += [(key, kind, x) for x in leaf.templates]
                key, kind, leaf = k, c, Leaf()
                if len(out) > 5_000:
                    yield _batch(out, _TREE, _TREE_TYPES)
                    out = []
            leaf.add(t)
    out += [(key, kind, x) for x in leaf.templates]
    if out:
        yield _batch(out, _TREE, _TREE_TYPES)


def lines_of(text: Column) -> Column:
    """Lines of a text; the literal escapes of line breaks count as line breaks."""
    breaks = F.replace(F.replace(text, F.lit("\\r"), F.lit("\r")), F.lit("\\n"), F.lit("\n"))
    return F.filter(F.transform(F.split(breaks, r"[\r\n]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def masked(line: Column) -> Column:
    named = F.when(F.contains(line, F.lit(".")), F.regexp_replace(F.regexp_replace(line, _URL, "<url>"), _HOST, "<host>")).otherwise(line)
    out = F.when(line.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(named, _HEX, "<hex>"), r"\d+", "<n>")).otherwise(named)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def mine_templates(lines: DataFrame) -> DataFrame:
    """``leaf, kind, tokens``: templates of the distinct masked lines (``masked, kind``) that may be messages; a template's
    wildcards are ``<*>``. A leaf's lines are first merged where they lie, so that a frequent beginning sends its
    templates, not its lines, to the task that merges the leaf."""
    local = lines.mapInArrow(_grow, _TREE)
    return local.repartition("leaf").sortWithinPartitions("leaf", F.array_join("tokens", " ")).mapInArrow(_merge, _TREE)


def _matches(tokens: Column, template: Column) -> Column:
    return F.forall(F.zip_with(tokens, template, lambda a, b: (a == b) | (b == WILD)), lambda x: x)


def residue(df: DataFrame, record_id: str, fields: list[str], spread: list[str] | None = None, seeds: bool = True) -> DataFrame:
    """``record_id, field_name, verdict``: each field that holds, wholly or in part, an unfilled slot ('slot'), filler, a
    stand-in, an error message, a notice that scripts are required, or another message ('message') in place of its
    content; the verdicts of a field in a sorted array.

    Null, empty and blank fields are no cases. Rows delivered again give one row, rows with a null id none. ``spread``: the
    columns (song, site) of which a message without known words must have at least two values, where it is a whole
    field; the record's id if not given. ``seeds=False`` judges by where templates stand alone, without any word list.
    """
    by = F.xxhash64(*[df[c] for c in spread or [record_id]])
    wide = df.select(df[record_id].alias("record_id"), by.alias("spread"), *[df[f].cast("string").alias(f) for f in fields]).where(F.col("record_id").isNotNull())
    values = wide.unpivot(["record_id", "spread"], fields, "field_name", "text").where("text is not null")
    listed = values.select("record_id", "field_name", "spread", lines_of(F.col("text")).alias("lines"))
    # a page of a few lines that names its request or host is a whole field of one message too
    page = (F.size("lines") <= PAGE) & F.exists("lines", lambda x: x.rlike(rf"{_URL}|{_HOST}|{_HEX}"))
    lines = listed.select("record_id", "field_name", "spread", ((F.size("lines") == 1) | page).alias("whole"), F.explode("lines").alias("line"))
    # from here on distinct lines: what a field's lines are worth comes back to them at the end
    where = F.when(F.col("whole"), F.col("spread"))
    counts = [F.count("*").alias("n"), F.count(where).alias("n_whole"), F.min(where).alias("lo"), F.max(where).alias("hi")]
    distinct = lines.groupBy("line").agg(*counts)
    distinct = materialise(distinct.select("*", masked(F.col("line")).alias("masked"), (F.col("line").rlike(SLOT_SIGN) & F.col("line").rlike(SLOT)).alias("slot")), "lines")
    forms = distinct.groupBy("masked").agg(F.sum("n").alias("n"), F.sum("n_whole").alias("n_whole"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def kinds(batches):
        for b in batches:
            text = b.column("masked").to_pylist()
            kind = [classify(x) if seeds else None for x in text]
            added = [bool(_ADDED.match(x)) for x in text]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(kind, pa.string()), pa.array(added)], [*b.schema.names, "kind", "added"])

    forms = materialise(forms.mapInArrow(kinds, "masked string, n bigint, n_whole bigint, lo bigint, hi bigint, kind string, added boolean").where("masked <> ''"), "forms")
    templates = mine_templates(forms.where("kind is not null or (n_whole > 0 and not added)").select("masked", "kind"))
    templates = materialise(templates.withColumn("template", F.xxhash64("leaf", "tokens")), "templates")
    keyed = forms.where("not added or kind is not null").withColumn("t", F.split("masked", " "))

    def leaf(kind: Column) -> Column:
        return F.array_join(F.concat(F.array(kind, F.size("t").cast("string")), F.slice("t", 1, DEPTH)), "\x1f")

    # templates without known words: judged by all lines they match
    bare = keyed.where("kind is null").withColumn("leaf", leaf(F.lit(""))).join(templates.where("kind is null").select("leaf", "tokens", "template"), "leaf").where(_matches(F.col("t"), F.col("tokens")))
    stands = bare.groupBy("template").agg(F.sum("n").alias("n"), F.sum("n_whole").alias("n_whole"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    alone = stands.where("n_whole * 3 >= n * 2 and lo <> hi").select("template")
    bad = keyed.where("kind is not null").select("masked", F.col("kind").alias("verdict"))
    # seeded templates by their own verdict; their wildcards reach lines without known words only where they stand alone too
    bad = bad.unionByName(bare.join(alone, "template", "left_semi").select("masked", F.lit("message").alias("verdict")))
    said = distinct.join(bad, "masked").select("line", "verdict").unionByName(distinct.where("slot").select("line", F.lit("slot").alias("verdict")))
    # few lines are bad: their table is written, so that its size is known and Spark sends it around only if it is small
    said = materialise(said.distinct(), "residue")
    return lines.select("record_id", "field_name", "line").join(said, "line").groupBy("record_id", "field_name").agg(F.sort_array(F.collect_set("verdict")).alias("verdict"))
