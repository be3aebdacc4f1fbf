"""Values that were cut off by a field limit or in mid-transfer.

Method: a structural check of each whole value by a stack automaton (unclosed quotes, brackets and markup), of its end for broken
multibyte sequences, entities and escapes and marks of a cut, and, where the structure alone doesn't tell, the
baselines of its source: the lengths at which the source cuts (an exact length in characters or bytes that far more
distinct texts have than its neighbours), how often its values end with a terminator, and, over the whole corpus, which
lines are known in full and how often a word is the last one of a line or sentence. All baselines are aggregated
over all values with map-side combination and joined back by key.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

# ---- fixed values ---------------------------------------------------------------------------------------------------
#: A broken end: half an entity, tag, escape or multibyte sequence.
_BROKEN = re.compile(r"(?:[�\ud800-\udfff]|&(?:#\w{0,7}|[A-Za-z]\w{0,7})?|<[^<>]{0,60}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?)$")
#: Marks that a cutter leaves.
_MARK = re.compile(r"(?:[\[(](?:…|\.\.\.)[\])]|(?:…|\.\.\.)\s*(?:\[?\(?(?:read more|more|continue reading|weiterlesen|mehr lesen|leer más|seguir leyendo|続きを読む|続き|もっと見る)\)?\]?)\s*[»›>→]?|\s(?:…|\.\.\.))$", re.I)
_ELLIPSIS = re.compile(r"(?:…|\.{3,})+$")
_STOPS, _CLOSERS = frozenset(".!?。！？．｡…"), "\"'”’»」』)]）】"
#: What may stand behind a finished text without a terminator of its own.
_TAILS = (
    ("list", re.compile(r"(?:^|\n)\s*\d{1,3}[.)] (?P<item>[^\n]*)$")),
    ("list", re.compile(r"(?:^|\n)\s*[-*•・] (?P<item>[^\n]*)$")),
    ("menu", re.compile(r"(?:^|[.!?。！？…\s])[^\s.!?。！？>|]+(?: [>|»] [^\n>|»]+)* [>|»] (?P<item>[^\n>|»]*)$")),
    ("sign", re.compile(r"(?:^|\s|[。！？])[—–―] ?(?P<item>\S{1,40})$")),
    ("tags", re.compile(r"(?:^|\s|[。！？])#(?P<item>\S{1,40})$")),
    ("note", re.compile(r"[(（\[][^()（）\[\]]{1,40}[)）\]](?P<item>)$")),
)
_OPEN, _CLOSE = "([{（［｛「『【〈《“«„", ")]}）］｝」』】〉》”»“"
_PAIR = dict(zip(_OPEN, _CLOSE))
_WORD = re.compile(r"[^\W\d_]+|\d+")
_DIGIT = re.compile(r"\d")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_LINE_STOPS = frozenset(",.;:!?。、，．！？…")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_ITEM = re.compile(r"^\d{1,3}[.)] ")
_EDGE = " \t\r\n.,;:!?。、，．！？…\"'”’»「」『』()（）　"

#: Bytes of the longest character.
UTF8 = 4

#: Tags that are never closed.
_VOID = frozenset("br hr img input link meta wbr".split())
_SIGN = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>|[\"" + re.escape(_OPEN + _CLOSE) + "]")
#: Of the texts of a table that have a sign, the share that may leave it open before it says nothing about a text.
HANGS = 0.1

VALUE, LINE, TOKEN = 0, 1, 2
_SCHEMA = (
    "kind int, table_name string, record_id bigint, field_name string, source string, chars bigint, bytes bigint, digest string, state string, expects int, "
    "tail string, line string, last1 string, last2 string, cjk boolean, signs array<string>, hang string, ends bigint, total bigint"
)
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = dict(x.split() for x in _SCHEMA.split(", "))


def _digest(s: str) -> str:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=10).hexdigest()


def automaton(text: str) -> tuple[list[tuple[str, int]], set[str]]:
    """Stack automaton over a whole text: the brackets, paired quotes, straight double quotes and tags still open at its end, each
    with its place, and all that were opened. A closing tag closes what was opened inside it; a closing sign without
    an opening one is passed over."""
    stack: list[tuple[str, str, int]] = []  # what closes it, what opened it, where
    opened: set[str] = set()
    for m in _SIGN.finditer(text):
        c = m[0]
        if m[2]:
            tag = f"<{m[2].lower()}>"
            if m[3] or tag[1:-1] in _VOID:
                continue
            if not m[1]:
                stack.append((tag, tag, m.start()))
                opened.add(tag)
            elif any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
        elif stack and c == stack[-1][0]:
            stack.pop()
        elif c in _PAIR or c == '"':
            stack.append((_PAIR.get(c, c), c, m.start()))
            opened.add(c)
    return [(sign, at) for _, sign, at in stack], opened


def unclosed(text: str) -> bool:
    return bool(automaton(text)[0])


def normalise(text: str) -> str:
    return text.replace("\\r", "\r").replace("\\n", "\n").replace("\r\n", "\n").replace("\r", "\n") if "\\" in text or "\r" in text else text


def _key(line: str) -> str:
    """A line as it is recognised again; of a very long one its digest."""
    key = _plain(line)
    return key if len(key) < 200 else _digest(key)


def _plain(line: str) -> str:
    if line.isascii():
        return " ".join(line.casefold().split()).strip(_EDGE)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", line).casefold()).strip(_EDGE)


def tokens(text: str) -> list[str]:
    """Words; numbers are one token; of kana and kanji runs each pair of neighbours is one."""
    text = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    words = _WORD.findall(text)
    if not _DIGIT.search(text) and (text.isascii() or not _CJK.search(text)):
        return words
    out = []
    for w in words:
        if w[0].isdigit():
            out.append("#")
        elif not w.isascii() and _CJK.search(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w)
    return out


def anatomy(raw: str) -> dict:
    """The structure of a value. ``state`` of its end: 'done', 'broken', 'marked', 'ellipsis' or 'open'. ``signs``: the brackets, quotes
    and tags it opens; ``hang``: the last of them that an earlier line opens and nothing closes."""
    return _anatomy(normalise(raw))


def _anatomy(text: str) -> dict:
    body = text.rstrip()
    lines = [x for x in map(str.strip, body.split("\n")) if x]
    out = {"state": "done", "expects": 0, "tail": None, "line": None, "last1": None, "last2": None, "cjk": False, "signs": None, "hang": None}
    if not lines:
        return out
    verse = [x for x in lines[:-1] if x[0] not in "[(~*"]
    if len(verse) >= 2 and sum(x.rstrip(_CLOSERS)[-1:] in _LINE_STOPS for x in verse) >= 0.7 * len(verse):
        out["expects"] = 1
    end, last = body[-120:], body[body.rfind("\n") + 1 :]
    if _BROKEN.search(end) and not body.endswith("\\n"):
        out["state"] = "broken"
        return out
    if _MARK.search(end):
        out["state"] = "marked"
        return out
    left, signs = automaton(body)
    out["signs"] = sorted(signs) or None
    if left and left[-1][1] < len(body) - len(last):
        out["hang"] = left[-1][0]
    bare = last
    if _ELLIPSIS.search(end):
        out["state"], bare = "ellipsis", _ELLIPSIS.sub("", body).rstrip()
        bare = bare[bare.rfind("\n") + 1 :]
    elif left and not out["hang"]:
        out["state"] = "broken"
        return out
    else:
        for name, p in _TAILS:
            if m := p.search(last):
                out["state"], out["tail"] = "open", name
                out["line"] = _key(m["item"])
                bare = m["item"]
                break
        else:
            if body.rstrip(_CLOSERS)[-1:] in _STOPS and not re.search(r"^\s*\d{1,3}\.$", last):
                return out
            out["state"] = "open"
    out["line"] = out["line"] if out["tail"] else _key(bare)
    t = tokens(bare)
    if t:
        out["last1"], out["cjk"] = t[-1], bool(_CJK.search(t[-1]))
        out["last2"] = " ".join(t[-2:]) if len(t) > 1 else None
    if text != body and text[len(body) :].count("\n") and out["state"] == "open":
        out["state"] = "done"  # it goes on to a new line: the last one is whole
    return out


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns not given are null."""
    cols = [pa.array(columns[c], _TYPES[_KINDS[c]]) if c in columns else pa.nulls(n, _TYPES[_KINDS[c]]) for c in _NAMES]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def _scan(batches):
    known, said = Counter(), Counter()  # keys of lines, by texts; lines, by occurrences
    ends, total = Counter(), Counter()

    def count():
        """Words and pairs of words of the lines seen, each distinct line once."""
        for x, n in said.items():
            item = _ITEM.sub("", x)
            for s in _SENTENCE.split(item):
                if t := tokens(s):
                    for w in t:
                        total[w] += n
                    two = [f"{p} {q}" for p, q in zip(t, t[1:])]
                    for w in two:
                        total[w] += n
                    ends[t[-1]] += n
                    if two:
                        ends[two[-1]] += n
        said.clear()

    def counted():
        count()
        yield _rows(len(known), kind=[LINE] * len(known), line=list(known), total=list(known.values()))
        yield _rows(len(total), kind=[TOKEN] * len(total), last1=list(total), ends=[ends[k] for k in total], total=list(total.values()))
        known.clear(), ends.clear(), total.clear()

    for b in batches:
        raw = b.column("text").to_pylist()
        texts = [normalise(x) for x in raw]
        values = [_anatomy(x) for x in texts]
        n = len(raw)
        sizes = [len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in raw]
        given = {c: b.column(c) for c in ("table_name", "record_id", "field_name", "source")}
        told = {c: [v[c] for v in values] for c in ("state", "expects", "tail", "line", "last1", "last2", "cjk", "signs", "hang")}
        yield _rows(n, kind=[VALUE] * n, chars=[len(x) for x in raw], bytes=sizes, digest=[_digest(x) for x in raw], total=[1] * n, **given, **told)
        for v, text in zip(values, texts):
            parts = [x for x in map(str.strip, text.rstrip().split("\n")) if x]
            if v["state"] != "done" and parts:  # of an unfinished last line, only whole sentences tell where sentences end
                head, stop, _ = parts[-1].rpartition(". ") if ". " in parts[-1] else parts[-1].rpartition("。")
                parts[-1:] = [head + stop] if stop else []
            said.update(parts)
            known.update({_key(_ITEM.sub("", x)) for x in parts})
        if len(said) > 50_000:
            count()
        if len(total) + len(known) > 400_000:
            yield from counted()
    if known or said:
        yield from counted()


def _limits(values: DataFrame, share: float, least: int) -> DataFrame:
    """``table_name, source, unit, size``: the lengths at which a source cuts, in ``chars``, ``bytes``, where cuts go back to a
    word's end ``near``, and where they go back to a character's end ``cut``. An exact length counts that at least ``share`` of the source's distinct texts have
    with an unfinished end, ``least`` or more, a strong part of all texts of its neighbourhood, and that few texts exceed.
    A near length counts if a tenth of the source's unfinished texts lie within 4 characters of it, and few are longer.

    A source that cuts on bytes without splitting a character stops up to 3 bytes below its limit. Its ``cut``, one a source, is
    derived from all unfinished texts in [limit - 3, limit]: they must be ``share`` of its texts, and among those that have
    characters of several bytes and don't stop at a limit in characters, ``least`` and half of the neighbourhood."""
    whole = values.groupBy("table_name", "source", "digest").agg(F.first("chars").alias("chars"), F.first("bytes").alias("bytes"), F.max(F.when(F.col("state") != "done", 1).otherwise(0)).alias("odd"), F.max(F.when(F.col("state").isin("open", "ellipsis"), 1).otherwise(0)).alias("loose"))
    by_unit = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")])
    by = whole.select("table_name", "source", "odd", F.explode(by_unit).alias("x")).groupBy("table_name", "source", "x.unit", "x.size").agg(F.count("*").alias("n"), F.sum("odd").alias("odd"))
    every = whole.groupBy("table_name", "source").agg(F.count("*").alias("texts"), F.sum("odd").alias("odd_texts"))
    # lengths of a source are few, however many its texts are
    lengths = Window.partitionBy("table_name", "source", "unit").orderBy("size")
    longer, near = lengths.rangeBetween(12, Window.unboundedFollowing), lengths.rangeBetween(-4, 4)
    bins = by.withColumn("bin", (F.col("size") / 40).cast("bigint")).withColumns({"longer": F.coalesce(F.sum("n").over(longer), F.lit(0)), "odd_near": F.sum("odd").over(near)})
    around = bins.groupBy("table_name", "source", "unit", "bin").agg(F.sum("n").alias("bin_n"))
    bins = bins.join(around, ["table_name", "source", "unit", "bin"]).join(every, ["table_name", "source"])
    exact = bins.where((F.col("odd") >= least) & (F.col("odd") >= share * F.col("texts")) & (F.col("n") * 8 >= F.col("bin_n")) & F.expr("longer <= greatest(2, 0.3 * n)"))
    near = bins.where((F.col("unit") == "chars") & (F.col("odd_near") > least) & (F.col("odd_near") * 10 >= F.col("odd_texts")) & F.expr("longer <= greatest(2, 0.3 * odd_near)"))
    cols = ["table_name", "source", "unit", "size"]
    by_chars = exact.where("unit = 'chars'").select("table_name", "source", F.col("size").alias("chars"), F.lit(1).alias("by_chars"))
    wide = F.when((F.col("loose") == 1) & (F.col("bytes") > F.col("chars")) & F.col("by_chars").isNull(), 1).otherwise(0)
    steps = whole.join(by_chars, ["table_name", "source", "chars"], "left").groupBy("table_name", "source", F.col("bytes").alias("size")).agg(F.count("*").alias("n"), F.sum("loose").alias("loose"), F.sum(wide).alias("wide"))
    sizes = Window.partitionBy("table_name", "source").orderBy("size")
    below, about = sizes.rangeBetween(1 - UTF8, 0), sizes.rangeBetween(-23, 16)
    steps = steps.withColumns({"longer": F.coalesce(F.sum("n").over(sizes.rangeBetween(12, Window.unboundedFollowing)), F.lit(0)), "n_below": F.sum("loose").over(below), "wide_below": F.sum("wide").over(below), "wide_about": F.sum("wide").over(about)})
    steps = steps.join(every, ["table_name", "source"])
    strong = (F.col("wide_below") >= least) & (F.col("n_below") >= share * F.col("texts")) & (F.col("wide_below") * 2 >= F.col("wide_about")) & (F.col("wide") * 8 >= F.col("wide_below")) & F.expr("longer <= greatest(2, 0.3 * n_below)")
    cut = steps.where(strong).groupBy("table_name", "source").agg(F.max_by("size", F.struct("wide_below", -F.col("size"))).alias("size"))
    return exact.select(*cols).unionByName(near.withColumn("unit", F.lit("near")).select(*cols)).unionByName(cut.withColumn("unit", F.lit("cut")).select(*cols))


def truncated(values: DataFrame, share: float = 0.015, least: int = 4) -> DataFrame:
    """``table_name, record_id, field_name, source, reason``: the values that stop inside a word, sentence or line.

    ``values``: ``table_name, record_id, field_name, source, text``. Null, empty and blank texts are no cases, nor is a
    finished text, whatever its length or last character. Rows delivered again count once; rows with a null id
    are left out; a null source is a source of its own.
    """
    slim = values.select("table_name", F.col("record_id").cast("bigint").alias("record_id"), "field_name", F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    slim = slim.where(F.col("record_id").isNotNull() & F.col("text").isNotNull()).distinct()
    parts = materialise(slim.mapInArrow(_scan, _SCHEMA), "anatomy")
    value = parts.where(F.col("kind") == VALUE)
    known = parts.where((F.col("kind") == LINE) & (F.length("line") > 0)).groupBy("line").agg(F.sum("total").alias("known"))
    token = parts.where(F.col("kind") == TOKEN).groupBy("last1").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total"))
    limits = _limits(value.where("chars > 0"), share, least)
    # how often values end with a terminator: of the field, and of a source with enough values
    fair = value.where("state in ('done', 'open') and tail is null and chars > 1")
    by_field = fair.groupBy("table_name", "field_name").agg(F.avg(F.when(F.col("state") == "done", 1.0).otherwise(0.0)).alias("field_done"))
    by_source = fair.groupBy("table_name", "field_name", "source").agg(F.avg(F.when(F.col("state") == "done", 1.0).otherwise(0.0)).alias("source_done"), F.count("*").alias("_n"))
    by_source = by_source.where("_n >= 30").drop("_n")
    # a sign that an earlier line opens and nothing closes tells of a cut where texts of the table seldom leave it open
    hung = value.where("signs is not null").select("table_name", F.explode("signs").alias("sign"), "hang").groupBy("table_name", "sign").agg(F.count("*").alias("_all"), F.count_if(F.col("sign") == F.col("hang")).alias("_open"))
    odd = hung.where((F.col("_open") > 0) & (F.col("_open") <= HANGS * (F.col("_all") + 20))).select("table_name", F.col("sign").alias("hang"))
    hanging = value.where("hang is not null and state <> 'broken'").join(odd, ["table_name", "hang"], "left_semi")
    doubt = value.where("state in ('ellipsis', 'open')").drop("kind", "ends", "total", "digest", "signs", "hang")
    lim = limits.groupBy("table_name", "source").pivot("unit", ["chars", "bytes", "near", "cut"]).agg(F.collect_set("size"))
    doubt = doubt.join(lim.select("table_name", "source", F.col("chars").alias("l_chars"), F.col("bytes").alias("l_bytes"), F.col("near").alias("l_near"), F.array_max("cut").alias("l_cut")), ["table_name", "source"], "left")
    doubt = doubt.withColumn("near_limit", F.coalesce(F.array_contains("l_near", F.col("chars")), F.lit(False))).drop("l_near")
    at_cut = F.coalesce((F.col("l_cut") - F.col("bytes")).between(0, UTF8 - 1), F.lit(False))
    doubt = doubt.withColumn("at_limit", F.coalesce(F.array_contains("l_chars", F.col("chars")), F.lit(False)) | F.coalesce(F.array_contains("l_bytes", F.col("bytes")), F.lit(False)) | at_cut).drop("l_chars", "l_bytes", "l_cut")
    doubt = doubt.join(by_field, ["table_name", "field_name"], "left").join(by_source, ["table_name", "field_name", "source"], "left").join(known, "line", "left")
    one = token.select("last1", F.col("ends").alias("e1"), F.col("total").alias("t1"))
    two = token.select(F.col("last1").alias("last2"), F.col("ends").alias("e2"), F.col("total").alias("t2"))
    wanted = doubt.where("last1 is not null and not cjk").select("last1").distinct()
    words = token.where(~F.contains("last1", F.lit(" ")) & (F.col("total") >= 5) & (F.length("last1") <= 40))
    heads = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("last1") - 1, F.lit(1))), lambda i: F.substring("last1", F.lit(1), i))).alias("head"), "last1", "total")
    heads = heads.where("head <> last1").select(F.col("head").alias("last1"), F.col("total").alias("n")).join(wanted, "last1", "left_semi").groupBy("last1").agg(F.sum("n").alias("longer"))
    j = doubt.join(one, "last1", "left").join(two, "last2", "left").join(heads, "last1", "left").fillna({"known": 0, "t1": 0, "e1": 0, "t2": 0, "e2": 0, "longer": 0})
    inside = ~F.col("cjk") & (F.col("t1") <= F.greatest(F.lit(2), F.col("longer") / 500)) & (F.col("longer") >= 5) & F.col("last1").isNotNull()
    seldom = ((F.col("t2") >= 8) & (F.col("e2") < 0.02 * F.col("t2"))) | ((F.col("t2") < 8) & (F.col("t1") >= 20) & (F.col("e1") < 0.02 * F.col("t1")))
    prose = F.coalesce(F.col("field_done") >= 0.5, F.lit(False)) | F.coalesce(F.col("source_done") >= 0.8, F.lit(False))
    tail, is_open = F.col("tail"), F.col("state") == "open"
    reason = (
        F.when(tail == "note", None)
        .when(tail.isNotNull() & F.col("at_limit") & (F.col("known") == 0), "limit")
        .when(tail.isin("list", "menu") & (F.col("known") == 0) & inside, "word")
        .when(tail.isNotNull(), None)
        .when(F.col("at_limit") & ((is_open & (prose | (F.col("expects") == 1))) | (F.col("state") == "ellipsis")), "limit")
        .when(F.col("near_limit") & (F.col("state") == "ellipsis"), "limit")
        .when(is_open & prose, "terminator")
        .when(F.col("known") > 0, None)
        .when(F.col("at_limit"), "limit")
        .when(is_open & (F.col("expects") == 1), "terminator")
        .when(inside, "word")
        .when(seldom, "line")
    )
    cols = ["table_name", "record_id", "field_name", F.when(F.col("source") != "", F.col("source")).alias("source")]
    plain = value.where("state in ('broken', 'marked')").select(*cols, F.when(F.col("state") == "broken", "broken").otherwise("mark").alias("reason"))
    ended = j.withColumn("reason", reason).where("reason is not null").select(*cols, "reason")
    found = plain.unionByName(ended).unionByName(hanging.select(*cols, F.lit("unclosed").alias("reason")))
    return found.groupBy("table_name", "record_id", "field_name", "source").agg(F.min("reason").alias("reason"))
