"""Runs of consecutive events with the same utterance, each collapsed into one event.

Method: boundary interval lookup. Rows are range-sorted by entity, version (highest first) and position; in every chunk
(an Arrow batch of a sorted partition) the positions where a run starts go into one sorted array, each event finds its
run in it by binary search, and counts, ends and times are aggregated per run. A run that is open at a chunk's end is
carried into the next one; runs at the edges of partitions, at most two a partition, are joined in a last step, so
neither a long entity nor a long run is ever held by one task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, parallelism

_MARKS = re.compile("[̀-ͯ]")
_PAUSE = r"[っッ]?\s*[-‐-―−.,、。・…]+[\s\-‐-―−.,、。・…]*"
#: A stammered start: a phrase, pause, and the phrase again; or a word's first letters, pause, and the word.
_STAMMER = (
    re.compile(rf"^([^\W_].{{0,60}}){_PAUSE}(?=\1(?:\W|$))"),
    re.compile(rf"^([^\W\d_]{{1,2}}){_PAUSE}(?=\1)"),
    re.compile(r"^([^\W\d_]{1,14})[-‐-―]+\s*(?=\1)"),
)
_LEAD = re.compile(r"^[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_REPEAT = re.compile(r"([^\W\d_])\1+")
_LONG = re.compile("[ーｰ〜~～]+$")
_KANA = re.compile("[぀-ヿ㐀-鿿]")
#: Spellings of umlauts and their plain letters count as one.
_DIGRAPH = re.compile("([aou])e")


def utterance(text: str | None) -> tuple[str, ...] | None:
    """The words of a text, without regard to case, width, accents, punctuation, spacing marks, stretched letters and
    stammered starts. None for a null or blank text. A text without any word, such as a lone note sign, is itself."""
    if text is None:
        return None
    s = unicodedata.normalize("NFKC", text).casefold()
    if not s.strip():
        return None
    s = unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", s)))
    s = _LEAD.sub("", s)
    while (m := next(filter(None, (p.match(s) for p in _STAMMER)), None)) is not None:
        s = s[m.end() :]
    if _KANA.search(s):
        s = "".join(_WORD.findall(_LONG.sub("", re.sub(r"[^\wー]+", "", s.replace("〜", "")))))
        s = _LONG.sub("", re.sub("ー+", "ー", s))
        return (s,) if s else ("", text.strip())
    return tuple(_WORD.findall(s)) or ("", text.strip())


def _plain(word: str) -> str:
    return _DIGRAPH.sub(r"\1", _REPEAT.sub(r"\1", word))


def misspelt(a: str, b: str) -> bool:
    """One word is the other with a letter left out, or with two neighbouring letters swapped. A different letter makes
    another word, and so does any difference in a number."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) < 4 or len(a) - len(b) > 1 or not (a.isalpha() and b.isalpha()):
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    return i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]


def alike(a: str, b: str) -> bool:
    """Spellings of one word: misspelt in some form, or misspelt twice, by a swap and by a swap or a letter left out."""
    x, y = _plain(a), _plain(b)
    if misspelt(x, y) or misspelt(a, b) or misspelt(_REPEAT.sub(r"\1", a), _REPEAT.sub(r"\1", b)):
        return True
    short, long = sorted((_REPEAT.sub(r"\1", a), _REPEAT.sub(r"\1", b)), key=len)
    if min(len(x), len(y)) < 5 or len(long) - len(short) > 2 or Counter(short) - Counter(long):
        return False  # a letter of its own makes another word
    for u, v in ((a, y), (b, x)):
        for i in range(len(u) - 1):
            if u[i] != u[i + 1]:
                t = _plain(u[:i] + u[i + 1] + u[i] + u[i + 2 :])
                if t == v or misspelt(t, v):
                    return True
    return False


class Form:
    """An utterance with what comparing it needs, worked out once."""

    __slots__ = ("words", "plain", "joined", "bound")

    def __init__(self, words: tuple[str, ...]):
        self.words = words
        #: Only equal ones are the same: lone signs, and text in kana.
        self.bound = not words[0] or bool(_KANA.search(words[0]))
        self.plain = () if self.bound else tuple(map(_plain, words))
        self.joined = "".join(self.plain)

    def same(self, other: Form) -> bool:
        if self.words == other.words:
            return True
        if self.bound or other.bound:
            return False
        if self.joined == other.joined:
            return True
        a, b = self.words, other.words
        if len(a) != len(b) or len(a) < 2:
            return False
        odd = [i for i, (x, y) in enumerate(zip(self.plain, other.plain)) if x != y]
        return len(odd) <= 2 and all(alike(a[i], b[i]) for i in odd)


def _letter_by_letter(text: str | None) -> tuple[str, ...] | None:
    return ("", text) if text and text.strip() else None


def same_utterance(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return Form(a).same(Form(b))


RUN_SCHEMA = "part int, edge int, entity string, version int, first_pos int, last_pos int, n bigint, from_ms bigint, to_ms bigint, seq int, head string, forms array<string>"
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()))
#: bits of edge: the run holds the first, the last event of its partition; the row only says how the partition ends or begins
FIRST, LAST = 1, 2


_FAR = np.iinfo(np.int64).max


def _least(a, b, f=min):
    return b if a is None else a if b is None else f(a, b)


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Number of each row's value, -1 for null, and the values."""
    d = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def _times(column: pa.Array, rows: np.ndarray, empty: int) -> np.ndarray:
    return pc.fill_null(column, empty).to_numpy(zero_copy_only=False)[rows]


def _scan(batches, read=utterance):
    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
    known: dict[str, Form | None] = {}
    entity = version = None
    last = None  # position and key of the last row
    spoken: dict[tuple, tuple[Form, str]] = {}  # the distinct forms of the open run, each with a text that has it
    run = None  # the open run: [entity, version, first, last, n, from, to, number, head text, forms, edge]
    lead = None  # entity and version of the partition's first event
    made = 0

    def form(text):
        if text not in known:
            if len(known) > 50_000:
                known.clear()
            words = read(text)
            known[text] = Form(words) if words else None
        return known[text]

    def row(r):
        told = r[10] or (r[0], r[1]) == lead  # what a run torn before this partition may be compared with
        return (part, r[10], *r[:8], r[8] if told else None, [t for _, t in r[9].values()] if told else None)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)

    for b in batches:
        if not b.num_rows:
            continue
        (ent, ent_of), (key, key_of), (text, text_of) = (_codes(b.column(c)) for c in ("entity", "row_key", "text"))
        ver, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("version", "pos"))
        # an entity's first row has its highest version; rows alike in position and key are the same record
        new = np.concatenate([[ent_of[ent[0]] != entity], ent[1:] != ent[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(ent)), 0))
        top = np.where((head == 0) & ~new[0], version if version is not None else 0, ver[head])
        again = np.concatenate([[not new[0] and last == (ver[0], pos[0], key_of[key[0]] if key[0] >= 0 else None)], (ent[1:] == ent[:-1]) & (ver[1:] == ver[:-1]) & (pos[1:] == pos[:-1]) & (key[1:] == key[:-1])])
        keep = np.flatnonzero((ver == top) & ~again)
        entity, version, last = ent_of[ent[-1]], int(top[-1]), (ver[-1], pos[-1], key_of[key[-1]] if key[-1] >= 0 else None)
        if not len(keep):
            continue
        # where a text isn't the one before it in its entity a run may start; there forms are compared
        said = text[keep]
        forms_of = [form(x) for x in text_of]
        number: dict = {}
        kind = np.array([number.setdefault(f.words, k) if f else -1 for k, f in enumerate(forms_of)] + [-1])[said]
        whose = ent[keep]
        first = np.concatenate([[run is None or ent_of[whose[0]] != run[0]], whose[1:] != whose[:-1]])
        may = np.flatnonzero(first | (kind < 0) | np.concatenate([[True], kind[1:] != kind[:-1]]))
        starts, forms = [], []
        for i in may.tolist():
            now = forms_of[said[i]] if kind[i] >= 0 else None
            if first[i] or now is None or not (now.words in spoken or any(x.same(now) for x, _ in spoken.values())):
                spoken = {}
                starts.append(i)
                forms.append(spoken)
            if now is not None:
                spoken.setdefault(now.words, (now, text_of[said[i]]))
        start = np.array(starts, np.int64)  # sorted run-start positions of the chunk
        run_of = np.searchsorted(start, np.arange(len(keep)), "right") - 1  # -1: goes on with the carried run
        bounds = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]]))
        size = np.diff(np.append(bounds, len(keep)))
        lo, hi = np.minimum.reduceat(_times(b.column("start_ms"), keep, _FAR), bounds), np.maximum.reduceat(_times(b.column("end_ms"), keep, -_FAR), bounds)
        out = []
        for x, n, v, w in zip(bounds.tolist(), size.tolist(), lo.tolist(), hi.tolist()):
            i, j, k = int(keep[x]), int(keep[x + n - 1]), int(run_of[x])
            n, v, w = n if kind[x] >= 0 else 0, None if v == _FAR else v, None if w == -_FAR else w
            if k < 0:
                run[3], run[4] = int(pos[j]), run[4] + n
                run[5], run[6] = _least(run[5], v), _least(run[6], w, max)
                continue
            if run is not None and (run[4] > 0 or run[10] or (run[0], run[1]) == lead):
                out.append(row(run))
            run, made = [ent_of[ent[i]], int(top[i]), int(pos[i]), int(pos[j]), n, v, w, made, text_of[text[i]] if text[i] >= 0 else None, forms[k], 0], made + 1
            if lead is None:
                run[10], lead = FIRST, (run[0], run[1])
        if out:
            yield batch(out)
    if run is not None:
        run[10] |= LAST
        yield batch([row(run)])


def _joined(edges: list, run_at: Callable[[int, int], dict | None], read=utterance) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Joins the runs at the edges of neighbouring partitions; drops versions superseded in an earlier partition.

    A torn run is compared as inside a partition, by all its forms; if it goes on over a partition's first run, the next
    ones (``run_at(part, seq)``) are compared too. Second result: ``part, seq`` of the runs that came to a torn one so.
    """
    done, taken, open_run, top = [], [], None, None

    def goes_on(r):
        """Whether r belongs to the open run; it is added then."""
        now = read(r["head"])
        if now is None or not (now in forms or any(same_utterance(x, now) for x in forms)):
            return False
        forms.update(map(read, r["forms"]))
        open_run["last_pos"], open_run["n"] = r["last_pos"], open_run["n"] + r["n"]
        open_run["from_ms"], open_run["to_ms"] = _least(open_run["from_ms"], r["from_ms"]), _least(open_run["to_ms"], r["to_ms"], max)
        return True

    forms: set = set()
    for r in sorted(edges, key=lambda x: (x["part"], -(x["edge"] & FIRST))):
        if (top and top[0] == r["entity"] and top[1] != r["version"]) or (r["part"], r["seq"]) in taken:
            continue
        top = (r["entity"], r["version"])
        last = r["edge"] & LAST
        if r["edge"] & FIRST and open_run and open_run["entity"] == r["entity"] and goes_on(r):
            seq = r["seq"]
            while not last and (x := run_at(r["part"], seq + 1)) and (x["entity"], x["version"]) == top and goes_on(x):
                seq, last = x["seq"], x["edge"] & LAST
                taken.append((r["part"], seq))
        else:
            if open_run:
                done.append(open_run)
            open_run, forms = r, {u for u in map(read, r["forms"]) if u is not None}
        if not last:
            done.append(open_run)
            open_run = None
    done += [open_run] if open_run else []
    return [tuple(x[k] for k in ("entity", "version", "first_pos", "last_pos", "n", "from_ms", "to_ms")) for x in done if x["n"]], taken


def collapse_runs(df: DataFrame, entity: str, version: str, pos: str, text: str, start: str, end: str, key: str, read_time: Callable[[Column], Column] = lambda c: c, exact: bool = False) -> DataFrame:
    """One row per longest run of consecutive events with the same utterance in each entity's highest version.

    Result: entity, version, first_pos, last_pos, n (records), from_ms and to_ms (least start and greatest end of its
    events with a known time, null where none is). Single events give runs of one; null and blank texts give none
    and end a run. Ties in ``pos`` are ordered by ``key``; rows alike in ``pos`` and ``key`` are one record. Rows
    with a null entity, version or position are left out; an empty table gives an empty result. Other columns aren't read.
    ``read_time`` turns a start or end into milliseconds; it is applied behind the sort, so that the sampling of the
    sort's bounds doesn't have to evaluate it. ``exact``: only texts alike letter by letter are the same utterance.

    An event belongs to the open run if it is alike to any of the run's forms so far. Where a run is torn between partitions
    its forms are carried on, so the number of partitions doesn't change the result.
    """
    spark, read = df.sparkSession, _letter_by_letter if exact else utterance
    slim = df.select(
        F.col(entity).cast("string").alias("entity"),
        F.col(version).cast("int").alias("version"),
        F.col(pos).cast("int").alias("pos"),
        F.col(key).cast("string").alias("row_key"),
        F.col(text).alias("text"),
        F.col(start).alias("start_ms"),
        F.col(end).alias("end_ms"),
    ).where("entity is not null and version is not null and pos is not null")
    order = ["entity", F.desc("version"), "pos", "row_key"]
    ranged = slim.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({c: read_time(F.col(c)).cast("bigint") for c in ("start_ms", "end_ms")})
    runs = materialise(ranged.mapInArrow(lambda batches: _scan(batches, read), RUN_SCHEMA), "runs")
    # at most two rows per partition of the sort, with the forms of their runs
    rows = [x.asDict() for x in runs.where("edge > 0").collect()]
    run_at = lambda part, seq: next((x.asDict() for x in runs.where(f"part = {part} and seq = {seq}").collect()), None)
    edges, taken = _joined(rows, run_at, read)
    schema = "entity string, version int, first_pos int, last_pos int, n bigint, from_ms bigint, to_ms bigint"
    whole = _without(runs.where("edge = 0 and n > 0"), ["part", "version", "entity"], [(p, v, e) for p, e, v in _superseded(rows)])
    whole = _without(whole, ["part", "seq"], taken)
    return whole.select("entity", "version", "first_pos", "last_pos", "n", "from_ms", "to_ms").unionByName(spark.createDataFrame(edges, schema))


def _without(df: DataFrame, cols: list[str], rows: list[tuple]) -> DataFrame:
    """Rows that aren't among the few of ``rows``, at most one or two a partition; nothing is sent around for that."""
    keys = ["\x1f".join(map(str, r)) for r in rows]
    return df.where(~F.concat_ws("\x1f", *cols).isin(keys)) if keys else df


def _superseded(edges: list[dict]) -> list[tuple[int, str, int]]:
    """Entities at a partition's beginning whose higher version ended an earlier partition: at most one a partition."""
    top, out = None, []
    for r in sorted(edges, key=lambda x: (x["part"], -(x["edge"] & FIRST))):
        if top and top[0] == r["entity"] and r["version"] < top[1]:
            out.append((r["part"], r["entity"], r["version"]))
        else:
            top = (r["entity"], r["version"])
    return out
