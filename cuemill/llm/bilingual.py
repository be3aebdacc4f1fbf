"""Pairs of lines that say the same in a text and its rough translation.

Method, over whole corpora:

1. Clauses (lines, cut where lines were joined) are aligned by length with dynamic programming; numbers help. One-to-one
   beads inside undisturbed stretches are the confident pairs.
2. Word-translation probabilities come from these pairs by expectation-maximisation (each word of the translation is
   explained by the words of the original), distributed: every pass sums expected counts where the pairs lie and
   aggregates them by word pair. Entries of a glossary count as pairs too.
3. Each text is aligned again by dynamic programming with lexical scores, with beads of 1-1, 1-2 and 2-1 clauses and
   omissions on either side. What was moved, and so isn't in order, is matched afterwards by best mutual score, parts
   of divided lines by what they still lack; a line that recurs pairs occurrence by occurrence.

The lexicon is counted before it is sent anywhere. Up to ``SMALL`` entries go to all tasks; a larger one stays a table, is
joined to the pairs by word pair in each round, and to the texts by word in the end. Nothing is left out of it either way.

No size changes a row. Counts are whole numbers of ``UNIT`` parts and probabilities whole numbers of ``GRAIN`` parts, so their sums are
exact in any order, whichever way the lexicon goes. A text of more than ``PIECE`` clauses is aligned as a whole too: only
its likenesses are worked out a square at a time, and rows of the dynamic programming are worked out again for the way back.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from math import isqrt
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .codepoints import ragged

#: Entries of a lexicon that is sent to all tasks (20 bytes each).
SMALL = 2_000_000
ROUNDS = 4
#: Parts of a count and of a probability.
UNIT, GRAIN = 1 << 24, 1 << 30
#: Clauses of a text on either side whose likenesses are worked out at once.
PIECE = 1_500

_WORD = re.compile(r"[^\W_]+")
_JOIN = re.compile(r"\s+/\s+|[;；]\s*|　+")
#: Commas may join two lines or stand inside one: cut for aligning, where pieces can meet again, but not for training.
_SOFT_JOIN = re.compile(_JOIN.pattern + r"|,\s+and\s+(?=\S)|,\s+(?=[A-ZÁÉÍÓÚÑÄÖÜ])")
_NOTE = re.compile(r"^(?:\[[^\]]*\]|\([^)]*\)|[~*=_\-–—]+.*|\*.*|.*translated by.*|translator'?s note.*)$", re.I)
_KATA = re.compile("[ァ-ヺー]{2,}")
_DIGIT = re.compile(r"\d")
_NONE: frozenset = frozenset()
_ACCENT = re.compile("[\u0300-\u036f]+")
_KANA = re.compile("[぀-ヿ㐀-鿿]")


# ---- tokens ---------------------------------------------------------------------------------------------------------
def _kana_table() -> dict[str, str]:
    """Katakana to Latin letters by rule: rows of five vowels behind a consonant."""
    out = {}
    rows = {"": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サシスセソ", "z": "ザジズゼゾ", "t": "タチツテト", "d": "ダヂヅデド", "n": "ナニヌネノ"}
    rows |= {"h": "ハヒフヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "r": "ラリルレロ"}
    for c, row in rows.items():
        out |= {k: c + v for k, v in zip(row, "aiueo")}
    out |= {k: "y" + v for k, v in zip("ヤユヨ", "auo")} | {"ワ": "wa", "ヲ": "o", "ン": "n", "ヴ": "vu", "フ": "fu", "ジ": "ji", "シ": "shi", "チ": "chi", "ツ": "tsu", "ー": "", "ッ": ""}
    return out


_ROMAN = _kana_table()
_SMALL = dict(zip("ァィゥェォャュョ", ("a", "i", "u", "e", "o", "ya", "yu", "yo")))


def romanise(kata: str) -> str:
    out = ""
    for c in kata:
        if c in _SMALL:
            v = _SMALL[c]
            if out.endswith(("shi", "ji", "chi")):
                out = out[:-1] + v.lstrip("y")
            elif out.endswith("u") and len(out) == 1 or out.endswith(("au", "iu", "uu", "eu", "ou")):
                out = out[:-1] + "w" + v
            elif out:
                out = out[:-1] + v
            else:
                out = v
        else:
            out += _ROMAN.get(c, "")
    return out


def skeleton(name: str) -> str:
    """Letters of a name that survive transcription into kana and back."""
    s = name.lower().replace("qu", "k").replace("q", "k").replace("l", "r").replace("c", "k")
    return re.sub(r"(.)\1", r"\1", s.replace("u", ""))


def tokens(text: str) -> list[str]:
    """Words without case and accents; numbers; of kana and kanji, every pair of neighbours, and names in katakana by skeleton."""
    if text.isascii():
        return _WORD.findall(text.casefold())
    text = unicodedata.normalize("NFKC", text)
    out = []
    if _KANA.search(text):
        for name in _KATA.findall(text):
            if len(name) >= 3:
                out.append("N:" + skeleton(romanise(name)))
        text = _KATA.sub(lambda m: m[0] if len(m[0]) < 3 else "・", text)
    s = _ACCENT.sub("", unicodedata.normalize("NFKD", text.casefold()))
    for w in _WORD.findall(unicodedata.normalize("NFC", s)):
        if w[0].isascii() or not _KANA.search(w):
            out.append(w)
        else:
            for part in re.findall(r"\d+|\D+", w):
                if part[0].isdigit():
                    out.append(part)
                else:
                    out += [part[i : i + 2] for i in range(len(part) - 1)] or [part]
    return out


def token_id(t: str) -> int:
    return zlib.crc32(t.encode())


class Words:
    """Words seen so far, by number of appearance, with what aligning needs of each."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.rows: list[tuple[int, bool, bool, int]] = []

    def add(self, t: str) -> int:
        if (k := self.at.get(t)) is None:
            k = self.at[t] = len(self.rows)
            # its number, is it a number, is it a name in kana, and the number it would have as such a name
            self.rows.append((token_id(t), t.isdigit(), t.startswith("N:"), token_id("N:" + skeleton(t))))
        return k

    def arrays(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int64, bool, bool, np.int64)
        return tuple(np.array(c, k) for c, k in zip(zip(*self.rows), kinds)) if self.rows else tuple(np.zeros(0, k) for k in kinds)


class Clause:
    """What aligning needs of a clause, worked out when asked for, and once for all its occurrences."""

    __slots__ = ("text", "size", "numbers", "_words", "_at")

    def __init__(self, text: str, words: Words):
        self.text, self.size, self._words, self._at = text, len(text), words, None
        self.numbers = frozenset(filter(str.isdigit, self.tokens())) if _DIGIT.search(text) else _NONE

    def tokens(self) -> list[str]:
        return tokens(self.text)

    def at(self) -> tuple[int, ...]:
        """Its words, as places in the table of words; equal for clauses of the same words."""
        if self._at is None:
            self._at = tuple(map(self._words.add, self.tokens()))
        return self._at

    def words(self) -> list[int]:
        rows = self._words.rows
        return sorted({rows[k][0] for k in self.at() if not rows[k][1]})


# ---- clauses --------------------------------------------------------------------------------------------------------
def lines_of(raw: str | None) -> list[str]:
    if not raw:
        return []
    text = raw.replace("\\r", "\r").replace("\\n", "\n").replace("\r\n", "\n").replace("\r", "\n")
    return [x.strip() for x in text.split("\n") if x.strip()]


def _cut(line: str, join: re.Pattern) -> list[str]:
    return [] if _NOTE.match(line) else [p.strip() for p in join.split(line) if p and p.strip(" ,.、。")]


def clauses(lines: list[str], join: re.Pattern = _SOFT_JOIN) -> list[tuple[int, str]]:
    """(line, clause): headings and notes left out, joined lines cut where they were joined."""
    return [(i, p) for i, x in enumerate(lines) for p in _cut(x, join)]


class Reader:
    """Clauses of texts. Lines recur in editions of a text, so a task remembers what it has worked out."""

    def __init__(self, join: re.Pattern):
        self.join, self.lines, self.known, self.words = join, {}, {}, Words()

    def refresh(self) -> None:
        """Between batches: forgets what it knows when that has become much."""
        if len(self.lines) > 100_000:
            self.lines, self.known, self.words = {}, {}, Words()

    def read(self, raw: str | None) -> tuple[int, list[tuple[int, Clause]]]:
        """Number of lines, and (line, clause)."""
        lines, out = lines_of(raw), []
        for i, x in enumerate(lines):
            if (got := self.lines.get(x)) is None:
                got = self.lines[x] = [self.clause(p) for p in _cut(x, self.join)]
            out += [(i, c) for c in got]
        return len(lines), out

    def clause(self, text: str) -> Clause:
        if (c := self.known.get(text)) is None:
            c = self.known[text] = Clause(text, self.words)
        return c


def _interned(sets: list[frozenset], seen: dict) -> np.ndarray:
    """A number for each set, the same for equal ones; 0 for the empty set."""
    return np.array([seen.setdefault(x, len(seen) + 1) if x else 0 for x in sets], np.int64)


def _blocks(n: int, m: int, piece: int) -> list[tuple[int, int]]:
    """Rows of a dynamic programming that are held at once: few of them, or few blocks of them."""
    size = max(piece * piece // (m + 1), isqrt(n), 2)
    return [(a, min(a + size, n)) for a in range(0, n, size)]


def by_length(o: list[Clause], e: list[Clause], piece: int = PIECE) -> list[tuple[int, int]]:
    """Confident one-to-one pairs: dynamic programming over lengths, numbers weighing in. Of more than ``piece`` squared cells, only
    the row before each block of rows is kept, and the blocks are worked out again from the last to the first."""
    n, m = len(o), len(e)
    if not n or not m:
        return []
    lo, le = np.array([x.size for x in o], float), np.array([x.size for x in e], float)
    ratio = le.sum() / lo.sum()
    seen: dict = {}
    no, ne = _interned([x.numbers for x in o], seen), _interned([x.numbers for x in e], seen)

    def rows(a, b, before):
        gain = 1.0 - 1.5 * np.abs(np.log((le[None, :] + 4) / (lo[a:b, None] * ratio + 4)))
        gain += np.where((no[a:b, None] > 0) | (ne[None, :] > 0), np.where(no[a:b, None] == ne[None, :], 1.5, -2.0), 0.0)
        best = np.zeros((b - a + 1, m + 1))
        best[0] = before
        for i in range(b - a):
            row = np.maximum(best[i, 1:], best[i, :-1] + gain[i] - 0.3)
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(row, 0))
        return gain, best

    blocks, before = _blocks(n, m, piece), [np.zeros(m + 1)]
    for a, b in blocks[:-1]:
        before.append(rows(a, b, before[-1])[1][-1].copy())
    i, j, path = n, m, []
    for a, b in reversed(blocks):
        gain, best = rows(a, b, before.pop())
        up = best[1:] == best[:-1]
        left = best[:, 1:] == best[:, :-1]
        while i > a and j:
            if up[i - a - 1, j]:
                i -= 1
            elif left[i - a, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                path.append((i, j, gain[i - a, j]))
    path.reverse()
    have = {(i, j) for i, j, _ in path}
    sure = []
    for i, j, g in path:
        anchored = no[i] > 0 and no[i] == ne[j]
        calm = (i - 1, j - 1) in have and (i + 1, j + 1) in have
        if g > 0.2 and (anchored or calm):
            sure.append((i, j))
    return sure


# ---- lexicon --------------------------------------------------------------------------------------------------------
_LOW = np.int64((1 << 32) - 1)


def _expect(sent):
    """Expected counts of word pairs over Arrow batches of confident pairs; uniform where there is no lexicon yet. What the
    lexicon doesn't hold explains nothing."""

    def run(batches):
        lex = sent.value if sent is not None else None  # keys, sorted, and t(e | f)
        for b in batches:
            if not b.num_rows:
                continue
            f, e = b.column("f"), b.column("e")
            fv, ev = f.flatten().to_numpy(zero_copy_only=False), e.flatten().to_numpy(zero_copy_only=False)
            nf, ne = (np.diff(x.offsets.to_numpy()) for x in (f, e))
            weight = b.column("n").to_numpy(zero_copy_only=False).astype(float)
            f0, e0 = np.cumsum(nf) - nf, np.cumsum(ne) - ne
            # for each word of the translation, all words of its original
            word = ragged(e0, ne)
            pair = np.repeat(np.arange(b.num_rows), ne)
            each = nf[pair]
            key = fv[ragged(f0[pair], each)] << 32 | np.repeat(ev[word], each)
            group = np.repeat(np.arange(len(word)), each)
            if lex is not None:
                at = np.minimum(np.searchsorted(lex[0], key), max(len(lex[0]) - 1, 0))
                held = np.flatnonzero(lex[0][at] == key) if len(lex[0]) else at[:0]
                key, group, p = key[held], group[held], lex[1][at[held]]
            else:
                p = np.ones(len(key))
            c = np.rint(weight[pair[group]] * p / np.bincount(group, p, len(word))[group] * UNIT).astype(np.int64)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.add.reduceat(c[order], first) if len(key) else c)], ["key", "c"])

    return run


def _expect_by_join(pairs: DataFrame, lex: DataFrame) -> DataFrame:
    """The same with a lexicon of any size: word pairs of the lines joined to it by key, then each word of a line's translation
    with what explains it there."""
    words = pairs.select("pair", "n", F.explode("f").alias("f"), "e").select("pair", "n", "f", F.explode("e").alias("e"))
    held = words.withColumn("key", F.shiftleft("f", 32).bitwiseOR(F.col("e"))).join(lex.select("key", "t"), "key")
    word = held.groupBy("pair", "e").agg(F.first("n").alias("n"), F.sum("t").alias("total"), F.collect_list(F.struct("key", "t")).alias("x"))
    each = word.select("n", "total", F.explode("x").alias("x"))
    return each.select("x.key", F.rint(F.col("n") * F.col("x.t") / F.col("total") * F.lit(float(UNIT))).cast("bigint").alias("c"))


def _sendable(lex: DataFrame, small: int):
    """The lexicon as sorted arrays (key, t, c) for all tasks, or None if it has more than ``small`` entries."""
    if lex.count() > small:
        return None
    table = lex.select("key", "t", "c").toArrow()
    key, t, c = (table.column(x).to_numpy() for x in ("key", "t", "c"))
    order = np.argsort(key)
    return key[order], t[order], c[order]


def train(pairs: DataFrame, rounds: int = ROUNDS, small: int = SMALL) -> DataFrame:
    """``key, t, c``: t(e | f) and expected count, in parts, by pair of words, f in the key's high half. ``pairs``: ``f array<bigint>,
    e array<bigint>, n`` and a number ``pair`` of each row that stays the same when it is read again. Entries of t up to 0.002
    or a count up to 0.05 are noise and fall out in each round."""
    lex = None
    for _ in range(rounds):
        arrays = _sendable(lex, small) if lex is not None else None
        if lex is None or arrays is not None:
            sent = pairs.sparkSession.sparkContext.broadcast(arrays[:2]) if arrays is not None else None
            counts = pairs.select("f", "e", "n").mapInArrow(_expect(sent), "key bigint, c bigint")
        else:
            counts = _expect_by_join(pairs, lex)
        counts = counts.groupBy("key").agg(F.sum("c").alias("c")).withColumn("f", F.shiftrightunsigned("key", 32))
        total = counts.groupBy("f").agg(F.sum("c").alias("total"))
        t = F.rint(F.col("c") / F.col("total") * F.lit(float(GRAIN))) / F.lit(float(GRAIN))
        lex = materialise(counts.join(total, "f").select("key", t.alias("t"), "c").where((F.col("t") > F.lit(0.002)) & (F.col("c") > F.lit(0.05 * UNIT))), "lexicon")
    return lex


class Originals:
    """For each word of the translation, the originals that explain it: those with a hundredth or more of what explains
    it in all, so a hundred at most. A rare original, which takes all it meets for its translation, has a small part."""

    def __init__(self, key: np.ndarray, t: np.ndarray, c: np.ndarray):
        f, e = key >> 32 & _LOW, key & _LOW
        order = np.lexsort((-c, e))
        f, e, t, c = f[order], e[order], t[order], c[order]
        words, inv = np.unique(e, return_inverse=True)
        total = np.add.reduceat(c, np.searchsorted(e, words)) if len(c) else c
        ok = (c >= 0.01 * total[inv]) & (t >= 0.02)
        self.f, e = f[ok], e[ok]
        self.e, self.start = np.unique(e, return_index=True)
        self.size = np.diff(np.append(self.start, len(e)))

    def of(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``e``, original), for all originals of all of ``e``."""
        if not len(self.e):
            return e[:0], e[:0]
        at = np.minimum(np.searchsorted(self.e, e), len(self.e) - 1)
        known = np.flatnonzero(self.e[at] == e)
        size = self.size[at[known]]
        return np.repeat(known, size), self.f[ragged(self.start[at[known]], size)]


def _originals_by_join(texts: DataFrame, lex: DataFrame) -> DataFrame:
    """``record_id, e, f``: the same for each text, as arrays side by side, from a lexicon of any size. What is gathered for a text
    are pairs of its own words."""
    share = lex.withColumns({"f": F.shiftrightunsigned("key", 32), "e": F.col("key").bitwiseAND(F.lit(int(_LOW)))})
    total = share.groupBy("e").agg(F.sum("c").alias("total"))
    useful = share.join(total, "e").where((F.col("c") >= F.lit(0.01) * F.col("total")) & (F.col("t") >= F.lit(0.02))).select("e", "f")

    def words(batches):
        reader = Reader(_SOFT_JOIN)
        for b in batches:
            reader.refresh()
            for side, name in enumerate(("og", "en")):
                ids, ws = [], []
                for r, x in zip(b.column("record_id").to_pylist(), b.column(name).to_pylist()):
                    mine = {w for _, c in reader.read(x)[1] for w in c.words()}
                    ids += [r] * len(mine)
                    ws += mine
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([side] * len(ids), pa.int32()), pa.array(ws, pa.int64())], ["record_id", "side", "w"])

    said = texts.mapInArrow(words, "record_id bigint, side int, w bigint").distinct()
    met = said.where("side = 1").select("record_id", F.col("w").alias("e")).join(useful, "e")
    met = met.join(said.where("side = 0").select("record_id", F.col("w").alias("f")), ["record_id", "f"])
    return met.groupBy("record_id").agg(F.collect_list(F.struct("e", "f")).alias("x")).select("record_id", F.col("x.e").alias("e"), F.col("x.f").alias("f"))


# ---- lexical alignment ----------------------------------------------------------------------------------------------
def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in wanted, position in keys) of those of ``wanted`` that are in the sorted ``keys``."""
    if not len(keys):
        return wanted[:0], wanted[:0]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    return hit, at[hit]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class _Side:
    """Words of one side of a batch of texts: of each occurrence its clause and weight, and the distinct words of each text."""

    def __init__(self, texts: list[list[Clause]], words: Words, weigh):
        self.every = every = [c for t in texts for c in t]
        self.n = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.n) - self.n
        sizes = np.array([len(c.at()) for c in every], np.int64)
        place = np.fromiter(chain.from_iterable(c.at() for c in every), np.int64, int(sizes.sum()))
        ids, self.digit, self.name, other = (x[place] for x in words.arrays())
        self.text_of = np.repeat(np.arange(len(texts)), self.n)
        self.clause = np.repeat(np.arange(len(every)), sizes)
        self.weight = weigh(ids, self.digit | self.name)
        self.sum = np.bincount(self.clause, self.weight, len(every))
        base = self.text_of[self.clause] << 32
        self.key, at, self.word = np.unique(base | ids, return_index=True, return_inverse=True)
        self.digit, self.name, self.id, self.base = self.digit[at], self.name[at], ids[at], base[at]
        self.other = self.base | other[at]
        self.order = np.argsort(self.word, kind="stable")  # occurrences of a word
        self.start = np.searchsorted(self.word[self.order], np.arange(len(self.key) + 1))
        pair = _distinct(self.word * max(len(every), 1) + self.clause)  # clauses of a word
        self.in_word, self.in_clause = pair // max(len(every), 1), pair % max(len(every), 1)
        self.c_start = np.searchsorted(self.in_word, np.arange(len(self.key) + 1))
        self.size = np.array([c.size for c in every], float)

    def clauses_of(self, words):
        n = self.c_start[words + 1] - self.c_start[words]
        return np.repeat(np.arange(len(words)), n), self.in_clause[ragged(self.c_start[words], n)]

    def occurrences_of(self, words):
        n = self.start[words + 1] - self.start[words]
        return np.repeat(np.arange(len(words)), n), self.order[ragged(self.start[words], n)]


class Aligner:
    """Aligns texts with their translations, many at once: all that concerns single words, cells or rows of the dynamic
    programming is done for a whole batch of texts in numpy."""

    def __init__(self, weights: dict[int, float], originals: Originals | None = None, piece: int = PIECE):
        self.originals, self.reader, self.piece = originals, Reader(_SOFT_JOIN), piece
        self.w_id = np.array(sorted(weights), np.int64)
        self.w = np.array([weights[x] for x in sorted(weights)], float)

    def _weigh(self, ids: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), 3.0)
        hit, at = _lookup(self.w_id, ids)
        out[hit] = self.w[at]
        out[fixed] = 3.0
        return out

    def align(self, texts: list[tuple], given: list[tuple] | None = None) -> list[set[tuple[int, int]]]:
        """Pairs of lines of each ``(original, translation)``. ``given``: of each text, the words of its translation and
        their originals, side by side, where there is no lexicon at hand."""
        out: list[set] = [set() for _ in texts]
        work, cells = [], 0
        self.reader.refresh()
        self.words = self.reader.words
        for k, (og, en) in enumerate(texts):
            lines_o, co = self.reader.read(og)
            lines_e, ce = self.reader.read(en)
            if co and ce and max(len(co), len(ce)) > self.piece:
                self._long((k, co, ce, lines_o, lines_e), given, out)
            elif co and ce:
                work.append((k, co, ce, lines_o, lines_e))
                cells += len(co) * len(ce)
            if cells > 300_000:
                self._some(work, given, out)
                work, cells = [], 0
        if work:
            self._some(work, given, out)
        return out

    def _cells(self, o: _Side, e: _Side, given: list | None) -> tuple[np.ndarray, ...]:
        """Where the cells of each text begin, and of each cell the weight of what clause i explains in clause j and of what of clause i
        is said in clause j, their shares of the clauses, the likeness, and whether numbers contradict each other."""
        base = np.cumsum(o.n * e.n) - o.n * e.n
        cell = lambda i, j: base[o.text_of[i]] + (i - o.first[o.text_of[i]]) * e.n[o.text_of[i]] + j - e.first[e.text_of[j]]
        total = int((o.n * e.n).sum())
        # which word of a translation stands for which of its original: the same, one that explains it, or the same name
        plain = np.flatnonzero(~e.digit)
        if given is None:
            at, f = self.originals.of(e.id[plain])
            word_e, want = plain[at], e.base[plain[at]] | f
        else:
            pieces = [(k << 32 | np.asarray(x[0], np.int64), k << 32 | np.asarray(x[1], np.int64)) for k, x in enumerate(given) if x is not None]
            said, want = (np.concatenate([p[i] for p in pieces]) if pieces else np.zeros(0, np.int64) for i in (0, 1))
            at, word_e = _lookup(e.key, said)
            at, word_e = at[~e.digit[word_e]], word_e[~e.digit[word_e]]
            want = want[at]
        word_e = np.concatenate([np.arange(len(e.key)), word_e])
        want = np.concatenate([e.key, want])
        at, word_o = _lookup(o.key, want)
        at, word_o = at[~o.name[word_o]], word_o[~o.name[word_o]]
        named, name_o = _lookup(o.key, e.other[plain])
        named, name_o = named[o.name[name_o]], name_o[o.name[name_o]]
        word_e, word_o = np.concatenate([word_e[at], plain[named]]), np.concatenate([word_o, name_o])
        # weight of what clause i explains in clause j, and of what of clause i is said in clause j
        at, i = o.clauses_of(word_o)
        pair = _distinct(word_e[at] * len(o.sum) + i)
        at, t = e.occurrences_of(pair // len(o.sum))
        said_e = np.bincount(cell((pair % len(o.sum))[at], e.clause[t]), e.weight[t], total)
        at, j = e.clauses_of(word_e)
        pair = _distinct(word_o[at] * len(e.sum) + j)
        at, t = o.occurrences_of(pair // len(e.sum))
        back = np.bincount(cell(o.clause[t], (pair % len(e.sum))[at]), o.weight[t], total)
        row = np.repeat(np.arange(len(o.sum)), e.n[o.text_of])
        col = ragged(e.first[o.text_of], e.n[o.text_of])
        seen: dict = {}
        no = _interned([c.numbers for c in o.every], seen)[row]
        ne = _interned([c.numbers for c in e.every], seen)[col]
        clash = (no > 0) & (ne > 0) & (no != ne)
        cov_e, cov_o = said_e / np.maximum(e.sum[col], 1e-9), back / np.maximum(o.sum[row], 1e-9)
        return base, said_e, back, cov_e, cov_o, 0.5 * (cov_e + cov_o) - 0.6 * clash, clash

    def _some(self, work, given, out):
        for _, c in chain.from_iterable(x[1] + x[2] for x in work):
            c.at()
        o, e = (_Side([[c for _, c in x[side]] for x in work], self.words, self._weigh) for side in (1, 2))
        base, said_e, back, cov_e, cov_o, full, clash = self._cells(o, e, given and [given[x[0]] for x in work])
        order = np.lexsort((o.n, e.n))
        for a in range(0, len(order), 48):
            some = order[a : a + 48]
            paths = _paths([(int(o.n[k]), int(e.n[k])) for k in some], *(_padded(x, some, base, o.n, e.n) for x in (said_e, back, cov_e, cov_o, full, clash)), _padded_row(o.sum, some, o), _padded_row(e.sum, some, e))
            for k, pairs in zip(some.tolist(), paths):
                n, m = int(o.n[k]), int(e.n[k])
                cut = lambda x: x[base[k] : base[k] + n * m].reshape(n, m)  # noqa: B023, E731
                self._finish(work[k], pairs, _Dense(*map(cut, (cov_e, cov_o, full, clash))), o.sum[o.first[k] : o.first[k] + n], e.sum[e.first[k] : e.first[k] + m], out)

    def _long(self, one, given, out):
        """The same rows for one text of any number of clauses, without all its cells at once."""
        k, co, ce, _, _ = one
        sides, weights, of = [], [], []
        for cs in (co, ce):
            kinds: dict = {}
            of.append(np.array([kinds.setdefault((c.at(), c.numbers), (len(kinds), c))[0] for _, c in cs], np.int64))
            every = [c for _, c in kinds.values()]
            sides.append([_Side([every[a : a + self.piece]], self.words, self._weigh) for a in range(0, len(every), self.piece)])
            weights.append(np.concatenate([x.sum for x in sides[-1]])[of[-1]])
        kept, given = [], given and [given[k]]
        for a, o in enumerate(sides[0]):
            for b, e in enumerate(sides[1]):
                cells = self._cells(o, e, given)[1:]
                at = np.flatnonzero(np.maximum(cells[2], cells[3]) > 0.56)
                i, j = np.divmod(at, len(e.sum))
                kept.append((a * self.piece + i, b * self.piece + j, *(x[at] for x in cells)))
        cells = _Sparse(*of, *map(np.concatenate, zip(*kept)))
        self._finish(one, _path(cells, *weights, self.piece), cells, *weights, out)

    def _finish(self, one, pairs, cells, wo, we, out):
        t, co, ce, lines_o, lines_e = one
        found = self._rest(pairs, cells, wo, we)
        n, m = len(co), len(ce)
        if min(n, m) >= 4 and len({i for i, _ in found}) < 0.35 * min(n, m):
            return  # a few likenesses, but no translation of this text
        found = _whole(co, ce, _recur(co, ce, found), lines_o, lines_e)
        out[t].update((co[i][0], ce[j][0]) for i, j in found)

    @staticmethod
    def _rest(pairs, cells, wo, we):
        """What the path leaves over: moved clauses, and parts of divided ones."""
        n, m = len(wo), len(we)
        used_o, used_e = np.zeros(n, bool), np.zeros(m, bool)
        if pairs:
            x, y = np.array(pairs).T
            used_o[x] = used_e[y] = True
        # moved clauses: best score first, both still free
        x, y, full = cells.alike(~used_o, ~used_e)
        for k in np.argsort(-full, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            if not used_o[i] and not used_e[j]:
                pairs.append((i, j))
                used_o[i] = used_e[j] = True
        # divided ones: a clause that is wholly said by a longer one, and says what its partners don't
        lack_o, lack_e = np.ones(n), np.ones(m)
        if pairs:
            x, y = np.array(pairs).T
            cov_e, cov_o = cells.shares(x, y)
            np.subtract.at(lack_o, x, cov_o), np.subtract.at(lack_e, y, cov_e)
        for j in np.flatnonzero(~used_e & (we >= 2.0)).tolist():
            i, c, d, clash = cells.column(j)
            ok = np.flatnonzero((c >= 0.7) & (lack_o[i] >= 0.6 * d) & (d >= 0.2) & ~clash)
            if len(ok):
                v = c[ok] + 0.3 * np.minimum(lack_o[i[ok]], d[ok]) - 0.01 * np.abs(i[ok] / n - j / m)
                best = ok[np.flatnonzero(v == v.max())[-1]]
                i, d = int(i[best]), d[best]
                pairs.append((i, j))
                used_o[i] = used_e[j] = True
                lack_o[i] -= d
        for i in np.flatnonzero(~used_o & (wo >= 2.0)).tolist():
            j, d, c, clash = cells.line(i)
            ok = np.flatnonzero((c >= 0.7) & (lack_e[j] >= 0.6 * d) & (d >= 0.2) & ~clash)
            if len(ok):
                v = c[ok] + 0.3 * np.minimum(lack_e[j[ok]], d[ok]) - 0.01 * np.abs(i / n - j[ok] / m)
                best = ok[np.flatnonzero(v == v.max())[-1]]
                j, d = int(j[best]), d[best]
                pairs.append((i, j))
                lack_e[j] -= d
        return pairs


class _Dense:
    """Cells of a text, all of them."""

    def __init__(self, cov_e, cov_o, full, clash):
        self.cov_e, self.cov_o, self.full, self.clash = cov_e, cov_o, full, clash
        self.i, self.j = map(np.arange, full.shape)

    def line(self, i):
        return self.j, self.cov_e[i], self.cov_o[i], self.clash[i]

    def column(self, j):
        return self.i, self.cov_e[:, j], self.cov_o[:, j], self.clash[:, j]

    def shares(self, x, y):
        return self.cov_e[x, y], self.cov_o[x, y]

    def alike(self, free_o, free_e):
        """Cells of a likeness of 0.6 or more, line by line."""
        x, y = np.nonzero((self.full >= 0.6) & free_o[:, None] & free_e[None, :])
        return x, y, self.full[x, y]


class _Places:
    """Where the clauses of each kind stand."""

    def __init__(self, of: np.ndarray):
        self.of, self.at = of, np.argsort(of, kind="stable")
        self.size = np.bincount(of)
        self.first = np.cumsum(self.size) - self.size

    def spread(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, index into ``kinds``) of all clauses of these kinds, in order of place."""
        n = self.size[kinds]
        place, index = self.at[ragged(self.first[kinds], n)], np.repeat(np.arange(len(kinds)), n)
        order = np.argsort(place)
        return place[order], index[order]


class _Sparse:
    """Cells of a text by kinds of clauses, equal ones being of a kind: those where either share is over 0.56. No other cell can be in a
    bead (likeness over 0.57, or both parts covered to over 0.6), be moved (0.6) or divided (0.7)."""

    def __init__(self, of_o, of_e, i, j, said_e, back, cov_e, cov_o, full, clash):
        self.o, self.e = _Places(of_o), _Places(of_e)
        order = np.lexsort((j, i))
        self.i, self.j, self.said_e, self.back, self.cov_e, self.cov_o, self.full, self.clash = (x[order] for x in (i, j, said_e, back, cov_e, cov_o, full, clash))
        self.key = self.i * len(self.e.size) + self.j
        self.of_line = np.searchsorted(self.i, np.arange(len(self.o.size) + 1))
        self.down = np.lexsort((self.i, self.j))
        self.of_column = np.searchsorted(self.j[self.down], np.arange(len(self.e.size) + 1))

    def entries(self, i, which=None):
        """Clauses of the translation that line i has cells with, in order, and those cells."""
        k = self.o.of[i]
        at = np.arange(self.of_line[k], self.of_line[k + 1])
        at = at[which[at]] if which is not None else at
        place, index = self.e.spread(self.j[at])
        return place, at[index]

    def line(self, i):
        j, at = self.entries(i)
        return j, self.cov_e[at], self.cov_o[at], self.clash[at]

    def column(self, j):
        k = self.e.of[j]
        at = self.down[self.of_column[k] : self.of_column[k + 1]]
        i, index = self.o.spread(self.i[at])
        at = at[index]
        return i, self.cov_e[at], self.cov_o[at], self.clash[at]

    def shares(self, x, y):
        at = np.searchsorted(self.key, self.o.of[x] * len(self.e.size) + self.e.of[y])
        return self.cov_e[at], self.cov_o[at]

    def alike(self, free_o, free_e):
        which = (self.full >= 0.6) & (np.bincount(self.e.of, free_e) > 0)[self.j]
        x, y, full = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in np.flatnonzero(free_o).tolist():
            j, at = self.entries(i, which)
            free = free_e[j]
            x.append(np.full(int(free.sum()), i)), y.append(j[free]), full.append(self.full[at[free]])
        return tuple(map(np.concatenate, (x, y, full)))


def _path(cells: _Sparse, wo: np.ndarray, we: np.ndarray, piece: int) -> list[tuple[int, int]]:
    """``_paths`` for one text of any length, from the cells that can count. Of the rows, the two before each block are kept, and the
    blocks are worked out again, with their steps, from the last to the first."""
    n, m = len(wo), len(we)

    def row(i, older, old):
        """Row i + 1 from rows i - 1 and i, and its steps; None if all of them are omissions of clause i."""
        j, at = cells.entries(i)
        v, s = old[1:].copy(), np.ones(m, np.int8)
        one = cells.full[at] - 0.55
        k = j[one > 0.02]
        new = old[k] + one[one > 0.02]
        up = new > v[k]
        v[k[up]], s[k[up]] = new[up], 3
        # clause i against j and j + 1 together
        k = np.flatnonzero(j[1:] == j[:-1] + 1)
        a, b, k = at[k], at[k + 1], j[k]
        ok = (np.minimum(cells.cov_e[a], cells.cov_e[b]) > 0.6) & (np.maximum(cells.cov_o[a], cells.cov_o[b]) < 0.8)
        a, b, k = a[ok], b[ok], k[ok]
        wide = 0.5 * ((cells.said_e[a] + cells.said_e[b]) / np.maximum(we[k] + we[k + 1], 1e-9) + np.minimum(1.0, cells.cov_o[a] + cells.cov_o[b]))
        wide -= 0.6 * (cells.clash[a] | cells.clash[b]) + 0.45
        new = old[k] + wide
        up = new > v[k + 1] + 0.05
        v[k[up] + 1], s[k[up] + 1] = new[up], 4
        if i:  # and i - 1 and i together against j
            before, at_before = cells.entries(i - 1)
            k, a, b = np.intersect1d(before, j, assume_unique=True, return_indices=True)
            a, b = at_before[a], at[b]
            ok = (np.minimum(cells.cov_o[a], cells.cov_o[b]) > 0.6) & (np.maximum(cells.cov_e[a], cells.cov_e[b]) < 0.8)
            a, b, k = a[ok], b[ok], k[ok]
            tall = 0.5 * (np.minimum(1.0, cells.cov_e[a] + cells.cov_e[b]) + (cells.back[a] + cells.back[b]) / np.maximum(wo[i - 1] + wo[i], 1e-9))
            tall -= 0.6 * (cells.clash[a] | cells.clash[b]) + 0.45
            new = older[k] + tall
            up = new > v[k] + 0.05
            v[k[up]], s[k[up]] = new[up], 5
        if not (s > 1).any():
            return old, None
        top = np.maximum.accumulate(v)
        s[1:][top[:-1] > v[1:]] = 2
        return np.concatenate([[0.0], top]), s

    blocks = _blocks(n, m, piece)
    older = old = np.zeros(m + 1)
    before = []
    for a, b in blocks:
        before.append((older, old))
        for i in range(a, b) if b < n else ():
            older, old = old, row(i, older, old)[0]
    i, j, pairs = n, m, []
    for a, b in reversed(blocks):
        older, old = before.pop()
        steps = []
        for r in range(a, b):
            new, s = row(r, older, old)
            older, old = old, new
            steps.append(s)
        while i > a and j:
            s = steps[i - a - 1]
            s = 1 if s is None else s[j - 1]
            if s == 1:
                i -= 1
            elif s == 2:
                j -= 1
            elif s == 3:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif s == 4:
                i, j = i - 1, j - 2
                pairs += [(i, j + 1), (i, j)]
            else:
                i, j = i - 2, j - 1
                pairs += [(i + 1, j), (i, j)]
    return pairs


def _padded(flat: np.ndarray, some: np.ndarray, base: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = np.zeros((len(some), int(n[some].max()), int(m[some].max())), flat.dtype)
    for x, k in enumerate(some):
        out[x, : n[k], : m[k]] = flat[base[k] : base[k] + n[k] * m[k]].reshape(n[k], m[k])
    return out


def _padded_row(flat: np.ndarray, some: np.ndarray, side: _Side) -> np.ndarray:
    out = np.zeros((len(some), int(side.n[some].max())))
    for x, k in enumerate(some):
        out[x, : side.n[k]] = flat[side.first[k] : side.first[k] + side.n[k]]
    return out


def _paths(shapes, said_e, back, cov_e, cov_o, full, clash, wo, we) -> list[list[tuple[int, int]]]:
    """Dynamic programming over all texts of a batch side by side, a row at a time: beads of 1-1, 1-2 and 2-1 clauses, and
    omissions, which cost nothing. Within a row, omissions on the translation's side are a running maximum."""
    many, n, m = full.shape
    one = np.where(full - 0.55 > 0.02, full - 0.55, -9.0)
    # clause i against j and j + 1 together, and i and i + 1 against j; only if both parts say little of the whole each
    wide = 0.5 * ((said_e[:, :, :-1] + said_e[:, :, 1:]) / np.maximum(we[:, None, :-1] + we[:, None, 1:], 1e-9) + np.minimum(1.0, cov_o[:, :, :-1] + cov_o[:, :, 1:]))
    wide -= 0.6 * (clash[:, :, :-1] | clash[:, :, 1:]) + 0.45
    wide[~((np.minimum(cov_e[:, :, :-1], cov_e[:, :, 1:]) > 0.6) & (np.maximum(cov_o[:, :, :-1], cov_o[:, :, 1:]) < 0.8))] = -9.0
    tall = 0.5 * (np.minimum(1.0, cov_e[:, :-1] + cov_e[:, 1:]) + (back[:, :-1] + back[:, 1:]) / np.maximum(wo[:, :-1, None] + wo[:, 1:, None], 1e-9))
    tall -= 0.6 * (clash[:, :-1] | clash[:, 1:]) + 0.45
    tall[~((np.minimum(cov_o[:, :-1], cov_o[:, 1:]) > 0.6) & (np.maximum(cov_e[:, :-1], cov_e[:, 1:]) < 0.8))] = -9.0
    best = np.zeros((n + 1, many, m + 1))
    step = np.zeros((n + 1, many, m + 1), np.int8)
    step[0, :, 1:] = 2
    step[1:, :, 0] = 1
    any_wide, any_tall = (wide > 0).any(axis=(0, 2)), (tall > 0).any(axis=(0, 2))
    for i in range(n):
        v, s = best[i, :, 1:].copy(), np.ones((many, m), np.int8)
        new = best[i, :, :-1] + one[:, i]
        up = new > v
        v[up], s[up] = new[up], 3
        if any_wide[i]:
            new = best[i, :, :-2] + wide[:, i]
            up = np.zeros_like(up)
            up[:, 1:] = new > v[:, 1:] + 0.05
            v[up], s[up] = new[up[:, 1:]], 4
        if i and any_tall[i - 1]:
            new = best[i - 1, :, :-1] + tall[:, i - 1]
            up = new > v + 0.05
            v[up], s[up] = new[up], 5
        top = np.maximum.accumulate(v, axis=1)
        s[:, 1:][top[:, :-1] > v[:, 1:]] = 2
        best[i + 1, :, 1:], step[i + 1, :, 1:] = top, s
    out = []
    for k, (i, j) in enumerate(shapes):
        way, width, pairs = step[:, k].tobytes(), m + 1, []
        while i or j:
            s = way[i * width + j]
            if s == 1:
                i -= 1
            elif s == 2:
                j -= 1
            elif s == 3:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif s == 4:
                i, j = i - 1, j - 2
                pairs += [(i, j + 1), (i, j)]
            else:
                i, j = i - 2, j - 1
                pairs += [(i + 1, j), (i, j)]
        out.append(pairs)
    return out


def _whole(co, ce, pairs, lines_o, lines_e):
    """Without the pairs of a text's last line that was cut off with under a third left: it is far shorter than
    its partner lets expect, and nobody else says the rest."""
    last_o, last_e = co[-1][0] == lines_o - 1, ce[-1][0] == lines_e - 1
    if not pairs or not any(i == len(co) - 1 and last_o or j == len(ce) - 1 and last_e for i, j in pairs):
        return pairs
    size = sorted(ce[j][1].size / co[i][1].size for i, j in pairs)
    ratio = size[len(size) // 2]
    with_o, with_e = Counter(i for i, _ in pairs), Counter(j for _, j in pairs)
    out = []
    for i, j in pairs:
        share = ce[j][1].size / (co[i][1].size * ratio)
        cut_e = last_e and j == len(ce) - 1 and share < 1 / 3 and with_o[i] == 1
        cut_o = last_o and i == len(co) - 1 and share > 3 and with_e[j] == 1
        if not cut_e and not cut_o:
            out.append((i, j))
    return out


def _recur(co, ce, pairs):
    """Of an original clause that recurs, the first occurrence takes the first of the partners, and so on; and a
    partner that stands in the translation more often than it is needed is taken where it stands first."""
    kinds: dict[tuple, list] = {}
    for i, (_, c) in enumerate(co):
        kinds.setdefault(c.at(), []).append(i)
    same: dict[tuple, list] = {}
    for j, (_, c) in enumerate(ce):
        same.setdefault(c.at(), []).append(j)
    by_o: dict[int, list] = {}
    for i, j in pairs:
        by_o.setdefault(i, []).append(j)
    taken = {j for _, j in pairs}
    out = []
    for occ in kinds.values():
        units = [sorted(by_o[i]) for i in occ if i in by_o]
        for u in units:
            for k, j in enumerate(u):
                for free in same[ce[j][1].at()]:
                    if free >= j:
                        break
                    if free not in taken:
                        taken.discard(j), taken.add(free)
                        u[k] = free
                        break
        for i, u in zip(occ, sorted(units)):
            out += [(i, j) for j in u]
    return out


# ---- the operator ---------------------------------------------------------------------------------------------------
_PAIRS = "f array<bigint>, e array<bigint>, text bigint"


def _pair_batch(fs, es, texts):
    return pa.RecordBatch.from_arrays([pa.array(fs, pa.list_(pa.int64())), pa.array(es, pa.list_(pa.int64())), pa.array(texts, pa.int64())], ["f", "e", "text"])


def aligned_lines(df: DataFrame, record_id: str, original: str, translation: str, glossary: DataFrame | None = None, small: int = SMALL, piece: int = PIECE) -> DataFrame:
    """``record_id, og_line, en_line``: pairs of lines where the translation's line, or a part of it, translates the
    original's line or a part of it. Lines count from 0 over those that aren't blank.

    A record with a null, empty or blank text on either side gives no rows; so does a translation of something else. A
    last line of which under a third is left pairs with nothing. Rows delivered again count once; rows with a null
    id are left out. ``glossary``: ``og_term, en_term``, may hold nulls and repetitions. ``small``: entries up to which the
    lexicon is sent to all tasks; beyond, it is joined. ``piece``: clauses of a text whose likenesses are worked out at once.
    Neither changes a row.
    """
    spark = df.sparkSession
    texts = df.select(df[record_id].cast("bigint").alias("record_id"), df[original].cast("string").alias("og"), df[translation].cast("string").alias("en"))
    texts = texts.where("record_id is not null and og is not null and en is not null")

    def sure(batches):
        reader = Reader(_JOIN)
        for b in batches:
            reader.refresh()
            fs, es, ts = [], [], []
            for og, en, text in zip(*(b.column(c).to_pylist() for c in ("og", "en", "text"))):
                o, e = ([c for _, c in reader.read(x)[1]] for x in (og, en))
                for i, j in by_length(o, e, piece):
                    f, t = o[i].words(), e[j].words()
                    if f and t:
                        fs.append(f), es.append(t), ts.append(text)
            if fs:
                yield _pair_batch(fs, es, ts)

    # the same text under many ids, or delivered again, counts once: lines are counted by the texts they stand in
    pairs = texts.select("og", "en", F.xxhash64("og", "en").alias("text")).mapInArrow(sure, _PAIRS)
    if glossary is not None:

        def terms(batches):
            words = Words()
            for b in batches:
                rows = [(Clause(x, words).words(), Clause(y, words).words()) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x and y]
                rows = [r for r in rows if r[0] and r[1]]
                if rows:
                    yield _pair_batch(*zip(*rows), [0] * len(rows))

        pairs = pairs.unionByName(glossary.select("og_term", "en_term").distinct().mapInArrow(terms, _PAIRS))
    lines = pairs.groupBy("f", "e", "text").agg(F.count("*").alias("twice"))
    pairs = materialise(lines.groupBy("f", "e").agg(F.count("*").cast("double").alias("n")).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    lex = train(pairs, small=small)
    # weight of a token: the rarer, the more it says; common ones that aren't in the table weigh least
    seen = pairs.select(F.explode(F.concat("f", "e")).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    count = pairs.agg(F.sum("n")).first()[0] or 1.0
    common = seen.where(F.col("n") > 0.002 * count).select("t", F.least(F.lit(3.0), F.greatest(F.lit(0.15), F.lit(0.6) * F.log(F.lit(0.6 * count) / F.col("n")))).alias("w"))
    weights = {r[0]: r[1] for r in common.collect()}  # tokens of more than a 500th of all lines: some thousands at most
    arrays = _sendable(lex, small)
    if arrays is None:
        texts = texts.join(_originals_by_join(texts, lex), "record_id", "left")
    sent = spark.sparkContext.broadcast((weights, Originals(*arrays) if arrays is not None else None))

    def pair_up(batches):
        aligner = Aligner(*sent.value, piece=piece)
        for b in batches:
            ids, *both = (b.column(c).to_pylist() for c in ("record_id", "og", "en"))
            given = None if aligner.originals else [(e, f) if e else None for e, f in zip(*(b.column(c).to_pylist() for c in ("e", "f")))]
            rows = [(r, i, j) for r, pairs in zip(ids, aligner.align(list(zip(*both)), given)) for i, j in sorted(pairs)]
            if rows:
                x, y, z = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int32()), pa.array(z, pa.int32())], ["record_id", "og_line", "en_line"])

    return texts.mapInArrow(pair_up, "record_id bigint, og_line int, en_line int").distinct()
