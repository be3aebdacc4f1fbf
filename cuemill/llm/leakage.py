"""Evaluation passages that leaked into training texts.

Method: Wu-Manber multi-pattern search over normalised symbols, then extension with edits.

* Texts become symbols that don't depend on layout, case, markup, accents or width: words where a passage is written in
  words, single characters where it is written in kana and kanji.
* Each passage is cut into disjoint pieces of ``m`` symbols. If a stretch of the required length has no more edits than
  allowed, one piece in it is untouched (there are more whole pieces in it than edits), so exact search loses nothing.
* A shift table over blocks of symbols says how far a position can be skipped; where the shift is 0, the block's hash
  bucket gives the pieces that end so, and direct comparison confirms them. Many cursors, one per stretch of the text,
  run through an Arrow batch side by side as numpy arrays.
* Hits are extended in both directions with the furthest-reaching paths of each number of edits.

The passages are few and go to every task; if they are more than ``PATTERN_BUDGET`` characters, they are worked off in
groups of that size, one pass over the corpus each. The corpus isn't shuffled at all.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import flatten, ragged
from .tokenizer import piece_hashes

#: Characters of passages that one pass carries to every task.
PATTERN_BUDGET = 20_000_000
SLICE = 2_000_000
DROP, BREAK, WORD, CJK = 0, 1, 2, 3

_CUE = re.compile(r"(?m)^[^\S\n]*(?:\d+[^\S\n]*\r?\n[^\S\n]*)?(?:\d{1,3}:)?\d{1,3}:\d{2}[,.:]\d{1,3}[^\S\n]*-->[^\n]*$")
_INLINE = re.compile(r"</?(?:i|b|u|s|em|strong|font|span|mark|a|c|v|ruby|rt|small|sup|sub)(?:[ .][^<>]{0,120})?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>|\{\\[^{}]{0,60}\}")
_STAMP = re.compile(r"\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\]|<\d{1,3}:\d{2}(?:[.:]\d{1,3})?>")


def strip_markup(text: str) -> str:
    """The text without subtitle numbering and times, tags, style codes, entities and escaped line breaks."""
    if "-->" in text:
        text = _CUE.sub(" ", text.replace("\r\n", "\n"))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", _STAMP.sub(" ", text)))
    elif "{\\" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _STAMP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = re.sub(r"\\[rnt]", " ", text)
    return text


class FoldTable:
    """Per code point: its folded code point and what it is, filled in as code points turn up."""

    def __init__(self):
        self.to, self.kind = np.zeros(0x110000, np.uint32), np.full(0x110000, 255, np.uint8)

    def _fill(self, x: int):
        s = unicodedata.normalize("NFKD", chr(x)).casefold()
        s = [c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)] or [""]
        c = s[0]
        self.to[x] = ord(c) if c else 0
        cat = unicodedata.category(chr(x))
        if not c or cat[0] == "M" or cat in ("Cf", "Cc") and not chr(x).isspace() or cat == "Lm" and c in "ーｰ":
            self.kind[x] = BREAK if c and c in "ーｰ" else DROP
            if c and c in "ーｰ":
                self.kind[x], self.to[x] = CJK, ord("ー")
        elif c.isalnum():
            self.kind[x] = CJK if 0x3040 <= ord(c) <= 0x30FF or 0x3400 <= ord(c) <= 0x9FFF or 0x20000 <= ord(c) <= 0x3FFFF else WORD
        else:
            self.kind[x] = BREAK

    def __call__(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.kind[cp]
        if (new := k == 255).any():
            for x in np.unique(cp[new]):
                self._fill(int(x))
            k = self.kind[cp]
        return self.to[cp], k


_fold = FoldTable()


def symbols(texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Two streams of symbols over all texts, each with its text numbers: words (by hash), and characters (words' ones too)
    of texts that have kana or kanji."""
    cleaned = [strip_markup(x) for x in texts]
    cleaned = [x.replace("ß", "ss") if "ß" in x else x for x in cleaned]
    cp, offsets = flatten(cleaned)
    to, kind = _fold(cp)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    keep = kind != DROP
    to, kind, text = to[keep], kind[keep], text[keep]
    at = np.flatnonzero(kind == WORD)
    if len(at):
        head = np.concatenate([[True], (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])])
        starts = np.flatnonzero(head)
        words = piece_hashes(to[at], starts, np.diff(np.append(starts, len(at))))
        word_text = text[at[starts]]
    else:
        words, word_text = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    has = np.zeros(len(texts), bool)
    has[text[kind == CJK]] = True
    sel = (kind >= WORD) & has[text]
    return (words, word_text), (to[sel].astype(np.uint64), text[sel])


class WuManber:
    """Search for the pieces of all passages in a stream of symbols.

    ``passages``: symbol arrays. Pieces are disjoint windows of ``m`` symbols; ``block`` symbols make a block.
    """

    BITS = 20

    def __init__(self, passages: list[np.ndarray], m: int, block: int):
        self.m, self.block, self.passages = m, block, passages
        self.vocabulary = np.unique(np.concatenate(passages)) if passages else np.zeros(0, np.uint64)
        self.ids = [self.code(p) for p in passages]
        self.flat = np.concatenate(self.ids) if passages else np.zeros(0, np.int32)
        self.base = np.concatenate([[0], np.cumsum([len(p) for p in self.ids])]).astype(np.int64)
        owner, where = [], []
        for n, p in enumerate(self.ids):
            for i in range(0, len(p) - m + 1, m):
                owner.append(n), where.append(i)
        self.owner, self.where = np.array(owner, np.int64), np.array(where, np.int64)
        pieces = self.flat[(self.base[self.owner] + self.where)[:, None] + np.arange(m)] if len(owner) else np.zeros((0, m), np.int32)
        self.shift = np.full(1 << self.BITS, m - block + 1, np.uint8)
        for end in range(block, m + 1):  # a block that ends `m - end` symbols before a piece does
            h = self.hash([pieces[:, end - block + i] for i in range(block)])
            np.minimum.at(self.shift, h, np.uint8(m - end))
        suffix = self.hash([pieces[:, m - block + i] for i in range(block)])
        order = np.argsort(suffix, kind="stable")
        self.bucket, self.pieces = suffix[order], pieces[order]
        self.owner, self.where = self.owner[order], self.where[order]

    def code(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the symbols; one number for all that no passage has."""
        i = np.searchsorted(self.vocabulary, symbols)
        i = np.minimum(i, max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[i] == symbols if len(self.vocabulary) else np.zeros(len(symbols), bool)
        return np.where(hit, i, len(self.vocabulary)).astype(np.int32)

    def hash(self, cols: list[np.ndarray]) -> np.ndarray:
        h = cols[0].astype(np.uint64)
        for c in cols[1:]:
            h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, codes: np.ndarray, stretch: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits: position in ``codes``, passage, position in it. A cursor per stretch; all move side by side."""
        n, m, b = len(codes), self.m, self.block
        none = np.zeros(0, np.int64)
        if n < m or not len(self.owner):
            return none, none, none
        h = self.hash([codes[i : n - b + 1 + i] for i in range(b)])  # block that starts at i
        at = np.arange(m - 1, n, stretch)
        stop = np.minimum(at + stretch, n)
        ends = []
        while len(at):
            s = self.shift[h[at - b + 1]]
            ends.append(at[s == 0])
            at = at + np.maximum(s, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        end = np.concatenate(ends)
        suffix = h[end - b + 1]
        lo, hi = np.searchsorted(self.bucket, suffix, "left"), np.searchsorted(self.bucket, suffix, "right")
        k = ragged(lo, hi - lo)
        end = np.repeat(end, hi - lo)
        for i in range(m):  # direct comparison, from the end
            same = self.pieces[k, m - 1 - i] == codes[end - i]
            k, end = k[same], end[same]
        return end - m + 1, self.owner[k], self.where[k]


def _extend(a: np.ndarray, i: int, b: np.ndarray, j: int, step: int, most: int) -> list[int]:
    """Furthest-reaching: symbols of passage ``b`` covered from ``j`` on in direction ``step`` with 0, 1, ... ``most`` edits."""
    n, m = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    a = a[i : i + min(n, m + most) : 1] if step > 0 else a[max(0, i - m - most + 1) : i + 1][::-1]
    b = b[j:] if step > 0 else b[: j + 1][::-1]
    a, b = a.tolist(), b.tolist()
    n, m = len(a), len(b)
    out, reach = [], {0: 0}  # diagonal (text minus passage) -> symbols of the passage
    for d in range(most + 1):
        if d:
            new: dict[int, int] = {}
            for k, y in reach.items():
                for k2, y2 in ((k, y + 1), (k - 1, y + 1), (k + 1, y)):
                    if y2 <= m and 0 <= y2 + k2 <= n and y2 > new.get(k2, -1):
                        new[k2] = y2
            reach = new
        best = out[-1] if out else 0
        for k, y in reach.items():
            x, y0 = y + k, y
            while y < m and x < n and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = y
            if y > y0:  # a stretch ends with a symbol that is the same
                best = max(best, y)
        out.append(best)
        if not reach or best >= m:
            break
    return out


class Matcher:
    """Which passages a text holds: at least ``least`` running symbols with at most one edit in ``per``.

    The pre-filter loses nothing. A stretch of twice ``least`` or more can be halved, and a half has no more edits in
    proportion; while it is longer than ``least`` and than ``per`` times its edits, a symbol at its end can be left out. So
    each stretch holds one of max(least, per * t) symbols with t edits, 2 * least > per * t, and in it a piece without edit.
    If one of its t + 1 exact runs is longer than ``bare``, that run has a whole piece and is a hit. If none is,
    ``steps`` + 1 neighbouring ones with the hit among them have all equal symbols but those of t - ``steps`` runs.
    """

    def __init__(self, items: list[int], passages: list[np.ndarray], m: int, block: int, least: int, per: int):
        self.items, self.least, self.per = items, least, per
        self.wm = WuManber(passages, m, block)
        self.bare = 2 * m - 2  # longest run that may have no whole piece
        most = (2 * least - 1) // per
        self.steps = most // 2
        self.bound = min(max(least, per * t) - t - max(0, t - self.steps) * self.bare for t in range(most + 1))

    def _runs(self, codes, bounds, pos, item, where):
        """Lengths of the exact runs around the hits, to the left and the right, up to ``least``; all hits side by side."""
        flat, base = self.wm.flat, self.wm.base
        lo, hi = bounds
        p, q = pos, base[item] + where
        sides = []
        for step, x, y, xe, ye in ((1, p, q, hi, base[item + 1]), (-1, p - 1, q - 1, lo - 1, base[item] - 1)):
            sides.append(self._run(codes, flat, x, y, xe, ye, step))
        return sides

    def _run(self, codes, flat, x, y, xe, ye, step):
        n = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        for _ in range(self.least):
            a, b = x[live] + step * n[live], y[live] + step * n[live]
            ok = (a != xe[live]) & (b != ye[live]) & ((a < xe[live]) == (step > 0)) & ((b < ye[live]) == (step > 0))
            live, a, b = live[ok], a[ok], b[ok]
            live = live[codes[a] == flat[b]]
            if not len(live):
                break
            n[live] += 1
        return n

    def _reach(self, codes, x, y, xe, ye, step, run) -> list[np.ndarray]:
        """Furthest-reaching: symbols of the passages covered from ``x``, ``y`` on with 0, 1, ... ``steps`` edits; all hits side by side."""
        n, m = step * (xe - x), step * (ye - y)
        out, reach = [run], {0: run}  # diagonal (text minus passage) -> symbols of the passage, negative: not to be reached
        for d in range(1, self.steps + 1):
            new = {}
            for k in range(-d, d + 1):
                got = np.max([reach[j] + add for j, add in ((k, 1), (k + 1, 1), (k - 1, 0)) if j in reach], axis=0)
                got = np.minimum(got, np.minimum(m, n - k))
                got[(got < 0) | (got + k < 0)] = -len(codes) - self.least
                ok = np.flatnonzero(got >= 0)
                got[ok] += self._run(codes, self.wm.flat, x[ok] + step * (got[ok] + k), y[ok] + step * got[ok], xe[ok], ye[ok], step)
                new[k] = got
            reach = new
            out.append(np.maximum(out[-1], np.max(list(reach.values()), axis=0)))
        return out

    def found(self, codes: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
        """(text number, item) for each text of a stream."""
        pos, item, where = self.wm.search(codes)
        if not len(pos):
            return set()
        # pieces don't reach over the end of a text
        ok = text[pos] == text[pos + self.wm.m - 1]
        pos, item, where = pos[ok], item[ok], where[ok]
        if not len(pos):
            return set()
        first = np.searchsorted(text, text[pos], "left")
        last = np.searchsorted(text, text[pos], "right")
        right, left = self._runs(codes, (first, last), pos, item, where)
        # one hit per exact run
        _, uniq = np.unique((pos - left) * np.int64(len(self.wm.flat)) + self.wm.base[item] + where - left, return_index=True)
        pos, item, where, left, right, first, last = (x[uniq] for x in (pos, item, where, left, right, first, last))
        run = left + right
        out = {(int(t), self.items[i]) for t, i in zip(text[pos[run >= self.least]], item[run >= self.least])}
        rest = np.flatnonzero(run < self.least)
        pos, item, where, left, right, first, last, run = (x[rest] for x in (pos, item, where, left, right, first, last, run))
        likely = run > self.bare
        if len(low := np.flatnonzero(~likely)):
            x, q = pos[low], self.wm.base[item[low]] + where[low]
            r = self._reach(codes, x, q, last[low], self.wm.base[item[low] + 1], 1, right[low])
            l = self._reach(codes, x - 1, q - 1, first[low] - 1, self.wm.base[item[low]] - 1, -1, left[low])
            likely[low] = np.max([r[d] + l[self.steps - d] for d in range(self.steps + 1)], axis=0) >= self.bound
        likely = np.flatnonzero(likely)
        for r in likely.tolist():
            t, n = int(text[pos[r]]), int(item[r])
            if (t, self.items[n]) in out:
                continue
            if self._holds(codes[first[r] : last[r]], int(pos[r] - first[r]), n, int(where[r])):
                out.add((t, self.items[n]))
        return out

    def _holds(self, a, i, n, j) -> bool:
        b = self.wm.ids[n]
        most = len(b) // self.per + 1
        right = _extend(a, i, b, j, 1, most)
        left = _extend(a, i - 1, b, j - 1, -1, most) if i > 0 and j > 0 else [0]
        for d1, x in enumerate(left):
            for d2, y in enumerate(right):
                if x + y >= self.least and (d1 + d2) * self.per <= x + y:
                    return True
        return False


def matchers(items: list[tuple[int, str]]) -> tuple[Matcher, Matcher]:
    """The word and the character matcher. A passage counts as kana and kanji if a third of its signs are."""
    by_word: tuple[list, list] = ([], [])
    by_char: tuple[list, list] = ([], [])
    for i, passage in items:
        (w, _), (c, _) = symbols([passage])
        cjk = len(c) and int((_fold(c.astype(np.uint32))[1] == CJK).sum()) * 3 >= len(c)
        ids, passages = by_char if cjk else by_word
        ids.append(i), passages.append(c if cjk else w)
    return Matcher(*by_word, m=5, block=2, least=20, per=8), Matcher(*by_char, m=10, block=3, least=60, per=15)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """``doc_id, item_id``: the documents that hold at least 20 running words of a passage with at most one in eight
    added, dropped or replaced; for passages in kana and kanji, 60 characters with at most one in fifteen.

    Null or blank texts and passages match nothing; passages too short to hold the required stretch neither. Rows
    delivered twice give one row. Rows with a null id are left out; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    slim = items.select(items[item_id].cast("bigint").alias("item_id"), items[passage].cast("string").alias("passage")).where("item_id is not null and passage is not null").distinct()
    size = slim.agg(F.sum(F.length("passage"))).first()[0] or 0
    groups = max(1, -(-size // PATTERN_BUDGET))
    corpus = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = None
    for g in range(groups):
        part = slim.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else slim
        mine = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.orderBy("item_id", "passage").collect()])
        found = corpus.mapInArrow(_search(mine), "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


_made: dict = {}


def _search(items):
    def run(batches):
        if items.value and _made.get("items") is not items.value:
            _made.clear()
            _made.update(items=items.value, matchers=matchers(items.value))
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            lo = size = 0
            for i, x in enumerate(texts):
                size += len(x)
                if items.value and (size >= SLICE or i == len(texts) - 1):
                    streams = symbols(texts[lo : i + 1])
                    rows = set().union(*(m.found(m.wm.code(s), t) for m, (s, t) in zip(_made["matchers"], streams)))
                    if rows:
                        x, y = zip(*sorted(rows))
                        yield pa.RecordBatch.from_arrays([pa.array([ids[lo + k] for k in x], pa.int64()), pa.array(y, pa.int64())], ["doc_id", "item_id"])
                    lo, size = i + 1, 0

    return run
