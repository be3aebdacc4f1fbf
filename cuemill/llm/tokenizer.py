"""Encoding a corpus with a public byte-level BPE tokenizer.

Method: the texts of an Arrow batch are one array of code points; piece boundaries come from shifted comparisons of
character classes. Equal pieces are found by hash and encoded once per worker. New pieces are laid into padded numpy
matrices, bucketed by length; in each round every row merges its leftmost pair of least rank, looked up in a hash
table of pairs, and rows without a pair left are compacted away. There is no shuffle: each text is read and encoded where it lies.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .codepoints import STEP, flatten, mix, ragged

#: Bytes of the largest vocabulary that is sent to all tasks; the public ones have one to four million.
LARGEST = 64 << 20
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The endings that the public pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "m", "d", "ll", "ve", "re")
NONE = np.int64(2**62)


def char_class(cp: int) -> int:
    c = chr(cp)
    kind = unicodedata.category(c)[0]
    if kind == "L":
        return LETTER
    if kind == "N":
        return NUMBER
    # white space of the pattern language is the Unicode property, which lacks the four separators U+001C..U+001F
    return SPACE if c.isspace() and not 0x1C <= cp <= 0x1F else OTHER


class ClassTable:
    """Character classes by code point, filled in as code points turn up."""

    def __init__(self):
        self.of = np.full(0x110000, 255, np.uint8)

    def __call__(self, cp: np.ndarray) -> np.ndarray:
        k = self.of[cp]
        if (new := k == 255).any():
            for x in np.unique(cp[new]):
                self.of[x] = char_class(int(x))
            k = self.of[cp]
        return k


def piece_starts(cp: np.ndarray, offsets: np.ndarray, classes: ClassTable) -> np.ndarray:
    """Where a piece of the pre-tokenizer's pattern starts: contractions, then runs of letters, numbers or other signs
    with at most one blank before, then white space, whose last sign stays with what follows."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    k = classes(cp)
    first = np.zeros(n + 1, bool)  # of a text
    first[offsets[:-1]] = True
    first = first[:n]
    begin = first.copy()
    begin[1:] |= k[1:] != k[:-1]
    space = k == SPACE
    last = np.ones(n, bool)  # of a text
    last[:-1] = first[1:]
    # a white-space run before something else in its text gives up its last sign
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    begin |= ends_run
    # that sign joins what follows if it is a plain blank, and is a piece of its own if not
    joins = np.zeros(n, bool)
    joins[1:] = ends_run[:-1] & (cp[:-1] == 32)
    begin &= ~joins
    # contractions start at an apostrophe that begins a piece; what follows them begins a new one
    quote = np.flatnonzero((cp == 39) & begin)
    if len(quote):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        text_end = offsets[np.searchsorted(offsets, quote, "right")]
        size = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            hit = quote + len(c) < text_end
            for i, x in enumerate(c):
                hit &= pad[quote + 1 + i] == ord(x)
            size[hit & (size == 0)] = len(c)
        for q, s in zip(quote[size > 0], size[size > 0]):
            begin[q + 1 : q + 1 + s] = False
            e = q + 1 + s
            if e < n and not first[e] and not space[e]:
                begin[e] = True
            # a letter run or a sign run goes on behind the contraction as a piece of its own; an apostrophe there was
            # no piece's beginning when the quotes were gathered, so look at it again
            while e < n and not first[e] and cp[e] == 39 and (s2 := _contraction(cp, e, n, first)):
                begin[e + 1 : e + 1 + s2] = False
                e += 1 + s2
                if e < n and not first[e] and not space[e]:
                    begin[e] = True
    return np.flatnonzero(begin)


def _contraction(cp: np.ndarray, at: int, n: int, first: np.ndarray) -> int:
    for c in CONTRACTIONS:
        if at + len(c) < n and all(cp[at + 1 + i] == ord(x) and not first[at + 1 + i] for i, x in enumerate(c)):
            return len(c)
    return 0


class PairTable:
    """Open-addressing hash table from a pair of ids to the id, and so the rank, of their merger. A pair whose part was made
    after the merger can't have made it and is no entry, so a merger's own pairs always rank behind it."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank:
                    left.append(a), right.append(b), to.append(rank)
        key = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        to = np.array(to, np.int64)
        size = 1 << (4 * len(key)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        left_over, self.probes = np.arange(len(key)), 0
        slot = mix(key) & self.mask
        while len(left_over):  # each round seats one key per free slot; the rest move on
            s = slot[left_over]
            free = self.keys[s] < 0
            self.keys[s[free]] = key[left_over[free]]
            seated = self.keys[s] == key[left_over]
            self.values[s[seated]] = to[left_over[seated]]
            left_over = left_over[~seated]
            slot[left_over] = (slot[left_over] + np.uint64(1)) & self.mask
            self.probes += 1

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        slot = mix(key) & self.mask
        out = self.values[slot]
        at = self.keys[slot]
        out = np.where(at == key, out, NONE)
        todo = np.flatnonzero((at != key) & (at >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            at = self.keys[slot[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out


class Encoder:
    """Encodes texts; keeps the ids of pieces it has met, up to ``cache`` pieces."""

    def __init__(self, vocabulary: str | bytes, cache: int = 1_000_000):
        """``vocabulary``: a rank file's path, or what stands in it."""
        if isinstance(vocabulary, str):
            with open(vocabulary, "rb") as f:
                vocabulary = f.read()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs, self.classes, self.cache = PairTable(self.ranks), ClassTable(), cache
        self.clear()

    def clear(self):
        self.seen_hash, self.seen_at, self.seen_len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by rounds over padded matrices bucketed by length."""
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for high in (1, 4, 8, 16, 32, 64, 128, 512):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            step = 4_000_000 // high  # a bucket is worked off in slices of bounded size
            for i in range(0, len(rows), step):
                self._merge(pieces, rows[i : i + step], sizes, out)
        for r in np.flatnonzero(sizes > low):
            out[r] = self._merge_long(pieces[r])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece: each round merges every pair of least rank, from the left. As a merger's own pairs rank behind
        it, this is the same as one pair at a time."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            rank = self.pairs.rank(ids[:-1], ids[1:])
            if (best := rank.min()) == NONE:
                break
            at = np.flatnonzero(rank == best)
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1  # neighbours overlap: every second one is taken
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids.astype(np.int32)

    def _merge(self, pieces, rows, sizes, out):
        width = int(sizes[rows].max())
        n = sizes[rows].copy()
        ids = np.full((len(rows), width + 1), -1, np.int64)
        flat = self.byte[np.frombuffer(b"".join(pieces[r] for r in rows), np.uint8)]
        ids[np.repeat(np.arange(len(rows)), n), ragged(np.zeros(len(rows), np.int64), n)] = flat
        rank = np.full((len(rows), width + 1), NONE, np.int64)
        live = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        rank[:, :-1][live] = self.pairs.rank(ids[:, :-1][live], ids[:, 1:][live])
        where = rows
        while len(where):
            at = rank.argmin(1)  # the first of the least
            best = rank[np.arange(len(where)), at]
            over = best == NONE
            for r in np.flatnonzero(over):
                out[where[r]] = ids[r, : n[r]].astype(np.int32)
            if over.any():
                keep = ~over
                where, ids, rank, n, at, best = where[keep], ids[keep], rank[keep], n[keep], at[keep], best[keep]
                if not len(where):
                    break
            n -= 1
            w = int(n.max()) + 1
            # drop the pair's right half: columns behind it move one to the left
            col = np.arange(w)
            src = col[None, :] + (col[None, :] > at[:, None])
            src = np.minimum(src, ids.shape[1] - 1)
            ids, rank = np.take_along_axis(ids, src, 1), np.take_along_axis(rank, src, 1)
            r = np.arange(len(where))
            ids[r, at] = best
            ids[r, n], rank[r, n] = -1, NONE
            for c in (at - 1, at):  # the ranks of the new id with its neighbours
                ok = (c >= 0) & (c + 1 < n)
                new = np.full(len(where), NONE, np.int64)
                new[ok] = self.pairs.rank(ids[r[ok], c[ok]], ids[r[ok], c[ok] + 1])
                rank[r[c >= 0], c[c >= 0]] = new[c >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offset of each text in them."""
        cp, offsets = flatten(texts)
        starts = piece_starts(cp, offsets, self.classes)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        length = np.diff(np.append(starts, len(cp)))
        key = piece_hashes(cp, starts, length)
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.seen_hash) + len(uniq) > self.cache:
            self.clear()
        at = np.searchsorted(self.seen_hash, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.seen_hash)
        known[inside] = self.seen_hash[at[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        if len(new):
            s, n = starts[first[new]], length[first[new]]
            joined = cp[ragged(s, n)].tobytes().decode("utf-32-le", "surrogatepass")
            ends = np.cumsum(n)
            pieces = [joined[e - m : e].encode("utf-8", "surrogatepass") for e, m in zip(ends.tolist(), n.tolist())]
            ids = self.merge(pieces)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            where = len(self.pool) + np.cumsum(sizes) - sizes
            self.pool = np.concatenate([self.pool, *ids])
            allh = np.concatenate([self.seen_hash, uniq[new]])
            order = np.argsort(allh, kind="stable")
            self.seen_hash = allh[order]
            self.seen_at = np.concatenate([self.seen_at, where])[order]
            self.seen_len = np.concatenate([self.seen_len, sizes])[order]
            at = np.searchsorted(self.seen_hash, uniq)
        a, m = self.seen_at[at][inverse], self.seen_len[at][inverse]
        flat = self.pool[ragged(a, m)]
        total = np.concatenate([[0], np.cumsum(m)])
        return flat, total[np.searchsorted(starts, offsets, "left")]


def piece_hashes(cp: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece. Pieces longer than 64 code points are hashed by blocks of 64, so that no run of
    multiplications is long enough for the low bits to repeat."""
    h = mix(cp)
    pos = np.arange(len(cp)) - np.repeat(starts, length)
    weight = _weights()[np.minimum(pos & 63, 63)] + (pos >> 6).astype(np.uint64) * STEP[5]
    return mix(np.add.reduceat(mix(h ^ weight), starts) + length.astype(np.uint64) * STEP[7])


def _weights() -> np.ndarray:
    return mix(np.arange(64, dtype=np.uint64) * STEP[3])


_encoders: dict[str, Encoder] = {}


def encoder(name: str, sent) -> Encoder:
    """The worker's encoder of a vocabulary; made once per Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(sent.value)
    return _encoders[name]


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, ids``: the token ids of each text, without special tokens; what looks like one is plain text.

    A null and an empty text both give an empty list. Every row of ``df`` gives one row, repeated ids included; an
    empty table an empty result. ``vocabulary`` is a rank file that the driver can read under that path; executors get what
    stands in it, ``LARGEST`` bytes at most, however large the corpus is.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read(LARGEST + 1)
    if len(ranks) > LARGEST:
        raise ValueError(f"{vocabulary} is no vocabulary: more than {LARGEST} bytes")
    name, sent = hashlib.blake2b(ranks).hexdigest(), df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        enc = encoder(name, sent)
        for b in batches:
            ids_of, texts = b.column(0).cast(pa.int64()), [x or "" for x in b.column(1).to_pylist()]
            lo = size = 0
            for i, x in enumerate(texts):  # slices of about 4 million characters, whatever the texts' lengths
                size += len(x)
                if size >= 4_000_000 or i == len(texts) - 1:
                    ids, off = enc.encode(texts[lo : i + 1])
                    lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([ids_of.slice(lo, i + 1 - lo), lists], ["doc_id", "ids"])
                    lo, size = i + 1, 0

    return df.select(df[doc_id].cast("bigint"), df[text]).mapInArrow(run, "doc_id bigint, ids array<int>")
