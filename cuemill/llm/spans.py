"""Long spans that stand verbatim in more than one record.

Method: seed and extend, without ever forming a pair of records.

1. Texts are packed into compressed blocks by hash of the text, so equal texts meet in one block and take part once.
2. Seeds: of the windows of ``span`` characters, each picks the leftmost least of its ``seed``-gram hashes (winnowing), so equal
   windows pick equal anchors. Each block sends its distinct anchors to the bucket of the anchor; an anchor
   known to two blocks, or to two texts of one block, is a seed hit and goes back to the blocks that have it.
3. Extension: each occurrence of a hit anchor is sent to the anchor's bucket with the characters round it, as far as windows
   lean on this anchor. There the characters themselves are compared: sorted by anchor and what follows, and by anchor and what
   precedes (backwards), neighbours tell how far each occurrence extends to either side together with others. An
   occurrence is shared as far as another text agrees on both sides at once over ``span`` characters or more.
4. The shared stretches of all anchors are joined per text: maximal ranges, each a maximal repeat or a union of such.

An anchor of more than ``HOT`` occurrences, such as the edge of a passage that stands in a third of all records, would be a hot
group: its windows are compared one by one, spread over the buckets by a 64-bit hash of their characters; each block sends
an equal window once. So what is exchanged for a key is bounded either by ``HOT`` or by the number of blocks.

The number of blocks and of tasks follows the characters of the corpus (``_layout``), not the session's partitions, so what a
task reads stays the same as the corpus grows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import flatten, mix, ragged, window_hashes

BLOCK, HITS = "block int, kind int, body binary", "bucket int, block int, kind int, body binary"
#: kind of a message: anchors or windows, by hash; occurrences of anchors, with their characters
KEYS, PLACES = 0, 1
#: Occurrences of an anchor, counted up to 255 a block, beyond which its windows are compared by hash.
HOT = 1000
#: Characters that are hashed at once; bounds a worker's memory.
SLICE = 1_500_000

#: Bytes of text in a block: at least, and at most.
LEAST, MOST = 4 << 20, 256 << 20


def _layout(size: int) -> tuple[int, int]:
    """Number of blocks and of buckets for ``size`` bytes of text. A block grows with the root of the corpus, since every block
    sends something to every bucket: 4 MB up to 1.7 GB of text, 30 MB at 90 GB, 256 MB from 7 TB on. A bucket takes a
    quarter of what a block sends, since the occurrences in it come with their characters."""
    block = min(MOST, max(LEAST, 100 * math.isqrt(size)))
    return max(1, -(-size // block)), max(1, -(-size // max(LEAST, block // 4)))


def _pack(ids: np.ndarray, copies: np.ndarray, texts: list[str]) -> bytes:
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    head = np.array([len(ids)], np.int64).tobytes()
    body = head + ids.tobytes() + copies.tobytes() + np.fromiter(map(len, raw), np.int64, len(raw)).tobytes() + b"".join(raw)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blobs) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct texts of a block, in a fixed order: their least id, and whether they stand under more than one id."""
    by_text: dict[str, list] = {}
    for blob in blobs:
        body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        n = int(np.frombuffer(body, np.int64, 1)[0])
        ids, copies = np.frombuffer(body, np.int64, n, 8), np.frombuffer(body, np.bool_, n, 8 + 8 * n)
        sizes, at = np.frombuffer(body, np.int64, n, 8 + 9 * n), 8 + 17 * n
        for i, c, m in zip(ids.tolist(), copies.tolist(), sizes.tolist()):
            x = body[at : at + m].decode("utf-8", "surrogatepass")
            at += m
            if (e := by_text.get(x)) is None:
                by_text[x] = [i, c]
            elif c or e[0] != i:
                e[0], e[1] = min(e[0], i), True
    order = sorted(by_text, key=lambda x: by_text[x][0])
    return np.array([by_text[x][0] for x in order], np.int64), np.array([by_text[x][1] for x in order], np.bool_), order


def _slices(texts: list[str]):
    lo = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= SLICE or i == len(texts) - 1:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0


def _least_left(h: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least value of each window of ``width`` values is, by doubling."""
    at, s = np.arange(len(h)), 1
    if len(h) < width:
        return at[:0]
    while s * 2 <= width:
        a, b = at[:-s], at[s:]
        at = np.where(h[a] <= h[b], a, b)
        s *= 2
    if s < width:
        n = len(h) - width + 1
        a, b = at[:n], at[width - s : width - s + n]
        at = np.where(h[a] <= h[b], a, b)
    return at


class _Slice:
    """Valid windows of a slice of texts, in groups that lean on the same anchor."""

    def __init__(self, texts: list[str], span: int, seed: int):
        self.texts, self.span = texts, span
        cp, self.offsets = flatten(texts)
        if len(cp) < span:
            self.start = self.text = self.first = self.last = self.anchor = np.zeros(0, np.int64)
            self.key = self.window = np.zeros(0, np.uint64)
            return
        h = window_hashes(cp, [seed, span])
        mixed = mix(h[seed])
        anchor = _least_left(mixed, span - seed + 1)
        text = np.repeat(np.arange(len(texts)), np.diff(self.offsets))[: len(anchor)]
        ok = np.flatnonzero(np.arange(len(anchor)) + span <= self.offsets[text + 1])
        a, t = anchor[ok], text[ok]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])) if len(ok) else ok
        tail = np.append(head[1:], len(ok)) - 1
        # of each group: its text, first and last window, where its anchor is, and the anchor's key
        self.text, self.first, self.last, self.anchor = t[head], ok[head], ok[tail] if len(ok) else ok, a[head]
        self.key = mix(mixed[self.anchor])  # least hashes are small numbers: mixed again, they spread over all buckets
        self.window = h[span]

    def windows(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, window) of all windows of ``groups``."""
        n = self.last[groups] - self.first[groups] + 1
        return np.repeat(groups, n), ragged(self.first[groups], n)

    def said(self, groups: np.ndarray) -> list[str]:
        """The characters that the windows of each group cover."""
        t = self.text[groups]
        lo, hi = self.first[groups] - self.offsets[t], self.last[groups] + self.span - self.offsets[t]
        return [self.texts[x][i:j] for x, i, j in zip(t.tolist(), lo.tolist(), hi.tolist())]


def _distinct(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, whether each stands in more than one text, and how often it stands, up to 255."""
    if not len(key):
        return key, np.zeros(0, np.bool_), np.zeros(0, np.uint8)
    order = np.argsort(key, kind="stable")
    k, t = key[order], text[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    n = np.minimum(np.diff(np.append(head, len(k))), 255).astype(np.uint8)
    return k[head], np.minimum.reduceat(t, head) != np.maximum.reduceat(t, head), n


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _messages(block: int, kind: int, rows: list[tuple[int, bytes]]):
    for i in range(0, len(rows), 1000):
        x, z = zip(*rows[i : i + 1000])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array([block] * len(x), pa.int32()), pa.array([kind] * len(x), pa.int32()), pa.array(z, pa.binary())], ["bucket", "block", "kind", "body"])


def _send(block: int, key: np.ndarray, many: np.ndarray, n: np.ndarray, buckets: int):
    """Sorted keys by bucket: their top bits say which."""
    cut = np.searchsorted(_bucket_of(key, buckets), np.arange(buckets + 1))
    yield from _messages(block, KEYS, [(i, key[a:b].tobytes() + n[a:b].tobytes() + np.packbits(many[a:b]).tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])


def _keys(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(body) * 8 // 73
    return np.frombuffer(body, np.uint64, n), np.unpackbits(np.frombuffer(body, np.uint8, offset=9 * n), count=n).astype(bool), np.frombuffer(body, np.uint8, n, 8 * n)


def _met(bodies: list[bytes], blocks: list[int], hot: int):
    """Keys of one bucket: those that more than one text has go back to each block that has them; the last bit of a key says
    whether it stands more than ``hot`` times."""
    parts = [_keys(x) for x in bodies]
    key, many, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    block = np.repeat(np.array(blocks, np.int64), [len(p[0]) for p in parts])
    order = np.argsort(key, kind="stable")
    k, b = key[order], block[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    shared = np.logical_or.reduceat(many[order], head) | (np.minimum.reduceat(b, head) != np.maximum.reduceat(b, head))
    often = np.add.reduceat(n[order].astype(np.int64), head) > hot
    size = np.diff(np.append(head, len(k)))
    shared, often = np.repeat(shared, size), np.repeat(often, size)
    k, b = (k & ~ONE | often)[shared], b[shared]
    order = np.argsort(b, kind="stable")
    k, b = k[order], b[order]
    who, at = np.unique(b, return_index=True)
    yield from zip(who.tolist(), [KEYS] * len(who), [k[x:y].tobytes() for x, y in zip(at, [*at[1:], len(k)])])


ONE = np.uint64(1)
NOTHING = np.uint32(0xFFFFFFFF)
#: Occurrences that are extended at once; bounds a worker's memory.
PART = 50_000


def _post(block: int, part: _Slice, groups: np.ndarray, number: int, whose: int, seed: int, buckets: int):
    """Occurrences of anchors on their way to the anchors' buckets: number of the occurrence in its block, its text, how far its
    anchor lies behind its beginning, how many windows it has, and its characters."""
    bucket = _bucket_of(part.key[groups], buckets)
    order = np.argsort(bucket, kind="stable")
    said, rows = part.said(groups[order]), []
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    g = groups[order]
    head = np.stack([number + order, part.text[g] + whose, part.anchor[g] - part.first[g], part.last[g] - part.first[g]], 1).astype(np.int32)
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            chars = "".join(said[a:b]).encode("utf-8", "surrogatepass")
            body = head[a:b].tobytes() + chars
            rows.append((i, (b - a).item().to_bytes(4, "little") + len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)))
    yield from _messages(block, PLACES, rows)


def _reach(rows: np.ndarray, seed: int) -> np.ndarray:
    """For rows that begin with the anchor's characters: in order of their characters, numbers of classes that agree in the anchor and the
    first 0, 1, 2 ... characters behind it; (width + 1, rows)."""
    raw = np.ascontiguousarray(rows.astype(">u4"))
    order = np.argsort(raw.view(np.dtype((np.void, raw.shape[1] * 4))).ravel(), kind="stable")
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if len(s) > 1 else np.zeros(0, np.int64)
    out = np.empty((rows.shape[1] - seed + 1, len(rows)), np.int64)
    for r in range(len(out)):
        out[r, order] = np.concatenate([[0], np.cumsum(common < seed + r)])
    return out


def _shared_offsets(cp, anchor, begin, size, whose, lead, more, span, seed) -> np.ndarray:
    """For each occurrence of some anchors the distances, as bits, at which an anchor lies behind the beginning of a stretch of ``span``
    characters that another text has too."""
    slack = span - seed
    # characters before the anchor, nearest first, and behind it; beyond what an occurrence has, a sign that no text has
    d = np.arange(1, slack + 1)
    left = np.where(d <= lead[:, None], cp[np.maximum(anchor[:, None] - d, 0)], NOTHING)
    right = anchor[:, None] + seed - 1 + d
    right = np.where(right < (begin + size)[:, None], cp[np.minimum(right, len(cp) - 1)], NOTHING)
    middle = cp[anchor[:, None] + np.arange(seed)]
    to_right, to_left = _reach(np.concatenate([middle, right], 1), seed), _reach(np.concatenate([middle, left], 1), seed)
    mask = np.zeros(len(anchor), np.uint64)
    for o in range(slack + 1):
        at = np.flatnonzero((o <= lead) & (o >= lead - more))
        if len(at) < 2:
            continue
        pair = to_left[o][at] * len(anchor) + to_right[slack - o][at]
        order = np.argsort(pair, kind="stable")
        p, w = pair[order], whose[at][order]
        head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        shared = np.minimum.reduceat(w, head) != np.maximum.reduceat(w, head)
        mask[at[order[np.repeat(shared, np.diff(np.append(head, len(p))))]]] |= ONE << np.uint64(o)
    return mask


def _extended(bodies: list[bytes], blocks: list[int], span: int, seed: int):
    """Occurrences of anchors of one bucket: how far each is shared with another text, extending it both ways by its characters."""
    heads, texts = [], []
    for x in bodies:
        n = int.from_bytes(x[:4], "little")
        body = pa.decompress(x[12:], decompressed_size=int.from_bytes(x[4:12], "little"), codec="zstd", asbytes=True)
        heads.append(np.frombuffer(body, np.int32, 4 * n).reshape(n, 4).astype(np.int64))
        texts.append(body[16 * n :].decode("utf-8", "surrogatepass"))
    block = np.repeat(np.array(blocks, np.int64), [len(h) for h in heads])
    number, text, lead, more = np.concatenate(heads).T
    cp, _ = flatten(texts)
    begin = np.cumsum(span + more) - span - more
    anchor = begin + lead
    whose = block << 32 | text
    mask = np.zeros(len(number), np.uint64)
    # equal anchors have equal hashes: worked off in slices that part between them
    h = window_hashes(cp, [seed])[seed][anchor]
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    cut = np.unique(np.append(heads[np.searchsorted(heads, np.arange(0, len(h), PART), "right") - 1], len(h)))
    for x, y in zip(cut, cut[1:]):
        some = order[x:y]
        mask[some] = _shared_offsets(cp, anchor[some], begin[some], span + more[some], whose[some], lead[some], more[some], span, seed)
    for b in np.unique(block):
        at = np.flatnonzero((block == b) & (mask > 0))
        if len(at):
            yield int(b), PLACES, number[at].astype(np.int64).tobytes() + mask[at].tobytes()


class _Among:
    """Membership in a set of keys: a bit table first, then binary search for the few that pass."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.shift = np.uint64(64 - max(10, (8 * len(self.keys)).bit_length()))
        self.table = np.zeros(1 << int(np.uint64(64) - self.shift), np.bool_)
        self.table[self.keys >> self.shift] = True

    def where(self, x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[x >> self.shift])
        if not len(at):
            return at
        i = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        return at[self.keys[i] == x[at]]


def shared_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 80, seed: int = 56, hot: int = HOT) -> DataFrame:
    """``doc_id, from_char, to_char``: the characters of each text that lie in a span of at least ``span`` characters
    standing verbatim in a text with another id, as maximal ranges; code points from 0, ``to_char`` exclusive.

    Null texts and texts shorter than ``span`` give no row. Whole copies share everything. Repetition inside one text
    alone, and whole rows delivered twice, share nothing. Rows with a null id are left out. ``seed`` (below ``span``)
    trades the number of anchors against the number of chance hits and doesn't change the result; nor does ``hot``, the occurrences
    beyond which an anchor's windows are spread over all buckets. ``span - seed`` is 63 at most.
    """
    if not 8 <= seed <= span <= seed + 63:
        raise ValueError("seed must be at least 8, at most span, and at least span - 63")
    docs = df.select(df[doc_id].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text")).where((F.length("text") >= span) & F.col("doc_id").isNotNull())

    blocks, buckets = _layout(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def pack(batches):
        for b in batches:
            groups: dict[int, list] = {}
            for i, x, h in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("h").to_pylist()):
                groups.setdefault(h, []).append((i, x))
            rows = []
            for h, g in groups.items():
                by: dict[str, list] = {}
                for i, x in g:
                    e = by.setdefault(x, [i, i])
                    e[0], e[1] = min(e[0], i), max(e[1], i)
                ids = np.array([e[0] for e in by.values()], np.int64)
                rows.append((h, _pack(ids, np.array([e[0] != e[1] for e in by.values()], np.bool_), list(by))))
            if rows:
                x, y = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array([KEYS] * len(x), pa.int32()), pa.array(y, pa.binary())], ["block", "kind", "body"])

    def seeds(table: pa.Table):
        block = table.column("block")[0].as_py()
        _, _, texts = _unpack(table.column("body").to_pylist())
        keys, whose = [], []
        for lo, part in _slices(texts):
            p = _Slice(part, span, seed)
            keys.append(p.key & ~ONE)
            whose.append(p.text + lo)
        yield from _send(block, *_distinct(np.concatenate(keys), np.concatenate(whose)), buckets)

    def hit_groups(texts: list[str], bodies: list[bytes]):
        """Slices with their groups on anchors that are hit: (first text, slice, groups to extend, number of the first, groups on
        hot anchors). The same in each call for the same block."""
        hits = np.concatenate([np.frombuffer(x, np.uint64) for x in bodies])
        cold, hot = _Among(hits[hits & ONE == 0]), _Among(hits[hits & ONE == 1] & ~ONE)
        number = 0
        for lo, part in _slices(texts):
            p = _Slice(part, span, seed)
            groups = cold.where(p.key & ~ONE)
            yield lo, p, groups, number, hot.where(p.key & ~ONE)
            number += len(groups)

    def extend(texts_table: pa.Table, hits: pa.Table):
        if not texts_table.num_rows or not hits.num_rows:
            return
        block = texts_table.column("block")[0].as_py()
        _, _, texts = _unpack(texts_table.column("body").to_pylist())
        keys, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, p, groups, number, often in hit_groups(texts, hits.column("body").to_pylist()):
            yield from _post(block, p, groups, number, lo, seed, buckets)
            group, window = p.windows(often)
            keys.append(mix(p.window[window]) & ~ONE)
            whose.append(p.text[group] + lo)
        yield from _send(block, *_distinct(np.concatenate(keys), np.concatenate(whose)), buckets)

    def ranges(texts_table: pa.Table, hits: pa.Table):
        if not texts_table.num_rows or not hits.num_rows:
            return
        told: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        for stage, kind, x in zip(*(hits.column(c).to_pylist() for c in ("stage", "kind", "body"))):
            told[0 if stage == 0 else 1 + kind].append(x)
        if not told[1] and not told[2]:
            return
        among = _Among(np.concatenate([np.frombuffer(x, np.uint64) & ~ONE for x in told[1]] or [np.zeros(0, np.uint64)]))
        found = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in told[2]]
        number = np.concatenate([x[0] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        mask = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(number)
        number, mask = number[order], mask[order]
        ids, copies, texts = _unpack(texts_table.column("body").to_pylist())
        for lo, p, groups, first, often in hit_groups(texts, told[0]):
            a, b = np.searchsorted(number, [first, first + len(groups)])
            group, bits = groups[number[a:b] - first], mask[a:b]
            starts = []
            for o in range(span - seed + 1):
                on = group[bits >> np.uint64(o) & ONE == 1]
                starts.append(np.stack([p.anchor[on] - o, p.text[on]]))
            g, window = p.windows(often)
            hit = among.where(mix(p.window[window]) & ~ONE)
            starts.append(np.stack([window[hit], p.text[g[hit]]]))
            start, who = np.concatenate(starts, 1)
            keep = ~copies[who + lo]  # whole copies are stated elsewhere
            start, who = start[keep], who[keep]
            if not len(start):
                continue
            order = np.argsort(start, kind="stable")  # texts lie one behind the other, so this sorts by text too
            start, who = start[order], who[order]
            start = start - p.offsets[who]
            head = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] > start[:-1] + span)]))
            tail = np.append(head[1:], len(start)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[who[head] + lo]), pa.array(start[head].astype(np.int64)), pa.array((start[tail] + span).astype(np.int64))], ["doc_id", "from_char", "to_char"]
            )

    def table(f, schema):
        names, types = zip(*(x.split() for x in schema.split(", ")))
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
        target = pa.schema([(n, kinds[k]) for n, k in zip(names, types)])

        def run(*args: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(f(*args)), target)

        return run

    def answer(t: pa.Table) -> pa.Table:
        rows = []
        for kind in (KEYS, PLACES):
            some = t.filter(pc.equal(t.column("kind"), kind))
            if some.num_rows:
                bodies, blocks = some.column("body").to_pylist(), some.column("block").to_pylist()
                rows += _met(bodies, blocks, hot) if kind == KEYS else _extended(bodies, blocks, span, seed)
        cols = list(zip(*rows)) or [[]] * 3
        return pa.table({"block": pa.array(cols[0], pa.int32()), "kind": pa.array(cols[1], pa.int32()), "body": pa.array(cols[2], pa.binary())})

    packed = docs.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")).mapInArrow(pack, BLOCK)
    found = "doc_id bigint, from_char bigint, to_char bigint"
    by_block = packed.repartition(blocks, "block").groupBy("block")

    def met(sent: DataFrame, stage: int) -> DataFrame:
        back = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, BLOCK)
        return back.withColumn("stage", F.lit(stage)).repartition(blocks, "block")

    hits = met(by_block.applyInArrow(_one_table(table(seeds, HITS)), HITS), 0)
    stretches = met(by_block.cogroup(hits.groupBy("block")).applyInArrow(_two_tables(table(extend, HITS)), HITS), 1)
    parts = by_block.cogroup(hits.unionByName(stretches).repartition(blocks, "block").groupBy("block")).applyInArrow(_two_tables(table(ranges, found)), found)
    return parts.unionByName(_whole_copies(docs))


def _one_table(f):
    def run(t: pa.Table) -> pa.Table:
        return f(t)

    return run


def _two_tables(f):
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return f(a, b)

    return run


def _whole_copies(docs: DataFrame) -> DataFrame:
    """Texts that stand under more than one id: shared from end to end. Counted with map-side aggregation, so a text that
    a third of all rows carry is one row per map task; the join back has one row per text on its other side."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.unhex(F.md5("text")).alias("h2"), F.length("text").cast("bigint").alias("to_char"))
    copied = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2")
    return keyed.join(copied, ["h1", "h2"], "left_semi").select("doc_id", F.lit(0).cast("bigint").alias("from_char"), "to_char").distinct()
