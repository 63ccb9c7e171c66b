"""Line dedup by an exact set-similarity join (prefix, positional, length and bitmap filters).

A line is the set of its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased). A line
is removed when an earlier one - smaller (doc_id, line number) - has a Jaccard
similarity of at least ``percent``; the earlier one may itself be removed. Lines
of fewer than ``min_words`` different words are left alone; 1 leaves out none
that has a word.

Plan:

1. word counts of the whole corpus, hashed into a fixed table, order words by rarity;
2. equal lines, word for word, collapse to their first occurrence by a partial
   aggregation; sets too small to match any but an equal one (at most three
   words at 80) collapse as sets, which settles them: they post nothing;
3. each set posts its prefix, the ``n - ceil(t n) + 1`` rarest words, and
   postings are dealt out by word, packed as arrays. A task takes a word's
   postings by length and gives each line its earliest candidates that pass the
   length, positional and bitmap filters (parity bitmaps: their Hamming distance
   bounds the symmetric difference from below);
4. candidates are verified on full sets. A line that stays unresolved though
   it had more candidates gets all of them in a second round. So a group of
   thousands of near copies costs a candidate or two each, and no match is lost;
5. a key of more than ``hot`` postings is cut into slices. In the first round
   each posting meets its neighbours by length; in the second, lines that are
   still open meet all others of the key, a pair of slices a row, so that no
   task holds a hot key or compares all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import chunks, lean, mark, materialise, rehash, small_enough, sweep, utf8


@dataclass(frozen=True)
class Params:
    percent: int = 80
    min_words: int = 4
    counters: int = 1 << 17
    first: int = 1  # candidates a posting gets in the first round
    bucket: int = 100_000  # postings of a task's array, about
    hot: int = 8192  # postings of a key from which on they are dealt out in squares of so many
    reach: int = 64  # neighbours, by length, that a hot key's posting meets in the first round
    hold: int = 500_000  # postings that a task holds before it passes on those of hot keys

    @property
    def joined(self) -> int:
        """Words from which on a set can match an unequal one: 100 n >= percent (n + 1)."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 31


@dataclass
class Lines:
    """Line sets of a run of texts: row and line number of each, its keys by rarity, offsets."""

    row: np.ndarray
    line: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    said: np.ndarray  # hash of the words as a sequence

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)


def _lines(w: ts.Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each line that has words, and the offsets of their words."""
    row = w.row
    breaks = np.zeros(len(data) + 1, np.int32)  # line feeds before each byte
    np.cumsum(data == 10, out=breaks[1:])
    line = (breaks[w.begin] - breaks[offsets[:-1]][row]).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    start = np.flatnonzero(new)
    return row[start], line[start], np.append(start, len(row))


_ODD = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _sequence(hashes: np.ndarray, first: np.ndarray, odd: int) -> np.ndarray:
    """A hash of each line's words in their order: their hashes weighted by odd numbers that depend on the place."""
    weight = (np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    weight *= np.uint64(0x9E3779B97F4A7C16)
    weight += np.uint64(odd)
    weight *= hashes
    return _row_sum(weight, first)


def _as_sets(hashes: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different words of ``some`` lines, ascending, and their offsets."""
    size = np.diff(first)[some]
    who = np.repeat(np.arange(len(some)), size)
    h = hashes[np.arange(len(who)) + np.repeat(first[some] - (np.cumsum(size) - size), size)]
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(who[new], minlength=len(some)))])


def _enough(hashes: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Whether each line has at least ``least`` different words. Most show it in a bitmap of 64 slots; the others are counted."""
    ok = np.diff(first) >= least
    if len(ok) and least > 1:
        slots = np.bitwise_or.reduceat(np.uint64(1) << (hashes & np.uint64(63)), first[:-1])
        for i in np.flatnonzero(ok & (np.bitwise_count(slots) < least)):
            ok[i] = len(np.unique(hashes[first[i] : first[i + 1]])) >= least
    return ok


def line_sets(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, p: Params) -> Lines:
    """Sets of lines of at least ``min_words`` words that can match an unequal one. A key is 5 bits of the word's log2 count above 59 bits of its hash, so keys sort by rarity."""
    w = ts.words(data, offsets)
    row, line, first = _lines(w, data, offsets)
    said = _sequence(w.hashes, first, _ODD[0])
    key = w.hashes >> np.uint64(5)
    key |= counts[(w.hashes & np.uint64(len(counts) - 1)).astype(np.int64)]
    keys, first = ts.distinct_sorted(key, first)
    n = np.diff(first)
    ok = n >= max(p.min_words, p.joined)
    if not ok.all():
        keys = keys[np.repeat(ok, n)]
        first = np.concatenate([[0], np.cumsum(n[ok])])
    return Lines(row[ok], line[ok], keys, first, said[ok])


def _cut_out(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given lines, end to end, and their offsets."""
    feeds = np.flatnonzero(data == 10)
    nth = np.searchsorted(feeds, offsets[row]) + line  # the line feed that ends the line, if one does
    edge = np.concatenate([[-1], feeds, [len(data)]])
    begin, end = np.where(line > 0, edge[nth] + 1, offsets[row]), np.minimum(edge[nth + 1], offsets[row + 1])
    first = np.concatenate([[0], np.cumsum(end - begin)])
    return data[np.arange(first[-1]) + np.repeat(begin - first[:-1], end - begin)], first


def _texts(batch: pa.RecordBatch, limit: int = 1 << 18):
    data, offsets = utf8(batch.column("text"))
    for lo, hi in chunks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _row_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _survey(p: Params):
    """One scan for two results: the words of every line (fp1, fp2) as a sequence, or as a set if only an equal set can match, with its place, and, once a task, its word counters (i, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.counters, np.int64)
        for batch in batches:
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            known = np.asarray(batch.column("doc").is_valid())
            for lo, _, data, offsets in _texts(batch):
                w = ts.words(data, offsets)
                total += np.bincount((w.hashes & np.uint64(p.counters - 1)).astype(np.int64), minlength=p.counters)
                row, line, first = _lines(w, data, offsets)
                fp = [_sequence(w.hashes, first, odd) for odd in _ODD]
                ok = known[lo + row] & _enough(w.hashes, first, p.min_words)
                small = np.flatnonzero(ok & ~_enough(w.hashes, first, p.joined)) if p.min_words < p.joined else []
                if len(small):
                    sets = _as_sets(w.hashes, first, small)
                    for x, odd in zip(fp, _ODD, strict=True):
                        x[small] = _sequence(*sets, odd)
                none = pa.nulls(int(ok.sum()))
                yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.int64()), pa.array(fp[0][ok]), pa.array(fp[1][ok]), pa.array(doc[lo + row[ok]].astype(np.int64)), pa.array(line[ok], pa.int32())], names=_SURVEY)
        some = np.flatnonzero(total)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some]), none, none, none, none.cast(pa.int32())], names=_SURVEY)

    return lean(run)


_SURVEY = ["i", "c", "fp1", "fp2", "doc", "line"]


def _table(survey: DataFrame, p: Params) -> np.ndarray:
    """Word counts of all texts, by hash."""
    rows = survey.where("i is not null").groupBy("i").agg(F.sum("c").alias("c")).toArrow()  # p.counters rows at most
    total = np.zeros(p.counters, np.int64)
    total[rows.column("i").to_numpy()] = rows.column("c").to_numpy()
    return total


POSTING = np.dtype([("key", "u8"), ("low", "u8"), ("high", "u8"), ("doc", "i8"), ("line", "i4"), ("n", "i4"), ("pos", "i4")])
_PACKED = "bucket int, kind int, packed binary"


def _cells(rows: np.ndarray, bucket: np.ndarray, kind: int, most: int = 1 << 14) -> pa.RecordBatch:
    """Rows that come by bucket as cells of at most ``most`` rows of one bucket."""
    at = np.arange(len(rows))
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rows) else at
    cut = np.flatnonzero((at - np.repeat(cut, np.diff(np.append(cut, len(rows))))) % most == 0)
    ends = np.append(cut, len(rows))[1:]
    blobs = [rows[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(np.full(len(cut), kind, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "packed"])


def _postings(shared, p: Params, buckets: int, window: int = 4 << 20):
    """Prefix postings. Equal lines within a window of texts are posted once, at their first place."""

    def flush(held):
        doc, line, fp, n, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.concatenate([[0], np.cumsum(n)])
        order = np.lexsort((line, doc, fp))
        new = np.ones(len(order), bool)
        new[1:] = fp[order][1:] != fp[order][:-1]
        pick = np.sort(order[new])
        # parity bitmap of 128 bits: bit b is set if an odd number of the set's words hash to b
        slot = ts.mix(keys.copy())
        bit, upper = np.uint64(1) << (slot & np.uint64(63)), (slot >> np.uint64(6) & np.uint64(1)).astype(bool)
        low, high = (np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), first[:-1]) for half in (~upper, upper))
        size = n[pick] - (n[pick] * p.percent + 99) // 100 + 1
        at = np.repeat(np.arange(len(pick)), size)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        key = keys[first[pick[at]] + pos]
        bucket = (key % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        who, out = pick[at[by]], np.empty(len(by), POSTING)
        out["key"], out["pos"] = key[by], pos[by]
        for name, value in (("low", low), ("high", high), ("doc", doc), ("line", line), ("n", n)):
            out[name] = value[who]
        return _cells(out, bucket[by], 0)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for lo, _, data, offsets in _texts(batch):
                x = line_sets(data, offsets, shared.value, p)
                if len(x.row):
                    held.append((doc[lo + x.row], x.line, x.said, x.n, x.keys))
                size += len(data)
                if size > window and held:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return lean(run)


ASKING = np.dtype([("key", "u8"), ("doc", "i8"), ("line", "i4")])


def _asking(buckets: int):
    """Packs unresolved (key, doc, line) for the tasks that hold their keys."""

    def run(batches):
        for batch in batches:
            rows = np.empty(batch.num_rows, ASKING)
            rows["key"] = batch.column("key").to_numpy().view(np.uint64)
            rows["doc"], rows["line"] = batch.column("doc").to_numpy(), batch.column("line").to_numpy()
            bucket = (rows["key"] % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            yield _cells(rows[by], bucket[by], 1)

    return lean(run)


#: Candidates; postings of keys that have more (packed); slices of hot keys (packed, with the least and largest set).
_CANDIDATE = "doc long, line int, doc0 long, line0 int, key long, more boolean, bucket int, packed binary, least int, largest int"


def candidates(rows: np.ndarray, p: Params, skip: int, take: int, asking: np.ndarray | None = None, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings by key and length, and among them (later, earlier, more) of candidate pairs that pass the filters.

    Equal lines of different windows are candidates too; that the later place
    is confirmed says nothing new. Each later line gets its ``skip``-th to ``take``-th earliest candidates of
    a key; more: there are others after those. asking: only these get any.
    reach: a posting meets only so many neighbours.
    """
    if asking is not None:
        rows = rows[np.isin(rows["key"], asking["key"])]
    rows = rows[_by_key(rows["key"])[1]]  # without keys of one row
    rows = rows[np.lexsort((rows["line"], rows["doc"], rows["n"], rows["key"])) if reach else np.lexsort((rows["n"], rows["key"]))]
    key, n = rows["key"], rows["n"].astype(np.int64)
    group = np.zeros(len(rows), np.int64)
    group[1:] = np.cumsum(key[1:] != key[:-1])
    # by key and length, the partners of a row are those after it while the length allows
    low = np.arange(1, len(rows) + 1)
    high = np.searchsorted(group << 32 | n, group << 32 | n * 100 // p.percent, "right")
    return rows, *_pairs(rows, low, high if reach is None else np.minimum(high, low + reach), p, skip, take, asking)


def across(left: np.ndarray, right: np.ndarray, p: Params, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``candidates`` for the pairs between two sets of postings of one key, each by length."""
    short, long = left["n"].astype(np.int64), right["n"].astype(np.int64)
    low = np.concatenate([len(left) + np.searchsorted(long, short, "left"), np.searchsorted(short, long, "right")])
    high = np.concatenate([len(left) + np.searchsorted(long, short * 100 // p.percent, "right"), np.searchsorted(short, long * 100 // p.percent, "right")])
    rows = np.concatenate([left, right])
    return rows, *_pairs(rows, low, high, p, 0, 1 << 62, asking)


def _pairs(rows: np.ndarray, first: np.ndarray, last: np.ndarray, p: Params, skip: int, take: int, asking: np.ndarray | None, block: int = 1 << 18, hold: int = 300_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, more) of the pairs of each row with the rows from ``first`` to before ``last``, none of which is shorter."""
    asks = np.ones(len(rows), bool)
    if asking is not None:
        both = np.concatenate([asking, rows[list(ASKING.names)].astype(ASKING)])
        _, inverse = np.unique(both, return_inverse=True)
        wanted = np.zeros(inverse.max(initial=-1) + 1, bool)
        wanted[inverse[: len(asking)]] = True
        asks = wanted[inverse[len(asking) :]]
    n, room = rows["n"].astype(np.int32), (rows["n"] - rows["pos"]).astype(np.int32)
    low, high, doc, line = (np.ascontiguousarray(rows[c]) for c in ("low", "high", "doc", "line"))
    kept = take + 1 if take < 1 << 40 else take

    def earliest(found: np.ndarray) -> np.ndarray:
        """The first ``kept`` of each later row."""
        found = found[:, np.lexsort((line[found[1]], doc[found[1]], found[0]))]
        head = np.ones(found.shape[1], bool)
        head[1:] = found[0][1:] != found[0][:-1]
        at = np.flatnonzero(head)
        rank = np.arange(found.shape[1]) - np.repeat(at, np.diff(np.append(at, found.shape[1])))
        return found[:, rank < kept]

    # the shorter of a pair: its place must leave room for the overlap that two sets of its size need, the least there is
    wide = n.astype(np.int64)
    size = np.where(room >= (2 * p.percent * wide + 99 + p.percent) // (100 + p.percent), np.maximum(last - first, 0), 0)
    left = np.flatnonzero(size)
    size = size[left]
    total = np.concatenate([[0], np.cumsum(size)])
    pairs, held, lo = [np.zeros((2, 0), np.int64)], 0, 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + block, "right")) - 1)
        a = np.repeat(left[lo:hi], size[lo:hi])
        b = np.arange(total[hi] - total[lo]) + np.repeat(first[left[lo:hi]] - (total[lo:hi] - total[lo]), size[lo:hi])
        lo = hi
        if asking is not None:
            some = asks[a] | asks[b]
            a, b = a[some], b[some]
        both = wide[a] + wide[b]
        need = (p.percent * both + 99 + p.percent) // (100 + p.percent)
        ok = np.minimum(room[a], room[b]) >= need
        a, b, slack = a[ok], b[ok], (both - 2 * need)[ok]
        ok = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b]) <= slack
        ok &= (doc[a] != doc[b]) | (line[a] != line[b])  # rows that repeat an id post the same place twice
        a, b = a[ok], b[ok]
        swap = (doc[a] > doc[b]) | (doc[a] == doc[b]) & (line[a] > line[b])
        found = np.stack([np.where(swap, a, b), np.where(swap, b, a)])
        found = found[:, asks[found[0]]]
        if found.shape[1]:
            pairs.append(found)
            held += found.shape[1]
            if held > hold and kept < 1 << 40:
                pairs = [earliest(np.concatenate(pairs, axis=1))]
                held = pairs[0].shape[1]
                hold = max(hold, 2 * held)
    found = earliest(np.concatenate(pairs, axis=1))
    head = np.ones(found.shape[1], bool)
    head[1:] = found[0][1:] != found[0][:-1]
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, found.shape[1]))
    rank = np.arange(found.shape[1]) - np.repeat(at, count)
    beyond = np.repeat(count, count) > take
    ok = (rank >= skip) & (rank < take)
    return found[0][ok], found[1][ok], beyond[ok]


def _by_key(key: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The keys of at least ``least`` rows, and their rows by key."""
    by = np.argsort(key)
    key = key[by]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(start, len(key)))
    return key[start[size >= least]], by[np.repeat(size >= least, size)]


def _rows(n: int, **columns) -> pa.RecordBatch:
    """``n`` rows of _CANDIDATE; columns that aren't given are null."""
    fields = [pa.field("doc", pa.int64()), pa.field("line", pa.int32()), pa.field("doc0", pa.int64()), pa.field("line0", pa.int32()), pa.field("key", pa.int64()), pa.field("more", pa.bool_()), pa.field("bucket", pa.int32()), pa.field("packed", pa.binary()), pa.field("least", pa.int32()), pa.field("largest", pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=pa.schema(fields))


def _found(rows: np.ndarray, b: np.ndarray, a: np.ndarray, more: np.ndarray, bucket: int) -> pa.RecordBatch:
    return _rows(len(b), doc=rows["doc"][b], line=rows["line"][b], doc0=rows["doc"][a], line0=rows["line"][a], key=rows["key"][b].view(np.int64), more=more, bucket=np.full(len(b), bucket, np.int32))


def _walk(p: Params, skip: int, take: int, only: bool):
    """Candidates of packed postings that come sorted by bucket; of keys that have more, the postings come out again, in cells; those of hot keys in slices."""

    def shed(rows: np.ndarray, hot: np.ndarray, bucket: int):
        """Postings without those of hot keys, the hot keys so far, and what comes out for them."""
        hot = np.union1d(hot, _by_key(rows["key"], p.hot + 1)[0])
        mine = np.isin(rows["key"], hot) if len(hot) else np.zeros(len(rows), bool)
        some, out = rows[mine], []
        if len(some):
            out.append(_found(*candidates(some, p, 0, p.first, reach=p.reach), bucket))
            some = some[np.lexsort((some["line"], some["doc"], some["n"], some["key"]))]
            head = np.flatnonzero(np.concatenate([[True], some["key"][1:] != some["key"][:-1]]))
            rank = np.arange(len(some)) - np.repeat(head, np.diff(np.append(head, len(some))))
            cut = np.flatnonzero(rank % p.hot == 0)
            slices = [some[x:y] for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(some)], strict=True)]
            out += [_rows(1, key=x["key"][:1].view(np.int64), packed=[x.tobytes()], least=x["n"][:1], largest=x["n"][-1:]) for x in slices]
        return rows[~mine], hot, out

    def walk(rows: np.ndarray, asking: np.ndarray, bucket: int):
        rows, b, a, more = candidates(rows, p, skip, take, asking if only else None)
        yield _found(rows, b, a, more, bucket)
        if not only:
            again = rows[np.isin(rows["key"], rows["key"][b[more]])]
            cells = _cells(again, np.full(len(again), bucket, np.int32), 0)
            yield _rows(cells.num_rows, bucket=cells.column("bucket"), packed=cells.column("packed"))

    def run(batches):
        held, asking, bucket, size, hot = [], [], None, 0, np.zeros(0, np.uint64)
        of = lambda xs, t: np.concatenate([np.frombuffer(x, t) for x in xs] or [np.zeros(0, t)])

        def end():
            rows, _, out = shed(of(held, POSTING), hot, bucket) if not only else (of(held, POSTING), hot, [])
            yield from out
            yield from walk(rows, of(asking, ASKING), bucket)

        for batch in batches:
            for b, kind, packed in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("packed"), strict=True):
                if b != bucket:
                    if held or asking:
                        yield from end()
                    held, asking, bucket, size, hot = [], [], b, 0, np.zeros(0, np.uint64)
                packed = packed.as_buffer().to_pybytes()
                (held if kind == 0 else asking).append(packed)
                size += len(packed) // POSTING.itemsize if kind == 0 else 0
                if size > p.hold and not only:
                    rows, hot, out = shed(of(held, POSTING), hot, bucket)
                    yield from out
                    held, size = [rows.tobytes()], 0
        if held or asking:
            yield from end()

    return lean(run)


def _places(batches):
    """(key, slice, doc, line) of every posting in slices."""
    for batch in batches:
        for key, number, packed in zip(*(batch.column(c) for c in ("key", "slice", "packed")), strict=True):
            x = np.frombuffer(packed.as_buffer(), POSTING)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), key.as_py())), pa.array(np.full(len(x), number.as_py())), pa.array(x["doc"]), pa.array(x["line"])], names=["key", "slice", "doc", "line"])


def _meet(p: Params):
    """Candidates of the open lines of two slices of a key, or of one with itself."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(c)[r].as_buffer(), POSTING) for c in ("packed", "packed1"))
                alone = batch.column("slice")[r] == batch.column("slice1")[r]
                asking = np.zeros(sum(len(batch.column(c)[r].values) for c in ("docs", "docs1") if batch.column(c)[r].is_valid), ASKING)
                asking["key"] = left["key"][0]
                for name, columns in (("doc", ("docs", "docs1")), ("line", ("lines", "lines1"))):
                    asking[name] = np.concatenate([batch.column(c)[r].values.to_numpy() for c in columns if batch.column(c)[r].is_valid])
                yield _found(*(candidates(left, p, 0, 1 << 62, asking) if alone else across(left, right, p, asking)), 0)

    return lean(run)


def _hot_pairs(found: DataFrame, near: DataFrame, p: Params) -> DataFrame | None:
    """Candidates of open lines among all postings of hot keys."""
    hot = found.where("least is not null").select("key", F.xxhash64("packed").alias("slice"), "packed", "least", "largest")
    if hot.isEmpty():
        return None
    places = hot.mapInArrow(lean(_places), "key long, slice long, doc long, line int")
    open_ = places.join(near, ["doc", "line"], "left_anti").groupBy("key", "slice").agg(F.collect_list("doc").alias("docs"), F.collect_list("line").alias("lines"))  # of one slice: p.hot at most
    full = materialise(hot.join(open_, ["key", "slice"], "left"), "hot-slices", tidy=True)
    narrow = full.select("key", "slice", "least", "largest", F.col("docs").isNotNull().alias("open"))
    other = narrow.toDF("key", "slice1", "least1", "largest1", "open1")
    reach = (F.col("least1") * p.percent <= F.col("largest") * 100) & (F.col("least") * p.percent <= F.col("largest1") * 100)
    squares = narrow.join(other, "key").where((F.col("slice") <= F.col("slice1")) & (F.col("open") | F.col("open1")) & reach).select("key", "slice", "slice1").distinct()
    first = full.select("key", "slice", "packed", "docs", "lines")
    both = materialise(squares, "squares").join(first, ["key", "slice"]).join(first.toDF("key", "slice1", "packed1", "docs1", "lines1"), ["key", "slice1"])
    return both.mapInArrow(_meet(p), _CANDIDATE)


def _sets(p: Params):
    def run(batches):
        for batch in batches:
            doc, lines = batch.column("doc").to_numpy(), batch.column("lines")
            for lo, hi, data, offsets in _texts(batch, 1 << 20):
                asked = lines.slice(lo, hi - lo)
                row, line = np.repeat(np.arange(hi - lo), asked.value_lengths().to_numpy()), asked.flatten().to_numpy().astype(np.int64)
                w = ts.words(*_cut_out(data, offsets, row, line))
                keys, first = ts.distinct_sorted(w.hashes, w.first)
                for i in range(0, len(row), 1 << 20):  # offsets of a batch have 31 bits
                    cut = first[i : i + (1 << 20) + 1]
                    members = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(((cut - cut[0]) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys[cut[0] : cut[-1]]))])
                    yield pa.RecordBatch.from_arrays([pa.array(doc[lo + row[i : i + (1 << 20)]], pa.int64()), pa.array(line[i : i + (1 << 20)], pa.int32()), members], names=["doc", "line", "members"])

    return lean(run)


def _confirm(p: Params):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                both = np.concatenate([np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= p.percent * (len(both) - common))
            yield batch.select(["doc", "line"]).filter(pa.array(ok, pa.bool_()))

    return lean(run)


def _verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(doc, line) of those candidates whose full sets match an earlier line."""
    pairs = materialise(pairs.select("doc", "line", "doc0", "line0").distinct(), "candidate-pairs", tidy=True)
    need = pairs.select("doc", "line").union(pairs.select("doc0", "line0")).distinct().groupBy("doc").agg(F.collect_list("line").alias("lines"))
    need = small_enough(materialise(need, "asked"), lists="lines")
    sets = materialise(texts.join(need, "doc").select("doc", "lines", "text").mapInArrow(_sets(p), "doc long, line int, members binary"), "line-sets", tidy=True)
    later, earlier = sets.withColumnRenamed("members", "left"), sets.toDF("doc0", "line0", "right")
    both = pairs.join(later, ["doc", "line"]).join(earlier, ["doc0", "line0"]).select("doc", "line", "left", "right")
    return materialise(both.mapInArrow(_confirm(p), "doc long, line int").distinct(), "near", tidy=True)


def _repeats(lines: DataFrame) -> DataFrame:
    """(doc, line) of every line that equals an earlier one: all of a class but its first.

    The smallest doc comes from a hash aggregation, which a smallest (doc,
    line) wouldn't get; the smallest line is then looked for in that doc only.
    """
    classes = lines.groupBy("fp1", "fp2").agg(F.min("doc").alias("doc0"), F.count("*").alias("c")).where("c > 1").drop("c")
    classes = classes.select(rehash("fp1").alias("fp1"), "fp2", "doc0")
    copies = materialise(lines.join(classes, ["fp1", "fp2"]), "copies", tidy=True)
    home = copies.where("doc = doc0").groupBy("fp1", "fp2").agg(F.min("line").alias("line0"), F.max("line").alias("last")).where("line0 < last")
    home = copies.where("doc = doc0").join(home.select(rehash("fp1").alias("fp1"), "fp2", "line0"), ["fp1", "fp2"]).where("line > line0")
    return copies.where("doc <> doc0").select("doc", "line").union(home.select("doc", "line"))


def removals(docs: DataFrame, id_col: str = "doc_id", params: Params = Params()) -> DataFrame:
    """(doc, lines): the numbers, from 0, of the lines to remove from each document that loses any."""
    p, sc = params, docs.sparkSession.sparkContext
    every = docs.select(F.col(id_col).cast("long").alias("doc"), "text")
    texts = every.where("doc is not null")
    survey = materialise(every.mapInArrow(_survey(p), "i int, c long, fp1 long, fp2 long, doc long, line int"), "lines")
    lines, counts = survey.where("doc is not null").select("fp1", "fp2", "doc", "line"), _table(survey, p)
    buckets = int(counts.sum() * (100 - p.percent) // 100 // p.bucket) + 1
    shared = sc.broadcast(np.minimum(np.log2(counts + 1.0), 31).astype(np.uint64) << np.uint64(59))
    postings = texts.mapInArrow(_postings(shared, p, buckets), _PACKED)
    found = materialise(postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_walk(p, 0, p.first, False), _CANDIDATE), "candidates", tidy=True)
    near = _verify(found.where("doc is not null"), texts, p)
    more = materialise(found.where("more").select("key", "doc", "line").distinct().join(near, ["doc", "line"], "left_anti"), "unresolved")
    rest = _hot_pairs(found, near, p)
    if not more.isEmpty():  # all candidates of those that had more than the first round tried; the postings of their keys are at hand
        both = found.where("bucket is not null and packed is not null").select("bucket", F.lit(0).alias("kind"), "packed").union(more.mapInArrow(_asking(buckets), _PACKED))
        cold = both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_walk(p, p.first, 1 << 62, True), _CANDIDATE)
        rest = cold if rest is None else rest.union(cold)
    if rest is not None:
        near = near.union(_verify(materialise(rest, "candidates", tidy=True), texts, p))
    # a class's first line goes if it is near an earlier one, its others go anyway
    gone = near.union(_repeats(lines)).distinct()
    return gone.groupBy("doc").agg(F.collect_list("line").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", params: Params = Params()) -> DataFrame:
    """``docs`` without the removed lines, plus n_lines and n_removed (long).

    Null texts stay null and blank lines stay. Rows with a null id keep all
    their lines and remove none elsewhere. Rows that repeat an id are one
    document: they lose the same line numbers, and lines of the same number
    none to one another. A line
    goes with its line feed. A column n_chars is brought up to date; columns of
    ``docs`` named n_lines, n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    since = mark()
    gone = materialise(removals(docs, id_col, params), "removals", tidy=True)
    sweep(docs.sparkSession, since, gone)
    gone = small_enough(gone.toDF("_doc", "_lines"), lists="_lines")
    both = docs.join(gone, docs[id_col].cast("long") == F.col("_doc"), "left").drop("_doc")
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    both = both.withColumn("n_lines", F.when(F.octet_length("text") > 0, feeds + 1).otherwise(0).cast("long"))
    # the lines and the numbers that stay, bound once so that a long text is split once
    every = F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1)
    part = F.struct(F.split("text", "\n", -1).alias("lines"), F.array_except(every, F.array_sort("_lines")).alias("left"))
    less = F.transform(F.array(part), lambda x: F.struct(F.array_join(F.transform(x["left"], lambda i: F.get(x["lines"], i)), "\n").alias("text"), F.size(x["left"]).alias("n")))[0]
    cut = F.col("_lines").isNotNull() & (F.col("n_lines") > 0)
    both = both.withColumn("_less", F.when(cut, less)).withColumn("n_removed", F.when(cut, F.col("n_lines") - F.col("_less.n")).otherwise(0).cast("long"))
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = {c: F.col(c) for c in names} | {"text": F.when(F.col("_less").isNotNull(), F.col("_less.text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("_less.text").cast(kind)).otherwise(F.col("n_chars"))
    return both.select(*[out[c].alias(c) for c in docs.columns], "n_lines", "n_removed")
