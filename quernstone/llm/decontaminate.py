"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Words of training and test texts are hashed; of every ``guarantee - k + 1``
consecutive k-gram hashes the smallest (rightmost of equals) is kept on both
sides. Equal kept hashes are joined, and each hit is extended by testing every
window of ``guarantee`` words that covers it. Because both sides pick by
content alone, every shared span of at least ``guarantee`` words shares a kept
hash, so no window is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import chunks, lean, mark, materialise, sweep, utf8

WINDOW, K = 8, 5
#: Words of benchmark text that one broadcast block may hold (8 bytes a word and table); more words make more blocks.
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def winnow(g: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Positions kept of the k-gram hashes ``g`` of rows ``first[i]:first[i+1]``: the smallest of each w in a row.

    A row of fewer than w hashes, but some, keeps its smallest.
    """
    n = len(g)
    keep = np.zeros(n, bool)
    counts = np.diff(first)
    if n >= w:
        low, at = g[: n - w + 1].copy(), np.zeros(n - w + 1, np.int64)
        for i in range(1, w):
            nxt = g[i : n - w + 1 + i]
            less = nxt <= low  # rightmost of equals
            low[less] = nxt[less]
            at[less] = i
        pos = np.arange(n - w + 1)
        row_end = np.repeat(first[1:], counts)[: n - w + 1]
        inside = pos + w <= row_end
        keep[(pos + at)[inside]] = True
    for r in np.flatnonzero((counts > 0) & (counts < w)):
        a, b = first[r], first[r + 1]
        keep[b - 1 - int(np.argmin(g[a:b][::-1]))] = True
    return np.flatnonzero(keep)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


@dataclass
class Index:
    """One block of benchmark items: kept fingerprints, and by window length the sorted window hashes with their items."""

    prints: np.ndarray
    coarse: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: hashes, item offsets, items
    window: int
    k: int

    @classmethod
    def build(cls, ids: list, texts: list, window: int = WINDOW, k: int = K) -> Index:
        data, offsets = utf8(pa.array(texts, pa.string()))
        w = ts.words(data, offsets, ts.ALNUM)
        prints, by_size = [], {}
        for i in range(len(texts)):
            h = w.hashes[w.first[i] : w.first[i + 1]]
            if len(h) == 0 or ids[i] is None:
                continue
            size = min(window, len(h))
            hashes = ts.grams(h, size)
            by_size.setdefault(size, []).append((hashes, np.full(len(hashes), i)))
            if size == window:
                g = ts.grams(h, k)
                prints.append(g[winnow(g, np.array([0, len(g)]), window - k + 1)])
        tables = {}
        for size, parts in by_size.items():
            hashes, items = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((items, hashes))
            hashes, items = hashes[order], items[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1])])
            tables[size] = (hashes[new], np.append(np.flatnonzero(new), len(hashes)), items)
        kept = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        coarse = np.zeros(1 << 20, bool)
        coarse[(kept >> np.uint64(44)).astype(np.int64)] = True
        return cls(kept, coarse, tables, window, k)

    def hits(self, w: ts.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks whose running sum is positive on words inside an occurring window; distinct (row, item) pairs that occur."""
        marks = np.zeros(len(w.hashes) + 1, np.int32)
        row_of = w.row
        rows, items = [], []
        for size, (table, offs, of) in self.windows.items():
            full = np.maximum(w.counts - size + 1, 0)
            n = len(w.hashes) - size + 1
            if n <= 0 or not full.any():
                continue
            if size == self.window:
                at = self._candidates(w)
            else:  # an item shorter than the window has no guaranteed fingerprint: its one window is looked up itself
                at = np.arange(n)
            end = w.first[1:][row_of[at]]
            at = at[at + size <= end]
            acc = np.zeros(len(at), np.uint64)
            for i in range(size):
                acc *= np.uint64(ts._GRAM)
                acc += w.hashes[at + i]
            value = ts.mix(acc)
            found = _member(value, table)
            at, value = at[found], value[found]
            if not len(at):
                continue
            np.add.at(marks, at, 1)
            np.add.at(marks, at + size, -1)
            entry = np.searchsorted(table, value)
            pair = np.unique(np.stack([row_of[at], entry]), axis=1)
            count = offs[pair[1] + 1] - offs[pair[1]]
            rows.append(np.repeat(pair[0], count))
            start = np.repeat(offs[pair[1]], count)
            items.append(of[start + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)])
        if not rows:
            return marks, np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        return marks, pairs[0], pairs[1]

    def _candidates(self, w: ts.Words) -> np.ndarray:
        """Window starts that cover a shared fingerprint."""
        k, span = self.k, self.window - self.k + 1
        full = np.where(w.counts >= self.window, w.counts - k + 1, 0)
        g = ts.grams(w.hashes, k)
        row = np.repeat(np.arange(len(full)), full)
        first = np.concatenate([[0], np.cumsum(full)])
        pos = w.first[row] + np.arange(len(row)) - first[row]
        if not len(pos):
            return pos
        kept = winnow(g[pos], first, span)
        value = g[pos[kept]]
        maybe = self.coarse[(value >> np.uint64(44)).astype(np.int64)]
        kept, value = kept[maybe], value[maybe]
        kept = kept[_member(value, self.prints)]
        at = pos[kept][:, None] - np.arange(span)[None, :]
        begin = w.first[row[kept]][:, None]
        return np.unique(at[at >= begin])


def _pieces(text: str, window: int) -> Iterator[str]:
    """The text, or pieces of at most about BLOCK_WORDS words that overlap so far that each window is whole in one."""
    if len(text) // 2 < BLOCK_WORDS:
        yield text
        return
    bounds = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    if len(bounds) <= BLOCK_WORDS:
        yield text
        return
    for lo in range(0, len(bounds), BLOCK_WORDS):
        hi = min(len(bounds), lo + BLOCK_WORDS + window - 1)
        if hi - lo >= window or lo == 0:  # fewer at the end are in the piece before
            yield text[bounds[lo][0] : bounds[hi - 1][1]]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, k: int) -> Iterator[tuple[Index, np.ndarray]]:
    """Indexes over benchmark rows, of at most about BLOCK_WORDS words each; a longer item comes in pieces."""
    ids, texts, size = [], [], 0
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        for piece in _pieces(r.t or "", window):
            n = min(len(piece) // 2, BLOCK_WORDS) + 1
            if ids and size + n > BLOCK_WORDS:
                yield Index.build(ids, texts, window, k), np.array(ids, object)
                ids, texts, size = [], [], 0
            ids.append(r.i)
            texts.append(piece)
            size += n
    yield Index.build(ids, texts, window, k), np.array(ids, object)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, k: int = K, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items (array of item ids as strings, sorted) and spans.

    spans: array of struct(begin, end) in words, the maximal runs of hit words.
    Null text has no words. Benchmark rows with a null id or no word match
    nothing; rows that repeat an id count as one item. Empty tables give zeros
    or no rows; repeated document rows each get their result. Columns of
    ``docs`` with the new names are replaced.

    The benchmark's fingerprints go to the documents: one broadcast per block
    of BLOCK_WORDS words (about 100 MB at most). A benchmark of several blocks
    is joined block by block, each pass adding to the spans and items of the
    one before, so nothing unbounded is ever broadcast and no document is
    shuffled; every further block costs a scan of the documents. Items longer
    than a block are split so that each window is whole in a piece.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "n_hit", "n_items", "spans", "items")
    kept = [c for c in out.columns if keep_text or c != "text"]
    blocks = _blocks(benchmark, id_col, text_col, window, k)
    block, since, before = next(blocks), mark(), None
    while block is not None:  # the driver holds this block and the next
        after = next(blocks, None)
        if before is not None:
            out = materialise(out, "decontaminate")
            sweep(spark, since, out)  # the pass before has been read
        last, before = after is None, block
        fields = [f for f in out.schema.fields if f.name not in ADDED and (f.name in kept or not last)]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_words long", "spans array<struct<begin:long,end:long>>", "items array<string>"])
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(block), [f.name for f in fields]), schema)
        block = after
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))


ADDED = ("n_words", "spans", "items")
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scanner(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            again = "spans" in batch.schema.names
            n_words, spans, items = [], [], []
            for lo, hi in chunks(offsets):
                w = ts.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ts.ALNUM)
                marks, rows, found = index.hits(w)
                if again:
                    for r, before in enumerate(batch.column("spans").slice(lo, hi - lo).to_pylist()):
                        for x in before:
                            marks[w.first[r] + x["begin"]] += 1
                            marks[w.first[r] + x["end"]] -= 1
                hit, row_of = np.cumsum(marks[:-1]) > 0, w.row
                n_words.append(w.counts)
                same = np.concatenate([[False], row_of[1:] == row_of[:-1]]) if len(hit) else hit  # as the word before
                edge = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & same)) if len(hit) else np.zeros(0, np.int64)
                stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & same[1:], [False]])) + 1 if len(hit) else edge
                of = row_of[edge]
                runs = [{"begin": x, "end": y} for x, y in zip((edge - w.first[of]).tolist(), (stop - w.first[of]).tolist(), strict=True)]
                cut = np.searchsorted(of, np.arange(hi - lo + 1)).tolist()
                at = np.searchsorted(rows, np.arange(hi - lo + 1)).tolist()
                spans += [runs[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                items += [sorted(set(names[found[a:b]].tolist())) if b > a else [] for a, b in zip(at[:-1], at[1:], strict=True)]
            if again:
                items = [sorted({*x, *y}) for x, y in zip(items, batch.column("items").to_pylist(), strict=True)]
            arrays = [*(batch.column(c) for c in columns), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *ADDED])

    return lean(run)


def digest(found: DataFrame, min_items: int = 2) -> DataFrame:
    """Adds items_sha256 (hex of the sorted ids, comma-joined) and contaminated (at least ``min_items`` items)."""
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256)).withColumn("contaminated", F.col("n_items") >= min_items)

