"""MinHash near-duplicate groups: banded universal-hash minima, verified links, connected components.

Documents link when the Jaccard similarity of their sets of word shingles is at
least ``threshold``. 32 bands of 4 minima miss a pair at similarity 0.8 with
probability (1 - 0.8^4)^32 < 5e-8. Candidates pass a length filter and a
signature filter (agreement of all 128 minima at least ``threshold`` less 5.5
standard deviations, about 0.61) and are then confirmed on the full sets.

Groups may hold any number of near copies, so pairs are never all emitted:

1. documents with equal sets collapse to one representative;
2. in every bucket each member is verified against one centre, and where
   members are then in different components, against another;
3. where they still are, all pairs that cross components are verified within
   tasks, which return an edge a member.

Every candidate pair is thus verified or already connected, which loses no link
that the components could show.
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
from .components import connected_components


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    chunk: int = 1024  # members of a bucket that meet as many others in one task
    seed: int = 20240229

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def agreement(self) -> float:
        t = self.percent / 100
        return t - 5.5 * (t * (1 - t) / self.hashes) ** 0.5

    def family(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers (odd) and offsets of the universal family x -> a x + b mod 2^64, ordered by its high bits."""
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return rng.integers(0, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, self.hashes, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of shingle hashes, ascending, with offsets."""
    return ts.distinct_sorted(*ts.row_grams(ts.words(data, offsets), size))


def signatures(sets: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima (rows x hashes) over rows that have shingles."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(a), len(starts)), np.uint64)
    if len(starts):
        buf = np.empty(len(sets), np.uint64)
        for i in range(len(a)):
            np.multiply(sets, a[i], out=buf)
            buf += b[i]
            np.minimum.reduceat(buf, starts, out=out[i])
    return out.T


_FEATURES = "id long, n long, fp1 long, fp2 long, bands array<long>, sig binary"


def _features(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = p.family()
        salt = np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets):
                sets, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p.shingle)
                n = np.diff(first)
                some = np.flatnonzero(n > 0)
                sig = signatures(sets, first, a, b)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(ts.mix(sets ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                prints = [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums]
                key = np.zeros((len(some), p.bands), np.uint64)
                for r in range(p.rows):
                    key *= np.uint64(0x5851F42D4C957F2D)
                    key += sig[:, r :: p.rows]
                key = ts.mix(ts.mix(key) + salt)
                small = np.ascontiguousarray((sig >> np.uint64(48)).astype(np.uint16))
                offs = np.zeros(hi - lo + 1, np.int32)
                offs[1:] = np.cumsum(np.where(n > 0, p.bands, 0))
                bands = pa.ListArray.from_arrays(pa.array(offs), pa.array(key.ravel().view(np.int64)))
                blobs = np.full(hi - lo, None, object)
                blobs[some] = [x.tobytes() for x in small]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), bands, pa.array(blobs, pa.binary())], names=["id", "n", "fp1", "fp2", "bands", "sig"])

    return lean(run)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets, 1 << 20):
                sets, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                blobs = [sets[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["id", "members"])

    return lean(run)


def _agree(p: Params):
    """Keeps pairs whose signatures agree enough; an estimate that errs on the side of keeping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, p.hashes) for c in ("sig_u", "sig_v"))
                ok = (left == right).mean(axis=1) >= p.agreement
                yield batch.select(["u", "v"]).filter(pa.array(ok))

    return lean(run)


def _confirm(p: Params):
    """Keeps pairs whose full sets reach the threshold; both come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                s, t = (np.frombuffer(c.as_buffer(), np.uint64) for c in (x, y))
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= p.percent * (len(both) - common) and common > 0)
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return lean(run)


def _members(ids: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(id, members): the full sets of the given ids."""
    ids = small_enough(materialise(ids, "asked"))  # else the texts are shuffled to them
    return materialise(texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_sets(p.shingle), "id long, members binary"), "sets")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Those of the distinct pairs (u, v) that really link, in the shared folder."""
    sig = reps.select("id", "sig")
    near = pairs.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("sig_u")), "u").join(sig.select(F.col("id").alias("v"), F.col("sig").alias("sig_v")), "v")
    near = materialise(near.select("u", "v", "sig_u", "sig_v").mapInArrow(_agree(p), "u long, v long"), "near")
    ids = near.select(F.col("u").alias("id")).union(near.select("v")).distinct()
    sets = _members(ids, texts, p)
    both = near.join(sets.select(F.col("id").alias("v"), F.col("members").alias("right")), "v").join(sets.select(F.col("id").alias("u"), F.col("members").alias("left")), "u")
    return materialise(both.select("u", "v", "left", "right").mapInArrow(_confirm(p), "u long, v long").distinct(), "links", tidy=True)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (long), component_id, kept (boolean).

    Null or blank texts have an empty set and link with nothing. Rows with a
    null id link with nothing, get a null component and are kept. Rows that
    repeat an id are one document with several texts: its links are those of
    any of them. Ids must fit a bigint. Other columns don't matter.
    """
    p = params
    since = mark()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feats = materialise(texts.mapInArrow(_features(p), _FEATURES), "signatures")
    full = feats.where("n > 0 and id is not null")
    classes = materialise(full.groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = materialise(full.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "representatives")
    # every representative in each of its buckets; a bucket of one is no candidate
    slots = reps.select(F.explode("bands").alias("key"), "id", "n")
    shared = slots.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(rehash("key").alias("key"))
    buckets = materialise(slots.join(shared, "key", "left_semi"), "buckets", tidy=True)
    pairs = materialise(_star(buckets.withColumn("component", F.col("id")), 0, p), "pairs")
    links = _verified(pairs, reps, texts, p)
    label = connected_components(links)
    # another star where members are still apart, about other centres; then all pairs that are left, within tasks
    rest = materialise(_star(_apart(buckets, label), 1, p).join(pairs, ["u", "v"], "left_anti"), "pairs")
    links = links.union(_verified(rest, reps, texts, p))
    label = connected_components(links)
    more = _crossing(_apart(buckets, label), reps, texts, p)
    if not more.isEmpty():
        label = connected_components(links.union(more))
    # documents -> class -> component; ids of a class share its representative, ids with several classes join them
    of = classes.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component"))
    of = materialise(of, "components")
    sweep(docs.sparkSession, since, feats, of)
    out = feats.select("id", "n", "fp1", "fp2").join(of, ["fp1", "fp2", "n"], "left")
    return _one_per_id(out).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _close(p: Params, a: str, b: str):
    """Set sizes that allow the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * p.percent


def _star(buckets: DataFrame, turn: int, p: Params) -> DataFrame:
    """Distinct pairs (u > v) of each bucket's members with its centre: the smallest in one of four orders, which differ by turn."""
    order = F.xxhash64("id", F.pmod("key", F.lit(4)), F.lit(turn))
    centre = buckets.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n", "component")).alias("c"))
    centre = centre.select(rehash("key").alias("key"), F.col("c.id").alias("b"), F.col("c.n").alias("nb"), F.col("c.component").alias("cb"))
    both = buckets.join(centre, "key").where((F.col("component") != F.col("cb")) & _close(p, "n", "nb"))
    return both.select(F.greatest("id", "b").alias("u"), F.least("id", "b").alias("v")).distinct()


def _apart(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Buckets whose members are in several components: key, id, n, component, and m, the smallest component."""
    placed = buckets.select("key", "id", "n").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    placed = materialise(placed.select("key", "id", "n", F.coalesce("component", "id").alias("component")), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("m"), F.max("component").alias("x")).where("m < x").select(rehash("key").alias("key"), "m")
    return materialise(placed.join(split, "key"), "split")


def _crossing(split: DataFrame, reps: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Edges (u, v) that join, within the buckets, all members of different components that link.

    Two passes over squares of a bucket, of at most two chunks of members: the
    first marks members with a partner that passes the length and signature
    filters, in the first bucket that the two share; the second intersects the
    full sets of the marked members. Neither returns pairs: marks are one a
    member, edges one a member and square.
    """
    size = split.groupBy("key").agg(F.ceil(F.count("*") / p.chunk).alias("parts")).select(rehash("key").alias("key"), "parts")
    rows = split.join(size, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    square = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    rows = rows.select("key", *square, "id", "n", "component").distinct().join(reps.select("id", "bands", "sig"), "id")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    marked = materialise(rows.mapInArrow(_mark(p), "key long, i long, j long, id long").distinct(), "marked", tidy=True)
    sets = _members(marked.select("id").distinct(), texts, p)
    rows = marked.join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return materialise(rows.mapInArrow(_intersect(p), "u long, v long").distinct(), "links", tidy=True)


def _squares(batches: Iterator[pa.RecordBatch], rows: int):
    """Tables of whole squares (key, i, j) from batches sorted by them, of about ``rows`` rows, with each row's square number."""
    held, size = [], 0

    def numbered(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        new = np.zeros(t.num_rows, np.int64)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            of = numbered(t)
            cut = int(np.searchsorted(of, of[-1]))  # the last may go on
            if cut:
                yield t.slice(0, cut).combine_chunks(), of[:cut]
                held, size = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
    if size:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbered(t)


def _mark(p: Params):
    def run(batches):
        for t, of in _squares(batches, 8_000):
            n, component = t.column("n").to_numpy(), t.column("component").to_numpy()
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, p.bands)
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, p.hashes)
            key = t.column("key").to_numpy()
            hit = np.zeros(len(of), bool)
            left = np.arange(len(of))
            for gap in range(1, len(of)):
                left = left[left + gap < len(of)]
                left = left[of[left] == of[left + gap]]
                if not len(left):
                    break
                a = left[component[left] != component[left + gap]]
                a = a[np.minimum(n[a], n[a + gap]) * 100 >= np.maximum(n[a], n[a + gap]) * p.percent]
                for s in range(0, len(a), 20_000):
                    x = a[s : s + 20_000]
                    y = x + gap
                    same = bands[x] == bands[y]
                    x = x[bands[x, same.argmax(axis=1)] == key[x]]  # the first band they share is this bucket
                    y = x + gap
                    ok = (sig[x] == sig[y]).mean(axis=1) >= p.agreement
                    hit[x[ok]] = hit[y[ok]] = True
            yield from t.select(["key", "i", "j", "id"]).filter(pa.array(hit)).to_batches()

    return lean(run)


def _intersect(p: Params, tile: int = 256):
    """Links among the members of each square, as an edge of each linked member to the smallest of its local component."""

    def links(sets: list[np.ndarray]) -> np.ndarray:
        found = []
        for a in range(0, len(sets), tile):
            for b in range(a, len(sets), tile):
                both = sets[a : a + tile] + (sets[b : b + tile] if b > a else [])
                sizes = np.array([len(x) for x in both])
                _, word = np.unique(np.concatenate(both), return_inverse=True)
                row = np.repeat(np.arange(len(both)), sizes)
                width = 1 << 14
                common = np.zeros((len(both), len(both)), np.float32)
                for w in range(0, int(word.max()) + 1, width):
                    here = (word >= w) & (word < w + width)
                    m = np.zeros((len(both), width), np.float32)
                    m[row[here], word[here] - w] = 1
                    common += m @ m.T
                i, j = np.nonzero(np.triu(100 * common >= p.percent * (sizes[:, None] + sizes[None, :] - common), 1))
                k = min(tile, len(sets) - a)
                found.append(np.stack([np.where(i < k, a + i, b + i - k), np.where(j < k, a + j, b + j - k)]))
        return np.concatenate(found, axis=1)

    def run(batches):
        for t, of in _squares(batches, 1_000):
            ids, blobs = t.column("id").to_numpy(), t.column("members").combine_chunks()
            cut = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of)).tolist()
            us, vs = [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                i, j = links([np.frombuffer(blobs[r].as_buffer(), np.uint64) for r in range(lo, hi)])
                low = ids[lo:hi].copy()
                while len(i):
                    new = low.copy()
                    np.minimum.at(new, i, low[j])
                    np.minimum.at(new, j, low[i])
                    if (new == low).all():
                        break
                    low = new
                moved = low != ids[lo:hi]
                us.append(ids[lo:hi][moved])
                vs.append(low[moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return lean(run)


def _one_per_id(out: DataFrame) -> DataFrame:
    """The component of a row: its class's, or its own id without shingles."""
    return out.withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
