"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors u, v with cosine >= c have |u - v|^2 <= 2 (1 - c). After a random
rotation the coordinates are cut into blocks of equal width; by the pigeonhole
principle at least one block holds no more than its proportional share of that
squared distance. Each block is joined by range: its leading coordinates make
grid cells, a vector is stored in its home cell and asks every cell that the
block's ball touches. A pair counts in the first block whose budget it meets,
so nothing is counted twice, and is confirmed by the cosine of the original
vectors in double precision.

A cell may hold any number of vectors: it is dealt out in squares of at most
``chunk`` homes by ``chunk`` askers. What is dealt are a block's coordinates
only; a first pass marks the vectors that have a partner under the block's
budget, and whole vectors are fetched for the squares of marked ones. Then a
task returns, per vector, a number of links and one edge to the smallest vector
of its local component, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mark, materialise, rehash, small_enough, sweep
from .components import connected_components


@dataclass(frozen=True)
class Params:
    cosine: float = 0.98
    blocks: int = 8
    grid: int = 2
    width: float = 3.0  # of a cell, in radii
    chunk: int = 1024
    seed: int = 20240229


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Space:
    """The rotation of one dimension with its blocks, budgets and grids."""

    def __init__(self, dim: int, p: Params):
        q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(p.seed + dim)).standard_normal((dim, dim)))
        self.q, self.p = q, p
        cuts = np.linspace(0, dim, min(p.blocks, dim) + 1).round().astype(int)
        self.blocks = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.budget = [2 * (1 - p.cosine) * (b - a) / dim + 1e-12 for a, b in self.blocks]

    def rotate(self, units: np.ndarray) -> np.ndarray:
        return np.einsum("nd,de->ne", units, self.q)  # no BLAS: a row's result doesn't depend on its batch

    def cells(self, rotated: np.ndarray):
        """(block, row, cell, home) of every cell that a row lives in or asks."""
        for b, (lo, hi) in enumerate(self.blocks):
            r = self.budget[b] ** 0.5 * (1 + 1e-9)
            x, c = rotated[:, lo : min(lo + self.p.grid, hi)], r * self.p.width
            home, low, high = (np.floor(y / c).astype(np.int64) for y in (x, x - r, x + r))
            yield b, np.arange(len(x)), self._key(home), True
            for step in product(*[range(int(s) + 1) for s in (high - low).max(axis=0)]):
                cell = low + np.array(step)
                ok = (cell <= high).all(axis=1)
                yield b, np.flatnonzero(ok), self._key(cell[ok]), False

    @staticmethod
    def _key(cell: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), np.int64)
        for j in range(cell.shape[1]):
            out = out * (1 << 20) + cell[:, j] + (1 << 19)
        return out


_spaces: dict = {}


def _space(dim: int, p: Params) -> Space:
    if (dim, p) not in _spaces:
        _spaces[dim, p] = Space(dim, p)
    return _spaces[dim, p]


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _slots(p: Params):
    schema = ["block", "cell", "home", "cid", "coords"]

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat, at = _matrix(batch.column("vec")), np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for part in np.array_split(rows, len(rows) // 4096 + 1):
                    x = flat[at[part][:, None] + np.arange(dim)]
                    space, cid, label = _space(int(dim), p), batch.column("cid").to_numpy()[part], batch.column("label").take(pa.array(part))
                    rotated = space.rotate(unit(x))
                    for b, row, cell, home in space.cells(rotated):
                        n, (lo, hi) = len(row), space.blocks[b]
                        at_ = pa.py_buffer((np.arange(n + 1) * (hi - lo) * 4).astype(np.int32))
                        coords = pa.Array.from_buffers(pa.binary(), n, [None, at_, pa.py_buffer(np.ascontiguousarray(rotated[row, lo:hi], np.float32))])
                        yield pa.RecordBatch.from_arrays([label.take(pa.array(row)), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(cell), pa.array(np.full(n, home)), pa.array(cid[row]), coords], names=["label", "dim", *schema])

    return lean(run)


_KEY = ["label", "dim", "block", "cell", "hi", "gi"]


def _mark(p: Params):
    """The rows of one square that have a partner under the block's budget, as far as coordinates in single precision tell; these err on the side of keeping."""

    def run(table: pa.Table) -> pa.Table:
        budget = _space(table.column("dim")[0].as_py(), p).budget[table.column("block")[0].as_py()] + 1e-5
        x = np.frombuffer(b"".join(table.column("coords").to_pylist()), np.float32).reshape(table.num_rows, -1)
        home, cid = table.column("home").to_numpy(), table.column("cid").to_numpy()
        h, g = np.flatnonzero(home), np.flatnonzero(~home)
        size, hit = (x * x).sum(axis=1), np.zeros(table.num_rows, bool)
        for part in np.array_split(g, max(1, len(g) * len(h) // 500_000 + 1)):
            near = size[part][:, None] + size[h][None, :] - 2 * (x[part] @ x[h].T) <= budget
            near &= cid[part][:, None] != cid[h][None, :]
            hit[part] |= near.any(axis=1)
            hit[h] |= near.any(axis=0)
        return table.select([*_KEY, "home", "cid"]).filter(pa.array(hit))

    return run


def _square(p: Params):
    """Links of one square of one cell."""

    def run(table: pa.Table) -> pa.Table:
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        space = _space(dim, p)
        raw = _matrix(table.column("vec")).reshape(-1, dim)
        rot = space.rotate(unit(raw))
        size = np.sqrt((raw * raw).sum(axis=1))
        home = table.column("home").to_numpy()
        cid, rep, mult = (table.column(c).to_numpy() for c in ("cid", "rep", "mult"))
        h, g = np.flatnonzero(home), np.flatnonzero(~home)
        lo, hi = space.blocks[block]
        out_i, out_j = [], []
        for part in np.array_split(g, max(1, len(g) * len(h) // 500_000 + 1)):
            x, y = rot[part][:, lo:hi], rot[h][:, lo:hi]
            d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
            i, j = np.nonzero((d2 <= space.budget[block] + 1e-9) & (cid[part][:, None] != cid[h][None, :]))
            for s in range(0, len(i), 50_000):
                a, b = part[i[s : s + 50_000]], h[j[s : s + 50_000]]
                ok = _cosine(raw, size, a, b) >= p.cosine
                a, b = a[ok], b[ok]
                first = np.full(len(a), -1)
                for k, (m, n) in enumerate(space.blocks[: block + 1]):
                    diff = rot[a, m:n] - rot[b, m:n]
                    first = np.where((first < 0) & ((diff * diff).sum(axis=1) <= space.budget[k]), k, first)
                out_i.append(a[first == block])
                out_j.append(b[first == block])
        i, j = np.concatenate([np.zeros(0, np.int64), *out_i]), np.concatenate([np.zeros(0, np.int64), *out_j])
        links = np.bincount(i, weights=mult[j], minlength=len(cid)).astype(np.int64)
        # smallest representative of each local component; one class may be here as home and as asker
        same = {}
        first_of = np.array([same.setdefault(c, n) for n, c in enumerate(cid.tolist())])
        low, i, j = rep.copy(), first_of[i], first_of[j]
        while len(i):
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            if (new == low).all():
                break
            low = new
        linked = np.zeros(len(cid), bool)
        linked[i] = linked[j] = True
        keep = np.flatnonzero(linked | (links > 0))
        return pa.table({"cid": cid[keep], "rep": rep[keep], "links": links[keep], "low": low[first_of[keep]]})

    return run


def _cosine(raw: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        plain = (raw[a] * raw[b]).sum(axis=1) / (size[a] * size[b])
    bad = ~np.isfinite(plain)
    if bad.any():  # sizes out of range: scale first
        plain[bad] = (unit(raw[a[bad]]) * unit(raw[b[bad]])).sum(axis=1)
    return plain


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: Params = Params()) -> DataFrame:
    """One row per row of ``df``: id, n_links (long), component_id, kept (boolean).

    Vectors of equal non-null label and equal length are compared. Null or empty
    vectors, zero vectors, vectors with null or non-finite components and rows
    with a null label or id link with nothing (component: their own id; kept).
    Equal vectors link with one another and count one by one. Rows that repeat
    an id with different vectors share a component; an empty table gives no
    rows. Other columns don't matter.
    """
    p, since = params, mark()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0), F.lit(False))
    prints = [F.xxhash64("vec").alias("fp1"), F.xxhash64(F.lit(p.seed), "vec").alias("fp2")]
    rows = materialise(rows.select("*", good.alias("good"), F.size("vec").alias("dim"), *prints, F.monotonically_increasing_id().alias("row")), "vectors")
    # equal vectors are one class, named by its first row; only class rows carry the vector on
    names = ["label", "dim", "fp1", "fp2"]
    classes = rows.where("good").groupBy(*names).agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.min("row").alias("cid"))
    classes = materialise(classes, "classes")
    vectors = materialise(rows.select("row", "vec").join(classes.select("label", "dim", "cid", "rep", "mult"), F.col("row") == F.col("cid")).drop("row"), "class-vectors")
    kind = dict(classes.dtypes)["label"]
    key = _KEY[:4]
    slots = vectors.select("label", "dim", "cid", "vec").mapInArrow(lean(_slots(p)), f"label {kind}, dim int, block int, cell long, home boolean, cid long, coords binary")
    slots = materialise(slots, "slots")
    many = slots.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("askers")).where("homes > 0 and askers > 1")
    many = many.select(*key[:3], rehash("cell").alias("cell"), F.ceil(F.col("homes") / p.chunk).alias("hs"), F.ceil(F.col("askers") / p.chunk).alias("gs"))
    many = small_enough(materialise(many, "cells"))
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("hs")).otherwise(F.col("gs")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("home"), F.col("gs")).otherwise(F.col("hs")) - 1))
    dealt = slots.join(many, key).withColumn("own", own).withColumn("other", other)
    hi, gi = (F.when(F.col("home") == at_home, F.col("own")).otherwise(F.col("other")) for at_home in (True, False))
    dealt = dealt.select(*key, "home", "cid", "coords", hi.alias("hi"), gi.alias("gi"))
    marked = dealt.groupBy(*_KEY).applyInArrow(_mark(p), f"label {kind}, dim int, block int, cell long, hi long, gi long, home boolean, cid long")
    marked = materialise(marked, "marked")
    squares = marked.join(vectors.select("cid", "rep", "mult", "vec"), "cid")
    found = squares.groupBy(*_KEY).applyInArrow(_square(p), "cid long, rep long, links long, low long")
    found = materialise(found, "links")
    label = connected_components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    n = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of = classes.join(n, "cid", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    of = materialise(of.select(*names, (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "components")
    sweep(df.sparkSession, since, rows, of)
    bad = rows.where("not good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = rows.where("good").select("id", *names).join(of, names).select("id", "links", "component").union(bad)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
