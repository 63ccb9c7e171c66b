"""Language ID of code-switched text by a linear-chain conditional random field.

Words (runs of ASCII letters and non-ASCII bytes, lower-cased) of a line form a
chain; long lines start a new chain every CHAIN words, so that chains can be
run side by side. A word's features are its prefixes and suffixes of 1 to 4
bytes, its byte trigrams and the word itself (the learned lexicon), hashed into
one table of weights per language. Transitions are learned with them.
Forward-backward gives each word's posterior, by which the words are labelled;
a document's score for a language is the mean of its words' posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import chunks, lean, utf8

CHAIN = 128
BITS = 18
#: Documents, and bytes of them, that are fitted on: a bounded sample by language and hash of the id.
SAMPLE, SAMPLE_BYTES = 3000, 48 << 20
EPOCHS, RATE, SEED = 3, 0.3, 20240229
_AFFIX = 8  # feature columns: 4 prefixes, 4 suffixes; then the word
_LETTER = re.compile(r"[^\W\d_]")


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0 to U+00DE, lower-cased in place of their UTF-8 bytes."""
    out = ts.LOWERED[data]
    if len(out) > 1:
        second = np.zeros(len(out), bool)
        second[1:] = data[:-1] == 0xC3
        second &= (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        out[second] += 0x20
    return out


@dataclass
class Chains:
    """Words of some rows with their features, and the chains they form."""

    row: np.ndarray  # of each word
    dense: np.ndarray  # words x (_AFFIX + 1) table slots; slot 0 is none
    tri: np.ndarray  # table slots of all trigrams
    tri_word: np.ndarray  # their words
    start: np.ndarray  # first word of each chain
    size: np.ndarray
    begin: np.ndarray | None = None  # byte bounds of each word
    end: np.ndarray | None = None


def chains(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Chains:
    data = folded(data)
    w = ts.words(data, offsets, ts.LETTERS, ts.SAME)
    n = len(w.hashes)
    size = w.end - w.begin
    shift = np.uint64(64 - bits)
    dense = np.zeros((n, _AFFIX + 1), np.int64)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint64)
    slot = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15) >> shift) | np.uint64(1)).astype(np.int64)
    pre, suf = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(1, 5):
        long = size >= k
        pre = pre * np.uint64(257) + padded[w.begin + k - 1] + np.uint64(1)
        suf = suf * np.uint64(257) + padded[w.end - np.minimum(k, size)] + np.uint64(1)
        dense[:, k - 1] = np.where(long, slot(pre * np.uint64(31) + np.uint64(k)), 0)
        dense[:, 3 + k] = np.where(long, slot(suf * np.uint64(37) + np.uint64(1000 + k)), 0)
    dense[:, _AFFIX] = ((w.hashes >> shift) | np.uint64(1)).astype(np.int64)
    many = np.maximum(size - 2, 0)
    tri_word = np.repeat(np.arange(n), many)
    at = np.repeat(w.begin - (np.cumsum(many) - many), many) + np.arange(len(tri_word))
    tri = slot((padded[at] << np.uint64(16)) + (padded[at + 1] << np.uint64(8)) + padded[at + 2] + np.uint64(1 << 40))
    row = w.row
    line = np.searchsorted(np.flatnonzero(data == 10), w.begin)
    new = np.ones(n, bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    start = np.flatnonzero(rank % CHAIN == 0)
    return Chains(row, dense, tri, tri_word, start, np.diff(np.append(start, n)), w.begin, w.end)


def emissions(c: Chains, weight: np.ndarray) -> np.ndarray:
    """Log potentials (words x languages)."""
    out = weight[c.dense].sum(axis=1)
    if len(c.tri):
        first = np.flatnonzero(np.concatenate([[True], c.tri_word[1:] != c.tri_word[:-1]]))
        out[c.tri_word[first]] += np.add.reduceat(weight[c.tri], first, axis=0)
    return out


def forward_backward(u: np.ndarray, c: Chains, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each word (words x languages) and, if asked, the expected transition counts. Chains run side by side, scaled at each step."""
    langs = u.shape[1]
    e = np.exp(np.maximum(u - u.max(axis=1, keepdims=True), -60)) if len(u) else u
    t = np.exp(trans)
    order = np.argsort(-c.size, kind="stable")
    start, size = c.start[order], c.size[order]
    steps = int(size[0]) if len(size) else 0
    alive = [int((size > s).sum()) for s in range(steps)]
    alpha = np.empty_like(e)
    for s in range(steps):
        at = start[: alive[s]] + s
        a = e[at] if s == 0 else (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    post = alpha.copy()
    expected = np.zeros((langs, langs))
    beta = np.ones((len(size), langs))
    for s in range(steps - 2, -1, -1):
        n = alive[s + 1]
        at = start[:n] + s
        b = beta[:n] * e[at + 1]
        if pairs:
            joint = alpha[at][:, :, None] * t[None] * b[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = b @ t.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:n] = b
        p = alpha[at] * b
        post[at] = p / p.sum(axis=1, keepdims=True)
    return post, expected


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray
    trans: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED, bits: int = BITS) -> Model:
        """Conditional likelihood by AdaGrad over mini-batches of documents and of lines spliced from two of them.

        A document's words have its language; a spliced line's have those of
        its parts, from which the transitions learn where languages switch.
        """
        names = sorted(set(langs))
        y = np.array([names.index(x) for x in langs], np.int64)
        k = len(names)
        weight, trans = np.zeros((1 << bits, k), np.float32), np.zeros((k, k))
        gw, gt = np.full((1 << bits, k), 1e-4, np.float32), np.full((k, k), 1e-4)
        rng = np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs if k > 1 else 0):
            for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
                mixed, where, second = spliced([texts[i] for i in part], y[part], rng)
                data, offsets = utf8(pa.array([*(texts[i] for i in part), *mixed], pa.string()))
                c = chains(data, offsets, bits)
                if not len(c.row):
                    continue
                truth = np.concatenate([y[part], second[:, 0]])[c.row]
                place = c.begin - offsets[c.row]
                for j, (a, b) in enumerate(where, len(part)):
                    truth[(c.row == j) & (place >= a) & (place < b)] = second[j - len(part), 1]
                post, expected = forward_backward(emissions(c, weight), c, trans, True)
                delta = (-post / len(c.row)).astype(np.float32)
                delta[np.arange(len(truth)), truth] += np.float32(1 / len(c.row))
                grad = np.zeros_like(weight)
                for j in range(c.dense.shape[1]):
                    np.add.at(grad, c.dense[:, j], delta)
                if len(c.tri):
                    np.add.at(grad, c.tri, delta[c.tri_word])
                grad[0] = 0
                gw += grad * grad
                weight += rate * grad / np.sqrt(gw)
                on = np.ones(len(truth), bool)
                on[c.start] = False  # words that follow another in their chain
                on = np.flatnonzero(on)
                seen = np.bincount(truth[on - 1] * k + truth[on], minlength=k * k).reshape(k, k)
                step = (seen - expected) / max(1, len(c.row))
                gt += step * step
                trans += rate * step / np.sqrt(gt)
        return cls(names, weight, trans)

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Chains, np.ndarray]:
        """The words of all rows and their posteriors (words x languages)."""
        c = chains(data, offsets, int(np.log2(len(self.weight))))
        if not len(c.row):
            return c, np.zeros((0, len(self.langs)))
        return c, forward_backward(emissions(c, self.weight), c, self.trans)[0]


def spliced(texts: list[str], y: np.ndarray, rng: np.random.Generator) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """Lines of a few words of one text with some of another language's in between or after; the byte bounds of those, and both languages."""
    out, where, langs = [], [], []
    for i in range(0, len(texts) - 1, 2):
        a, b = texts[i].split(), texts[i + 1].split()
        if y[i] == y[i + 1] or len(a) < 8 or len(b) < 8:
            continue
        p, q = int(rng.integers(len(a) - 7)), int(rng.integers(len(b) - 7))
        head, more = int(rng.integers(2, 8)), int(rng.integers(2, 8))
        left, inner = " ".join(a[p : p + head]) + " ", " ".join(b[q : q + more]) + " "
        out.append(left + inner + " ".join(a[p + head : p + 7 + int(rng.integers(0, 5))]))
        begin = len(left.encode())
        where.append((begin, begin + len(inner.encode())))
        langs.append((y[i], y[i + 1]))
    return out, where, np.array(langs, np.int64).reshape(-1, 2)


def means(c: Chains, post: np.ndarray, rows: int) -> np.ndarray:
    """Mean posterior by language of each row (rows x languages); rows without words are zero."""
    out = np.zeros((rows, post.shape[1]))
    for j in range(out.shape[1]):
        out[:, j] = np.bincount(c.row, weights=post[:, j], minlength=rows)
    return out / np.maximum(np.bincount(c.row, minlength=rows), 1)[:, None]


_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_SHARES = 16


def _smallest(rows: DataFrame, id_col: str, sample: int) -> list:
    """(id, lang, size) of ``sample`` rows: those of the smallest hashes of the id, by turns from every language."""
    spark = rows.sparkSession
    h = F.xxhash64(F.col(id_col).cast("string"))
    ranked = rows.select(F.col(id_col).alias("id"), "lang", F.octet_length("text").alias("size"), h.alias("h"))
    order = ["h", "id", "size"]
    # first within _SHARES runs of tasks, so that a frequent language's last task reads at most _SHARES * sample rows, however many tasks there are
    ranked = ranked.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(_SHARES)))
    for groups in (["lang", "share"], ["lang"]):
        ranked = ranked.withColumn("turn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("turn") <= sample)
    before = spark.conf.get(_GROUP_LIMIT)
    spark.conf.set(_GROUP_LIMIT, str(max(sample, int(before))))  # each task then passes on its first ``sample`` rows of a language only
    try:
        return ranked.orderBy("turn", *order, "lang").limit(sample).collect()
    finally:
        spark.conf.set(_GROUP_LIMIT, before)


def _within(rows: list, limit: int) -> tuple[list, list]:
    """Ids of the sampled rows that fit in ``limit`` bytes, and ids of those of which only the first part does.

    Every language has an equal share of the bytes; what it leaves goes to the
    rows that didn't fit, in their order. A language whose rows are all longer
    than its share gives the first part of one.
    """
    langs = dict.fromkeys(r["lang"] for r in rows)
    share = limit // max(1, len(langs))
    left, taken, later = dict.fromkeys(langs, share), [], []
    for r in rows:
        if r["size"] <= left[r["lang"]]:
            left[r["lang"]] -= r["size"]
            taken.append(r)
        else:
            later.append(r)
    missing, cut = set(langs) - {r["lang"] for r in taken}, []
    for r in later:
        if r["lang"] in missing:
            missing.remove(r["lang"])
            left[r["lang"]] = 0
            cut.append(r["id"])
    rest = sum(left.values())
    for r in later:
        if r["size"] <= rest and r["id"] not in cut:
            rest -= r["size"]
            taken.append(r)
    return [r["id"] for r in taken], cut


def train(docs: DataFrame, condition=None, id_col: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Fit on ``sample`` documents, by turns from every language, with a text and a language that meet the condition: those of the smallest hashes of the id.

    They are read whole as far as SAMPLE_BYTES allow. Returns None if there are none.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col(id_col).isNotNull())
    if condition is not None:
        rows = rows.where(condition)
    chosen = _smallest(rows, id_col, sample)
    ids, cut = _within(chosen, SAMPLE_BYTES)
    if not chosen:
        return None
    part = SAMPLE_BYTES // len({r["lang"] for r in chosen}) // 4  # characters, of at most four bytes
    text = F.when(F.col(id_col).isin(cut), F.substring("text", 1, part)).otherwise(F.col("text")) if cut else F.col("text")
    got = rows.where(F.col(id_col).isin([*ids, *cut])).select(id_col, "lang", text.alias("text")).orderBy(id_col, "lang", "text").limit(sample).collect()
    return Model.fit([r["text"] for r in got], [r["lang"] for r in got])


_SHARE = pa.struct([("lang", pa.string()), ("share", pa.float64())])
_WORD = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("posterior", pa.float64())])


def _labelled(c: Chains, post: np.ndarray, langs: list[str], data: np.ndarray, offsets: np.ndarray, ok: np.ndarray) -> pa.Array:
    """The word labels of each row; none for rows that aren't ``ok``."""
    mine = ok[c.row]
    row, best = c.row[mine], post[mine].argmax(axis=1)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    begin, end = (chars[x[mine]] - chars[offsets[:-1]][row] for x in (c.begin, c.end))
    top = post[mine][np.arange(len(best)), best].astype(np.float64)
    words = pa.StructArray.from_arrays([pa.array(begin), pa.array(end), pa.array(langs, pa.string()).take(pa.array(best)), pa.array(np.minimum(top, 1.0))], fields=list(_WORD))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ok)))]), pa.int32()), words)


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with words, shares, lang_pred and score (mean posterior, 0 to 1) for every row.

    words: array of struct(begin, end, lang, posterior), each word's bounds in
    characters from 0 and its likeliest language. shares: array of
    struct(lang, share), the mean posterior of every language that isn't 0, in
    the languages' order. Null texts and texts without
    a letter get no words, ``und`` and 0, as does every row without a model.
    Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, text = shared.value, batch.column("text")
            data, offsets = utf8(text)
            for lo, hi in chunks(offsets):
                piece, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ascii_ = (piece >= 0x41) & (piece <= 0x7A) & ((piece <= 0x5A) | (piece >= 0x61))
                letters = np.diff(np.concatenate([[0], np.cumsum(ascii_)])[offs]) > 0
                for i in np.flatnonzero(~letters & (np.diff(offs) > 0)):
                    letters[i] = bool(_LETTER.search(text[lo + i].as_py()))
                if m is None:
                    p, words = np.zeros((hi - lo, 1)), pa.array([[]] * (hi - lo), pa.list_(_WORD))
                    shares = pa.array([[]] * (hi - lo), pa.list_(_SHARE))
                else:
                    c, post = m.label(piece, offs)
                    p = means(c, post, hi - lo)
                best = p.argmax(axis=1)
                top = p[np.arange(len(p)), best]
                ok = letters & (top > 0)
                if m is not None:
                    words = _labelled(c, post, m.langs, piece, offs, ok)
                    some, which = np.nonzero((p > 0) & ok[:, None])
                    each = pa.StructArray.from_arrays([pa.array(m.langs, pa.string()).take(pa.array(which)), pa.array(p[some, which].astype(np.float64))], fields=list(_SHARE))
                    shares = pa.ListArray.from_arrays(pa.array(np.searchsorted(some, np.arange(hi - lo + 1)), pa.int32()), each)
                lang = [m.langs[b] if good else "und" for b, good in zip(best.tolist(), ok.tolist(), strict=True)]
                score = np.where(ok, np.minimum(top, 1.0), 0.0)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), words, shares, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "words", "shares", "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    words = "words array<struct<begin:long,end:long,lang:string,posterior:double>>, shares array<struct<lang:string,share:double>>"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), f"{schema}, {words}, lang_pred string, score double")
