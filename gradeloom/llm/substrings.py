"""Removal of repeated passages by difference-cover anchors.

A window is ``span`` consecutive words of a document. A word goes if a window that covers it also
starts, word for word, in a document with a smaller id.

D is a difference cover modulo v: each residue is a difference of two of its members. So for any two
positions some shift below v brings both onto cover positions, and two equal windows share an anchor (the
span - v + 1 words at a cover position) at the same place. Only anchors are hashed and shuffled, len(D)
in v positions. Anchors that occur in several documents mark where windows can match; just those windows are hashed in
full (128 bits) and matched. Groups of equal anchors or windows are reduced to their least and greatest document before anything is joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPAN = 50
#: Perfect difference sets of lines in projective planes (fixed values): modulus to members.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover(span: int) -> tuple[int, np.ndarray]:
    """The largest modulus with an anchor of at least a third of the span; (1, [0]) for short spans."""
    fit = [v for v in COVERS if 3 * (span - v + 1) >= span and span > v]
    return (max(fit), np.array(COVERS[max(fit)])) if fit else (1, np.array([0]))


def anchors(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a document's word hashes."""
    v, d = cover(span)
    got = C.window_hashes(h, span - v + 1)
    at = np.flatnonzero(np.isin(np.arange(len(got)) % v, d))
    return at, got[at]


def _window_pair(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    return C.window_hashes(h, span), C.window_hashes(C.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), span, 0xD1342543DE82EF95)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


#: Rows that a task holds to combine them; at most about 30 MB with what sorting takes.
CHUNK = 250_000


def _ends() -> list:
    return [F.min("_k").alias("a"), F.max("_k").alias("b"), F.max("p").alias("c"), F.max("_th").alias("d"), F.max("sure").alias("s")]


def several_docs(k: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows by group and then document: those whose group has several documents, and those that speak for their group (its
    first and last row, or all of them if the group has one document)."""
    begin = np.concatenate(([True], group[1:] != group[:-1]))
    end = np.concatenate((begin[1:], [True]))
    at = np.cumsum(begin) - 1
    several = (k[begin] != k[end])[at]
    return several, ~several | begin | end


def later_docs(k: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows by group and then document: those of a later document than the group's first, and those of the first."""
    begin = np.concatenate(([True], group[1:] != group[:-1]))
    first = k == k[begin][np.cumsum(begin) - 1]
    return ~first, first


class _Held:
    """Rows of a task, combined before they are shuffled. What the task's own rows decide is sent as sure, under a random hash; just the rows that
    speak for their group go by its hash. So a hash that a third of all documents have sends a few rows from each chunk."""

    def __init__(self, hashes: int):
        self.n, self.rows, self.hashes = 0, [], hashes

    def add(self, k: int, th: int, at: np.ndarray, *hs: np.ndarray) -> bool:
        self.rows.append((np.full(len(at), k, np.int64), np.full(len(at), th, np.int64), at.astype(np.int32), *hs))
        self.n += len(at)
        return self.n >= CHUNK

    def told(self, rule) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        k, th, p, *hs = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.n, self.rows = 0, []
        order = np.lexsort((k, hs[0]))  # further hashes only tell apart the groups
        sure, speaks = rule(k[order], (hs[0] if len(hs) == 1 else hs[0] ^ C.mix(hs[1]))[order])
        for rows, known in ((np.sort(order[sure]), True), (np.sort(order[speaks]), False)):  # by document again, which compresses better
            for a in range(0, len(rows), 50_000):
                i = rows[a : a + 50_000]
                spread = C.mix(k[i].view(np.uint64) ^ C.mix(p[i].astype(np.uint64) + np.uint64(0x5EED)))
                keys = {name: _signed(C.mix(spread + np.uint64(j)) if known else h[i]) for j, (name, h) in enumerate(zip("xy", hs, strict=False))}
                yield C.batch(**keys, _k=pa.array(k[i]), _th=pa.array(th[i]), p=pa.array(p[i]), sure=pa.array(np.full(len(i), known)))


def removals(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_k, _th and the removed word ranges (bytes of u4 begin, end pairs) of the rows that lose words."""
    v, _ = cover(span)
    C.text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("_k"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("t")).where("_k is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(1)
        for keys, ths, texts in C.rows_of(batches, "_k", "_th", "t"):
            for k, th, t in zip(keys, ths, texts, strict=True):
                at, h = anchors(C.word_hashes(C.words(t)), span) if t else ((), ())
                if len(at) and held.add(k, th, at, h):
                    yield from held.told(several_docs)
        yield from held.told(several_docs)

    # Both sides of the join read one exchange by hash: the aggregate names all columns, so that none is pruned on its side alone.
    found = base.mapInArrow(find, "x long, _k long, _th long, p int, sure boolean").repartition("x")
    several = found.groupBy("x").agg(*_ends()).where("(a < b or s) and c >= 0 and d is not null").select("x", "c")
    marks = found.join(several, "x").where("sure or c >= 0").groupBy("_k", "_th").agg(F.sort_array(F.collect_set("p")).alias("ps"))  # a document's own anchors alone
    marks = C.saved(marks)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(2)
        for keys, ths, texts, marked in C.rows_of(batches, "_k", "_th", "t", "ps"):
            for k, th, t, ps in zip(keys, ths, texts, marked, strict=True):
                x, y = _window_pair(C.word_hashes(C.words(t)), span)
                edge = np.zeros(len(x) + v + 1, np.int64)  # an anchor lies in the windows that start up to v - 1 before it
                p = np.array(ps)
                np.add.at(edge, np.maximum(0, p - v + 1), 1)
                np.add.at(edge, np.minimum(p + 1, len(x) + v), -1)
                at = np.flatnonzero(np.cumsum(edge)[: len(x)] > 0)
                if len(at) and held.add(k, th, at, x[at], y[at]):
                    yield from held.told(later_docs)
        yield from held.told(later_docs)

    wins = base.join(C.small(marks), ["_k", "_th"]).mapInArrow(windows, "x long, y long, _k long, _th long, p int, sure boolean").repartition("x", "y")
    first = wins.groupBy("x", "y").agg(*_ends()).where("(a < b or s) and c >= 0 and d is not null").select("x", "y", "a")
    lost = wins.join(first, ["x", "y"]).where("_k > a or sure").groupBy("_k", "_th").agg(F.collect_list("p").alias("ps"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ths, starts in C.rows_of(batches, "_k", "_th", "ps"):
            out = []
            for ps in starts:
                p = np.unique(np.array(ps, np.int64))
                cut = np.flatnonzero(np.diff(p) > span)
                out.append(np.stack((p[np.concatenate(([0], cut + 1))], p[np.concatenate((cut, [len(p) - 1]))] + span), 1).astype("<u4").tobytes())
            yield C.batch(_k=pa.array(keys, pa.int64()), _th=pa.array(ths, pa.int64()), __gl_cut=pa.array(out, pa.binary()))

    return C.saved(lost.mapInArrow(ranges, "_k long, _th long, __gl_cut binary"))


def _kept(text: str | None, cut: bytes | None) -> tuple[list[bytes], int]:
    ws = C.words(text)
    if not cut:
        return ws, 0
    out, at = [], 0
    for a, b in np.frombuffer(cut, "<u4").reshape(-1, 2).tolist():
        out += ws[at:a]
        at = b
    out += ws[at:]
    return out, len(ws) - len(out)


def _with_cuts(docs: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    cuts = C.small(removals(docs, span, id_col, text_col).withColumnsRenamed({"_k": "__gl_ck", "_th": "__gl_ct"}))
    return docs.withColumn("__gl_th", F.xxhash64(F.col(text_col))).join(cuts, (F.col(id_col).cast("long") == F.col("__gl_ck")) & (F.col("__gl_th") == F.col("__gl_ct")), "left").drop("__gl_ck", "__gl_ct", "__gl_th")


def dedup_digest(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; see :func:`dedup` for what is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, cuts in C.rows_of(batches, "_k", "t", "__gl_cut"):
            got = [_kept(t, c) for t, c in zip(texts, cuts, strict=True)]
            yield C.batch(doc_id=pa.array(keys, pa.int64()), n_words=pa.array([len(w) + n for w, n in got], pa.int64()), n_removed=pa.array([n for _, n in got], pa.int64()), kept_sha256=[hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in got])

    cols = _with_cuts(docs.select(F.col(id_col).cast("long").alias("_k"), F.col(text_col).alias("t")), span, "_k", "t")
    return cols.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text; all columns stay.

    A row that loses nothing keeps its text as it is; else the kept words are joined by one space. Rows whose words all go
    are dropped. Windows are judged on the input. A null text or id is left alone (a null id is no smaller than any);
    rows that share an id never count as repeats of each other; texts shorter than the span have no window; an empty table stays empty.
    """
    names = docs.columns
    cols = _with_cuts(docs, span, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts, cuts = b.column(at).to_pylist(), b.column(b.schema.get_field_index("__gl_cut")).to_pylist()
            new = [t if c is None else b" ".join(_kept(t, c)[0]).decode("utf-8", "surrogatepass") for t, c in zip(texts, cuts, strict=True)]
            keep = pa.array([c is None or bool(t) for t, c in zip(new, cuts, strict=True)], pa.bool_())
            out = [pa.array(new, pa.string()) if n == text_col else b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(out, names).filter(keep)

    return cols.mapInArrow(run, docs.schema)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(C.documents(spark, sf_dir))
