"""Spelling variants by symmetric deletion.

Every word emits itself and its distinct single deletions. Two words that differ by one inserted, deleted or replaced code point share exactly one
of these keys, so an equi-join of the keys finds each such pair once, and an edit distance of exactly one keeps it. A word's form is the
most frequent of its near words, if that is frequent enough; roots follow the forms to the last by joins that double their reach.

Counting, keys and joins are built-in functions. Words longer than LONG, whose deletions would take the square of their length, emit digests
of the same keys, computed from prefix sums; their pairs are checked on the words all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, SEEN, TIMES, DAMAGED = 7, 2, 10, 31
#: Words up to this length have their keys written out.
LONG = 64
#: Deletions of long words that one batch holds.
KEYS = 1 << 20
_MULS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def ascii_lower(text: Column) -> Column:
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """id (as text) and run of every maximal run of letters of at least ``shortest``, with A-Z in lower case. A null text has none; a null id is the empty text."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{shortest},}}+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    return rows.select("id", ascii_lower(F.col("run")).alias("run"))


def damaged(id_: Column, run: Column, every: int = DAMAGED) -> Column:
    """The run, without one letter where ``every`` divides the crc32 of ``<id>:<run>``."""
    h = F.crc32(F.concat(id_, F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, shortest: int = SHORTEST, seen: int = SEEN) -> DataFrame:
    """word, n of a column ``word``: those of at least ``shortest`` code points and ``seen`` occurrences. Tasks count before rows are dealt."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seen)


def keys(word: Column) -> Column:
    """The word and its distinct single deletions."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def _powers(n: int, mul: int) -> np.ndarray:
    out = np.full(max(n, 1), mul, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def key_digests(word: str) -> np.ndarray:
    """(k, 2) digests of 128 bits of the word and its distinct single deletions, in time linear in the word: a key's digest is the sum of its
    letters' values by powers of an odd number, so what stands behind a deleted letter is divided by it once."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.concatenate(([True], points[1:] != points[:-1]))  # deletions within a run of one letter are the same
    out = []
    for mul in _MULS:
        terms = C.mix(points * np.uint64(mul) + np.uint64(mul >> 7)) * _powers(len(points), mul)
        upto = np.cumsum(terms, dtype=np.uint64)
        behind = (upto[-1] - upto) * np.uint64(pow(mul, -1, 1 << 64))
        sums = np.concatenate((upto[-1:], (upto - terms + behind)[first]))
        lengths = np.full(len(sums), len(points) - 1, np.uint64)
        lengths[0] += np.uint64(1)
        out.append(C.mix(sums + C.mix(lengths)))
    return np.stack(out, axis=1).view(np.int64)


def _long_keys(words: DataFrame) -> DataFrame:
    """k1, k2, id of the words' keys; a task holds one word's keys at a time, or those of many short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ws in C.rows_of(batches, "id", "word"):
            held, size = [], 0
            for id_, w in zip(ids, ws, strict=True):
                k = key_digests(w)
                held.append((np.full(len(k), id_, np.int64), k))
                size += len(k)
                if size >= KEYS:
                    yield _key_batch(held)
                    held, size = [], 0
            if held:
                yield _key_batch(held)

    return words.mapInArrow(run, "k1 long, k2 long, id long")


def _key_batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    k = np.concatenate([x for _, x in held])
    return C.batch(k1=pa.array(k[:, 0]), k2=pa.array(k[:, 1]), id=pa.array(np.concatenate([i for i, _ in held])))


def apart_by_one(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point is all that differs; linear, where a table of distances would not be."""
    x, y = (np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4") for w in sorted((a, b), key=len))
    if len(y) - len(x) > 1 or a == b:
        return False
    differ = np.flatnonzero(x != y[: len(x)])
    at = int(differ[0]) if len(differ) else len(x)
    return bool((x[at + (len(x) == len(y)) :] == y[at + 1 :]).all())


def _checked(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, near = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("word", "near"))
            yield b.filter(pa.array(list(map(apart_by_one, a, near)), pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


def near_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """word, n, near, near_n of every ordered pair of near words of a saved table of word and n, each once.

    Words that share a deletion number at most 89 letters for each of its places, whatever the corpus, so no key is hot.
    """
    length = F.length("word")
    k = words.where(length <= long).select(F.explode(keys(F.col("word"))).alias("key"), "word", "n")
    a, b = k, k.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    short = a.join(b.hint("merge"), "key").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).drop("key")
    if not words.where(length > long).limit(1).count():
        return short
    # a pair with a word beyond the limit; its other word may have just that length
    rest = C.saved(words.where(length >= long).withColumn("id", F.monotonically_increasing_id()))
    d = C.saved(_long_keys(rest.select("id", "word")))
    pairs = d.join(d.withColumnRenamed("id", "other"), ["k1", "k2"]).where("id <> other").select("id", "other").distinct()
    pairs = pairs.join(rest, "id").join(rest.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")), "other")
    both = F.greatest(F.length("word"), F.length("near")) > long
    return short.unionByName(_checked(pairs.where(both).select("word", "n", "near", "near_n")))


def forms(words: DataFrame, times: int = TIMES, long: int = LONG) -> DataFrame:
    """word, n, n_near, form, form_n of each row of a saved table of word and n; a form is at least ``times`` as frequent as its word."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best")
    found = near_pairs(words, long).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(found.hint("merge"), "word", "left")
    good = F.coalesce(-F.col("best.m") >= times * F.col("n"), F.lit(False))
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of a saved table of word and form (each word once, no cycles): forms followed to the last. Every round doubles the reach.

    Links grow with the corpus, and a few MB of files are many times that as a hash table in the driver, so they are never broadcast.
    """
    now = C.saved(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge")
        step = C.saved(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, times: int = TIMES, long: int = LONG) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of a table of distinct words and n. Ties of the largest n fall to the smallest word in code-point order; an empty table gives no rows."""
    rows = C.saved(forms(C.saved(words), times, long))
    ends = roots(rows.where("form is not null")).hint("merge")
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(C.documents(spark, sf_dir))
    return variants(counted(r.select(damaged(F.col("id"), F.col("run")).alias("word"))))
