"""Log-bilinear language model scores.

The outcomes that the model predicts are words: the most frequent ones, WORDS_ROOT times the cube root of the training tokens, LEAST_WORDS at least; the end
of a text; and for all rarer words buckets by their first two bytes. Outcomes fall into classes of equal width, by rank. From the two outcomes before
comes a predicted vector (their vectors, each through a matrix of its place, added up); its product with a class's vector, plus a bias, is the class's score,
and its product with an outcome's vector, plus a bias, the outcome's score within its class. Both levels are trained in numpy by noise-contrastive
estimation, on every place of every training text. Rows of a step are sorted by outcome, so that those of a class share its noise.
Shards of the places are trained on in tasks whose models are averaged round by round. Scores are normalised
exactly, by batched matrix products: over the classes, and over the outcomes of the token's class.

Inside a bucket a known word has the share (c - d) / total, with d the absolute discount n1 / (n1 + 2 n2); what is taken off, d * words / total, is
the bucket's share of the one unknown word. Known words, end and unknown word so add up to one, as in the base score.

Word counts are a table, never collected: the HEAD most frequent words are broadcast as a dictionary; the others are joined by hash. What the driver
holds grows with the cube root of the tokens: words and vectors.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST_WORDS, WORDS_ROOT = 16_384, 32
#: Passes over all places where one task trains, and where models are averaged.
EPOCHS, SHARED_EPOCHS = 2, 1
#: Places that a task trains on at least, in corpora of over four times as many a number that grows with the cube root of the tokens, as the models do; and rounds of an
#: epoch after which the tasks' models are averaged. Fewer places than two tasks' have one task, and no averaging.
SHARD, ROUNDS = 4_000_000, 4
#: Outcomes of a stored run of places: at least (but for a task's last), and at most.
RUN, LONGEST_RUN = 1 << 14, 1 << 15
#: Numbers of a slice of the parameters, as tasks pass it on.
SLICE = 1 << 16
HEAD = 250_000
#: Rows of a step where one task trains, and where models are averaged; noise of a step, and of each of its classes.
DIMENSIONS, ROWS, SHARED_ROWS, CLASS_NOISE, NOISE = 24, 4096, 8192, 64, 32
END = 0
#: Text that is split into words at a time, but for longer texts.
PIECE_BYTES = 4 << 20
_LN10 = float(np.log(10))


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[tuple[list, pa.Array, np.ndarray]]:
    """Columns k and t in pieces of about ``limit`` bytes of text: the ids, all words, A-Z in lower case, and the number of words of each text (null: none).

    Arrow's white space is 0x20 and 0x09-0x0D, and its ASCII functions leave all other bytes as they are.
    """
    for b in batches:
        keys, texts = (b.column(b.schema.get_field_index(c)) for c in ("k", "t"))
        turn = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // limit
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
        for a, e in zip(edges, edges[1:], strict=False):
            if a == e:
                continue
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(a, e - a), "")))
            flat, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
            some = pc.not_equal(pc.binary_length(flat), 0)  # white space at the edges of a text leaves empty words
            upto = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
            yield keys.slice(a, e - a).to_pylist(), flat.filter(some).cast(pa.binary()), np.diff(upto[ends - ends[0]])
    b = keys = texts = split = flat = some = None
    C.release()


def _firsts_of(words: pa.Array) -> np.ndarray:
    """A number for the first two bytes of each word."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    one, two = raw.take(at[:-1]).astype(np.int64), raw.take(at[:-1] + 1, mode="clip")
    return np.where(np.diff(at) > 1, one << 8 | two, one + (1 << 16))


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text (null: no text) is 0 modulo 10."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Outcomes:
    """Outcome 0 is the end; 1 .. words the words by rank; from ``tail`` on, the buckets. Class i holds outcomes i * width .. (i + 1) * width - 1; those between the
    last word and the first bucket are nothing."""

    def __init__(self, words: int):
        self.words, self.width = words, max(8, math.isqrt(words) + 1)
        self.tail = -(-(words + 1) // self.width) * self.width
        self.buckets = 2 * self.width
        self.size = self.tail + self.buckets
        self.classes = self.size // self.width

    def bucket(self, word: bytes) -> int:
        return self.tail + zlib.crc32(word[:2]) % self.buckets

    def bucket_all(self, words: pa.Array) -> np.ndarray:
        """The buckets of words that are not empty."""
        if not len(words):
            return np.empty(0, np.int64)
        kinds, at = np.unique(_firsts_of(words), return_inverse=True)
        return np.array([self.bucket(bytes([k & 0xFF]) if k >> 16 else bytes(divmod(k, 256))) for k in kinds.tolist()], np.int64)[at]


def _order(at: np.ndarray) -> np.ndarray:
    """As argsort; numbers of 16 bits are sorted by their digits."""
    return np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")


def _firsts(at: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))


def _added(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, two columns at a time where their number is even."""
    if values.shape[1] % 2:
        return np.add.reduceat(values, first)
    return np.add.reduceat(values.view(np.complex64), first).view(np.float32)


def _sums(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, and for each the sum of its rows."""
    order = _order(at)
    at = at.take(order)
    first = _firsts(at)
    return at[first], _added(values.take(order, axis=0), first)


def _sigmoid(x: np.ndarray, scale: np.float32) -> np.ndarray:
    """``scale`` times the sigmoid of minus ``x``, in the place of ``x``."""
    np.exp(x, out=x)
    x += 1
    return np.divide(scale, x, out=x)


class LogBilinear:
    """Parameters of the model, started from the shares of the outcomes (``counts``), and its normalised log probabilities."""

    def __init__(self, outcomes: Outcomes, counts: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 9):
        g, o = np.random.default_rng(seed), outcomes
        self.outcomes = o
        normal = lambda *shape: g.normal(0, 0.1, shape).astype(np.float32)
        self.read, self.say, self.say_class = normal(o.size, dimensions), np.zeros((o.size, dimensions), np.float32), np.zeros((o.classes, dimensions), np.float32)
        self.place = np.stack([np.eye(dimensions, dtype=np.float32)] * 2)
        q = counts.astype(np.float64) + 0.5
        q[o.words + 1 : o.tail] = 0
        self.share = q / q.sum()
        by_class = self.share.reshape(o.classes, o.width).sum(1)
        self.share_class = by_class
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(self.share / np.repeat(by_class, o.width)), -1e9).astype(np.float32)
        self.bias_class = np.log(by_class).astype(np.float32)

    NAMES = ("read", "say", "say_class", "place", "bias", "bias_class")

    def begin(self) -> None:
        """Before training: the sums of squares that Adagrad divides by, and the noise's log shares, which stay."""
        self.seen = {x: np.full_like(getattr(self, x), 1e-6) for x in self.NAMES}
        self.noise, self.noise_class = self.bias.copy(), self.bias_class.copy()

    def flat(self) -> np.ndarray:
        """All parameters and Adagrad's sums as one vector."""
        return np.concatenate([x.ravel() for n in self.NAMES for x in (getattr(self, n), self.seen[n])])

    def set_flat(self, v: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            for held in (vars(self), self.seen):
                held[n] = v[at : at + held[n].size].reshape(held[n].shape).copy()
                at += held[n].size

    def train(self, parts: Iterable[np.ndarray], step: int, steps: int, seed: int, rows: int = ROWS, rate: float = 0.1) -> None:
        """NCE on rows of (outcome, one before, two before), part by part; ``step`` of ``steps`` are done. Noise is drawn from the outcomes' own shares: classes once
        a step, and within each class that occurs in it. Steps are Adagrad's, seeded."""
        o, g, seen = self.outcomes, np.random.default_rng(seed), self.seen
        upto, upto_class = np.cumsum(self.share), np.cumsum(self.share_class)
        below = upto_class - self.share_class
        q, q_class = self.noise, self.noise_class
        dot = lambda x, y: np.einsum("ij,ij->i", x, y)
        size = self.read.shape[1]

        def wide(x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
            """With ``last`` as one more number of each vector, and zeros up to an even length, so that one product gives scores with their biases."""
            out = np.zeros((*x.shape[:-1], size + 2 - size % 2), np.float32)
            out[..., :size], out[..., size] = x, last
            return out

        for part in parts:
            part = part.take(g.permutation(len(part)), axis=0)
            for a in range(0, len(part), rows):
                own = part[a : a + rows]
                own = own.take(_order(own[:, 0]), axis=0)
                w = own[:, 0].copy()
                slow, step = np.float32(rate * max(0.02, 1 - step / steps)), step + 1
                n = np.float32(len(w))
                # each distinct word before is multiplied out once, and its gradient added up before it is
                h, before = 0, []
                for i in (0, 1):
                    c = own[:, 1 + i]
                    order = _order(c)
                    c = c.take(order)
                    first = _firsts(c)
                    kind = np.empty(len(c), np.int64)
                    kind[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(c)))
                    r = self.read.take(c[first], axis=0)
                    before.append((c[first], r, order, first))
                    h = h + (r @ self.place[i]).take(kind, axis=0)
                h1 = wide(h, 1)
                k = w // o.width
                first = _firsts(k)
                kinds, edges = k[first], [*first.tolist(), len(w)]
                nk = np.minimum(np.searchsorted(upto_class, g.random(CLASS_NOISE)), o.classes - 1)
                less = self.bias_class - q_class - np.float32(math.log(CLASS_NOISE))
                said, of = self.say_class.take(k, axis=0), wide(self.say_class[nk], less[nk])
                up_class = -_sigmoid(dot(h, said) + less[k], 1 / n)
                down = _sigmoid(h1 @ -of.T, 1 / n)
                dh = up_class[:, None] * said
                dh += down @ of[:, :size]
                pushed_class = np.empty((len(kinds), h1.shape[1]), np.float32)
                drawn_class = down.T @ h1
                # outcomes drawn by their shares within each class, for all its rows
                draw = below[kinds][:, None] + g.random((len(kinds), NOISE)) * self.share_class[kinds][:, None]
                nw = np.clip(np.searchsorted(upto, draw.ravel()).reshape(-1, NOISE), (kinds * o.width)[:, None], (kinds * o.width + o.width - 1)[:, None])
                less = self.bias - q - np.float32(math.log(NOISE))
                said, of = self.say.take(w, axis=0), wide(self.say.take(nw, axis=0), less.take(nw))
                up = -_sigmoid(dot(h, said) + less.take(w), 1 / n)
                dh += up[:, None] * said
                down, dn = np.empty((len(w), NOISE), np.float32), np.empty_like(dh)
                pushed, minus = np.empty_like(of), -of.transpose(0, 2, 1)
                spans = list(zip(edges, edges[1:], strict=False))
                for i, (b, e) in enumerate(spans):
                    np.matmul(h1[b:e], minus[i], out=down[b:e])
                _sigmoid(down, 1 / n)
                of = np.ascontiguousarray(of[:, :, :size])
                for i, (b, e) in enumerate(spans):
                    np.matmul(down[b:e], of[i], out=dn[b:e])
                    np.matmul(down[b:e].T, h1[b:e], out=pushed[i])
                    np.matmul(up_class[b:e], h1[b:e], out=pushed_class[i])
                dh += dn
                first = _firsts(w)
                changes = {}
                at, d = _sums(np.concatenate((kinds, nk)), np.concatenate((pushed_class, drawn_class)))
                changes["say_class"], changes["bias_class"] = (at, d[:, :size]), (at, d[:, size])
                at, d = _sums(np.concatenate((w[first], nw.ravel())), np.concatenate((_added(up[:, None] * h1, first), pushed.reshape(nw.size, -1))))
                changes["say"], changes["bias"] = (at, d[:, :size]), (at, d[:, size])
                added = [_added(dh.take(order, axis=0), first) for _, _, order, first in before]
                changes["read"] = _sums(np.concatenate([b[0] for b in before]), np.concatenate([d @ self.place[i].T for i, d in enumerate(added)]))
                changes["place"] = (np.arange(2), np.stack([b[1].T @ d for b, d in zip(before, added, strict=True)]))
                for x, (places, d) in changes.items():
                    held, squares = getattr(self, x), seen[x].take(places, axis=0)
                    squares += d * d
                    seen[x][places] = squares
                    now = held.take(places, axis=0)
                    now -= slow * d / np.sqrt(squares, out=squares)
                    held[places] = now

    def ready(self) -> "LogBilinear":
        """With the context vectors of each place multiplied out, and the biases as one more dimension."""
        o, one = self.outcomes, np.ones((self.outcomes.size, 1), np.float32)
        self.before = [np.hstack((self.read @ self.place[0], one)), np.hstack((self.read @ self.place[1], 0 * one))]
        self.to_class = np.hstack((self.say_class, self.bias_class[:, None])).T.copy()
        self.to_outcome = np.hstack((self.say, self.bias[:, None])).reshape(o.classes, o.width, -1).transpose(0, 2, 1).copy()
        # the greatest length of a class's vectors and the greatest bias bound its scores
        length = lambda x: np.sqrt((x * x).sum(-1)).max(-1)
        self.limit_class = float(length(self.say_class)), float(self.bias_class.max())
        self.limit = list(zip(length(self.say.reshape(o.classes, o.width, -1)).tolist(), self.bias.reshape(o.classes, o.width).max(1).tolist(), strict=True))
        return self

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.before[0][one] + self.before[1][two]

    def _shares(self, h: np.ndarray, i: int | None = None) -> np.ndarray:
        """The exponentials of the scores of the classes, or of the outcomes of class ``i``; the greatest score of a row is taken off where they might be too large."""
        weights, (length, bias) = (self.to_class, self.limit_class) if i is None else (self.to_outcome[i], self.limit[i])
        scores = h @ weights
        if math.sqrt(float(np.einsum("ij,ij->i", h, h).max(initial=0))) * length + bias > 80:
            scores -= scores.max(1)[:, None]
        return np.exp(scores, out=scores)

    def logs(self, one: np.ndarray, two: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """log P(outcome) after each pair of outcomes. Classes after a pair are scored once for all its tokens, outcomes of a class after a pair likewise."""
        o, out = self.outcomes, np.empty(len(outcome), np.float64)
        pair = one.astype(np.int64) * o.size + two
        order = np.argsort(pair)
        for own, first, times in _blocks(pair, order):
            h = self.predicted(one[own[first]], two[own[first]])
            out[own] = self._picked(self._shares(h), np.repeat(np.arange(len(first)), times), outcome[own] // o.width)
        k = outcome // o.width
        order = order[_order(k[order])]
        edges = np.searchsorted(k[order], np.arange(o.classes + 1)).tolist()
        for i in np.flatnonzero(np.diff(edges)).tolist():
            for own, first, times in _blocks(pair, order[edges[i] : edges[i + 1]]):
                h = self.predicted(one[own[first]], two[own[first]])
                out[own] += self._picked(self._shares(h, i), np.repeat(np.arange(len(first)), times), outcome[own] - i * o.width)
        return out

    def _picked(self, shares: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The logs of the rows' shares at some places."""
        return np.log(shares[row, at] / (shares @ np.ones(shares.shape[1], np.float32))[row] + 1e-37)

    def log_unknown(self, one: np.ndarray, two: np.ndarray, share: np.ndarray) -> np.ndarray:
        """log P(unknown word) after each pair of outcomes, ``share`` being each bucket's share of it."""
        o, out = self.outcomes, np.empty(len(one), np.float64)
        first = o.tail // o.width
        for a in range(0, len(one), 2048):
            part = self.predicted(one[a : a + 2048], two[a : a + 2048])
            of_class = self._shares(part)
            of_class = of_class[:, first:] / of_class.sum(1)[:, None]
            total = np.zeros(len(part))
            for i in range(first, o.classes):
                e = self._shares(part, i)
                total += of_class[:, i - first] * (e @ share[i * o.width - o.tail :][: o.width].astype(np.float32)) / e.sum(1)
            out[a : a + 2048] = np.log(np.maximum(total, 1e-300))
        return out


def _blocks(pair: np.ndarray, order: np.ndarray, rows: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in an order by pairs, in blocks of ``rows`` distinct pairs: the places, where in them each pair begins, and how often it occurs."""
    first = _firsts(pair[order])
    edges = np.append(first, len(order))
    for a in range(0, len(first), rows):
        own = edges[a : a + rows + 1]
        yield order[own[0] : own[-1]], own[:-1] - own[0], np.diff(own)


def _contexts(outcome: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes one and two before each token of some texts, whose first tokens follow ends."""
    one = np.concatenate(([END], outcome[:-1]))
    two = np.concatenate(([END, END], outcome[:-2])) if len(outcome) > 1 else np.array([END])
    one[starts] = END
    two[starts] = END
    after = starts + 1
    two[after[after < len(outcome)]] = END
    return one, two


def _counted(found: list[pa.RecordBatch]) -> pa.Table:
    """One row for each word of some counts."""
    return pa.Table.from_batches(found).group_by("w", use_threads=False).aggregate([("c", "sum"), ("o", "sum")]).select(["w", "c_sum", "o_sum"]).rename_columns(["w", "c", "o"])


def _with_ends(values: np.ndarray, lens: np.ndarray, end: int) -> np.ndarray:
    """The words' values with ``end`` behind those of each text."""
    out = np.full(len(values) + len(lens), end, values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(len(lens)), lens)] = values
    return out


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, epochs: int | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row (log10 probabilities of the whole text with its end).

    Rows learn and are held out by crc32 of the id as text. A null text is empty and has its end alone; a null id counts
    as an empty text id; rows that repeat count as rows. With nothing to learn from, all words are unknown and both scores
    say so. Words of equal counts at the edge of the model's own are all in or all out of it, with their bin of the histogram. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for keys, flat, lens in pieces(batches):
            coded = flat.dictionary_encode()
            at, n = coded.indices.to_numpy(), len(coded.dictionary)
            held = np.bincount(at[np.repeat(np.array([held_out(k) for k in keys], bool), lens)], minlength=n)
            found.append(C.batch(w=coded.dictionary, c=np.bincount(at, minlength=n) - held, o=held))
            rows += n
            if rows > 1_500_000:
                found = _counted(found).combine_chunks().to_batches()
                rows = sum(map(len, found))
                if rows > 750_000:
                    yield from found
                    found, rows = [], 0
        if found:
            yield from _counted(found).to_batches(max_chunksize=100_000)

    words = C.saved(base.mapInArrow(count, "w binary, c long, o long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("o").alias("o")))
    total = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()

    def learns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys,) in C.rows_of(batches, "k"):
            yield C.batch(n=[sum(not held_out(k) for k in keys)])

    ends = int(base.select("k").mapInArrow(learns, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    n_train, known = int(total["n"] or 0) + ends, int(total["v"]) + (ends > 0)
    discount = total["n1"] / (total["n1"] + 2 * total["n2"]) if total["n1"] and total["n2"] else 0.5
    most = max(least_words, int(WORDS_ROOT * n_train ** (1 / 3)))
    own = _head(words, most, F.col("c"))
    top = dict(sorted((_head(words, head, F.col("c") + F.col("o")) | own).items()))
    single = sorted(own, key=lambda w: (-own[w], w))
    place = {w: i + 1 for i, w in enumerate(single)}
    outcomes = Outcomes(len(single))
    numbers = spark.sparkContext.broadcast((place, outcomes))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, o = numbers.value
        sums, kinds = np.zeros(o.buckets, np.int64), np.zeros(o.buckets, np.int64)
        for ws, cs in C.rows_of(batches, "w", "c"):
            for w, c in zip(ws, cs, strict=True):
                if c and w not in place:
                    k = o.bucket(w) - o.tail
                    sums[k] += c
                    kinds[k] += 1
        yield C.batch(k=list(range(o.buckets)), s=sums, n=kinds)

    mass, kinds = np.zeros(outcomes.buckets), np.zeros(outcomes.buckets)
    for r in words.select("w", "c").mapInArrow(bucketed, "k long, s long, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # a row for each bucket
        mass[r["k"]], kinds[r["k"]] = r["s"], r["n"]
    # a bucket without a known word is all unknown
    unknown = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
    counts = np.zeros(outcomes.size)
    counts[END] = ends
    counts[1 : len(single) + 1] = [top[w] for w in single]
    counts[outcomes.tail :] = mass
    model = LogBilinear(outcomes, counts)
    if epochs != 0 and n_train:
        _trained(model, base, numbers, n_train, epochs)
    shared = spark.sparkContext.broadcast((top, place, discount, mass, unknown, model))
    floor = n_train + 0.1 * (known + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, place, d, mass, unknown, model = shared.value
        o = model.ready().outcomes
        # by number of a head word: outcome, log share in it (nan: unknown), base log10; the end comes last
        heads = pa.array(list(counts), pa.binary())
        kind = np.array([place.get(w) or o.bucket(w) for w in counts] + [END], np.int64)
        c = np.array([*counts.values(), ends], np.float64)
        own = np.where(kind < o.tail, 0.0, np.log(np.maximum(c - d, 1e-300) / np.maximum(mass[np.maximum(kind - o.tail, 0)], 1)))
        own[c == 0] = np.nan
        basis = np.log10((c + 0.1) / floor)

        for part, flat, each in pieces(batches):
            lens = each + 1
            starts = np.cumsum(lens) - lens
            number = pc.fill_null(pc.index_in(flat, value_set=heads), -1).to_numpy()
            beyond = flat.filter(pa.array(number < 0))
            at = _with_ends(number, each, len(counts))
            rest = np.flatnonzero(at < 0)
            k = kind[at]
            k[rest] = o.bucket_all(beyond)
            one, two = _contexts(k, starts)
            value = model.logs(one, two, k)
            share = own[at]
            share[rest] = np.nan
            lost = np.flatnonzero(np.isnan(share))
            logu = model.log_unknown(one[lost], two[lost], unknown) if ends else np.zeros(len(lost))
            both = np.stack((value[rest], logu[np.searchsorted(lost, rest)]), 1).astype("<f4")
            value += np.nan_to_num(share)
            value[lost] = logu
            base10, seen = basis[at], ~np.isnan(share)
            value[rest] = base10[rest] = 0
            sums = [np.add.reduceat(x, starts) for x in (value, base10, seen.astype(np.int64))]
            cut = np.searchsorted(np.searchsorted(starts, rest, side="right") - 1, np.arange(len(part) + 1)).tolist()
            yield C.batch(
                k=pa.array(part, pa.int64()), held_out=pa.array([held_out(x) for x in part]), n_tokens=pa.array(lens), n_known=pa.array(sums[2]), base=pa.array(sums[1]), value=pa.array(sums[0]),
                far=pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(C.word_hashes(beyond.to_pylist()).view(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["h", "a", "b"])),
            )

    schema = "k long, held_out boolean, n_tokens long, n_known long, base double, value double, far array<struct<h:long,a:float,b:float>>"
    rows = C.saved(base.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()))

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the words beyond the head, with the log share in their bucket."""
        heads, _, d, mass, _, model = shared.value
        o = model.outcomes
        for ws, cs in C.rows_of(batches, "w", "c"):
            beyond = [(w, c) for w, c in zip(ws, cs, strict=True) if c and w not in heads]
            share = [math.log((c - d) / mass[o.bucket(w) - o.tail]) for w, c in beyond]
            yield C.batch(h=pa.array(C.word_hashes([w for w, _ in beyond]).view(np.int64)), c=pa.array([c for _, c in beyond], pa.int64()), s=pa.array(share, pa.float64()))

    rare = words.select("w", "c").where("c > 0").mapInArrow(by_hash, "h long, c long, s double")
    far = rows.select("row", F.explode("far").alias("x")).select("row", "x.h", "x.a", "x.b").join(rare, "h", "left")
    seen = F.col("c").isNotNull()
    far = far.groupBy("row").agg(F.count_if(seen).alias("far_known"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / floor)).alias("far_base"), F.sum(F.when(seen, F.col("a") + F.col("s")).otherwise(F.col("b"))).alias("far_value"))
    out = rows.drop("far").join(C.small(C.saved(far)), "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return out.select(
        F.col("k").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + zero("far_known")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("far_base")).alias("base_score"), ((F.col("value") + zero("far_value")) / _LN10).alias("score"),
    )


def _places(v: np.ndarray) -> np.ndarray:
    """Rows of (outcome, one before, two before) of a run, whose first two outcomes only come before. An end ends its text, so behind it stand ends."""
    one = v[1:-1]
    return np.stack((v[2:], one, np.where(one == END, END, v[:-2])), axis=1)


def _trained(model: LogBilinear, base: DataFrame, numbers, n_train: int, epochs: int | None = None) -> None:
    """Trains on all places of all training texts. Their outcomes are stored in runs, which are dealt to shards and rounds by hash.

    Tasks train on shards of the runs, each from the same model, and after every round their models are averaged, slice by slice in Spark; the driver holds one model.
    """
    shards = max(1, int(n_train / (SHARD * max(1.0, n_train / (4 * SHARD)) ** (1 / 3))))
    rounds, rows, usual = (ROUNDS, SHARED_ROWS, SHARED_EPOCHS) if shards > 1 else (1, ROWS, EPOCHS)
    epochs = usual if epochs is None else epochs
    kind = np.dtype("<u2" if model.outcomes.size <= 1 << 16 else "<u4")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, o = numbers.value
        words = pa.array(list(place), pa.binary())

        def told(at: np.ndarray) -> Iterator[pa.RecordBatch]:
            v = np.concatenate(([END, END], at)).astype(kind)
            for a in range(0, len(at), LONGEST_RUN):
                raw = v[a : a + LONGEST_RUN + 2].tobytes()
                yield C.batch(x=pa.array([raw], pa.binary()), h=pa.array([xxhash.xxh3_64_intdigest(raw) >> 1], pa.int64()), n=pa.array([len(raw) // kind.itemsize - 2], pa.int64()))

        left = np.empty(0, np.int64)
        for keys, flat, lens in pieces(batches):
            learnt = np.array([not held_out(k) for k in keys], bool)
            flat, lens = flat.filter(pa.array(np.repeat(learnt, lens))), lens[learnt]
            at = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy().astype(np.int64) + 1
            rest = np.flatnonzero(at == 0)
            at[rest] = o.bucket_all(flat.filter(pa.array(at == 0)))
            at, begin = np.concatenate((left, _with_ends(at, lens, END))), 0
            for e in (len(left) + np.cumsum(lens + 1)).tolist():
                if e - begin >= RUN:
                    yield from told(at[begin:e])
                    begin = e
            left = at[begin:]
        if len(left):
            yield from told(left)

    shard = F.pmod(F.col("h"), F.lit(shards)).cast("int")
    runs = C.saved(base.mapInArrow(store, "x binary, h long, n long").withColumn("s", shard), "none")
    each = max(1, -(-n_train // (shards * rounds * rows)))
    model.begin()
    for done in range(epochs * rounds):
        own = runs.where(F.pmod(F.shiftright("h", 20), F.lit(rounds)) == done % rounds)
        model.set_flat(_round(model, own, kind, shards, done, each, epochs * rounds, rows))
    del model.seen, model.noise, model.noise_class


def _round(model: LogBilinear, runs: DataFrame, kind: np.dtype, shards: int, done: int, each: int, rounds: int, rows: int) -> np.ndarray:
    """The model's vector after a round: where tasks have changed a number, the mean of what these made of it."""
    was = model.flat()
    shared = runs.sparkSession.sparkContext.broadcast((model, was))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = shared.value
        own.set_flat(before)
        number: list[int] = []
        rows_in = lambda xs: np.concatenate([_places(np.frombuffer(x, kind).astype(np.int64)) for x in xs])

        def parts() -> Iterator[np.ndarray]:
            held: list[bytes] = []
            for shard, xs in C.rows_of(batches, "s", "x"):
                number[:] = shard[:1]
                for x in xs:
                    held.append(x)
                    if len(held) >= 16:
                        yield rows_in(held)
                        held = []
            if held:
                yield rows_in(held)

        own.train(parts(), done * each, rounds * each, 1000 * done + TaskContext.get().partitionId(), rows)
        if number:
            now = own.flat()
            for j in range(0, len(now), SLICE):
                yield C.batch(j=pa.array([j], pa.int64()), s=pa.array(number, pa.int32()), v=pa.array([now[j : j + SLICE].tobytes()], pa.binary()))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, before = shared.value
        at, sums, changed = None, None, None

        def made() -> pa.RecordBatch:
            v = before[at : at + SLICE] + sums / np.maximum(changed, 1)
            return C.batch(j=pa.array([at], pa.int64()), v=pa.array([v.astype("<f4").tobytes()], pa.binary()))

        for js, vs in C.rows_of(batches, "j", "v"):
            for j, v in zip(js, vs, strict=True):
                if j != at:
                    if at is not None:
                        yield made()
                    at, sums = j, np.zeros(min(SLICE, len(before) - j))
                    changed = np.zeros(len(sums), np.int32)
                d = np.frombuffer(v, "<f4").astype(np.float64) - before[j : j + SLICE]
                sums += d
                changed += d != 0
        if at is not None:
            yield made()

    told = runs.repartitionById(shards, F.col("s")).sortWithinPartitions("h").mapInArrow(learn, "j long, s int, v binary")
    if shards > 1:
        told = told.repartition("j").sortWithinPartitions("j", "s").mapInArrow(mean, "j long, v binary")
    out = was.copy()
    for r in told.select("j", "v").toLocalIterator():  # the model's vector, in slices
        v = np.frombuffer(bytes(r["v"]), "<f4")
        out[r["j"] : r["j"] + len(v)] = v
    shared.unpersist()
    return out


def _head(words: DataFrame, most: int, by: Column) -> dict[bytes, int]:
    """Training counts of the words most frequent ``by`` a count, up to ``most`` of them: whole bins of a logarithmic histogram, from the top."""
    binned = words.select("w", "c", F.floor(8 * F.log2(by)).cast("int").alias("b")).where("b is not null")
    left, least = most, None
    for r in sorted(binned.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["b"]):  # a few hundred bins
        left -= r["n"]
        if left < 0:
            break
        least = r["b"]
    if least is None:
        return {}
    got = binned.where(F.col("b") >= least).select("w", "c").toArrow()
    return dict(zip(got["w"].to_pylist(), got["c"].to_pylist(), strict=True))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(C.documents(spark, sf_dir))
