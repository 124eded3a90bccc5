"""The corpus operators against brute force, on real rows and on rows made to be awkward."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import common as C
from gradeloom.llm import components, encoding, fingerprints, html_pages, lm_scoring, mixing, near_join, packing, quality, ranges, substrings, token_counts, token_files

DATA = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, t int, _k int, size int, n int, r int, host int, taken int, _th int, h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward_rows():
    rnd = random.Random(5)
    prose = lambda n: " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") for _ in range(n))
    long, base = prose(9000), prose(300)
    near = base.split()
    near[150] = "changed"
    texts = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "one  two"), (10, long), (11, prose(60) + "\n" + " ".join(base.split()[20:90]) + "\n" + prose(30)),
        (12, "x\x00y <|endoftext|> <s> é日本 😀   ▁▁ a"), (13, "spam eggs and ham " * 40), (None, base), (None, None), (14, "word " * 2000), (15, "z" * 30000), (16, prose(200)), (-3, prose(120)),
    ]
    return [(i, t, None if n % 7 == 0 else "en", None if n % 5 == 0 else f"s{n % 3}", None, *[n] * 10) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def real(spark):
    return C.documents(spark, DATA).cache()


@pytest.fixture(params=["awkward", "real", "empty"])
def docs(request, spark):
    return spark.createDataFrame([], SCHEMA) if request.param == "empty" else request.getfixturevalue(request.param)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# 1


def test_mix(docs):
    out = mixing.mix(docs, mixing.n_words(F.col("text")), F.array("source"), mixing.cycle_521, keep=["doc_id", "source"]).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(words(t))) for i, t in texts_of(docs))
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for size, taken, target in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 1
    assert abs(sum(v[2] for v in by.values()) - sum(v[0] for v in by.values())) < 1e-3
    again = mixing.mix(docs.repartition(7), mixing.n_words(F.col("text")), F.array("source"), mixing.cycle_521).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in out)


def test_mix_of_overlapping_sources(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(10).alias("w"), F.when(F.col("id") < 100, F.array(F.lit("a"))).when(F.col("id") < 200, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("m"))
    out = mixing.mix(df, F.col("w"), F.col("m"), quotas={"a": 1800, "b": 900}).select("doc_id", "taken", F.explode_outer("taken_by").alias("x")).collect()
    got = Counter()
    for r in out:
        if r["x"]:
            got[r["x"]["source"]] += r["x"]["words"]
    assert got == {"a": 1800, "b": 900}
    assert max(r["taken"] for r in out) == 10  # nothing repeats while there is room elsewhere
    whole = mixing.mix(df, F.col("w"), F.col("m"), quotas={"a": 1805, "b": 901}, cut=False).collect()
    assert all(r["taken"] % 10 == 0 for r in whole) and abs(sum(r["taken"] for r in whole) - 2706) <= 20


def test_flow_is_cheapest():
    """Against all integer flows of small networks."""
    from itertools import product

    rnd = random.Random(1)
    for _ in range(40):
        patterns = [(tuple(s for s in "ab" if rnd.random() < 0.7), rnd.randint(1, 3)) for _ in range(2)]
        quotas = {"a": rnd.randint(0, 6), "b": rnd.randint(0, 6)}
        cost = lambda given, size: sum((k // size) for k in range(given))
        best = None
        for f in product(range(7), repeat=4):
            parts = [{"a": f[0], "b": f[1]}, {"a": f[2], "b": f[3]}]
            if any(x and s not in m for (m, _), p in zip(patterns, parts) for s, x in p.items()) or any(sum(p.values()) > 3 * size for (_, size), p in zip(patterns, parts)):
                continue
            if any(sum(p[s] for p in parts) > quotas[s] for s in "ab"):
                continue
            key = (-sum(f), sum(cost(sum(p.values()), size) for (_, size), p in zip(patterns, parts)))
            best = min(best, key) if best else key
        got = mixing.route(patterns, quotas, 3)
        assert (-sum(sum(p.values()) for p in got), sum(cost(sum(p.values()), size) for (_, size), p in zip(patterns, got))) == best


def test_mix_of_components_equals_one_network(spark):
    """Sources that rows connect are solved apart; together they give the same."""
    rnd = random.Random(9)
    names = ["a", "b", "c", "d", "e", None]
    rows = [(i, rnd.randint(0, 9), rnd.choice([["a"], ["a", "b"], ["c"], ["d", "e"], ["e"], [None], [], None])) for i in range(400)]
    quotas = {"a": 300, "b": 200, "c": 5000, "d": 10, "e": 400, None: 77}
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, w long, m array<string>"), F.col("w"), F.col("m"), quotas=quotas).select("doc_id", "taken", "taken_by").collect()
    size = Counter()
    for _, w, m in rows:
        size[tuple(m or ())] += w
    found = [(m, w) for m, w in size.items() if m]
    want = Counter()
    for g in mixing.route(found, {s: quotas[s] for s in names}, 3):
        want.update(g)
    got = Counter()
    for r in out:
        got.update({x["source"]: x["words"] for x in r["taken_by"]})
    assert {s: got[s] for s in names} == {s: want[s] for s in names}
    weights = mixing.mix(spark.createDataFrame(rows, "doc_id long, w long, m array<string>"), F.col("w"), F.col("m"), mixing.cycle_521).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in weights)


# ranges


@pytest.mark.parametrize("kind", ["dense", "skewed", "wide", "hot", "null", "none"])
def test_range_plans(spark, kind):
    rnd = random.Random(1)
    ids = {
        "dense": list(range(4000)), "skewed": [int(rnd.paretovariate(0.3)) % 10**12 for _ in range(4000)], "wide": [rnd.choice([-(2**63), 2**63 - 1, rnd.randrange(-(2**63), 2**63)]) for _ in range(4000)],
        "hot": [7] * 2000 + list(range(2000)), "null": [None] * 2000 + list(range(2000)), "none": [],
    }[kind]
    rows = C.saved(spark.createDataFrame([(k, 10) for k in ids], "k long, w long"))
    plan = ranges.plan_ranges(rows, 400, bins=16)
    keys = __import__("pyarrow").array(ids, "int64")
    subs = np.array([rnd.randrange(1 << 16) for _ in ids], np.uint16)
    up, down = plan.ranks(keys, subs), plan.ranks_down(keys, subs)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, subs[i]))
    assert (np.diff(up[order]) >= 0).all()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, -(ids[i] or 0), subs[i]))
    assert (np.diff(down[order]) >= 0).all()
    for r in (up, down):
        sums = Counter(r.tolist())
        assert not ids or (min(sums) >= 0 and max(sums) < plan.size and max(sums.values()) * 10 <= 2 * 400)
    assert plan.size <= 400


def test_running_sum(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"), F.lit("x").alias("s"))
    out = ranges.running_sum(df, [F.col("id").desc()], "v", "before", parts=6, keep=["id"]).collect()
    assert {r["id"]: r["before"] for r in out} == {i: sum(j % 7 for j in range(i + 1, 1000)) for i in range(1000)}
    assert ranges.running_sum(df.limit(0), [F.col("id")], "v", "before").count() == 0


# 2, 3, 6


def test_encoder_equals_the_library():
    e, rnd = encoding.Encoder(BYTES), random.Random(1)
    parts = [" ", " ", "\n", "\t", "a", "b", "é", "1", ".", ",", " ", "\0", "'s", "日", "<|endoftext|>", "\r", "word", "!!"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(20000)]
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


def test_encoder_cuts_words_marks_and_lines_as_the_library():
    import regex

    letters = re.compile(encoding._LETTERS)
    assert all(regex.fullmatch(r"\p{L}", c) for c in map(chr, range(0x110000)) if letters.fullmatch(c))
    e, rnd = encoding.Encoder(BYTES, cached=500), random.Random(2)
    parts = ["th", "The", "é", "ß", "ж", "中", "αω", "İ", "ǆ", "×", "²", "ª", "\u0301", "\u02bc", " ", " ", " ", "\n", "\n\n", ".", ",", "!?", "'t", "-", "12", "(", "😀", "x" * 300]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(10000)]
    for a in range(0, len(texts), 100):  # the cache is turned many times
        some = texts[a : a + 100]
        assert [x.tolist() for x in e.encode(some)] == [x.ids for x in e.tok.encode_batch(some, add_special_tokens=False)]
    assert len(e.cache.old) and not e.cache.old.old


@pytest.mark.parametrize("together", [1, 300, 1 << 20])
def test_encoder_cuts_at_line_ends_as_the_library(monkeypatch, together):
    monkeypatch.setattr(encoding, "TOGETHER", together)
    e, rnd = encoding.Encoder(BYTES), random.Random(4)
    parts = ["the", "It's", "'s", "é", "12", ".", "!?", " ", " ", "\n", "\n", "\r", "\t", "\xa0", "\x1c", "\n\n", " \n", "\n ", "<|endoftext|>"]
    texts = ["", "\n", "\nthe", "the\n", None, *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(6000))]
    for a in range(0, len(texts), 700):
        some = [t or "" for t in texts[a : a + 700]]
        assert [x.tolist() for x in e.encode(texts[a : a + 700])] == [x.ids for x in e.tok.encode_batch(some, add_special_tokens=False)]


def test_encoder_makes_the_first_word_of_a_line_once(monkeypatch):
    e, merged = encoding.Encoder(BYTES), []
    merge = e._merged
    monkeypatch.setattr(e, "_merged", lambda *a: (merged.append(a), merge(*a))[1])
    texts = [f"A cat{i % 7} sat.\nThe dog, too.\nThe end" for i in range(200)]
    for a in (0, 100):
        assert [x.tolist() for x in e.encode(texts[a : a + 100])] == [x.ids for x in e.tok.encode_batch(texts[a : a + 100], add_special_tokens=False)]
    assert merged.count(("", "The")) == 1 and len(merged) == len(set(merged))


def test_forgotten_encoder_is_freed_without_the_collector():
    import gc
    import weakref

    one = encoding.encoder(BYTES, 1000)
    one.encode(["some words, and\nmore"])
    gone = weakref.ref(one)
    del one
    encoding.forget(BYTES)
    free = gone() is None
    gc.enable()
    assert free


def test_piece_counts_equal_the_library():
    import sentencepiece

    c, rnd = token_counts.PieceCounter(PIECES), random.Random(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    parts = [" ", " ", "\n", "a", "é", "1", ".", " ", "\0", "the", "▁", "日", "<s>", "in", "er", "ing", "😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(20000)]
    assert [c.count(t) for t in texts] == [len(x) for x in sp.encode(texts, num_threads=1)]


def test_token_counts(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in texts_of(docs))
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, PIECES).collect()) == want


@pytest.mark.parametrize("vocabulary", [2, 3, 300, 32000, 50257, 65536, 70000])
def test_packed_files_round_trip(vocabulary):
    rnd = np.random.default_rng(3)
    docs = [rnd.integers(0, vocabulary, n).astype(np.uint32) for n in (0, 1, 7, 5000, 63, 64, 65)]
    f = token_files.TokenFile(token_files.file_bytes([None, 1, 2, 3, 4, 5, 6], docs, vocabulary, block=64))
    every = np.concatenate(docs)
    assert [(k, s, x.tolist()) for k, s, x in f.documents()] == [(k, int(sum(map(len, docs[:i]))), d.tolist()) for i, (k, d) in enumerate(zip([None, 1, 2, 3, 4, 5, 6], docs))]
    for a, b in ((0, 1), (63, 65), (100, 100), (4000, 5205), (0, 10**9)):
        assert f.ids(a, b).tolist() == every[a:b].tolist()


def ids_of(docs, end):
    from tokenizers import Tokenizer

    rows = texts_of(docs)
    enc = Tokenizer.from_file(BYTES).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return [(i, np.array([*e.ids, end], "<u4")) for (i, _), e in zip(rows, enc)]


def test_token_files(spark, docs):
    uri = C.shared_dir(spark)
    files = token_files.write_token_files(docs, uri, BYTES, shard_text_bytes=20_000, shard_ids=3000)
    out = [tuple(r) for r in token_files.read_token_files(files, uri).orderBy("start").collect()]
    want = ids_of(docs, 0)
    assert Counter((k, n, c) for k, _, n, c in out) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    keys = [k for k, *_ in out]
    assert keys == sorted(keys, key=lambda k: (k is None, k or 0))
    at = 0
    for _, start, n, _ in out:
        assert start == at
        at += n


def test_packing(docs):
    out = packing.pack(docs, BYTES, window=256, segment=100).collect()
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids_of(docs, 1))
    windows, pieces = defaultdict(list), Counter()
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += r["length"]
    last = max(windows, default=0)
    for w, spans in windows.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 256 or w == last
    assert sorted(windows) == list(range(len(windows)))
    total = Counter()
    for (i, n, _), times in want.items():
        total[i] += n * times
    assert pieces == total
    ids = {i: x for i, x in ids_of(docs, 1)}
    for r in out:
        if r["doc_id"] not in (None, 2):  # ids that rows share are told apart by the totals alone
            assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def runs_of(rows, key):
    """Sources along the stream with the number of their ids."""
    out = []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        if out and out[-1][0] == key(r):
            out[-1][1] += r["length"]
        else:
            out.append([key(r), r["length"]])
    return out


@pytest.mark.parametrize("shares", [{"a": 0.25, "b": 0.75}, {"a": 0.125, "b": 0.625, "c": 0.25}, {"a": 0.5, "b": 0.5, "c": 0.0}, {"a": 2.0**-20, "b": 0.5, "c": 0.5}])
def test_packing_is_deficit_round_robin(spark, shares):
    """Against queues that are served round by round."""
    rnd = random.Random(3)
    rows = [(i, " ".join(["word"] * rnd.randint(1, 150)), rnd.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    window, most = 512, 128
    out = packing.pack(df, BYTES, window=window, segment=most, shares=shares).collect()
    total = Counter()
    for r in out:
        total[r["source"]] += r["length"]
    left = max(0.0, 1 - sum(shares.values()))
    quantum = {s: max((shares[s] if s in shares else left) * window, 1e-6) for s in total}
    order = [r["source"] for r in df.select("source").distinct().orderBy(F.xxhash64("source")).collect()]
    queues = {}
    for s in total:  # a queue's documents in the order that they were sent, cut into segments
        q, size = quantum[s], {}
        for r in sorted((r for r in out if r["source"] == s), key=lambda r: (r["sequence_id"], r["offset"])):
            size.setdefault(r["doc_id"], r["doc_tokens"])
        seg = min(most, max(64, math.ceil(q / math.ceil(q / most))))
        queues[s] = [min(seg, n - a) for n in size.values() for a in range(0, n, seg)]
    credit, sent, want = Counter(), Counter(), []
    while any(queues.values()):
        live = [s for s in order if queues[s]]
        jump = max(1, min(math.floor((queues[s][0] - credit[s]) / quantum[s]) for s in live))  # rounds that send nothing
        for s in live:
            credit[s] += quantum[s] * jump
            while queues[s] and queues[s][0] <= credit[s]:
                n = queues[s].pop(0)
                credit[s] -= n
                if want and want[-1][0] == s:
                    want[-1][1] += n
                else:
                    want.append([s, n])
    assert runs_of(out, lambda r: r["source"]) == want


def test_packing_fills_every_window_to_the_shares(spark):
    """Twenty equal sources: each window holds about its share of each."""
    df = spark.range(800).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 60).alias("text"), F.concat(F.lit("s"), F.col("id") % 20).alias("source"))
    out = packing.pack(df, BYTES).toPandas()
    share = out[out.sequence_id < out.sequence_id.max()].pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0) / 2048
    assert share.shape[1] == 20 and (share - 0.05).abs().to_numpy().max() < 0.06
    assert (share.cumsum().to_numpy() - 0.05 * np.arange(1, len(share) + 1)[:, None] < 0.06).all()  # deficits carry


# 4


def lowered(t):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)]


def test_lm_score(docs, monkeypatch):
    """The base columns by a plain count, the score by plain loops over the trained parameters."""
    kept = []
    trained = lm_scoring._trained
    monkeypatch.setattr(lm_scoring, "_trained", lambda model, *a: (trained(model, *a), kept.append(model)))
    out = lm_scoring.lm_score(docs, head=500, least_words=60, epochs=1).collect()
    toks = [(i, lowered(t) + [None]) for i, t in texts_of(docs)]
    c = Counter()
    for i, ts in toks:
        if not lm_scoring.held_out(i):
            c.update(ts)
    n, v = sum(c.values()), len(c)
    want = Counter((i, lm_scoring.held_out(i), len(ts), sum(c[x] > 0 for x in ts), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), 4)) for i, ts in toks)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == want
    if not n:
        return
    m = kept[0]
    o = m.outcomes
    left, level, least = max(60, int(lm_scoring.WORDS_ROOT * n ** (1 / 3))), Counter(math.floor(8 * math.log2(x)) for w, x in c.items() if w), 0
    for b in sorted(level, reverse=True):  # whole bins of the counts
        left -= level[b]
        if left < 0:
            break
        least = b
    own = sorted((w for w in c if w and math.floor(8 * math.log2(c[w])) >= least), key=lambda w: (-c[w], w.encode("utf-8", "surrogatepass")))
    number = {w: i + 1 for i, w in enumerate(own)} | {None: 0}
    once, twice = (sum(x == k for w, x in c.items() if w) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    bucket = lambda w: o.tail + zlib.crc32(w.encode("utf-8", "surrogatepass")[:2]) % o.buckets
    mass, kinds = Counter(), Counter()
    for w, x in c.items():
        if w not in number:
            mass[bucket(w)] += x
            kinds[bucket(w)] += 1

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def every(one, two):
        """The probability of each outcome after two others."""
        h = (m.read[one] @ m.place[0] + m.read[two] @ m.place[1]).astype(float)
        inner = np.concatenate([softmax(m.say[k * o.width : (k + 1) * o.width] @ h + m.bias[k * o.width : (k + 1) * o.width]) for k in range(o.classes)])
        return inner * np.repeat(softmax(m.say_class @ h + m.bias_class), o.width)

    def of(w, p):
        if w in number:
            return p[number[w]]
        if c[w]:
            return p[bucket(w)] * (c[w] - d) / mass[bucket(w)]
        return sum(p[b] * (d * kinds[b] / mass[b] if mass[b] else 1.0) for b in range(o.tail, o.size))

    place = lambda w: number[w] if w in number else bucket(w)
    p = every(3, 1)
    assert abs(sum(of(w, p) for w in [*c, "\0never\0"]) - 1) < 1e-5
    got = {r["doc_id"]: r["score"] for r in out}
    for i, ts in [x for x in toks if x[0] not in (None, 2) and len(x[1]) < 400][:12]:
        at = [0, 0, *map(place, ts)]
        plain = sum(np.log10(of(w, every(at[j + 1], at[j]))) for j, w in enumerate(ts))
        assert abs(got[i] - plain) < 1e-3 * max(1, abs(plain) / 10), i


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_lm_pieces_have_the_plain_words(limit):
    """Words, counts and buckets from whole columns are those of text by text."""
    rnd = random.Random(5)
    parts = [" ", "\t", "\n", "\x0b\x0c\r", "\0", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "A", "Zé", "ÀÉ", "İ", "日本", "w", "word", "!"]
    texts = [None, "", "  ", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(2000))]
    o, got = lm_scoring.Outcomes(60), []
    for keys, flat, lens in lm_scoring.pieces([C.batch(k=list(range(len(texts))), t=pa.array(texts, pa.string())).slice(0, 1500), C.batch(k=list(range(1500, len(texts))), t=pa.array(texts[1500:], pa.string()))], limit):
        ws, ends = flat.to_pylist(), np.cumsum(lens).tolist()
        assert o.bucket_all(flat).tolist() == [o.bucket(w) for w in ws]
        got += [(k, ws[e - n : e]) for k, n, e in zip(keys, lens.tolist(), ends, strict=True)]
    assert got == [(i, (t or "").encode().lower().split()) for i, t in enumerate(texts)]


@pytest.mark.parametrize("far", [1, 300])
def test_lm_scores_what_follows_one_pair_together(monkeypatch, far):
    """10,000 tokens after 25 pairs: 25 rows of classes, and at most 25 of each class's outcomes; also with scores beyond what an exponential holds."""
    g, o = np.random.default_rng(6), lm_scoring.Outcomes(40)
    m = lm_scoring.LogBilinear(o, np.ones(o.size))
    m.say, m.say_class = (far * g.normal(size=x.shape).astype(np.float32) for x in (m.say, m.say_class))
    one, two = g.integers(0, 5, 10_000), g.integers(0, 5, 10_000)
    outcome = g.choice([*range(o.words + 1), *range(o.tail, o.size)], 10_000)
    rows, shares = [], lm_scoring.LogBilinear._shares
    monkeypatch.setattr(lm_scoring.LogBilinear, "_shares", lambda self, h, *i: (rows.append(len(h)), shares(self, h, *i))[1])
    got = m.ready().logs(one, two, outcome)
    assert sum(rows) <= 25 * (1 + o.classes)
    h = (m.read[one] @ m.place[0] + m.read[two] @ m.place[1]).astype(float)
    soft = lambda x: x - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)) - x.max(1, keepdims=True)
    at, k = np.arange(10_000), outcome // o.width
    inner = np.stack([soft(h @ m.say[i * o.width : (i + 1) * o.width].T.astype(float) + m.bias[i * o.width : (i + 1) * o.width])[at, outcome % o.width] for i in range(o.classes)])
    want = soft(h @ m.say_class.T.astype(float) + m.bias_class)[at, k] + inner[k, at]
    sure = want > -60  # below, single precision ends
    assert sure.any() and np.abs(got - want)[sure].max() < 2e-2 and (got[~sure] < -50).all()


@pytest.mark.parametrize(("shard", "gain"), [(lm_scoring.SHARD, 0.2), (100_000, 0.1)])
def test_lm_learns_more_than_counts(spark, monkeypatch, shard, gain):
    """In one task, and in four whose models are averaged."""
    monkeypatch.setattr(lm_scoring, "SHARD", shard)
    docs = C.documents(spark, "/root/testdata/sf0.01")
    per = lambda e: lm_scoring.lm_score(docs, epochs=e).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    (untrained, base), (trained, _) = per(0), per(2)
    assert base < untrained and trained > untrained + gain


@pytest.mark.parametrize("shard", [4_000_000, 2_000])
def test_lm_trains_on_every_place(spark, monkeypatch, shard):
    """All places of all training texts, also where a sample of them was drawn before: no more and no fewer, in one task and in many."""
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 40))) for i in range(1500)] + [(5000, "long text " * 9000), (None, "no id"), (5001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lm_scoring, "SHARD", shard)
    monkeypatch.setattr(lm_scoring, "LONGEST_RUN", 700)
    monkeypatch.setattr(lm_scoring, "RUN", 300)
    places, turn = Counter(), lm_scoring._round

    def watched(model, runs, kind, *a):
        for r in runs.collect():
            places.update(map(tuple, lm_scoring._places(np.frombuffer(bytes(r["x"]), kind)).tolist()))
        return turn(model, runs, kind, *a)

    monkeypatch.setattr(lm_scoring, "_round", watched)
    lm_scoring.lm_score(df, epochs=1)
    learnt = [lowered(t) for i, t in rows if not lm_scoring.held_out(i)]
    c = Counter(w for ws in learnt for w in ws)
    number = {w: i + 1 for i, w in enumerate(sorted(c, key=lambda w: (-c[w], w.encode())))}
    want = Counter()
    for ws in learnt:
        at = [0, 0, *(number[w] for w in ws), 0]
        want.update(zip(at[2:], at[1:], at, strict=False))
    assert places == want


def test_outcomes_hold_every_word_once():
    for n in (0, 1, 7, 63, 64, 65, 5000):
        o = lm_scoring.Outcomes(n)
        assert o.tail > n and o.tail % o.width == 0 and o.size == o.classes * o.width
        assert {o.bucket(bytes((a, b))) for a in range(97, 123) for b in range(97, 123)} <= set(range(o.tail, o.size))


# 5


def brute_links(rows, threshold=0.8):
    sets = [C.shingles(t) if i is not None else np.empty(0) for i, t in rows]
    links = [[j for j in range(len(rows)) if i != j and len(sets[i]) and len(sets[j]) and (x := len(np.intersect1d(sets[i], sets[j]))) >= threshold * (len(sets[i]) + len(sets[j]) - x) - 1e-9] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            low = min([label[i], *(label[j] for j in js)])
            for j in (i, *js):
                if label[j] != low:
                    label[j], changed = low, True
    least = {}
    for i, (k, _) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], k), k) if k is not None and least.get(label[i], k) is not None else k
    return Counter((k, least[label[i]], len(links[i])) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("block", [3, 2048])
def test_near_join(docs, block):
    out = near_join.near_join(docs, block=block).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == brute_links(texts_of(docs))


def test_near_join_of_a_large_group(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rnd.randint(0, 4)):
            ws[rnd.randrange(200)] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(ws)))
    out = near_join.near_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == brute_links(rows)


def test_parts_that_share_an_earlier_value_do_not_meet():
    rnd = random.Random(4)
    heavy = [(0, 7), (1, -3), (3, 9)]
    lanes = [[rnd.choice((7, 5)), rnd.choice((-3, 2)), 1, rnd.choice((9, 8))] for _ in range(300)]
    parts = [near_join.part_of(x, heavy) for x in lanes]
    assert near_join.part_of(lanes[0], None) == 0
    plan = [(p, -(-c // 16)) for p, c in sorted(Counter(parts).items())]
    own, met = zip(*(near_join.blocks_of(p, r, plan) for r, p in enumerate(parts)), strict=True)
    assert sorted(set(own)) == list(range(sum(b for _, b in plan)))
    for i in range(300):
        for j in range(i):
            apart = not any(lanes[i][e] == v == lanes[j][e] for e, v in heavy)
            assert (own[j] in met[i]) == (own[i] in met[j]) == apart


def test_a_large_group_is_dealt_few_times(spark, monkeypatch):
    """1500 near copies in blocks of 50: members whose pairs an earlier band has seen aren't dealt again."""
    rnd = random.Random(6)
    rows = []
    for i in range(1500):
        ws = [f"w{k}" for k in range(120)]
        for _ in range(rnd.randint(0, 2)):
            ws[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")

    stored = []
    saved = C.saved
    monkeypatch.setattr(C, "saved", lambda d, *a: (stored.append(saved(d, *a)), stored[-1])[1])
    out = near_join.near_join(df, block=50).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == brute_links(rows)
    found, parts, plan = (next(x for x in stored if x.columns == c).collect() for c in (["r", "kb", "band", "nb"], ["kb", "band", "r", "n", "p"], ["kb", "plan"]))
    plans = {x["kb"]: [(y["p"], y["nb"]) for y in x["plan"]] for x in plan}
    cut = sum(len(near_join.blocks_of(x["p"], x["r"], plans[x["kb"]])[1]) for x in parts)
    whole = sum(x["nb"] for x in found if x["nb"] > 1 and x["band"] > 0)
    assert len(parts) == sum(x["nb"] > 1 and x["band"] > 0 for x in found) and 4 * cut < whole, (cut, whole)


def test_near_copies_store_no_pairs(spark, monkeypatch):
    """A group of 3000: the links of brute force, and rows stored in proportion to the members."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        ws = list(base)
        for _ in range(rnd.randint(0, 3)):
            ws[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    stored = []
    saved = C.saved
    monkeypatch.setattr(C, "saved", lambda df, *a: (stored.append(saved(df, *a)), stored[-1])[1])
    out = {r["doc_id"]: r["n_links"] for r in near_join.near_join(spark.createDataFrame(rows, "doc_id long, text string"), block=1000).collect()}
    sets = [C.shingles(t) for _, t in rows]
    every = np.unique(np.concatenate(sets))
    m = np.zeros((3000, len(every)), np.float32)
    for i, x in enumerate(sets):
        m[i, np.searchsorted(every, x)] = 1
    common, size = m @ m.T, m.sum(1)
    links = (common / (size[:, None] + size[None, :] - common) >= 0.8 - 1e-6).sum(1) - 1
    assert all(out[i] == links[i] for i in range(3000))
    assert all("js" not in x.columns and x.count() <= 3000 * 32 * 3 for x in stored)


def test_keep_one(awkward):
    left = near_join.keep_one(awkward)
    assert left.columns == awkward.columns
    ids = sorted((r["doc_id"] for r in left.collect() if r["doc_id"] is not None))
    assert ids == [-3, 1, 4, 5, 6, 7, 10, 11, 12, 13, 14, 15, 16]
    assert left.where("doc_id is null").count() == 2


def test_components(spark):
    rnd = random.Random(1)
    edges = [(a, a + 1) for a in range(60)] + [(rnd.randrange(100, 140), rnd.randrange(100, 140)) for _ in range(30)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "u long, v long")).collect())
    assert all(got[x] == 0 for x in range(1, 61)) and 0 not in got


# 7


def plain_fingerprint(text):
    """256 bins by the top byte of a shingle's hash, the least hash of each, empty bins from others by their own sequence; the low bytes."""
    hs = [int(x) for x in C.shingles(text)]
    if not hs:
        return ""
    mixed = lambda x: int(C.mix(np.array([x % 2**64], np.uint64))[0])
    full = {}
    for h in hs:
        full[h >> 56] = min(full.get(h >> 56, h), h)
    out = []
    for i in range(256):
        at, turn = i, 0
        while at not in full:
            turn += 1
            at = mixed(i * 0x9E3779B97F4A7C15 + turn) % 256
        out.append(mixed(full[at]) & 255)
    return bytes(out).hex()


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 512, 2)) / 256
    return min(1.0, max(0.0, (same - 1 / 256) / (255 / 256)))


def test_fingerprints(docs):
    out = fingerprints.fingerprints(docs).collect()
    rows = sorted(texts_of(docs), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5((x[1] or "").encode()).digest()))
    want, prints = Counter(), [plain_fingerprint(t) for _, t in rows]
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = fingerprints.edited_text(t, nxt)
        p = plain_fingerprint(e)
        want[k, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[i], p, round(plain_likeness(prints[i], p), 9), round(plain_likeness(prints[i], prints[(i + 1) % len(rows)]), 9)] += 1
    assert Counter((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out) == want


def test_fingerprints_of_hot_ids(spark, monkeypatch):
    """Many rows without an id, with the same id, and equal in all."""
    rows = [(None, f"null {i}") for i in range(300)] + [(7, f"seven {i} " * 3) for i in range(300)] + [(9, "all the same text") for _ in range(300)] + [(i, f"own {i}") for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = Counter(tuple(r) for r in fingerprints.fingerprints(df).collect())
    monkeypatch.setattr(fingerprints, "PART_TEXT_BYTES", 500)
    assert Counter(tuple(r) for r in fingerprints.fingerprints(df).collect()) == whole and sum(whole.values()) == len(rows)


def test_fingerprints_over_many_ranges(real, monkeypatch):
    whole = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(real).collect()}
    monkeypatch.setattr(fingerprints, "PART_TEXT_BYTES", 30_000)
    assert {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(real).collect()} == whole


def test_edited_texts_make_no_sketch(docs):
    """The columns that need none, with the same rows as the whole operator's."""
    names = ("doc_id", "n_chars", "edited_sha256")
    whole = Counter(tuple(r) for r in fingerprints.fingerprints(docs).select(*names).collect())
    # a sketch of no bins is an error
    out = fingerprints.fingerprints(docs, bins=0, sketched=False)
    assert tuple(out.columns) == names and Counter(map(tuple, out.collect())) == whole


def test_likeness_is_unbiased():
    rnd, errors = random.Random(4), []
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        for _ in range(60):
            both, own = rnd.randint(20, 600), 0
            own = int(both * (1 - share) / 2 / share) if share else both
            take = lambda n: C.mix(np.array([rnd.getrandbits(63) for _ in range(n)], np.uint64))
            x, y, z = take(both if share else 0), take(own), take(own)
            a, b = (np.unique(np.concatenate((x, q))) for q in (y, z))
            j = len(x) / max(1, len(x) + 2 * own)
            errors.append(fingerprints.likeness(fingerprints.packed(fingerprints.sketch(a)), fingerprints.packed(fingerprints.sketch(b))) - j)
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.04


# 8


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article class="post"><h1>Title &amp; more</h1><p><b>One&nbsp;two<br>three<p>Four <i>fi</i>ve &lt;b&gt;</p><div class="ad">Buy</div><aside>Side</aside><form>Mail <input></form>
    <!-- no --><ul><li>a<li>b</ul><section id="comments">Nice!</section></article><footer>End</footer></body></html>"""
    assert html_pages.main_text(page) == "Title & more\n\nOne two three\n\nFour five <b>\n\na\n\nb"
    assert html_pages.main_text(None) == html_pages.main_text("") == ""
    assert html_pages.main_text("plain <b>text") == "plain text"


def test_class_words_leave_text():
    assert html_pages.main_text('<article><p class="share-price">1</p><p id="notice">2</p><section class="related work"><p>3</p></section><div class="notice">4</div></article>') == "1\n\n2\n\n3\n\n4"
    assert html_pages.main_text('<body><div>t</div><div class="cookie-notice">n</div><div class="share-buttons">s</div><div id="sidebar">b</div><p class="advert">a</p><div class="notice">n</div><ul class="comment-list"><li>c</ul></body>') == "t"


@pytest.mark.parametrize("page, text", [("<div>" * 200_000 + "deep", "deep"), ("<a " * 350_000, None), ("<p>x<a '>" * 100_000, None), ("<li>" + "<b>" * 100_000 + "<ul>" + "<li>" * 50_000, ""), ("<" * 500_000 + ">", None), ("<b>" * 100_000 + "</i>" * 100_000, "")])
def test_pages_are_read_in_linear_time(page, text):
    import time

    began = time.thread_time()
    got = html_pages.extracted(page, {1})[0]
    html_pages.template_candidates(page)
    assert time.thread_time() - began < 15
    assert text is None or got == text


def test_deep_and_broken_pages(spark):
    rows = [(1, "http://a/", "<div>" * 3000 + "deep", "x"), (2, None, None, None), (3, "http://a/", "<p class='x>open quote <b>t</b>", "y"), (3, "http://a/", "", "y"), (None, "http://a/", "<p>x</p>", "z")]
    names = "page_id long, url string, html string, host string"
    out = html_pages.extract(spark.createDataFrame(rows, names)).collect()
    assert len(out) == 5 and next(r["text"] for r in out if r["page_id"] == 1) == "deep"
    assert html_pages.extract(spark.createDataFrame([], names)).count() == 0
    clash = spark.createDataFrame([(1, "http://a/", "<p>x</p>", 1, 2, 3, 4)], "page_id long, url string, html string, p int, d int, text int, ds int")
    assert [r["text"] for r in html_pages.extract(clash).collect()] == ["x"]


def plain_template_removal(pages, least=3):
    """Containers of well-formed pages without class names, counted by their source with what the page says beside them."""
    seen = defaultdict(set)
    strip = lambda x: re.sub(r"<[^>]*>", " ", x).split()

    def containers(page):
        for tag in ("div", "ul"):
            for m in re.finditer(f"<{tag}>", page):
                depth, at = 0, m.start()
                for t in re.finditer(f"</?{tag}>", page[m.start() :]):
                    depth += -1 if t[0][1] == "/" else 1
                    if not depth:
                        at = m.start() + t.end()
                        break
                yield m.start(), at

    for host, page in pages:
        for a, b in containers(page):
            seen[host, page[a:b]].add(tuple(sorted(strip(page[:a]) + strip(page[b:]))))
    out = []
    for host, page in pages:
        cut = [(a, b) for a, b in containers(page) if len(seen[host, page[a:b]]) >= least]
        left = "".join(c for i, c in enumerate(page) if not any(a <= i < b for a, b in cut))
        out.append("\n\n".join(x for x in (" ".join(strip(y)) for y in re.split(r"</?(?:div|ul|li|p|body)>", left if strip(left) else page)) if x))
    return out


def test_templates_equal_brute_force(spark):
    rnd = random.Random(6)
    menus, foots = [f"<ul><li>menu {i}</li><li>all</li></ul>" for i in range(4)], [f"<div>foot {i}<div>inner</div></div>" for i in range(5)]
    pages = []
    for i in range(120):
        body = "".join(f"<p>line {rnd.randrange(40)} of text</p>" for _ in range(3)) + f"<p>own {i}</p>"
        pages.append((f"h{rnd.randrange(3)}", f"<body>{rnd.choice(menus)}<div>{body}{rnd.choice(foots) if i % 3 else ''}</div>{rnd.choice(foots)}</body>"))
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    out = html_pages.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in out} == dict(enumerate(plain_template_removal(pages)))
    off = {r["page_id"]: r["text"] for r in html_pages.extract(df, least_pages=10**9).collect()}
    assert sum(off[r["page_id"]] != r["text"] for r in out) > 100 and all(r["n_templates"] for r in out if off[r["page_id"]] != r["text"])


def test_site_templates(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><span>Hot offers</span> all day</div><div>story {i} text</div></body>") for i in range(20)] + [(99, "http://other.example/", "<body><div><span>Hot offers</span> all day</div></body>")]
    out = {r["page_id"]: r["text"] for r in html_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "story 3 text" and out[99] == "Hot offers all day"


def test_pages_say_what_decided(spark):
    nav, foot = "<nav><ul><li>Menu</li></ul></nav>", "<footer>End</footer>"
    page = lambda i, more="": f"<html><head><title>T {i}</title><style>p{{}}</style></head><body>{nav}{more}<article><p>Story {i}.</p></article>{foot}</body></html>"
    rows = [(i, f"http://h.example/{i}", page(i, f"<aside>own {i}</aside>" if i > 7 else "")) for i in range(10)] + [(50, "http://small.example/", page(50)), (51, "http://small.example/2", None)]
    out = {r["page_id"]: (r["text"], r["decided"], r["n_templates"]) for r in html_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: ("" if i == 51 else f"Story {i}.", "templates" if i < 8 else "both" if i < 10 else "rules", 2 if i < 10 else 0) for i in (*range(10), 50, 51)}


def test_templates_within_articles(spark):
    box = "<div><p>More from us</p><ul><li>All stories</li></ul></div>"
    rows = [(i, f"http://h.example/{i}", f"<body><article><h1>Story</h1><p>Same words.</p><p>Text {i}.</p>{box}</article></body>") for i in range(20)]
    copied = "<div>Own words of one page.</div>"  # the same page under several addresses
    rows += [(100 + i, f"http://h.example/c{i}", f"<body><nav>{i}</nav><article>{copied}</article></body>") for i in range(5)]
    rows += [(200, "http://h.example/only", f"<body><article>{box}</article></body>")]
    out = {r["page_id"]: r["text"] for r in html_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[7] == "Story\n\nSame words.\n\nText 7."
    assert out[102] == "Own words of one page." and out[200] == "More from us\n\nAll stories"


def test_templates_of_large_and_small_hosts(spark):
    note = "<div>Section notice</div>"
    rows = [(i, f"http://hot.example/{i}", f"<body><div>story {i}</div>{note if i < 4 else ''}</body>") for i in range(600)]
    rows += [(1000 + i, "http://small.example/", "<body><div>The one page</div></body>") for i in range(3)]  # the same row, thrice
    rows += [(2000 + i, f"http://lists.example/{i}", f"<body><div>All {x}</div></body>") for i, x in enumerate("aaab")]
    out = {r["page_id"]: r["text"] for r in html_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[2] == "story 2" and out[500] == "story 500"
    assert out[1001] == "The one page" and out[2000] == "All a"


def article_text(page):
    import html

    inside = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("tag", ["article", "div"])
def test_pages(spark, tag):
    """The same text whether or not the article is marked."""
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    out = {r["page_id"]: r["text"] for r in html_pages.extract(rows.withColumn("html", F.regexp_replace("html", "article>", f"{tag}>"))).collect()}
    assert out == {r["page_id"]: article_text(r["html"]) for r in rows.collect()}


def test_templates_alone_find_the_article(spark):
    """Menus, adverts and footers without any mark: what recurs on a host goes, and nothing of the articles does."""
    every = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", F.regexp_extract("url", "//([^/?#]*)", 1))
    rows = every.where(F.col("host") == every.groupBy("host").count().orderBy(F.desc("count")).first()["host"]).drop("host")
    bare = rows.withColumn("html", F.regexp_replace(F.regexp_replace("html", "(</?)(?:nav|footer|article)>", "$1div>"), ' class="ad"', ""))
    out = {r["page_id"]: r for r in html_pages.extract(bare).collect()}
    exact = [out[r["page_id"]]["text"] == article_text(r["html"]) for r in rows.collect()]
    assert len(exact) > 300 and np.mean(exact) > 0.95 and np.mean([r["n_templates"] > 0 for r in out.values()]) > 0.95


# 9


def test_quality(docs):
    out = quality.quality(docs).collect()
    want = Counter()
    for i, t in texts_of(docs):
        t = t or ""
        ws = words(t)
        runs = Counter(tuple(ws[a : a + 5]) for a in range(len(ws) - 4))
        again = {b for a in range(len(ws) - 4) if runs[tuple(ws[a : a + 5])] > 1 for b in range(a, a + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        want[i, len(ws), sum(map(len, ws)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(ws) < 10 or 100 * len(again) > 20 * len(ws)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == want
    assert not any(r["kept"] and r["base_failed"] for r in out)
    assert quality.keep_good(docs).count() == sum(r["kept"] for r in out)


def plain_kneser_ney(texts, top):
    """log P of each text's tokens with its end, by an interpolated modified Kneser-Ney bigram model of the distinct texts."""
    count = Counter(w for t in set(texts) for w in words(t))
    top = max(top, 2 * math.isqrt(sum(count.values())))
    least = sorted(count.values(), reverse=True)[min(top, len(count)) - 1]
    known = {w for w in count if count[w] >= least}
    seq = lambda t: ["^", *(w if w in known else "?" for w in words(t)), "^"]
    pair, first, n = Counter(), Counter(), len(known) + 2
    for t in set(texts):
        s = seq(t)
        pair.update(zip(s, s[1:], strict=False))
        first.update(s[:-1])
    after, follow = defaultdict(list), Counter()
    for (a, b), x in pair.items():
        after[a].append(x)
        follow[b] += 1

    def discounts(xs):
        k = [sum(x == i for x in xs) for i in (1, 2, 3, 4)]
        d = [0.5, 1.0, 1.5]
        if k[0] and k[1]:
            y = k[0] / (k[0] + 2 * k[1])
            for i in range(3):
                if k[i] and k[i + 1]:
                    d[i] = min(max(i + 1 - (i + 2) * y * k[i + 1] / k[i], 0.01), i + 0.99)
        return lambda x: d[min(x, 3) - 1] if x else 0.0

    low, high, total = discounts(follow.values()), discounts(pair.values()), sum(follow.values())
    off = sum(map(low, follow.values()))
    uni = lambda b: (follow[b] - low(follow[b])) / total + off / total / n

    def p(a, b):
        if not after[a]:
            return uni(b)
        return (pair[a, b] - high(pair[a, b])) / first[a] + sum(map(high, after[a])) / first[a] * uni(b)

    return [sum(math.log(p(a, b)) for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1) for s in map(seq, texts)]


def test_perplexity_and_verdict_equal_plain_kneser_ney(spark):
    rnd = random.Random(11)
    rows = []
    for lang, n, size in (("en", 120, 400), ("fr", 8, 60)):
        for _ in range(n):
            rows.append((len(rows), " ".join(f"{lang}{min(rnd.randrange(size), rnd.randrange(size))}" for _ in range(rnd.randint(12, 90))), lang))
    rows += [(1000 + i, rows[3][1], "en") for i in range(9)] + [(2000, " ".join(f"j{i}" for i in range(60)), "en"), (2001, None, "xx"), (2002, rows[5][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in quality.quality(df, vocabulary=70).collect()}
    scores = {}
    for lang in ("en", "fr", None):
        own = [(i, t) for i, t, x in rows if x == lang]
        scores[lang] = dict(zip([i for i, _ in own], plain_kneser_ney([t for _, t in own], 70), strict=True))
        for i, x in scores[lang].items():
            assert abs(out[i]["log_perplexity"] + x) < 1e-4, (i, lang)
    found = {}
    for lang, by in scores.items():
        v = sorted(math.floor(-x * quality.BIN) for i, x in by.items() if not out[i]["base_failed"])
        if v:
            q = [(v[next(k for k in range(len(v)) if k + 1 >= f * len(v))] + 0.5) / quality.BIN for f in (0.25, 0.5, 0.75)]
            found[lang] = len(v), q[1], (q[2] - q[0]) / 1.349
    pooled = sum(n * s * s for n, _, s in found.values()) / sum(n for n, _, _ in found.values())
    for lang, by in scores.items():
        for i, x in by.items():
            n, mid, s = found.get(lang, (1, 0, 0))
            k = quality.PRIOR_ROWS
            reach = quality.WIDTH * max(math.sqrt((n * s * s + k * pooled) / (n + k)), quality.LEAST_SPREAD) * math.sqrt(1 + k / n) * math.sqrt(1 + quality.SHORT / out[i]["n_words"])
            if abs(abs(-x - mid) - reach) > 1e-3:
                assert out[i]["kept"] == (not out[i]["base_failed"] and abs(-x - mid) < reach), i
    assert not out[2000]["kept"] and out[2001]["kept"] is False


def test_rows_are_removed_by_language_too(spark):
    rnd = random.Random(4)
    text = " ".join(f"q{rnd.randrange(10**9)}" for _ in range(150))
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.5)) % 900}" for _ in range(150)), "en") for i in range(200)] + [(500, text, "en"), (500, text, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["_lang"]: r["kept"] for r in quality.quality(df, vocabulary=500).where("doc_id = 500").collect()}
    assert kept == {"en": False, "none": True}
    assert [r["lang"] for r in quality.keep_good(df, vocabulary=500).where("doc_id = 500").collect()] == ["none"]


def test_kneser_ney_is_normalised():
    v = quality.Vocabulary([("en", 5), ("en", -7), ("fr", 9)])
    rnd = np.random.default_rng(2)
    pairs = np.unique([(a * v.size + b) for a in range(4) for b in range(4) if rnd.random() < 0.6])
    m = quality.KneserNey(v, pairs, rnd.integers(1, 6, len(pairs)))
    for a in range(4):
        assert abs(np.exp(m.logs(np.array([a * v.size + b for b in range(4)]))).sum() - 1) < 1e-5


def test_small_languages_have_words_of_their_own(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(200)), "en") for i in range(400)]
    rows += [(1000 + i, " ".join(f"x{rnd.randrange(40)}" for _ in range(60)), "xx") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    v = quality.fit(df, vocabulary=50).vocabulary
    assert len(v.hashes["xx"]) == 40 and len(v.hashes["en"]) >= math.isqrt(400 * 200)
    assert all(r["low"] is not None for r in quality.quality(df, vocabulary=50).collect())


def test_languages_beyond_the_largest_share_a_model(spark):
    rnd, names = np.random.default_rng(11), ["aa", "bb", "cc", None, "dd", "ee"]
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words, 30 + i % 17)), names[min(int(rnd.geometric(0.4)) - 1, 5)]) for i in range(600)]
    tokens = {g or "": sum(len(t.split()) for _, t, x in rows if x == g) for g in names}
    own = sorted(tokens, key=lambda g: (-tokens[g], g))[:2]
    plain = [(i, t, g if (g or "") in own else "zz") for i, t, g in rows]
    fields = ("doc_id", "kept", "log_perplexity", "low", "high")
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 40, languages=2).collect()}
    for r in quality.quality(spark.createDataFrame(plain, "doc_id long, text string, lang string"), 40).collect():
        assert [got[r["doc_id"]][f] for f in fields] == pytest.approx([r[f] for f in fields])
    assert {r["_lang"] for r in got.values()} == set(tokens)  # rows keep their own language


def test_a_language_for_each_row(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 40}" for k in range(1, 40)), f"x{i}") for i in range(400)], "doc_id long, text string, lang string")
    v = quality.fit(df, vocabulary=50).vocabulary
    assert len(v.langs) == quality.LANGUAGES + 1 and quality.OTHERS in v.langs
    assert quality.keep_good(df, vocabulary=50).count() == sum(r["kept"] for r in quality.quality(df, vocabulary=50).collect())


def test_bands_reject_junk_and_keep_clean(spark):
    rnd = random.Random(8)
    clean = [f"w{int(rnd.paretovariate(0.5)) % 3000}" for _ in range(400 * 150)]
    rows = [(i, " ".join(clean[i * 150 : i * 150 + 150]), "en") for i in range(400)] + [(1000 + i, " ".join(f"q{rnd.randrange(10**9)}" for _ in range(150)), "en") for i in range(8)]
    out = [r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary=1000).collect() if not r["base_failed"]]
    good, junk = ([r["kept"] for r in out if (r["doc_id"] < 1000) == x] for x in (True, False))
    assert len(good) > 300 and np.mean(good) > 0.98 and len(junk) == 8 and not any(junk)


# 10


def brute_removal(rows, span):
    first = {}
    for k, t in rows:
        ws = words(t)
        for a in range(len(ws) - span + 1):
            g = tuple(ws[a : a + span])
            if k is not None:
                first[g] = min(first.get(g, k), k)
    out = Counter()
    for k, t in rows:
        ws = words(t)
        gone = set()
        if k is not None:
            for a in range(len(ws) - span + 1):
                if first[tuple(ws[a : a + span])] < k:
                    gone.update(range(a, a + span))
        out[k, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("span", [3, 10, 50])
def test_substrings(docs, span):
    assert Counter(tuple(r) for r in substrings.dedup_digest(docs, span).collect()) == brute_removal(texts_of(docs), span)


@pytest.mark.parametrize("modulus", sorted(substrings.COVERS))
def test_covers(modulus):
    d = substrings.COVERS[modulus]
    assert {(a - b) % modulus for a in d for b in d} == set(range(modulus))


def test_dedup_keeps_columns(awkward):
    out = substrings.dedup(awkward)
    assert out.columns == awkward.columns
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in awkward_rows()} - {2}
