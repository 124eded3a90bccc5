"""Personal data, spelling variants and the Merkle manifest against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import DATA, SCHEMA, awkward_rows

from gradeloom.llm import common as C
from gradeloom.llm import merkle, private_data, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(params=["awkward", "real", "empty"])
def docs(request, spark):
    if request.param == "real":
        return C.documents(spark, DATA)
    rows = awkward_rows() if request.param == "awkward" else []
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture
def query(monkeypatch, spark):
    """A query over the given rows."""

    def run(f, docs):
        monkeypatch.setattr(C, "documents", lambda *_: docs)
        return f(spark, "").collect()

    return run


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, c in enumerate(reversed(digits)):
        x = int(c) * (2 if place % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            fine = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def found(text):
    return [f"{private_data.KINDS[s.kind]}:{s.start}:{s.end}" for s in private_data.spans(text)]


def test_private_data(docs, query):
    texts = Counter((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = Counter()
    for (i, t), n in texts.items():
        b = base_spans(t)
        kinds = Counter(x.partition(":")[0] for x in b)
        want[(i, *(kinds[k] for k in PATTERNS), hashlib.sha256(",".join(b).encode()).hexdigest())] += n
    out = query(private_data.op11_private_data, docs)
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out) == want
    assert Counter((r["doc_id"], r["spans"]) for r in out) == Counter({(i, s): n for (i, s), n in Counter((i, ",".join(found(t))) for (i, t), n in texts.items() for _ in range(n)).items()})


def test_base_spans_of_random_texts():
    rnd = random.Random(2)
    pieces = ["a", "B", "é", "@", ".", "-", "+", "1", "25", "300", "4111111111111111", "4111 1111 1111 1111", "(", ")", " ", "  ", "x@y.z", "1.2.3.4", "+1 (555) 010-9999", "\n", ":", "::", "İ", "00000000255", "token = \"a1b2c3\""]
    for _ in range(6000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 30)))
        spans = private_data.spans(text)
        assert [f"{private_data.KINDS[s.kind]}:{s.start}:{s.end}" for s in spans if s.base] == base_spans(text), text
        assert spans == sorted(spans) and all(0 <= s.start < s.end <= len(text) for s in spans)
        added = sorted((s.start, s.end) for s in spans if not s.base)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:], strict=False))


ADDED = [
    ('token = "0b1c2d3e4f"', ["account:9:19"]),
    ("TOKEN = \"0B1C2D3E4F\"!!", ["account:9:19"]),
    ("password: hunter22x", ["account:10:19"]),
    ("the password is lost", []),
    ("tokens = 0b1c2d3e4f", []),
    ("mytoken = 0b1c2d3e4f", []),
    ("IBAN DE89 3704 0044 0532 0130 00.", ["account:5:32"]),
    ("GB82WEST12345698765432", ["account:0:22"]),
    ("GB83WEST12345698765432", []),
    ("account no. 123-456-789 here", ["account:12:23"]),
    ("accounting 123456", []),
    ("passport number: X1234567", ["account:17:25"]),
    ("ghp_0123456789abcdefABCDEF", ["account:0:26"]),
    ("name [at] mail [dot] example [dot] com", ["email:0:38"]),
    ("look at example. com is short", []),
    ("meet me at example.com", []),
    ("jürgen@example.com", ["email:2:18"]),
    ("ö@müller.de", ["email:0:11"]),
    ("https://u:p@example.org/x y", ["email:10:23"]),
    ("https://u:p@localhost/x y", ["url:0:23"]),
    ("see http://example.com/?session=abc123.", ["url:4:38"]),
    ("see http://example.com/a?page=2", []),
    ("tel: 030 123456-7", ["phone:5:17"]),
    ("hotel: 030 123456-7", []),
    ("at 12 Baker Street, London", ["address:3:18"]),
    ("Hauptstraße 5a, 10115 Berlin.", ["address:0:28"]),
    ("12 rue de la Paix, 75002 Paris", ["address:0:30"]),
    ("vive en la calle Mayor 3", ["address:11:24"]),
    ("fe80::1ff:fe23:4567:890a up", ["ip:0:24"]),
    ("std::vector::at", []),
    ("-----BEGIN CERTIFICATE-----\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", ["account:28:93"]),
]


@pytest.mark.parametrize(("text", "want"), ADDED)
def test_added_spans(text, want):
    if text.startswith("https://u:p@e"):
        want = ["email:10:23", "url:0:25"]
    assert found(text) == want


@pytest.mark.parametrize("piece", ["1", "1.", "a@", "@", "+1", "+1 (", "token=", "token = ", "::", "a:", "http://", " at ", "a at ", "account 1", "A", "A calle A", " rue Ab", "DE8", "DE89 ", "tel:1", "12 Ab street", "-----BEGIN RSA PRIVATE KEY-----", "Aa", "(at)"])
def test_texts_are_read_in_linear_time(piece):
    text = (piece * 300_000)[:300_000]
    began = time.process_time()
    private_data.spans(text)
    private_data.spans(text + " x@y.z")
    assert time.process_time() - began < 12


def test_masked_texts(spark):
    rows = [(1, "mail a.b@c.de or +1 (555) 010-9999", 7), (2, None, None), (None, "", 1), (3, "https://u:p@example.org/x y", 2), (3, "clean", 2)]
    out = private_data.find_private(spark.createDataFrame(rows, "doc_id long, text string, spans_of int"), keep=["doc_id", "text", "spans_of"], masked=True).collect()
    got = {(r["doc_id"], r["text"]): r["masked"] for r in out}
    assert got == {(1, rows[0][1]): "mail <EMAIL> or <PHONE>", (2, None): None, (None, ""): "", (3, rows[3][1]): "<URL> y", (3, "clean"): "clean"}


# Spelling


def plain_words(rows):
    n = Counter()
    for i, t in rows:
        for r in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                n[r] += 1
    return {w: c for w, c in n.items() if c >= 2}


def plain_variants(n, times=10):
    """As the operator, by every deletion and insertion of a word that is a word."""
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        near[w] = {x for k in range(len(w)) for x in (w[:k] + w[k + 1 :], *(w[:k] + c + w[k + 1 :] for c in letters)) if x in n and x != w}
        near[w] |= {x for k in range(len(w) + 1) for c in letters if (x := w[:k] + c + w[k:]) in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def as_tuples(rows):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling(docs, query):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = query(spelling.op12_spelling, docs)
    got = as_tuples(out)
    assert len(got) == len(out)
    n = plain_words(rows)
    assert {(x[0], x[3]) for x in got} == set(n.items())
    assert got == plain_variants(n)


@pytest.mark.parametrize("long", [4, 8, 64])
def test_long_words_have_the_same_variants(spark, long):
    """Dense words over two letters, among them runs and swaps; the limit of written keys changes nothing."""
    rnd = random.Random(long)
    n = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(4, 12))): int(10 ** rnd.uniform(0, 5)) for _ in range(500)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_tuples(spelling.variants(df, long=long).collect()) == plain_variants(n)


def test_very_long_words(spark):
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh") for _ in range(60_000))
    n = {base: 500, base[:777] + base[778:]: 20, base[:9000] + "z" + base[9001:]: 7, base[:5] + "q" + base[5:]: 3, "z" * 50_000: 4, "z" * 50_001: 80, base[::-1]: 2}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    words = list(n)
    assert [got[w]["n_near"] for w in words] == [3, 1, 1, 1, 1, 1, 0]
    assert [got[w]["form"] for w in words] == [None, base, base, base, "z" * 50_001, None, None]


def test_roots_follow_chains(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(13)] + [("x", "w12"), ("y", "x"), ("lone", "end")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "end" if w == "lone" else "w13" for w, _ in links}


def test_links_are_never_broadcast(spark, monkeypatch):
    """Words and links grow with the corpus, so no join of them goes through the driver, however small their files are."""
    plans, saved = [], C.saved
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(C, "saved", lambda df, *a: (seen(df), saved(df, *a))[1])
    n = {"abcdefgh": 900, "abcdefg": 80, "abcdef": 7, "other": 3}
    out = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    seen(out)
    assert as_tuples(out.collect()) == plain_variants(n)
    assert sum("Join" in p for p in plans) >= 3 and not [p for p in plans if "Broadcast" in p]


def test_keys_meet_where_words_do():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("aab") for _ in range(rnd.randrange(1, 7))) for _ in range(2))
        plain = [{w} | {w[:k] + w[k + 1 :] for k in range(len(w))} for w in (a, b)]
        digests = [set(map(tuple, spelling.key_digests(w).tolist())) for w in (a, b)]
        assert [len(d) for d in digests] == [len(p) for p in plain]
        assert len(digests[0] & digests[1]) == len(plain[0] & plain[1])


# Merkle


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(r, lowered=False):
    fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"].translate(LOWER) if lowered and r["text"] is not None else r["text"]]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(leaves, fanout):
    """Root, and for each leaf the siblings (left, right) level by level."""
    nodes, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        groups = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for j, i in enumerate(at):
            g = groups[i // fanout]
            paths[j].append(("".join(g[: i % fanout]), "".join(g[i % fanout + 1 :])))
        at = [i // fanout for i in at]
        nodes = ["".join(g) for g in groups]
        nodes = [H(x) for x in nodes]
    return nodes[0], paths


def plain_manifest(rows, fanout=16):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = plain_tree([x[2] for x in by[s]], fanout)
    root, above = plain_tree([trees[s][0] for s in order], fanout) if order else (None, [])
    out = Counter()
    for s, up in zip(order, above, strict=True):
        for (_, _, leaf, r), path in zip(by[s], trees[s][1], strict=True):
            h = plain_leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            for a, b in path + up:
                h = H(a, h, b)
            out[r["doc_id"], leaf, trees[s][0], root, H(*(a + b for a, b in path + up)), h, h == root] += 1
    return out


MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_merkle(docs, query):
    rows = docs.collect()
    assert Counter(tuple(r[c] for c in MERKLE) for r in query(merkle.op13_merkle, docs)) == plain_manifest(rows)


def test_merkle_of_hot_and_single_sources(spark, query):
    """A source of a third of the rows, one of 16, one of 17, hundreds of single rows, a null one, one row many times."""
    rnd = random.Random(6)
    sources = ["hot"] * 400 + ["a"] * 16 + ["b"] * 17 + [None] * 3 + [f"s{k}" for k in range(300)] + ["", "é", "z\U0001f600", "z￿"]
    rows = [(rnd.randrange(10**6), f"T{k} x", "en", s, k, *[0] * 10) for k, s in enumerate(sources)]
    rows += [(7, "Same", None, "hot", None, *[0] * 10)] * 200 + [(None, None, None, "hot", None, *[0] * 10)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert Counter(tuple(r[c] for c in MERKLE) for r in query(merkle.op13_merkle, docs)) == plain_manifest(docs.collect())


def test_tampering_shows(spark):
    rows = C.documents(spark, DATA).select("doc_id", "source", merkle.leaf(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    for fanout in (2, 16):
        out = merkle.manifest(rows, F.col("source"), ["doc_id"], ["doc_id"], fanout=fanout)
        assert out.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
        assert out.where(merkle.folded(merkle.digest(F.col("leaf")), F.col("path")) == F.col("root")).count() == 0
