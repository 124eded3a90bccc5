"""The pipeline's stages, one after another, against brute force."""

from collections import Counter

import pyarrow as pa
import pytest
from test_corpus_operators import SCHEMA, awkward_rows, brute_links, brute_removal, ids_of, texts_of, words

import __spark_entry__ as driver
import corpus_pipeline as P
from gradeloom.llm import common as C
from gradeloom.llm import mixing, quality

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", ["awkward", "real"])
def test_stages(spark, kind):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with the operators' own names in the awkward table."""
    stage = dict(P.STAGES)
    docs = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(4) if kind == "awkward" else C.documents(spark, DATA)
    docs = C.saved(docs)
    columns, at = docs.columns, {c: i for i, c in enumerate(docs.columns)}

    # what the operator of the first stage keeps, row by row
    verdict = {(r["doc_id"], r["_th"], r["_lang"]): r["kept"] for r in quality.quality(docs).collect()}
    keyed = docs.selectExpr("*", "xxhash64(text) AS __t", "coalesce(lang, '') AS __g").collect()
    want = Counter(tuple(r)[: len(columns)] for r in keyed if verdict[r["doc_id"], r["__t"], r["__g"]])
    good = C.saved(stage["quality rules"](spark, docs, DATA))
    assert good.columns == columns and rows_of(good) == want and good.count()

    # one row of each class stays, that of the least id
    one = C.saved(stage["near duplicates"](spark, good, DATA))
    classes = brute_links([(i, t) for i, t in texts_of(good) if i is not None and words(t)])
    least = {k: c for (k, c, _) in classes}
    assert one.columns == columns
    kept = rows_of(one)
    assert not kept - rows_of(good)
    ids = Counter(r[at["doc_id"]] for r in kept.elements() if r[at["doc_id"]] is not None and words(r[at["text"]]))
    assert ids == Counter(set(least.values()))
    assert sum(r[at["doc_id"]] is None for r in kept.elements()) == good.where("doc_id is null").count()

    # words in a window that a document of a smaller id has go
    clean = C.saved(stage["repeated passages"](spark, one, DATA))
    left = {k: (n, gone) for (k, n, gone, _) in brute_removal(texts_of(one), 50)}
    got = {r["doc_id"]: len(words(r["text"])) for r in clean.collect()}
    assert clean.columns == columns and got == {k: n - gone for k, (n, gone) in left.items() if n > gone or not n}
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"]) for r in clean.collect())

    # whole rows, as many times as the mix takes them
    mixed = C.saved(stage["mixture"](spark, clean, DATA))
    assert mixed.columns == columns and set(rows_of(mixed)) <= set(rows_of(clean))
    times = rows_of(mixed)
    assert all(n <= 3 * rows_of(clean)[r] for r, n in times.items())
    target = {r["source"]: r["target"] for r in mixing.mix(clean, mixing.n_words(clean["text"]), mixing.F.array("source"), mixing.cycle_521, keep=["source"]).collect()}
    taken, longest = Counter(), max(map(len, (words(t) for _, t in texts_of(clean))))
    for r, n in times.items():
        taken[r[at["source"]]] += n * len(words(r[at["text"]]))
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())

    # each row's ids, each id in one piece, in full windows
    out = stage["packing"](spark, mixed, DATA).collect()
    size = Counter()
    for r in out:
        size[r["doc_id"]] += r["length"]
    total = Counter()
    for i, x in ids_of(mixed, 1):
        total[i] += len(x)
    assert size == total
    windows = Counter()
    for r in out:
        windows[r["sequence_id"]] += r["length"]
    assert all(n == 2048 for w, n in windows.items() if w != max(windows)) and sorted(windows) == list(range(len(windows)))


def test_stages_on_an_empty_table(spark):
    docs = C.documents(spark, DATA).limit(0)
    for _, stage in P.STAGES:
        docs = C.saved(stage(spark, docs, DATA))
        assert docs.count() == 0


def test_stages_begin_with_what_stands_free_given_back(spark):
    def collected():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    docs = C.saved(C.documents(spark, DATA).limit(0))
    for _, stage in P.STAGES:
        before = collected()
        stage(spark, docs, DATA)
        assert collected() > before


def test_rows_of_the_driver_need_no_workers(spark):
    rows = [("a", 1.5), (None, None)]
    df = C.local_table(spark, rows, name=pa.string(), share=pa.float64())
    assert df.dtypes == [("name", "string"), ("share", "double")] and [tuple(r) for r in df.collect()] == rows
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert C.local_table(spark, [], name=pa.string(), share=pa.float64()).collect() == []


def test_the_driver_finds_all_of_them(spark):
    found = driver.queries()
    assert {n.split("_")[0] for n in found} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in found
