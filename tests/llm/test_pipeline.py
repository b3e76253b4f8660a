import os
import re

import corpus_pipeline
import pytest
from helpers import ODD, documents

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_keep_columns_and_run_to_the_end(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = corpus_pipeline.run(spark, DATA).orderBy("start").collect()
    assert 0 < len(got) <= 2 * n
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_every_stage_takes_odd_rows(spark):
    rows = [(d, t[:600] if t else t, s) for (d, t), s in zip(ODD, ["a", None, "a", "b", "b", "b", None, "c"], strict=True)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        if name != "mixing":
            assert out.count() <= len(rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_against_plain_python(spark):
    """What each filter keeps of the smallest tables, told anew without Spark."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()}
    sets = {}
    for d, t in rows.items():
        w = t.encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())
    least = {d: d for d in rows}
    order = sorted(rows)
    links = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0) >= 0.8]
    for _ in order:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert kept == {d for d in rows if least[d] == d}
    window = lambda t, n: [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    known: dict[int, set] = {}
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text or "")
        known.setdefault(min(10, len(w)), set()).update(window(w, min(10, len(w))) if w else [])
    clean = {d for d, t in rows.items() if not any(g in of for n, of in known.items() if n for g in window(words(t), n))}
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, DATA).collect()} == clean


def test_every_stage_takes_an_empty_table(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    docs = documents(spark, [], extra=False)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0, name
