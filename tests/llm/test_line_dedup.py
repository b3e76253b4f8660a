import hashlib
import random

from helpers import ODD, documents

from kgweave.llm import line_dedup


def brute(rows):
    key = lambda d, t: (d is not None, d or 0, hashlib.md5((t or "").encode()).digest())
    seen: dict = {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda r: key(*r)):
        ls = t.split("\n")
        for i in range(len(ls) - 2):
            seen.setdefault(tuple(ls[i : i + 3]), []).append((key(d, t), i))
    out = []
    for d, t in rows:
        ls, gone = (t or "").split("\n"), set()
        for i in range(len(ls) - 2):
            if min(seen[tuple(ls[i : i + 3])]) != (key(d, t), i):
                gone |= {i, i + 1, i + 2}
        kept = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out.append((d, 0 if t is None else len(ls), len(gone), hashlib.md5(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))) for i in range(60)] + ODD + [(70, "a\na\na\na\na\na"), (5, "other\ntext\nof five"), (71, "other\ntext\nof five")]
    got = sorted((tuple(r) for r in line_dedup.line_report(spark, documents(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert line_dedup.line_report(spark, documents(spark, [])).count() == 0


def test_texts_keep_a_copy_of_every_line(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice("abcdef") for _ in range(9))) for i in range(30)]
    docs = documents(spark, rows)
    out = line_dedup.dedup_lines(spark, docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert {x for _, t in rows for x in t.split("\n")} == {x for t in texts.values() for x in t.split("\n") if x}
    assert texts[0] == rows[0][1] or len(texts[0]) < len(rows[0][1])
