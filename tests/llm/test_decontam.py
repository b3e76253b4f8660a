import hashlib
import random
import re

import pytest
from helpers import ODD, documents

from kgweave.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for d, text in docs:
        ws, hit, who = low(text), set(), set()
        for item, t in items:
            iw = low(t)
            for i in range(max(1, len(iw) - n + 1) if iw else 0):
                win = iw[i : i + n]
                for j in range(len(ws) - len(win) + 1):
                    if ws[j : j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        who.add(str(item))
        ids = ",".join(sorted(who))
        out.append((d, len(ws), len(hit), len(who), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontam.AUTOMATON_WORDS, 25])
def test_against_brute_force(spark, limit):
    rng = random.Random(3)
    vocab = ["a", "B", "c1", "é", "d"]
    say = lambda k: rng.choice([" ", ", ", "--"]).join(rng.choice(vocab) for _ in range(k))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(12)] + [(3, say(12)), (50, None)]
    docs = [(i, say(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") + "! " + say(4)) for i in range(30)] + [(d, t) for d, t in ODD if d is not None]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leak_digest(decontam.find_leaks(spark, documents(spark, docs), b, automaton_words=limit)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_spans_are_of_the_original(spark):
    text = "Start: One, two; THREE four five six seven eight nine ten. End é"
    b = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    r = decontam.find_leaks(spark, documents(spark, [(1, text)]), b).first()
    assert [(s.item, text[s.first : s.last]) for s in r.spans] == [("7", "One, two; THREE four five six seven eight nine ten")]


def test_empty_tables_and_filter(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    d = documents(spark, ODD)
    assert decontam.find_leaks(spark, d, b).where("n_hit > 0").count() == 0
    assert decontam.find_leaks(spark, d.limit(0), b).count() == 0
    b = spark.createDataFrame([(1, "same text twice")], "item_id long, text string")
    kept = decontam.drop_leaked(spark, d, b)
    assert kept.columns == d.columns
    assert kept.count() == len(ODD) - 2
