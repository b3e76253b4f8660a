import random

import numpy as np
import pytest
import xxhash
from helpers import ODD, documents

from kgweave.llm import simhash


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    comp = list(range(len(fps)))
    while True:
        new = [min(comp[j] for j in range(len(fps)) if (fps[i][1] ^ fps[j][1]).bit_count() <= 2) for i in range(len(fps))]
        if new == comp:
            break
        comp = new
    least = {c: min((d for (d, _), k in zip(fps, comp) if k == c and d is not None), default=None) for c in set(comp)}
    return sorted(((d, f"{f:016x}", least[c]) for (d, f), c in zip(fps, comp)), key=str)


def near(rng, base, k):
    words = base.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return " ".join(words)


@pytest.mark.parametrize("subtrie", [256, 2])
def test_against_brute_force(spark, subtrie, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTRIE", subtrie)
    rng = random.Random(5)
    base = " ".join(rng.choice(["Lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(40)) for _ in range(400))
    rows = [(100 + i, near(rng, base, i % 3)) for i in range(40)] + [(i + 10, f"short {i % 4} text {i % 3}") for i in range(20)] + [(d, (t or "")[:2000] if t else t) for d, t in ODD]
    got = simhash.fingerprint_digest(simhash.near_duplicates(spark, documents(spark, rows))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert simhash.near_duplicates(spark, documents(spark, [])).count() == 0


def test_trie_finds_every_pair():
    rng = np.random.default_rng(1)
    for budget, flips in ((2, 6), (5, 12)):
        base = rng.integers(0, 2**63, 20, dtype=np.uint64)
        keys = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, flips, 20).astype(np.uint64)) for _ in range(8)])
        keys = np.sort(np.concatenate([keys, keys[:5]]))
        got = {tuple(sorted(p)) for a, b in simhash.trie_links(keys, np.array([0, len(keys)]), budget) for p in zip(a.tolist(), b.tolist())}
        want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= budget}
        assert got == want


def test_similar_groups_catch_near_copies_and_leave_the_rest(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTRIE", 16)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, group = [], []
    for g in range(12):
        base = [word() for _ in range(300)]
        for k in range(12):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(300)] = word()
            texts.append(" ".join(w))
            group.append(g)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "one"), (None, texts[0])]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark, documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == [group.index(g) for g in group]
    assert (got[1000], got[1001], got[1002], got[None]) == (1000, 1000, 1002, 0)
    kept = simhash.keep_first(spark, documents(spark, rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(0, 144, 12), 1000, 1002, None], key=str)
    assert kept.columns == documents(spark, rows).columns


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def bridge(rng):
    """L, m, X: m is an original, L and X are separate edits of it that are not similar to each other."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    m = [word() for _ in range(300)]
    # Words in another order keep a fingerprint of different words.
    edit = lambda at: " ".join(m[:at] + [w for i in range(at, at + 14, 2) for w in (m[i + 1], m[i])] + m[at + 14 :])
    left, mid, right = edit(20), " ".join(m), edit(200)
    assert jaccard(left, mid) >= 0.8 and jaccard(mid, right) >= 0.8 > jaccard(left, right)
    return left, mid, right


@pytest.mark.parametrize("parts", [1, 3])
def test_a_bridge_joins_what_it_links(spark, parts):
    rng = random.Random(12)
    rows = []
    for g in range(8):
        left, mid, right = bridge(rng)
        rows += [(10 * g + i, t) for i, t in enumerate((left, mid, right) if g % 2 else (left, right, mid))]
    for order in (rows, rows[::-1]):
        got = simhash.similar_groups(spark, documents(spark, order).repartition(parts) if parts > 1 else documents(spark, order).coalesce(1)).collect()
        assert {r.doc_id: r.component_id for r in got} == {d: d // 10 * 10 for d, _ in rows}


def test_links_at_the_bound_are_exact_for_short_and_long_texts(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, want = [], {}
    # Of n words the last k are others: n - 4 shingles, k of them in one text only.
    for size, k in ((30, 1), (30, 2), (30, 3), (40, 3), (40, 4), (40, 5), (94, 10), (94, 11), (400, 44), (400, 45)):
        for _ in range(20):
            base = [word() for _ in range(size)]
            d = len(rows)
            rows += [(d, " ".join(base)), (d + 1, " ".join(base[:-k] + [word() for _ in range(k)]))]
            want |= {d: d, d + 1: d if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else d + 1}
    assert 100 < sum(c == d for d, c in want.items()) - 200 + 100 < 200
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark, documents(spark, rows)).collect()}
    assert got == want


def test_the_trie_join_gives_similar_groups_their_first_candidates(spark, monkeypatch):
    """It runs once, within two bits, before any band; what it links is held to the exact similarity."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1])), (3, " ".join(word() for _ in range(2000)))]
    near, real = simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1]), simhash.links
    assert near.bit_count() <= 2
    calls = []
    monkeypatch.setattr(simhash, "links", lambda points, scratch, budget: calls.append(budget) or real(points, scratch, budget))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark, documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and calls == [2]


def test_large_groups_cost_pairs_in_proportion_and_lose_no_link(spark, monkeypatch):
    """Edits of one original share bands in masses but many are not similar; some have copies of their own."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))

    def edit(w, k):
        w = list(w)
        for _ in range(k):
            w[rng.randrange(len(w))] = word()
        return w

    texts = []
    for _ in range(2):
        base = [word() for _ in range(150)]
        edits = [edit(base, rng.randint(1, 14)) for _ in range(160)]
        # Edits of edits, so that links lie between nodes far from the hub too.
        texts += [base, *edits, *(edit(edits[k], rng.randint(1, 5)) for k in range(40))]
    rng.shuffle(texts)
    rows = list(enumerate(" ".join(w) for w in texts))
    sets = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) for w in texts]
    least = list(range(len(sets)))
    linked = [(i, j) for i in least for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in linked:
            least[i] = least[j] = min(least[i], least[j])
    assert len(set(least)) > 30
    pairs, real = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda some, *rest: pairs.append(some.count()) or real(some, *rest))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark, documents(spark, rows)).collect()}
    assert got == dict(enumerate(least))
    assert sum(pairs) < 6 * len(rows), pairs
