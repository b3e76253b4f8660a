"""Scores of triples over arrays, fused scores, rewards and schedules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """``x`` to so many places as SQL engines round doubles: scaled, the half away from zero, scaled back.

    ``F.round`` rounds the shortest decimal form instead, so the two differ where sums fall on a half.
    """
    unit = F.lit(10.0**places)
    y = F.abs(x) * unit
    whole = F.floor(y).cast("double")
    up = F.when(y - whole >= 0.5, 1.0).otherwise(0.0)
    # From 2 ** 52 on a double has no fraction; NaN and infinity stay too.
    return F.when(y >= 2.0**52, x).otherwise(F.signum(x) * (whole + up) / unit)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y)


def norm(a: Column, p: int) -> Column:
    return total(F.transform(a, F.abs)) if p == 1 else F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x)))


def transe(h: Column, r: Column, t: Column, p: int = 1) -> Column:
    return -norm(subtract(add(h, r), t), p)


def distmult(h: Column, r: Column, t: Column) -> Column:
    return dot(multiply(h, r), t)


def complex_score(hr: Column, hi: Column, rr: Column, ri: Column, tr: Column, ti: Column) -> Column:
    return dot(multiply(hr, rr), tr) + dot(multiply(hi, rr), ti) + dot(multiply(hr, ri), ti) - dot(multiply(hi, ri), tr)


def rotate(hr: Column, hi: Column, phase: Column, tr: Column, ti: Column, gamma: float = 12.0, p: int = 1) -> Column:
    """gamma less the distance of the tail from the head turned by the phases."""
    cos, sin = F.transform(phase, F.cos), F.transform(phase, F.sin)
    re = subtract(subtract(multiply(hr, cos), multiply(hi, sin)), tr)
    im = subtract(add(multiply(hr, sin), multiply(hi, cos)), ti)
    each = F.zip_with(re, im, lambda a, b: F.abs(a) + F.abs(b)) if p == 1 else F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b + 1e-9))
    return F.lit(gamma) - total(each)


def half(a: Column, second: bool) -> Column:
    """First or second half of an array: real and imaginary parts."""
    n = (F.size(a) / 2).cast("int")
    return F.slice(a, n + 1, n) if second else F.slice(a, F.lit(1), n)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_floor(x: Column, eps: float = 1e-9) -> Column:
    return F.ln(F.greatest(x, F.lit(eps)))


def hybrid(kge: Column, success: Column, w_kge: float = 1.0, w_proof: float = 1.0, penalty: float = 100.0) -> Column:
    return w_kge * log_floor(kge) + F.when(success, F.lit(w_proof)).otherwise(F.lit(-penalty))


def proof_only(log_prob: Column, success: Column, penalty: float = 100.0) -> Column:
    return log_prob - F.when(success, 0.0).otherwise(penalty)


def weighted(kge: Column, log_prob: Column, w_kge: float, w_proof: float) -> Column:
    return w_kge * kge + w_proof * log_prob


def linear_bridge(proof: Column, kge: Column, alpha: float) -> Column:
    a = sigmoid(F.lit(alpha))
    return a * proof + (1 - a) * kge


def gated_bridge(proof: Column, kge: Column, success: Column, on: float, off: float) -> Column:
    """Own weights where the proof succeeded and where it failed; their mean where that is unknown."""
    one, two = linear_bridge(proof, kge, on), linear_bridge(proof, kge, off)
    return F.when(success.isNull(), (one + two) / 2).when(success, one).otherwise(two)


def type_bridge(kge: Column, success: Column, symmetric: Column, w_kge: float, w_symmetric: float, w_other: float, penalty: float) -> Column:
    w = F.when(symmetric, w_symmetric).otherwise(w_other)
    return w_kge * kge + F.when(success, w).otherwise(-w * penalty)


def puct(q: Column, low: Column, high: Column, prior: Column, parent: Column, visits: Column, base: float = 19652.0, init: float = 1.25) -> Column:
    """Normalised value and exploration of a child by its prior and visits."""
    value = F.when(high > low, (q - low) / (high - low)).otherwise(q)
    return value + (F.ln((1 + parent + base) / base) + init) * prior * F.sqrt(F.greatest(parent, F.lit(1))) / (1 + visits)


def predicate_bridge(proof: Column, kge: Column, alpha: Column, default: float = 0.5) -> Column:
    """The linear bridge with a weight of the row's predicate; one without a weight has the default."""
    a = sigmoid(F.coalesce(alpha, F.lit(default)))
    return a * proof + (1 - a) * kge


def rotate_atom(hr: Column, hi: Column, phase: Column, tr: Column, ti: Column) -> Column:
    """Head turned by the phases, less the tail: real parts, then imaginary ones."""
    cos, sin = F.transform(phase, F.cos), F.transform(phase, F.sin)
    re = subtract(subtract(multiply(hr, cos), multiply(hi, sin)), tr)
    return F.concat(re, subtract(add(multiply(hr, sin), multiply(hi, cos)), ti))


def complex_atom(hr: Column, hi: Column, rr: Column, ri: Column, tr: Column, ti: Column) -> Column:
    """Head times relation times the tail's conjugate: real parts, then imaginary ones."""
    a, b = subtract(multiply(hr, rr), multiply(hi, ri)), add(multiply(hr, ri), multiply(hi, rr))
    return F.concat(add(multiply(a, tr), multiply(b, ti)), subtract(multiply(b, tr), multiply(a, ti)))


def atom_vector(kind: str, h: Column, r: Column, t: Column) -> Column:
    """A vector of an atom of its arguments' and relation's: transe, complex, rotate, concat or sum."""
    if kind == "transe":
        return add(r, subtract(h, t))
    if kind == "sum":
        return add(add(r, h), t)
    if kind == "concat":
        return F.concat(r, h, t)
    hr, hi, tr, ti = half(h, False), half(h, True), half(t, False), half(t, True)
    if kind == "complex":
        return complex_atom(hr, hi, half(r, False), half(r, True), tr, ti)
    return rotate_atom(hr, hi, half(r, False), tr, ti)


def state_vector(kind: str, atoms: Column, size: int) -> Column:
    """A vector of a state of its atoms' (array of arrays of ``size``): sum, mean or concat."""
    if kind == "concat":
        return F.flatten(atoms)
    zero = F.array_repeat(F.lit(0.0), size)
    summed = F.aggregate(atoms, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return F.transform(summed, lambda x: x / F.greatest(F.size(atoms), F.lit(1))) if kind == "mean" else summed


def backed_up(value: Column, visits: Column, reward: Column, gamma: float = 0.99) -> tuple[Column, Column]:
    """A node's mean value and visits after one more return through it: reward + gamma * value below."""
    n = visits + 1
    return value + (reward - value) / n, n


def temperature(progress: Column, steps: tuple[tuple[float, float], ...] = ((0.5, 1.0), (0.75, 0.5), (1.0, 0.25))) -> Column:
    """The temperature of the first (share of training, temperature) that progress is below; then the last."""
    out = F.lit(steps[-1][1])
    for upto, value in reversed(steps):
        out = F.when(progress < upto, value).otherwise(out)
    return out


#: Bytes of a soft fact in Parquet, and those that a run may take.
FACT_BYTES, RUN_BYTES = 20, 512 << 20


def capped_k(asked: Column, entities: Column, relations: Column, most: int = 10) -> Column:
    """Soft facts a head and role: as asked, but at most ``most`` and what RUN_BYTES hold, and at least one."""
    holds = F.greatest(F.lit(1), F.floor(F.lit(RUN_BYTES) / (entities * relations * 2 * FACT_BYTES)))
    return F.least(asked, F.lit(most), holds).cast("int")


def soft_facts_expected(entities: Column, relations: Column, k: Column, density: Column) -> Column:
    """Soft facts of both roles less those that are known: up to 30 % of them, density * k."""
    return entities * relations * 2 * k * (1 - F.least(F.lit(0.3), density * k))


# Rewards by type of (proved, label 1), (not, 1), (proved, 0), (not, 0); None is the
# weight of negatives.
REWARDS = {
    0: (1.0, 0.0, 0.0, 0.0),
    1: (1.0, 0.0, -1.0, 0.0),
    2: (1.0, 0.0, 0.0, 1.0),
    3: (1.0, -0.5, -1.5, 1.0),
    4: (1.0, -1.0, -1.0, None),
    5: (1.0, -1.0, -1.0, None),
}
ENDED_BONUS = 0.3


def reward(kind: int, done: Column, success: Column, label: Column, ended: Column, weight: float = 1.0) -> Column:
    """Reward of a finished episode; type 5 adds a bonus to negatives that were ended by choice."""
    tp, fn, fp, tn = REWARDS[kind]
    rest = F.lit(weight if tn is None else tn)
    if kind == 5:
        rest = rest + F.when(ended, ENDED_BONUS).otherwise(0.0)
    hit = F.when(success, tp).otherwise(fn)
    return F.when(~done, 0.0).when(label == 1, hit).when(success, fp).otherwise(rest)


def anneal(progress: Column, start: float, end: float, kind: str = "linear", warmup: float = 0.0) -> Column:
    """A rate over progress 0 to 1: warmed up linearly, then linear, exp or cos to ``end``."""
    x = F.greatest(F.lit(0.0), (progress - warmup) / (1 - warmup))
    after = {"linear": start + (end - start) * x, "exp": start * F.pow(F.lit(end / start), x), "cos": end + (start - end) * (1 + F.cos(x * F.lit(3.141592653589793))) / 2}[kind]
    return F.when((progress < warmup) & F.lit(warmup > 0), start * progress / max(warmup, 1e-12)).otherwise(after)
