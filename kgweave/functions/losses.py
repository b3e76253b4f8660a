"""Terms of ranking and contrastive losses, ensembles and attention, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def log_sigmoid(x: Column) -> Column:
    """Stable for either sign."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def softmax(x: Column, over: WindowSpec, temperature: float = 1.0) -> Column:
    """exp(x / T) over its sum in the window, after the window's maximum is taken off."""
    e = F.exp((x - F.max(x).over(over)) / temperature)
    return e / F.sum(e).over(over)


def hinge(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), margin - positive + negative)


def ensemble(scores: list[Column], how: str, weights: list[float] | None = None) -> Column:
    """mean, max, or a sum weighted by the softmax of ``weights``."""
    if how == "max":
        return F.greatest(*scores)
    if how == "mean":
        weights = [0.0] * len(scores)
    e = [F.exp(F.lit(float(w))) for w in weights]
    total = sum(e[1:], e[0])
    parts = [s * w / total for s, w in zip(scores, e, strict=True)]
    return sum(parts[1:], parts[0])


def entropy(p: Column, over: WindowSpec) -> Column:
    """Entropy of the probabilities of a window; 0 has no part in it."""
    return F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).over(over)


def gumbel(key: Column, modulus: int = 1000003) -> Column:
    """A seeded Gumbel variable of an integer key: the greatest of logits with it is a fair draw."""
    u = (F.pmod(key * 7919 + 104729, F.lit(modulus)) + 0.5) / modulus
    return -F.ln(-F.ln(u))


def clipped_value_loss(new: Column, old: Column, target: Column, clip: float) -> Column:
    """Half the greater of the squared errors of a value and of one held within ``clip`` of the old."""
    held = old + F.greatest(F.lit(-clip), F.least(F.lit(clip), new - old))
    return F.greatest((new - target) * (new - target), (held - target) * (held - target)) / 2


def margin_contrastive(positive: Column, negative: Column, margin: float) -> Column:
    """What a negative's score comes nearer to the positive's than ``margin``."""
    return F.greatest(F.lit(0.0), F.lit(margin) + negative - positive)
