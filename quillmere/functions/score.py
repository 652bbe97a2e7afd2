"""Scores, decay and similarity as column expressions (SC20, GR3, L2, L3, RT14, ID10, A14, A17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which an edge's weight has fallen to 1/e.
EDGE_DAYS = 90.0
#: Weights of the hybrid score: meaning, words, entities, strength.
HYBRID = {"semantic": 0.55, "lexical": 0.25, "entity": 0.10, "strength": 0.10}


def clip01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def days_between(later: Column, earlier: Column) -> Column:
    """Days, with fractions, none below zero."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / 86_400e6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """SC20: between 0 and 1; 0 for different lengths, zero vectors and components that are null or not finite."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    fine = (F.size(a) == F.size(b)) & value.isNotNull() & ~F.isnan(value)
    return F.when(fine, clip01(value)).otherwise(0.0)


def edge_weight(occurrences: Column, confidence: Column, last: Column | None = None, now: Column | None = None) -> Column:
    """GR3: log of occurrences times confidence, with decay where times are given."""
    weight = F.log1p(F.greatest(F.lit(1), occurrences)) * confidence
    if last is not None:
        weight = weight * F.exp(-days_between(now, last) / EDGE_DAYS)
    return F.round(weight, 6)


def retention(last: Column, now: Column, strength: Column, stability_days: float = 1.0) -> Column:
    """L2: what is left of a memory: exp(-days / (strength * stability))."""
    return F.exp(-days_between(now, last) / (F.greatest(F.lit(1.0), strength) * stability_days))


def reinforced(strength: Column) -> Column:
    """L3."""
    return strength + 1.0


def strength_signal(strength: Column, retained: Column) -> Column:
    """RT14."""
    return F.round(F.least(F.lit(1.0), F.log1p(strength) / F.log1p(F.lit(10.0))) * retained, 6)


def alias_confidence(rank: Column, weight: Column, top: Column) -> Column:
    """ID10."""
    by_rank = F.least(F.lit(1.0), rank / 100.0)
    by_weight = F.least(F.lit(1.0), weight / F.greatest(top, F.lit(0.0001)))
    return F.round(0.6 * by_rank + 0.4 * by_weight, 4)


def jaccard(both: Column, left: Column, right: Column) -> Column:
    """A14 from counts; 0 if either set is empty."""
    return F.when((left > 0) & (right > 0), F.try_divide(both, left + right - both)).otherwise(0.0)


def hybrid(weights: dict[str, float] | None = None) -> Column:
    """W2 over columns semantic, lexical, entity and strength; a missing one counts as 0."""
    weights = weights or HYBRID
    total = sum(weights.values())
    score = sum((clip01(F.coalesce(F.col(c), F.lit(0.0))) * w for c, w in weights.items()), F.lit(0.0))
    return F.round(score / total, 6) if total > 0 else F.lit(None).cast("double")


def composite(expected: Column, hard: Column, usd: Column, seconds: Column) -> Column:
    """Half expectations, a fifth hard checks, a fifth cost, a tenth speed, on logarithmic scales from $0.007 to $0.30 and 45 s to 1400 s."""

    def scale(value: Column, best: float, worst: float) -> Column:
        return 100 * clip01((F.log10(F.lit(worst)) - F.log10(value)) / (F.log10(F.lit(worst)) - F.log10(F.lit(best))))

    return F.round(0.5 * expected + 0.2 * hard + 0.2 * scale(usd, 0.007, 0.30) + 0.1 * scale(seconds, 45.0, 1400.0), 1)
