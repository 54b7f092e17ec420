"""Per-row losses on logits (B21, B22); reductions live in operators.metrics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labelforge.functions._util import as_col

from labelforge.fixed import FOCAL_ALPHA, FOCAL_GAMMA


def bce_with_logits(logit, label) -> Column:
    """Numerically stable binary cross-entropy on a logit."""
    z = as_col(logit).cast("double")
    y = as_col(label).cast("double")
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal_loss(logit, label, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA) -> Column:
    """``alpha * (1 - pt)^gamma * bce`` with ``pt = exp(-bce)``.
    ``alpha`` weighs both classes alike, as in the reference."""
    bce = bce_with_logits(logit, label)
    pt = F.exp(-bce)
    return F.lit(float(alpha)) * F.pow(F.lit(1.0) - pt, F.lit(float(gamma))) * bce
