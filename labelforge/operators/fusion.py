"""Label fusion by the trust rule (D2) and its statistics.

Rule: a crowd label of 1 is kept as 1 (the model is ignored); crowd 0 and
model 0 give 0; crowd 0 and model 1 is dropped as a risk.  Any other
combination (a label outside 0/1) is dropped too.  Keys are compared as
stripped text; a null key never matches (SQL semantics).

Plan: each source is first aggregated to ``(filename, label) -> count``
(map-side partial aggregation), and only these small tables are joined.  A
key repeated across a third of the input therefore reaches the join as at
most a handful of rows (one per distinct label), not as a hot partition whose
rows would all be paired with each other.  The reference's inner merge
multiplies duplicate keys; the sizes keep that semantics as sums of
``n_crowd * n_model``, and ``fuse_labels`` re-expands the rows only at the
output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelforge.functions.labels import to_int_label
from labelforge.functions.text import normalise_key


def _prepare(df: DataFrame, key: str, label: str, out_label: str) -> DataFrame:
    return df.select(
        normalise_key(key).alias("filename"),
        to_int_label(label, out_label).alias(out_label),
    )


def _counted(df: DataFrame, key: str, label: str, out_label: str, out_count: str) -> DataFrame:
    return (_prepare(df, key, label, out_label)
            .groupBy("filename", out_label).agg(F.count(F.lit(1)).alias(out_count)))


def merge_sources(crowd: DataFrame, model: DataFrame, key: str = "filename",
                  crowd_label: str = "label", model_label: str = "label") -> DataFrame:
    """The merged label pairs with the rule applied, one row per distinct
    ``(filename, label_crowd, label_model)`` and its multiplicity ``n``
    (= rows of that pair in the reference's inner merge).

    Columns: filename, label_crowd, label_model, n, final_label (null =
    dropped)."""
    c = _counted(crowd, key, crowd_label, "label_crowd", "n_crowd")
    m = _counted(model, key, model_label, "label_model", "n_model")
    merged = c.join(m, "filename", "inner")
    final = (F.when(F.col("label_crowd") == 1, F.lit(1))
             .when((F.col("label_crowd") == 0) & (F.col("label_model") == 0), F.lit(0)))
    return merged.select("filename", "label_crowd", "label_model",
                         (F.col("n_crowd") * F.col("n_model")).alias("n"), final.alias("final_label"))


#: Copies of one pair that a row expands to; more are split into chunks that
#: are dealt out before they are written.
EXPAND_ROWS = 65_536


def fuse_labels(crowd: DataFrame, model: DataFrame, key: str = "filename",
                crowd_label: str = "label", model_label: str = "label") -> DataFrame:
    """The clean training set ``(filename, final_label)``; a duplicated
    key yields as many rows as the reference's merge does."""
    merged = merge_sources(crowd, model, key, crowd_label, model_label)
    kept = merged.filter(F.col("final_label").isNotNull())
    step = F.lit(EXPAND_ROWS).cast("long")
    last = F.expr(f"(n - 1) div {EXPAND_ROWS}")
    chunks = kept.select("filename", "label_crowd", "label_model", "final_label", "n",
                         F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    size = F.least(step, F.col("n") - F.col("chunk") * step).cast("int")
    dealt = chunks.select("filename", "final_label", "chunk", size.alias("size")).repartition("filename", "chunk")
    return dealt.select("filename", F.explode(F.array_repeat("final_label", F.col("size"))).alias("final_label"))


def _per_key(df: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """Rows of each key: all, with label 1 and with label 0."""
    y = F.col(name)
    return (_prepare(df, key, label, name).groupBy("filename")
            .agg(F.count(F.lit(1)).alias(f"{name}_n"), F.count_if(y == 1).alias(f"{name}_1"), F.count_if(y == 0).alias(f"{name}_0")))


def fusion_stats(crowd: DataFrame, model: DataFrame, key: str = "filename",
                 crowd_label: str = "label", model_label: str = "label") -> DataFrame:
    """One row of sizes.  Each source is read once and summed per key; a
    full outer join of the two small tables holds every size."""
    both = (_per_key(crowd, key, crowd_label, "c").join(_per_key(model, key, model_label, "m"), "filename", "full_outer")
            .na.fill(0, ["c_n", "c_1", "c_0", "m_n", "m_1", "m_0"]))

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    c, m = (lambda x: F.col(f"c_{x}")), (lambda x: F.col(f"m_{x}"))
    out = both.agg(
        total(c("n")).alias("crowd"),
        total(m("n")).alias("model"),
        total(c("n") * m("n")).alias("merged"),
        total(c("1") * m("n")).alias("positives"),
        total(c("0") * m("0")).alias("negatives"),
        total(c("0") * m("1")).alias("risk"),
        total(F.when(F.col("filename").isNull(), c("n") + m("n"))).alias("null_keys"),
    )
    final = F.col("positives") + F.col("negatives")
    return out.select("crowd", "model", "merged", final.alias("final"), "positives", "negatives",
                      (F.col("merged") - final).alias("discarded"), "risk", "null_keys")
