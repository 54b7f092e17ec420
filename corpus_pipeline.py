"""A training-data pipeline over ``documents``.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.  Rows of
one doc_id are kept or dropped together; null texts count as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from labelforge.llm.common import land, table
from labelforge.llm.hot import without_keys
from labelforge.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id, null too, is among ``ids``; texts
    that certainly stay are not shuffled."""
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    named = {"__none": lambda i: i.isNull(), "__id": lambda i: F.coalesce(i.cast("string"), F.lit(""))}
    gone = land(ids.select(*[f(F.col("doc_id")).alias(c) for c, f in named.items()]).distinct(), "documents-to-drop")
    marked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]).withColumns({c: f(F.col(inner["doc_id"])) for c, f in named.items()})
    return without_keys(marked, gone, [*named]).select(*[F.col(n).alias(c) for c, n in inner.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their
    language and source (operator 9).  Null and empty texts fail the base
    rules; rows of one text, language and source are kept or dropped together;
    long texts are judged whole; an empty table stays empty."""
    _ready(spark)
    return quality.drop_rejected(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring template lines (operator 3); one of which
    nothing but white space is left goes, ``n_chars`` follows the text.  Rows
    that lose no line stay as they are, null and empty texts included; repeated
    rows count as one document of their text; an empty table stays empty."""
    _ready(spark)
    # the operator adds columns: others go through it under names of their own
    inner = {c: c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)}
    out = line_dedup.drop_lines(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]))
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    sized = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.where(left).select(*[(sized if c == "n_chars" else F.col(n)).alias(c) for c, n in inner.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar ones
    (operator 7 on shingles of five words at a similarity of 0.8).  Documents
    without words stay; of repeated rows (id and text) one stays; long texts are
    compared whole; an empty table stays empty."""
    _ready(spark)
    groups = (jaccard_join.similar_groups(docs, shingle=5, percent=80, meet=1)
              .select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first")))
    rows = land(groups.groupBy("doc_id").agg(F.count_if("first").alias("c")), "documents-of-groups")
    out = _without(docs, rows.where("c = 0").select("doc_id"))
    # rows of one id: of each text one
    return out if not rows.where("c > 1").limit(1).count() else out.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark (operator 1).  Null and
    empty texts hold none and stay; rows of one id go together; long texts are
    searched whole; with an empty table or benchmark nothing changes."""
    _ready(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0").select("doc_id"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digest of what they decode to
    (operator 5).  Null and empty texts have no ids; repeated rows stay."""
    _ready(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode(docs, ranks, keep=("doc_id", "lang", "source"), decoded=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("jaccard_join", near_duplicates),
          ("decontaminate", decontamination), ("byte_bpe", tokens)]

#: Outlier estimates and tokenizer merges are not expressible in SQL; the
#: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
