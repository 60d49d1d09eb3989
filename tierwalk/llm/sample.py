"""Bounded samples of labelled rows for fitting.

Edge cases: rows without an id or a label are left out; of repeated ids the first in label order counts; of several texts
under one id all are taken; an empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Labels whose counts are sent to all tasks.
COMMON = 200


def _thinned(ids: DataFrame, each: int) -> DataFrame:
    counts = ids.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(COMMON)
    share = F.coalesce(F.lit(2.0 * each) / F.col("n"), F.lit(1.0))
    return ids.join(F.broadcast(counts), "label", "left").where(F.expr("pmod(xxhash64(doc_id, 'thin'), 1000000)") < share * 1_000_000).drop("n")


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, each: int | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled rows for which `learn` holds, picked by a hash of the id.

    With `each`, at most so many of every label come first, so that a rare label is not lost beside common ones. Of a common
    label, ids are first thinned by their hash to about twice that, so that ranking it takes no longer than a rare one; so are
    the COMMON most frequent labels, and no other can hold a large share of the rows. Ids are picked first, from columns
    of a few bytes, and only then do texts join: the pick holds at most `most` ids, so it can be broadcast.
    """
    ids = labels.select("doc_id", F.col(label).alias("label")).where("doc_id is not null and label is not null").where(learn)
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"))
    if each is not None:
        ids = _thinned(ids, each).withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order[:2]))).where(F.col("rank") <= each)
        order = (F.col("rank"), *order)
    picked = ids.orderBy(*order).limit(most).groupBy("doc_id").agg(F.min("label").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
