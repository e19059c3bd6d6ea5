"""Bounded samples of labelled documents for fitting, and models kept in the shared folder."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import map_file, new_folder, stash, write_file

#: Longer texts are not learned from; they are scored whole all the same.
LEARN_BYTES = 1 << 20
#: Bytes of text of all sampled rows together.
SAMPLE_BYTES = 256 << 20
#: More values than this are no labels: an error.
MOST_VALUES = 1000


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    learn: Column | None = None,
    keep: tuple[str, ...] = (),
    read: Callable[[DataFrame], DataFrame] | None = None,
    learn_bytes: int = LEARN_BYTES,
    sample_bytes: int = SAMPLE_BYTES,
) -> list:
    """At most ``per_class`` rows ``(doc_id, label, text, *keep, total)`` of each label value, those first by a hash of ``doc_id``.

    Rows are drawn among those that qualify: an id, a label, and a text of at most ``learn_bytes`` bytes.  Of rows that repeat an id
    one is drawn.  All rows together have at most ``sample_bytes`` bytes of text, an equal part for each value.
    ``total`` is the number of labelled rows of that value, so that a caller can weigh classes as they are.
    ``read`` puts other columns in the place of ``text``, on executors.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    rows = rows if learn is None else rows.where(learn)
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(MOST_VALUES + 1).collect()}
    if len(totals) > MOST_VALUES:
        raise ValueError(f"{label} has more than {MOST_VALUES} values")
    # Ids, lengths and hashes move here, no texts; repeated ids are summed up before they are shuffled.
    sized = docs.select("doc_id", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash")).where(F.col("doc_id").isNotNull() & (F.col("bytes") <= learn_bytes))
    fit = stash(sized.join(rows.distinct(), "doc_id").groupBy("label", "doc_id").agg(F.min("hash").alias("hash"), F.max("bytes").alias("bytes")), "labelled")
    chosen = []
    for value in sorted(totals):
        size = 0
        for r in fit.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            size += r["bytes"]
            if size > sample_bytes // len(totals):
                break
            chosen.append((r["doc_id"], value, r["hash"]))
    if not chosen:
        return []
    spark = docs.sparkSession
    kind = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("label", IntegerType()), StructField("hash", LongType())])
    wanted = F.broadcast(spark.createDataFrame(chosen, kind))  # at most per_class ids of each value
    got = docs.select("doc_id", "text", *keep, F.xxhash64("text").alias("hash")).join(wanted, ["doc_id", "hash"]).dropDuplicates(["doc_id", "label"])
    got = got if read is None else read(got)
    place = {(i, value): k for k, (i, value, _) in enumerate(chosen)}
    found = [r.asDict() for r in got.drop("hash").collect()]
    return [{**r, "total": totals[r["label"]]} for r in sorted(found, key=lambda r: place[r["doc_id"], r["label"]])]


def save(spark, model: object, what: str) -> str:
    """Write a model of fixed size to the shared folder; its URI."""
    uri = f"{new_folder(spark, what)}/model.pickle"
    write_file(uri, pickle.dumps(model, protocol=5))
    return uri


@lru_cache(maxsize=2)
def load(uri: str):
    return pickle.loads(map_file(uri))
