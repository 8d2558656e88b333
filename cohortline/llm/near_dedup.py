"""Near duplicates by ProbMinHash over weighted word shingles, banding and exact verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm import shingles as sh
from cohortline.llm.components import cluster
from cohortline.llm.text import map_rows, one_space, whole_text
from cohortline.session import materialize, small_batches

SIMILARITY, ROWS, RECALL = 0.8, 4, 0.99999
GROUP_BYTES = 500_000
ADDED = ["class_id", "class_size", "kept"]


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle's weight: 1 + ln(occurrences), so repeats count, but less and less."""
    return 1.0 + np.log(counts)


def signatures(texts: list[str], bands: int, rows: int) -> list[np.ndarray]:
    """Band keys of each text; none for a text without words.

    Texts that repeat shingles have bands by weights and bands by the shingles alone. Weights of 1 make both the same,
    so that a text without repeats meets each kind with the one set it has.
    """
    out = []
    for _, group in sh.batches(texts, GROUP_BYTES):
        number, element, counts = sh.shingles(group)
        repeats = np.zeros(len(group), dtype=bool)
        repeats[number[counts > 1]] = True
        signed = sh.prob_minhash(number, element, weights(counts), len(group), bands * rows)
        keys, filled = sh.band_keys(signed, bands), np.bincount(number, minlength=len(group)) > 0
        chosen = repeats[number]
        renamed = (np.cumsum(repeats) - 1)[number[chosen]]
        plain = sh.prob_minhash(renamed, element[chosen], np.ones(int(chosen.sum())), int(repeats.sum()), bands * rows)
        also = iter(sh.band_keys(plain, bands))
        out += [(np.concatenate([k, next(also)]) if r else k) if f else k[:0] for k, f, r in zip(keys, filled, repeats)]
    return out


def describe(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles, ascending, and their weights."""
    out = []
    for _, group in sh.batches(texts, GROUP_BYTES):
        number, element, counts = sh.shingles(group)
        cuts = np.searchsorted(number, np.arange(len(group) + 1))
        out += [(element[i:j], weights(counts[i:j])) for i, j in zip(cuts[:-1], cuts[1:])]
    return out


def similar(similarity: float):
    """Whether the probability Jaccard or the plain Jaccard similarity of two texts reaches the limit."""

    def close(x, y):
        return sh.set_jaccard(x[0], y[0]) >= similarity or sh.probability_jaccard(*x, *y) >= similarity

    return close


def with_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, rows: int = ROWS) -> DataFrame:
    """``key`` with ``class_id``, ``class_size``, ``kept`` and the text's ``digest`` for every row.

    A class is a connected component of links: two texts are linked if the probability Jaccard similarity of their
    five-word shingles (weight 1 + ln of the count) or the plain one is at least ``similarity``. Texts equal but for
    white space are one item. Null is empty; texts without words form one class. A text of fewer than five words has
    one shingle of all of them. ``class_id`` is the smallest key of the class (null if all are null); one row of a class is
    kept: that with the smallest key, nulls last, of rows with equal keys the first read. There are bands for either
    similarity, each tuned so that a pair at the limit is missed with probability 1e-5. An empty table gives an empty result.
    """
    bands = sh.tune_bands(similarity, RECALL, rows)
    body = F.trim(one_space(whole_text(text)))
    slim = docs.select(F.col(key).alias("key"), body.alias("body")).withColumn("digest", F.unhex(F.md5("body")))

    def sign(columns):
        yield None, {"bands": signatures(columns["body"].to_pylist(), bands, rows)}

    signed = map_rows(slim, ["key", "digest"], sign, "bands array<bigint>").withColumn("row", F.monotonically_increasing_id())
    with small_batches(docs.sparkSession):
        signed = materialize(signed, "signatures")
    items = signed.groupBy("digest").agg(F.min("row").alias("id"), F.first("bands").alias("bands"))
    items = materialize(items, "items")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = items.join(ids, "id").select("id", "digest")
        return slim.select("digest", "body").join(wanted, "digest").groupBy("id").agg(F.first("body").alias("body"))

    with small_batches(docs.sparkSession):
        parts = materialize(cluster(items.select("id", "bands"), fetch, describe, similar(similarity), similarity), "parts")
    placed = signed.select("key", "digest", "row").join(items.select("digest", "id"), "digest").join(parts, "id", "left")
    placed = placed.select("key", "digest", "row", F.coalesce("component", "id").alias("component"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), "row")).alias("first")
    classes = placed.groupBy("component").agg(first, F.count("*").alias("class_size"))
    joined = placed.join(classes, "component")
    return joined.select(
        F.col("key").alias(key), F.col("first.key").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest"
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of the input. Of rows with equal keys and equal texts one stays."""
    classes = with_classes(docs, key, text).groupBy(key, "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    chosen = classes.filter("kept").select(F.col(key).alias("__key"), F.col("digest").alias("__digest"), F.col("copies").alias("__copies"))
    body = F.trim(one_space(whole_text(text)))
    found = docs.withColumn("__text", F.unhex(F.md5(body))).join(chosen, (F.col(key).eqNullSafe(F.col("__key"))) & (F.col("__text") == F.col("__digest")))
    rows = found.select("__key", "__digest", "__copies", F.struct(*docs.columns).alias("__all"))
    repeated = rows.filter("__copies > 1").groupBy("__key", "__digest").agg(F.first("__all").alias("__all"))
    return rows.filter("__copies = 1").select("__all.*").unionByName(repeated.select("__all.*"))
