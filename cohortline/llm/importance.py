"""Target-distribution importance resampling: a draw of documents whose n-grams look like the target's."""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.text import map_rows, whole_text
from cohortline.operators.ranks import range_buckets
from cohortline.session import materialize

BUCKETS, WIDTH, SHARE, MIN_WORDS, SEED = 10_000, 3, (5, 100), 20, 42


def _separators() -> bytes:
    """A byte table: A-Z in lower case, other ASCII that is no digit or letter as a space, all else as it is."""
    table = bytearray(range(256))
    for code in range(128):
        letter = chr(code)
        table[code] = ord(letter.lower()) if letter.isalnum() else ord(" ")
    return bytes(table)


_TABLE = _separators()


def one_spaced(text: str) -> bytes:
    """The words of a text between single spaces, one before the first and one behind the last as well."""
    words = text.encode("utf-8", "replace").translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


def scanner(width: int):
    """Finds at every word the run of ``width`` words that begins there, or of as many as are left."""
    return regex.compile(rb"(?<= )[^ ]++(?: [^ ]++){0,%d}+(?= )" % (width - 1))


def feature_hashes(text: str, scan, width: int) -> tuple[int, list[int]]:
    """The number of words and the CRC-32 of every run of 1 to ``width`` words.

    The overlapped scan gives the span of the longest run at each word; a run of n words ends a space before the nth next begins.
    """
    body = one_spaced(text)
    spans = [m.span() for m in scan.finditer(body, overlapped=True)]
    starts = [a for a, _ in spans] + [len(body)]
    hashes = [crc32(body[a:b]) for a, b in spans]
    short = max(len(spans) - width + 1, 0)
    for n in range(1, width):
        # The last words' longest runs are shorter than ``width`` and were counted above already.
        hashes += [crc32(body[a : b - 1]) for a, b in zip(starts[: min(short, len(spans))], starts[n:])]
        hashes += [crc32(body[starts[i] : starts[i + n] - 1]) for i in range(short, len(spans) - n)]
    return len(spans), hashes


def pack_counts(buckets: np.ndarray) -> bytes:
    """Sorted bucket numbers as gaps of one byte; a byte 255 only adds 255."""
    gaps = np.diff(np.sort(buckets), prepend=0)
    far, rest = np.divmod(gaps, 255)
    out = np.full(len(gaps) + int(far.sum()), 255, dtype=np.uint8)
    out[np.cumsum(far + 1) - 1] = rest
    return out.tobytes()


def unpack_counts(code: bytes) -> np.ndarray:
    gaps = np.frombuffer(code, dtype=np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def scanned(rows: DataFrame, keep: list[str], width: int, buckets: int) -> DataFrame:
    """``keep`` with ``n_words``, ``n_features`` and the packed buckets of all features of the column ``text``."""

    def work(columns):
        scan = scanner(width)
        texts = columns["text"]
        # A few texts at a time, so that no more than their features are held.
        for first in range(0, len(texts), 256):
            out = [feature_hashes(t, scan, width) for t in texts[first : first + 256].to_pylist()]
            numbers = [np.array(h, dtype=np.int64) % buckets for _, h in out]
            columns = {
                "n_words": [n for n, _ in out],
                "n_features": [len(x) for x in numbers],
                "features": [pack_counts(x) for x in numbers],
            }
            yield range(first, first + len(out)), columns

    return map_rows(rows, keep, work, "n_words bigint, n_features bigint, features binary")


def bucket_totals(table: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket: every task adds up its rows, Spark the tasks."""

    def add(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for code in batch.column("features").to_pylist():
                total += np.bincount(unpack_counts(code), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    summed = table.select("features").mapInArrow(add, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(buckets, dtype=np.int64)
    for row in summed.collect():  # no more rows than buckets
        totals[row["bucket"]] = row["n"]
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares, in thousandths, rounded down."""
    whole_source, whole_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log(float(t + 1) * whole_source / (float(s + 1) * whole_target))) for s, t in zip(source.tolist(), target.tolist())],
        dtype=np.int64,
    )


def gumbel(key: Column, seed: int) -> Column:
    """A draw from the Gumbel distribution in thousandths, rounded down, that depends on seed and key alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    share: tuple[int, int] = SHARE,
    min_words: int = MIN_WORDS,
    width: int = WIDTH,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Every row's ``key``, ``mark`` (hash of the text), ``n_features``, ``weight``, ``score`` and ``rank``.

    Features are all runs of 1 to ``width`` words, hashed into ``buckets``; a document's weight is the sum of its
    features' gains, the score adds Gumbel noise, and the highest ``share`` of the documents with at least
    ``min_words`` words are drawn: without replacement, with chances in proportion to the importance weight. ``rank`` is
    1, 2, 3 ... in that order, null for the others.

    Texts are read whole, once: the packed buckets (about a byte a feature) are written to the shared folder for the
    totals and the weights. Null text has no words and weight 0. Equal scores go to the smaller key, nulls last; rows
    equal in score and key are alike and take neighbouring ranks. An empty target gives weights all the same, an empty table an empty
    result. Only the totals, one number per bucket, come to the driver. Other columns of the input play no part.
    """
    body = whole_text(text)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("mark"), body.alias("text"))
    table = materialize(scanned(rows, ["key", "mark"], width, buckets), "features")
    wanted = scanned(target.select(F.lit(0).alias("none"), whole_text(target_text).alias("text")), ["none"], width, buckets)
    gain = gains(bucket_totals(table, buckets), bucket_totals(wanted, buckets))

    def weigh(columns):
        yield None, {"weight": [int(gain[unpack_counts(code)].sum()) for code in columns["features"].to_pylist()]}

    weighed = map_rows(table, ["key", "mark", "n_words", "n_features"], weigh, "weight bigint")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)).withColumn("open", F.col("n_words") >= min_words)
    scored = materialize(scored.withColumns({"row": F.monotonically_increasing_id(), "down": -F.col("score"), "shut": ~F.col("open"), "none": F.col("key").isNull()}), "scores")
    drawn = scored.filter("open").count() * share[0] // share[1]

    order = ["shut", "down", "none", "key", "row"]
    placed = range_buckets(scored, order)
    sizes = placed.groupBy("__bucket").count()
    # One row per range of the partitioning, however many documents there are.
    earlier = F.sum("count").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__bucket", F.coalesce(earlier, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) + F.col("before")
    ranked = placed.join(starts, "__bucket").withColumn("place", place.cast("long"))
    rank = F.when(F.col("open") & (F.col("place") <= drawn), F.col("place"))
    return ranked.select(F.col("key").alias(key), "mark", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, ranked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`resample` drew, each as often as it was drawn, with its ``rank`` added (or replaced)."""
    chosen = ranked.filter("rank IS NOT NULL").select(F.col(key).alias("__key"), F.col("mark").alias("__mark"), "rank")
    chosen = chosen.groupBy("__key", "__mark").agg(F.sort_array(F.collect_list("rank")).alias("__ranks"))
    rows = docs.select(F.struct(*docs.columns).alias("__all"), F.col(key).alias("__id"), F.xxhash64(whole_text(text)).alias("__hash"))
    same = F.col("__id").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__mark"))
    number = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.lit(0)))
    found = rows.join(chosen, same).withColumn("__number", number).filter(F.col("__number") <= F.size("__ranks"))
    return found.select(*[F.col(f"__all.{c}").alias(c) for c in docs.columns if c != "rank"], F.get("__ranks", F.col("__number") - 1).alias("rank"))
