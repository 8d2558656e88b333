"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every input partition is a sender. It stores its rows in a table bucketed by sender and sends each owner of a range
   of fingerprints its sorted distinct fingerprints, as Golomb-coded gaps (about 1.5 bits over the entropy).
2. An owner merges what it got and answers each sender with a bitmap over the order sent: which fingerprints another
   sender has too. Equal fingerprints inside one sender are known to that sender.
3. Senders turn the answers into a bitmap over their rows. Stored rows meet it without a shuffle, as both sides are
   bucketed by sender, and only the suspects' texts are shuffled, to be compared byte by byte by grouping on the text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.text import one_space, whole_text
from cohortline.session import new_folder

PRINT_BITS = 48
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of ascending distinct non-negative integers: header, unary quotients, remainders."""
    values = np.asarray(values, dtype=np.int64)
    gaps = np.diff(values, prepend=np.int64(0))
    n = len(gaps)
    k = int(max(0, np.floor(np.log2(max(1.0, gaps.mean() * np.log(2)))))) if n else 0
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    head = np.array([n, k, len(unary)], dtype="<i8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(code: bytes) -> np.ndarray:
    n, k, length = (int(x) for x in np.frombuffer(code, dtype="<i8", count=3))
    cut = 24 + (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[24:cut], dtype=np.uint8), count=length))
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(code[cut:], dtype=np.uint8), count=n * k).reshape(n, k)
    gaps = (quotients.astype(np.int64) << k) + rest.astype(np.int64) @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return np.cumsum(gaps)


def _owner_bounds(owners: int) -> np.ndarray:
    return np.array([(1 << PRINT_BITS) * i // owners for i in range(1, owners)], dtype=np.int64)


def _send(owners: int):
    def send(rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(rows["__print"].to_numpy(np.int64))
        parts = np.split(prints, np.searchsorted(prints, _owner_bounds(owners)))
        full = [i for i, part in enumerate(parts) if len(part)]
        return pd.DataFrame({"__sender": rows["__sender"].iloc[0], "owner": full, "code": [encode(parts[i]) for i in full]})

    return send


def _find(codes: pd.DataFrame) -> pd.DataFrame:
    """One owner's answer: for each sender, a bitmap of the fingerprints that another sender has too."""
    lists = [decode(c) for c in codes["code"]]
    prints, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = prints[counts > 1]
    found = [np.packbits(np.isin(x, shared)).tobytes() for x in lists]
    return pd.DataFrame({"__sender": codes["__sender"], "owner": codes["owner"], "found": found})


def _mark(owners: int):
    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"__sender": [], "__marks": []})
        prints, where, counts = np.unique(rows["__print"].to_numpy(np.int64), return_inverse=True, return_counts=True)
        dup = counts > 1
        cuts = np.concatenate([[0], np.searchsorted(prints, _owner_bounds(owners)), [len(prints)]])
        for owner, found in zip(answers["owner"], answers["found"]):
            size = cuts[owner + 1] - cuts[owner]
            dup[cuts[owner] : cuts[owner + 1]] |= np.unpackbits(np.frombuffer(found, np.uint8), count=size).astype(bool)
        at = rows["__seq"].to_numpy(np.int64)[dup[where]]
        marks = np.zeros(int(rows["__seq"].max()) // 32 + 1, dtype=np.int64)
        np.bitwise_or.at(marks, at >> 5, np.int64(1) << (at & 31))
        return pd.DataFrame({"__sender": [rows["__sender"].iloc[0]], "__marks": [marks]})

    return mark


def with_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if identical after each run of white space is replaced by one space; null counts as empty (empty
    texts are a group like any other). Of a group the row with the smallest key stays; null keys come last, and of
    rows with equal keys the first read stays, so exactly one row of a group is kept. ``keep_id`` is the key of that
    row. An empty table gives an empty result. Input columns with the added names are replaced.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = owners or buckets
    norm = one_space(whole_text(text))
    rows = (
        docs.drop(*ADDED)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumns(
            {
                "__sender": F.shiftright("__row", 33).cast("int"),
                "__seq": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)),
                "__norm": norm,
            }
        )
        .withColumns(
            {
                "text_sha256": F.sha2("__norm", 256),
                "__print": F.shiftrightunsigned(F.xxhash64("__norm"), 64 - PRINT_BITS),
                "__check": F.xxhash64("__norm", F.lit(1)),
            }
        )
        .drop("__row", "__norm")
    )
    name = f"fingerprints_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").bucketBy(buckets, "__sender")
    writer.option("path", new_folder(spark, "fingerprints")).saveAsTable(name)
    stored = spark.table(name)

    light = stored.select("__sender", "__seq", "__print")
    sent = light.groupBy("__sender").applyInPandas(_send(owners), "__sender int, owner int, code binary")
    answers = sent.groupBy("owner").applyInPandas(_find, "__sender int, owner int, found binary")
    marks = light.groupBy("__sender").cogroup(answers.groupBy("__sender")).applyInPandas(_mark(owners), "__sender int, __marks array<bigint>")

    marked = stored.join(marks.hint("shuffle_hash"), "__sender")
    word = F.get(F.col("__marks"), F.shiftright("__seq", 5).cast("int"))
    place = F.col("__seq").bitwiseAND(F.lit(31)).cast("int")
    marked = marked.withColumn("__suspect", F.getbit(word, place) == 1).drop("__marks")

    single = marked.filter(~F.col("__suspect")).withColumns(
        {"keep_id": F.col(key), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    )
    suspects = marked.filter("__suspect")
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "__sender", "__seq"))
    groups = (
        suspects.groupBy("text_sha256", "__check", norm.alias("__norm"))
        .agg(first.alias("first"), F.count("*").alias("group_size"))
        .select(
            "text_sha256",
            "__check",
            "group_size",
            F.col("first.key").alias("keep_id"),
            F.col("first.__sender").alias("__keep_sender"),
            F.col("first.__seq").alias("__keep_seq"),
        )
    )
    verified = suspects.join(groups, ["text_sha256", "__check"]).withColumn(
        "kept", (F.col("__sender") == F.col("__keep_sender")) & (F.col("__seq") == F.col("__keep_seq"))
    )
    columns = [c for c in docs.drop(*ADDED).columns] + ADDED
    return single.select(*columns).unionByName(verified.select(*columns))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of the input."""
    flagged = with_duplicates(docs.withColumn("__all", F.struct(*docs.columns)), key, text)
    return flagged.filter("kept").select("__all.*")
