"""Packing documents into windows of a fixed number of tokens, best fit decreasing."""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.text import map_rows, whole_text
from cohortline.session import materialize

WINDOW = 2048
END_ID = 1
SHARD_PIECES = 8192
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

# The pre-tokenisation pattern of the public byte-level vocabulary, and the same pattern for texts
# in which no two white-space characters meet, where the look-ahead never matters (and costs a slower matcher).
ANY_TEXT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_DOUBLE = regex.compile(r"\s\s")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """A function from text to ids for a byte-level BPE file; one per Python worker. Ids are the merge order.

    Texts are split at the file's added tokens first, the longest at each place, which have ids of their own.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = json.load(f)
    letters, special = _byte_letters(), {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {bytes(letters[ch] for ch in token): id_ for token, id_ in content["model"]["vocab"].items() if token not in special}
    single = tiktoken.Encoding("single", pat_str=SINGLE_SPACES, mergeable_ranks=ranks, special_tokens={})
    general = tiktoken.Encoding("general", pat_str=ANY_TEXT, mergeable_ranks=ranks, special_tokens={})
    added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None

    def ordinary(text: str) -> list[int]:
        return (general if _DOUBLE.search(text) else single).encode_ordinary(text)

    def encode(text: str) -> list[int]:
        if not any(t in text for t in special):
            return ordinary(text)
        ids = []
        for part in added.split(text):
            ids += [special[part]] if part in special else ordinary(part)
        return ids

    return encode


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Each document's ids and an end id, cut into full windows and a rest: one row per piece.

    Null text is empty and gives the end id alone. Every row of the input counts as a document of its own.
    """

    def cut(columns):
        encode = encoder(vocabulary)
        places, out = [], {c: [] for c in ("start", "length", "ids_crc32", "doc_tokens", "ids")}
        for i, body in enumerate(columns["text"]):
            ids = np.frombuffer(array("I", encode(body.as_py()) + [END_ID]), dtype="<u4")
            for start in range(0, len(ids), window):
                part = ids[start : start + window]
                places.append(i)
                out["start"].append(start)
                out["length"].append(len(part))
                out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                out["doc_tokens"].append(len(ids))
                if with_ids:
                    out["ids"].append(part.astype(np.int32))
        yield places, out

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_rows(rows, ["key"], cut, PIECE + ", ids array<int>" * with_ids)


class OpenWindows:
    """Open windows by free space: a segment tree of counts finds the tightest one that still fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, free: int, change: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, free: int, name: int) -> None:
        self.at[free].append(name)
        self._add(free, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The name and free space of a window with the least free space that is at least ``length``."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._add(free, -1)
        return self.at[free].pop(), free


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """The window and offset of each piece; ``lengths`` must descend."""
    open_, placed, opened = OpenWindows(window), [], 0
    for length in lengths:
        found = open_.take(length) if length < window else None
        if found is None:
            found, opened = (opened, window), opened + 1
        name, free = found
        placed.append((name, window - free))
        if free > length:
            open_.put(free - length, name)
    return placed


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; pieces of a sequence lie gapless from 0, at most ``window`` tokens.

    Pieces are dealt at random to shards of about 8192, each packed by itself, so no task holds more; a shard leaves
    one or two windows partly filled, out of some thousands. Ties in length are packed by key (nulls last), start
    and place read. ``sequence_id`` is unique but not consecutive. The piece table is written once to the shared
    folder, so that a lost executor repeats neither tokenising nor dealing. An empty table gives an empty result.
    """
    cut = materialize(pieces(docs, vocabulary, key, text, window, with_ids).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    shards = 1 + cut.count() // SHARD_PIECES

    def place(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), *[(c, "ascending") for c in ("key", "start", "piece")]]
        rows = rows.take(pc.sort_indices(rows, order, null_placement="at_end"))
        placed = best_fit_decreasing(rows.column("length").to_pylist(), window)
        shard = rows.column("shard")[0].as_py() << 32
        rows = rows.drop_columns(["piece", "shard"])
        rows = rows.append_column("sequence_id", pa.array([shard + name for name, _ in placed], pa.int64()))
        return rows.append_column("offset", pa.array([offset for _, offset in placed], pa.int64()))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "piece")
    packed = dealt.groupBy("shard").applyInArrow(place, f"{out}, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order, from :func:`pack` with ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
