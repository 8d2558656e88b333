"""Clusters of near-duplicate items: candidates from shared buckets, exact checks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.session import materialize


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` that is no ``a`` itself; then ``b`` names the component."""
    twice = edges.groupBy("a").count().filter("count > 1").select("a")
    chained = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
    return twice.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (least id reachable) of every id in the edges ``a``, ``b``, by alternating stars.

    A round links each vertex to the least neighbour of the vertices it touches, first upwards, then downwards; both
    are an aggregation and a join, so a vertex with very many neighbours is combined on the map side and its join can
    be split. Each round is written to the shared folder. It ends when every component is a star.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while not _is_forest_of_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a")
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(small.filter("a != b").distinct(), "edges")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows (id, bucket) of buckets of several, with their number ``n``: one shuffle and sort, counted along the sorted rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), dtype=np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.hstack([held, np.vstack([batch.column(c).to_numpy() for c in ("id", "bucket")])])
            heads = np.flatnonzero(np.concatenate([[True], held[1, 1:] != held[1, :-1]])) if held.shape[1] else np.zeros(0, np.int64)
            # The last bucket may go on in the next batch.
            done = held.shape[1] if batch is None else heads[-1] if len(heads) else 0
            heads = heads[heads < done]
            n = np.diff(np.append(heads, done))
            n = np.repeat(n, n)
            several = np.flatnonzero(n > 1)
            yield pa.RecordBatch.from_arrays([pa.array(held[0, several]), pa.array(held[1, several]), pa.array(n[several])], names=["id", "bucket", "n"])
            held = held[:, done:]

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "id bigint, bucket bigint, n bigint")


Elements = tuple[np.ndarray, np.ndarray]
MAP_BITS = 512


def cluster(
    items: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    describe: Callable[[list[str]], list[Elements]],
    close: Callable[[Elements, Elements], bool],
    similarity: float,
    slices: int = 1,
    unique: bool = False,
) -> DataFrame:
    """``id`` and ``component`` of the items of ``items`` (id, bands) that are linked to another one.

    Items that share a bucket are candidates. All pairs of a bucket would grow with its square, so each member is first
    compared with one leader: the one that meets most items in all its buckets, most likely what the others are copies of. What is
    left are buckets that still hold several components, such as texts around one common passage, or copies too far
    from each other. Their items are compared exactly by prefixes: take each item's elements from the rarest on. With shares a and b
    of two items from their first common element on, neither kind of similarity exceeds 1 / (1/a + 1/b - 1), so only items of
    different components with a common element at which this still reaches ``similarity`` meet. Of those without repeated elements, the
    parities of the elements' numbers in 512 hash classes give a second bound: with d classes that differ, of n
    elements in both together, the Jaccard similarity is at most (n - d) / (n + d). No link between candidates is lost.

    An id may come more than once, with the same bands. ``fetch`` gives (id, body) for a table of ids, ``describe`` the
    ascending element hashes and weights of each body, and ``close`` decides a pair, by a similarity that
    keeps this bound for numbers or weights of elements, as Jaccard and probability Jaccard similarity do. With ``slices``
    the bands meet in so many rounds, one after the other, of which each shuffles its own bands alone. ``unique`` says that
    no id comes twice and no item has a bucket twice, which saves two shuffles.
    """

    def meet(bands: Column) -> DataFrame:
        rows = items.select("id", F.explode(bands).alias("bucket"))
        if unique:
            return materialize(_shared_buckets(rows), "met")
        rows = rows.distinct()
        shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        return materialize(rows.join(shared, "bucket"), "met")

    share = F.ceil(F.size("bands") / slices).cast("int")
    met = meet(F.col("bands") if slices == 1 else F.slice("bands", 1, share))
    for k in range(1, slices):
        met = met.unionByName(meet(F.slice("bands", share * k + 1, share)))
    known = met.groupBy("id").agg(F.sum("n").alias("known"))
    members = materialize(met.select("bucket", "id").join(known, "id"), "members")
    # An item that meets many others is most likely what they are copies of.
    leader = F.max_by("id", F.struct("known", -F.col("id"))).alias("leader")
    led = members.join(members.groupBy("bucket").agg(leader), "bucket")
    bodies = materialize(fetch(members.select("id").distinct()), "bodies")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = dict(zip(batch["a"], batch["body_a"])) | dict(zip(batch["b"], batch["body_b"]))
            known = dict(zip(texts, describe(list(texts.values()))))
            linked = [close(known[a], known[b]) for a, b in zip(batch["a"], batch["b"])]
            yield batch.loc[linked, ["a", "b"]]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = describe(batch["body"].tolist())
            sizes = [len(e) for e, _ in known]
            if sum(sizes):
                again = np.repeat(np.arange(len(batch)), sizes)
                element = np.concatenate([e for e, _ in known]).astype(np.int64)
                weight = np.concatenate([np.asarray(w, float) for _, w in known])
                yield batch[["id", "component"]].iloc[again].assign(element=element, weight=weight)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps, sizes, flat = [], [], []
            for element, weight in describe(batch["body"].tolist()):
                bits = np.bincount((element % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1
                maps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                sizes.append(len(element))
                flat.append(bool((np.asarray(weight) == 1).all()))
            yield batch[["id"]].assign(size=sizes, flat=flat, map=maps)

    def verified(pairs: DataFrame) -> DataFrame:
        left = bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a"))
        right = bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b"))
        found = pairs.join(left, "a").join(right, "b").select("a", "b", "body_a", "body_b").mapInPandas(check, "a bigint, b bigint")
        return materialize(found, "links")

    def ordered(first: str, second: str) -> list:
        return [F.least(first, second).alias("a"), F.greatest(first, second).alias("b")]

    def unsettled(members: DataFrame, parts: DataFrame, compared: int) -> DataFrame:
        """The members, with components, of buckets of several components with members that were not compared."""
        placed = members.select("bucket", "id", "known").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
        open_ = mixed.filter((F.col("low") < F.col("high")) & (F.col("n") > compared + 1)).select("bucket")
        return materialize(placed.join(open_, "bucket", "left_semi"), "unsettled")

    tested = materialize(led.filter("id != leader").select(*ordered("id", "leader")).distinct(), "pairs")
    links = verified(tested)
    parts = connected_components(links)

    left = unsettled(members, parts, 1)
    if left.isEmpty():
        return parts
    rest = bodies.join(left.select("id", "component").distinct(), "id")
    maps = materialize(rest.mapInPandas(sketch, "id bigint, size bigint, flat boolean, map array<bigint>"), "maps")
    each = materialize(rest.mapInPandas(spread, "id bigint, component bigint, element bigint, weight double"), "elements")
    common = each.groupBy("element").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    item = Window.partitionBy("id")
    rarest = item.orderBy("n", "element").rowsBetween(Window.unboundedPreceding, -1)
    rest_of = {
        "number": 1 - F.coalesce(F.count("*").over(rarest), F.lit(0)) / F.count("*").over(item),
        "load": 1 - F.coalesce(F.sum("weight").over(rarest), F.lit(0.0)) / F.sum("weight").over(item),
    }
    prefix = each.join(common, "element").withColumns(rest_of).filter(F.greatest("number", "load") >= similarity - 1e-9)
    prefix = prefix.filter("low < high").select("element", "id", "component", "number", "load").join(maps, "id")
    other = prefix.select("element", *[F.col(c).alias(f"lead_{c}") for c in prefix.columns if c != "element"])

    def reachable(share: str) -> Column:
        return 1 / F.col(share) + 1 / F.col(f"lead_{share}") - 1 <= 1 / similarity + 1e-9

    # Every bit in which the maps differ is an element that only one of both has, so it bounds what they share.
    apart = sum((F.bit_count(F.col("map")[i].bitwiseXOR(F.col("lead_map")[i])) for i in range(MAP_BITS // 64)), F.lit(0))
    sizes = F.col("size") + F.col("lead_size")
    may = (sizes - apart) / (sizes + apart) >= similarity - 1e-9
    near = (F.col("id") < F.col("lead_id")) & (F.col("component") != F.col("lead_component")) & (reachable("number") | reachable("load"))
    near = near & (~(F.col("flat") & F.col("lead_flat")) | may)
    met = prefix.join(other, "element").filter(near).select(*ordered("id", "lead_id")).distinct()
    met = met.join(tested, ["a", "b"], "left_anti")
    found = verified(materialize(met, "pairs"))
    return parts if found.isEmpty() else connected_components(links.unionByName(found))
