"""Byte strings that repeat anywhere in the corpus, by a depth-limited radix sort of suffixes.

Every window of a fixed number of bytes is a suffix that is sorted no deeper than that. The first digit is taken by
content: the window's rarest-looking gram (the leftmost one of least hash), so neighbouring windows mostly share it and travel as
one run. Spark deals the runs by that digit; a run that meets no other one ends there. The next digits are the
window's bytes in order, eight at a time, compared in the tasks; windows alone in their group drop out after each pass. Groups that
last through all bytes are exactly the repeated windows. Buckets with too many different runs for one task are dealt again by
a longer stretch of bytes, in the end by whole windows, where equal ones are combined on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.shingles import mix
from cohortline.llm.text import map_rows, whole_text
from cohortline.session import bucketed, materialize

WINDOW = 400
PART_BYTES = 1 << 19
PLACE_BITS = 22
MOST_RUNS = 4096
TASK_BYTES = 6_000_000

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def gram_width(window: int) -> int:
    """The bytes of the first digit: about a third of the window, so that runs are long and chance meetings few."""
    return max(1, window * 8 // 25)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _stretch_hashes(running: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((running[ends] - running[starts]) * down[starts])


def _running(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, 1 << max(PART_BYTES.bit_length(), len(data).bit_length()))
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
    return running, down


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row: block-wise least ones from the left and from the right."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def runs_of(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """All windows of texts (together at most half a MB and a window) as runs with one first digit.

    Per run: text, first window's place, windows, bytes from there to the gram, the gram's hash and the whole run's hash.
    """
    gram = gram_width(window)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    length = np.array([len(t) for t in texts])
    first = np.cumsum(length) - length
    number = np.repeat(np.arange(len(texts)), length)
    running, down = _running(data, _BASES[0])
    at = np.arange(len(data) - gram + 1)
    grams = _stretch_hashes(running, down, at, at + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = _sliding_min((grams & ~low) | at.astype(np.uint64), window - gram + 1)
    place = np.flatnonzero(number[: len(data) - window + 1] == number[window - 1 :])
    least = least[place]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(place) != 1) | (np.diff(number[place]) != 0)])) if len(place) else place
    starts, size = place[new], np.diff(np.append(new, len(place)))
    anchor = (least[new] & low).astype(np.int64)
    other, other_down = _running(data, _BASES[1])
    whole = _stretch_hashes(other, other_down, starts, starts + size + window - 1)
    text = number[starts]
    return text, starts - first[text], size, anchor - starts, grams[anchor].view(np.int64), whole.view(np.int64)


def _parts(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """The texts in groups of about half a MB as (text, offset, bytes); a longer text comes in parts that overlap by a window less one."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 1), PART_BYTES):
            part = text[at : at + PART_BYTES + window - 1]
            if group and size + len(part) > PART_BYTES:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def describe(texts: list[bytes], window: int) -> list[dict[str, np.ndarray]]:
    """The runs of each text: arrays ``starts``, ``sizes``, ``ahead``, ``marks`` and ``twins``."""
    found = []
    for group in _parts(texts, window):
        text, start, *rest = runs_of([part for _, _, part in group], window)
        whose, offset = np.array([i for i, _, _ in group]), np.array([at for _, at, _ in group])
        found.append((whose[text], start + offset[text], *rest))
    number, *columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 6
    cuts = np.searchsorted(number, np.arange(1, len(texts)))
    return [dict(zip(("starts", "sizes", "ahead", "marks", "twins"), parts)) for parts in zip(*[np.split(c, cuts) for c in columns])]


def repeated_windows(pieces: list[bytes], bucket: np.ndarray, ahead: np.ndarray, size: np.ndarray, window: int) -> list[np.ndarray]:
    """Which of each piece's windows another window of its bucket equals, by most-significant-digit passes of eight bytes.

    Equal windows have their gram at the same place, so bucket and place of the gram are the first digit. ``bucket`` must not descend.
    """
    data = np.frombuffer(b"".join(pieces) + bytes(8), dtype=np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    length = np.array([len(p) for p in pieces])
    base = np.cumsum(length) - length
    piece = np.repeat(np.arange(len(pieces)), size)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    _, dense = np.unique(bucket, return_inverse=True)
    label = dense[piece] * np.int64(window + 1) + (ahead[piece] - offset)
    order = np.argsort(label, kind="stable")
    where, label = (base[piece] + offset)[order], label[order]

    def settle():
        """The groups' first members and sizes, after those that are alone have gone."""
        nonlocal order, where, label
        first = np.flatnonzero(np.diff(label, prepend=-1))
        count = np.diff(np.append(first, len(label)))
        if (count == 1).any():
            keep = np.repeat(count > 1, count)
            order, where, label = order[keep], where[keep], label[keep]
            count = count[count > 1]
            first = np.cumsum(count) - count
        return first, count

    first, count = settle()
    for depth in range(0, window, 8):
        if not len(where):
            break
        digit = np.ascontiguousarray(eight[where + depth]).view(">u8").ravel().astype(np.uint64)
        digit >>= np.uint64(8 * max(0, depth + 8 - window))
        differs = digit != np.repeat(digit[first], count)
        if differs.any():
            open_ = np.flatnonzero(np.repeat(np.logical_or.reduceat(differs, first), count))
            sorted_ = open_[np.lexsort((digit[open_], label[open_]))]
            order[open_], where[open_], digit[open_] = order[sorted_], where[sorted_], digit[sorted_]
            label = np.cumsum(np.concatenate([[1], (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])]))
            first, count = settle()
    out = np.zeros(len(piece), dtype=bool)
    out[order] = True
    return np.split(out, np.cumsum(size)[:-1])


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _radix(bodies: DataFrame, window: int) -> DataFrame:
    """``bucket``, ``name`` and ``low``, ``high``: the stretches of windows of each piece that repeat in its bucket."""

    def settle(rows: list[tuple]) -> pd.DataFrame:
        bucket, name, ahead, size, piece = (list(c) for c in zip(*rows))
        flags = repeated_windows(piece, np.array(bucket), np.array(ahead), np.array(size), window)
        out = [(bucket[i], name[i], a, b) for i, f in enumerate(flags) if f.any() for a, b in zip(*(x.tolist() for x in _stretches(f)))]
        return pd.DataFrame(out, columns=["bucket", "name", "low", "high"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch[c].tolist() for c in ("bucket", "name", "ahead", "size", "piece"))):
                if size > TASK_BYTES and row[0] != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield settle(held)

    dealt = bodies.select("bucket", "name", "ahead", "size", "piece").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(run, "bucket bigint, name binary, low int, high int")


def _finer(pieces: DataFrame, width: int, window: int) -> DataFrame:
    """Pieces cut into blocks of at most ``width`` windows; a block's bucket is a hash of the bytes that all its windows share."""

    def work(columns):
        values = [columns[c].to_pylist() for c in ("bucket", "ahead", "size", "offset", "piece")]
        places, out = [], {c: [] for c in ("bucket", "ahead", "size", "offset", "piece")}
        for i, (bucket, ahead, size, offset, piece) in enumerate(zip(*values)):
            for block in range((ahead - size + 1) // width, ahead // width + 1):
                low = max(0, ahead - (block + 1) * width + 1)
                high = min(size - 1, ahead - block * width)
                shared = piece[ahead - block * width : ahead - (block + 1) * width + 1 + window]
                code = blake2b(bucket.to_bytes(8, "little", signed=True) + block.to_bytes(4, "little") + shared, digest_size=8).digest()
                places.append(i)
                out["bucket"].append(int.from_bytes(code, "little", signed=True))
                out["ahead"].append(ahead - low)
                out["size"].append(high - low + 1)
                out["offset"].append(offset + low)
                out["piece"].append(piece[low : high + window])
        yield places, out

    cut = map_rows(pieces.drop("name"), ["mark", "twin", "weight"], work, "bucket bigint, ahead int, size int, offset int, piece binary")
    return cut.withColumn("name", F.unhex(F.md5(F.concat(F.col("ahead").cast("string").cast("binary"), "piece"))))


def _repeated_in_buckets(pieces: DataFrame, window: int, most: int) -> DataFrame:
    """``mark``, ``twin``, ``low``, ``high`` for every run with windows that repeat: stretches of its windows.

    Buckets of more than ``most`` different pieces are dealt again by a longer stretch, which ends with single
    windows: then equal pieces are one row, and each bucket holds one.
    """
    found = None
    for width in (None, *[w for w in (64, 8) if 2 * w <= window], 1):
        if width is not None:
            pieces = materialize(_finer(pieces, width, window), "pieces")
        alike = ["bucket", "name", "ahead", "size", "piece"]
        bodies = pieces if width is None else materialize(pieces.groupBy(*alike).agg(F.sum("weight").alias("weight")), "bodies")
        hot = materialize(bodies.groupBy("bucket").count().filter(F.col("count") > most).select("bucket"), "hot")
        cool = bodies.join(hot, "bucket", "left_anti") if width != 1 else bodies
        part = _radix(cool, window)
        if width is not None:
            # A piece that came more than once repeats over its whole length.
            whole = cool.filter("weight > 1").select("bucket", "name", F.lit(0).alias("low"), F.col("size").alias("high"))
            part = part.unionByName(whole)
        part = part.join(pieces.select("bucket", "name", "mark", "twin", "offset"), ["bucket", "name"])
        part = part.select("mark", "twin", (F.col("low") + F.col("offset")).alias("low"), (F.col("high") + F.col("offset")).alias("high"))
        part = materialize(part, "stretches")
        found = part if found is None else found.unionByName(part)
        if width == 1 or hot.isEmpty():
            return found
        pieces = pieces.join(hot, "bucket", "left_semi")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = MOST_RUNS) -> DataFrame:
    """Every row's ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` and ``kept_sha256``.

    Texts are UTF-8 bytes, null is empty. ``spans`` (start, end exclusive, in bytes) cover each byte that lies in a string of
    ``window`` bytes that also starts anywhere else: in another row or the same, overlapping or not; no copy is spared.
    Touching spans are one. ``kept_sha256`` is the SHA-256 of what is left. Rows with the same text repeat each other
    over their whole length; texts shorter than a window have no spans. Keys may be null or repeat and play no part. An empty
    table gives an empty result. Other columns of the input play no part.

    Texts are copied once to the shared folder, in buckets of the input's partitions, and read there twice more without a
    shuffle; what moves between tasks are run hashes (one run per third of a window or so), the bytes around the ends of
    repeated passages and the spans. Only runs' hashes of 64 bits decide whether whole runs are equal; windows are compared byte by byte.
    """
    body = whole_text(text).cast("binary")
    rows = docs.select(F.col(key).alias("key"), body.alias("body")).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.select(
        "key", "body", F.shiftright("__row", 33).cast("int").alias("sender"), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"),
        F.octet_length("body").cast("long").alias("n_bytes"), F.unhex(F.sha2("body", 256)).alias("digest"),
    )
    with bucketed(rows, "sender", "texts") as stored:
        return materialize(_spans(stored, window, most).withColumnRenamed("key", key), "spans")


def _spans(stored: DataFrame, window: int, most: int) -> DataFrame:
    arrays = "starts array<int>, sizes array<int>, ahead array<int>, marks array<bigint>, twins array<bigint>"
    at = ["sender", "seq"]

    def find(columns):
        found = describe(columns["body"].to_pylist(), window)
        yield None, {name: [f[name] for f in found] for name in ("starts", "sizes", "ahead", "marks", "twins")}

    long = stored.filter(F.col("n_bytes") >= window)
    described = materialize(map_rows(long.select(*at, "body"), at, find, arrays), "runs")
    copies = materialize(long.groupBy("digest").agg(F.min(F.struct(*at)).alias("first"), F.count("*").alias("copies")), "copies")

    # One row stands for all with the same text.
    each = described.join(copies.select("first.*", "copies"), at)
    each = each.select(*at, "copies", F.explode(F.arrays_zip("starts", "sizes", "ahead", "marks", "twins")).alias("run"))
    run = {"starts": "start", "sizes": "size", "ahead": "ahead", "marks": "mark", "twins": "twin"}
    each = each.select(*at, "copies", *[F.col(f"run.{old}").alias(new) for old, new in run.items()])
    where = F.min(F.struct(*at, "start", "size", "ahead")).alias("where")
    kinds = materialize(each.groupBy("mark", "twin").agg(F.sum("copies").alias("weight"), where), "kinds")
    met = kinds.groupBy("mark").agg(F.count("*").alias("n"), F.min("weight").alias("least")).filter("n > 1 AND least = 1").select("mark")

    asked = kinds.join(met, "mark").select("where.*", "mark", "twin", "weight")
    asked = asked.groupBy(*at).agg(F.collect_list(F.struct("mark", "twin", "weight", "start", "size", "ahead")).alias("asked"))

    def fetch(columns):
        places, out = [], {c: [] for c in ("mark", "twin", "weight", "ahead", "size", "piece")}
        for i, (data, runs) in enumerate(zip(columns["body"], columns["asked"])):
            data = data.as_py()
            for r in runs.as_py():
                places.append(i)
                for c in ("mark", "twin", "weight", "ahead", "size"):
                    out[c].append(r[c])
                out["piece"].append(data[r["start"] : r["start"] + r["size"] + window - 1])
        yield places, out

    chosen = stored.select(*at, "body").join(asked.hint("shuffle_hash"), at)
    piece = "mark bigint, twin bigint, weight bigint, ahead int, size int, piece binary"
    pieces = map_rows(chosen, at, fetch, piece).drop(*at)
    pieces = pieces.withColumns({"bucket": F.col("mark"), "offset": F.lit(0), "name": F.unhex(F.hex("twin"))})
    pieces = materialize(pieces, "pieces")
    met_windows = _repeated_in_buckets(pieces, window, most)
    whole = kinds.filter("weight > 1").select("mark", "twin", F.lit(0).alias("low"), F.col("where.size").alias("high"))
    stretches = met_windows.unionByName(whole)

    covered = F.struct((F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high") + window - 1).alias("end"))
    listed = each.filter("copies = 1").join(stretches, ["mark", "twin"]).groupBy(*at).agg(F.collect_list(covered).alias("found"))

    def cut(columns):
        out = {c: [] for c in ("n_removed", "spans", "kept")}
        for data, found in zip(columns["body"], columns["found"]):
            data, spans = data.as_py(), []
            for start, end in sorted((s["start"], s["end"]) for s in found.as_py()):
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], end)
                else:
                    spans.append({"start": start, "end": end})
            edges = [0, *[e for s in spans for e in (s["start"], s["end"])], len(data)]
            kept = sha256()
            for a, b in zip(edges[::2], edges[1::2]):
                kept.update(data[a:b])
            out["n_removed"].append(sum(s["end"] - s["start"] for s in spans))
            out["spans"].append(spans)
            out["kept"].append(kept.hexdigest())
        yield None, out

    span = "array<struct<start:int,end:int>>"
    touched = stored.select(*at, "body").join(listed.hint("shuffle_hash"), at)
    touched = materialize(map_rows(touched, at, cut, f"n_removed bigint, spans {span}, kept string"), "touched")
    again = copies.filter("copies > 1").select("digest", F.lit(True).alias("again"))
    light = stored.select(*at, "key", "n_bytes", "digest").join(again, "digest", "left").join(touched, at, "left")
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    spans = F.when(F.col("again"), everything).otherwise(F.coalesce("spans", F.array().cast(span)))
    return light.select(
        "key", "n_bytes", F.when(F.col("again"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"), spans.alias("spans"),
        F.when(F.col("again"), sha256(b"").hexdigest()).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **tuning) -> DataFrame:
    """The rows of ``docs``, each text less its spans; characters that a span cuts in two go as well. Other columns stay as they are."""
    body = whole_text(text)
    marked = repeated_spans(docs.select(F.struct(F.col(key).alias("key"), F.sha2(body, 256).alias("digest")).alias("doc"), body.alias("body")), "doc", "body", **tuning)
    marked = marked.filter("n_spans > 0").groupBy("doc").agg(F.first("spans").alias("__spans"))
    marked = marked.select(F.col("doc.key").alias("__key"), F.col("doc.digest").alias("__digest"), "__spans")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(data, found):
            edges = [0, *[e for s in found for e in (s["start"], s["end"])], len(data)]
            return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")

        return pd.Series([one(t.encode(), s) for t, s in zip(texts, spans)])

    same = F.col(key).eqNullSafe(F.col("__key")) & (F.sha2(body, 256) == F.col("__digest"))
    joined = docs.join(marked, same, "left")
    changed = joined.filter("__spans IS NOT NULL").withColumn(text, rest(body, F.col("__spans")))
    return joined.filter("__spans IS NULL").select(*docs.columns).unionByName(changed.select(*docs.columns))
