"""Passages that repeat across documents: near-equal paragraphs by MinHash and components, extended to equal runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm import shingles as sh
from cohortline.llm.components import cluster
from cohortline.llm.text import map_rows, whole_text
from cohortline.session import materialize, shuffles_freed, temporary

MIN_WORDS, SIMILARITY, ROWS, RECALL = 20, 0.8, 4, 0.9999
CUT, SLICES, PLACE_BITS = 32, 2, 30
_DIGEST = np.array([0x9FB21C651E98DF25, 0xB492B66FBE98F273], dtype=np.uint64)


def word_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes at which each word starts and ends."""
    word = np.concatenate([[False], ~sh._space(data), [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def cut_words(word: np.ndarray, reach: int) -> np.ndarray:
    """Whether a cut comes before each word: its run of three words has the least hash of all up to ``reach`` words away.

    That depends on the words around it alone, so a passage is cut alike wherever it lies. Cuts are more than ``reach``
    words apart, about twice as many on average.
    """
    n, most = len(word), np.uint64(2**64 - 1)
    padded = np.concatenate([word, np.zeros(2, dtype=np.uint64)])
    gram = sh.mix((padded[:n] * _DIGEST[0] + padded[1 : n + 1]) * _DIGEST[0] + padded[2:])
    edge = np.full(reach, most)
    least, width = np.concatenate([edge, gram, edge]), 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (gram < least[:n]) & (gram <= least[reach + 1 : reach + 1 + n])


def paragraphs(text: bytes, word: np.ndarray, reach: int) -> np.ndarray:
    """Start and end (code points) and number of words of each paragraph of a text with these word hashes.

    A paragraph is a line with a word, from its first word to its last. Lines of over four times ``reach`` words are cut by their content.
    """
    return all_paragraphs([text], np.zeros(len(word), dtype=np.int64), word, reach)[:, 1:]


def all_paragraphs(texts: list[bytes], number: np.ndarray, word: np.ndarray, reach: int) -> np.ndarray:
    """The :func:`paragraphs` of several texts, each after its text's number; ``number`` and ``word`` are those of their words."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts, ends = word_bytes(data)
    if not len(starts):
        return np.zeros((0, 4), dtype=np.int64)
    heads = np.unique(np.append(0, np.searchsorted(starts, np.flatnonzero(data == 10))))
    heads = heads[heads < len(starts)]
    sizes = np.diff(np.append(heads, len(starts)))
    inside = np.repeat(sizes > 4 * reach, sizes)
    if inside.any():
        bounds = np.searchsorted(number, np.arange(len(texts) + 1))
        cut = np.zeros(len(word), dtype=bool)
        for i in np.unique(number[inside]):
            cut[bounds[i] : bounds[i + 1]] = cut_words(word[bounds[i] : bounds[i + 1]], reach)
        heads = np.union1d(heads, np.flatnonzero(inside & cut))
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    letters = lambda place: place - np.searchsorted(inner, place)
    sizes = np.array([len(t) + 1 for t in texts])
    of = number[heads]
    before = letters(np.cumsum(sizes) - sizes)[of]
    after = np.append(heads[1:], len(starts))
    return np.column_stack([of, letters(starts[heads]) - before, letters(ends[after - 1]) - before, after - heads])


def describe(word: np.ndarray, heads: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit digest of the word sequence and the band keys of each paragraph, from its first word, their number and the hashes of all words."""
    digests, keys = [np.zeros(0, dtype=np.uint64)], [np.zeros((0, bands), dtype=np.int64)]
    for at in range(0, len(heads), sh.BATCH_TEXTS):
        count = sizes[at : at + sh.BATCH_TEXTS]
        starts = np.cumsum(count) - count
        number = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(number)) - starts[number]
        own = word[heads[at : at + sh.BATCH_TEXTS][number] + place]
        digests.append(np.add.reduceat(sh.mix(own * _DIGEST[0] + place.astype(np.uint64) * _DIGEST[1]), starts))
        of, element, _ = sh.shingles([b""] * len(count), known=(number, own))
        keys.append(sh.band_keys(sh.minhash(of, element, len(count), bands * rows), bands))
    return np.concatenate(digests).view(np.int64), np.concatenate(keys)


def elements(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each paragraph's distinct five-word shingles, ascending, all of weight 1."""
    out = []
    for _, group in sh.batches(texts):
        number, element, _ = sh.shingles(group)
        cuts = np.searchsorted(number, np.arange(len(group) + 1))
        out += [(element[i:j], np.ones(j - i)) for i, j in zip(cuts[:-1], cuts[1:])]
    return out


def similar(similarity: float):
    """Whether the shingles of two paragraphs have at least this Jaccard similarity."""
    return lambda x, y: sh.set_jaccard(x[0], y[0]) >= similarity


def word_runs(number: np.ndarray, word: np.ndarray, texts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every run of ``width`` words: text number, place of its first word, digest, and place and hash of its anchor.

    The anchor is the half run with the least hash in the run, the leftmost of equal ones. It depends on the run's
    words alone, so equal runs have equal anchors wherever they lie, and neighbouring runs mostly share one.
    """
    half, n = (width + 1) // 2, len(word) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    part = np.zeros(len(word) - half + 1, dtype=np.uint64)
    for j in range(half):
        part += word[j : j + len(part)]
        part *= _DIGEST[0]
    part = sh.mix(part)
    digest = sh.mix(part[:n] * _DIGEST[0] + part[width - half : width - half + n] * _DIGEST[1])
    least, at, reach = part, np.arange(len(part)), 1
    while reach < width - half + 1:
        step = min(reach, width - half + 1 - reach)
        at = np.where(least[step:] < least[:-step], at[step:], at[:-step])
        least, reach = part[at], reach + step
    inside = np.flatnonzero(number[:n] == number[width - 1 :])
    count = np.bincount(number, minlength=texts)
    before = (np.cumsum(count) - count)[number[inside]]
    return number[inside], inside - before, digest[inside].view(np.int64), at[inside] - before, least[inside].view(np.int64)


def anchors(number: np.ndarray, word: np.ndarray, texts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct anchors the runs of each text have, and the places and hashes of these."""
    number, _, _, place, anchor = word_runs(number, word, texts, width)
    new = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
    return np.bincount(number[new], minlength=texts), place[new].astype(np.int32), anchor[new]


def lists(values, sizes: np.ndarray) -> pa.ListArray:
    """Values as lists of these sizes, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The code points at which each word starts and ends."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_bytes(data)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return letters[starts], letters[ends]


def paragraph_table(docs: DataFrame, bands: int, rows: int, min_words: int, key: str, text: str) -> DataFrame:
    """One row per document: ``key``, ``mark`` (hash of the text), ``n_paragraphs``, its long paragraphs with bands and its anchors."""

    def split(columns):
        texts = columns["text"].to_pylist()
        for at, group in sh.batches(texts):
            number, word = sh.words(group)
            found = all_paragraphs(group, number, word, CUT)
            count = np.bincount(found[:, 0], minlength=len(group))
            place = np.arange(len(found)) - (np.cumsum(count) - count)[found[:, 0]]
            heads = np.cumsum(found[:, 3]) - found[:, 3]  # every word lies in one paragraph
            long = found[:, 3] >= min_words
            items, place = found[long], place[long]
            digests, keys = describe(word, heads[long], items[:, 3], bands, rows)
            columns = [place.astype(np.int32), items[:, 1].astype(np.int32), items[:, 2].astype(np.int32), digests, lists(keys.ravel(), np.full(len(keys), bands))]
            names = ["place", "start", "end", "digest", "bands"]
            parts = lists(pa.StructArray.from_arrays([pa.array(c) for c in columns], names), np.bincount(items[:, 0], minlength=len(group)))
            kept, places, hashes = anchors(number, word, len(group), min_words)
            yield range(at, at + len(group)), {"n_paragraphs": count, "parts": parts, "places": lists(places, kept), "anchors": lists(hashes, kept)}

    body = whole_text(text)
    made = "n_paragraphs bigint, parts array<struct<place:int,start:int,end:int,digest:bigint,bands:array<bigint>>>, places array<int>, anchors array<bigint>"
    return map_rows(docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("mark"), body.alias("text")), ["key", "mark"], split, made)


def line_spans(stored: DataFrame, slim: DataFrame, similarity: float) -> DataFrame:
    """``key``, ``mark`` and ``lines`` (start, end, exact: an equal one comes before): the paragraphs to remove, of documents that have any."""
    found = stored.select("key", "mark", F.explode("parts").alias("part")).select("key", "mark", "part.*")
    where = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), "mark", "place", "start", "end")
    with temporary(found.groupBy("digest").agg(F.min(where).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "first") as first:

        def fetch(ids: DataFrame) -> DataFrame:
            wanted = first.join(ids, first["digest"] == ids["id"]).select("id", "first.key", "first.mark", "first.start", "first.end")
            wanted = wanted.groupBy("key", "mark").agg(F.collect_list(F.struct("id", "start", "end")).alias("wanted"))
            same = slim["key"].eqNullSafe(wanted["key"]) & (slim["mark"] == wanted["mark"])

            def pull(batches):
                for batch in batches:
                    out = []
                    for text_, asked in zip(batch["text"].tolist(), batch["wanted"].tolist()):
                        out += [(w["id"], text_[w["start"] : w["end"]]) for w in asked]
                    yield pd.DataFrame(out, columns=["id", "body"])

            pulled = slim.join(wanted, same).select("text", "wanted").mapInPandas(pull, "id bigint, body string")
            return pulled.groupBy("id").agg(F.first("body").alias("body"))

        items = first.select(F.col("digest").alias("id"), "bands")
        parts = materialize(cluster(items, fetch, elements, similar(similarity), similarity, SLICES, unique=True), "parts")
        groups = first.join(parts, first["digest"] == parts["id"], "left").withColumn("component", F.coalesce("component", "digest"))
        groups = groups.select("digest", "first", "copies", "component")
        keepers = groups.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("copies").alias("members")).filter("members > 1")
        doomed = groups.join(keepers, "component").select("digest", "first", "keeper")

        def at(place: str) -> Column:
            return F.col("key").eqNullSafe(F.col(f"{place}.key")) & (F.col("mark") == F.col(f"{place}.mark")) & (F.col("place") == F.col(f"{place}.place"))

        gone = found.drop("bands").join(doomed, "digest").filter(~at("keeper"))
        listed = F.sort_array(F.collect_set(F.struct("start", "end", (~at("first")).alias("exact"))))
        return materialize(gone.groupBy("key", "mark").agg(listed.alias("lines")), "lines")


def repeated(points: DataFrame) -> DataFrame:
    """The points (key, mark, at, anchor) whose anchor comes more than once, without it: one shuffle and sort, each row beside its neighbours."""

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row of a batch may have its like in the next one; it alone is held.
        last, equal = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, rows = batch.column("anchor").to_numpy(), batch.select(["key", "mark", "at"])
            first = last is not None and last[1] == anchor[0]
            if equal or first:
                yield last[0]
            same = np.concatenate([[first], anchor[1:] == anchor[:-1]])
            yield rows.slice(0, len(anchor) - 1).filter(pa.array(same[:-1] | same[1:]))
            last, equal = (rows.slice(len(anchor) - 1), anchor[-1]), bool(same[-1])
        if equal:
            yield last[0]

    dealt = points.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(twice, points.drop("anchor").schema)


def asked_places(stored: DataFrame, lines: DataFrame) -> DataFrame:
    """``key``, ``mark``, ``places`` of the anchors that occur twice, and ``lines``, of documents with any such anchor."""
    points = stored.select("key", "mark", F.explode(F.arrays_zip("places", "anchors")).alias("a")).select("key", "mark", F.col("a.places").alias("at"), F.col("a.anchors").alias("anchor"))
    places = repeated(points).groupBy("key", "mark").agg(F.collect_set("at").alias("places"))
    same = F.col("p.key").eqNullSafe(F.col("l.key")) & (F.col("p.mark") == F.col("l.mark"))
    return places.alias("p").join(lines.alias("l"), same, "left").select("p.key", "p.mark", "places", "lines")


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with ``doc``, their number in order of key (nulls last) and mark, which no two share."""
    ordered = docs.orderBy(F.col("key").isNull(), "key", "mark").withColumn("__id", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered")
    part, row = F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part).count()
    # One row per range here, not per document.
    starts = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__start"))
    placed = ordered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn("doc", F.col("__start") + row).drop("__id", "__part", "__start")


def run_spans(asked: DataFrame, slim: DataFrame, width: int) -> DataFrame:
    """``key``, ``mark`` and ``runs`` (start << 32 | end, unmerged): runs of ``width`` words that came before.

    Equal runs have equal anchors, so only runs with an anchor that occurs twice are compared, by digest and with the
    first of their kind alone. Where a run overlaps the first one of its kind, that one's words stay. Runs inside a
    paragraph that equals an earlier one are left out: they go with it and are the first of no kind.
    """

    def compare(columns):
        asked_of = list(zip(columns["places"].to_pylist(), columns["lines"].to_pylist()))
        for first, group in sh.batches(columns["text"].to_pylist()):
            out = []
            number, place, digest, at, _ = word_runs(*sh.words(group), len(group), width)
            bounds = np.searchsorted(number, np.arange(len(group) + 1))
            for i, text in enumerate(group):
                (places, spans), mine = asked_of[first + i], slice(bounds[i], bounds[i + 1])
                starts, ends = word_edges(text)
                p, wanted, going = place[mine], np.zeros(len(starts), dtype=bool), np.zeros(len(starts), dtype=bool)
                wanted[np.asarray(places, dtype=np.int64)] = True
                for span in spans or ():
                    low, high = np.searchsorted(starts, [span["start"], span["end"]])
                    if span["exact"]:
                        going[low : high - width + 1] = True
                use = wanted[at[mine]] & ~going[p]
                p, after = p[use], np.append(starts, ends[-1:])
                out.append((np.full(len(p), first + i), p, starts[p], ends[p + width - 1], after[p + width], digest[mine][use]))
            of, *found = [np.concatenate(c) for c in zip(*out)]
            yield of, dict(zip(["place", "start", "end", "next", "digest"], found))

    asked = materialize(numbered(asked), "asked")
    same = F.col("s.key").eqNullSafe(F.col("q.key")) & (F.col("s.mark") == F.col("q.mark"))
    wanted = slim.alias("s").join(asked.alias("q"), same).select("doc", "text", "places", "lines")
    made = "place int, start int, end int, next int, digest bigint"
    # Place and document as one number; a text has less than 2^31 bytes and so at most 2^30 words.
    at = F.shiftleft("doc", PLACE_BITS).bitwiseOR(F.col("place").cast("long"))

    def later(batches):
        """Of the runs by digest and place all but the first of their kind, which alone is held from batch to batch."""
        kind = first = after = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            digest, at, start, end, next_ = (batch.column(c).to_numpy().astype(np.int64) for c in ("digest", "at", "start", "end", "next"))
            head = np.diff(np.append(kind, digest)) != 0 if len(kind) else np.append(True, np.diff(digest) != 0)
            of = np.cumsum(head) - (0 if len(kind) else 1)
            first, after = np.append(first, at[head])[of], np.append(after, next_[head])[of]
            start = np.where(at >> PLACE_BITS == first >> PLACE_BITS, np.maximum(start, after), start)
            gone = np.flatnonzero(at != first)
            yield pa.RecordBatch.from_arrays([pa.array((at >> PLACE_BITS)[gone]), pa.array((start << 32 | end)[gone])], names=["doc", "run"])
            kind, first, after = digest[-1:], first[-1:], after[-1:]

    with temporary(map_rows(wanted, ["doc"], compare, made), "runs") as runs:
        dealt = runs.select("digest", at.alias("at"), "start", "end", "next").repartition("digest").sortWithinPartitions("digest", "at")
        found = dealt.mapInArrow(later, "doc bigint, run bigint").repartition("doc")
        found = materialize(found.groupBy("doc").agg(F.collect_list("run").alias("runs")), "later")
    return found.join(asked.select("doc", "key", "mark"), "doc").drop("doc")


def merged(columns: dict) -> Iterator[tuple]:
    """The ``spans`` of each row: those of ``lines`` and ``runs``, ascending, overlapping ones as one."""
    rows = len(columns["lines"])
    row = []
    for listed in (columns["lines"], columns["runs"]):
        row.append(np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)))
    flat, runs = columns["lines"].flatten(), columns["runs"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = [pc.struct_field(flat, "start").to_numpy(zero_copy_only=False).astype(np.int64), runs >> 32]
    end = [pc.struct_field(flat, "end").to_numpy(zero_copy_only=False).astype(np.int64), runs & 0xFFFFFFFF]
    row, start, end = np.concatenate(row), np.concatenate(start), np.concatenate(end)
    order = np.lexsort((start, row))
    base = row[order] << 32
    reached = np.maximum.accumulate(base + end[order])
    heads = np.flatnonzero(base + start[order] >= np.concatenate([[-1], reached[:-1]]))
    last = np.append(heads[1:], len(order))[: len(heads)] - 1
    spans = [[] for _ in range(rows)]
    for i, a, b in zip(row[order][heads].tolist(), start[order][heads].tolist(), (reached[last] - base[last]).tolist()):
        spans[i].append({"start": a, "end": b})
    yield None, {"spans": spans}


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, rows: int = ROWS, min_words: int = MIN_WORDS
) -> DataFrame:
    """Every row's ``key``, ``mark``, ``n_paragraphs``, ``n_removed`` and ``spans`` (start, end) to remove.

    Paragraphs are lines, long ones cut by their content (:func:`paragraphs`). Those of at least ``min_words`` words (20) are items: equal word sequences
    (64-bit digest) are one, others are linked if the Jaccard similarity of their five-word shingles is at least 0.8.
    Of each connected component the first paragraph (by key, nulls last, then
    mark and place) stays and all others go, in other documents or the same. Bands are
    tuned to miss a pair at the limit with probability 1e-4. Matches are then extended to the full length of common
    passages: of all equal runs of ``min_words`` words the first stays and the words of all others go, wherever they lie
    in paragraphs and however the lines are broken. Both are judged on the input; whatever goes has an equal or linked one that
    comes before it, so of each kind one stays. Spans count code points, end exclusive,
    and start and end at words. Null text is empty. Rows equal in key and text are one document: they keep and lose the same. An empty table gives an empty result.
    """
    bands = sh.tune_bands(similarity, RECALL, rows)
    body = whole_text(text)
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("mark"), body.alias("text"))
    with shuffles_freed(docs.sparkSession):
        with temporary(paragraph_table(docs, bands, rows, min_words, key, text), "paragraphs") as stored:
            every = materialize(stored.select("key", "mark", "n_paragraphs"), "documents")
            lines = line_spans(stored, slim, similarity)
            asked = materialize(asked_places(stored, lines), "asked")
        runs = run_spans(asked, slim, min_words)

    def same(other: str) -> Column:
        return F.col("d.key").eqNullSafe(F.col(f"{other}.key")) & (F.col("d.mark") == F.col(f"{other}.mark"))

    joined = every.alias("d").join(lines.alias("l"), same("l"), "left").join(runs.alias("r"), same("r"), "left")
    joined = joined.select(F.col("d.key").alias(key), "d.mark", "n_paragraphs", "lines", "runs")
    marked = map_rows(joined, [key, "mark", "n_paragraphs"], merged, "spans array<struct<start:int,end:int>>")
    return marked.select(key, "mark", "n_paragraphs", F.size("spans").cast("long").alias("n_removed"), "spans")


def spans_text(spans) -> Column:
    """start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **tuning) -> DataFrame:
    """The rows of ``docs`` with their texts less the spans that :func:`repeated_spans` marks; other columns as they were."""
    marked = repeated_spans(docs, key, text, **tuning).filter("n_removed > 0").select(F.col(key).alias("__key"), F.col("mark").alias("__mark"), "spans")
    marked = marked.groupBy("__key", "__mark").agg(F.first("spans").alias("__spans"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(whole_text(text)) == F.col("__mark"))

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, spans: pd.Series) -> pd.Series:
        def one(body, out):
            pieces, at = [], 0
            for s in out:
                pieces.append(body[at : s["start"]])
                at = min(s["end"] + 1, len(body))
            return "".join(pieces) + body[at:]

        return pd.Series([one(b, s) for b, s in zip(bodies, spans)])

    joined = docs.join(marked, same, "left")
    changed = joined.filter("__spans IS NOT NULL").withColumn(text, cut(whole_text(text), F.col("__spans")))
    return joined.filter("__spans IS NULL").select(*docs.columns).unionByName(changed.select(*docs.columns))
