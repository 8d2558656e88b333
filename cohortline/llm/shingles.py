"""Word shingles of many texts at once, as sorted hashes, and MinHash signatures over them (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
BATCH_BYTES = 2_000_000
BATCH_TEXTS = 4096
HASH_BITS = 52

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_tables = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of the base and of its inverse; a worker keeps the longest tables it was asked for."""
    global _tables
    if len(_tables[0]) < size:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word, from differences of one running polynomial over all bytes."""
    word = np.concatenate([[False], ~_space(data), [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << int(len(data) + 1).bit_length())
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts]), starts


def _cut_long(text: bytes) -> list[bytes]:
    """A long text in parts of about a batch, cut at white space, so that tables stay small."""
    parts, at = [], 0
    while len(text) - at > BATCH_BYTES:
        cut = max(text.rfind(c, at, at + BATCH_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [c for c in (text.find(c, at + BATCH_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if c > 0]
            cut = min(found) if found else len(text)
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text number and hash of every word of the texts, in order."""
    numbers, hashes, group, numbers_in, size = [], [], [], [], 0

    def flush():
        if group:
            data = np.frombuffer(b" ".join(group), dtype=np.uint8)
            found, starts = _word_hashes(data)
            first = np.cumsum([0] + [len(p) + 1 for p in group[:-1]])
            numbers.append(np.array(numbers_in)[np.searchsorted(first, starts, side="right") - 1])
            hashes.append(found)
            group.clear()
            numbers_in.clear()

    for i, text in enumerate(texts):
        for part in _cut_long(text):
            if size + len(part) > BATCH_BYTES:
                flush()
                size = 0
            group.append(part)
            numbers_in.append(i)
            size += len(part)
    flush()
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(numbers).astype(np.int64), np.concatenate(hashes)


def shingles(texts: list[bytes], width: int = SHINGLE, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 52-bit hash and count of each distinct shingle, ascending by text and hash.

    A text of fewer words than ``width`` has one shingle of all its words; one without words has none. At most 4096 texts. ``known``: what :func:`words` found in them.
    """
    number, word = words(texts) if known is None else known
    if not len(word):
        return number, word, number
    per_text = np.bincount(number, minlength=len(texts))
    summed = np.zeros(len(word), dtype=np.uint64)
    for j in range(width):
        ahead = word[j:]
        same = number[j:] == number[: len(ahead)]
        summed[: len(ahead)] += np.where(same, ahead * _MULTIPLIERS[j], np.uint64(0))
    first = np.cumsum(per_text) - per_text
    place = np.arange(len(word)) - first[number]
    used = place < np.maximum(per_text[number] - (width - 1), 1)
    key = (number[used].astype(np.uint64) << np.uint64(HASH_BITS)) | (mix(summed[used]) >> np.uint64(64 - HASH_BITS))
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), counts


def batches(texts: list[str], most: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes in groups of at most ``most`` bytes (a longer text alone), each with the number of its first text."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace")
        if group and (size + len(data) > most or len(group) == BATCH_TEXTS):
            yield first, group
            group, size, first = [], 0, i
        group.append(data)
        size += len(data)
    if group:
        yield first, group


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of each signature (rows: texts)."""
    texts, hashes = signature.shape
    rows = signature.reshape(texts, bands, hashes // bands)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _MULTIPLIERS[0], (texts, bands)).copy()
    for j in range(rows.shape[2]):
        key = mix(key + rows[:, :, j] * _MULTIPLIERS[j % 5] + np.uint64(j))
    return key.view(np.int64)


def prob_minhash(number: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, hashes: int) -> np.ndarray:
    """ProbMinHash signatures: row i holds, for each register, the element of text i whose arrival there came first.

    Each element has a Poisson process with a rate equal to its weight, seeded by the element alone; each arrival
    goes to a random register, which keeps the earliest. An element stops as soon as its next arrival is later than
    every register of its text. Two registers agree with the probability Jaccard similarity of the weighted sets.
    """
    first = np.full(texts * hashes, np.inf)
    owner = np.zeros(texts * hashes, dtype=np.uint64)
    limit = np.full(texts, np.inf)
    at, time, step = np.arange(len(element)), np.zeros(len(element)), 0
    while len(at):
        block = 1 if step < 2 else int(np.clip(200_000 // len(at), 1, 64))
        seed = element[at][:, None] * _MULTIPLIERS[1] + (np.arange(step, step + block, dtype=np.uint64) * _BASE)[None, :]
        drawn = mix(seed)
        gaps = -np.log(((drawn >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight[at][:, None]
        arrivals = time[:, None] + np.cumsum(gaps, axis=1)
        register = (mix(drawn ^ _MULTIPLIERS[2]) >> np.uint64(33)) % np.uint64(hashes)
        text = number[at]
        alive = arrivals < limit[text][:, None]
        slot = (text[:, None] * hashes + register.astype(np.int64))[alive]
        came = arrivals[alive]
        np.minimum.at(first, slot, came)
        won = first[slot] == came
        owner[slot[won]] = np.broadcast_to(element[at][:, None], alive.shape)[alive][won]
        touched = np.unique(text)
        limit[touched] = first.reshape(texts, hashes)[touched].max(axis=1)
        time = arrivals[:, -1]
        going = time < limit[text]
        at, time, step = at[going], time[going], step + block
    return owner.reshape(texts, hashes)


def minhash(number: np.ndarray, element: np.ndarray, texts: int, hashes: int) -> np.ndarray:
    """MinHash signatures of sets: the least value of each of ``hashes`` hash functions of the elements' low 32 bits."""
    signature = np.zeros((hashes, texts), dtype=np.uint64)
    if not len(number):
        return signature.T
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    owners, low = number[starts], element.astype(np.uint32)
    hashed = np.empty_like(low)
    salts = mix(np.arange(1, hashes + 1, dtype=np.uint64) * _BASE)
    for j in range(hashes):
        np.bitwise_xor(low, salts[j].astype(np.uint32), out=hashed)
        np.multiply(hashed, (salts[hashes - 1 - j] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), out=hashed)
        signature[j, owners] = np.minimum.reduceat(hashed, starts)
    return signature.T


def tune_bands(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` that finds a pair of this similarity with at least this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def set_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays of distinct hashes; 1 if both are empty."""
    common = np.intersect1d(a, b, assume_unique=True).size
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets given by ascending distinct hashes."""
    both = np.union1d(a, b)
    if not len(both):
        return 1.0
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a)], y[np.searchsorted(both, b)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    left = np.searchsorted(ratio, ratio, side="left")
    x_from = np.append(np.cumsum(x[::-1])[::-1], 0.0)[left]
    y_before = np.concatenate([[0.0], np.cumsum(y)])[left]
    shared = (x > 0) & (y > 0)
    return float((x[shared] / (x_from[shared] + ratio[shared] * y_before[shared])).sum())
