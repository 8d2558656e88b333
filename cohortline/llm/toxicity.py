"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.text import map_rows, whole_text
from cohortline.session import materialize

FIT_ROWS, FEATURES, MIN_DOCS = 2000, 1024, 5
PREFIXES = (4, 5)
SCALE = 50.0
PLACES = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def forms(word: str) -> list[str]:
    """A word as features: itself, and its beginnings (marked by a hyphen), which inflected words share."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) >= n]]


@dataclass(frozen=True)
class Model:
    """``P(grade > k) = sigmoid(w . x - cuts[k])``: one weight per feature, shared by all cuts; cuts ascend."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and cut."""
        return 1 / (1 + np.exp(-(scores[:, None] - self.cuts[None, :])))

    def score(self, text: str) -> float:
        found = words_of(text)
        total = 0.0
        known = self.vocabulary
        for word in found:
            for form in forms(word):
                i = known.get(form)
                if i is not None:
                    total += self.weights[i]
        return SCALE * total / max(len(found), 1)


def fit(rows: list[tuple[list[str], int]], features: int = FEATURES, rounds: int = 300, ridge: float = 2e-4) -> Model:
    """The model for (distinct forms repeated as they occur, grade) rows; grades are 0, 1, ... without gaps.

    Features: the forms in at least five rows that best tell grade 0 from the others (log odds times root of support).
    Full-batch gradient steps (Adam) on the mean negative log likelihood.
    """
    grades = np.array([g for _, g in rows])
    cuts = int(grades.max()) if len(grades) else 1
    support: dict[str, list[int]] = {}
    for found, grade in rows:
        for form in {f for w in found for f in forms(w)}:
            support.setdefault(form, [0, 0])[grade > 0] += 1
    bad, good = max((grades > 0).sum(), 1), max((grades == 0).sum(), 1)

    def strength(form):
        n0, n1 = support[form]
        return abs(np.log((n1 + 0.5) / (bad + 1)) - np.log((n0 + 0.5) / (good + 1))) * np.sqrt(n0 + n1)

    chosen = sorted((f for f, n in support.items() if sum(n) >= MIN_DOCS), key=lambda f: (-strength(f), f))[:features]
    known = {f: i for i, f in enumerate(chosen)}
    at, which, value = [], [], []
    for i, (found, _) in enumerate(rows):
        counts: dict[int, int] = {}
        for form in (f for w in found for f in forms(w)):
            if form in known:
                counts[known[form]] = counts.get(known[form], 0) + 1
        at += [i] * len(counts)
        which += counts
        value += [SCALE * c / max(len(found), 1) for c in counts.values()]
    at, which, value = np.array(at, int), np.array(which, int), np.array(value, float)
    importance = 1 / max(len(rows), 1)

    params = np.concatenate([np.zeros(len(chosen)), [0.0], np.zeros(cuts - 1)])  # weights, first cut, log gaps
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, gaps = params[: len(chosen)], np.exp(params[len(chosen) + 1 :])
        theta = params[len(chosen)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, weights=value * w[which], minlength=len(rows))
        cdf = 1 / (1 + np.exp(-(score[:, None] - theta[None, :])))  # P(grade > k)
        upper = np.concatenate([np.ones((len(rows), 1)), cdf], axis=1)[np.arange(len(rows)), grades]
        lower = np.concatenate([cdf, np.zeros((len(rows), 1))], axis=1)[np.arange(len(rows)), grades]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) * (grades > 0), lower * (1 - lower) * (grades < cuts)
        to_score = -importance * (du - dl) / p
        to_theta = np.zeros(cuts)
        np.add.at(to_theta, np.maximum(grades - 1, 0), importance * du / p)
        np.add.at(to_theta, np.minimum(grades, cuts - 1), -importance * dl / p)
        to_gap = np.cumsum(to_theta[::-1])[::-1]
        gradient = np.concatenate(
            [np.bincount(which, weights=value * to_score[at], minlength=len(chosen)) + ridge * w, [to_gap[0]], to_gap[1:] * gaps]
        )
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        params = params - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    theta = params[len(chosen)] + np.concatenate([[0.0], np.cumsum(np.exp(params[len(chosen) + 1 :]))])
    return Model(known, params[: len(chosen)], theta)


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, seed: int = 0) -> list[tuple[list[str], int]]:
    """At most about ``fit_rows`` labelled rows of each grade, chosen by a hash of the key: (words, grade).

    The bound holds for every size of the tables, so the fit on the driver has a fixed size. Null grades and keys are left out; of several
    grades of one key the highest counts. The chosen labels are written first, so that their small size is known and they,
    not the documents, move in the join; documents outside the sample's range of hashes are not read into it.
    """
    known = labels.filter(F.col(grade).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(grade).cast("int")).alias("__grade"))

    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("string"), F.lit(seed)), F.lit(PLACES))

    limits = {r["__grade"]: int(min(1.0, fit_rows / r["count"]) * PLACES) for r in known.groupBy("__grade").count().collect()}
    chosen = F.lit(False)
    for level, limit in limits.items():
        chosen = chosen | ((F.col("__grade") == level) & (place("__key") < limit))
    sample = materialize(known.filter(chosen), "sample")
    rows = docs.select(F.col(key).alias("__doc"), whole_text(text).alias("__text")).filter(place("__doc") < max(limits.values(), default=0))
    joined = rows.join(sample, F.col("__doc") == F.col("__key")).select("__grade", "__key", "__text")
    return [([sys.intern(w) for w in words_of(r["__text"])], r["__grade"]) for r in sorted(joined.collect(), key=lambda r: (r["__key"], r["__text"]))]


def graded(rows: list[tuple[list[str], int]], levels: int = 3) -> list[tuple[list[str], int]]:
    """Ordered grades for rows that only say toxic or not: toxic ones are cut into ``levels`` equal parts by the share of
    their words with a form that is typical of toxic rows (in 2 % of them, and at least five times as likely as in others)."""
    toxic = [set(f for w in found for f in forms(w)) for found, g in rows if g]
    clean = [set(f for w in found for f in forms(w)) for found, g in rows if not g]
    counts: dict[str, list[int]] = {}
    for side, group in ((0, clean), (1, toxic)):
        for found in group:
            for form in found:
                counts.setdefault(form, [0, 0])[side] += 1
    typical = {f for f, (a, b) in counts.items() if b >= 0.02 * len(toxic) and b * max(len(clean), 1) >= 5 * max(a, 1) * max(len(toxic), 1)}

    def share(found):
        return sum(any(f in typical for f in forms(w)) for w in found) / max(len(found), 1)

    cuts = np.quantile([share(found) for found, g in rows if g] or [0.0], [i / levels for i in range(1, levels)])
    return [(found, int(1 + np.searchsorted(cuts, share(found), side="left")) if g else 0) for found, g in rows]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Every row's ``key`` with ``severity`` (expected grade), ``grade`` (most probable) and ``toxic`` (P(grade > 0) >= ``least``).

    Whole texts are read; null is empty. A text without known features gets the grade of the cuts alone. Equal rows give equal
    results. An empty table gives an empty result.
    """

    def score(columns):
        above = model.above(np.array([model.score(t.as_py()) for t in columns["text"]]).reshape(-1))
        chance = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
        yield None, {"severity": above.sum(axis=1), "grade": chance.argmax(axis=1), "toxic": above[:, 0] >= least}

    slim = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_rows(slim, ["key"], score, "severity double, grade int, toxic boolean").withColumnRenamed("key", key)


def grade_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, seed: int = 0) -> DataFrame:
    """Fit on ``labels`` (key, toxic 0/1) and grade all of ``docs`` as :func:`predict` does; without labels of both kinds the result is empty.

    Labels without a document, null labels and null keys play no part; of several labels of one key toxic counts. Rows of ``docs`` that repeat
    a key are graded each by its own text. Null text is empty; an empty table gives an empty result. Other columns play no part.
    """
    rows = graded(labelled_sample(docs, labels, "toxic", key, text, fit_rows, seed))
    if not any(g for _, g in rows) or all(g for _, g in rows):
        return predict(docs.limit(0), Model({}, np.zeros(0), np.zeros(1)), key, text)
    return predict(docs, fit(rows), key, text)
