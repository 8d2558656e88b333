"""Document quality by hierarchical empirical Bayes: a document classifier, shrunk by its path and host."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.text import map_rows, whole_text, word_array
from cohortline.session import materialize

FIT_ROWS, BINS, BLOCK_WORDS, PLACES = 20_000, 12, 200, 1_000_000
SHAPE = ("letters", "capitals", "symbols", "marks", "digits", "stutter", "variety", "word_length", "line_words")


def add_shape(docs: DataFrame, text: str = "text") -> DataFrame:
    """Shares that describe a text's form, in columns ``s_<name>``; JVM functions over the whole text.

    The variety of words is the mean share of distinct words in consecutive blocks of 200, weighted by their lengths.
    """
    body, words = whole_text(text), F.col("__words")
    size = F.greatest(F.length(body), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))) / size

    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: a == b)
    blocks = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(BLOCK_WORDS))
    distinct = F.aggregate(blocks, F.lit(0), lambda sum_, at: sum_ + F.size(F.array_distinct(F.slice(words, at, F.lit(BLOCK_WORDS)))))
    named = docs.withColumn("__words", word_array(body)).withColumns(
        {
            "s_letters": share(r"\p{L}+"),
            "s_capitals": share(r"\p{Lu}+"),
            "s_symbols": share(r"[#*$%&|<>]+"),
            "s_marks": share(r"[.,;:!?]+"),
            "s_digits": share(r"[0-9]+"),
            "s_stutter": F.size(F.filter(pairs, lambda same: same)) / n,
            "s_variety": distinct / n,
            "s_word_length": F.log1p(F.length(F.array_join(words, "")) / n),
            "s_line_words": F.log1p(n / F.size(F.split(body, "\n"))),
        }
    )
    return named.drop("__words")


class ShapeModel:
    """Logistic regression on one-hot bins of the shape columns; bin edges are quantiles of the fitted rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 500, ridge: float = 1e-3):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.prior = float(np.clip(y.mean(), 0.01, 0.99))
        where, self.weights = self._bins(x), np.zeros(x.shape[1] * BINS + 1)
        mean, square = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, rounds + 1):
            error = (1 / (1 + np.exp(-self._logit(where))) - y) / len(y)
            gradient = ridge * self.weights
            gradient[-1] = error.sum()
            for j in range(where.shape[1]):
                gradient += np.bincount(where[:, j], weights=error, minlength=len(gradient))
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
            self.weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") + j * BINS for j, e in enumerate(self.edges)], axis=1)

    def _logit(self, where: np.ndarray) -> np.ndarray:
        return self.weights[where].sum(axis=1) + self.weights[-1]

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """The log likelihood ratio of good against bad: the logit less the prior of the fitted rows, within +-12."""
        return np.clip(self._logit(self._bins(x)) - np.log(self.prior / (1 - self.prior)), -12, 12)


def fit_shape(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, seed: int = 0) -> ShapeModel | None:
    """Fit on at most about ``fit_rows`` labelled rows (quality 0/1), chosen by a hash of the key; null if there are none."""
    known = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("__key")).agg(F.min("quality").alias("quality"))
    limit = int(min(1.0, fit_rows / max(known.count(), 1)) * PLACES)

    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("string"), F.lit(seed)), F.lit(PLACES))

    # The chosen labels are written first: their small size is known then, and they, not the documents, move in the join.
    chosen = materialize(known.filter(place("__key") < limit), "sample")
    inside = docs.select(F.col(key).alias("__doc"), F.col(text).alias("__body")).filter(place("__doc") < limit)
    joined = inside.join(chosen, F.col("__doc") == F.col("__key"))
    rows = add_shape(joined, "__body").select("quality", *[f"s_{s}" for s in SHAPE]).toPandas()
    if rows["quality"].nunique() < 2:
        return None
    return ShapeModel(rows[[f"s_{s}" for s in SHAPE]].to_numpy(float), rows["quality"].to_numpy(float))


def _concentration(groups: DataFrame, mean: Column, prior: Column) -> float:
    """Pseudo-count of a Beta prior from the spread of group means about ``prior``, beyond what their sizes explain."""
    spread = F.sum(F.col("n") * (mean - prior) ** 2)
    noise = F.sum(F.greatest(F.col("p2") / F.col("n") - mean**2, F.lit(0.0)))
    row = groups.filter("n >= 2").agg(spread.alias("spread"), noise.alias("noise"), F.sum("n").alias("n"), F.avg(prior * (1 - prior)).alias("most")).first()
    if not row["n"]:
        return 10.0
    between = max((row["spread"] - row["noise"]) / row["n"], 1e-6)
    return float(np.clip(row["most"] / between - 1, 1.0, 1e4))


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(inside / (1 - inside))


def score_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Every row's ``key``, ``host``, ``path``, ``p_document``, ``p_host``, ``p_path``, ``p_quality`` and ``kept``.

    ``p_document`` is the classifier's chance under the global prior. A host's posterior mean shrinks the mean chance of
    its documents to the global mean, a path's shrinks its own to its host's; the pseudo-counts are estimated from
    the spread between hosts and between paths, so sparse sites stay near their parent. A document does not count for
    its own site. ``p_quality`` takes the path's posterior as prior for the document's evidence. Null hosts and paths are
    sites named ''. Null text is empty. Equal rows count each. Without labels of both kinds, or without rows, the
    result is empty. All sites are aggregated over all documents; a site of any size is one row after map-side sums.
    """
    model = fit_shape(docs, labels, key, text)
    key_type = docs.schema[key].dataType.simpleString()
    if model is None:
        empty = docs.sparkSession.createDataFrame([], f"`{key}` {key_type}, host string, path string, p_document double, p_host double, p_path double, p_quality double, kept boolean")
        return empty
    names = [f"s_{s}" for s in SHAPE]

    def weigh(columns):
        x = np.column_stack([columns[n].to_numpy(zero_copy_only=False) for n in names]).astype(float)
        yield None, {"evidence": model.evidence(x)}

    shaped = add_shape(docs.select(F.col(key).alias("key"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.col(text).alias("text")))
    prior = float(np.log(model.prior / (1 - model.prior)))
    rows = map_rows(shaped.select("key", "host", "path", *names), ["key", "host", "path"], weigh, "evidence double")
    rows = materialize(rows.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + prior)))), "evidence")

    sums = [F.count("*").alias("n"), F.sum("p").alias("p1"), F.sum(F.col("p") ** 2).alias("p2")]
    paths = materialize(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "p1", "p2")])
    total = hosts.agg(F.sum("n").alias("n"), F.sum("p1").alias("p1")).first()
    middle = total["p1"] / total["n"] if total["n"] else 0.5
    mean = F.col("p1") / F.col("n")
    k_host = _concentration(hosts, mean, F.lit(middle))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("p1").alias("host_p1"))
    shrunk = (F.col("host_p1") + k_host * middle) / (F.col("host_n") + k_host)
    k_path = _concentration(paths.join(hosts, "host"), mean, shrunk)

    joined = rows.join(paths.drop("p2").join(hosts, "host"), ["host", "path"])
    p_host = (F.col("host_p1") - F.col("p") + k_host * middle) / (F.col("host_n") - 1 + k_host)
    p_path = (F.col("p1") - F.col("p") + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path)
    joined = joined.withColumn("p_host", p_host).withColumn("p_path", p_path)
    joined = joined.withColumn("p_quality", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("p_path"))))))
    return joined.select(
        F.col("key").alias(key), "host", "path", F.col("p").alias("p_document"), "p_host", "p_path", "p_quality", (F.col("p_quality") >= least).alias("kept")
    )
