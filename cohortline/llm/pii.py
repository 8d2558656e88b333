"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.text import map_rows, whole_text
from cohortline.session import materialize

# Kinds in the order used for ties, then the vocabulary of the labelers.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
SECRET_NAMES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "AIza")
MAIL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "example.com", "example.org", "example.net")
FOR_WORDS = ("call", "phone", "tel", "mobile", "fax", "mail", "email", "e-mail", "contact", "write", "card", "visa", "credit", "ip", "address", "host", "server", "login", "user")
AGAINST_WORDS = ("version", "v", "release", "chapter", "section", "figure", "build", "update", "isbn", "page")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
# Anchored before a digit run and without steps back, so that long runs cost no more than their length.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NAMED = re.compile(r"(?i)\b(" + "|".join(SECRET_NAMES) + r")\s*[=:]\s*[\"']?([^\s\"']{6,})")
RANDOM = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}")
_DIGIT = re.compile(r"[0-9]")

LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the four base kinds: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = []
    at, read = text.find("@"), 0
    while at >= 0:
        # Every e-mail begins in the run of name characters before an @, and no earlier than the last one ended.
        start = at
        while start > read and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m and m.group(1):
            out.append((m.start(), m.end(), "email"))
            read = m.end()
        at = text.find("@", max(at + 1, read))
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def extra_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates for credentials: named values and long strings that mix letters and digits."""
    if not _DIGIT.search(text) and "=" not in text and ":" not in text:
        return []
    found = {m.span(2) for m in NAMED.finditer(text)}
    for m in RANDOM.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in found):
            found.add(m.span())
    return sorted((a, b, "secret") for a, b in found)


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else 0 if no else 2


def votes(text: str, start: int, end: int, kind: str, base: bool) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 personal, 0 not, 2 abstains."""
    body, before = text[start:end], text[max(0, start - 32) : start]
    words = re.findall(r"[A-Za-z_-]+", before.lower())
    last = words[-1] if words else ""
    digits = sum(c.isdigit() for c in body)
    letters = sum(c.isalpha() for c in body)
    named = NAMED.search(text, max(0, start - 32), end)
    if kind == "secret":
        checksum = _vote(False, False)
        gazetteer = _vote(body.startswith(KEY_PREFIXES), False)
        shape = _vote(len(body) >= 16 and digits >= 3 and letters >= 3, digits == 0 or letters == 0)
        pattern = _vote(bool(named) or body.startswith(KEY_PREFIXES) or bool(re.fullmatch("[0-9a-f]{16,}", body)), False)
    else:
        checksum = _vote(kind == "card" and base, kind == "ip" and body.startswith("0"))
        gazetteer = _vote(kind == "email" and body.lower().endswith(MAIL_DOMAINS), kind == "ip" and body in ("0.0.0.0", "127.0.0.1", "255.255.255.255"))
        shape = _vote(kind == "card" and digits == 16 or kind == "phone" and 10 <= digits <= 13, kind == "ip" and digits < 6)
        pattern = _vote(base, not base)
    context = _vote(last in FOR_WORDS or bool(named), last in AGAINST_WORDS)
    return pattern, checksum, gazetteer, context, shape


def features(text: str, start: int, end: int, kind: str) -> list[int]:
    """Small whole numbers that describe a span: kind, length, share of digits, characters around it."""
    body = text[start:end]
    length, digits = len(body), sum(c.isdigit() for c in body)
    left, right = text[start - 1 : start], text[end : end + 1]
    return [
        KINDS.index(kind),
        min(length.bit_length(), 7),
        digits * 4 // length,
        (left.isspace() or not left) * 2 + (right.isspace() or not right),
        1 if left in ("=", ":", '"', "'") and left else 0,
        1 if body.isascii() and body.lower() == body else 0,
    ]


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document with its candidate spans: start, end, kind, base, votes and features as one number each."""

    def find(columns):
        texts = columns["text"]
        for first in range(0, len(texts), 1024):
            rows = []
            for body in texts[first : first + 1024].to_pylist():
                spans = [(s, True) for s in base_spans(body)]
                taken = [s for s, _ in spans]
                spans += [(s, False) for s in extra_spans(body) if not any(a < s[1] and s[0] < b for a, b, _ in taken)]
                row = []
                for (start, end, kind), base in spans:
                    vote = 0
                    for v in votes(body, start, end, kind, base):
                        vote = vote * 3 + v
                    described = 0
                    for f in features(body, start, end, kind):
                        described = described * 8 + f
                    row.append({"start": start, "end": end, "kind": kind, "base": base, "vote": vote, "described": described})
                rows.append(row)
            yield range(first, first + len(rows)), {"spans": rows}

    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    return map_rows(rows, ["key"], find, "spans array<struct<start:int,end:int,kind:string,base:boolean,vote:int,described:int>>")


def unpack(code: int, base: int, width: int) -> list[int]:
    return [code // base**i % base for i in range(width - 1, -1, -1)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior that a span with each vote pattern is personal, and each labeler's chance of a right vote.

    The one-coin model: a labeler that does not abstain is right with its own chance, for either class; the prior is
    estimated too. Chances start at 0.8 and are smoothed by two right and one wrong vote.
    """
    right, prior = np.full(patterns.shape[1], 0.8), 0.5
    yes, no = patterns == 1, patterns == 0
    posterior = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior)) + (yes * 1.0 - no * 1.0) @ np.log(right / (1 - right))
        posterior = 1 / (1 + np.exp(-logit))
        weight = counts[:, None] * (yes | no)
        agree = (weight * np.where(yes, posterior[:, None], 1 - posterior[:, None])).sum(axis=0)
        right = np.clip((agree + 2) / (weight.sum(axis=0) + 3), 0.05, 0.995)
        prior = float(np.clip((counts @ posterior + 1) / (counts.sum() + 2), 0.01, 0.99))
    return posterior, right


def fit_classifier(described: np.ndarray, positive: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression of soft labels on one-hot features (rows: distinct descriptions), by gradient steps with decay."""
    x, weight = one_hot(described), np.zeros(described.shape[1] * 8 + 1)
    total, moment = counts.sum(), np.zeros_like(weight)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ weight))
        gradient = x.T @ (counts * p - positive) / total + 1e-4 * weight
        moment = 0.9 * moment + gradient
        weight -= 0.5 * moment
    return weight


def one_hot(described: np.ndarray) -> np.ndarray:
    x = np.zeros((len(described), described.shape[1] * 8 + 1))
    for j in range(described.shape[1]):
        x[np.arange(len(described)), j * 8 + described[:, j]] = 1
    x[:, -1] = 1
    return x


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Every row's ``key`` and ``spans`` (start, end, kind, base, chance), by start, then kind.

    All base spans stay. A candidate for a credential is added if the span classifier gives it at least ``least``. The
    vote patterns (at most 3^5) and the span descriptions (at most 8^6, a few hundred in practice) are counted over all
    documents by Spark; EM and the classifier are fitted on those counts, not on rows. Positions are code points, end exclusive.
    Null text is empty and has no spans; equal rows give equal results. An empty table gives an empty result.
    """
    found = materialize(candidates(docs, key, text), "spans")
    each = found.select(F.explode("spans").alias("s")).select("s.vote", "s.described", "s.base")
    counted = each.groupBy("vote", "described").count().toPandas()
    chance: dict[int, float] = {}
    if len(counted):
        by_vote = counted.groupby("vote")["count"].sum()
        patterns = np.array([unpack(v, 3, len(LABELERS)) for v in by_vote.index])
        posterior, _ = expectation_maximisation(patterns, by_vote.to_numpy(float))
        counted["positive"] = counted["count"] * counted["vote"].map(dict(zip(by_vote.index, posterior)))
        by_form = counted.groupby("described")[["positive", "count"]].sum()
        forms = np.array([unpack(d, 8, 6) for d in by_form.index])
        weight = fit_classifier(forms, by_form["positive"].to_numpy(), by_form["count"].to_numpy(float))
        chance = dict(zip(by_form.index.tolist(), (1 / (1 + np.exp(-one_hot(forms) @ weight))).tolist()))

    def decide(columns):
        rows = []
        for spans in columns["found"].to_pylist():
            kept = [(s, 1.0 if s["base"] else chance[s["described"]]) for s in spans]
            kept = [{**{k: s[k] for k in ("start", "end", "kind", "base")}, "chance": p} for s, p in kept if p >= least]
            rows.append(sorted(kept, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
        yield None, {"spans": rows}

    out = "spans array<struct<start:int,end:int,kind:string,base:boolean,chance:double>>"
    return map_rows(found.withColumnRenamed("spans", "found"), ["key"], decide, out).withColumnRenamed("key", key)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text, in place of ``spans``."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": number(kind) for kind in BASE}
    return found.withColumns({**counts, "base_sha256": F.sha2(joined(base), 256), "spans": joined(F.col("spans"))})
