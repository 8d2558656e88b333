"""Repair of conversation structure: cheapest edits by a dynamic program that streams over turns sorted in each conversation."""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.text import NO_SPACE

# The grammar of role initials (s?(ua)+)? as states, the role that can follow each, and the costs.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FILLER = ("user", "user", "assistant", "user")
TO_END = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CLEAN, BLANK, DUPLICATE, CUT = range(4)
SPILL_ROWS = 1 << 20

REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """Every way to take one row from a state: (letters, cost, next state); inserts come before the row's own edit."""
    for inserts in range(3):
        before, spent = "I" * inserts, INSERT * inserts
        yield before + "D", spent + DELETE, state
        if fault not in (BLANK, DUPLICATE):
            spent += TRUNCATED * (fault == CUT)
            if initial in FOLLOWS[state]:
                yield before + "K", spent, FOLLOWS[state][initial]
            yield before + "R", spent + REROLE, FOLLOWS[state][FILLER[state][0]]
        state = FOLLOWS[state][FILLER[state][0]]


@lru_cache(maxsize=65536)
def advance(known: tuple, initial: str, fault: int) -> tuple[int, tuple, tuple]:
    """One row of the dynamic program: what to add to all costs, the new states, and how each was reached.

    ``known`` has for each state (cost above the least, rank of its edits in ASCII order) or None. No edits of one
    state begin with all those of another, as both end with the same row's edit; so ranks of prefixes decide ties for good.
    """
    best: dict[int, tuple] = {}
    for state, reached in enumerate(known):
        if reached is not None:
            for letters, cost, after in edits(state, initial, fault):
                way = (reached[0] + cost, reached[1], letters, state)
                if after not in best or way < best[after]:
                    best[after] = way
    least = min(w[0] for w in best.values())
    order = sorted(w[1:3] for w in best.values())
    states = tuple((best[s][0] - least, order.index(best[s][1:3])) if s in best else None for s in range(4))
    ways = tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))
    return least, states, ways


class Trail:
    """How each row's states were reached: two bytes a row, written to a task's temporary file beyond a million rows."""

    def __init__(self):
        self.recent, self.spilled, self.file = array("H"), 0, None
        self.kinds: list[tuple] = []
        self.number: dict[tuple, int] = {}

    def add(self, ways: tuple) -> None:
        if ways not in self.number:
            self.number[ways] = len(self.kinds)
            self.kinds.append(ways)
        self.recent.append(self.number[ways])
        if len(self.recent) == SPILL_ROWS:
            self.file = self.file or tempfile.TemporaryFile()
            self.recent.tofile(self.file)
            self.recent, self.spilled = array("H"), self.spilled + 1

    def _blocks(self) -> Iterator[array]:
        yield self.recent
        for block in range(self.spilled - 1, -1, -1):
            self.file.seek(block * SPILL_ROWS * 2)
            part = array("H")
            part.fromfile(self.file, SPILL_ROWS)
            yield part

    def letters(self, state: int) -> str:
        """All edits on the way to ``state``, read from the last row back."""
        parts = []
        for block in self._blocks():
            for number in reversed(block):
                state, letters = self.kinds[number][state]
                parts.append(letters[::-1])
            parts = ["".join(parts)]
        if self.file is not None:
            self.file.close()
        return "".join(parts)[::-1]


class Conversation:
    """The state carried from row to row of one conversation, of the same size for any number of rows but for the trail."""

    def __init__(self, hashed: bool):
        self.known: tuple = ((0, 0), None, None, None)
        self.hashes = [sha256(), None, None, None] if hashed else None
        self.began = [False] * 4
        self.trail, self.cost, self.faults = Trail(), 0, [0, 0, 0, 0]
        self.last, self.illegal = None, 0
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, fault: int, initial: str, role: str, text: str, turn: int | None) -> None:
        self.faults[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        more, self.known, ways = advance(self.known, initial, fault)
        self.cost += more
        self.trail.add(ways)
        if self.hashes is not None:
            self._write(ways, f"{role}:{text}", text)

    def _write(self, ways: tuple, as_is: str, text: str) -> None:
        hashes, began = [None] * 4, [False] * 4
        for state, way in enumerate(ways):
            if way is not None:
                at, letters = way
                hashes[state], began[state] = self.hashes[at].copy(), self.began[at]
                for letter in letters:
                    if letter != "D":
                        line = as_is if letter == "K" else f"{FILLER[at]}:" + (text if letter == "R" else "")
                        hashes[state].update((("\n" if began[state] else "") + line).encode("utf-8", "replace"))
                        began[state] = True
                        if letter == "I":
                            at = FOLLOWS[at][FILLER[at][0]]
        self.hashes, self.began = hashes, began

    def report(self) -> dict:
        ends = [(self.known[s][0] + INSERT * len(more), self.known[s][1], s) for s, more in TO_END.items() if self.known[s] is not None]
        cost, _, state = min(ends)
        out = {
            "gaps": 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns,
            "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT],
            "illegal": self.illegal, "cost": self.cost + cost, "audit": self.trail.letters(state) + TO_END[state], "repaired_sha256": None,
        }
        if self.hashes is not None:
            digest, at = self.hashes[state], state
            for _ in TO_END[state]:
                digest.update((("\n" if self.began[state] else "") + f"{FILLER[at]}:").encode())
                at = FOLLOWS[at][FILLER[at][0]]
            out["repaired_sha256"] = digest.hexdigest()
        return out


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" "))


def with_faults(rows: DataFrame, conv: str, turn: str, role: str, text: str, absent: Column) -> DataFrame:
    """The rows as the stream reads them: conversation as text, order, ``fault`` and the role's first character.

    A row is a duplicate if its role and text came at an earlier turn. The first turns come from an aggregation that is
    combined on the map side; only the texts' hashes (SHA-256) move. Copies at one turn meet in the stream.
    """
    plain = rows.select(
        F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"), F.col(conv).isNull().alias("none"), absent.alias("absent"),
        F.col(turn).isNotNull().alias("dated"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        _plain(role).alias("role"), _plain(text).alias("text"),
    )
    plain = plain.withColumn("same", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    at = F.struct("dated", "turn")
    repeated = plain.filter("NOT absent").groupBy("conv", "none", "same").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    repeated = repeated.filter("first < last").drop("last")
    joined = plain.join(repeated, ["conv", "none", "same"], "left")
    again = ~F.col("absent") & F.coalesce(at > F.col("first"), F.lit(False))
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(~F.col("text").rlike(NO_SPACE), BLANK).when(again, DUPLICATE).when(~end.isin(".", "!", "?"), CUT).otherwise(CLEAN)
    return joined.select("conv", "none", "absent", "dated", "turn", "role", "text", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def _streamed(marked: DataFrame) -> DataFrame:
    """Whole conversations in one task each, in order of turn (nulls first); ties by role, then text."""
    return marked.repartition("conv", "none").sortWithinPartitions("conv", "none", "dated", "turn", "role", "text")


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None, hashed: bool = True
) -> DataFrame:
    """One row per conversation: faults, the least cost of edits that give roles of the form (system? (user assistant)+)?, and the edits.

    Columns: ``conv``, ``gaps`` (turn numbers left out), ``blank``, ``duplicate``, ``truncated`` (rows by their first
    fault), ``illegal`` (neighbours out of order), ``cost``, ``audit`` and ``repaired_sha256`` (of the repaired
    ``role:text`` lines; null unless ``hashed``). ``audit`` has a letter per edit: K keep, R give the role that fits, D delete, I insert an
    empty turn; of equally cheap edits the ASCII-least. A null role or text counts as one space, a null turn comes first,
    rows of equal turns are taken by role, then text; repeated rows are duplicates. An empty role fits
    nowhere. The null conversation is one like any other. ``absent`` marks rows that are not there, whose conversation is reported all the
    same (with zeros if no row is there). An empty table gives an empty result. Other columns of the input play no part.

    A conversation of any length passes through one task as a stream: costs of four states and four running hashes are carried over
    Arrow batches, and two bytes a row are kept to trace the edits back, beyond a million rows in a temporary file of the task. Lost tasks run again.
    """
    marked = with_faults(rows, conv, turn, role, text, F.lit(False) if absent is None else absent)
    names = ["conv", "none", "absent", "fault", "initial", "role", "text", "dated", "turn"]

    def stream(batches):
        current, open_, before = None, None, None
        for batch in batches:
            done = []
            for conv_, none, gone, fault, initial, role_, text_, dated, turn_ in zip(*(batch[c].tolist() for c in names)):
                if (conv_, none) != current:
                    if open_ is not None:
                        done.append({"conv": current[0], "none": current[1], **open_.report()})
                    current, open_, before = (conv_, none), Conversation(hashed), None
                if not gone:
                    fault = DUPLICATE if fault != BLANK and (dated, turn_, role_, text_) == before else fault
                    before = (dated, turn_, role_, text_)
                    open_.add(fault, initial, role_, text_, turn_ if dated else None)
            if done:
                yield pd.DataFrame(done)
        if open_ is not None:
            yield pd.DataFrame([{"conv": current[0], "none": current[1], **open_.report()}])

    reports = _streamed(marked).select(*names).mapInPandas(stream, f"conv string, none boolean, {REPORT}")
    key = F.when(~F.col("none"), F.col("conv").cast(rows.schema[conv].dataType))
    return reports.withColumn("conv", key).drop("none").withColumnRenamed("conv", conv)


def repaired_rows(
    rows: DataFrame, reports: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None
) -> DataFrame:
    """The repaired conversations: ``conv``, ``place`` (0, 1, ...), ``role``, ``text`` and ``edit`` (K, R or I) of every row that is there after.

    ``reports`` comes from :func:`repair`. Each conversation's audit is sorted before its rows and steers the stream over them.
    """
    marked = with_faults(rows, conv, turn, role, text, F.lit(False) if absent is None else absent).filter("NOT absent")
    steer = reports.select(
        F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"), F.col(conv).isNull().alias("none"), F.lit(False).alias("dated"),
        F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit",
    )
    both = marked.select("conv", "none", "dated", "turn", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(steer)
    both = both.withColumn("own", F.col("audit").isNull())
    dealt = both.repartition("conv", "none").sortWithinPartitions("conv", "none", "own", "dated", "turn", "role", "text")
    names = ["conv", "none", "role", "text", "own", "audit"]

    def stream(batches):
        audit, at, last, place, state = "", 0, 0, 0, START
        for batch in batches:
            out = []
            for conv_, none, role_, text_, own, given in zip(*(batch[c].tolist() for c in names)):
                if not own:
                    audit, at, last, place, state = given, 0, len(given.rstrip("I")), 0, START
                    continue
                taken = False
                # A row takes the inserts before its own edit, the last row those behind it as well.
                while at < len(audit) and (not taken or at >= last):
                    letter, at = audit[at], at + 1
                    taken = taken or letter != "I"
                    if letter != "D":
                        new = role_ if letter == "K" else FILLER[state]
                        out.append((conv_, none, place, new, "" if letter == "I" else text_, letter))
                        place, state = place + 1, FOLLOWS[state][new[0]]
            yield pd.DataFrame(out, columns=["conv", "none", "place", "role", "text", "edit"])

    built = dealt.select(*names).mapInPandas(stream, "conv string, none boolean, place bigint, role string, text string, edit string")
    key = F.when(~F.col("none"), F.col("conv").cast(rows.schema[conv].dataType))
    return built.withColumn("conv", key).drop("none").withColumnRenamed("conv", conv)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with planted faults, by the CRC-32 of ``conv:turn`` modulo 20: ``absent`` (0), empty text (1), no ``.!?`` (2), twice (3), role user (4)."""
    name = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(name), F.lit(20))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("body", "[.!?]", "")).otherwise(F.col("body"))
    slim = rows.select(F.col(conv).alias(conv), F.col(turn).alias(turn), _plain(role).alias("speaker"), _plain(text).alias("body"), kind.alias("kind"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    speaker = F.when(F.col("kind") == 4, "user").otherwise(F.col("speaker"))
    return slim.select(conv, turn, speaker.alias(role), body.alias(text), (F.col("kind") == 0).alias("absent"), twice.alias("copy")).drop("copy")
