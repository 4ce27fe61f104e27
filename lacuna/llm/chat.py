"""Chat formatting: speaker roles of transcript lines by a hidden Markov model.

A source row (conversation, turn, given role, text) is a run of lines. A line is
observed as its speaker marker and line features (length class, list or code
line, question). The marker of a row's first line is the given role, if it is
a known name; any line may begin with a marker of its own (``Assistant: ...``,
``<|user|>``). The hidden states are the roles; a line that begins a row or has a
marker moves by the speaker-change chances, another line by those within a turn.

Chances are learnt by counting: line features by role from lines with a marker,
speaker changes from markers of neighbouring rows, each with one added to every
count. How far a marker is trusted and how rarely a speaker changes without one
are parameters.

Viterbi runs over blocks of ``BLOCK_TURNS`` turns of a conversation (a block with
more than ``BLOCK_ROWS`` rows is cut further, by turn and by hash). One pass gives
each block of a longer conversation its best scores from every role to every
role. These small tables are dealt by ranges, joined within each range, and the
ranges of a conversation are chained; then each range's own blocks are chained
between its ends, and a second pass reads each block between its now known ends. Turns come out one row per run of lines
of a role within a source row, so no conversation is gathered whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lacuna.functions import settle, settle_counting

ROLES = ("system", "user", "assistant")
#: Names that stand for a role, in markers and in the role column.
NAMES = {
    "system": 0,
    "instruction": 0,
    "user": 1,
    "human": 1,
    "prompter": 1,
    "customer": 1,
    "q": 1,
    "assistant": 2,
    "ai": 2,
    "bot": 2,
    "gpt": 2,
    "agent": 2,
    "model": 2,
    "a": 2,
}
MARKER_TRUST = 0.99
CHANGE_WITHIN = 1e-6
BLOCK_TURNS = 512
BLOCK_ROWS = 4096
#: Tables of blocks for each range, however many a conversation has.
CHAINED = 100_000
LENGTH_CLASSES = 12
_MARKER = re.compile(
    r"^\s*(?:[#>*]+\s*)?(?:<\|?|\[)?(" + "|".join(NAMES) + r")(?:\|?>|\]|\s*:|\s*>)\**:?[ \t]*",
    re.IGNORECASE,
)
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s|^\s{4,}\S|^```")
_LEVELS = len(ROLES)


def features(line: str) -> int:
    """The class of a line: length on a scale of powers of two, list or code, question."""
    length = min(len(line).bit_length(), LENGTH_CLASSES - 1)
    return (length * 2 + bool(_LIST.match(line))) * 2 + line.rstrip().endswith("?")


N_FEATURES = LENGTH_CLASSES * 4


def observe(role: str | None, text: str) -> tuple[list[int], list[tuple[str, str]]]:
    """What is seen of every line, as one number, and the line without its marker and whole.

    The number holds the marker's role (or ``_LEVELS``), whether the line begins
    a row or has a marker, and the feature class.
    """
    given = NAMES.get((role or "").strip().lower(), _LEVELS)
    seen, lines = [], []
    for i, line in enumerate(text.split("\n")):
        found = _MARKER.match(line)
        marker = NAMES[found[1].lower()] if found else given if i == 0 else _LEVELS
        bare = line[found.end() :] if found else line
        begins = i == 0 or found is not None
        seen.append((marker * 2 + begins) * N_FEATURES + features(bare))
        lines.append((bare, line))
    return seen, lines


def _parts(seen: int) -> tuple[int, int, int]:
    rest, feature = divmod(seen, N_FEATURES)
    return rest >> 1, rest & 1, feature


class Model:
    """Log chances of the hidden Markov model."""

    def __init__(self, lines: np.ndarray, changes: np.ndarray):
        lines, changes = lines + 1.0, changes + 1.0
        self.feature = np.log(lines / lines.sum(axis=1, keepdims=True)).tolist()
        self.first = np.log(changes[_LEVELS] / changes[_LEVELS].sum()).tolist()
        after = changes[:_LEVELS]
        self.change = np.log(after / after.sum(axis=1, keepdims=True)).tolist()
        stay, leave = math.log1p(-2 * CHANGE_WITHIN), math.log(CHANGE_WITHIN)
        self.within = [[stay if a == b else leave for b in range(_LEVELS)] for a in range(_LEVELS)]
        wrong = math.log((1 - MARKER_TRUST) / (_LEVELS - 1))
        trust = math.log(MARKER_TRUST)
        self.marker = [[trust if a == b else wrong for b in range(_LEVELS)] for a in range(_LEVELS)]

    def emission(self, seen: int) -> list[float]:
        marker, _, feature = _parts(seen)
        own = [chances[feature] for chances in self.feature]
        return own if marker == _LEVELS else [x + m for x, m in zip(own, self.marker[marker])]

    def step(self, scores: list[float], seen: int) -> tuple[list[float], list[int]]:
        move = self.change if _parts(seen)[1] else self.within
        best, back = [], []
        for b, emitted in enumerate(self.emission(seen)):
            a = max(range(_LEVELS), key=lambda a: scores[a] + move[a][b])
            best.append(scores[a] + move[a][b] + emitted)
            back.append(a)
        return best, back

    def begin(self, seen: int) -> list[float]:
        return [p + e for p, e in zip(self.first, self.emission(seen))]

    def decode(self, lines: list[int], entry: int, leave: int) -> list[int]:
        """The best roles; ``entry`` and ``leave`` are the neighbouring blocks' roles, -1 for none."""
        if entry < 0:
            scores, backs = self.begin(lines[0]), [[0] * _LEVELS]
        else:
            scores = [0.0 if a == entry else -math.inf for a in range(_LEVELS)]
            scores, back = self.step(scores, lines[0])
            backs = [back]
        for seen in lines[1:]:
            scores, back = self.step(scores, seen)
            backs.append(back)
        role = leave if leave >= 0 else max(range(_LEVELS), key=lambda a: scores[a])
        out = [role]
        for back in reversed(backs[1:]):
            role = back[role]
            out.append(role)
        return out[::-1]

    def transfer(self, lines: list[int], first: bool) -> list[float]:
        """Best scores from each entering role to each last role, by rows."""
        rows = []
        for entry in range(_LEVELS):
            if first:
                scores = self.begin(lines[0])
            else:
                scores = [0.0 if a == entry else -math.inf for a in range(_LEVELS)]
                scores, _ = self.step(scores, lines[0])
            for seen in lines[1:]:
                scores, _ = self.step(scores, seen)
            rows += scores
        return rows


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


_KEY = ["talk", "turns", "sub"]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks, from rows ordered by block."""
    kept = None
    for frame in frames:
        frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        if frame.empty:
            continue
        number = (frame[_KEY] != frame[_KEY].shift()).any(axis=1).cumsum()
        done = number < number.iloc[-1]
        for _, block in frame[done].groupby(number[done], sort=False):
            yield block
        kept = frame[~done]
    if kept is not None:
        yield kept


def _lines(block: pd.DataFrame) -> list[int]:
    return np.concatenate(block["seen"].to_list()).tolist()


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lines = np.zeros((_LEVELS, N_FEATURES), np.int64)
    changes = np.zeros((_LEVELS + 1, _LEVELS), np.int64)
    for block in _blocks(frames):
        before = _LEVELS if block["first"].iloc[0] else -1
        current = _LEVELS
        for seen in _lines(block):
            marker, begins, feature = _parts(seen)
            if begins:
                if before >= 0 and marker < _LEVELS:
                    changes[before, marker] += 1
                current = marker
                before = marker if marker < _LEVELS else -1
            if current < _LEVELS:
                lines[current, feature] += 1
    for kind, table in enumerate((lines, changes)):
        a, b = np.nonzero(table)
        yield pd.DataFrame({"kind": kind, "a": a, "b": b, "n": table[a, b]})


def _tables(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["best"].to_list()).reshape(-1, _LEVELS, _LEVELS)


def _joined(blocks: pd.DataFrame) -> pd.DataFrame:
    """One table for consecutive blocks of a conversation."""
    blocks = blocks.sort_values(["turns", "sub"])
    tables = _tables(blocks)
    whole = tables[0]
    for table in tables[1:]:
        whole = (whole[:, :, None] + table[None]).max(axis=1)
    return blocks[["talk", "segment"]].head(1).assign(best=[whole.ravel()])


def _chain(rows: pd.DataFrame, order: list[str], entry: int = -1, leave: int = -1) -> pd.DataFrame:
    """The roles at both ends of every table in order, between the given ends of all (-1: free)."""
    rows = rows.sort_values(order)
    tables = _tables(rows)
    scores, backs = tables[0][max(entry, 0)], []
    for table in tables[1:]:
        through = scores[:, None] + table
        backs.append(through.argmax(axis=0))
        scores = through.max(axis=0)
    ends = [int(scores.argmax()) if leave < 0 else leave]
    for back in reversed(backs):
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    return rows[["talk", *order]].assign(entry=[entry, *ends[:-1]], leave=ends)


def _ends(tables: DataFrame) -> DataFrame:
    """The roles at both ends of every block, from the blocks' tables."""
    tables, seen = settle_counting(tables, n=F.count(F.lit(1)))
    tasks = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = tables.repartitionByRange(max(tasks, -(-(seen["n"] or 0) // CHAINED)), *_KEY)
    dealt = settle(ranges.withColumn("segment", F.spark_partition_id()))
    own = ["talk", "segment"]
    outer = (
        dealt.groupBy(*own)
        .applyInPandas(lambda rows: _joined(rows), "talk string, segment int, best array<double>")
        .groupBy("talk")
        .applyInPandas(
            lambda rows: _chain(rows, ["segment"]), "talk string, segment int, entry int, leave int"
        )
    )

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        return _chain(rows, ["turns", "sub"], int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0]))

    return (
        dealt.join(outer, own)
        .groupBy(*own)
        .applyInPandas(inside, "talk string, turns long, sub long, entry int, leave int")
    )


def _dealt(conversations: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with what is seen of them and their block, kept as a table."""
    seen = F.pandas_udf(
        lambda role, text: pd.Series([observe(r, t)[0] for r, t in zip(role, text)]), "array<int>"
    )
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = conversations.select(
        *named,
        # A row without a conversation is one of its own.
        F.coalesce(
            F.concat(F.lit("="), F.col("conv_id").cast("string")), F.concat(F.lit("?"), F.uuid())
        ).alias("talk"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = settle(
        rows.withColumn("seen", seen("role", "text"))
        .withColumn("salt", F.xxhash64("text", "role"))
        .withColumn("turns", F.floor(F.col("at") / BLOCK_TURNS))
    )
    large = rows.groupBy("talk", "turns").agg(F.count("*").alias("n")).filter(f"n > {BLOCK_ROWS}")
    # Rows of one turn follow the order of their salts.
    cuts = F.ceil(F.col("n") / BLOCK_ROWS)
    place = F.least(F.floor((F.col("salt") / 2.0**64 + 0.5) * cuts), cuts - 1)
    sub = (F.col("at") - F.col("turns") * BLOCK_TURNS) * cuts + place
    return settle(
        rows.join(large, ["talk", "turns"], "left")
        .withColumn("sub", F.coalesce(sub, F.lit(0)).cast("long"))
        .drop("n")
    )


def _by_block(rows: DataFrame) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, "at", "salt")


def parse(conversations: DataFrame, keep: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """One row per canonical turn: ``keep``, part (from 0 in its source row), role, text, rendered.

    ``conversations`` has conv_id, turn, role and text. A null turn counts as 0,
    a null text as empty (one empty line), and a null or unknown role as no
    marker; rows of equal turn follow a hash of text and role. Repeated rows
    stay. An empty table gives no rows.
    """
    rows = _dealt(conversations, list(keep))
    blocks = rows.groupBy(*_KEY).agg(F.lit(1).alias("one"))
    talks = settle(
        blocks.groupBy("talk").agg(
            F.min(F.struct("turns", "sub")).alias("start"), F.count("*").alias("n_blocks")
        )
    )
    first = (F.col("turns") == F.col("start.turns")) & (F.col("sub") == F.col("start.sub"))
    seen = rows.select(*_KEY, "at", "salt", "seen").join(talks, "talk").withColumn("first", first)
    counted = _by_block(seen.drop("start", "n_blocks")).mapInPandas(
        _count, "kind int, a int, b int, n long"
    )
    lines, changes = np.zeros((_LEVELS, N_FEATURES)), np.zeros((_LEVELS + 1, _LEVELS))
    for kind, a, b, n in counted.groupBy("kind", "a", "b").agg(F.sum("n")).collect():
        (changes if kind else lines)[a, b] = n
    model = Model(lines, changes)

    def transfer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(frames):
            best = model.transfer(_lines(block), bool(block["first"].iloc[0]))
            yield block[_KEY].head(1).assign(best=[best])

    key = "talk string, turns long, sub long"
    longer = _by_block(seen.filter("n_blocks > 1").drop("start", "n_blocks"))
    ends = _ends(longer.mapInPandas(transfer, f"{key}, best array<double>"))
    inner = [f"c{i}" for i in range(len(keep))]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(frames):
            entry, leave = block["entry"].iloc[0], block["leave"].iloc[0]
            roles = iter(model.decode(_lines(block), int(entry), int(leave)))
            at, part, said, texts = [], [], [], []
            for i, (role, text) in enumerate(zip(block["role"], block["text"])):
                own_seen, own = observe(role, text)
                turns: list[tuple[int, list[str]]] = []
                for what, (bare, line) in zip(own_seen, own):
                    now = next(roles)
                    # A marker that the decoded role rejects is text.
                    line = bare if _parts(what)[0] == now else line
                    if not turns or turns[-1][0] != now:
                        turns.append((now, []))
                    turns[-1][1].append(line)
                for k, (now, of_turn) in enumerate(turns):
                    at.append(i)
                    part.append(k)
                    said.append(ROLES[now])
                    texts.append("\n".join(of_turn))
            out = block[inner].iloc[at].reset_index(drop=True)
            rendered = [render(r, t) for r, t in zip(said, texts)]
            yield out.assign(part=part, role=said, text=texts, rendered=rendered)

    whole = rows.join(settle(ends), _KEY, "left").fillna(-1, ["entry", "leave"])
    kept = [f for f in rows.schema.fields if f.name in inner]
    schema = StructType(
        [
            *kept,
            StructField("part", IntegerType()),
            *(StructField(c, StringType()) for c in ("role", "text", "rendered")),
        ]
    )
    return _by_block(whole).mapInPandas(decode, schema).toDF(
        *keep, "part", "role", "text", "rendered"
    )


def chat_query(spark, sf_dir: str) -> DataFrame:
    return parse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
