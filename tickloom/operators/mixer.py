"""Mixing corpora by ratio: which unit (a file's row group) goes to which chunk and part."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tickloom.functions.ranking import with_index
from tickloom.sources.sinks import materialised


def check_ratios(ratios: Mapping[str, float], slack: float = 1e-6) -> None:
    if abs(sum(ratios.values()) - 1) > slack:
        raise ValueError(f"ratios sum to {sum(ratios.values())}, not to 1")


class _Sums:
    """Sums of a category's unit sizes up to each unit, read block by block as a plan moves on; one block is held."""

    def __init__(self, blocks: Iterator[Row], skip: int) -> None:
        self.blocks, self.first, self.upto = blocks, 0, np.zeros(0, np.int64)  # of the block: first position, sums
        self.at, self.before = 0, 0  # next unit, and the sum before it
        self.ended = False
        while not self.ended and self.at < skip:
            self._fill()
            step = min(skip - self.at, self.first + len(self.upto) - self.at)
            self._go(self.at + step)
        self._fill()

    def _fill(self) -> None:
        """Reads on where the next unit is beyond the block."""
        while not self.ended and self.at >= self.first + len(self.upto):
            row = next(self.blocks, None)
            if row is None:
                self.ended = True
                return
            self.first += len(self.upto)
            self.upto = self.last + np.cumsum(np.array(row["sizes"], np.int64))

    @property
    def last(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def _go(self, at: int) -> None:
        if at > self.at:
            self.before = int(self.upto[at - 1 - self.first])
            self.at = at

    def take(self, need: int) -> tuple[int, int, int]:
        """Whole units until ``need`` is there: first position, the one after the last, and their sum."""
        start, before = self.at, self.before
        while not self.ended:
            k = int(np.searchsorted(self.upto, before + need))  # the first sum that reaches it
            if k < len(self.upto):
                self._go(self.first + k + 1)
                self._fill()
                break
            self._go(self.first + len(self.upto))
            self._fill()
        return start, self.at, self.before - before


def mix_plan(units: DataFrame, ratios: Mapping[str, float], turn: int = 1_000_000, part: int = 50_000_000, chunk: int = 1_000_000_000, resume: Mapping[str, int] | None = None, block: int = 1 << 14) -> DataFrame:
    """``category, file, row_group, tokens, chunk, part, seq`` for every unit.

    The category that lags most behind its ratio in the current chunk (the first by order of
    ``ratios`` of equals) gives whole units until its turn's tokens are there. Parts and chunks end
    once their tokens are reached, so that they overshoot by less than a turn. ``resume`` skips so
    many units of each category.

    Units are numbered within their categories in Spark. Turns follow from each other, so the driver makes them one by one; it holds a block of
    sizes a category and a row a turn, the turn's first and last position, and finds a turn's end among the sums. Units get their places by
    a join with the positions of the turns.
    """
    check_ratios(ratios)
    order = list(ratios)
    u = units.where(F.col("category").isin(order)).select("category", "file", "row_group", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    u = with_index(u, ["category", "file", "row_group"], "i_")
    first = u.groupBy("category").agg(F.min("i_").alias("first_")).withColumnRenamed("category", "category_")
    u = materialised(u.join(first, F.col("category") == F.col("category_")).withColumn("pos", F.col("i_") - F.col("first_")).drop("i_", "first_", "category_"))
    blocks = u.groupBy("category", F.floor(F.col("pos") / block).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tokens"))), lambda x: x["tokens"]).alias("sizes"))
    blocks = materialised(blocks)
    queues = {c: _Sums(blocks.where(F.col("category") == c).orderBy("k").toLocalIterator(), (resume or {}).get(c, 0)) for c in order}
    given = dict.fromkeys(order, 0)
    turns: list[tuple] = []
    seq = at_chunk = at_part = in_chunk = in_part = 0
    while any(not queues[c].ended for c in order):
        pick = min((c for c in order if not queues[c].ended), key=lambda c: given[c] / max(in_chunk, 1) - ratios[c])
        room = min(part, chunk - (in_chunk - in_part)) - in_part
        start, end, taken = queues[pick].take(max(1, min(turn, room)))
        turns.append((pick, start, end - 1, at_chunk, at_part, seq))
        seq += end - start
        given[pick] += taken
        in_chunk += taken
        in_part += taken
        if in_part >= min(part, chunk - (in_chunk - in_part)):
            at_part, in_part = at_part + 1, 0
        if in_chunk >= chunk:
            at_chunk, at_part, in_chunk, in_part = at_chunk + 1, 0, 0, 0
            given = dict.fromkeys(order, 0)
    t = units.sparkSession.createDataFrame(turns, "category_ string, from_ long, to_ long, chunk long, part long, seq_ long")
    t = t.withColumn("pos_", F.explode(F.sequence("from_", "to_")))
    out = u.join(t, (F.col("category") == F.col("category_")) & (F.col("pos") == F.col("pos_")))
    return out.select("category", "file", "row_group", "tokens", "chunk", "part", (F.col("seq_") + F.col("pos") - F.col("from_")).alias("seq"))


def apply_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with ``category, file, row_group`` beside the chunk and part that their unit goes to."""
    return rows.join(plan.select("category", "file", "row_group", "chunk", "part", "seq"), ["category", "file", "row_group"])


def units_of(rows: DataFrame, tokens: str) -> DataFrame:
    return rows.groupBy("category", "file", "row_group").agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


def units_of_row_groups(groups: DataFrame, category: str, size: str = "tokens") -> DataFrame:
    """Units of one category from the row groups of its files, as ``sources.readers.row_groups`` lists them; ``size`` names what counts."""
    return groups.select(F.lit(category).alias("category"), "file", "row_group", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("tokens"))
