"""Sums of long vectors over many tasks, as a tree.

Every task sums what it reads into one vector and hands it out in slots of bounded
length. Slots of the same place are then added ``FAN_IN`` at a time, level by level, so
no task holds more than ``FAN_IN`` slots of a place however many tasks there were.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evotrail.staging import staged_table

FAN_IN = 32
#: Numbers in a slot.
SLOT = 8_192


def tree_sum(parts: DataFrame, kind: str, fan_in: int = FAN_IN) -> DataFrame:
    """(slot, values) of the rows (slot long, values array<kind>): their sums by slot.

    All vectors of a slot are equally long. Ints stay exact as long as the sums fit.
    """

    def add(found: pd.DataFrame) -> pd.DataFrame:
        total = np.add.reduce(np.stack(found["values"].to_numpy()))
        return pd.DataFrame({"slot": found["slot"][:1], "leaf": found["leaf"][:1], "values": [total]})

    stored = staged_table(parts.select("slot", F.spark_partition_id().alias("leaf"), "values"))
    leaves = (stored.agg(F.max("leaf")).first()[0] or 0) + 1
    while True:
        leaves = -(-leaves // fan_in)
        stored = (
            stored.withColumn("leaf", (F.col("leaf") % leaves).cast("int"))
            .groupBy("slot", "leaf")
            .applyInPandas(add, f"slot long, leaf int, values array<{kind}>")
        )
        if leaves == 1:
            return stored.select("slot", "values")


def slots(vector: np.ndarray) -> list[np.ndarray]:
    """The vector in pieces of at most ``SLOT``; slot n is the piece n."""
    return [vector[at : at + SLOT] for at in range(0, len(vector), SLOT)]


def whole(sums: DataFrame, size: int, dtype) -> np.ndarray:
    """The summed vector on the driver: for sizes bounded apart from the input."""
    found = np.zeros(size, dtype)
    for slot, values in sums.collect():
        found[slot * SLOT : slot * SLOT + len(values)] = values
    return found
