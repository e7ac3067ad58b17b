"""What the operators on conversations share: turns in order over the whole table, and folds along each conversation.

A conversation may hold any share of all turns. ordered() deals turns by ranges of (conversation, place), which cut through
a conversation too, so numbering them gathers no conversation in one task. A digest over all texts of a conversation is
sequential by nature: fold() sorts on disk and lets the rows pass one after the other, holding none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: What stands for a null conversation in keys; no number is written like this.
NO_ID = " "


def key_of(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("long").cast("string"), F.lit(NO_ID))


def id_of(key: Column) -> Column:
    return F.when(key != NO_ID, key.try_cast("long")).alias("conv_id")


def ordered(rows: DataFrame, name: str) -> DataFrame:
    """rows (key, turn, role, text, ...) written with `digest` (of role and text) and `seq`, which ascends by key, turn (nulls
    first), role and the SHA-256 of the text (hexadecimal). Exact copies stay side by side."""
    place = ["key", F.col("turn").asc_nulls_first(), "role", "text_sha", "copy"]
    named = rows.withColumn("text_sha", F.sha2("text", 256)).withColumn("copy", F.monotonically_increasing_id())
    dealt = named.repartitionByRange(*place).sortWithinPartitions(*place)
    return C.materialize(dealt.withColumn("seq", F.monotonically_increasing_id()).withColumn("digest", F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text_sha"), 256)).drop("text_sha", "copy"), name)


def fold(rows: DataFrame, columns: list[str], new: Callable, schema: str, order: Column | str = "seq") -> DataFrame:
    """One row (schema) for each key: new(key) is fed add(*columns) for each row in order and gives result() at the end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        key, state, done = None, None, []
        for f in frames:
            for own, *values in zip(f["key"], *(f[c].astype(object).where(f[c].notna(), None) for c in columns), strict=True):
                if own != key:
                    if state is not None:
                        done.append(state.result())
                    key, state = own, new(own)
                state.add(*values)
            if len(done) > 1_000:
                yield pd.DataFrame(done, columns=names)
                done = []
        if state is not None:
            done.append(state.result())
        yield pd.DataFrame(done, columns=names)

    return rows.repartition("key").sortWithinPartitions("key", order).select("key", *columns).mapInPandas(run, schema)
