"""Matches of texts that end with one another, by reversed texts sorted in ranges.

A text's suffixes are the prefixes of its reverse, and in sorted order whatever
begins with a text follows it without gap. So a scan of a range needs a stack
only: what the row at hand begins with. The texts that the first row of a range
begins with are looked up and put before it, so ranges are scanned apart. Rows
are shuffled once by range and once by its number, whatever their lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def _ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (text, ..) as (part, carried, r, ..): reversed texts in order in each part, after those in earlier parts that its first begins with."""
    rest = [c for c in rows.columns if c != "text"]
    ordered = rows.select(F.reverse("text").alias("r"), *rest).repartitionByRange("r").sortWithinPartitions("r")
    held = written(ordered.select(F.spark_partition_id().alias("part"), F.lit(False).alias("carried"), "*"), "ranges")
    first = held.groupBy("part").agg(F.min("r").alias("first"))
    prefixes = first.select(F.col("part").alias("to"), F.explode(F.transform(F.sequence(F.lit(0), F.length("first")), lambda i: F.substring("first", 1, i))).alias("r"))
    before = held.join(prefixes, "r").filter("part < to").withColumns({"part": F.col("to"), "carried": F.lit(True)}).select(held.columns)
    return held.unionByName(before).repartition("part").sortWithinPartitions("part", "r")


def _scan(batches: Iterator[pa.RecordBatch], step: Callable[[list, tuple], None], leave: Callable[[list, list], None]) -> Iterator[None]:
    """Call ``step(stack, row)`` for each row (part, carried, r, ..), with what it begins with on the stack, and ``leave(stack, entry)`` for what is done; one None for each batch."""
    stack: list[list] = []
    part = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while stack and (row[0] != part or not row[2].startswith(stack[-1][0])):
                leave(stack, stack.pop())
            part = row[0]
            step(stack, row)
        yield
    while stack:
        leave(stack, stack.pop())
    yield


def ending_with(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(tail, id): each of ``longer`` (text, id string) with all of ``shorter`` (text) that it ends with."""
    rows = longer.select("text", "id", F.lit(None).cast("string").alias("tail")).unionByName(shorter.select("text", F.lit(None).cast("string").alias("id"), F.col("text").alias("tail")).distinct())

    def run(batches):
        out: list[tuple[str, str]] = []
        same: list = [None, []]

        # Texts that are equal count as well, in whichever order they come.
        def step(stack, row):
            _, carried, r, name, tail = row
            if tail is not None:
                stack.append([r, tail])
                out.extend((tail, x) for x in same[1] if same[0] == r)
            elif not carried:
                out.extend((entry[1], name) for entry in stack)
                if same[0] != r:
                    same[:] = [r, []]
                same[1].append(name)

        for _ in _scan(batches, step, lambda stack, entry: None):
            while out:
                some, out[:] = out[:10_000], out[10_000:]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], names=["tail", "id"])

    return _ranges(rows).mapInArrow(run, "tail string, id string")


def least(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, first, value): for each of ``wanted`` (text), the least of ``keys`` (text, first, value string) that it ends with or that ends with it."""
    first = dict(keys.dtypes)["first"]
    rows = keys.select("text", "first", "value", F.lit(False).alias("asked")).unionByName(wanted.select("text", F.lit(None).cast(first).alias("first"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("asked")).distinct())

    def run(batches):
        schema, out = None, []

        def better(a, b):
            return b if a is None or b is not None and b[0] < a[0] else a

        # An entry: its text, whether it is asked for, the least key above it, and the least below it.
        def step(stack, row):
            _, carried, r, own, value, asked = row
            above = stack[-1][2] if stack else None
            if asked:
                stack.append([r, True, above, None])
            else:
                key = (tuple(own.values()), own, value)
                stack.append([r, False, better(above, key), None if carried else key])

        def leave(stack, entry):
            r, asked, above, below = entry
            if asked and (best := better(above, below)) is not None:
                out.append((r[::-1], best[1], best[2]))
            if stack:
                stack[-1][3] = better(stack[-1][3], below)

        def counted():
            nonlocal schema
            for batch in batches:
                schema = schema or batch.schema.field("first").type
                yield batch

        for _ in _scan(counted(), step, leave):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], schema), pa.array([x[2] for x in out], pa.string())], names=["text", "first", "value"])
                out.clear()

    found = _ranges(rows).mapInArrow(run, f"text string, first {first}, value string")
    return found.groupBy("text").agg(F.min("first").alias("first"), F.min_by("value", "first").alias("value"))
