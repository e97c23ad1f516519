"""Point-in-time join: the last observation of each feature available at a decision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import interim
from .fold import BatchStarts, ddl_of
from .series import SeriesLayout


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], fill: Sequence[str], keep: str, spread: Sequence[str | Column] = ()) -> DataFrame:
    """Rows with boolean ``keep``, whose columns ``fill`` hold, each by itself, the last value that is not null up to there.

    Rows are dealt by sampled ranges of (keys, order, spread), so no key and no crowded moment is a single task; ``spread`` tells
    rows apart that ``order`` leaves equal. They are shuffled once and stored as filled in their piece; what a piece takes over
    from those before it is one row a piece, which is broadcast. Null keys are a group.
    """
    keys, fill = list(keys), list(fill)
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(pieces, *keys, *order, *spread).sortWithinPartitions(*keys, *order)
    dealt = dealt.select(*df.columns, F.spark_partition_id().alias("_piece"), F.lit(False).alias("_tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = BatchStarts(keys)
        held: dict[str, pa.Array] = {}  # the last value met of the open group, one row each
        tail = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts, at = marks(batch), np.arange(n)
            opened = np.maximum.accumulate(np.where(starts, at, -1))
            columns = dict(zip(batch.schema.names, batch.columns))
            for x in fill:
                own = columns[x]
                last = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), at, -1))
                # Row 0 is null, row 1 what was held before this batch, the others the batch's own.
                before = held.get(x, pa.nulls(1, own.type))
                take = np.where(last >= np.maximum(opened, 0), last + 2, np.where(opened < 0, 1, 0))
                columns[x] = pa.concat_arrays([pa.nulls(1, own.type), before, own]).take(pa.array(take))
                held[x] = columns[x].slice(n - 1, 1)
            filled = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
            tail = filled.slice(n - 1, 1)
            yield filled.filter(columns[keep])
        if tail is not None:
            place = tail.schema.get_field_index("_tail")
            yield tail.set_column(place, tail.schema.field(place), pa.array([True]))

    stored = interim(dealt.mapInArrow(run, ddl_of(dealt)))
    tails = stored.where("_tail").select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_from"), *[F.col(x).alias(f"_f_{x}") for x in fill])
    along = Window.partitionBy(*[f"_k_{i}" for i in range(len(keys))]).orderBy("_from")
    tails = tails.withColumn("_to", F.coalesce(F.lead("_from").over(along), F.lit(pieces))).withColumns(
        {f"_f_{x}": F.last(f"_f_{x}", True).over(along.rowsBetween(Window.unboundedPreceding, 0)) for x in fill})
    met = (F.col("_piece") > F.col("_from")) & (F.col("_piece") <= F.col("_to"))
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    out = stored.where("NOT _tail").join(F.broadcast(tails), met, "left")
    return out.select(*[(F.coalesce(x, f"_f_{x}").alias(x) if x in fill else F.col(x)) for x in df.columns if x != keep])


def as_of_join(
    decisions: DataFrame,
    observations: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    available: str = "available_time",
    values: Sequence[str] = ("value",),
    layout: SeriesLayout | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Attach to each decision row the ``values`` of the latest observation with ``available <= ts``.

    Of observations available at one time the one with the largest ``tie`` counts (without ``tie``: with the
    largest values in column order). Both sides form one series per key (:func:`fill_forward`), shuffled and stored once;
    pieces have no blocks, so ``layout`` changes nothing.
    """
    keys, values = list(keys), list(values)
    payload = F.struct(*[F.col(v) for v in values])
    right = observations.select(*keys, F.col(available).alias("_at"), payload.alias("_obs"), (F.col(tie) if tie else payload).alias("_tie"))
    left = decisions.withColumns({"_at": F.col(ts), "_own": F.lit(True)})
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_own", F.coalesce("_own", F.lit(False)))
    known = fill_forward(both, keys, ("_at", "_own", "_tie"), ("_obs",), "_own", spread=(F.xxhash64(*decisions.columns),))
    return known.select(*decisions.columns, *[F.col(f"_obs.{v}").alias(v) for v in values])
