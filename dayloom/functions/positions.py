"""Places, ranks and running totals over a whole table without a window over all rows in one task.

Approximate quantiles of the ordering column cut the table into blocks; exact totals of the blocks
(at most BLOCKS numbers) say what lies before each; a window inside the blocks does the rest.
The cuts only deal the work out: results do not depend on them. Many rows with one value of the
ordering column share a block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

BLOCKS = 64
ROLLING_ROWS = 100_000  # rows of a block of a rolling window


def running_sums(df: DataFrame, by: str, sums: Mapping[str, Column], then: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Adds, for each name, the sum of its column over the rows up to this one in the order of ``by``
    (a number, not null) and ``then``; also returns the number of rows."""
    shares = [i / BLOCKS for i in range(1, BLOCKS)]
    cuts, n = df.agg(F.percentile_approx(by, shares, 10_000), F.count("*")).first()
    cuts = sorted(set(cuts or ()))
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    rows = df.withColumn("__block", block).withColumns({f"__{k}": c for k, c in sums.items()})
    before = {k: [0] * (len(cuts) + 2) for k in sums}
    for r in rows.groupBy("__block").agg(*[F.sum(f"__{k}").alias(k) for k in sums]).collect():  # at most BLOCKS rows
        for k in sums:
            before[k][r["__block"] + 1] = r[k] or 0
    ahead = {k: F.get(F.array(*[F.lit(x) for x in accumulate(v)]), F.col("__block")) for k, v in before.items()}
    inside = Window.partitionBy("__block").orderBy(by, *then).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({k: F.sum(f"__{k}").over(inside) + ahead[k] for k in sums})
    return out.drop("__block", *[f"__{k}" for k in sums]), n


def with_position(df: DataFrame, by: str, then: Sequence[str] = (), out: str = "position") -> tuple[DataFrame, int]:
    """Adds the row's place from 1 in the order of ``by`` and ``then``; also returns how many rows there are."""
    return running_sums(df, by, {out: F.lit(1).cast("bigint")}, then)


def tile(position: Column, n: int, buckets: int) -> Column:
    """The bucket, from 1, of a place among n: sizes differ by one at most, larger ones first."""
    size, more = divmod(n, buckets)
    ahead = more * (size + 1)
    return F.when(position <= ahead, F.floor((position - 1) / (size + 1)) + 1).otherwise(more + F.floor((position - 1 - ahead) / max(size, 1)) + 1).cast("int")


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, n (rows that have it), rank (from 1; ties share the mean of theirs): one row a value."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    reached, _ = running_sums(counts, value, {"__upto": F.col("n")})
    return reached.select(value, "n", (F.col("__upto") - (F.col("n") - 1) / 2).alias("rank"))


def rolling_rows(df: DataFrame, by: str, rows_back: int, function, out: str) -> DataFrame:
    """Adds function(window) over the row and the ``rows_back`` rows before it. Each block takes along
    the last rows of the block before."""
    placed, _ = with_position(df, by, out="__at")
    own = F.floor((F.col("__at") - 1) / ROLLING_ROWS)
    last = (F.col("__at") - 1) % ROLLING_ROWS >= ROLLING_ROWS - rows_back
    dealt = placed.withColumn("__own", own).withColumn("__block", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__block").orderBy("__at").rowsBetween(-rows_back, 0)
    return dealt.withColumn(out, function(w)).where("__own = __block").drop("__at", "__own", "__block")
