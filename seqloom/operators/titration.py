"""The acidity at which a string's net charge is smallest, on a fixed grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import lookups as L
from seqloom.functions import sequences as S


def charge_zero(df: DataFrame, keys: Sequence[str], steps: int = 1400) -> DataFrame:
    """Grid point 0..14 with the least absolute charge; row-local, over letter counts only.

    Net charge falls as the acidity rises, so a bisection over the grid finds
    the crossing; the nearer of the two grid points beside it is the answer.
    """
    kinds = [k for k in {**L.PK_POSITIVE, **L.PK_NEGATIVE} if len(k) == 1]
    rows = df.select(*keys, F.struct(*[S.count_in("seq", k).alias(k) for k in kinds]).alias("_c"))

    def charge(point):
        ph = point * 14.0 / steps
        total = F.lit(0.0)
        for k, pk in L.PK_POSITIVE.items():
            n = F.lit(1) if k == "n_end" else F.col("_c")[k]
            total = total + n / (1 + F.pow(F.lit(10.0), ph - pk))
        for k, pk in L.PK_NEGATIVE.items():
            n = F.lit(1) if k == "c_end" else F.col("_c")[k]
            total = total - n / (1 + F.pow(F.lit(10.0), F.lit(pk) - ph))
        return total

    def halve(acc, _):
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        positive = charge(middle) > 0
        return F.struct(
            F.when(positive, middle).otherwise(acc["lo"]).alias("lo"),
            F.when(positive, acc["hi"]).otherwise(middle).alias("hi"),
        )

    rounds = F.sequence(F.lit(1), F.lit(steps.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(steps).alias("hi"))
    found = rows.withColumn("_r", F.aggregate(rounds, start, halve))
    below, above = (F.round(F.abs(charge(F.col("_r")[side])), 9) for side in ("lo", "hi"))
    point = F.when(below <= above, F.col("_r")["lo"]).otherwise(F.col("_r")["hi"])
    return found.select(*keys, (point / (steps / 14)).alias("ph"))
