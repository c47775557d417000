"""Which of many requests apply, as if one writer took them in order."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage


def settle(claims: DataFrame) -> DataFrame:
    """``claims``: request_id, target, choice, ticket; a request is all of its claims, or nothing.

    Requests are taken by ascending ticket (one per request, unique). A request applies if none of its targets has gone to another
    choice before; a target that already has the same choice is no obstacle. Returns the claims with ``won`` and ``fresh`` (the claim
    that gave the target its choice). Each round decides every request that is first, among the open ones, on all its open targets,
    so rounds follow the longest chain of requests that block one another, not their number; requests with one claim need one.
    """
    pending = cut_lineage(claims.select("request_id", "target", "choice", "ticket"))
    request = Window.partitionBy("request_id")  # as many rows as a request has fields
    taken = done = None
    while not pending.isEmpty():
        if taken is None:
            marked = pending.withColumn("held", F.lit(None).cast(pending.schema["choice"].dataType))
        else:
            marked = pending.join(taken.select(F.col("target").alias("_t"), F.col("choice").alias("held")), F.col("target").eqNullSafe(F.col("_t")), "left").drop("_t")
        marked = marked.withColumn("lost", F.max(F.coalesce(F.col("held") != F.col("choice"), F.lit(False))).over(request))
        first = marked.filter("not lost and held is null").groupBy(F.col("target").alias("_t")).agg(F.min("ticket").alias("_first"))
        ahead = marked.join(first, F.col("target").eqNullSafe(F.col("_t")), "left")
        clear = F.col("held").isNotNull() | F.coalesce(F.col("ticket") == F.col("_first"), F.lit(False))
        round_ = cut_lineage(ahead.withColumn("fresh", F.col("held").isNull()).withColumn("won", ~F.col("lost") & F.min(clear).over(request)).drop("_t", "_first", "held"))
        decided = round_.filter("won or lost").withColumn("fresh", F.col("won") & F.col("fresh")).drop("lost")
        done = decided if done is None else done.unionByName(decided)
        new = round_.filter("won and fresh").select("target", "choice")
        taken = new if taken is None else taken.unionByName(new)
        pending = round_.filter("not won and not lost").select("request_id", "target", "choice", "ticket")
    return done if done is not None else pending.withColumn("fresh", F.lit(False)).withColumn("won", F.lit(False))
