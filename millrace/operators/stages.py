"""Stage plans: which stages may run, in which order, and whether what they left still has its seal.

A plan has few stages; its closure of needs is found by doubling, so rounds grow with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import scratch


def closure(edges: DataFrame) -> DataFrame:
    """(stage, needs): all stages that a stage needs, however far; a stage of a cycle needs itself."""
    spark = edges.sparkSession
    at, step = scratch(spark), 0
    edges.select("stage", "needs").where("stage is not null and needs is not null").distinct().write.parquet(f"{at}/0")
    count = -1
    while True:
        known = spark.read.parquet(f"{at}/{step}")
        if (now := known.count()) == count:
            return known
        count, step = now, step + 1
        further = known.select("stage", F.col("needs").alias("via")).join(known.select(F.col("stage").alias("via"), "needs"), "via").select("stage", "needs")
        known.union(further).distinct().write.parquet(f"{at}/{step}")


def reached(edges: DataFrame, low: str, high: str, roots: DataFrame) -> DataFrame:
    """The distinct values of roots(high) and of all that edges(low, high) lead to from them, however far.

    A round goes on from what the last one found first: it joins the edges with these and drops
    what is known, so cycles end and a value is written once.  Rounds are as many as the longest
    of the shortest ways.
    """
    spark = edges.sparkSession
    at, step = scratch(spark), 0
    edges.select(F.col(low).alias("_low"), F.col(high).alias("_high")).where("_low is not null and _high is not null").distinct().write.parquet(f"{at}/edges")
    edges = spark.read.parquet(f"{at}/edges")
    roots.select(F.col(high).alias("_high")).where("_high is not null").distinct().write.parquet(f"{at}/found/0")
    while True:
        last = spark.read.parquet(f"{at}/found/{step}")
        if last.isEmpty():
            break
        known = spark.read.parquet(*(f"{at}/found/{k}" for k in range(step + 1)))
        # Tables of keys merge: packed as they are, their size is estimated far too low for a broadcast.
        further = edges.hint("merge").join(last.select(F.col("_high").alias("_low")), "_low").select("_high").distinct()
        further.hint("merge").join(known, "_high", "left_anti").write.parquet(f"{at}/found/{step + 1}")
        step += 1
    return spark.read.parquet(*(f"{at}/found/{k}" for k in range(step + 1))).select(F.col("_high").alias(high))


def plan_stages(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """(stage, position, seal, state, faults) of every stage of stages(stage, content, sealed) and edges(stage, needs).

    A stage needs more stages than any that it needs, so their number orders the plan.  The
    seal hashes the contents of the stage and of all it needs: a change there makes it stale.
    faults: repeated stage, unknown need, cycle; such a stage and those that need it are invalid.
    States: invalid, sealed, stale, ready (all direct needs sealed), blocked.
    """
    one = stages.groupBy("stage").agg(F.min("content").alias("content"), F.min("sealed").alias("sealed"), (F.count("*") > 1).alias("repeated"))
    far = closure(edges)
    met = far.join(one.select(F.col("stage").alias("needs"), F.col("content").alias("part"), F.col("repeated").alias("bad")), "needs", "left")
    of = met.groupBy("stage").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.concat_ws("=", F.col("needs").cast("string"), "part"))).alias("parts"),
        F.max(F.col("part").isNull()).alias("unknown"),
        F.max(F.col("stage") == F.col("needs")).alias("cycle"),
        F.max(F.coalesce("bad", F.lit(False))).alias("bad"),
    )
    cyclic = far.where("stage = needs").select(F.col("needs"))
    behind = far.join(cyclic, "needs", "left_semi").select("stage").distinct().withColumn("behind", F.lit(True))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    both = one.join(of, "stage", "left").join(behind, "stage", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    faults = F.array_compact(F.array(F.when(F.col("repeated"), F.lit("repeated stage")), F.when(no("unknown"), F.lit("unknown need")), F.when(no("cycle"), F.lit("cycle"))))
    seal = F.sha2(F.array_join(F.concat(F.array(F.concat_ws("=", F.col("stage").cast("string"), "content")), "parts"), "\n"), 256)
    known = both.select("stage", F.coalesce("n", F.lit(0)).alias("n"), seal.alias("seal"), "sealed", faults.alias("faults"), (F.col("repeated") | no("unknown") | no("bad") | no("behind")).alias("invalid"))
    own = F.when(F.col("invalid"), "invalid").when(F.col("sealed") == F.col("seal"), "sealed").when(F.col("sealed").isNotNull(), "stale")
    judged = known.withColumn("own", own)
    open_needs = edges.select("stage", "needs").distinct().join(judged.select(F.col("stage").alias("needs"), "own"), "needs").groupBy("stage").agg(F.count_if(F.coalesce("own", F.lit("")) != "sealed").alias("open"))
    state = F.coalesce("own", F.when(F.coalesce("open", F.lit(0)) == 0, "ready").otherwise("blocked"))
    position = F.row_number().over(W.orderBy("n", "stage"))
    return judged.join(open_needs, "stage", "left").select("stage", position.alias("position"), "seal", state.alias("state"), F.array_join("faults", ",").alias("faults"))


def release_faults(data: DataFrame, manifest: DataFrame, split: str, key: str, tokens: str, limit: int) -> DataFrame:
    """(split, rows, faults) of a release against its manifest(split, rows, ids, hash, columns); one aggregate over the rows.

    The hash sums 48 bits of each row's SHA-256, so it holds in any order of the rows.
    """
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in sorted(data.columns))), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    found = data.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_ids"), F.sum(part).cast("string").alias("sum"), F.max(tokens).alias("most"))
    met = manifest.join(found, "split", "full_outer")
    codes = F.array_compact(
        F.array(
            F.when(F.col("rows").isNull(), F.lit("unexpected split")),
            F.when(F.col("n").isNull(), F.lit("missing split")),
            F.when(F.col("rows") != F.col("n"), F.lit("row count")),
            F.when(F.col("n_ids") != F.col("n"), F.lit("repeated id")),
            F.when(F.col("hash") != F.col("sum"), F.lit("hash")),
            F.when(F.col("columns") != F.lit(",".join(sorted(data.columns))), F.lit("schema")),
            F.when(F.col("most") > limit, F.lit("tokens")),
        )
    )
    return met.select("split", F.coalesce("n", F.lit(0)).alias("rows"), F.array_join(codes, ",").alias("faults"))
