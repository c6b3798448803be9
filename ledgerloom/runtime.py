"""Session helpers: reading tables and cutting lineage where executors may be lost."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder and read from there.

    The folder is spark.checkpoint.dir as the cluster names it. A folder of our own is used only on a single machine where none
    is set, as in tests; a cluster must name one, since a folder of one machine is lost with it.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints"))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join by shuffle and sort, whatever its size is thought to be.

    Sizes are estimated from the compressed columns of a scan and know nothing of what is exploded after it, so a side that
    grows with the input may pass for one small enough to be gathered on the driver and broadcast.
    """
    return df.hint("merge")


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` with the row number over the whole order, without gathering it in one partition.

    Rows are range-partitioned and numbered within their partition; what a partition begins with is the sum of the
    counts before it, of which there is one per partition. Order columns must tell all rows apart.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    d = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = d.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__o", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__o")
    return d.withColumn(name, F.row_number().over(W.partitionBy("__p").orderBy(*order))).join(F.broadcast(counts), "__p").withColumn(name, F.col(name) + F.col("__o")).drop("__p", "__o")


def by_group(df: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """`work` (a list of dicts -> a list of dicts) on each group, in `order`; `schema` names what it gives besides the keys.

    Groups are met one after the other in sorted partitions, so thousands of small groups share an Arrow batch and a
    worker holds one group at a time. For groups with a natural bound, such as the boxes of a page.
    """
    kinds = dict(df.dtypes)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        import pandas as pd

        cols, at, group, out = None, None, [], []

        def flush():
            if group:
                out.extend((*at, *[r.get(n) for n in names]) for r in work(group))

        def frame():
            return pd.DataFrame(out, columns=[*keys, *names], dtype=object)

        for b in batches:
            cols = cols or list(b.columns)
            values = [b[c].astype(object).where(b[c].notna(), None).tolist() for c in cols]
            where = [cols.index(k) for k in keys]
            for row in zip(*values):
                key = tuple(row[i] for i in where)
                if key != at:
                    flush()
                    at, group = key, []
                group.append(dict(zip(cols, row)))
            yield frame()
            out = []
        flush()
        yield frame()

    full = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, full)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than there are cores, for work that costs far more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def exact_quantiles(df: DataFrame, by: str, value: str, probs: dict[str, float]) -> DataFrame:
    """(by, n, a column for each of `probs`): exact quantiles with linear interpolation, nulls left out.

    The built-in exact percentile holds all distinct values of a group in one task. Here equal values are counted first, with map-side
    combine, so that a value which very many rows have is one row; different values are range-partitioned and their counts summed up,
    and only the two on either side of each quantile are gathered.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    v = df.select(F.col(by), F.col(value).cast("double").alias("__v")).where("__v is not null").groupBy(by, "__v").agg(F.count("*").alias("__c"))
    d = cut(v.repartitionByRange(by, "__v").withColumn("__p", F.spark_partition_id()))
    counts = d.groupBy(by, "__p").agg(F.sum("__c").alias("__c"))
    w = W.partitionBy(by)
    counts = counts.withColumn("__o", F.coalesce(F.sum("__c").over(w.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("__c").over(w))
    place = {k: (F.col("n") - 1) * p for k, p in probs.items()}
    holds = lambda x, least, more: (x >= F.col(least)) & (x < F.col(least) + F.col(more))
    wanted = lambda least, more: _any([holds(f(x), least, more) for x in place.values() for f in (F.floor, F.ceil)])
    # Partitions that hold no wanted place need no order.
    r = d.join(counts.where(wanted("__o", "__c")).select(by, "__p", "__o", "n"), [by, "__p"])
    upto = F.sum("__c").over(W.partitionBy(by, "__p").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    r = r.withColumn("__at", upto + F.col("__o") - F.col("__c")).where(wanted("__at", "__c"))
    at = lambda x: F.max(F.when(holds(x, "__at", "__c"), F.col("__v")))
    part = {k: F.max(x - F.floor(x)) for k, x in place.items()}
    return r.groupBy(by).agg(F.max("n").alias("n"), *[(at(F.floor(x)) + (at(F.ceil(x)) - at(F.floor(x))) * part[k]).alias(k) for k, x in place.items()])


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
