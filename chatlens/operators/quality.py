"""Keys that should be unique and are not."""

from functools import reduce

from pyspark.sql import functions as F


def uniqueness_violations(messages, keys=("id", "msg_id")):
    """Values of a key column that occur more than once. Each column is read on its own."""
    def repeated(key):
        counts = messages.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
        return counts.where("n > 1").select(
            F.lit(key).alias("field"), F.col("value").cast("string").alias("value"), "n"
        )

    return reduce(lambda a, b: a.unionByName(b), map(repeated, keys))
