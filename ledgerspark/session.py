"""Session settings.  On a cluster, pass your own session to ``tune``; ``local_session`` is for tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch; a single larger row stands alone.
ARROW_BYTES = 16 * 1024 * 1024


def tune(spark: SparkSession) -> SparkSession:
    """Settings the jobs want in any session.

    The JVM does not compile methods of more than 8,000 bytecodes, and the widest projections would exceed
    that as one generated method.  With the limit, Spark generates them in smaller methods instead; the
    feature table of ten million rows takes less than half the time.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return bound_batches(spark)


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, whatever rows hold; always by the same value, so no query changes it for another."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def local_session(cores: str = "8", app: str = "ledgerspark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
