"""The stateful stream of outcomes against the batch classification."""

import random

from pyspark.sql import functions as F

from shoal import model as M
from shoal.operators import incremental
from shoal.streaming.outcomes import follow_outcomes


def test_outcomes_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(31)
    bits = [M.CREATE, M.DELETE, M.RENAME_OLD, M.RENAME_NEW, M.BASIC_INFO]
    log = [(u, rng.randrange(5), 1, rng.choice(bits), 32, f"n{u}") for u in range(1, 61)]
    df = spark.createDataFrame(log, M.CHANGE)
    base = spark.createDataFrame([], "id long")
    want = {(r.file_id, r.usn, r.outcome) for r in incremental.classify(base, df).collect()}
    source = str(tmp_path / "in")
    for part in range(3):
        batch = df.filter((F.col("usn") > part * 20) & (F.col("usn") <= part * 20 + 20))
        batch.coalesce(1).write.mode("append").parquet(source)
        if part:  # a repeated part changes nothing
            df.filter("usn <= 5").coalesce(1).write.mode("append").parquet(source)
        stream = follow_outcomes(spark.readStream.schema(M.CHANGE).parquet(source))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
        q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = [(r.file_id, r.usn, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(got) == want and len(got) == len(want)
