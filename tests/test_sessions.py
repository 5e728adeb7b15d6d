"""Series of a stream against the batch query, late files, and what closes a run."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from lumenspark.functions.dialect import chain, spark_text
from lumenspark.operators import catalog
from lumenspark.streaming import sessions

START = datetime.datetime(2024, 1, 1)
SCHEMA = "folder string, path string, bias double, width int, height int, modified timestamp"


def test_series_over_several_batches(spark, tmp_path):
    r = np.random.default_rng(8)
    rows = []
    for folder in ("a", "b", "c"):
        for i in range(40):
            bias = [None, 0.0, -2.0, 2.0, 1.0][r.integers(5)]
            rows.append((folder, f"p{i:03}.{['jpg', 'PNG', 'txt'][min(2, r.integers(8))]}", bias, int(r.integers(1, 3)), 5, START + datetime.timedelta(seconds=i)))
    later = START + datetime.timedelta(hours=1)
    batches = [[x for x in rows if low <= int(x[1][1:4]) < low + 8] for low in range(0, 40, 8)]
    batches.append([("z", "end.png", 0.0, 1, 1, later)])
    batches.append([("a", "p010x.png", 0.0, 1, 5, later + datetime.timedelta(hours=1))])
    got = []
    for batch in batches:  # one batch each, through the same checkpoint
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = sessions.sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        got.append(spark.read.schema(sessions.FOUND).parquet(str(tmp_path / "out")).count())
    found = spark.read.schema(sessions.FOUND).parquet(str(tmp_path / "out")).filter("folder <> 'z'")
    text = chain([("catalog", "SELECT folder, path, bias, width, height FROM {src}"), *catalog.series("catalog"), ("result", "SELECT folder, first_path, path FROM members UNION ALL SELECT folder, NULL AS first_path, path FROM singles")])
    expected = spark.sql(spark_text(text), src=spark.createDataFrame(rows, SCHEMA))
    key = lambda df: sorted(map(tuple, df.select("folder", "first_path", "path").collect()), key=repr)
    assert key(found.filter(~F.col("late"))) == key(expected)
    assert [(x.folder, x.first_path, x.path) for x in found.filter("late").collect()] == [("a", None, "p010x.png")]
    assert 0 < got[1] < got[4] < got[5]  # runs come out as they are closed
