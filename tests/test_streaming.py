"""The streaming pass equals the batch pass when games arrive in order."""

from conftest import SF
from pyspark.sql import functions as F

from paceline.operators import elo
from paceline.sources import tables
from paceline.streaming.online_elo import stream_elo


def test_stream_equals_batch(spark, tmp_path):
    g = tables.games(spark, SF).withColumn("start_date", F.col("start_date").cast("timestamp")).withColumn("league", F.lit("all")).where("season <= 1996")
    g.where("season = 1995").coalesce(1).write.parquet(str(tmp_path / "in"))
    g.where("season = 1996").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = stream_elo(rows).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["game_id"]: r["p"] for r in spark.sql("select * from online").collect()}
    want = {r["game_id"]: r["p"] for r in elo.pregame(g, spark.createDataFrame([elo.TUNED], elo.PARAMS)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
