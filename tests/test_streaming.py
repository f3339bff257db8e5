from strandline.operators import tiles
from strandline.streaming.counts import streaming_kmer_counts


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGTACGT"), ("a", "ACNACG"), ("b", ""), ("b", "TTTT")], "name string, sequence string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_kmer_counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("kmers").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("kmers").collect()} == {tuple(r) for r in tiles.kmer_counts(df, 3).collect()}
