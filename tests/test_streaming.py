import os
import tempfile


def test_incremental_outline_stream(spark):
    from quire.streaming import incremental
    d = tempfile.mkdtemp(prefix="quire-stream-", dir="/tmp")
    src, store, ck = os.path.join(d, "src"), os.path.join(d, "store"), os.path.join(d, "ck")
    os.makedirs(src)
    with open(os.path.join(src, "a.py"), "w") as fh:
        fh.write("import os\nclass A:\n    pass\ndef f(x):\n    return x\n")
    incremental.start(spark, src, store, ck, once=True).awaitTermination()
    first = spark.read.parquet(store)
    assert first.where("kind = 'function'").count() == 1
    # a second run with no new files adds nothing
    incremental.start(spark, src, store, ck, once=True).awaitTermination()
    assert spark.read.parquet(store).count() == first.count()
