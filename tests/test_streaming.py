from lithic.operators.table import Table
from lithic.session import workspace
from lithic.streaming.ingest import append_stream


def test_batches_commit_once(spark, sf):
    source, rows = workspace(spark, "source"), spark.read.parquet(f"{sf}/orders.parquet")
    rows.repartition(3).write.parquet(source)
    table = Table.create(spark, workspace(spark, "sink"), rows.schema)
    checkpoint = workspace(spark, "mark")
    for _ in range(2):  # the second run finds nothing new
        append_stream(spark.readStream.schema(rows.schema).parquet(source), table, checkpoint).awaitTermination()
    assert Table.open(spark, table.path).scan().count() == rows.count()
    done = Table.open(spark, table.path)
    assert done.state["stream"][checkpoint] >= 0
