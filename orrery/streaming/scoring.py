"""Stateless scoring of a stream by a fitted model."""

from pyspark.sql import DataFrame


def score_stream(model, stream: DataFrame, checkpoint: str, sink: str = "memory", name: str = "scored"):
    """Starts a query that scores each micro-batch; exactly once where the sink is."""
    writer = model.transform(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.format(sink).queryName(name).start()
