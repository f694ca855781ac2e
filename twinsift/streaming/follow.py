"""Following change events: into the index, into a folded state, and once-only reports."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import Interrupted
from ..operators import events
from ..plans.session import Session
from ..schemas import SAYS_NOT_WRITABLE, SKIPPED

log = logging.getLogger("twinsift")


def follow(session: Session, changes: DataFrame, checkpoint: str, on_results: Callable[[DataFrame], None], once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Keeps the index up to date with a stream of (seq, path, type): each batch is folded to the last event of a path.

    A batch that fails is handled again event by event, so one bad event is logged and left out and the others count.
    """

    def batch(rows: DataFrame, _: int) -> None:
        last = events.fold(rows, "seq").select("path", "type").persist()
        try:
            if last.isEmpty():
                return
            try:
                on_results(session.handle_changes(last))
            except Interrupted:
                raise
            except Exception as e:  # noqa: BLE001
                log.warning("A batch of changes failed and is handled one by one: %s", e)
                for event in last.toLocalIterator():
                    try:
                        on_results(session.handle_changes(last.sparkSession.createDataFrame([event], last.schema)))
                    except Interrupted:
                        raise
                    except Exception as e:  # noqa: BLE001
                        log.error("The change of %s is left out: %s", event["path"], e)
        finally:
            last.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def fold_stream(stream: DataFrame, order: tuple[str, ...], checkpoint: str) -> Callable[[], DataFrame]:
    """Folds an event stream (path, type, order columns) into the last event of each path; the result reads the state.

    A streaming aggregation: a maximum for each path, combined before the exchange and kept in Spark's state store, which
    writes what changes and recovers by itself. After a restart the state is there at once, and each event counts once.
    The state is read as a table, for which no batch has to run. (The session chooses the store; with
    spark.sql.streaming.stateStore.providerClass set to RocksDB's it need not fit in memory.)
    """
    spark, names = stream.sparkSession, stream.columns
    query = events.fold(stream, *order).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()

    def read() -> DataFrame:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state/0")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.createDataFrame([], stream.schema)
        best = spark.read.format("statestore").load(checkpoint).select("value.*").toDF("best")
        return best.select("best.*").select("*", "_rest.*").select(*names)

    return read


def unwritable(results: DataFrame) -> DataFrame:
    """Of a stream of results, each duplicate path that could not be written, the first time only."""
    return results.where((F.col("status") == SKIPPED) & (F.col("message") == SAYS_NOT_WRITABLE)).select("duplicate_path").dropDuplicates(["duplicate_path"])
