"""Resume-safe feature extraction over arriving voxel files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxcohort import schema
from voxcohort.sources.sinks import read_or_none


class Waiting:
    """Voxels of cases that are not complete yet: one generation of files per batch.

    A batch reads the generation before it and writes its own, so what it costs follows
    what is still waiting, not all that ever arrived. The generation a replayed batch
    needs is kept; older ones are removed.
    """

    def __init__(self, session: SparkSession, folder: str):
        self.session, self.folder = session, folder
        self.path = session._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(session._jsparkSession.sessionState().newHadoopConf())

    def place(self, batch: int) -> str:
        return f"{self.folder}/batch={batch}"

    def generations(self) -> list[int]:
        if not self.files.exists(self.path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.folder))]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def before(self, batch: int) -> DataFrame | None:
        held = [g for g in self.generations() if g < batch]
        return self.session.read.schema(schema.VOXELS).parquet(self.place(held[-1])) if held else None

    def keep(self, rows: DataFrame, batch: int) -> None:
        """Write the generation of ``batch`` and remove those that no batch reads again."""
        rows.write.mode("overwrite").parquet(self.place(batch))
        held = [g for g in self.generations() if g < batch]
        for g in held[:-1]:
            self.files.delete(self.path(self.place(g)), True)


def waiting_voxels(spark: SparkSession, out: str) -> DataFrame | None:
    """Voxels that wait beside the output ``out`` for the rest of their cases."""
    held = Waiting(spark, f"{out}_waiting")
    last = held.generations()
    return held.before(last[-1] + 1) if last else None


def run_available(spark: SparkSession, source: str, out: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame],
                  expected: DataFrame, key: str = "case_id", max_files: int = 1000) -> None:
    """Process every voxel file not seen yet and append one row per case that is now complete.

    ``expected`` (key, n_voxels) says how many voxels a case has. Voxels wait beside the
    output until their case is complete and are dropped then, so a case may arrive over
    many files, batches and runs. A file delivered twice, or a batch replayed after a
    failure, adds nothing: voxels are deduplicated, a batch starts from the generation
    before its own, and finished cases are left out by an anti-join on the key alone.
    """
    def one_batch(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        held = Waiting(session, f"{out}_waiting")
        before = held.before(number)
        waiting = batch if before is None else batch.unionByName(before)
        done = read_or_none(session, out, "parquet")
        if done is not None:
            waiting = waiting.join(done.select(key).distinct(), key, "left_anti")
        waiting = waiting.dropDuplicates([key, "z", "y", "x"]).select(batch.columns).persist()
        complete = waiting.groupBy(key).agg(F.count("*").alias("n")).join(expected, key).where("n >= n_voxels").select(key).persist()
        try:
            if not complete.isEmpty():
                compute(waiting.join(complete, key, "left_semi")).write.mode("append").parquet(out)
            held.keep(waiting.join(complete, key, "left_anti").select(batch.columns), number)
        finally:
            complete.unpersist()
            waiting.unpersist()

    stream = (spark.readStream.schema(schema.VOXELS).option("maxFilesPerTrigger", max_files)
              .option("recursiveFileLookup", True).parquet(source))
    query = (stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
