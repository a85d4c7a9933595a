"""An upsert sink: a table of the latest row of each key, in versions, fed by batches or by a stream."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.graph import filesystem, materialised

DELETED = "deleted"


class VersionedTable:
    """Rows by key below a path that Spark writes; a version is a small file that names one folder of rows a bucket of keys.

    A batch of changes writes the buckets that it touches to new folders, and then the next version's file,
    which a rename puts in place.  A writer that is lost before that leaves the last version as it was, and
    folders that nothing reads; ``vacuum`` removes those.  A batch whose number is not above the last
    version's is a replay and changes nothing.  Of rows with one key the greatest by ``order`` stays, whatever
    batch brings it, so late batches do no harm.  A removal is a row with ``deleted`` true; it is kept as
    long as the table, so that a late older row does not bring the key back.  Null keys are a key like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: Sequence[str], buckets: int = 16):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, list(order), buckets
        self.schema = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(DELETED, T.BooleanType())])

    def _list(self, folder: str) -> list[str]:
        files, at = filesystem(self.spark, f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []

    def versions(self) -> list[int]:
        return [int(name) for name in self._list("versions") if name.isdigit()]

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": -1, "batch": None, "folders": {}}
        version = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/versions/{version:020d}").first()[0]
        return json.loads(text) | {"version": version}

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given, without those that are removed."""
        return self._rows(sorted(self._manifest(version)["folders"].values())).filter(~F.col(DELETED)).drop(DELETED)

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = self.schema.names
        top = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(*self.order)).alias("r"))
        return top.select(*[F.col("r").getField(n).alias(n) for n in names])

    def upsert(self, changes: DataFrame, batch: int | None = None) -> bool:
        """Apply a batch of changes; False if it was a replay.  Changes without ``deleted`` remove nothing."""
        last = self._manifest()
        if batch is not None and last["batch"] is not None and batch <= last["batch"]:
            return False
        if DELETED not in changes.columns:
            changes = changes.withColumn(DELETED, F.lit(False))
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        new = materialised(self._latest(changes.select(*self.schema.names)).withColumn("bucket", bucket))
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        old = self._rows([last["folders"][b] for b in touched if b in last["folders"]])
        merged = self._latest(old.unionByName(new.drop("bucket"))).withColumn("bucket", bucket)
        name = uuid.uuid4().hex
        merged.write.partitionBy("bucket").parquet(f"{self.path}/rows/{name}")
        folders = last["folders"] | {b: f"{name}/bucket={b}" for b in touched}
        self._commit(last["version"] + 1, {"batch": last["batch"] if batch is None else batch, "folders": folders})
        return True

    def _commit(self, version: int, manifest: dict) -> None:
        """Put the version's file in place; an error if another writer was faster."""
        files, draft = filesystem(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{version:020d}")
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions, and folders that those left do not read."""
        old, left = self.versions()[:-keep], self.versions()[-keep:]
        read = {f.split("/")[0] for v in left for f in self._manifest(v)["folders"].values()}
        for name in [f"versions/{v:020d}" for v in old] + [f"rows/{f}" for f in self._list("rows") if f not in read]:
            files, at = filesystem(self.spark, f"{self.path}/{name}")
            files.delete(at, True)

    def writer(self, changes: DataFrame, checkpoint: str) -> DataStreamWriter:
        """The stream of changes as a writer to this table, to be started."""
        return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.upsert(rows, batch) and None)
