"""Tables kept as files by hash of a key, whose upserts rewrite only the parts that a batch touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "__part"


class VersionedTable:
    """A table at a path of any store: data/<batch>/__part=<k> holds rows whose key hashes to k, versions/<n>.json says
    which batch holds each part of version n. Readers take the greatest version; a version appears by one rename after
    its data is whole, so that a batch that fails, or that two writers begin, leaves the table as it was. One batch at a time
    wins: of two that begin from one version the second fails and can be run again."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, parts: int = 64):
        self.spark, self.path, self.key, self.schema, self.parts = spark, path.rstrip("/"), key, schema, parts
        self._path = lambda *p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *p]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """0 before the first batch."""
        if not self._fs.exists(self._path("versions")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _places(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0])

    def _read(self, places: dict[str, str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{batch}/{PART}={k}" for k, batch in places.items()])

    def read(self, version: int | None = None) -> DataFrame:
        """The table of a version, the latest if none is named."""
        return self._read(self._places(self.version() if version is None else version))

    def _part(self, df: DataFrame):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int")

    def upsert(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Make merge(old rows, changes) the next version and return its number. Only parts that hold a key of changes
        are read and written (parts bounds how many there are); merge must keep rows in their keys' parts, that
        is, answer for keys of the two alone. Without changes the version stays."""
        begun = self.version()
        places = self._places(begun)
        touched = [r[0] for r in changes.select(self._part(changes)).distinct().collect()]
        if not touched:
            return begun
        old = self._read({k: places[k] for k in map(str, touched) if k in places})
        batch = uuid.uuid4().hex
        out = merge(old, changes).select(*self.schema.names)
        out.withColumn(PART, self._part(out)).repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/data/{batch}")
        kept = {k: b for k, b in places.items() if int(k) not in touched}
        written = {f.getPath().getName().split("=")[1]: batch for f in self._fs.listStatus(self._path("data", batch)) if f.getPath().getName().startswith(PART)}
        self._publish(begun + 1, kept | written)
        return begun + 1

    def _publish(self, version: int, places: dict[str, str]) -> None:
        draft = self._path("drafts", uuid.uuid4().hex)
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(places).encode()))
        stream.close()
        self._fs.mkdirs(self._path("versions"))
        target = self._path("versions", f"{version}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"version {version} is there already: another batch came first")
