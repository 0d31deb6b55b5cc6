"""Stored tables with snapshots: files are staged, and one rename of a manifest commits them.

A table is a folder of ``data`` (a folder of files for each write, never changed) and ``manifests`` (one small JSON document a version, naming the
folders that make up the table). Readers take the newest manifest, or a version they name, and read exactly its folders; a job that
dies before its rename leaves the older version as it was. Two writers of one version: the second rename finds the name taken and
raises ``CommitConflict``. A write that names its batch is committed once: the same batch again changes nothing.

With a key, rows are dealt into buckets by its hash. ``upsert`` writes the incoming rows alone, as a new layer of the buckets they fall
in; reading puts newer layers over older ones, in the buckets that have layers. A bucket whose layers are more than LAYERS, or together
over COMPACT of its base, is written anew within the same commit. So what an upsert writes follows what comes in, not what is stored.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
LAYERS = 8
COMPACT = 0.5
#: Batches that a manifest remembers.
BATCHES = 1000


class CommitConflict(RuntimeError):
    """Another writer has committed this version first."""


@dataclass(frozen=True)
class Part:
    """A folder of files: of one bucket (-1: not bucketed) and layer (0: the base)."""

    folder: str
    bucket: int
    layer: int
    size: int


@dataclass(frozen=True)
class Snapshot:
    version: int
    fmt: str
    schema: str
    key: str | None
    buckets: int
    parts: tuple[Part, ...] = ()
    batches: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        return sum(p.size for p in self.parts)


@dataclass(frozen=True)
class Written:
    """What a write did: bytes written, of them by compaction, bytes stored after it, buckets touched and compacted."""

    version: int
    written: int = 0
    compacted: int = 0
    stored: int = 0
    touched: tuple[int, ...] = field(default=())
    rewritten: tuple[int, ...] = field(default=())


class StoredTable:
    """A table under a folder. ``key``, ``buckets`` and ``fmt`` hold for a table that is not there yet."""

    def __init__(self, spark: SparkSession, folder: str, key: str | None = None, buckets: int = BUCKETS, fmt: str = "parquet") -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(self._conf)
        now = self.snapshot()
        self.key, self.buckets, self.fmt = (now.key, now.buckets, now.fmt) if now else (key, buckets if key else 0, fmt)

    def _path(self, name: str):  # noqa: ANN202 - a Java object
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _list(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    # ---- manifests ----

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._list("manifests") if n.startswith("v") and n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        found = self.versions()
        if version is not None and version not in found:
            raise ValueError(f"no version {version} of {self.folder}")
        if not found:
            return None
        stream = self._fs.open(self._path(f"manifests/v{version or found[-1]:010d}.json"))
        try:
            raw = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(**{**raw, "parts": tuple(Part(**p) for p in raw["parts"]), "batches": tuple(raw["batches"])})

    def _commit(self, snapshot: Snapshot) -> None:
        staged = self._path(f"manifests/staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged)
        out.write(json.dumps(asdict(snapshot)).encode())
        out.close()
        context = self._hadoop.FileContext.getFileContext(staged.toUri(), self._conf)
        rename = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE  # fails where the name is taken
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(self._path(f"manifests/v{snapshot.version:010d}.json")), how)
        except Exception as e:
            self._fs.delete(staged, False)
            if snapshot.version in self.versions():
                raise CommitConflict(f"version {snapshot.version} of {self.folder} is another writer's") from e
            raise

    # ---- data ----

    def _stage(self, df: DataFrame, layer: int) -> tuple[Part, ...]:
        """Write df to a folder of its own that nothing reads yet."""
        name = f"data/{uuid.uuid4().hex}"
        if not self.buckets:
            df.write.format(self.fmt).save(f"{self.folder}/{name}")
            return (Part(name, -1, layer, self._size(name)),)
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        df.withColumn("_bucket", bucket).hint("rebalance", F.col("_bucket")).write.format(self.fmt).partitionBy("_bucket").save(f"{self.folder}/{name}")
        found = [n for n in self._list(name) if n.startswith("_bucket=")]
        return tuple(Part(f"{name}/{n}", int(n[8:]), layer, self._size(f"{name}/{n}")) for n in found)

    def _size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def _rows(self, parts: list[Part], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{p.folder}" for p in parts]
        reader = self.spark.read.format(self.fmt).schema(StructType.fromJson(json.loads(schema)))
        return reader.load(paths) if paths else self.spark.createDataFrame([], StructType.fromJson(json.loads(schema)))

    def _merged(self, parts: list[Part], schema: str) -> DataFrame:
        """Rows of the parts, newer layers over older ones by key. Buckets of a single layer are read as they are."""
        layers: dict[int, set[int]] = {}
        for p in parts:
            layers.setdefault(p.bucket, set()).add(p.layer)
        flat = self._rows([p for p in parts if len(layers[p.bucket]) == 1], schema)
        rest = [p for p in parts if len(layers[p.bucket]) > 1]
        if not rest:
            return flat
        by_layer = [self._rows([p for p in rest if p.layer == n], schema).withColumn("_layer", F.lit(n)) for n in sorted({p.layer for p in rest})]
        newest = W.partitionBy(self.key).orderBy(F.desc("_layer"))
        top = reduce(DataFrame.unionByName, by_layer).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_layer")
        return flat.unionByName(top)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of its newest version or the one named; None if it was never written."""
        now = self.snapshot(version)
        return None if now is None else self._merged(list(now.parts), now.schema)

    def rows_of(self, keys: list, version: int | None = None) -> DataFrame | None:
        """Rows of a few keys: only the buckets that their hashes name are read."""
        now = self.snapshot(version)
        if now is None or not now.key:
            raise ValueError("keys are looked up in a stored table with a key")
        kind = StructType.fromJson(json.loads(now.schema))[now.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add(now.key, kind))
        buckets = {r[0] for r in asked.select(F.pmod(F.xxhash64(F.col(now.key)), F.lit(now.buckets))).collect()}
        return self._merged([p for p in now.parts if p.bucket in buckets], now.schema).join(F.broadcast(asked.distinct()), now.key, "left_semi")

    # ---- writes ----

    def _known(self, batch: str | None, now: Snapshot | None) -> Written | None:
        return Written(now.version, stored=now.size) if batch is not None and now and batch in now.batches else None

    def _next(self, now: Snapshot | None, schema: StructType, parts: tuple[Part, ...], batch: str | None) -> Snapshot:
        batches = ((*(now.batches if now else ()), batch) if batch is not None else now.batches if now else ())[-BATCHES:]
        return Snapshot((now.version if now else 0) + 1, self.fmt, schema.json(), self.key, self.buckets, parts, tuple(batches))

    def overwrite(self, df: DataFrame, batch: str | None = None) -> Written:
        """The table becomes df, which may be made from the table itself. With a key, one row a key stays (the smallest by hash of the rest)."""
        now = self.snapshot()
        if known := self._known(batch, now):
            return known
        parts = self._stage(one_per_key(df, self.key) if self.key else df, 0)
        after = self._next(now, df.schema, parts, batch)
        self._commit(after)
        return Written(after.version, after.size, 0, after.size, tuple(sorted({p.bucket for p in parts})))

    def upsert(self, df: DataFrame, batch: str | None = None) -> Written:
        """Incoming rows over stored ones of the same key."""
        if not self.key:
            raise ValueError("upsert needs a table with a key")
        now = self.snapshot()
        if now is None:
            return self.overwrite(df, batch)
        if known := self._known(batch, now):
            return known
        schema = StructType.fromJson(json.loads(now.schema))
        schema = StructType([*schema.fields, *(f for f in df.schema.fields if f.name not in schema.names)])
        new = self._stage(one_per_key(df, self.key), 1 + max((p.layer for p in now.parts), default=0))
        parts = (*now.parts, *new)
        touched = {p.bucket for p in new}
        due = set()
        for b in touched:
            base = sum(p.size for p in now.parts if p.bucket == b and p.layer == 0)
            above = [p for p in parts if p.bucket == b and p.layer > 0]
            if not base or len({p.layer for p in above}) > LAYERS or sum(p.size for p in above) > COMPACT * base:
                due.add(b)
        rewritten: tuple[Part, ...] = ()
        lone = {b for b in due if len([p for p in parts if p.bucket == b]) == 1}  # nothing to merge: the layer is the base
        if due - lone:
            rewritten = self._stage(self._merged([p for p in parts if p.bucket in due - lone], schema.json()), 0)
        kept = tuple(replace(p, layer=0) if p.bucket in lone else p for p in parts if p.bucket not in due - lone)
        after = self._next(now, schema, (*kept, *rewritten), batch)
        self._commit(after)
        compacted = sum(p.size for p in rewritten)
        return Written(after.version, sum(p.size for p in new) + compacted, compacted, after.size, tuple(sorted(touched)), tuple(sorted(due - lone)))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests but the newest ``keep``, and data that none of these names, such as that of jobs that died. No write may be under way."""
        kept = self.versions()[-max(1, keep) :]
        for v in set(self.versions()) - set(kept):
            self._fs.delete(self._path(f"manifests/v{v:010d}.json"), False)
        for n in self._list("manifests"):
            if n.startswith("staged-"):
                self._fs.delete(self._path(f"manifests/{n}"), False)
        named = {p.folder.split("/")[1] for v in kept for p in self.snapshot(v).parts}
        gone = [n for n in self._list("data") if n not in named]
        for n in gone:
            self._fs.delete(self._path(f"data/{n}"), True)
        return gone


def one_per_key(df: DataFrame, key: str | Column) -> DataFrame:
    """One row of each key: that with the smallest hash of its other columns."""
    others = sorted(c for c in df.columns if c != key)
    tie = F.xxhash64(*others) if others else F.lit(0)
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(tie))).where("_n = 1").drop("_n")
