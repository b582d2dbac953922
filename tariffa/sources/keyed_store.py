"""A stored table of keyed rows: versioned folders, one manifest a commit, and an upsert that shuffles only the batch.

Layout under the root:

    data/ver=<id>/month=<yyyy-MM>/...   Parquet, bucketed and sorted by a digest of the key; never changed once written
    manifests/<n>.json                  version n: which `ver` holds each month, schema, key, buckets, last batch of each writer

A commit writes new folders, then one manifest under a name that must not exist yet. That rename is the only change that readers
can see: a reader takes the highest manifest and reads the folders it lists, so it sees whole batches, and goes on
seeing its version while later batches are committed. A batch that fails before the rename leaves folders that no manifest lists; run again it
writes others. A batch that is run again after the rename finds its number in the manifest and does nothing.

An upsert rewrites the months it touches. Their old rows are read bucket by bucket and joined to the digests of the batch on the
bucket column, so only the batch is shuffled; the kept rows are written by the task that read their bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

KEY = ("property_id", "channel", "arrival_date", "nights", "room_type_canonical")
DIGEST, MONTH, VERSION = "_key", "month", "ver"
#: More months of arrival dates than any calendar of stays has.
MOST_MONTHS = 2400


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def key_digest(keys: Sequence[str]) -> Column:
    """A digest of the key as text, with null as ''; lengths are part of it, so no two keys give the same text."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat(*[x for t in text for x in (F.length(t).cast("string"), F.lit(":"), t)]).cast("binary"))


def month_of(date: str) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


@dataclass(frozen=True)
class Manifest:
    """One version of a table."""
    number: int
    schema: str
    keys: tuple[str, ...]
    date: str
    buckets: int
    months: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class KeyedStore:
    """A table at a root folder. `keys` must hold the date column, as all rows of a key lie in one month."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = KEY, date: str = "arrival_date", buckets: int | None = None):
        if date not in keys:
            raise ValueError(f"the keys must hold {date}: months are replaced as a whole")
        self.spark, self.root, self.keys, self.date = spark, root.rstrip("/"), tuple(keys), date
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -------------------------------------------------------------- files
    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest | None:
        """The newest version, or the one asked for; None if there is none yet."""
        known = self.versions()
        if not known and number is None:
            return None
        if number is not None and number not in known:
            raise ValueError(f"no version {number} of {self.root}")
        path, fs = self._path(f"manifests/{known[-1] if number is None else number}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        own = json.loads(text)
        return Manifest(**own | {"keys": tuple(own["keys"])})

    def _commit(self, new: Manifest) -> None:
        """The manifest under its number: written aside, then renamed, which fails where the name is taken."""
        aside, fs = self._path(f"manifests/.{new.number}-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(new.__dict__).encode()))
        finally:
            out.close()
        target, _ = self._path(f"manifests/{new.number}.json")
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Conflict(f"version {new.number} of {self.root} is taken")

    # -------------------------------------------------------------- reading
    def read(self, number: int | None = None, schema: StructType | str | None = None) -> DataFrame:
        """The rows of a version, without the store's own columns. Without any version an empty table of `schema`."""
        own = self.manifest(number)
        if own is None:
            if schema is None:
                raise ValueError(f"no version of {self.root} yet")
            return self.spark.createDataFrame([], schema)
        names = StructType.fromJson(json.loads(own.schema))
        if not own.months:
            return self.spark.createDataFrame([], names)
        paths = [f"{self.root}/data/{VERSION}={v}/{MONTH}={m}" for m, v in sorted(own.months.items())]
        return self.spark.read.schema(names).parquet(*paths).select(*names.fieldNames())

    def _bucketed(self, own: Manifest, months: Sequence[str]) -> tuple[DataFrame | None, str]:
        """The stored rows of some months as a bucketed table of the session's catalog, and its name."""
        held = [m for m in months if m in own.months]
        if not held:
            return None, ""
        name, schema = f"keyed_{uuid.uuid4().hex}", StructType.fromJson(json.loads(own.schema))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE {name} ({columns}, {DIGEST} STRING, {VERSION} STRING, {MONTH} STRING) USING parquet PARTITIONED BY ({VERSION}, {MONTH}) "
                       f"CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {own.buckets} BUCKETS LOCATION '{self.root}/data'")
        parts = " ".join(f"PARTITION ({VERSION}='{own.months[m]}', {MONTH}='{m}')" for m in held)
        self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
        return self.spark.table(name), name

    # -------------------------------------------------------------- writing
    def kept(self, own: Manifest, batch: DataFrame, months: Sequence[str]) -> tuple[DataFrame | None, str]:
        """The stored rows of these months whose key is not in the batch (with its digest), bucket by bucket."""
        old, name = self._bucketed(own, months)
        if old is None:
            return None, ""
        fresh = batch.select(DIGEST).repartition(own.buckets, DIGEST).distinct().hint("merge")  # as many parts as buckets
        return old.drop(VERSION).join(fresh, DIGEST, "left_anti"), name

    def upsert(self, batch: DataFrame, writer: str | None = None, batch_id: int | None = None) -> Manifest:
        """Old rows whose key is not in the batch, and all rows of the batch, as the next version.

        The columns are those of the first batch; later ones lose extra columns and get nulls for missing ones. With a
        writer, a batch number that is not above its last one is skipped.
        """
        own = self.manifest()
        if own and writer is not None and own.batches.get(writer, -1) >= batch_id:
            return own
        if own is None:
            names = batch.schema
            own = Manifest(-1, json.dumps(json.loads(names.json())), self.keys, self.date, self.buckets)
        if own.keys != self.keys or own.date != self.date:
            raise ValueError(f"{self.root} is keyed by {own.keys}")
        names = StructType.fromJson(json.loads(own.schema))
        rows = batch.select(*[(F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in names.fields])
        rows = rows.withColumns({DIGEST: key_digest(self.keys), MONTH: month_of(self.date)})
        months = [r[MONTH] for r in rows.select(MONTH).distinct().limit(MOST_MONTHS + 1).collect()]
        if len(months) > MOST_MONTHS:
            raise ValueError(f"a batch with over {MOST_MONTHS} months of dates")
        new = replace(own, number=own.number + 1, batches=own.batches | ({writer: batch_id} if writer is not None else {}))
        if months:
            new = replace(new, months=own.months | dict.fromkeys(months, self._write(own, rows, months)))
        self._commit(new)
        return new

    def _write(self, own: Manifest, rows: DataFrame, months: Sequence[str]) -> str:
        """The new content of the months in a folder of its own; returns the folder's id."""
        ver = uuid.uuid4().hex
        added = rows.repartition(own.buckets, DIGEST)
        kept, name = self.kept(own, rows, months)
        content = added if kept is None else kept.select(*added.columns).unionByName(added)
        out = f"keyed_{uuid.uuid4().hex}"
        try:
            content.write.format("parquet").option("path", f"{self.root}/data/{VERSION}={ver}").partitionBy(MONTH).bucketBy(own.buckets, DIGEST).sortBy(DIGEST).saveAsTable(out)
        finally:
            for x in (name, out):  # external tables: only their names in the catalog go
                if x:
                    self.spark.sql(f"DROP TABLE IF EXISTS {x}")
        return ver

    def vacuum(self, keep: int = 2) -> list[tuple[str, str]]:
        """Delete all but the newest `keep` versions, and every (ver, month) folder that none of those lists; returns these.

        Not to be called beside a running upsert, whose folders no manifest lists yet.
        """
        known = self.versions()
        used = {(v, m) for n in known[-keep:] for m, v in self.manifest(n).months.items()}
        for n in known[:-keep]:
            path, fs = self._path(f"manifests/{n}.json")
            fs.delete(path, False)
        gone, parts = [], lambda folder, key: [n.removeprefix(f"{key}=") for n in self._names(folder) if n.startswith(f"{key}=")]
        for v in parts("data", VERSION):
            folder = f"data/{VERSION}={v}"
            months = parts(folder, MONTH)
            unused = [m for m in months if (v, m) not in used]
            for name in [folder] if len(unused) == len(months) else [f"{folder}/{MONTH}={m}" for m in unused]:
                path, fs = self._path(name)
                fs.delete(path, True)
            gone += [(v, m) for m in unused]
        return gone
