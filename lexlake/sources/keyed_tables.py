"""Tables with a primary key, kept in buckets of which a merge rewrites those it touches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.functions.columns import to_micros
from lexlake.operators.incremental import max_value, newer_than
from lexlake.session import shuffles_dropped
from lexlake.sources.append_tables import check_location, ensure_database
from lexlake.sources.files import (
    bucket_folder,
    delete_folder,
    exists,
    last_version,
    make_folder,
    numbered_folders,
    qualify,
    read_text,
    subfolders,
    write_text,
)
from lexlake.spec import UPDATED_AT, TableSpec

BUCKET, STAMP = "bucket", "stamp"
_MANIFEST = "_manifest"
_VERSION_PROPERTY = "lexlake.version"
# partitions named in one statement
_BATCH = 500


@dataclass
class _Manifest:
    """What a version consists of: where each bucket lies, and which changes are on record."""

    version: int = 0
    # bucket number (as text, for JSON) -> version whose folder holds it; buckets without rows are absent
    buckets: dict[str, int] = field(default_factory=dict)
    # newest stamp in the table, in epoch microseconds
    stamp: int | None = None
    # stamps whose changed rows are kept, ascending; those after ``since`` are all there
    changes: list[int] = field(default_factory=list)
    since: int | None = None


class KeyedTable:
    """The current state of a keyed table, and the rows its last merges changed.

    The catalog table is partitioned by bucket, and each bucket has a location of its own. A merge reads and writes only the
    buckets its updates fall in, in a new version folder; a manifest, renamed into place, makes the version count, and then
    the partitions of these buckets are pointed at it. A table that is opened follows the newest manifest, so a run that
    died in between is finished by the next one, and an uncommitted version never shows. Version folders are not written
    over while they are read; a bucket's folder goes when `keep` later versions have another.

    Files are Parquet, hash-bucketed and sorted on the spec's ``bucketed_by`` columns; the partition is the bucket, so joins
    on these columns, and the merges themselves, do not shuffle the stored rows. Choose ``buckets`` so that one bucket
    fits a task (thousands, for a large table), and the same for tables that are joined. To change it, open a table with
    the other number at a new path and make this one's snapshot its first version: ``new.replace(old.snapshot())``.

    The rows that a merge changed are also kept by themselves, a folder per stamp, for the last ``keep_changes`` merges. Who
    follows the table reads these in place of the table.
    """

    def __init__(
        self,
        spark: SparkSession,
        spec: TableSpec,
        path: str,
        buckets: int | None = None,
        keep: int = 1,
        keep_changes: int = 10,
    ):
        self.spark = spark
        self.spec = spec
        self.path = path
        self.folder, self.buckets = bucket_folder(spark, path, buckets)
        self.changes_folder = f"{self.folder}/changes"
        self.keep = keep
        self.keep_changes = keep_changes
        self.database, self.full_name = ensure_database(spark, path)
        self._newest = _Manifest()
        self._registered: set[int] = set()
        self.ensure()

    # ---- state ----------------------------------------------------------------------------------------------------

    def _version_folder(self, version: int) -> str:
        return f"{qualify(self.spark, self.folder)}/version={version}"

    def _committed(self) -> list[int]:
        return [
            n for n in numbered_folders(self.spark, self.folder)
            if exists(self.spark, f"{self.folder}/version={n}/{_MANIFEST}")
        ]

    def _read_manifest(self, version: int) -> _Manifest:
        return _Manifest(**json.loads(read_text(self.spark, f"{self.folder}/version={version}/{_MANIFEST}")))

    def manifest(self) -> _Manifest:
        """Of the newest complete version; read once per version, and no data file with it."""
        committed = self._committed()
        version = committed[-1] if committed else 0
        if version != self._newest.version:
            self._newest = self._read_manifest(version) if version else _Manifest()
        return self._newest

    def ensure(self) -> None:
        """Create the catalog table if it is missing and point its partitions at the newest complete version."""
        check_location(self.spark, self.full_name, self.folder)
        # tells the number of buckets to who opens the table before its first write
        make_folder(self.spark, self.folder)
        by = ", ".join(self.spec.bucketed_by)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.full_name} ({self.spec.ddl}, {BUCKET} int) USING parquet "
            f"PARTITIONED BY ({BUCKET}) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS "
            f"LOCATION '{qualify(self.spark, self.folder)}'"
        )
        listed = self.spark.sql(f"SHOW PARTITIONS {self.full_name}").collect()
        self._registered = {int(r["partition"].rpartition("=")[2]) for r in listed}
        properties = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.full_name}").collect()}
        shown = int(properties.get(_VERSION_PROPERTY, 0))
        if shown != self.manifest().version:
            self._point_to(self._newest, shown)

    def _point_to(self, manifest: _Manifest, shown: int) -> None:
        """Bring the catalog from version ``shown`` to the manifest's: only buckets written since then change."""
        wanted = {int(b): v for b, v in manifest.buckets.items()}
        added = []
        for bucket, version in sorted(wanted.items()):
            place = f"PARTITION ({BUCKET}={bucket})"
            location = f"'{self._version_folder(version)}/{BUCKET}={bucket}'"
            if bucket not in self._registered:
                added.append(f"{place} LOCATION {location}")
            elif version > shown:
                self.spark.sql(f"ALTER TABLE {self.full_name} {place} SET LOCATION {location}")
        for at in range(0, len(added), _BATCH):
            self.spark.sql(f"ALTER TABLE {self.full_name} ADD IF NOT EXISTS {' '.join(added[at : at + _BATCH])}")
        gone = [f"PARTITION ({BUCKET}={b})" for b in sorted(self._registered - set(wanted))]
        for at in range(0, len(gone), _BATCH):
            self.spark.sql(f"ALTER TABLE {self.full_name} DROP IF EXISTS {', '.join(gone[at : at + _BATCH])}")
        self._registered = set(wanted)
        self.spark.sql(
            f"ALTER TABLE {self.full_name} SET TBLPROPERTIES ('{_VERSION_PROPERTY}'='{manifest.version}')"
        )
        self.spark.catalog.refreshTable(self.full_name)

    # ---- reading --------------------------------------------------------------------------------------------------

    def snapshot(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets, of which alone the files are read."""
        table = self.spark.table(self.full_name)
        if buckets is not None:
            table = table.where(F.col(BUCKET).isin(sorted(buckets)))
        return table.select(*self.spec.attributes)

    def newest_stamp(self) -> int | None:
        """Largest stamp in the table, in epoch microseconds; None if it is empty. No data is read."""
        return self.manifest().stamp

    def changes_since(self, since: int | None) -> DataFrame:
        """Rows stamped later than ``since``, as they are now: the whole table if that is None.

        They come from the folders of the merges after ``since``. Where these have been cleared away, as for a follower that
        is far behind, the table is searched.
        """
        if since is None:
            return self.snapshot()
        known = self.manifest()
        if known.since is None or since < known.since:
            return newer_than(self.snapshot(), since)
        stamps = [s for s in known.changes if s > since]
        if not stamps:
            return self.snapshot([])
        fields = [*self.spec.schema.fields, T.StructField(STAMP, T.LongType())]
        kept = self.spark.read.schema(T.StructType(fields)).parquet(self.changes_folder)
        rows = kept.where(F.col(STAMP).isin(stamps)).select(*self.spec.attributes)
        if len(stamps) == 1:
            return rows
        # a later merge may have changed a row again, or dropped it: its bucket tells
        return newer_than(self.snapshot(self.touched(rows)), since)

    # ---- writing --------------------------------------------------------------------------------------------------

    def aligned(self, updates: DataFrame) -> DataFrame:
        """Updates partitioned like the stored buckets, so that a merge moves the updates and not the table."""
        return updates.repartition(self.buckets, *self.spec.bucketed_by)

    def _bucket_of(self) -> Column:
        """The number Spark gives a row's bucket."""
        return F.pmod(F.hash(*self.spec.bucketed_by), F.lit(self.buckets))

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that rows with these keys fall in: at most one number per bucket reaches the driver."""
        return [r[BUCKET] for r in keys.select(self._bucket_of().alias(BUCKET)).distinct().collect()]

    def merge(
        self,
        updates: DataFrame,
        merged: Callable[[DataFrame, DataFrame], DataFrame],
        stamp: datetime,
        buckets: Iterable[int] | None = None,
    ) -> DataFrame:
        """Make ``merged(current, updates)`` the next state of the buckets of ``updates``, the others stay as they are.

        ``updates`` is read more than once. ``buckets`` names them where they are known already; without any only the stamp
        is noted.
        """
        buckets = self.touched(updates) if buckets is None else list(buckets)
        if not buckets:
            return self.note(stamp)
        return self._commit(merged(self.snapshot(buckets), self.aligned(updates)), buckets, to_micros(stamp))

    def note(self, stamp: datetime) -> DataFrame:
        """Note that the table is up to date at ``stamp`` though no row changed, so that it falls behind no record of changes."""
        return self._commit(None, [], to_micros(stamp))

    def replace(self, df: DataFrame, stamp: datetime | None = None) -> DataFrame:
        """Make ``df``, which may read the current version, the next state of the whole table."""
        return self._commit(df, None, None if stamp is None else to_micros(stamp))

    def _commit(self, df: DataFrame | None, buckets: list[int] | None, stamp: int | None) -> DataFrame:
        before = self.manifest()
        version = last_version(self.spark, self.folder) + 1
        next_one = _Manifest(version, dict(before.buckets), stamp, list(before.changes), before.since)
        if df is not None:
            incoming = f"{self.full_name[:-1]}__v{version}`"
            self._write(df, version, incoming)
            found = {f.removeprefix(f"{BUCKET}=") for f in subfolders(self.spark, self._version_folder(version)) if "=" in f}
            for bucket in before.buckets if buckets is None else map(str, buckets):
                next_one.buckets.pop(bucket, None)
            next_one.buckets.update(dict.fromkeys(found, version))
            if buckets is None or not before.buckets:
                # all is new: who follows the table has to read all of it
                if stamp is None:
                    next_one.stamp = max_value(self.spark.table(incoming), UPDATED_AT)
                next_one.changes, next_one.since = [], next_one.stamp
            else:
                self._keep_changes(self.spark.table(incoming), next_one)
            self.spark.sql(f"DROP TABLE {incoming}")
        next_one.stamp = max((s for s in (next_one.stamp, before.stamp) if s is not None), default=None)
        write_text(self.spark, f"{self._version_folder(version)}/{_MANIFEST}", json.dumps(asdict(next_one)))
        self._point_to(next_one, before.version)
        self._newest = next_one
        self._clear(next_one)
        return self.snapshot()

    def _write(self, df: DataFrame, version: int, incoming: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {incoming}")
        with shuffles_dropped(self.spark):
            (
                df.select(*self.spec.attributes, self._bucket_of().alias(BUCKET))
                .write.format("parquet")
                .partitionBy(BUCKET)
                .bucketBy(self.buckets, *self.spec.bucketed_by)
                .sortBy(*self.spec.bucketed_by)
                .option("path", self._version_folder(version))
                .mode("overwrite")
                .saveAsTable(incoming)
            )

    def _keep_changes(self, written: DataFrame, manifest: _Manifest) -> None:
        """Put the rows of this merge into a folder of their own, and let the oldest ones go."""
        stamp = manifest.stamp
        fresh = written.where(F.col(UPDATED_AT) == F.timestamp_micros(F.lit(stamp)))
        fresh.select(*self.spec.attributes).write.mode("overwrite").parquet(f"{self.changes_folder}/{STAMP}={stamp}")
        manifest.changes.append(stamp)
        while len(manifest.changes) > self.keep_changes:
            manifest.since = manifest.changes.pop(0)

    def _clear(self, newest: _Manifest) -> None:
        """Delete what neither the newest version nor the ``keep`` before it refer to, and what was never committed."""
        committed = self._committed()
        kept = [self._read_manifest(n) for n in committed[:-1][-self.keep :]] if self.keep else []
        kept.append(newest)
        needed = {(b, v) for m in kept for b, v in m.buckets.items()}
        oldest = kept[0].version
        for n in numbered_folders(self.spark, self.folder):
            if n >= oldest:
                continue
            folder = f"{self.folder}/version={n}"
            if not any(v == n for _, v in needed):
                delete_folder(self.spark, folder)
                continue
            for name in subfolders(self.spark, folder):
                if (name.removeprefix(f"{BUCKET}="), n) not in needed:
                    delete_folder(self.spark, f"{folder}/{name}")
        stamps = {f"{STAMP}={s}" for m in kept for s in m.changes}
        for name in subfolders(self.spark, self.changes_folder):
            if name not in stamps:
                delete_folder(self.spark, f"{self.changes_folder}/{name}")
