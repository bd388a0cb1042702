"""Parquet tables in hash buckets of a key, with a manifest: an upsert rewrites the buckets it touches, an append that must not
repeat keys opens the files that may hold them.

Each change writes its files into a folder of its own and then a manifest, a single small file that lists what the table is
made of from then on. A run that fails before that leaves the table as it was, and the next one replaces its folder. A Bloom
filter of each file's keys lies beside the data and is read for the touched buckets only. Small files of a bucket are merged
level by level, so a bucket has at most ``FANOUT`` files of each level. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.utils import AnalysisException

#: Rows of one file; files of one level and bucket that are merged into one of the next; bits of a Bloom filter per key.
RECORDS_PER_FILE, FANOUT, BITS_PER_KEY, PROBES = 1_000_000, 8, 12, 6
VERSION, BUCKET = "__version", "__bucket"
ENTRY = f"file string, {BUCKET} int, level int, rows long"


def bloom_bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of the keys' probes in a filter of ``size`` bits, one row per key."""
    u = hashes.astype(np.int64).view(np.uint64)
    low, high = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)


def bloom_filter(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(hashes) * BITS_PER_KEY // 64) * 64), np.uint8)
    bits[bloom_bits(hashes, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def bloom_may_hold(bloom: bytes, hashes: np.ndarray) -> bool:
    """Whether any of the keys may be in the file; False is certain."""
    bits = np.unpackbits(np.frombuffer(bloom, np.uint8))
    return bool(bits[bloom_bits(hashes, len(bits))].all(axis=1).any())


@dataclass
class KeyedTable:
    """The table at ``path`` with rows of ``schema``, dealt by ``key`` over ``buckets``. The number of buckets never changes.

    ``opened`` and ``rewritten`` tell the last change's work: stored files read to look keys up, and buckets written anew.
    """

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 64
    opened: list[str] = field(default_factory=list)
    rewritten: list[int] = field(default_factory=list)

    # --- reading ---

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{ENTRY}, {VERSION} long").parquet(f"{self.path}/_manifest")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def exists(self) -> bool:
        return self._manifests() is not None

    def entries(self) -> tuple[int, list]:
        """(version, its files); version 0 is the empty table. A row without a file stands for a table without files."""
        all_ = self._manifests()
        last = None if all_ is None else all_.agg(F.max(VERSION)).first()[0]
        if last is None:
            return 0, []
        return last, all_.where((F.col(VERSION) == last) & F.col("file").isNotNull()).orderBy("file").collect()

    def _read(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])

    def rows(self) -> DataFrame:
        return self._read([e.file for e in self.entries()[1]])

    # --- writing ---

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, level: int, tasks: int) -> list[tuple]:
        """Write rows into the version's folder, with a Bloom filter per file; the new entries."""
        folder = f"{self.path}/{VERSION}={version}/level={level}"
        dealt = rows.withColumn(BUCKET, self.bucket()).repartition(max(1, tasks), BUCKET)
        dealt.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE).partitionBy(BUCKET).parquet(folder)
        prefix = f"{VERSION}={version}/level={level}/"
        try:
            stored = self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, IntegerType())).parquet(folder)
        except AnalysisException as err:  # no rows, no files
            if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        place = F.concat(F.lit(prefix), F.regexp_extract(F.col("_metadata.file_path"), rf"({BUCKET}=[^/]*/[^/]*)$", 1))
        keyed = stored.select(place.alias("file"), F.col(BUCKET), F.xxhash64(self.key).alias("h"))

        def filters(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"file": group["file"].iloc[:1], BUCKET: group[BUCKET].iloc[:1], "rows": len(group), "bloom": [bloom_filter(group["h"].to_numpy())]})

        # A group is one file's key hashes: at most RECORDS_PER_FILE numbers.
        found = keyed.groupBy("file").applyInPandas(filters, f"file string, {BUCKET} int, rows long, bloom binary")
        blooms = f"{self.path}/_bloom/{VERSION}={version}/level={level}"
        found.write.mode("overwrite").parquet(blooms)
        written = self.spark.read.parquet(blooms).select("file", BUCKET, "rows").collect()
        return [(e.file, e[BUCKET], level, e.rows) for e in written]

    def _commit(self, version: int, entries: Sequence[tuple]) -> None:
        rows = self.spark.createDataFrame([tuple(e)[:4] for e in entries] or [(None, None, None, None)], ENTRY)
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/_manifest/{VERSION}={version}")

    def rewrite(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the rows of the buckets that ``new`` touches by ``merge(their rows, new)``; the version made."""
        version, entries = self.entries()
        # At most as many rows as there are buckets.
        self.rewritten = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())
        touched = set(self.rewritten)
        old = [e for e in entries if e[BUCKET] in touched]
        self.opened = [e.file for e in old]
        merged = merge(self._read(self.opened), new).select(*self.schema.names)
        added = self._write(merged, version + 1, 0, len(touched))
        self._commit(version + 1, [*(e for e in entries if e[BUCKET] not in touched), *added])
        return version + 1

    def may_hold(self, keys: DataFrame, entries: Sequence) -> list[str]:
        """Files that may hold one of ``keys`` (``__bucket, h``), told by their Bloom filters."""
        touched = sorted(r[0] for r in keys.select(BUCKET).distinct().collect())
        at = {e.file for e in entries if e[BUCKET] in set(touched)}
        if not at:
            return []
        folders = sorted({f"{self.path}/_bloom/{f.rsplit('/', 2)[0]}" for f in at})
        blooms = self.spark.read.schema(f"file string, {BUCKET} int, bloom binary").parquet(*folders).where(F.col(BUCKET).isin(touched))

        def test(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            hashes = asked["h"].to_numpy()
            held = [f for f, b in zip(known["file"], known["bloom"], strict=True) if len(hashes) and bloom_may_hold(b, hashes)]
            return pd.DataFrame({"file": pd.Series(held, dtype=object)})

        found = blooms.groupBy(BUCKET).cogroup(keys.groupBy(BUCKET)).applyInPandas(test, "file string").collect()
        return sorted({r.file for r in found} & at)

    def create(self, new: DataFrame, first: Callable[[DataFrame, DataFrame | None], DataFrame]) -> int:
        """Append ``first(new, stored)``: what is new by key. ``stored`` has the keys of the files that may hold one of them."""
        version, entries = self.entries()
        keys = new.where(F.col(self.key).isNotNull()).select(self.bucket().alias(BUCKET), F.xxhash64(self.key).alias("h")).distinct()
        self.opened, self.rewritten = self.may_hold(keys, entries), []
        stored = self._read(self.opened).select(self.key) if self.opened else None
        added = self._write(first(new, stored).select(*self.schema.names), version + 1, 0, self.buckets)
        self._commit(version + 1, [*entries, *added])
        return self.compact()

    def compact(self) -> int:
        """Merge the files of a bucket's level into one of the next level where there are ``FANOUT`` of them; the version."""
        version, entries = self.entries()
        count: dict[tuple[int, int], int] = {}
        for e in entries:
            count[e[BUCKET], e.level] = count.get((e[BUCKET], e.level), 0) + 1
        full = {k for k, n in count.items() if n >= FANOUT}
        if not full:
            return version
        kept, added = [e for e in entries if (e[BUCKET], e.level) not in full], []
        for level in sorted({lv for _, lv in full}):
            files = [e.file for e in entries if e.level == level and (e[BUCKET], level) in full]
            added += self._write(self._read(files), version + 1, level + 1, len({b for b, lv in full if lv == level}))
        self._commit(version + 1, [*kept, *added])
        self.rewritten = sorted({b for b, _ in full})
        return version + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only versions before the last ``keep`` are made of; how many files and folders went."""
        all_ = self._manifests()
        if all_ is None:
            return 0
        versions = sorted(r[0] for r in all_.select(VERSION).distinct().collect())[-keep:]
        live = {r.file for r in all_.where(F.col(VERSION).isin(versions)).select("file").distinct().collect()}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs, gone = root.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        base = fs.getFileStatus(root).getPath().toString()
        files = fs.listFiles(root, True)
        paths = []
        while files.hasNext():
            paths.append(files.next().getPath().toString())
        for p in paths:
            name = p[len(base) + 1:]
            top = name.split("/")[0]
            number = int((name if not top.startswith("_") or "=" in top else name.split("/", 1)[1]).split("/")[0].split("=")[1])
            old = (top == "_manifest" and number not in versions) or (
                top == "_bloom" and not any(f and f.startswith(f"{VERSION}={number}/") for f in live)) or (
                "=" in top and number <= versions[-1] and name not in live and name.endswith(".parquet"))
            if old and number <= versions[-1]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(p), False)
                gone += 1
        return gone
