"""A versioned key-value store: Parquet change files and a log of atomic commits.

``<root>/_log/<version>.json`` holds the actions of one commit.  It is written
aside and then published whole under its name, which fails if that exists: the
only point where writers meet.  Every ``CHECKPOINT`` versions the folded log is
written too, so opening a store reads one checkpoint and the entries after it,
and a commit one entry.  Files of a commit that never happened are invisible.
Every commit has one sequence number; records of one commit are ordered by
``op_idx``.  All file access goes through Hadoop's file system.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import merge, read, stats
from keyloom.plans.envelope import CHANGE, DELETE, ORDERINGS, PUT, identity, sort_columns, sort_key, successor

DEFAULT = "default"
L0_TRIGGER, BASE_BYTES, CHECKPOINT = 4, 256 << 20, 32
#: So many footers the driver always reads itself, and all of files that are on average at least so large.
FOOTERS, LARGE = 64, 16 << 20
log = logging.getLogger("keyloom.store")


class StoreError(Exception):
    pass


class Conflict(StoreError):
    """Another commit wrote or read-locked what this one depends on."""


class Log:
    """Numbered JSON files, each published once, and checkpoints of what they fold to."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self._path(f"{root}/_log")
        self.fs = self.path.getFileSystem(self.conf)

    def _path(self, *parts):
        return self._jvm.org.apache.hadoop.fs.Path(*parts)

    def entries(self, after: int = 0) -> list[dict]:
        """The entries behind a version: they have no gaps, so the first missing one ends them."""
        out = []
        while self.fs.exists(self._path(self.path, f"{after + 1:020d}.json")):
            after += 1
            out.append(json.loads(self._read(f"{after:020d}.json")))
        return out

    def checkpoint(self) -> dict | None:
        """The newest folded log."""
        names = [n for n in self.children(f"{self.path.toString()}/_checkpoints") if n.endswith(".json")]
        return json.loads(self._read(f"_checkpoints/{max(names)}")) if names else None

    def _read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.path, name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, content: dict):
        target = self._path(self.path, name)
        out = self.fs.create(target, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        return target

    def append(self, version: int, entry: dict) -> bool:
        """False if this version exists already; a reader sees all of an entry or none of it."""
        aside = self._write(f".{uuid.uuid4().hex}", entry)
        target = self._path(self.path, f"{version:020d}.json")
        try:
            if self.fs.getUri().getScheme() == "file":  # a link fails if the name is taken, a local rename doesn't
                nio = self._jvm.java.nio.file
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                nio.Files.createLink(local(self.fs.makeQualified(target)), local(self.fs.makeQualified(aside)))
            else:
                options = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf).rename(aside, target, options)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        finally:
            self.fs.delete(aside, False)
        return True

    def save(self, version: int, state: dict) -> None:
        """Write a checkpoint; the five newest stay."""
        folder = f"{self.path.toString()}/_checkpoints"
        self.fs.mkdirs(self._path(folder))
        aside = self._write(f".{uuid.uuid4().hex}", state)
        if not self.fs.rename(aside, self._path(folder, f"{version:020d}.json")):
            self.fs.delete(aside, False)
        for name in sorted(n for n in self.children(folder) if n.endswith(".json"))[:-5]:
            self.fs.delete(self._path(folder, name), False)

    def remove_tree(self, path: str) -> None:
        self.fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)

    def children(self, path: str) -> list[str]:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since a folder last changed."""
        return time.time() - self.fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def bounds(self, path: str) -> list[dict]:
        """Key and sequence bounds of each data file of a folder.

        The driver needs about 20 ms for a footer, so many small files are read in a job instead.
        """
        total = self.fs.getContentSummary(self._path(path))
        small = total.getFileCount() > FOOTERS and total.getLength() < total.getFileCount() * LARGE
        return self._from_rows(path) if small else self._from_footers(path)

    def _from_rows(self, path: str) -> list[dict]:
        bounds = [f(c).alias(f"{n}_{c}") for c in ("key", "seq") for n, f in (("min", F.min), ("max", F.max))]
        each = self._spark.read.schema(CHANGE).parquet(path).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("entries"), *bounds)
        found = each.select("name", "entries", *(F.hex(c).alias(c) for c in ("min_key", "max_key")), "min_seq", "max_seq").collect()  # a row for each file
        return sorted((r.asDict() for r in found), key=lambda r: r["name"])

    def _from_footers(self, path: str) -> list[dict]:
        files = [s.getPath() for s in self.fs.listStatus(self._path(path)) if s.getPath().getName().endswith(".parquet")]
        hadoop = self._jvm.org.apache.parquet.hadoop

        def one(file) -> dict | None:
            reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(file, self.conf))
            try:
                keys, seqs, rows = [], [], 0
                for block in reader.getFooter().getBlocks():
                    rows += block.getRowCount()
                    for column in block.getColumns():
                        name, stats = column.getPath().toDotString(), column.getStatistics()
                        if name == "key":
                            keys += [bytes(stats.genericGetMin().getBytes()), bytes(stats.genericGetMax().getBytes())]
                        elif name == "seq":
                            seqs += [stats.genericGetMin(), stats.genericGetMax()]
            finally:
                reader.close()
            return {"name": file.getName(), "entries": rows, "min_key": min(keys).hex().upper(), "max_key": max(keys).hex().upper(), "min_seq": min(seqs), "max_seq": max(seqs)} if rows else None

        with ThreadPoolExecutor(16) as pool:
            return [x for x in pool.map(one, files) if x]


class Store:
    """Handle on one store; cheap, holds the folded log only."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, cfs: Sequence[str] = ()):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.pins: list[int] = []
        self.log = Log(spark, self.root)
        self.refresh()
        if not self.cfs and not read_only:
            self._commit([{"add_cf": {"name": DEFAULT, "id": 0, "ordering": "bytewise"}}])
        for name in cfs:
            if name not in self.cfs:
                self.create_cf(name)

    # -- log -------------------------------------------------------------
    def refresh(self) -> None:
        """Read what the log has got since the last time."""
        if not hasattr(self, "version"):
            self.cfs: dict[str, dict] = {}
            self.files: dict[str, dict] = {}
            self.max_cf_id, self.version = -1, 0
            self.retention: dict[int, int] = {}
            self.batches: set[tuple[str, int]] = set()
            if saved := self.log.checkpoint():
                self.cfs, self.files, self.max_cf_id, self.version = (saved[k] for k in ("cfs", "files", "max_cf_id", "version"))
                self.retention = {int(k): v for k, v in saved["retention"].items()}
                self.batches = {tuple(b) for b in saved["batches"]}
        for entry in self.log.entries(self.version):
            self.version = entry["version"]
            for action in entry["actions"]:
                self._fold(action)

    def checkpoint(self) -> None:
        """Write the folded log; entries before it are no longer read."""
        state = {k: getattr(self, k) for k in ("cfs", "files", "max_cf_id", "version", "retention")}
        self.log.save(self.version, {**state, "batches": sorted(self.batches)})

    def _fold(self, action: dict) -> None:
        (kind, a), *_ = action.items()
        if kind == "add_cf":
            self.cfs[a["name"]] = a
            self.max_cf_id = max(self.max_cf_id, a["id"])
        elif kind == "drop_cf":
            gone = self.cfs.pop(a["name"])
            self.files = {p: f for p, f in self.files.items() if f["cf"] != gone["id"]}
        elif kind == "add_file":
            self.files[a["path"]] = a
        elif kind == "remove_file":
            self.files.pop(a["path"], None)
        elif kind == "retain":
            self.retention[a["cf"]] = max(self.retention.get(a["cf"], 0), a["seq"])
        elif kind == "options":
            self.cfs[a["name"]] = {**self.cfs[a["name"]], "options": a["options"]}
        elif kind == "batch":
            self.batches.add((a["source"], a["id"]))

    def _commit(self, actions: list[dict], version: int | None = None) -> int:
        if self.read_only:
            raise StoreError("read-only handle")
        version = self.version + 1 if version is None else version
        if not self.log.append(version, {"version": version, "actions": actions}):
            raise Conflict(f"version {version} exists")
        self.refresh()
        log.debug("committed version %d: %d actions", version, len(actions))
        if version % CHECKPOINT == 0:
            self.checkpoint()
        return version

    # -- keyspaces ---------------------------------------------------------
    def create_cf(self, name: str, ordering: str = "bytewise", prefix: int = 0, options: dict | None = None) -> None:
        """``prefix``: how many leading bytes are the key, for the ordering of that name."""
        if not name or name in self.cfs:
            raise StoreError(f"empty or existing name {name!r}")
        if ordering not in ORDERINGS:
            raise StoreError(f"unknown ordering {ordering!r}")
        if (ordering == "prefix") != (prefix > 0):
            raise StoreError("the prefix ordering, and no other, has a length")
        self._commit([{"add_cf": {"name": name, "id": self.max_cf_id + 1, "ordering": ordering, "prefix": prefix, "options": options or {}}}])

    def update_options(self, name: str, **options) -> dict:
        """Set options of a keyspace; its ordering can't change."""
        if {"ordering", "prefix", "id", "name"} & set(options):
            raise StoreError("the ordering of a keyspace can't change")
        new = {**self._cf(name).get("options", {}), **options}
        self._commit([{"options": {"name": name, "options": new}}])
        return new

    def drop_cf(self, name: str) -> None:
        if name == DEFAULT or name not in self.cfs:
            raise StoreError(f"cannot drop {name!r}")
        self._commit([{"drop_cf": {"name": name}}])

    def list_cfs(self) -> list[str]:
        return sorted(self.cfs, key=lambda n: self.cfs[n]["id"])

    # -- writes ------------------------------------------------------------
    def _write(self, cf: str, records: DataFrame, level: int = 0, target_rows: int = 0) -> list[dict]:
        """Write change records of one keyspace, sorted by key inside range partitions; return add_file actions.

        Counts are observed while the files are written, key bounds come from
        their footers: nothing is read back, but for keys and sequences of many
        small files.
        """
        meta = self._cf(cf)
        path = f"data/cf_{meta['id']}/{uuid.uuid4().hex}"
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CHANGE]
        order = sort_key(meta["ordering"], F.col("key"), meta.get("prefix", 0))
        out = records.select(*cols).repartitionByRange(order).sortWithinPartitions(order, F.desc("seq"), F.desc("op_idx"))
        seen = Observation()
        crc = F.crc32(F.concat("key", F.coalesce("value", F.lit(b""))))
        sizes = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
        out = out.observe(seen, F.count(F.lit(1)).alias("entries"), F.count_if(F.col("op") == DELETE).alias("deletions"), F.coalesce(F.sum(sizes), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(crc), F.lit(0)).alias("crc"))
        writer = out.write.option("parquet.bloom.filter.enabled#key", "true")
        if target_rows:  # a filter for unknown numbers takes 1 MB a file
            writer = writer.option("maxRecordsPerFile", target_rows).option("parquet.bloom.filter.expected.ndv#key", target_rows)
        writer.parquet(f"{self.root}/{path}")
        parts = self.log.bounds(f"{self.root}/{path}")
        if not parts:
            return []
        whole = {k: f(p[k] for p in parts) for k, f in (("min_key", min), ("max_key", max), ("min_seq", min), ("max_seq", max))}
        return [{"add_file": {"path": path, "cf": meta["id"], "level": level, **seen.get, **whole, "parts": parts}}]

    def _cf(self, name: str) -> dict:
        if name not in self.cfs:
            raise StoreError(f"no keyspace {name!r}")
        return self.cfs[name]

    def apply(self, changes: dict[str, DataFrame], extra: list[dict] | None = None, expected: int | None = None) -> int:
        """One atomic commit of (key, op, value[, op_idx]) rows for each keyspace; all get its version as seq."""
        if self.read_only:
            raise StoreError("read-only handle")
        version = (self.version if expected is None else expected) + 1
        actions = list(extra or [])
        for cf, df in changes.items():
            # Rows without a number of their own count in the order of the DataFrame: the last one of a key wins.
            idx = F.col("op_idx") if "op_idx" in df.columns else F.monotonically_increasing_id()
            rows = df.select(F.lit(cf).alias("cf"), F.coalesce(F.when(F.octet_length("key") > 0, F.col("key")), F.raise_error(F.lit("empty key"))).alias("key"), F.lit(version).alias("seq"), idx.alias("op_idx"), "op", F.when(F.col("op") == PUT, F.coalesce("value", F.lit(b""))).alias("value"), F.lit(None).alias("txn_id"))
            actions += self._write(cf, rows)
        return self._commit(actions, version)

    def put_all(self, rows: DataFrame, cf: str = DEFAULT) -> int:
        """Bulk put of (key, value[, op_idx]) rows in one commit; of rows with one key the last one wins."""
        return self.apply({cf: rows.select("key", F.lit(PUT).alias("op"), "value", *(c for c in rows.columns if c == "op_idx"))})

    def delete_all(self, keys: DataFrame, cf: str = DEFAULT) -> int:
        return self.apply({cf: keys.select("key", F.lit(DELETE).alias("op"), F.lit(None).cast("binary").alias("value"))})

    def _local(self, ops: Iterable[tuple]) -> DataFrame:
        rows = [(k, o, v, i) for i, (k, o, v) in enumerate(ops)]
        return self.spark.createDataFrame(rows, "key binary, op int, value binary, op_idx int")

    def put(self, key: bytes, value: bytes, cf: str = DEFAULT) -> int:
        return self.apply({cf: self._local([(key, PUT, value)])})

    def delete(self, key: bytes, cf: str = DEFAULT) -> int:
        return self.apply({cf: self._local([(key, DELETE, None)])})

    def delete_range(self, start: bytes | None, end: bytes | None, cf: str = DEFAULT) -> int:
        """Extension: tombstones for all live keys of a range."""
        return self.delete_all(self.scan(start, end, cf=cf).select("key"), cf)

    # -- reads -------------------------------------------------------------
    def _order(self, cf: str) -> dict:
        meta = self._cf(cf)
        return {"ordering": meta["ordering"], "prefix": meta.get("prefix", 0)}

    def _key_range(self, cf: str, start: bytes | None, end: bytes | None) -> tuple[bytes | None, bytes | None]:
        """Bytewise bounds that hold the range start <= key < end of a keyspace; None is open."""
        name = self._cf(cf)["ordering"]
        if name == "bytewise":
            return start or None, end or None
        if name == "reverse_bytewise":
            return end or None, start + b"\x00" if start else None
        return None, None

    def _paths(self, files: Iterable[dict], fits=lambda f: True) -> list[str]:
        """The data files that fit; a commit's folder where all of its files do, as the driver looks up every path."""
        out = []
        for f in filter(fits, files):
            names = [p["name"] for p in f["parts"] if fits(p)]
            whole = f"{self.root}/{f['path']}"
            out += [whole] if len(names) == len(f["parts"]) else [f"{whole}/{n}" for n in names]
        return out

    def changes(self, cf: str = DEFAULT, start: bytes | None = None, end: bytes | None = None, as_of: int | None = None, prune: tuple[bytes | None, bytes | None] | None = None) -> DataFrame:
        """Change records with start <= key < end in the keyspace's order, from the files that can matter.

        ``prune``: bytewise bounds of the keys wanted, where the caller knows them.
        """
        meta = self._cf(cf)
        if as_of is not None and as_of < self.retention.get(meta["id"], 0):
            raise StoreError(f"versions below {self.retention[meta['id']]} are compacted away")
        low, high = prune or self._key_range(cf, start, end)
        lo, hi = (x.hex().upper() if x else None for x in (low, high))
        fits = lambda f: (lo is None or f["max_key"] >= lo) and (hi is None or f["min_key"] < hi) and (as_of is None or f["min_seq"] <= as_of)
        keep = self._paths((f for f in self.files.values() if f["cf"] == meta["id"]), fits)
        if not keep:
            return self.spark.createDataFrame([], CHANGE)
        df = self.spark.read.schema(CHANGE).parquet(*keep)
        if low or high:
            df = df.filter(read.between(F.col("key"), low, high))
        if start or end:
            df = df.filter(read.within(meta["ordering"], F.col("key"), start or None, end or None, meta.get("prefix", 0)))
        return df if as_of is None else df.filter(F.col("seq") <= as_of)

    def _identity(self, cf: str) -> Column:
        order = self._order(cf)
        return identity(order["ordering"], F.col("key"), order["prefix"])

    def _merged(self, cf: str, records: DataFrame) -> DataFrame:
        """Live state of a keyspace's records; keys that its ordering takes for equal are one."""
        return merge.latest(records.withColumn("_id", self._identity(cf)), ("cf", "_id")).drop("_id")

    def state(self, cf: str = DEFAULT, as_of: int | None = None, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return self._merged(cf, self.changes(cf, start, end, as_of))

    def snapshot(self) -> int:
        """The version now; compaction keeps what it sees until it is released."""
        self.pins.append(self.version)
        return self.version

    def release(self, snapshot: int) -> None:
        if snapshot in self.pins:
            self.pins.remove(snapshot)

    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int = 0, cf: str = DEFAULT, as_of: int | None = None, reverse: bool = False) -> DataFrame:
        """Entries with start <= key < end, both in the keyspace's own order, in that order or its reverse."""
        out = self.state(cf, as_of, start, end).orderBy(*sort_columns(**self._names(cf), key=F.col("key"), reverse=reverse)).select("key", "value")
        return out.limit(limit) if limit else out

    def _names(self, cf: str) -> dict:
        order = self._order(cf)
        return {"name": order["ordering"], "prefix": order["prefix"]}

    def seek(self, target: bytes, cf: str = DEFAULT, as_of: int | None = None) -> DataFrame:
        return self.scan(target, None, 1, cf, as_of)

    def seek_for_prev(self, target: bytes, cf: str = DEFAULT, as_of: int | None = None) -> DataFrame:
        return read.seek_for_prev(self.state(cf, as_of), target, **self._order(cf)).select("key", "value")

    def get(self, key: bytes, cf: str = DEFAULT, as_of: int | None = None) -> bytes | None:
        order = self._order(cf)
        if order["ordering"] == "prefix":
            part = key[: order["prefix"]]
            found = self._merged(cf, self.changes(cf, as_of=as_of, prune=(part, successor(part))).filter(F.substring("key", 1, order["prefix"]) == F.lit(part)))
        elif order["ordering"] in ("bytewise", "reverse_bytewise", "numeric32", "numeric64"):
            found = self._merged(cf, self.changes(cf, as_of=as_of, prune=(key, key + b"\x00")))
        else:
            same = sort_key(order["ordering"], F.col("key")) == sort_key(order["ordering"], F.lit(key))
            found = self._merged(cf, self.changes(cf, as_of=as_of).filter(same))
        rows = found.select("value").take(1)
        return bytes(rows[0]["value"]) if rows else None

    def multi_get(self, keys: DataFrame, cf: str = DEFAULT, as_of: int | None = None) -> DataFrame:
        return read.multi_get(keys, self.state(cf, as_of))

    # -- maintenance -------------------------------------------------------
    def compact(self, cf: str = DEFAULT, oldest: int | None = None, force: bool = True, start: bytes | None = None, end: bytes | None = None, target_rows: int = 0) -> bool:
        """Rewrite a keyspace into one sorted level; versions that no read at or above ``oldest`` sees go.

        With ``start`` or ``end`` only commits whose files meet that range are
        rewritten, and tombstones stay, as older files may hold what they hide.
        ``target_rows`` splits the output.
        """
        meta = self._cf(cf)
        mine = [f for f in self.files.values() if f["cf"] == meta["id"]]
        low, high = self._key_range(cf, start, end)
        lo, hi = (x.hex().upper() if x else None for x in (low, high))
        old = [f for f in mine if (lo is None or f["max_key"] >= lo) and (hi is None or f["min_key"] < hi)]
        due = sum(f["level"] == 0 for f in old) >= L0_TRIGGER or sum(f["bytes"] for f in old if f["level"] == 1) > BASE_BYTES
        if not old or not (force or due):
            return False
        oldest = min([self.version, *self.pins]) if oldest is None else oldest
        records = self.spark.read.schema(CHANGE).parquet(*self._paths(old))
        kept = merge.retain(records.withColumn("_id", self._identity(cf)), oldest, bottom=len(old) == len(mine), by=("cf", "_id"))
        version = self.version + 1
        actions = self._write(cf, kept, level=1, target_rows=target_rows)
        actions += [{"remove_file": {"path": f["path"]}} for f in old] + [{"retain": {"cf": meta["id"], "seq": oldest}}]
        self._commit(actions, version)
        return True

    def vacuum(self, older_than: float = 24 * 3600.0) -> list[str]:
        """Delete data that no commit refers to and that is older than so many seconds: a commit may still be under way."""
        self.refresh()
        live, gone = {f["path"] for f in self.files.values()}, []
        for d in self.log.children(f"{self.root}/data"):
            for name in self.log.children(f"{self.root}/data/{d}"):
                path = f"data/{d}/{name}"
                if path not in live and self.log.age(f"{self.root}/{path}") >= older_than:
                    self.log.remove_tree(f"{self.root}/{path}")
                    gone.append(path)
        return gone

    def repair(self, older_than: float = 24 * 3600.0) -> dict:
        """Delete orphans and what writers left beside the log; report files that are damaged."""
        for name in self.log.children(f"{self.root}/_log"):
            if name.startswith(".") and self.log.age(f"{self.root}/_log/{name}") >= older_than:
                self.log.remove_tree(f"{self.root}/_log/{name}")
        return {"removed": self.vacuum(older_than), "damaged": self.fsck()}

    def property(self, name: str) -> int | str | None:
        """num-files, num-entries, num-deletions, total-bytes, version, num-keyspaces, num-files-at-level<N>, stats; None for other names."""
        files = list(self.files.values())
        if name.startswith("num-files-at-level") and name[18:].isdigit():
            return sum(len(f["parts"]) for f in files if f["level"] == int(name[18:]))
        numbers = {"num-files": sum(len(f["parts"]) for f in files), "num-entries": sum(f["entries"] for f in files), "num-deletions": sum(f["deletions"] for f in files), "total-bytes": sum(f["bytes"] for f in files), "version": self.version, "num-keyspaces": len(self.cfs)}
        return json.dumps(numbers, sort_keys=True) if name == "stats" else numbers.get(name)

    def fsck(self) -> list[str]:
        """Commits whose rows no longer give the recorded counts and checksums, or whose files aren't in key order."""
        bad = []
        for f in self.files.values():
            try:
                order = self._names(next(n for n, c in self.cfs.items() if c["id"] == f["cf"]))
                df = self.spark.read.schema(CHANGE).parquet(f"{self.root}/{f['path']}")
                s = df.agg(F.count("*").alias("n"), F.bit_xor(F.crc32(F.concat("key", F.coalesce("value", F.lit(b""))))).alias("crc")).first()
                key = sort_key(order["name"], F.col("key"), order["prefix"])
                found = df.select(key.alias("k"), F.input_file_name().alias("file")).groupBy("file").agg(F.min("k").alias("a"), F.max("k").alias("b"))
                ranges = sorted((bytes(r["a"]), bytes(r["b"])) for r in found.collect())  # a row for each file
                ok = (s["n"], s["crc"]) == (f["entries"], f["crc"]) and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False))
            except Exception:
                ok = False
            if not ok:
                bad.append(f["path"])
        return bad

    def file_table(self) -> DataFrame:
        """One row for each data file; bytes and deletions of a commit are shared out by entries."""
        rows = [
            (f"{f['path']}/{p['name']}", f["cf"], f["level"], p["entries"], f["deletions"] * p["entries"] // f["entries"], bytes.fromhex(p["min_key"]), bytes.fromhex(p["max_key"]), f["bytes"] * p["entries"] // f["entries"], p["min_seq"], p["max_seq"])
            for f in self.files.values()
            for p in f["parts"]
        ]
        return self.spark.createDataFrame(rows, "path string, cf int, level int, entries long, deletions long, min_key binary, max_key binary, bytes long, min_seq long, max_seq long")

    def approximate_sizes(self, ranges: Sequence[tuple[bytes, bytes]]) -> DataFrame:
        r = self.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "range_id int, range_start binary, range_end binary")
        return stats.approximate_sizes(r, self.file_table().withColumn("file", F.col("path")))

    def approximate_entries(self, cf: str = DEFAULT) -> int:
        return sum(f["entries"] for f in self.files.values() if f["cf"] == self._cf(cf)["id"])

    def begin(self, isolation: str = "repeatable_read") -> Transaction:
        return Transaction(self, isolation)


def open_store(spark: SparkSession, root: str, read_only: bool = False, cfs: Sequence[str] = ()) -> Store:
    return Store(spark, root, read_only, cfs)


def destroy(spark: SparkSession, root: str) -> None:
    """Remove a store; only a folder that holds a commit log (or nothing) is touched."""
    log = Log(spark, root)
    names = log.children(root)
    if names and "_log" not in names:
        raise StoreError(f"{root} is not a store")
    log.remove_tree(root)


class Transaction:
    """Buffered writes over a pinned version; first committer wins.

    repeatable_read: reads see the version at the start.  read_committed: reads
    see the newest.  serializable: also fails if a key that was read has changed.
    """

    def __init__(self, store: Store, isolation: str):
        if isolation not in ("read_committed", "repeatable_read", "serializable"):
            raise StoreError(f"unsupported isolation {isolation!r}")
        self.store, self.isolation = store, isolation
        self.start = store.version
        self.ops: dict[str, list[tuple]] = {}
        self.reads: set[tuple[str, bytes]] = set()
        self.ranges: list[tuple[str, bytes | None, bytes | None]] = []
        self.done = False

    def put(self, key: bytes, value: bytes, cf: str = DEFAULT) -> None:
        self.ops.setdefault(cf, []).append((key, PUT, value))

    def delete(self, key: bytes, cf: str = DEFAULT) -> None:
        self.ops.setdefault(cf, []).append((key, DELETE, None))

    def get(self, key: bytes, cf: str = DEFAULT, for_update: bool = False) -> bytes | None:
        if for_update or self.isolation == "serializable":
            self.reads.add((cf, key))
        for k, op, v in reversed(self.ops.get(cf, [])):
            if k == key:
                return v if op == PUT else None
        if self.isolation == "read_committed":
            self.store.refresh()
            return self.store.get(key, cf)
        return self.store.get(key, cf, self.start)

    def scan(self, cf: str = DEFAULT, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """The state of a range with the own writes; a serializable transaction depends on the whole range."""
        if self.isolation == "serializable":
            self.ranges.append((cf, start, end))
        if self.isolation == "read_committed":
            self.store.refresh()
        order = self.store._names(cf)
        base = self.store.changes(cf, start, end, None if self.isolation == "read_committed" else self.start)
        mine = self.store._local(self.ops.get(cf, [])).select(F.lit(cf).alias("cf"), "key", F.lit(1 << 60).alias("seq"), "op_idx", "op", "value", F.lit(None).cast("long").alias("txn_id"))
        mine = mine.filter(read.within(order["name"], F.col("key"), start or None, end or None, order["prefix"]))
        return self.store._merged(cf, base.unionByName(mine)).orderBy(*sort_columns(**order, key=F.col("key"))).select("key", "value")

    def commit(self, retries: int = 8) -> int:
        if self.done:
            raise StoreError("transaction is finished")
        for _ in range(retries):
            self.store.refresh()
            self._validate()
            try:
                version = self.store.apply({cf: self.store._local(ops) for cf, ops in self.ops.items()}, expected=self.store.version) if self.ops else self.store.version
            except Conflict:
                continue
            self.done = True
            return version
        raise Conflict("too many concurrent commits")

    def _validate(self) -> None:
        touched = self.reads | {(cf, op[0]) for cf, ops in self.ops.items() for op in ops}
        for cf in {c for c, _ in touched} | {c for c, _, _ in self.ranges}:
            if cf not in self.store.cfs or self.store.retention.get(self.store._cf(cf)["id"], 0) > self.start:
                # What was compacted may have held a newer delete.
                self._conflict(f"versions of {cf!r} behind {self.start} are compacted away")
            keys = [(cf, k) for c, k in touched if c == cf]
            identified = lambda d, cf=cf: d.withColumn("_id", self.store._identity(cf))
            if keys:
                newer = self.store.changes(cf).filter(F.col("seq") > self.start)
                if not merge.conflicts(identified(newer), identified(self.store.spark.createDataFrame(keys, "cf string, key binary")), self.start, ("cf", "_id")).isEmpty():
                    self._conflict(f"keys of {cf!r} changed since version {self.start}")
        for cf, start, end in self.ranges:
            if not self.store.changes(cf, start, end).filter(F.col("seq") > self.start).isEmpty():
                self._conflict(f"a range of {cf!r} that was read has changed since version {self.start}")

    def _conflict(self, why: str) -> None:
        self.rollback()
        raise Conflict(why)

    def rollback(self) -> None:
        self.ops.clear()
        self.done = True

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.rollback()
        elif not self.done:
            self.commit()
