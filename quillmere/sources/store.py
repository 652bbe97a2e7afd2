"""Tables on plain Parquet with atomic commits (SRC6, SRC8-SRC11, M23, ST6).

A table is a row of layers, folders of rows of which later ones replace earlier ones
by key; a manifest names the layers of each table. A commit writes new folders and
then a manifest, in one rename, so readers see all of a commit or nothing. A merge
adds a layer, so it costs what it changes, not the table. Receipts of commits make
repeats harmless; of a stream only its last batch is kept. File operations go
through Hadoop's file systems; one that renames over existing files, as object
stores do, allows one writer at a time only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.schemas import KEYS, schema

MANIFEST = "MANIFEST.json"
#: Layers over a table's first one before they are folded into one, and their share of its bytes before the table is written anew.
LAYERS = 8
SHARE = 0.5


class Conflict(RuntimeError):
    """Somebody else committed since the manifest was read."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _manifests(self) -> list[str]:
        if not self.fs.exists(self._path("manifests")):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self._path("manifests"))) if n.endswith(".json"))

    def manifest(self) -> dict:
        """The latest manifest; versions are numbered, the highest one holds."""
        names = self._manifests()
        return json.loads(self._read(f"manifests/{names[-1]}")) if names else {"version": 0, "tables": {}, "receipts": [], "progress": {}}

    def done(self, receipt: str | tuple[str, int] | None, at: dict | None = None) -> bool:
        """Whether a receipt was used: a name, or a stream and the number of its batch, which only grows."""
        at = at or self.manifest()
        if isinstance(receipt, tuple):
            return at["progress"].get(receipt[0], -1) >= receipt[1]
        return receipt is not None and receipt in at["receipts"]

    def _layered(self, name: str, layers: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{layers[0]}")
        for layer in layers[1:]:
            rows = _over(rows, self.spark.read.parquet(f"{self.path}/{layer}"), name)
        return rows

    def table(self, name: str, at: dict | None = None) -> DataFrame:
        """A table as of a manifest (the latest by default); one never written is empty."""
        layers = (at or self.manifest())["tables"].get(name)
        if layers is None:
            return self.spark.createDataFrame([], schema(name))
        return self._layered(name, layers)

    def _saved(self, name: str, rows: DataFrame, base: dict) -> str:
        where = f"{name}/v{base['version'] + 1:010d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{where}")
        return where

    def _publish(self, layers: dict[str, list[str]], receipt: str | tuple[str, int] | None, base: dict) -> None:
        new = base | {"version": base["version"] + 1, "tables": base["tables"] | layers}
        if isinstance(receipt, tuple):
            new["progress"] = base["progress"] | dict([receipt])
        elif receipt is not None:
            new["receipts"] = [*base["receipts"], receipt]
        draft, final = f"manifests/.{uuid.uuid4().hex}", f"manifests/{new['version']:010d}.json"
        self.fs.mkdirs(self._path("manifests"))
        self._write(draft, json.dumps(new))
        if self.fs.exists(self._path(final)) or not self.fs.rename(self._path(draft), self._path(final)):
            self.fs.delete(self._path(draft), False)
            raise Conflict(final)

    def commit(self, tables: dict[str, DataFrame], receipt: str | tuple[str, int] | None = None, base: dict | None = None) -> bool:
        """Replaces tables at once; False if the receipt was used before. Conflict if `base` is no longer the latest."""
        base = base or self.manifest()
        if self.done(receipt, base):
            return False
        self._publish({name: [self._saved(name, rows, base)] for name, rows in tables.items()}, receipt, base)
        return True

    def merge(self, name: str, rows: DataFrame, receipt: str | tuple[str, int] | None = None) -> bool:
        """Replaces rows of a table by key, in a layer of their own; False if the receipt was used before.

        Where the layers are many they are folded into one, and where they are large
        beside the first one the table is written anew, so that readers join few
        layers and a row is rewritten a few times only. Rows with a null in their key
        replace none.
        """
        base = self.manifest()
        if self.done(receipt, base):
            return False
        layers = base["tables"].get(name, [])
        rows = rows.select(*self.table(name, base).columns)
        sizes = [self.fs.getContentSummary(self._path(p)).getLength() for p in layers]
        if not layers:
            kept, new = [], rows
        elif sum(sizes[1:]) > SHARE * sizes[0]:
            kept, new = [], _over(self._layered(name, layers), rows, name)
        elif len(layers) > LAYERS:
            kept, new = layers[:1], _over(self._layered(name, layers[1:]), rows, name)
        else:
            kept, new = layers, rows
        self._publish({name: [*kept, self._saved(name, new, base)]}, receipt, base)
        return True

    def vacuum(self, keep: int = 10) -> int:
        """Deletes manifests but the last ones, and folders that none of these names; returns how many folders went.

        Folders that a commit is writing now have a higher number than the oldest
        manifest that stays, or the commit is bound to conflict.
        """
        names = self._manifests()
        gone, held = names[:-keep], names[-keep:]
        if not gone:
            return 0
        named = {path for n in held for layers in json.loads(self._read(f"manifests/{n}"))["tables"].values() for path in layers}
        oldest, deleted = int(held[0].removesuffix(".json")), 0
        for name in gone:
            self.fs.delete(self._path(f"manifests/{name}"), False)
        for table in (s.getPath().getName() for s in self.fs.listStatus(self._path("")) if s.isDirectory() and s.getPath().getName() != "manifests"):
            for folder in (s.getPath().getName() for s in self.fs.listStatus(self._path(table))):
                if f"{table}/{folder}" not in named and int(folder[1:11]) <= oldest:
                    self.fs.delete(self._path(f"{table}/{folder}"), True)
                    deleted += 1
        return deleted

    def backup(self, target: str) -> dict:
        """SRC11: copies the current tables elsewhere, with a manifest of row counts and content sums."""
        base, sums = self.manifest(), {}
        for name in base["tables"]:
            rows = self.table(name, base)
            rows.write.parquet(f"{target.rstrip('/')}/{name}")
            sums[name] = _sum(self.spark.read.parquet(f"{target.rstrip('/')}/{name}"))
        other = Store(self.spark, target)
        other._write(MANIFEST, json.dumps({"version": base["version"], "sums": sums}))
        return sums

    @classmethod
    def restore(cls, spark: SparkSession, source: str, target: str) -> Store:
        """SRC11: a new store from a backup whose sums agree; claimed messages are pending again. The target must be new."""
        saved, made = cls(spark, source), cls(spark, target)
        if made.fs.exists(made._path("")):
            raise FileExistsError(target)
        sums, tables = json.loads(saved._read(MANIFEST))["sums"], {}
        for name, want in sums.items():
            rows = spark.read.parquet(f"{saved.path}/{name}")
            if _sum(rows) != want:
                raise ValueError(f"backup of {name} is damaged")
            if name == "messages":
                rows = rows.withColumn("status", F.when(F.col("status") == "claimed", "pending").otherwise(F.col("status")))
            tables[name] = rows
        made.commit(tables)
        return made


def _over(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Rows of which newer ones replace older ones with their key; a small layer is broadcast, by Spark's own measure of its files."""
    keys = KEYS[name]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def _sum(rows: DataFrame) -> list[str]:
    """Row count and an order-free sum of row hashes; maps count as sorted entries."""
    cols = [F.array_sort(F.map_entries(c)) if kind.startswith("map") else F.col(c) for c, kind in rows.dtypes]
    found = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s")).first()
    return [str(found["n"]), str(found["s"])]


def write_export(path: str, facts: DataFrame, entities: DataFrame, edges: DataFrame) -> None:
    """SRC9: an export as JSON lines, a folder for each table."""
    for name, rows in (("facts", facts), ("entities", entities), ("relations", edges)):
        rows.write.json(f"{path}/{name}")


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC10: an export with whole fidelity; refused if it mixes guilds or repeats a fact."""
    tables = {name: spark.read.schema(schema(name)).json(f"{path}/{name}") for name in ("facts", "entities", "relations")}
    seen = tables["facts"].agg(F.count_distinct("guild_id").alias("guilds"), F.count("*").alias("n"), F.count_distinct("guild_id", "id").alias("ids")).first()
    if seen["guilds"] > 1 or seen["n"] != seen["ids"]:
        raise ValueError("an export holds one guild's facts, each once")
    return tables
