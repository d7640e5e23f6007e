"""Tables that grow by batches: a keyed table of which a batch rewrites only what it touches, and a set of keys.

Both are written by one job at a time, in numbered batches. What belongs to a table after batch N stands in the manifest
of N; files come first and the manifest last, so a batch that fails is not seen, and one that runs again replaces what it
had written. Files that no kept manifest names are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell.sources.tables import cut, delete, folders


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class _Manifests:
    """Numbered lists of (name, path) rows, each a small table; one without _SUCCESS does not count."""

    spark: SparkSession
    root: str

    def numbers(self) -> list[int]:
        return sorted(int(n[7:]) for n in folders(self.spark, self.root) if n.startswith("number="))

    def path(self, number: int) -> str:
        return f"{self.root}/number={number:012d}"

    def read(self, number: int) -> dict[str, str]:
        rows = self.spark.read.schema("name string, path string").parquet(self.path(number)).collect()
        return {r.name: r.path for r in rows}

    def below(self, number: int | None) -> dict[str, str]:
        """The newest one below ``number``, or the newest of all."""
        for n in reversed(self.numbers()):
            if (number is None or n < number) and "_SUCCESS" in folders(self.spark, self.path(n)):
                return self.read(n)
        return {}

    def write(self, number: int, entries: dict[str, str]) -> None:
        for later in (n for n in self.numbers() if n > number):
            delete(self.spark, self.path(later))
        rows = self.spark.createDataFrame(sorted(entries.items()), "name string, path string")
        rows.coalesce(1).write.mode("overwrite").parquet(self.path(number))

    def expire(self, keep: int) -> list[str]:
        """Drop all but the newest ``keep`` manifests; gives the paths that none of those names."""
        numbers = self.numbers()
        old, kept = numbers[: max(0, len(numbers) - keep)], numbers[max(0, len(numbers) - keep) :]
        alive = {p for n in kept for p in self.read(n).values()}
        dead = {p for n in old for p in self.read(n).values()} - alive
        for n in old:
            delete(self.spark, self.path(n))
        return sorted(dead)


@dataclass(frozen=True)
class KeyedTable:
    """A table cut into ``parts`` by the hash of a key. A batch rewrites the parts of its own keys; all others stay as
    they are. ``parts`` is fixed when a table is made: take it so that a part holds about a gigabyte."""

    spark: SparkSession
    root: str
    key: str
    schema: T.StructType
    parts: int = 64
    #: Manifests that stay, for readers of earlier states and batches that run again.
    keep: int = 3

    @property
    def _manifests(self) -> _Manifests:
        return _Manifests(self.spark, f"{self.root}/manifest")

    def live(self, before: int | None = None) -> dict[int, str]:
        """Folder of each part that has rows, after the newest batch below ``before`` (None: the newest of all)."""
        return {int(name): path for name, path in self._manifests.below(before).items()}

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        live = self.live(before)
        paths = [path for part, path in sorted(live.items()) if parts is None or part in set(parts)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, batch: DataFrame) -> list[int]:
        """The parts that a batch has keys of."""
        return sorted(r.part for r in batch.select(part_of(F.col(self.key), self.parts).alias("part")).distinct().collect())

    def update(self, number: int, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the parts that ``batch`` touches by ``merge(their rows, batch)``; gives their numbers.

        ``merge`` gets the stored rows of those parts only, and returns what these parts shall hold. A part with
        many rows is written by many tasks.
        """
        touched = self.touched(batch)
        entries = self.live(number)
        attempts = f"{self.root}/data"
        for name in folders(self.spark, attempts):
            # What an earlier run of this batch left; later ones are void too.
            if name.startswith("batch=") and int(name[6:18]) >= number:
                delete(self.spark, f"{attempts}/{name}")
        if touched:
            path = f"{attempts}/batch={number:012d}-{uuid.uuid4().hex}"
            rows = merge(self.read(number, touched), batch).select(*self.schema.names).withColumn("part", part_of(F.col(self.key), self.parts))
            rows.hint("rebalance", "part").write.partitionBy("part").parquet(path)
            written = {int(n[5:]): f"{path}/{n}" for n in folders(self.spark, path) if n.startswith("part=")}
            if not set(written) <= set(touched):
                raise ValueError("the merge gave rows of keys that are not in the batch's parts")
            entries = {p: f for p, f in entries.items() if p not in set(touched)} | written
        self._manifests.write(number, {str(p): f for p, f in entries.items()})
        for dead in self._manifests.expire(self.keep):
            delete(self.spark, dead)
        return touched


#: Bits of a filter per key, and how many of them a key sets: one key in a hundred is let through wrongly.
FILTER_BITS, FILTER_PROBES = 10, 7


def _probes(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bits (a power of two of them) that keys set, one row per probe."""
    steps = np.arange(FILTER_PROBES, dtype=np.uint64)[:, None]
    return (first.view(np.uint64) + steps * (second.view(np.uint64) | np.uint64(1))) & np.uint64(bits - 1)


def _filter(first: np.ndarray, second: np.ndarray) -> bytes:
    bits = 1 << max(6, (FILTER_BITS * len(first) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[_probes(first, second, bits).ravel()] = True
    return np.packbits(marks).tobytes()


def _may_hold(marks: bytes, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    held = np.frombuffer(marks, np.uint8)
    at = _probes(first, second, 8 * len(held))
    return ((held[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


@dataclass(frozen=True)
class KeySet:
    """Every key ever added, in runs that are cut by the hash of the key, with a Bloom filter for each part of a run.

    A batch of keys asks the filters first. Keys that no filter holds are new; for the others only the parts whose filter
    let one of them through are read. ``fanout`` runs of one size are merged into a larger one, so that there are
    no more than ``fanout`` of each size. Keys are strings and not NULL.
    """

    spark: SparkSession
    root: str
    parts: int = 16
    fanout: int = 8
    keep: int = 3

    @property
    def _manifests(self) -> _Manifests:
        return _Manifests(self.spark, f"{self.root}/manifest")

    def runs(self, before: int | None = None) -> dict[str, str]:
        """Name (``level-first-last``) and folder of every run."""
        return self._manifests.below(before)

    def _hashed(self, keys: DataFrame) -> DataFrame:
        return keys.select("key", part_of(F.col("key"), self.parts).alias("part"), F.xxhash64(F.lit(1), "key").alias("first"), F.xxhash64(F.lit(2), "key").alias("second"))

    def _parts(self, path: str) -> list[str]:
        return [f"{path}/keys/{n}" for n in folders(self.spark, f"{path}/keys") if n.startswith("part=")]

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema("key string").parquet(*parts) if parts else self.spark.createDataFrame([], "key string")

    def _write(self, keys: DataFrame, path: str) -> None:
        """A run: its keys by part, and the filter of each part."""
        keys.withColumn("part", part_of(F.col("key"), self.parts)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/keys")
        stored = self._read(self._parts(path))

        def build(group: pa.Table) -> pa.Table:
            first, second = (np.asarray(group.column(c).combine_chunks()) for c in ("first", "second"))
            return pa.table({"part": group.column("part")[:1].combine_chunks(), "marks": pa.array([_filter(first, second)], pa.binary())})

        self._hashed(stored).select("part", "first", "second").groupBy("part").applyInArrow(build, "part int, marks binary").write.parquet(f"{path}/filters")

    def candidates(self, number: int | None, keys: DataFrame) -> DataFrame:
        """key, run and part wherever a filter below ``number`` lets a key through."""
        runs = self.runs(number)
        if not runs:
            return self.spark.createDataFrame([], "key string, run string, part int")
        filters = self.spark.read.schema("part int, marks binary").parquet(*[f"{p}/filters" for p in runs.values()])
        names = {p.rpartition("/")[2]: name for name, p in runs.items()}
        folder = F.element_at(F.split(F.input_file_name(), "/"), -3)
        filters = filters.withColumn("folder", folder)

        def ask(asked: pa.Table, held: pa.Table) -> pa.Table:
            first, second = (np.asarray(asked.column(c).combine_chunks()) for c in ("first", "second"))
            found = []
            for place, marks in zip(held.column("folder").to_pylist(), held.column("marks").to_pylist(), strict=True):
                some = asked.filter(pa.array(_may_hold(marks, first, second))) if len(asked) else asked
                found.append(pa.table({"key": some.column("key"), "run": pa.array([names[place]] * len(some), pa.string()), "part": some.column("part")}))
            return pa.concat_tables(found) if found else pa.table({"key": pa.array([], pa.string()), "run": pa.array([], pa.string()), "part": pa.array([], pa.int32())})

        return self._hashed(keys).groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(ask, "key string, run string, part int")

    def known(self, number: int | None, keys: DataFrame) -> tuple[DataFrame, list[str]]:
        """Those of the keys that were added before batch ``number``, and the folders that were read to tell."""
        suspects = cut(self.candidates(number, keys), "suspects")
        runs = self.runs(number)
        folders_ = [f"{runs[r.run]}/keys/part={r.part}" for r in suspects.select("run", "part").distinct().orderBy("run", "part").collect()]
        return suspects.select("key").distinct().join(self._read(folders_), "key", "left_semi"), folders_

    def add(self, number: int, keys: DataFrame) -> None:
        """Store the keys (each once, none known) of batch ``number``, and merge runs where there are ``fanout`` of a level."""
        runs = self.runs(number)
        for name in folders(self.spark, f"{self.root}/runs"):
            if int(name.split("-")[2]) >= number:
                delete(self.spark, f"{self.root}/runs/{name}")
        runs |= self._run(0, number, number, keys)
        level = 0
        while len(same := sorted(n for n in runs if n.startswith(f"{level:02d}-"))) >= self.fanout:
            merged = self._read([f for n in same for f in self._parts(runs[n])])
            first, last = same[0].split("-")[1], same[-1].split("-")[2]
            runs = {n: p for n, p in runs.items() if n not in same} | self._run(level + 1, int(first), int(last), merged)
            level += 1
        self._manifests.write(number, runs)
        for dead in self._manifests.expire(self.keep):
            delete(self.spark, dead)

    def _run(self, level: int, first: int, last: int, keys: DataFrame) -> dict[str, str]:
        name = f"{level:02d}-{first:012d}-{last:012d}"
        path = f"{self.root}/runs/{name}-{uuid.uuid4().hex}"
        self._write(keys.select("key"), path)
        return {name: path}
