"""Providers: own sources of rows as Spark data sources, in batch and as streams.

A provider names the units it has (files, parts of files) and reads one unit. Spark gets them packed into partitions of a
bounded size; filters reach the provider, which leaves out what cannot match, and Spark checks the rows again. As a stream, the
units that came after an offset are the next micro-batch, so a restarted query goes on where its checkpoint ends.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import BARS_DDL

#: Without this setting Spark hands no filters to Python sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Unit:
    """Part of a source that is read at once. ``order`` never falls from one unit to a later one."""

    name: str
    order: int
    start: int
    length: int

    @property
    def place(self) -> tuple[int, str, int]:
        return self.order, self.name, self.start


@dataclass(frozen=True)
class Condition:
    """``column`` lies in ``values``, or between ``low`` and ``high`` (both inclusive; None is open)."""

    column: str
    low: Any = None
    high: Any = None
    values: tuple | None = None

    def may_hold(self, least: Any, most: Any) -> bool:
        """Whether a value between ``least`` and ``most`` can meet it; true where values don't compare."""
        try:
            if self.values is not None:
                return any(least <= v <= most for v in self.values)
            return (self.low is None or most >= self.low) and (self.high is None or least <= self.high)
        except TypeError:
            return True


def comparable(x: Any) -> Any:
    """Times with a zone, UTC where none is given, so that bounds and literals compare."""
    if isinstance(x, datetime):
        return x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x.astimezone(timezone.utc)
    return datetime(x.year, x.month, x.day, tzinfo=timezone.utc) if isinstance(x, date) else x


def conditions(filters: Iterable[Filter]) -> tuple[Condition, ...]:
    """What filters on plain columns ask for. Others are left to Spark, which checks all of them again."""
    out = []
    for f in filters:
        if len(getattr(f, "attribute", ())) != 1:
            continue
        name = f.attribute[0]
        if isinstance(f, In):
            out.append(Condition(name, values=tuple(comparable(v) for v in f.value if v is not None)))
        elif isinstance(f, EqualTo):
            out.append(Condition(name, values=(comparable(f.value),)))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            out.append(Condition(name, low=comparable(f.value)))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            out.append(Condition(name, high=comparable(f.value)))
    return tuple(out)


class Provider(ABC):
    """An own source: subclass it, give it a ``schema``, and register it by :func:`register_provider`."""

    schema: str

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    @abstractmethod
    def units(self) -> Iterable[Unit]:
        """All units there are now; called on the driver, so it lists and does not read."""

    @abstractmethod
    def read(self, unit: Unit, wanted: Sequence[Condition]) -> Iterator[pa.RecordBatch]:
        """Rows of one unit in the columns of ``schema``; rows that ``wanted`` excludes may be left out."""


@dataclass
class Pack(InputPartition):
    """Units that one task reads."""

    units: list[Unit]
    wanted: tuple[Condition, ...] = ()


def packs(units: Iterable[Unit], most: int, wanted: tuple[Condition, ...] = ()) -> list[Pack]:
    """Units in order, dealt into partitions of at most ``most`` bytes or one larger unit."""
    out: list[Pack] = []
    size = 0
    for u in sorted(units, key=lambda u: u.place):
        if not out or size + u.length > most:
            out.append(Pack([], wanted))
            size = 0
        out[-1].units.append(u)
        size += u.length
    return out


class _Reads:
    def __init__(self, provider: Provider, schema: StructType) -> None:
        self.provider, self.schema = provider, schema
        self.most = int(provider.options.get("partitionbytes", 128 << 20))

    def read(self, pack: Pack) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        for unit in pack.units:
            for b in self.provider.read(unit, pack.wanted):
                if b.num_rows:
                    yield from pa.Table.from_batches([b]).select(kind.names).cast(kind).to_batches()


class ProviderReader(_Reads, DataSourceReader):
    wanted: tuple[Condition, ...] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.wanted = conditions(filters)
        return filters

    def partitions(self) -> Sequence[Pack]:
        return packs(self.provider.units(), self.most, self.wanted) or [Pack([])]


class ProviderStream(_Reads, DataSourceStreamReader):
    """Offsets are places in the order of units: (order, name, start) of the last unit read."""

    def initialOffset(self) -> dict:
        return {"order": -1, "name": "", "start": -1}

    def latestOffset(self) -> dict:
        last = max((u.place for u in self.provider.units()), default=(-1, "", -1))
        return dict(zip(("order", "name", "start"), last))

    def partitions(self, start: dict, end: dict) -> Sequence[Pack]:
        low, high = ((o["order"], o["name"], o["start"]) for o in (start, end))
        return packs((u for u in self.provider.units() if low < u.place <= high), self.most)


def register_provider(spark: SparkSession, name: str, provider: type[Provider]) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read ``provider``.

    Options go to the provider with lower-case names; ``partitionBytes`` bounds what a task reads.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return provider.schema

        def _provider(self) -> Provider:
            return provider({k.lower(): v for k, v in self.options.items()})

        def reader(self, schema: StructType) -> ProviderReader:
            return ProviderReader(self._provider(), schema)

        def streamReader(self, schema: StructType) -> ProviderStream:
            return ProviderStream(self._provider(), schema)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Source)


class Folder(Provider):
    """Files below option ``path``, in the order they were last changed; files and folders whose names begin with ``_`` or
    ``.`` are not seen. Parquet files are cut at ``splitBytes``.

    A writer must make a file visible whole (by renaming) and later than those before it: a stream that has passed a file's
    time does not come back to it.
    """

    ends: tuple[str, ...] = (".parquet",)

    def files(self) -> tuple[fs.FileSystem, str]:
        path = re.sub(r"^file:/+", "/", self.options["path"])
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def units(self) -> Iterator[Unit]:
        store, base = self.files()
        split = int(self.options.get("splitbytes", 128 << 20))
        for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            hidden = any(x.startswith(("_", ".")) for x in f.path[len(base):].split("/"))
            if f.type != fs.FileType.File or hidden or not f.path.endswith(self.ends):
                continue
            cut = split if f.path.endswith(".parquet") else max(f.size, 1)
            for start in range(0, max(f.size, 1), cut):
                yield Unit(f.path, f.mtime_ns or 0, start, min(cut, f.size - start))

    def read(self, unit: Unit, wanted: Sequence[Condition]) -> Iterator[pa.RecordBatch]:
        store, _ = self.files()
        with store.open_input_file(unit.name) as f:
            file = pq.ParquetFile(f)
            groups = row_groups(file.metadata, unit, wanted)
            if groups:
                yield from file.iter_batches(batch_size=8192, row_groups=groups)


def row_groups(meta: pq.FileMetaData, unit: Unit, wanted: Sequence[Condition]) -> list[int]:
    """Row groups that begin inside the unit's bytes and whose bounds leave room for ``wanted``."""
    out = []
    for i in range(meta.num_row_groups):
        group = meta.row_group(i)
        columns = [group.column(k) for k in range(group.num_columns)]
        begin = min((c.dictionary_page_offset or c.data_page_offset for c in columns), default=0)
        if not unit.start <= begin < unit.start + unit.length:
            continue
        bounds = {c.path_in_schema: c.statistics for c in columns}
        known = ((w, bounds.get(w.column)) for w in wanted)
        if all(s is None or not s.has_min_max or w.may_hold(comparable(s.min), comparable(s.max)) for w, s in known):
            out.append(i)
    return out


class BarFolder(Folder):
    """Bars in Parquet files."""

    schema = BARS_DDL


class SnapshotFolder(Folder):
    """Snapshot documents: a ``.json`` file each (its path is the id), or rows (snapshot_id, value) of Parquet files.
    The parsers of ``sources.snapshots`` take the rows as they are."""

    schema = "snapshot_id string, value string"
    ends = (".json", ".parquet")

    def read(self, unit: Unit, wanted: Sequence[Condition]) -> Iterator[pa.RecordBatch]:
        if unit.name.endswith(".parquet"):
            yield from super().read(unit, wanted)
        elif all(w.column != "snapshot_id" or w.may_hold(unit.name, unit.name) for w in wanted):
            store, _ = self.files()
            with store.open_input_stream(unit.name) as f:
                text = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_pydict({"snapshot_id": [unit.name], "value": [text]})


def provider_bars(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register_provider(spark, "bar_folder", BarFolder)
    return spark.read.format("bar_folder").options(path=path, **options).load()


def provider_snapshots(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    register_provider(spark, "snapshot_folder", SnapshotFolder)
    reader = spark.readStream if stream else spark.read
    return reader.format("snapshot_folder").options(path=path, **options).load()
