"""Recorded payloads of services as a Spark data source.

``spark.read.format("recorded_payloads").load(folder)`` reads a folder that has
one folder ``source=NAME`` of JSON-lines files for each service, as connectors'
recorders leave them.  Each file is a partition.  A line or file that cannot be
read is a row with an error, so one service's failure never hides another's rows.

Options narrow what is read: ``sources`` (names with commas between) leaves out
whole folders; ``least`` and ``most`` bound the year in the files of the services that
honour a year filter (``honours``), all others give all their rows.  These are options and
not pushed filters, as Spark 4.1 keeps what a Python source was told by
one query's filters for the next query on the same DataFrame, which would lose rows.

Register once in a session: ``register(spark)``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source string, ord long, year int, payload string, error string"


@dataclass
class OneFile(InputPartition):
    """A file of one service, and whether the service applies the year filters."""

    source: str
    path: str
    honours: bool
    value: None = field(default=None)


def _year(payload: dict) -> int | None:
    """A payload's year: a number or the first four digits of a text."""
    text = str(payload.get("year") or "")[:4]
    return int(text) if len(text) == 4 and text.isdigit() else None


class PayloadReader(DataSourceReader):
    def __init__(self, path: str, sources: frozenset[str] | None, honours: frozenset[str], least: int | None, most: int | None):
        self.path, self.sources, self.honours, self.least, self.most = path, sources, honours, least, most

    def _asked(self, year: int | None) -> bool:
        """Whether a service that honours the bounds gives a row; one without a year only where there are none."""
        if self.least is None and self.most is None:
            return True
        return year is not None and (self.least is None or year >= self.least) and (self.most is None or year <= self.most)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = next((p.removeprefix("source=") for p in info.path.split("/") if p.startswith("source=")), None)
            file = info.base_name
            if info.type == fs.FileType.File and name is not None and not file.startswith(("_", ".")) and (self.sources is None or name in self.sources):
                found.append(OneFile(name, info.path, name in self.honours))
        return sorted(found, key=lambda x: (x.source, x.path)) or [OneFile("", "", False)]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        try:
            with store.open_input_stream(partition.path, compression="detect") as stream:
                lines = stream.read().decode("utf-8", "replace").split("\n")
        except OSError as error:
            yield partition.source, None, None, None, f"unreadable: {str(error)[:200]}"
            return
        for n, line in enumerate(lines):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
                payload = json.loads(row["payload"]) if isinstance(row["payload"], str) else row["payload"]
                year = _year(payload)
                found = partition.source, int(row["ord"]), year, json.dumps(payload, ensure_ascii=False), None
            except (ValueError, KeyError, TypeError, AttributeError) as error:
                yield partition.source, n, None, line, f"not a payload: {type(error).__name__}"
                continue
            if not partition.honours or self._asked(year):
                yield found


def _names(text: str) -> frozenset[str]:
    return frozenset(x for x in text.split(",") if x)


class RecordedPayloads(DataSource):
    """The format ``recorded_payloads``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        path, given = self.options["path"], self.options
        bound = lambda name: int(given[name]) if given.get(name) else None
        return PayloadReader(path if "://" in path or path.startswith("file:") else f"file://{path}", _names(given["sources"]) if "sources" in given else None, _names(given.get("honours", "")), bound("least"), bound("most"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedPayloads)


def read(spark: SparkSession, folder: str, sources: Sequence[str] | None = None, honours: Sequence[str] = (), least: int | None = None, most: int | None = None) -> DataFrame:
    """The payloads of some sources or all, within year bounds where the source honours them."""
    register(spark)
    given = {"honours": ",".join(honours), "least": "" if least is None else least, "most": "" if most is None else most}
    reader = spark.read.format("recorded_payloads").options(**given)
    return (reader if sources is None else reader.option("sources", ",".join(sources))).load(folder)


def write(rows: DataFrame, folder: str) -> None:
    """Records (source, ord, payload) as this source reads them."""
    rows.select("source", F.to_json(F.struct("ord", "payload")).alias("value")).write.partitionBy("source").text(folder)
