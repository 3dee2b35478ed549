"""Small files of a driver in the store that holds the tables: lists, records that are replaced whole."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Store:
    """A folder reached through Spark's own file systems, whichever store it is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._hadoop)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        where = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} was not moved to {to}")

    def write(self, name: str, text: str) -> None:
        """A new file; there must be none of that name."""
        out = self._fs.create(self._at(name), False)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class Record:
    """A small JSON value in numbered files: a change writes the next number, then the older ones go. A broken write leaves the last whole one."""

    def __init__(self, store: Store, name: str):
        self._store, self._name = store, name

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._store.names(self._name) if n.removesuffix(".json").isdigit())

    def get(self, default):
        for number in reversed(self._numbers()):
            try:
                return json.loads(self._store.read(f"{self._name}/{number}.json"))
            except ValueError:
                continue
        return default

    def put(self, value) -> None:
        numbers = self._numbers()
        self._store.write(f"{self._name}/{numbers[-1] + 1 if numbers else 0}.json", json.dumps(value))
        for number in numbers:
            self._store.delete(f"{self._name}/{number}.json")
