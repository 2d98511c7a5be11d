"""Versioned manifests, so that several tables change together.

A manifest is one small JSON file, ``manifest-<n>.json``, that says which folders make up version n. It is written
under another name and renamed as the last step, so readers see a version whole or not at all, and those that hold an
older manifest keep reading its folders until it is retired.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import SparkSession

from ..session import delete_path, folder_names

_NAME = re.compile(r"manifest-(\d+)\.json$")


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, n: int) -> str:
        return os.path.join(self.root, f"manifest-{n:09d}.json")

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(_NAME.match, folder_names(self.spark, self.root)) if m)

    def read(self, n: int | None = None) -> dict | None:
        """Version n, or the latest one; None if there is none."""
        numbers = self.numbers()
        if not numbers:
            return None
        at, fs = self._fs(self._path(numbers[-1] if n is None else n))
        stream = fs.open(at)
        try:
            scanner = self.spark._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A")
            return json.loads(scanner.next())
        finally:
            stream.close()

    def next_number(self) -> int:
        return (self.numbers() or [0])[-1] + 1

    def publish(self, n: int, content: dict) -> None:
        """Makes version n visible; fails if it is already there."""
        final, fs = self._fs(self._path(n))
        if fs.exists(final):
            raise FileExistsError(f"another writer published version {n} of {self.root}")
        draft, _ = self._fs(os.path.join(self.root, f".draft-{n:09d}.json"))
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(content, default=str).encode()))
        finally:
            stream.close()
        if not fs.rename(draft, final):
            raise FileExistsError(f"another writer published version {n} of {self.root}")

    def retire(self, keep: int = 2) -> None:
        """Deletes manifests older than the last ``keep`` and the folders that only those name."""
        numbers = self.numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        held = {f for n in kept for f in self.read(n)["folders"]}
        for n in old:
            for folder in self.read(n)["folders"]:
                if folder not in held:
                    delete_path(self.spark, os.path.join(self.root, folder))
            delete_path(self.spark, self._path(n))
