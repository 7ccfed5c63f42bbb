"""Locating landed files."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob on whatever file system the cluster uses, in name order."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in (fs.globStatus(path) or []))


def pick_register_files(paths: list[str], years: list[int] | None = None) -> list[str]:
    """One file per year, the plain form when a packed one is there too."""
    chosen: dict[str, str] = {}
    for path in sorted(paths, key=lambda p: p.endswith(".gz"), reverse=True):
        found = re.search(r"pp-([^./]+)\.csv(\.gz)?$", path)
        if found and (not years or found[1] in map(str, years)):
            chosen[found[1]] = path
    return [chosen[y] for y in sorted(chosen)]


def newest(paths: list[str]) -> str:
    """The latest release, as its name sorts last."""
    return max(paths)
