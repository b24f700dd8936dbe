"""Directory trees as a Spark data source: one row per regular file, with nanosecond times and hidden names."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnframe.functions.paths import split_patterns

_DDL = "rel_path string, name string, ext string, size long, mtime_ns long, state string, err string"


def extension_of(name: str) -> str:
    """Lower case from the last dot on."""
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 else ""


def shown(path: str) -> str | None:
    """A path that isn't UTF-8 with its odd bytes escaped (`\\xff`); None for any other."""
    try:
        path.encode()
        return None
    except UnicodeEncodeError:
        return path.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")


class Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders  # (path relative to the root, whether to descend)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        self.files, self.dirs = map(set, split_patterns(json.loads(options.get("exclude", "[]"))))
        self.skip = {os.path.realpath(p) for p in json.loads(options.get("skip", "[]"))}
        self.wanted = int(options.get("partitions", "32"))
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no directory {self.root}")

    def _enter(self, name: str, path: str) -> bool:
        return name not in self.dirs and path not in self.skip

    def _children(self, rel: str) -> list[str]:
        try:
            with os.scandir(os.path.join(self.root, rel)) as it:
                return [os.path.join(rel, e.name) for e in it if e.is_dir(follow_symlinks=False) and self._enter(e.name, e.path)]
        except OSError:
            return []

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough to share out; those opened give their files only."""
        if not self._enter(os.path.basename(self.root), self.root):  # links aren't followed below the real root, so paths are real
            return [Folders([])]
        flat, deep = [], [""]
        while deep and len(deep) < self.wanted:
            nxt = [c for d in deep for c in self._children(d)]
            flat += deep
            deep = nxt
            if not nxt:
                break
        shares: list[list[tuple[str, bool]]] = [[] for _ in range(max(1, min(self.wanted, len(deep) + len(flat))))]
        for i, f in enumerate([*((d, True) for d in deep), *((d, False) for d in flat)]):
            shares[i % len(shares)].append(f)
        return [Folders(s) for s in shares]

    def read(self, partition: Folders) -> Iterator[tuple]:
        stack = list(partition.folders)
        while stack:
            rel, descend = stack.pop()
            try:
                found = list(os.scandir(os.path.join(self.root, rel)))
            except OSError:
                continue  # a folder that can't be read drops its subtree
            for e in found:
                path = f"{rel}/{e.name}" if rel else e.name
                try:
                    if e.is_dir(follow_symlinks=False):
                        if descend and self._enter(e.name, e.path):
                            stack.append((path, True))
                        continue
                    facts = e.stat(follow_symlinks=False)
                except OSError as x:
                    name = shown(e.name) or e.name
                    yield (shown(path) or path, name, extension_of(name), 0, 0, "error", shown(str(x)) or str(x))
                    continue
                if stat.S_ISREG(facts.st_mode) and e.name not in self.files and e.path not in self.skip:
                    if (text := shown(path)) is not None:
                        name = text.rsplit("/", 1)[-1]
                        yield (text, name, extension_of(name), facts.st_size, facts.st_mtime_ns, "error", "the name isn't UTF-8")
                        continue
                    yield (path, e.name, extension_of(e.name), facts.st_size, facts.st_mtime_ns, "pending", None)


class TreeSource(DataSource):
    """format("cairn_tree"): options path, exclude and skip (JSON lists), partitions. Executors have to see the path."""

    @classmethod
    def name(cls) -> str:
        return "cairn_tree"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, skip: list[str] | None = None, partitions: int = 32) -> DataFrame:
    """Rows of a tree; symbolic links and devices are passed over, excluded folders aren't entered. A missing root raises.

    A name that isn't UTF-8 gives a row of state error with its odd bytes escaped.
    """
    spark.dataSource.register(TreeSource)
    split_patterns(exclude or [])
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no directory {root}")
    options = {"path": root, "exclude": json.dumps(exclude or []), "skip": json.dumps(skip or []), "partitions": str(partitions)}
    return spark.read.format("cairn_tree").options(**options).load()


def volume_facts(root: str, probe: bool = False) -> tuple[str | None, int]:
    """(file system type, case sensitivity as 0 or 1) of a root.

    The type is that of the longest mount point. Case is only probed by writing a file if asked to; else 1.
    """
    kind, best = None, -1
    root = os.path.realpath(root)
    try:
        with open("/proc/mounts", encoding="utf-8", errors="replace") as f:
            for line in f:
                point, fs = line.split()[1:3]
                if (root == point or root.startswith(point.rstrip("/") + "/")) and len(point) > best:
                    kind, best = fs, len(point)
    except OSError:
        pass
    if not probe:
        return kind, 1
    import tempfile

    try:
        with tempfile.NamedTemporaryFile(prefix="CaseProbe", dir=root) as f:
            return kind, int(not os.path.exists(os.path.join(root, os.path.basename(f.name).swapcase())))
    except OSError:
        return kind, 1
