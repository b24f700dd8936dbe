"""Questions to a store: roots, directories, duplicates, comparisons, summaries; as frames, and as JSON for display."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.operators import browse, compare
from cairnframe.operators.snapshots_view import side
from cairnframe.plans.store import Store

#: Rows that a JSON answer may hold; a larger one raises, so that nothing is left out unseen. Frames have no bound.
DISPLAY_ROWS = 200_000


def listed(df: DataFrame, most: int = DISPLAY_ROWS) -> list[dict]:
    """Rows for display; OverflowError beyond `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise OverflowError(f"more than {most} rows; use the frame, or write it")
    return [r.asDict(recursive=True) for r in rows]


@dataclass
class Comparison:
    """The answer to a comparison; every part is a frame."""

    identical: DataFrame  # one row: identical_count
    left_only: DataFrame
    right_only: DataFrame
    different: DataFrame
    left_compact: DataFrame
    right_compact: DataFrame

    def to_json(self, most: int = DISPLAY_ROWS) -> dict:
        """All parts as lists in their display order."""
        text = lambda c: F.coalesce(c, F.lit("")).alias("sha256")
        entry = lambda df: listed(df.select("rel_path", "size", text(F.col("sha256"))), most)
        compact = lambda df: listed(df.orderBy("sort_path").select("rel_path", "size", "sha256", "file_count", "collapsed"), most)
        brief = lambda s: F.struct(F.col(f"{s}_size").alias("size"), text(F.col(f"{s}_sha256"))).alias(s)
        return {
            "identical_count": self.identical.first()["identical_count"],
            "left_only": entry(self.left_only),
            "left_only_compact": compact(self.left_compact),
            "right_only": entry(self.right_only),
            "right_only_compact": compact(self.right_compact),
            "different": listed(self.different.orderBy("rel_path").select("rel_path", brief("left"), brief("right")), most),
        }


class Browser:
    """Reads one version of a store: the manifest is taken once, later commits don't show."""

    def __init__(self, store: Store):
        self.store = store
        self.manifest = store.manifest()

    def scan_id(self, machine_id: str, root: str) -> int:
        """The current scan of a root; LookupError where there is none, ValueError for missing parameters."""
        if not machine_id or not root:
            raise ValueError("machine_id and root are needed")
        for r in self.manifest["roots"]:
            if (r["machine_id"], r["root"]) == (machine_id, root) and r["current_scan_id"] is not None:
                return r["current_scan_id"]
        raise LookupError(f"no scan for {machine_id}:{root}")

    def entries(self, machine_id: str, root: str) -> DataFrame:
        return self.store.entries(self.scan_id(machine_id, root), self.manifest)

    def roots(self) -> list[dict]:
        """Roots whose scan exists, by hostname and root."""
        hosts = {s["scan_id"]: s["hostname"] for s in self.manifest["scans"]}
        rows = [
            {"machine_id": r["machine_id"], "hostname": hosts[r["current_scan_id"]], "root": r["root"]}
            for r in self.manifest["roots"]
            if r["current_scan_id"] in hosts
        ]
        return sorted(rows, key=lambda r: (r["hostname"], r["root"]))

    def directories(self, machine_id: str, root: str) -> DataFrame:
        return browse.directories(self.entries(machine_id, root), []).orderBy("dir")

    def duplicates(self, machine_id: str, root: str, prefix: str = "", ignore_noise: bool = False) -> DataFrame:
        """(size, sha256, rel_path), largest first."""
        rows = browse.duplicate_files(self.entries(machine_id, root), [], prefix, ignore_noise)
        return rows.orderBy(F.desc("size"), "sha256", "rel_path")

    def summary(self, machine_id: str, root: str) -> dict:
        """Scan id, number of files and their number by state."""
        scan = self.scan_id(machine_id, root)
        states = {r["state"]: r["files"] for r in browse.scan_summary(self.store.entries(scan, self.manifest)).collect()}
        return {"scan_id": scan, "files": sum(states.values()), "states": dict(sorted(states.items()))}

    def compare(
        self, left: tuple[str, str], right: tuple[str, str], left_prefix: str = "", right_prefix: str = "", mode: str = "path", ignore_noise: bool = False
    ) -> Comparison:
        """Compare two roots (machine_id, root) by path or by content.

        By content sizes don't matter, nothing is different and the compact lists are empty.
        """
        once = mode != "path"
        a = side(self.entries(*left), [], left_prefix, ignore_noise, once)
        b = side(self.entries(*right), [], right_prefix, ignore_noise, once)
        if mode == "path":
            rows = compare.compare_by_path(a, b, [])
            lo, ro = (compare.only_files(rows, w, []) for w in ("left", "right"))
            return Comparison(
                rows.agg(F.count_if(F.col("kind") == "identical").alias("identical_count")),
                lo.orderBy("rel_path"),
                ro.orderBy("rel_path"),
                rows.where(F.col("kind") == "different"),
                compare.compact_missing_trees(lo, b, []),
                compare.compact_missing_trees(ro, a, []),
            )
        if mode != "content":
            raise ValueError(f"mode {mode!r} is neither path nor content")
        same = compare.identical_by_content(a, b, []).agg(F.coalesce(F.sum("identical"), F.lit(0)).cast("long").alias("identical_count"))
        none = compare.compare_by_path(a.limit(0), b.limit(0), [])
        empty = compare.compact_missing_trees(compare.only_files(none, "left", []), b.limit(0), [])
        only = [compare.content_excess(x, y, []).orderBy("ord", "rel_path") for x, y in ((a, b), (b, a))]
        return Comparison(same, *only, none, empty, empty)


def summary_text(title: str, counts: dict[str, int]) -> str:
    """One line: `title: a=1, b=2,000`, by name."""
    return f"{title}: " + ", ".join(f"{k}={v:,}" for k, v in sorted(counts.items()))
