"""Command line: python -m cairnframe COMMAND ... (in a Spark session of its own, or under spark-submit).

scan, import-s3, import-database and consolidate change stores; roots, dirs, duplicates, summary, interrupted and compare print JSON.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from cairnframe.plans import inventory
from cairnframe.plans.api import Browser, listed
from cairnframe.plans.store import Store, local_identity


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnframe")
    p.add_argument("--store", required=True, help="folder of a store; for consolidate a folder of stores")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("scan", help="take the inventory of a tree")
    c.add_argument("root")
    c.add_argument("--exclude", action="append", default=[], help="a file name, or a folder name with a slash at its end")
    c.add_argument("--trusted-only", action="store_true", help="reuse only hashes of rows in a trusted state")
    c.add_argument("--parallelism", type=int, help="tasks that hash files at a time")
    c = sub.add_parser("import-s3", help="import a checksum report")
    c.add_argument("manifest")
    c.add_argument("--inventory", help="manifest of the object inventory that has the sizes")
    c = sub.add_parser("import-database", help="take over the current scans of an inventory in a SQLite file")
    c.add_argument("file")
    sub.add_parser("consolidate", help="merge all stores of a folder into one")
    sub.add_parser("roots")
    sub.add_parser("interrupted", help="newest failed scan of every root and its rows that can be reused")
    for name in ("dirs", "duplicates", "summary"):
        c = sub.add_parser(name)
        c.add_argument("machine")
        c.add_argument("root")
    sub.choices["duplicates"].add_argument("--prefix", default="")
    sub.choices["duplicates"].add_argument("--ignore-noise", action="store_true")
    c = sub.add_parser("compare")
    for s in ("left", "right"):
        c.add_argument(f"{s}_machine")
        c.add_argument(f"{s}_root")
    c.add_argument("--left-prefix", default="")
    c.add_argument("--right-prefix", default="")
    c.add_argument("--mode", choices=("path", "content"), default="path")
    c.add_argument("--ignore-noise", action="store_true")
    return p


def answer(spark: SparkSession, a: argparse.Namespace) -> object:
    """What a command prints."""
    if a.command == "consolidate":
        return {"store": inventory.consolidate(spark, a.store)}
    store = Store(spark, a.store)
    if a.command == "scan":
        scan = inventory.inventory(store, a.root, a.exclude, local_identity(store.path), a.trusted_only, a.parallelism)
        at = next(s for s in store.manifest()["scans"] if s["scan_id"] == scan)
        return Browser(store).summary(at["machine_id"], at["root"])
    if a.command == "import-s3":
        return store.import_s3(a.manifest, a.inventory)
    if a.command == "import-database":
        return {"machines": store.import_database(a.file, *local_identity(store.path))}
    if a.command == "interrupted":
        from cairnframe.operators.browse import interrupted_scans

        return listed(interrupted_scans(store.table("scans"), store.table("entries")))
    browser = Browser(store)
    if a.command == "roots":
        return browser.roots()
    if a.command == "dirs":
        return [r["dir"] for r in listed(browser.directories(a.machine, a.root))]
    if a.command == "duplicates":
        return listed(browser.duplicates(a.machine, a.root, a.prefix, a.ignore_noise))
    if a.command == "summary":
        return browser.summary(a.machine, a.root)
    sides = (a.left_machine, a.left_root), (a.right_machine, a.right_root)
    return browser.compare(*sides, a.left_prefix, a.right_prefix, a.mode, a.ignore_noise).to_json()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("cairnframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(json.dumps(answer(spark, a), ensure_ascii=False, indent=1))
    except (LookupError, ValueError, OSError, RuntimeError, OverflowError) as e:
        print(f"cairnframe: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
