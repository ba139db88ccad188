"""Command line: python -m revgraph --merge DIR --store PATH [--type TYPE] [--wipe]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from revgraph.plans.merge import commit_revision, merge_files, open_revision
from revgraph.sources.store import Store


def main() -> None:
    p = argparse.ArgumentParser(prog="revgraph")
    p.add_argument("--merge", required=True, help="folder of CSV files")
    p.add_argument("--store", required=True, help="repository directory")
    p.add_argument("--type", default=None, help="merge strategy; all give the same result")
    p.add_argument("--wipe", action="store_true", help="start from an empty repository")
    a = p.parse_args()
    store = Store(SparkSession.builder.appName("revgraph").getOrCreate(), a.store)
    if a.wipe or store.current() is None:
        store.wipe()
        open_revision(store)
        commit_revision(store)
    revision = open_revision(store)
    merge_files(store, a.merge, revision, a.type).show(truncate=False)
    commit_revision(store, revision)


if __name__ == "__main__":
    main()
