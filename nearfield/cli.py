"""Command line: version, info, compact, dump."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="nearfield", description=__doc__)
    kinds = parser.add_subparsers(dest="what", required=True)
    kinds.add_parser("version")
    for name in ("info", "compact", "dump"):
        kinds.add_parser(name).add_argument("path")
    given = parser.parse_args(args)
    if given.what == "version":
        print(__version__)
        return 0
    from pyspark.sql import SparkSession

    from .config import OpenMode
    from .errors import NearfieldError
    from .sources.collection import Collection

    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    try:
        with Collection.open(spark, given.path, OpenMode.READWRITE if given.what == "compact" else OpenMode.READONLY) as found:
            if given.what == "compact":
                found.compact()
            if given.what == "dump":
                for text in found.dump().toJSON().toLocalIterator():
                    print(text)
            else:
                row = found.info().first()
                print(f"nearfield {row.version_major}.{row.version_minor} | dim={row.dimension} | metric={row.metric} | index={row.index_type} | vectors={row['count']} | size={row.bytes} bytes")
        return 0
    except NearfieldError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
