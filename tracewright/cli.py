"""Command line: `convert IN OUT --to FORMAT [--from FORMAT]` and `compare A B [--from FORMAT] [--from-b FORMAT]`.

convert writes one text file for each document below OUT; compare exits with 0 for equal
documents, 1 for different ones and 2 after an error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import setops
from .sources import read, statements, write


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("--to", default="json", choices=sorted(write.WRITERS))
    one.add_argument("--from", dest="source_format")
    two = commands.add_parser("compare")
    two.add_argument("left")
    two.add_argument("right")
    two.add_argument("--from", dest="source_format")
    two.add_argument("--from-b", dest="right_format")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if given.command == "convert":
            texts = statements.texts(spark, given.source)
            write.convert(texts, given.to, given.source_format).select("text").write.text(given.target)
            return 0
        texts = [(statements.texts(spark, p), f) for p, f in ((given.left, given.source_format), (given.right, given.right_format or given.source_format))]
        left, right = (read.from_content(t, f) for t, f in texts)
        return 0 if setops.equal(left, right, *(read.bundles_of(t, f) for t, f in texts), by_name=False) else 1
    except Exception as error:
        print(f"E: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
