"""python -m lexweave.cli LINES OUTPUT: from a table of gazette lines to acts.

LINES is a parquet folder of issue_id, page_no, line_no, content; OUTPUT gets a folder for every format.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lexweave.plans import pipeline
from lexweave.session import ship


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexweave", description="Gazette lines to acts")
    p.add_argument("lines")
    p.add_argument("output")
    p.add_argument("--step", choices=pipeline.STEPS, default=pipeline.STEPS[-1], help="how far to go")
    p.add_argument("--single-act", help="only this act")
    p.add_argument("--fixups", help="parquet folder of patches: act_id, seq, op, needle, replacement, prev_lines")
    p.add_argument("--format", choices=pipeline.FORMATS, nargs="+", default=["json"])
    p.add_argument("--many-acts-a-file", action="store_true", help="parquet files of many acts instead of a folder an act")
    return p.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    a = arguments(argv)
    spark = ship(SparkSession.builder.appName("lexweave").getOrCreate())
    made = pipeline.run(spark.read.parquet(a.lines), a.step, a.single_act, fixups=spark.read.parquet(a.fixups) if a.fixups else None)
    if made.elements is None:
        made.acts.write.mode("overwrite").parquet(f"{a.output}/acts")
        return
    for fmt in a.format:
        pipeline.write(made.elements, fmt, f"{a.output}/{fmt}", made.semantics, not a.many_acts_a_file)


if __name__ == "__main__":
    main()
