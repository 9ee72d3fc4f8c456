"""Run one registered query and write its result with the library's sinks.

    python -m tillbook.plans.run <query> <tables_dir> <out_path> [csv|json|parquet]

The result is written by Spark's distributed writers (nothing is collected
to the driver).  ``python -m tillbook.plans.run --list`` prints the keys.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from tillbook.plans.catalog import queries
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    if argv[0] == "--list":
        print("\n".join(sorted(queries())))
        return 0
    if len(argv) < 3:
        print(__doc__)
        return 2
    name, tables_dir, out = argv[:3]
    fmt = argv[3] if len(argv) > 3 else "parquet"
    from tillbook.plans.session import build_session
    from tillbook.sources import sinks
    spark = build_session()
    df = queries()[name](spark, tables_dir)
    if fmt == "csv":
        sinks.export_csv(df, out)
    elif fmt == "json":
        sinks.export_json(df, out)
    else:
        df.write.mode("overwrite").parquet(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
