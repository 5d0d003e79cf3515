"""python -m motrac: the names of the queries, one a line."""

from __future__ import annotations

import sys

from motrac.plans import catalog


def main() -> int:
    print("Single-cell motion and trajectory analytics on Spark. Queries:")
    for name in sorted(catalog.queries()):
        print(f"  {name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
