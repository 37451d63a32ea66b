"""Write CATALOG.md: every registered query key, its survey ID and description.

Usage: python tools/catalog.py > CATALOG.md
"""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tallyspark.plans import ORACLES, QUERIES  # noqa: E402


def main() -> None:
    groups: dict[str, list[tuple[str, str]]] = {}
    for key, fn in QUERIES.items():
        module = fn.__wrapped_module__ if hasattr(fn, "__wrapped_module__") else "plans"
        doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
        groups.setdefault(module, []).append((key, doc))
    print("# Query catalog\n")
    print("Generated by `python tools/catalog.py`.  Every key is registered in `queries()`;")
    print("the oracle column says whether `oracle_sql()` has a DuckDB statement for it.\n")
    for module in sorted(groups):
        print(f"## {module}\n")
        print("| key | survey ID and description | oracle |")
        print("|---|---|---|")
        for key, doc in sorted(groups[module]):
            print(f"| `{key}` | {doc} | {'yes' if key in ORACLES else 'rows only'} |")
        print()
    print(f"{len(QUERIES)} queries, {len(ORACLES)} with an oracle.")


if __name__ == "__main__":
    main()
