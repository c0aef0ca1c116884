"""Write PLANS.md: the physical operator tree (``explain("formatted")``,
tree part only) of every headline query, after execution so AQE's final
plan is shown.  Usage: python scripts/plans_report.py [sf_dir]"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from zonelens.plans.registry import QUERIES  # noqa: E402
from zonelens.session import get_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n")[0]
    return "\n".join(line[:150] for line in head.splitlines())


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session(shuffle_partitions=16)
    out = ["# Physical plans of the headline queries", "",
           f"`explain(\"formatted\")` after execution (AQE final plans) at `{sf_dir}`, `local[8]`.",
           "Generated by `scripts/plans_report.py`.", ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        out += [f"## {name}", "", "```", tree(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
