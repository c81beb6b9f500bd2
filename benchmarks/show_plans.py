"""Write the final (post-AQE) physical plan of each headline analysis to PLANS.md.

    BENCH_SF_DIR=/root/testdata/sf0.1 python benchmarks/show_plans.py > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from orderlens.operators import aggregate  # noqa: E402
from orderlens.plans.registry import QUERIES  # noqa: E402
from orderlens.session import build_session  # noqa: E402


def show(title: str, df) -> None:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = re.sub(r"#\d+L?", "", plan)
    plan = re.sub(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/", "Location: [", plan)
    plan = re.sub(r"_?-?[0-9a-f]{32}", "", plan)              # of the names of stored tables
    plan = re.split(r"\n\W*== Initial Plan ==", plan)[0]
    print(f"## {title}\n\n```\n{plan.rstrip()}\n```\n")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("local[8]", shuffle_partitions=8)
    print(f"# Final physical plans ({os.path.basename(sf_dir)}, local[8], AQE on)\n")
    print("Generated by `benchmarks/show_plans.py`: each analysis is executed, then the final "
          "adaptive plan of that execution is printed. Expression ids are stripped.\n")
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    written = []
    store = aggregate.store
    aggregate.store = lambda df, name: (written.append(df), store(df, name))[1]
    for part, threshold in (("Broadcasts by size", default), ("Broadcasts off, as where no dimension is small enough", "-1")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        print(f"# {part}\n")
        for name in HEADLINE:
            df = QUERIES[name](spark, sf_dir)
            if written:
                show(f"{name}: the cells, written once", written.pop())
            show(name, df)
    print("# Tables kept for joins, broadcasts off\n")
    show("join_inner_multiway_bucketed: items, orders and payments meet without an exchange", QUERIES["join_inner_multiway_bucketed"](spark, sf_dir))
    for title, reorder in (("in the order of statistics", "true"), ("in the order of the text", "false")):
        spark.conf.set("spark.sql.cbo.joinReorder.enabled", reorder)
        show(f"join_multiway_by_statistics, {title}", QUERIES["join_multiway_by_statistics"](spark, sf_dir))
    spark.stop()


if __name__ == "__main__":
    main()
