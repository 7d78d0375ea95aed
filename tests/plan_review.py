"""Plan shape of the headline queries (final AQE plans): shuffles, join kinds, partial
WindowGroupLimits, Python stages.  Source of the README's plan review table.

    python tests/plan_review.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ["rule_report_by_vendor", "drop_blank_numbers", "snapshot_diff", "delta_with_reason", "fill_from_source",
         "formatted_report", "kpi_overview", "upsert_run_window", "match_text_to_ledger", "text_to_table",
         "extract_document_fields"]


def main() -> None:
    from tallyspark.session import build_session
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    for n in NAMES:
        df = E.queries()[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()          # final AQE plan
        p = df._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", p))
        print(f"| `{n}` | {shuffles} | {p.count('BroadcastHashJoin')} / {p.count('SortMergeJoin')} | "
              f"{p.count('WindowGroupLimit')} | {p.count('MapInPandas') + p.count('FlatMapGroupsInPandas')} |")


if __name__ == "__main__":
    main()
