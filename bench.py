"""Headline queries at one scale, each written to the no-op sink so that every row is produced; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "src1_read_logs", "snk1_event_table", "snk2_append_new", "snk3_commit_batch", "dec6_decode_logs", "dec10_drop_mirrors", "dec14_factories",
    "dec17_address_ids", "fct7_lane_sentence", "fct8_story_sentence", "cls2_settle_lane", "cls9_classify_range", "q1_daily_rollup",
    "q2_incremental_rollup", "q5_address_history", "q6_counterparties", "q8_tx_detail", "q9_tx_lane", "q11_tx_kind", "q13_block_messages",
    "q16_swap_sides", "str1_rolling_minute", "str2_event_rate", "str3_hold_join", "str4_lane_volume", "evl5_tally", "evl11_topic_truth",
    "set7_assemble_rows", "set11_replay_sample", "msr1_latency_stats",
]


def main() -> None:
    from chainloom.plans import registry
    from chainloom.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(queries)
    queries["q3_address_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    took: dict[str, float] = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    out = {"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
           "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    if "dec6_decode_logs" in took:
        out["events_per_sec"] = {n: round(events / took[n]) for n in ("dec6_decode_logs", "snk2_append_new", "q1_daily_rollup", "cls9_classify_range") if n in took}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
