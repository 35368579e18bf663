"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quarry.operators.mining import mine_topk
from quarry.plans.catalog import QUERIES
from quarry.plans.staging import scope, stage
from quarry.session import local_session
from quarry.sources.generator import GeneratorConfig, generate_profits, generate_transactions

HEADLINE = ("rtwu", "remaining_utility", "single_item_stats", "pair_join", "triple_join", "topk_exact", "topk_path", "itemsets_by_rank", "per_job_statistics", "job_statistics", "parse_transactions")
#: Published shapes: transactions, items, sizes around the published average.
SHAPES = {"small": GeneratorConfig(1_000, 100, 2, 8), "medium": GeneratorConfig(100_000, 500, 5, 15), "large": GeneratorConfig(1_000_000, 1_000, 10, 20), "dense": GeneratorConfig(10_000, 50, 20, 30), "sparse": GeneratorConfig(100_000, 5_000, 2, 4)}


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cpus, int(cpus), os.environ.get("BENCH_MEMORY", "12g"))
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(QUERIES["rtwu"](spark, sf))  # starts the JVM's compilers
    times = {name: timed(lambda name=name: noop(QUERIES[name](spark, sf))) for name in HEADLINE}
    for shape, c in SHAPES.items():
        with scope():
            tx, profit = stage(generate_transactions(spark, c), f"{shape}-tx"), stage(generate_profits(spark, c), f"{shape}-profit")
            times[f"mine_{shape}"] = timed(lambda tx=tx, profit=profit: noop(mine_topk(tx, profit, 10, 0.3)))
    print(json.dumps({"metric": "total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
