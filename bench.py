"""All queries of the core library at ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioforge.plans.inputs import PARTITIONS  # noqa: E402
from folioforge.plans.registry import QUERIES  # noqa: E402
from folioforge.session import local_session  # noqa: E402

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(PARTITIONS, str(2 * spark.sparkContext.defaultParallelism))
    # JVM and Python workers come up outside the measured queries.
    spark.range(0, 64, 1, 8).mapInPandas(lambda batches: batches, "id long").count()
    seconds: dict[str, float] = {}
    for name in sorted(QUERIES):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
