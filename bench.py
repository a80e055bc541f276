"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from phonolake.plans import catalogue
from phonolake.session import build_session

HEADLINE = [
    "agg01_file_statistics", "agg02_block_peaks", "agg04_pyramid", "agg07_integrated_loudness", "agg09_true_peak",
    "agg11_loudness_match_average", "agg12_block_summary", "agg29_scorecard", "prj01_gain", "win05_silences",
    "win06_clipped_runs", "win27_disc_positions", "join01_words_in_intervals", "join14_neighbour_pairs",
    "set03_merge_intervals", "agg32_word_errors", "fun01_tokens", "fun17_spectrogram", "st01_block_meter",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors before timing
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
