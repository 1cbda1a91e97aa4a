"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "vector_search", "keyword_search_docs", "fuse_images", "fuse_docs", "rerank_mmr", "zero_shot_classify", "reverse_geocode",
    "filter_structured", "understand_queries", "search_pipeline", "index_documents", "anti_new_uploads", "sink_upsert_files",
    "agg_refresh_people", "agg_top_tags", "agg_flow_status", "win_fair_share", "face_cluster", "project_file_card", "page_keyset",
    "stream_finalize", "stream_upsert_sink",
)


def main() -> None:
    import registry
    from mediashelf.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load()
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("documents", "embeddings", "events"):  # warm the JVM and the page cache
        spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    seconds = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {seconds[key]}", file=sys.stderr, flush=True)
    out = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
