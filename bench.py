"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from flowspark.functions.binary import decode_frames  # noqa: E402
from flowspark.functions.encode import encode_flows  # noqa: E402
from flowspark.operators import alerts, evaluation, history, operations, prep  # noqa: E402
from flowspark.operators.flows import emission_order, flow_aggregates, flow_measures, packets_to_flows  # noqa: E402
from flowspark.operators.scoring import score_vectors  # noqa: E402
from flowspark.operators.segments import segment_packets  # noqa: E402
from flowspark.operators.training import random_forest  # noqa: E402
from flowspark.plans.inputs import EVENT_TTL_US, scored_detections  # noqa: E402
from flowspark.plans.stream_queries import write_captures  # noqa: E402
from flowspark.session import cut_lineage, local_session  # noqa: E402
from flowspark.sources import views  # noqa: E402
from flowspark.sources.captures import read_packets  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df):
    """Run a query to its last row without collecting or storing the rows."""
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("OFF")
    # The inputs of each stage are made first, so a query's time is the stage's own.
    packets = cut_lineage(views.packets(spark, FOLDER))
    frames = cut_lineage(views.frames(spark, FOLDER))
    labelled = cut_lineage(segment_packets(packets))
    measures = cut_lineage(flow_measures(flow_aggregates(labelled)))
    numbered = cut_lineage(emission_order(measures))
    flows = cut_lineage(packets_to_flows(packets))
    vectors = cut_lineage(encode_flows(flows, "emit_no"))
    scored = cut_lineage(scored_detections(spark, FOLDER))
    pairs = cut_lineage(views.scores(spark, FOLDER))
    from pyspark.ml.functions import array_to_vector

    captures = write_captures(spark, FOLDER)

    attacker = F.startswith("srcip", F.lit("175.45.176.")).cast("double").alias("label")
    model = random_forest({"n_estimators": 20, "max_depth": 4}).fit(
        vectors.select(array_to_vector("features").alias("features"), attacker)
    )
    queries = {
        "frame_decode": lambda: decode_frames(frames),
        "packet_walk": lambda: segment_packets(packets),
        "flow_aggregation": lambda: flow_measures(flow_aggregates(labelled)),
        "emission_order": lambda: emission_order(measures),
        "history_windows": lambda: history.add_history(numbered),
        "packets_to_flows": lambda: packets_to_flows(packets),
        "capture_to_flows": lambda: packets_to_flows(read_packets(spark, captures)),
        "feature_encoding": lambda: encode_flows(flows),
        "scoring": lambda: score_vectors(vectors, model),
        "alert_dedup": lambda: alerts.flag_alerts(scored, order=["event_id"], ttl_us=EVENT_TTL_US),
        "threshold_sweep": lambda: evaluation.threshold_sweep(pairs),
        "ranking_metrics": lambda: evaluation.ranking_metrics(pairs),
        "exact_dedup": lambda: prep.drop_repeats(views.labelled(spark, FOLDER)),
        "sliding_rates": lambda: operations.sliding_rates(scored, {"scored": F.lit(True)}),
        "traffic_breakdown": lambda: operations.traffic_breakdown(packets_to_flows(views.packets(spark, FOLDER))),
    }
    rows = {"frame_decode": frames, "packet_walk": packets, "flow_aggregation": labelled, "emission_order": measures,
            "history_windows": numbered, "packets_to_flows": packets, "capture_to_flows": frames, "feature_encoding": flows, "scoring": vectors,
            "alert_dedup": scored, "threshold_sweep": pairs, "ranking_metrics": pairs, "sliding_rates": scored}
    counts = {name: df.count() for name, df in rows.items()}
    times = {}
    for name, build in queries.items():
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            consume(build())
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows_per_sec": {n: round(c / times[n]) for n, c in counts.items()},
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
