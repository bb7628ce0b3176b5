"""The three jobs end to end: captures to flows, flows to alerts, labelled table to model."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.contracts import ALERT_TTL_US, FLOW_COLUMNS, LINEAGE_COLUMNS, MODEL_COLUMNS
from flowspark.functions.encode import encode_flows, quoted, to_contract
from flowspark.operators import evaluation as E
from flowspark.operators import prep
from flowspark.operators import training as M
from flowspark.operators.alerts import alert_stream, audit_lines, deliver, flag_alerts
from flowspark.operators.flows import packets_to_flows
from flowspark.operators.scoring import score_onnx, score_vectors
from flowspark.session import cut_lineage
from flowspark.sources import sinks
from flowspark.sources.captures import capture_rejects, read_packets
from flowspark.sources.messages import read_labelled_csv


def extract_flows(spark: SparkSession, captures: str, packets_path: str, flows_path: str,
                  topic: dict | None = None, idle: str = "gap") -> DataFrame:
    """Decode a folder of captures, keep the packet table, and write flow records as JSON lines.

    ``topic`` (options of :func:`flowspark.sources.sinks.publish`) sends them to a topic as well. Returns
    the files that could not be read.
    """
    read_packets(spark, captures).write.mode("overwrite").parquet(packets_path)
    flows = packets_to_flows(spark.read.parquet(packets_path), idle)
    outputs = [lambda df: sinks.write_json_lines(df, flows_path, [*FLOW_COLUMNS, *LINEAGE_COLUMNS])]
    if topic is not None:
        outputs.append(lambda df: sinks.publish(df, **topic))
    sinks.fan_out(flows, outputs)
    return capture_rejects(spark, captures)


def score_flows(spark: SparkSession, flows: DataFrame, model: str | PipelineModel, scored_path: str,
                audit_path: str | None = None, threshold: float | None = None, contract: str | None = None,
                ttl_us: int = ALERT_TTL_US) -> DataFrame:
    """Score flow records, flag alerts, keep every scored flow, and return the flagged table.

    ``model`` is a fitted pipeline, or the path of an ONNX file.
    """
    limit = sinks.read_threshold(spark, contract, threshold)
    vectors = encode_flows(flows, "capture_id", "emit_no", F.col("ltime_us").alias("ts_us"))
    score = score_onnx if isinstance(model, str) else score_vectors
    scored = cut_lineage(score(vectors, model, limit))
    flagged = cut_lineage(flag_alerts(scored, order=["capture_id", "emit_no"], ttl_us=ttl_us))
    sinks.append_table(flagged, scored_path)
    if audit_path is not None:
        sinks.write_audit_log(audit_lines(flagged), audit_path)
    return flagged


def deliver_alerts(flagged: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(subscriber, alert) rows of a flagged table."""
    return deliver(alert_stream(flagged), subscribers)


def train_detector(spark: SparkSession, train_csv: str, test_csv: str, folder: str,
                   settings: dict = M.BOOSTED_BEST) -> dict:
    """Preprocess, fit boosted trees with class weights, pick the threshold, and store all of it.

    Writes ``model``, ``artifacts`` and ``contract`` under ``folder``; returns the scored test table, its
    evaluation and the threshold.
    """
    train, test = read_labelled_csv(spark, train_csv), read_labelled_csv(spark, test_csv)
    _, _, train_tree, artifacts = prep.preprocess_train(train)
    _, _, test_tree = prep.preprocess_test(test, artifacts)

    def inputs(tree: DataFrame) -> DataFrame:
        ordered = to_contract(tree.drop("label")).columns
        vector = F.array(*[
            (quoted(c) if c in tree.columns else F.lit(0)).cast("float").cast("double") for c in ordered
        ])
        return cut_lineage(tree.select(array_to_vector(vector).alias("features"), F.col("label").cast("double")))

    fitted = M.boosted_trees(settings, weight="weight").fit(M.with_attack_weight(inputs(train_tree)))
    scored = cut_lineage(fitted.transform(inputs(test_tree)).select(
        F.col("label").cast("int").alias("label"), E.attack_probability().alias("prob")
    ))
    best = E.best_threshold(scored).first()["threshold"]
    M.save_model(PipelineModel([fitted]), f"{folder}/model")
    prep.save_artifacts(spark, artifacts, f"{folder}/artifacts")
    sinks.write_contract(spark, f"{folder}/contract", best)
    return {"scored": scored, "threshold": best, "columns": MODEL_COLUMNS, **E.evaluate(scored, best)}
