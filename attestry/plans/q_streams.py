"""Queries over row isolation, progress, resume and the stream jobs."""

from pyspark.sql import functions as F

from attestry.operators import cleaning, evaluation as evl
from attestry.plans.adapters import Tables, VIEWS, refs
from attestry.plans.q_evaluate import _JOB
from attestry.plans.q_text import FIELDS
from attestry.plans.registry import FRAGMENTS, query
from attestry.session import scratch_path
from attestry.streaming import firstseen, intake

_K = "CAST(json_extract_string(props, '$.k') AS INT)"
FRAGMENTS["isolated"] = f"""SELECT event_id, event_id % 50 AS batch_no, CASE WHEN event_type = 'error' OR {_K} % 13 = 0 THEN NULL ELSE floor(100.0 / ({_K} % 13))::BIGINT END AS result,
 CASE WHEN event_type = 'error' OR {_K} % 13 = 0 THEN 'failed' ELSE 'completed' END AS state, CASE WHEN event_type = 'error' OR {_K} % 13 = 0 THEN 'processing_error' END AS error_code,
 CASE WHEN event_type = 'error' THEN 'source row is an error event' WHEN {_K} % 13 = 0 THEN 'no result' END AS error FROM events"""


def isolated(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    rows = t.events.select("event_id", (F.col("event_id") % 50).alias("batch_no"), "event_type", k.alias("k"))
    result = F.floor(F.try_divide(F.lit(100.0), F.col("k") % 13))
    return intake.isolate(rows, result, F.when(F.col("event_type") == "error", "source row is an error event")).drop("event_type", "k")


@query("B01_isolation", "SELECT * FROM isolated")
def _(t):
    return isolated(t)


@query("B02_progress", _JOB.replace("FROM records", "FROM isolated"))
def _(t):
    return evl.job_status(isolated(t), "batch_no")


@query("B03_resume", "SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM isolated WHERE state = 'completed' AND batch_no < 40)")
def _(t):
    finished = isolated(t).where("batch_no < 40")
    return intake.pending(t.events.select("event_id", "event_type"), finished, "event_id")


@query("B04_stream_intake", f"""SELECT row_no, {", ".join(FIELDS)}, array_to_string(nullified_fields, '|') AS nullified FROM cleaned""")
def _(t):
    out, cp = scratch_path(t.spark, "intake"), scratch_path(t.spark, "intake-cp")
    source = intake.file_source(t.spark, t.folder, "part.parquet", t.part.schema)

    def enrich(batch):
        local = Tables(batch.sparkSession, t.folder)  # a micro-batch has its own session
        others = {r: local[r] for r in refs(VIEWS["catalog"]) if r != "part"}
        rows = batch.sparkSession.sql(VIEWS["catalog"], part=batch, **others)
        return cleaning.clean_catalog(rows)

    intake.run_stream(t.spark, source, enrich, out, cp)
    return t.spark.read.parquet(out).select("row_no", *FIELDS, F.array_join("nullified_fields", "|").alias("nullified"))


@query("B05_first_seen", "SELECT l_suppkey, l_linenumber, arg_min(l_partkey, ROW(l_orderkey, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1, 2")
def _(t):
    out, cp = scratch_path(t.spark, "first-seen"), scratch_path(t.spark, "first-seen-cp")
    source = intake.file_source(t.spark, t.folder, "lineitem.parquet", t.lineitem.schema)
    firstseen.grow(t.spark, source.select("l_suppkey", "l_linenumber", "l_partkey", "l_orderkey"),
                   ["l_suppkey", "l_linenumber"], ["l_partkey"], ["l_orderkey", "l_partkey"], out, cp)
    return t.spark.read.parquet(out).drop("batch")
