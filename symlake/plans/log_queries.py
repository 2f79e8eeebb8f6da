"""Stack traces, in batch and as streams."""

from pyspark.sql import functions as F

from symlake.operators import logs as G
from symlake.plans.fixtures import VIEWS, sub, table, view
from symlake.plans.registry import query
from symlake.session import Scratch
from symlake.streaming import frames as S

_FRAME = "'^\\s*at (?:[^\\s/(]*/)*([^\\s/(]+)[.]([^\\s/.(]+)[(]([^)]*)[)]'"
_FRAMES = f"""(SELECT event_id, source, replace(regexp_extract(text, {_FRAME}, 1), '.', '/') AS type_name, regexp_extract(text, {_FRAME}, 2) AS method,
  nullif(regexp_extract(text, '[(]([^:)]*):', 1), '') AS file, try_cast(regexp_extract(text, ':(\\d+)[)]', 1) AS int) AS line, contains(text, 'Native Method') AS native
  FROM {sub('log_lines')} WHERE regexp_matches(text, {_FRAME}))"""


def _frames(spark, sf):
    return G.stack_frames(view(spark, sf, "log_lines"))


@query("stack_frames", f"SELECT * FROM {_FRAMES}")
def stack_frames(spark, sf):
    return _frames(spark, sf)


_LINK_SQL = f"""
WITH d AS (SELECT type_name, count(*) AS n, min(container) AS c FROM (SELECT DISTINCT * FROM {sub('log_decls')}) GROUP BY type_name),
t AS (SELECT d.type_name, d.n, d.c, min(x.entry_path) AS e FROM d JOIN {sub('log_decls')} x ON x.type_name = d.type_name AND x.container = d.c GROUP BY ALL)
SELECT f.event_id, f.source, f.type_name, f.method, f.file, f.line, f.native, coalesce(t.n, 0) AS n_targets,
  t.c || '!/' || t.e || CASE WHEN f.native THEN '#' || split_part(f.type_name,'/',-1) || '-' || f.method || '-(*)?' ELSE '?lineNumber=' || cast(f.line AS string) END AS locator
FROM {_FRAMES} f LEFT JOIN t USING (type_name)"""


@query("link_frames", _LINK_SQL)
def link_frames(spark, sf):
    return G.link_frames(_frames(spark, sf), view(spark, sf, "log_decls"))


@query("hot_frames", f"SELECT type_name, method, line, count(*) AS n_frames FROM {_FRAMES} GROUP BY ALL")
def hot_frames(spark, sf):
    return G.hot_frames(_frames(spark, sf))


@query("column_frames", """
SELECT doc_id, i AS line_no, type_name, 'go' AS method, 'A.java' AS file, i AS line, false AS native FROM (
  SELECT doc_id, cast(unnest(generate_series(1, len(string_split(text, chr(10))))) AS int) AS i, 'org/' || source AS type_name FROM documents)""")
def column_frames(spark, sf):
    """Every line of every document, turned into a frame of its own."""
    from symlake.sources.logs import lines_from_column

    lines = lines_from_column(table(spark, sf, "documents"), "text", ["doc_id", "source"])
    return G.stack_frames(lines.selectExpr(
        "doc_id", "line_no", "concat('  at org.', source, '.go(A.java:', cast(line_no AS string), ')') AS text"))


def _event_stream(spark, sf, columns):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").selectExpr(*columns)


_TEXT = f"{VIEWS['log_lines'][2]['text']} AS text"


@query("stream_link", _LINK_SQL)
def stream_link(spark, sf):
    lines = _event_stream(spark, sf, ["event_id", f"{VIEWS['log_lines'][2]['source']} AS source", _TEXT])
    scratch = Scratch(spark, "stream-link")
    S.run_linked(lines, lambda s: view(s, sf, "log_decls"), scratch.path("out"), scratch.path("checkpoint")).awaitTermination()
    shape = S.stream_frames(lines, view(spark, sf, "log_decls")).schema
    return spark.read.schema(shape).parquet(f"{scratch.path('out')}/source=*/batch=*")


@query("stream_window_counts", f"""
SELECT cast(epoch(time_bucket(INTERVAL 1 hour, e.ts)) AS bigint) AS window_start, f.type_name, f.method, count(*) AS n_frames
FROM {_FRAMES} f JOIN events e USING (event_id) GROUP BY ALL""")
def stream_window_counts(spark, sf):
    lines = _event_stream(spark, sf, ["timestamp_seconds(unix_micros(cast(concat(cast(ts AS string), '+00:00') AS timestamp)) / 1000000) AS at", _TEXT])
    scratch = Scratch(spark, "stream-counts")
    counts = S.stream_counts(G.stack_frames(lines), "at")
    S.run_counts_to_table(counts, scratch.path("out"), scratch.path("checkpoint")).awaitTermination()
    return S.read_counts(spark, scratch.path("out")).select(
        F.unix_seconds("window_start").alias("window_start"), "type_name", "method", "n_frames")
