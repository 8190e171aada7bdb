"""Named queries over the driver's tables, each over whole tables, with their DuckDB form.

Floating-point results are rounded to six places on both sides; every computed column is cast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.config import IndexConfig, RetrievalConfig
from chronoreel.functions.text import mcq_prompt, query_text, segment_id, url_id
from chronoreel.functions.vectors import dot
from chronoreel.operators import evaluate, halo, inference, manifest, matching, range_index, retrieve, sampling, segment_ranges, segments, signals, topk, udtf
from chronoreel.plans.adapters import customer_videos, embedding_frames, event_frames, flat_questions, table
from chronoreel.plans.index_store import IndexStore
from chronoreel.plans.pipeline import VideoIndex, baseline_frames
from chronoreel.plans.store import fresh_folder, written_once
from chronoreel.sources import frames as videos_source
from chronoreel.sources import raw, sinks
from chronoreel.sources.manifest import read_manifest
from chronoreel.streaming import ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOW, HIGH = (0.32, 2.0), (0.58, 4.0)
EVENT_LOW, EVENT_HIGH = (20.0, 86400.0), (60.0, 259200.0)
BUDGET = 8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(column: str, out: str | None = None):
    return F.round(F.col(column).cast("double"), 6).alias(out or column)


# SQL of the adapters.

_E = """
e AS (SELECT label::VARCHAR AS video_key, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame_ordinal,
  ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / 4.0)::FLOAT AS time_sec, embedding::DOUBLE[] AS embedding, vec_id FROM embeddings)"""
_V = """
v AS (SELECT user_id::VARCHAR AS video_key, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_ordinal,
  (date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 1e6::DOUBLE)::FLOAT AS time_sec, value::FLOAT AS signal FROM events)"""
_DRIFT = """
dr AS (SELECT *, coalesce(1 - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(embedding, lag(embedding) OVER (PARTITION BY video_key ORDER BY frame_ordinal)))), 0.0)::DOUBLE AS drift FROM e)"""


def _minmax_sql(x: str) -> str:
    lo, hi = f"min({x}::DOUBLE) OVER (PARTITION BY video_key)", f"max({x}::DOUBLE) OVER (PARTITION BY video_key)"
    return f"CASE WHEN abs({hi} - {lo}) <= 1e-9::DOUBLE * greatest(abs({hi}), abs({lo})) THEN 0.0::DOUBLE ELSE ({x}::DOUBLE - {lo}) / ({hi} - {lo}) END"


def _segments_sql(source: str, score: str, threshold: float, shortest: float, level: str, name: str, longest: float | None = None) -> str:
    """CTEs that end in ``name``: the segments of ``source`` (video_key, frame_ordinal, time_sec)."""
    more = f" OR (n.time_sec - b.t)::DOUBLE >= {longest}::DOUBLE" if longest else ""
    return f"""
{name}_f AS (SELECT video_key, frame_ordinal AS i, time_sec, {score}::FLOAT AS s FROM {source}),
{name}_w AS (
  SELECT video_key, i, time_sec AS t FROM {name}_f WHERE i = 0
  UNION ALL
  SELECT b.video_key, x.i, x.t FROM {name}_w b, LATERAL (
    SELECT n.i, n.time_sec AS t FROM {name}_f n WHERE n.video_key = b.video_key AND n.i > b.i
      AND ((n.s::DOUBLE >= {threshold}::DOUBLE AND (n.time_sec - b.t)::DOUBLE >= {shortest}::DOUBLE){more}) ORDER BY n.i LIMIT 1) x),
{name}_b AS (SELECT video_key, i, t FROM {name}_w UNION SELECT video_key, max(i), max_by(time_sec, i) FROM {name}_f GROUP BY 1),
{name}_p AS (SELECT video_key, i AS a, lead(i) OVER w AS b, t AS ta, lead(t) OVER w AS tb, (row_number() OVER w - 1)::INT AS no FROM {name}_b WINDOW w AS (PARTITION BY video_key ORDER BY i)),
{name} AS (
  SELECT p.video_key, '{level}' AS level, p.no AS segment_no, '{level}' || '_' || lpad(p.no::VARCHAR, 4, '0') AS segment_id, p.a AS start_index, p.b AS end_index,
    p.ta::DOUBLE AS start_time_sec, p.tb::DOUBLE AS end_time_sec, greatest(0.0::DOUBLE, p.tb::DOUBLE - p.ta::DOUBLE) AS duration_sec,
    max(f.s)::DOUBLE AS peak_score, avg(f.s::DOUBLE) AS mean_score
  FROM {name}_p p JOIN {name}_f f ON f.video_key = p.video_key AND f.i BETWEEN p.a AND p.b WHERE p.b IS NOT NULL GROUP BY ALL)"""


_SEGMENT_OUT = """video_key, level, segment_no, segment_id, start_index, end_index, round(start_time_sec, 6) AS start_time_sec, round(end_time_sec, 6) AS end_time_sec,
  round(duration_sec, 6) AS duration_sec, round(peak_score, 6) AS peak_score, round(mean_score, 6) AS mean_score"""


def _segment_rows(df: DataFrame) -> DataFrame:
    times = ("start_time_sec", "end_time_sec", "duration_sec", "peak_score", "mean_score")
    return df.select("video_key", "level", "segment_no", "segment_id", "start_index", "end_index", *[_r(c) for c in times])


def _picks_sql(n: str, k: str) -> str:
    """Even picks of n by k as a list."""
    return (
        f"CASE WHEN {n} <= 0 THEN []::INT[] WHEN {k} = 1 THEN [0] ELSE "
        f"list_transform(range({k}), lambda i: round_even(({n} - 1) * i / ({k} - 1)::DOUBLE, 0)::INT) END"
    )


def _uniform_sql(n: str, k: str) -> str:
    return f"CASE WHEN {n} <= {k} THEN list_transform(range({n}), lambda i: i::INT) ELSE {_picks_sql(n, k)} END"


# Signals -------------------------------------------------------------------------


@query(
    """
SELECT user_id::VARCHAR AS video_key, native_index, native_fps, (native_index // greatest(round_even(native_fps / 4.0, 0)::INT, 1))::INT AS frame_ordinal, round((native_index / native_fps)::FLOAT::DOUBLE, 6) AS time_sec
FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS native_index,
  CASE user_id % 4 WHEN 0 THEN 30.0 WHEN 1 THEN 25.0 WHEN 2 THEN 10.0 ELSE 29.97 END::DOUBLE AS native_fps FROM events)
WHERE native_index % greatest(round_even(native_fps / 4.0, 0)::INT, 1) = 0"""
)
def stride_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.element_at(F.array(*[F.lit(x) for x in (30.0, 25.0, 10.0, 29.97)]), (F.col("video_key").cast("int") % 4) + 1)
    native = event_frames(spark, sf_dir).select("video_key", F.col("frame_ordinal").cast("long").alias("native_index")).withColumn("native_fps", rate)
    return signals.stride(native, 4.0).select("video_key", "native_index", "native_fps", "frame_ordinal", _r("time_sec"))


@query(f"WITH {_E}, {_DRIFT} SELECT video_key, frame_ordinal, round(drift, 6) AS drift FROM dr")
def cosine_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.cosine_drift(embedding_frames(spark, sf_dir)).select("video_key", "frame_ordinal", _r("drift"))


@query(f"WITH {_V} SELECT video_key, frame_ordinal, round({_minmax_sql('signal')}, 6) AS scaled FROM v")
def minmax_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir).withColumn("scaled", signals.minmax("signal")).select("video_key", "frame_ordinal", _r("scaled"))


_THREE = f"""{_E}, {_DRIFT},
s3 AS (SELECT video_key, frame_ordinal, time_sec, drift AS openclip, abs(embedding[1]) AS dino, abs(embedding[2] - coalesce(lag(embedding[2]) OVER (PARTITION BY video_key ORDER BY frame_ordinal), embedding[2])) AS energy FROM dr),
n3 AS (SELECT video_key, frame_ordinal, time_sec, {_minmax_sql("openclip")} AS o, {_minmax_sql("dino")} AS d, {_minmax_sql("energy")} AS g FROM s3),
fu AS (SELECT video_key, frame_ordinal, time_sec, ((o * 0.45::DOUBLE + d * 0.35::DOUBLE + g * 0.2::DOUBLE) / 1.0::DOUBLE)::FLOAT AS combined FROM n3)"""


def _three_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    last = F.lag(F.col("embedding")[1]).over(Window.partitionBy("video_key").orderBy("frame_ordinal"))
    now = F.col("embedding")[1]
    rows = signals.cosine_drift(embedding_frames(spark, sf_dir), out="openclip")
    rows = rows.withColumn("dino", F.abs(F.col("embedding")[0].cast("double"))).withColumn("energy", F.abs(now.cast("double") - F.coalesce(last, now)))
    return signals.fuse(rows, IndexConfig())


@query(f"WITH {_THREE} SELECT video_key, frame_ordinal, round(combined::DOUBLE, 5) AS combined FROM fu")
def fused_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three_signals(spark, sf_dir).select("video_key", "frame_ordinal", F.round(F.col("combined").cast("double"), 5).alias("combined"))


# Segments ------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_V}, {_segments_sql('v', 'signal', *EVENT_LOW, 'low', 'lo')} SELECT {_SEGMENT_OUT} FROM lo")
def segments_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_rows(segments.segment_by_threshold(event_frames(spark, sf_dir), *EVENT_LOW, "low", score="signal"))


@query(f"WITH RECURSIVE {_V}, {_segments_sql('v', 'signal', *EVENT_HIGH, 'high', 'hi')} SELECT {_SEGMENT_OUT} FROM hi")
def segments_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_rows(segments.segment_by_threshold(event_frames(spark, sf_dir), *EVENT_HIGH, "high", score="signal"))


@query(f"WITH RECURSIVE {_V}, {_segments_sql('v', 'signal', *EVENT_HIGH, 'high', 'hi', 604800.0)} SELECT {_SEGMENT_OUT} FROM hi")
def segments_max_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_rows(segments.segment_by_threshold(event_frames(spark, sf_dir), *EVENT_HIGH, "high", max_seconds=604800.0, score="signal"))


_LEVELS = f"""{_E}, {_DRIFT},
sc AS (SELECT video_key, frame_ordinal, time_sec, {_minmax_sql("drift")} AS score FROM dr),
{_segments_sql("sc", "score", *LOW, "low", "lo")}, {_segments_sql("sc", "score", *HIGH, "high", "hi")},
sg AS (SELECT * FROM lo UNION ALL SELECT * FROM hi),
pm AS (SELECT sg.video_key, sg.level, sg.segment_no, u.p, avg(e.embedding[u.p]) AS m FROM sg JOIN e ON e.video_key = sg.video_key AND e.frame_ordinal BETWEEN sg.start_index AND sg.end_index,
  (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM e) + 1)) AS p) u GROUP BY ALL),
pn AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY video_key, level, segment_no)) AS norm FROM pm),
pv AS (SELECT video_key, level, segment_no, list((m / greatest(norm, 1e-12::DOUBLE))::FLOAT::DOUBLE ORDER BY p) AS vec FROM pn GROUP BY ALL),
sv AS (SELECT sg.*, pv.vec FROM sg JOIN pv USING (video_key, level, segment_no))"""


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, and low and high segments with pooled vectors, from the drift of the embeddings; segmented and pooled once."""
    frames = embedding_frames(spark, sf_dir)
    scored = signals.cosine_drift(frames).withColumn("score", signals.minmax("drift"))
    pooled = written_once(segments.mean_pool(frames, segments.segment_levels(scored, {"low": LOW, "high": HIGH}, score="score")))
    return frames, pooled.where(F.col("level") == "low"), pooled.where(F.col("level") == "high")


@query(f"WITH RECURSIVE {_LEVELS} SELECT video_key, level, segment_no, (p - 1)::INT AS position, round((m / greatest(norm, 1e-12::DOUBLE))::FLOAT::DOUBLE, 5) AS value FROM pn")
def segment_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, low, high = _levels(spark, sf_dir)
    rows = low.unionAll(high).select("video_key", "level", "segment_no", F.posexplode("embedding").alias("position", "value"))
    return rows.select("video_key", "level", "segment_no", "position", F.round(F.col("value").cast("double"), 5).alias("value"))


# Retrieval -----------------------------------------------------------------------

_HITS = f"""{_LEVELS},
qv AS (SELECT video_key, 'q' || vec_id::VARCHAR AS question_id, embedding AS query FROM e WHERE vec_id % 100 = 0),
th AS (SELECT *, row_number() OVER (PARTITION BY video_key, question_id ORDER BY score DESC, segment_no) AS rank
  FROM (SELECT sv.*, question_id, list_dot_product(vec, query) AS score FROM sv JOIN qv USING (video_key) WHERE level = 'high') QUALIFY rank <= 2),
tl AS (SELECT *, row_number() OVER (PARTITION BY video_key, question_id ORDER BY score DESC, segment_no) AS rank
  FROM (SELECT sv.*, question_id, list_dot_product(vec, query) AS score FROM sv JOIN qv USING (video_key) WHERE level = 'low'
    AND EXISTS (SELECT 1 FROM th WHERE th.video_key = sv.video_key AND th.question_id = qv.question_id AND sv.start_index >= th.start_index AND sv.end_index <= th.end_index))
  QUALIFY rank <= 3)"""
_HIT_OUT = """video_key, question_id, level, segment_id, rank::INT AS rank, round(score, 5) AS score, start_index, end_index, round(start_time_sec, 6) AS start_time_sec,
  round(end_time_sec, 6) AS end_time_sec, round(duration_sec, 6) AS duration_sec"""


def _questions(frames: DataFrame) -> DataFrame:
    """The vectors whose id is divisible by 100, each asked of its own video."""
    rows = frames.where(F.col("vec_id") % 100 == 0)
    return rows.select("video_key", F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("question_id"), F.col("embedding").alias("query"))


def _hit_rows(hits: DataFrame) -> DataFrame:
    return hits.select(
        "video_key", "question_id", "level", "segment_id", F.col("rank").cast("int").alias("rank"), F.round("score", 5).alias("score"),
        "start_index", "end_index", _r("start_time_sec"), _r("end_time_sec"), _r("duration_sec"),
    )


@query(f"WITH RECURSIVE {_HITS} SELECT {_HIT_OUT} FROM th")
def top_high_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _, high = _levels(spark, sf_dir)
    return _hit_rows(retrieve.top_segments(high, _questions(frames), 2))


@query(f"WITH RECURSIVE {_HITS} SELECT {_HIT_OUT} FROM tl")
def low_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, low, high = _levels(spark, sf_dir)
    asked = _questions(frames)
    return _hit_rows(retrieve.low_candidates(retrieve.top_segments(high, asked, 2), low, asked, 3))


def _evidence_sql(hits: str, frames: str, budget: int) -> str:
    n = "end_index - start_index + 1"
    return f"""
ev_k AS (SELECT *, greatest(1, {budget} // count(*) OVER (PARTITION BY video_key, question_id)) AS k FROM {hits}),
ev_p AS (SELECT DISTINCT video_key, question_id, start_index + unnest({_uniform_sql(f"({n})", "k")}) AS frame_index FROM ev_k),
ev_l AS (SELECT video_key, question_id, list(frame_index ORDER BY frame_index) AS l, count(*) AS n FROM ev_p GROUP BY ALL),
ev_c AS (SELECT video_key, question_id, CASE WHEN n <= {budget} THEN l ELSE list_transform({_picks_sql("n", str(budget))}, lambda j: l[j + 1]) END AS c FROM ev_l),
ev_o AS (SELECT video_key, question_id, unnest(range(len(c)))::INT AS position, unnest(c)::INT AS frame_index FROM ev_c),
ev AS (SELECT o.*, f.time_sec::DOUBLE AS time_sec FROM ev_o o JOIN {frames} f ON f.video_key = o.video_key AND f.frame_ordinal = o.frame_index)"""


@query(f"WITH RECURSIVE {_HITS}, {_evidence_sql('tl', 'e', BUDGET)} SELECT video_key, question_id, position, frame_index, round(time_sec, 6) AS time_sec FROM ev")
def flagship_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, low, high = _levels(spark, sf_dir)
    asked = _questions(frames)
    hits = retrieve.low_candidates(retrieve.top_segments(high, asked, 2), low, asked, 3)
    return retrieve.evidence_frames(hits, frames, BUDGET).select("video_key", "question_id", "position", "frame_index", _r("time_sec"))


_EVENT_HITS = f"{_V}, {_segments_sql('v', 'signal', *EVENT_HIGH, 'high', 'hi')}, eh AS (SELECT *, 'q' AS question_id FROM hi QUALIFY row_number() OVER (PARTITION BY video_key ORDER BY peak_score DESC, segment_no) <= 3)"


def _event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from the three segments of each user with the highest peaks."""
    frames = event_frames(spark, sf_dir)
    found = segments.segment_by_threshold(frames, *EVENT_HIGH, "high", score="signal")
    hits = retrieve._best(found.withColumn("question_id", F.lit("q")).withColumn("score", F.col("peak_score")), 3)
    return retrieve.evidence_frames(hits, frames, BUDGET)


@query(f"WITH RECURSIVE {_EVENT_HITS}, {_evidence_sql('eh', 'v', BUDGET)} SELECT video_key, question_id, position, frame_index, round(time_sec, 6) AS time_sec FROM ev")
def evidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_evidence(spark, sf_dir).select("video_key", "question_id", "position", "frame_index", _r("time_sec"))


@query(
    f"""WITH RECURSIVE {_EVENT_HITS}, {_evidence_sql("eh", "v", BUDGET)}
SELECT video_key, question_id, position, lpad(position::VARCHAR, 2, '0') || '_' || replace(printf('%.2f', time_sec), '.', '_') || 's.png' AS file_name FROM ev"""
)
def evidence_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.frame_names(_event_evidence(spark, sf_dir)).select("video_key", "question_id", "position", "file_name")


_PICKED = "SELECT video_key, unnest(range(len(c)))::INT AS position, unnest(c)::INT AS frame_index FROM (SELECT video_key, {} AS c FROM (SELECT user_id::VARCHAR AS video_key, count(*) AS n FROM events GROUP BY 1))"


@query(_PICKED.format(_uniform_sql("n", "64")))
def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.uniform_frames(event_frames(spark, sf_dir), 64)


@query(_PICKED.format(_picks_sql("n", "8")))
def resample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.resample_exact(event_frames(spark, sf_dir), 8)


@query(
    """
WITH q AS (SELECT DISTINCT user_id FROM events),
x AS (SELECT user_id, count_if(event_type = 'click')::INT AS n FROM events GROUP BY 1 HAVING user_id % 3 <> 0)
SELECT q.user_id::VARCHAR AS video_key, 'q' AS question_id, (CASE WHEN n IS NULL THEN 64 ELSE greatest(1, n) END)::INT AS frame_budget FROM q LEFT JOIN x USING (user_id)"""
)
def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("video_key", F.col("user_id").cast("string")).withColumn("question_id", F.lit("q"))
    asked = events.select("video_key", "question_id").distinct()
    exported = events.where(F.col("user_id") % 3 != 0).groupBy("video_key", "question_id").agg(F.count_if(F.col("event_type") == "click").cast("int").alias("n_frames"))
    return retrieve.frame_budget(asked, exported, 64)


# Manifests -----------------------------------------------------------------------

_FLAT = """
fl AS (SELECT lpad(conv_id::VARCHAR, 6, '0') AS video_id, lang AS duration, source AS domain, 'sub' || (conv_id % 3)::VARCHAR AS sub_category,
  CASE WHEN conv_id % 2 = 0 THEN 'c' || conv_id::VARCHAR ELSE 'c' || conv_id::VARCHAR END AS url, lpad(conv_id::VARCHAR, 6, '0') || '-' || turn::VARCHAR AS question_id,
  role AS task_type, c.text AS question, ['A. yes', 'B. no', 'C. both', 'D. neither'] AS options, ['A', 'B', 'C', 'D'][((conv_id + turn) % 4 + 1)::INT] AS answer, conv_id, turn
  FROM conversations c JOIN documents d ON d.doc_id = c.conv_id)"""
_FLAT_OUT = "video_id, duration, domain, sub_category, url, question_id, task_type, question, array_to_string(options, '|') AS options, answer"


def _joined_options(df: DataFrame) -> DataFrame:
    return df.withColumn("options", F.array_join("options", "|"))


@query(f"WITH {_FLAT} SELECT video_id, url, duration, domain, sub_category, (row_number() OVER (PARTITION BY video_id, url ORDER BY question_id, turn) - 1)::INT AS position, question_id, answer FROM fl")
def manifest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = manifest.group_flat(flat_questions(spark, sf_dir))
    return grouped.select("video_id", "url", "duration", "domain", "sub_category", F.posexplode("questions").alias("position", "q")).select(
        "video_id", "url", "duration", "domain", "sub_category", "position", "q.question_id", "q.answer"
    )


@query(f"WITH {_FLAT} SELECT {_FLAT_OUT} FROM fl")
def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_options(manifest.question_rows(manifest.group_flat(flat_questions(spark, sf_dir))))


@query(
    f"""WITH {_FLAT}, vi AS (SELECT DISTINCT video_id, url, duration, domain, sub_category FROM fl)
SELECT 'video_count' AS stat, '' AS key, count(*)::BIGINT AS n FROM vi UNION ALL SELECT 'question_count', '', count(*)::BIGINT FROM fl
UNION ALL SELECT 'by_duration', duration, count(*)::BIGINT FROM vi GROUP BY 2 UNION ALL SELECT 'by_domain', domain, count(*)::BIGINT FROM vi GROUP BY 2
UNION ALL SELECT 'by_sub_category', sub_category, count(*)::BIGINT FROM vi GROUP BY 2
UNION ALL SELECT 'by_duration_domain', duration || ' | ' || domain, count(*)::BIGINT FROM vi GROUP BY 2
UNION ALL SELECT 'by_task_type', task_type, count(*)::BIGINT FROM fl GROUP BY 2"""
)
def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.stats(manifest.group_flat(flat_questions(spark, sf_dir)))


@query(
    """
SELECT page_id, CASE WHEN strpos(u, 'watch?v=') > 0 THEN substr(u, strpos(u, 'watch?v=') + 8) ELSE u END AS url_id
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://v.example/watch?v=' || url ELSE url END AS u FROM pages)"""
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://v.example/watch?v="), F.col("url"))).otherwise(F.col("url"))
    return pages.select("page_id", url_id(F.lit(""), url).alias("url_id"))


@query(
    """
SELECT c_custkey::BIGINT AS row_no, c_name AS url, t.target_no::INT AS target_no
FROM customer JOIN (VALUES ('Customer#000000003', 0), ('Customer#000000001', 1), ('nobody', 2)) t(name, target_no) ON c_name = t.name"""
)
def target_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = manifest.select_targets(customer_videos(spark, sf_dir), ["Customer#000000003", "Customer#000000001", "nobody"])
    return picked.select("row_no", "url", "target_no")


# Sampling ------------------------------------------------------------------------

_CUSTOMERS = "cu AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS video_id, c_mktsegment AS duration, c_nationkey::VARCHAR AS domain, c_name AS url, c_custkey AS row_no FROM customer)"


def _sample_sql(size: str, part: str) -> str:
    """Rows of cu that a stratified sample of ``size`` within ``part`` draws."""
    over = f"PARTITION BY {part}" if part else ""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""WITH {_CUSTOMERS},
st AS (SELECT duration, domain, count(*) AS n, min(row_no) AS f FROM cu GROUP BY ALL),
sz AS (SELECT *, {size} AS size, sum(n) OVER ({over}) AS total FROM st),
ra AS (SELECT *, size * (n / total::DOUBLE) AS raw FROM sz WHERE size IS NOT NULL),
ba AS (SELECT *, least(n, greatest(1, floor(raw)))::BIGINT AS base FROM ra),
de AS (SELECT *, sum(base) OVER ({over}) - size AS d FROM ba),
ru AS (SELECT *, coalesce(sum(base - 1) OVER ({over} ORDER BY base DESC, n DESC, f {before}), 0) AS took, coalesce(sum(n - base) OVER ({over} ORDER BY raw - floor(raw) DESC, f {before}), 0) AS gave FROM de),
tg AS (SELECT duration, domain, CASE WHEN size >= total THEN n ELSE base - greatest(0, least(d - took, base - 1)) + greatest(0, least(-d - gave, n - base)) END AS target FROM ru)
SELECT video_id, duration, domain, url FROM (SELECT cu.*, row_number() OVER (PARTITION BY duration, domain ORDER BY md5('7|' || url), url) AS r FROM cu) JOIN tg USING (duration, domain) WHERE r <= target"""


def _strata_size(videos: DataFrame) -> int:
    """Room for every stratum and half as many again."""
    return (3 * videos.select("duration", "domain").distinct().count() + 1) // 2


_SAMPLE = _sample_sql("(SELECT (3 * count(*) + 1) // 2 FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer))", "")


@query(_SAMPLE)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = customer_videos(spark, sf_dir)
    return sampling.stratified_sample(videos, _strata_size(videos), 7).select("video_id", "duration", "domain", "url")


@query(_sample_sql("CASE duration WHEN 'BUILDING' THEN 26 WHEN 'MACHINERY' THEN 27 END", "duration"))
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sampling.quota_sample(customer_videos(spark, sf_dir), {"BUILDING": 26, "MACHINERY": 27}, 7)
    return drawn.select("video_id", "duration", "domain", "url")


def _stage_sql(number: int, fields: str) -> str:
    part, match = (f"PARTITION BY {fields}", f"USING ({fields})") if fields else ("", "ON true")
    return f"""SELECT a.video_id AS slot, f.url, {number} AS stage, tie FROM act a JOIN (SELECT *, row_number() OVER ({part} ORDER BY tie, url) AS r FROM fr) f {match}
WHERE r <= (SELECT count(*) FROM act)"""


@query(
    f"""WITH act AS ({_SAMPLE}), fr AS (SELECT c_mktsegment AS duration, c_nationkey::VARCHAR AS domain, c_name AS url, md5('7|' || c_name) AS tie FROM customer WHERE c_name NOT IN (SELECT url FROM act)),
al AS ({" UNION ALL ".join(_stage_sql(n, f) for n, f in enumerate(("duration, domain", "duration", "duration, domain", "")))})
SELECT slot, url, min(stage)::INT AS stage, any_value(tie) AS tie FROM al GROUP BY slot, url"""
)
def replacement_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements for every place of the sample, which itself is the active set."""
    videos = customer_videos(spark, sf_dir)
    size = _strata_size(videos)
    sample = written_once(sampling.stratified_sample(videos, size, 7))
    slots = sample.select(F.col("video_id").alias("slot"), "duration", "domain")
    return sampling.replacement_candidates(slots, videos, sample, videos.limit(0), sample.count(), 7, enforce_duration=True).select("slot", "url", "stage", "tie")


@query(
    f"""WITH act AS ({_SAMPLE}), ok AS (SELECT * FROM act WHERE md5(url) >= '1'), lost AS (SELECT *, row_number() OVER (ORDER BY video_id, url) - 1 AS slot FROM act WHERE md5(url) < '1')
SELECT (SELECT count(*) FROM act)::BIGINT AS n_sample, (SELECT count(*) FROM lost)::BIGINT AS n_replaced,
  (SELECT count(DISTINCT url) FROM lost)::BIGINT AS n_replacements, 0::BIGINT AS n_unavailable,
  (SELECT count(*) FROM lost JOIN (SELECT c_mktsegment AS duration, c_nationkey::VARCHAR AS domain, count(*) AS spare FROM customer WHERE md5(c_name) >= '1' AND c_name NOT IN (SELECT url FROM act) GROUP BY ALL) USING (duration, domain))::BIGINT AS n_same_bucket"""
)
def replacement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a sample whose unavailable videos were replaced: each once, by an available one, from its bucket if that has any."""
    videos = customer_videos(spark, sf_dir)
    here = videos.where(F.md5(F.col("url").cast("binary")) >= "1").select("url")
    sample = written_once(sampling.stratified_sample(videos, _strata_size(videos), 7))
    out, log = sampling.validate_and_replace(sample, videos, here, 7, enforce_duration=True)
    name = lambda side: videos.select(F.col("url").alias(f"{side}_url"), F.concat_ws("|", "duration", "domain").alias(side))
    pairs = log.join(name("replaced"), "replaced_url").join(name("replacement"), "replacement_url")
    figures = pairs.agg(F.count(F.lit(1)).alias("n_replaced"), F.count_distinct("replacement_url").alias("n_replacements"), F.count_if(F.col("replaced") == F.col("replacement")).alias("n_same_bucket"))
    whole = out.agg(F.count(F.lit(1)).alias("n_sample")).join(out.join(here, "url", "left_anti").agg(F.count(F.lit(1)).alias("n_unavailable")))
    return whole.join(figures)


# Text and answers ----------------------------------------------------------------


@query(
    f"""WITH {_FLAT} SELECT question_id, 'Look.' || chr(10) || 'Answer the multiple-choice question using only the evidence shown.' || chr(10) || 'Reply with only one letter: A, B, C, or D.' || chr(10) || chr(10)
|| 'Question: ' || question || chr(10) || 'Options:' || chr(10) || array_to_string(options, chr(10)) AS prompt FROM fl"""
)
def mcq_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_questions(spark, sf_dir).select("question_id", mcq_prompt(F.col("question"), F.col("options"), "Look.").alias("prompt"))


@query(f"WITH {_FLAT} SELECT question_id, question || chr(10) || array_to_string(options, chr(10)) AS query FROM fl")
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_questions(spark, sf_dir).select("question_id", query_text(F.col("question"), F.col("options")).alias("query"))


_SAID = r"""
sa AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 4 THEN 'E ' ELSE substr('ABCD', (conv_id % 5 + 1)::INT, 1) || ' ' END || regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS raw_text, ['A', 'B', 'C', 'D'][((conv_id + turn) % 4 + 1)::INT] AS gold_letter FROM conversations),
ju AS (SELECT *, nullif(regexp_extract(upper(raw_text), '\b([A-D])\b', 1), '') AS predicted_letter FROM sa)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers: a letter from the conversation's id, then the turn's ASCII text."""
    letter = F.element_at(F.array(*[F.lit(x) for x in ("A ", "B ", "C ", "D ", "E ")]), (F.col("conv_id") % 5 + 1).cast("int"))
    gold = F.element_at(F.array(*map(F.lit, "ABCD")), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return evaluate.judged(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(letter, text).alias("raw_text"), gold.alias("gold_letter")))


@query(f"WITH {_SAID} SELECT conv_id, turn, predicted_letter, coalesce(predicted_letter = gold_letter, false) AS choice_correct FROM ju")
def parse_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("conv_id", "turn", "predicted_letter", "choice_correct")


@query(f"WITH {_SAID} SELECT count(*)::BIGINT AS n_questions, round(coalesce(avg(CASE WHEN predicted_letter IS NOT DISTINCT FROM gold_letter THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE, 6) AS choice_accuracy FROM ju")
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_said(spark, sf_dir)).select("n_questions", _r("choice_accuracy"))


# Results -------------------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: turns as questions and answers, with turn % 3 evidence frames each."""
    said = _said(spark, sf_dir).select("conv_id", "turn", "raw_text", F.col("gold_letter").alias("answer"))
    asked = said.withColumn("video_key", F.col("conv_id").cast("string")).withColumn("question_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    places = F.sequence(F.lit(0), (F.col("turn") % 3).cast("int"))
    shown = asked.select("video_key", "question_id", F.posexplode(F.slice(places, F.lit(1), F.size(places) - 1)).alias("position", "p"))
    shown = shown.select("video_key", "question_id", "position", (F.col("p") * 5).alias("frame_index"))
    predictions = asked.select("video_key", "question_id", "raw_text", F.lit(0.25).alias("generation_sec"))
    return evaluate.result_rows(asked.select("video_key", "question_id", "answer"), predictions, evidence_frames=shown)


_RESULTS = f"""{_SAID},
re AS (SELECT conv_id::VARCHAR AS video_key, conv_id::VARCHAR || '-' || turn::VARCHAR AS question_id, raw_text, 0.25::DOUBLE AS generation_sec, gold_letter, predicted_letter,
  coalesce(predicted_letter = gold_letter, false) AS choice_correct, array_to_string(list_transform(range(turn % 3), lambda i: i * 5), '|') AS frames FROM ju)"""


@query(f"WITH {_RESULTS} SELECT * FROM re")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    frames = F.array_join(F.transform("evidence_frames", lambda x: x["frame_index"].cast("string")), "|")
    return rows.select("video_key", "question_id", "raw_text", "generation_sec", "gold_letter", "predicted_letter", "choice_correct", frames.alias("frames"))


@query(
    f"""WITH {_RESULTS} SELECT 'm.json' AS manifest_path, '/videos' AS video_root, count(DISTINCT video_key)::BIGINT AS videos, count(*)::BIGINT AS question_count,
  round(avg(choice_correct::INT)::DOUBLE, 6) AS choice_accuracy, '{{"max_evidence_frames": 8}}' AS config, 1.5::DOUBLE AS elapsed_sec FROM re"""
)
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.summary(_results(spark, sf_dir), {"max_evidence_frames": 8}, 1.5, "m.json", "/videos")
    return out.withColumn("choice_accuracy", _r("choice_accuracy"))


@query(
    f"""
WITH q AS (SELECT DISTINCT user_id, event_type FROM events), c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
x AS (SELECT user_id, event_type, count(*)::INT AS k FROM events GROUP BY ALL HAVING event_type <> 'view'),
b AS (SELECT user_id::VARCHAR AS video_key, event_type AS question_id, n, (CASE WHEN k IS NULL THEN 64 ELSE greatest(1, k) END)::INT AS budget FROM q JOIN c USING (user_id) LEFT JOIN x USING (user_id, event_type)),
l AS (SELECT video_key, question_id, budget, {_uniform_sql("n", "budget")} AS c FROM b)
SELECT video_key, question_id, budget AS frame_budget, unnest(range(len(c)))::INT AS position, unnest(c)::INT AS frame_index FROM l"""
)
def baseline_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even frames for each question, as many as retrieval showed where that is known."""
    events = event_frames(spark, sf_dir)
    kinds = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_key"), F.col("event_type").alias("question_id"))
    shown = kinds.where(F.col("question_id") != "view").groupBy("video_key", "question_id").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))
    return baseline_frames(kinds.distinct(), events, 64, shown).select("video_key", "question_id", "frame_budget", "position", "frame_index")


_PIXELS = ", ".join(f"(event_id * {k + 3}) % 256 AS p{k}" for k in range(4))


@query(
    f"""
WITH p AS (SELECT user_id::VARCHAR AS video_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, {_PIXELS} FROM events)
SELECT video_key, i::INT AS frame_ordinal, round(coalesce(({" + ".join(f"abs(p{k} - lag(p{k}) OVER w)" for k in range(4))}) / 4.0::DOUBLE / 255, 0)::FLOAT::DOUBLE, 6) AS energy
FROM p WINDOW w AS (PARTITION BY video_key ORDER BY i)"""
)
def frame_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of images of two by two grey pixels, made from the ids of events."""
    from pyspark.sql import Window

    order = Window.partitionBy("video_key").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("video_key", F.col("user_id").cast("string")).withColumn("frame_ordinal", F.row_number().over(order) - 1)
    data = F.unhex(F.concat(*[F.lpad(F.hex((F.col("event_id") * (k + 3)) % 256), 2, "0") for k in range(4)]))
    image = F.struct(F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    return halo.frame_energy(rows.select("video_key", "frame_ordinal", image.alias("image"))).select("video_key", "frame_ordinal", _r("energy"))


# Long videos, files and rounds ------------------------------------------------------


@query(f"WITH {_E}, {_DRIFT} SELECT video_key, frame_ordinal, round(drift, 6) AS drift FROM dr")
def drift_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift where the frames of a video lie in several tasks and stay there."""
    frames = embedding_frames(spark, sf_dir).repartitionByRange("video_key", "frame_ordinal")
    return halo.cosine_drift(frames).select("video_key", "frame_ordinal", _r("drift"))


_T = """
ty AS (SELECT event_type AS video_key, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::INT AS frame_ordinal,
  (date_diff('microsecond', min(ts) OVER (PARTITION BY event_type), ts) / 1e6::DOUBLE)::FLOAT AS time_sec, value::FLOAT AS signal FROM events)"""
TYPE_LOW, TYPE_HIGH = (150.0, 3600.0), (250.0, 14400.0)


def _type_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a few long videos, one for each type."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_key")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("video_key"), "ts", "event_id", F.col("value").cast("float").alias("signal"))
    seconds = F.expr("timestampdiff(MICROSECOND, min(ts) OVER (PARTITION BY video_key), ts)") / 1e6
    return rows.select("video_key", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("frame_ordinal"), seconds.cast("float").alias("time_sec"), "signal")


@query(
    f"""WITH RECURSIVE {_T}, {_segments_sql("ty", "signal", *TYPE_LOW, "low", "lo")}, {_segments_sql("ty", "signal", *TYPE_HIGH, "high", "hi")}
SELECT {_SEGMENT_OUT} FROM lo UNION ALL SELECT {_SEGMENT_OUT} FROM hi"""
)
def segments_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels of long videos, each spread over many ranges."""
    return _segment_rows(segment_ranges.segment_levels(_type_frames(spark, sf_dir), {"low": TYPE_LOW, "high": TYPE_HIGH}, score="signal", ranges=16))


@query(f"WITH RECURSIVE {_T}, {_segments_sql('ty', 'signal', *TYPE_HIGH, 'high', 'hi', 21600.0)} SELECT {_SEGMENT_OUT} FROM hi")
def segments_ranges_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_rows(segment_ranges.segment_levels(_type_frames(spark, sf_dir), {"high": TYPE_HIGH}, 21600.0, "signal", ranges=16))


@query(f"WITH RECURSIVE {_LEVELS} SELECT video_key, level, segment_no, (p - 1)::INT AS position, round((m / greatest(norm, 1e-12::DOUBLE))::FLOAT::DOUBLE, 5) AS value FROM pn")
def segment_pool_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled vectors of both levels from one index of running sums, without a row for each frame of a segment."""
    frames = embedding_frames(spark, sf_dir)
    scored = written_once(signals.cosine_drift(frames).withColumn("score", signals.minmax("drift")))
    found = segments.segment_levels(scored, {"low": LOW, "high": HIGH}, score="score")
    pooled = range_index.pool(range_index.build(scored, block_rows=16), found)
    rows = pooled.select("video_key", "level", "segment_no", F.posexplode("embedding").alias("position", "value"))
    return rows.select("video_key", "level", "segment_no", "position", F.round(F.col("value").cast("double"), 5).alias("value"))


@query(
    f"""WITH RECURSIVE {_T}, {_segments_sql("ty", "signal", *TYPE_LOW, "low", "lo")}, {_segments_sql("ty", "signal", *TYPE_HIGH, "high", "hi")}
SELECT video_key, level, segment_no, round(peak_score, 6) AS peak_score, round(mean_score, 6) AS mean_score FROM lo UNION ALL SELECT video_key, level, segment_no, round(peak_score, 6), round(mean_score, 6) FROM hi"""
)
def segment_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak and mean of the segments of long videos, from an index of block maxima and sums."""
    frames = written_once(_type_frames(spark, sf_dir).withColumn("embedding", F.array(F.col("signal"))))
    index = range_index.build(frames, score="signal", block_rows=16)
    found = segment_ranges.segment_levels(frames, {"low": TYPE_LOW, "high": TYPE_HIGH}, score="signal", ranges=16)
    return range_index.peaks(index, found).select("video_key", "level", "segment_no", _r("peak_score"), _r("mean_score"))


@query(f"WITH RECURSIVE {_V}, {_segments_sql('v', 'signal', *EVENT_LOW, 'low', 'lo')} SELECT {_SEGMENT_OUT} FROM lo")
def segments_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segments_low`` from a stream whose events come up to three days late, put in order by event time.

    The events are written in the order of their arrival, a few micro-batches; one event far later lets the watermark pass all.
    """
    root = fresh_folder(spark)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.col("value").alias("score"))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("tie"), F.lit(3 * 86_400_000_000))
    quarters = rows.select(F.percentile_approx(arrival, [0.25, 0.5, 0.75]).alias("q")).first()["q"]
    number = sum(((arrival > q).cast("int") for q in quarters), F.lit(0))
    for i in range(4):
        rows.where(number == i).coalesce(1).write.parquet(f"{root}/in/part={i}")
    far = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("video_key"), (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"), F.lit(0).cast("long").alias("tie"), F.lit(0.0).alias("score"))
    far.coalesce(1).write.parquet(f"{root}/in/part=4")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*")
    closed = ordered.segment_events(source, *EVENT_LOW, delay="3 days", idle_seconds=900 * 86_400.0)
    query = closed.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(ordered.OUT).parquet(f"{root}/out")
    return _segment_rows(found.select(F.lit("low").alias("level"), segment_id(F.lit("low"), F.col("segment_no")).alias("segment_id"), "*"))


@query(f"WITH RECURSIVE {_V}, {_segments_sql('v', 'signal', *EVENT_HIGH, 'high', 'hi', 604800.0)} SELECT {_SEGMENT_OUT} FROM hi")
def segments_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, called from SQL."""
    udtf.register(spark)
    frames = event_frames(spark, sf_dir).withColumnRenamed("signal", "score")
    call = "SELECT * FROM segment_frames(TABLE(SELECT * FROM {frames}) PARTITION BY video_key ORDER BY (frame_ordinal), %rD, %rD, 604800D)" % EVENT_HIGH
    found = spark.sql(call, frames=frames)
    return _segment_rows(found.select(F.lit("high").alias("level"), segment_id(F.lit("high"), F.col("segment_no")).alias("segment_id"), "*"))


def _drift_index(frames: DataFrame) -> VideoIndex:
    scored = written_once(signals.cosine_drift(frames).withColumn("score", signals.minmax("drift")))
    pooled = written_once(segments.mean_pool(frames, segments.segment_levels(scored, {"low": LOW, "high": HIGH}, score="score")))
    return VideoIndex(scored.drop("embedding"), pooled.where(F.col("level") == "high"), pooled.where(F.col("level") == "low"))


@query(f"WITH RECURSIVE {_HITS}, {_evidence_sql('tl', 'e', BUDGET)} SELECT video_key, question_id, position, frame_index, round(time_sec, 6) AS time_sec FROM ev")
def stored_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship from an index on disk that first had some of the videos and grew by the others."""
    frames = embedding_frames(spark, sf_dir)
    store = IndexStore(spark, fresh_folder(spark), shards=8)
    store.grow(frames.where(F.col("video_key") < "5"), _drift_index)
    store.grow(frames, _drift_index)
    found = store.retrieve(_questions(frames), RetrievalConfig(2, 3, BUDGET))
    return found["evidence"].select("video_key", "question_id", "position", "frame_index", _r("time_sec"))


@query(
    f"""WITH RECURSIVE {_LEVELS},
qv AS (SELECT video_key, 'q' || vec_id::VARCHAR AS question_id, embedding AS query FROM e WHERE vec_id % 100 = 0),
th AS (SELECT *, row_number() OVER (PARTITION BY video_key, question_id ORDER BY score DESC, segment_no) AS rank
  FROM (SELECT sv.*, question_id, list_dot_product(vec, query) AS score FROM sv JOIN qv USING (video_key) WHERE level = 'low') QUALIFY rank <= 3) SELECT {_HIT_OUT} FROM th"""
)
def top_low_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest low segments of each question, by blocks whose bounds reach the third score."""
    frames, low, _ = _levels(spark, sf_dir)
    return _hit_rows(topk.top_segments(topk.blocks(low, 4), _questions(frames), 3)[0])


@query(
    f"""WITH {_T}, en AS (SELECT video_key, min(time_sec)::DOUBLE AS t0, max(time_sec)::DOUBLE AS t1 FROM ty GROUP BY 1),
px AS (SELECT ty.video_key, least(floor((time_sec::DOUBLE - t0) / (t1 - t0) * 50), 49)::INT AS pixel, frame_ordinal, time_sec::DOUBLE AS time_sec, signal::DOUBLE AS value FROM ty JOIN en USING (video_key)),
mm AS (SELECT video_key, pixel, min(value) AS lo, max(value) AS hi FROM px GROUP BY ALL)
SELECT DISTINCT video_key, pixel, frame_ordinal, round(time_sec, 6) AS time_sec, round(value, 6) AS value FROM px JOIN mm USING (video_key, pixel)
WHERE value IN (lo, hi) QUALIFY row_number() OVER (PARTITION BY video_key, pixel, value ORDER BY frame_ordinal) = 1"""
)
def plot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plot fifty pixels wide shows of each event type's values."""
    found = sinks.decimated(_type_frames(spark, sf_dir), 50, ("signal",))
    return found.select("video_key", "pixel", "frame_ordinal", _r("time_sec"), _r("value"))


def _pixel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as native frames with images of two by two grey pixels."""
    from pyspark.sql import Window

    order = Window.partitionBy("video_key").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("video_key", F.col("user_id").cast("string")).withColumn("native_index", (F.row_number().over(order) - 1).cast("long"))
    rate = F.element_at(F.array(*[F.lit(x) for x in (30.0, 25.0, 10.0, 29.97)]), (F.col("user_id") % 4 + 1).cast("int"))
    data = F.unhex(F.concat(*[F.lpad(F.hex((F.col("event_id") * (k + 3)) % 256), 2, "0") for k in range(4)]))
    image = F.struct(F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    return rows.select("video_key", "native_index", rate.alias("native_fps"), image.alias("image"))


_PX = f"""
px AS (SELECT user_id::VARCHAR AS video_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS native_index,
  CASE user_id % 4 WHEN 0 THEN 30.0 WHEN 1 THEN 25.0 WHEN 2 THEN 10.0 ELSE 29.97 END::DOUBLE AS native_fps,
  {" || ".join(f"lpad(upper(to_hex((event_id * {k + 3}) % 256)), 2, '0')" for k in range(4))} AS pixels FROM events)"""


@query(
    f"""WITH {_PX}, st AS (SELECT *, greatest(round_even(native_fps / 4.0, 0)::BIGINT, 1) AS step FROM px)
SELECT video_key, (native_index // step)::INT AS frame_ordinal, native_index::BIGINT AS native_index, round((native_index / native_fps)::FLOAT::DOUBLE, 6) AS time_sec, native_fps, pixels
FROM st WHERE native_index % step = 0 AND native_index // step >= 2 AND native_index < 90"""
)
def raw_video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw video files written by the sink that commits, sampled by the data source; stride and filters are applied before a frame is read."""
    root = fresh_folder(spark)
    sinks.write_raw_videos(_pixel_frames(spark, sf_dir), root)
    rows = raw.raw_videos(spark, root, 4.0, range_bytes=4096).where((F.col("frame_ordinal") >= 2) & (F.col("native_index") < 90))
    return rows.select("video_key", "frame_ordinal", "native_index", _r("time_sec"), "native_fps", F.hex("image.data").alias("pixels"))


def _shown(spark: SparkSession, sf_dir: str) -> str:
    """The folder into which the evidence of ``evidence_frames`` was written."""
    root = fresh_folder(spark)
    images = _pixel_frames(spark, sf_dir).select("video_key", F.col("native_index").cast("int").alias("frame_ordinal"), "image")
    sinks.write_evidence(_event_evidence(spark, sf_dir), images, root)
    return root


@query(
    f"""WITH RECURSIVE {_EVENT_HITS}, {_evidence_sql("eh", "v", BUDGET)}, {_PX}
SELECT ev.video_key, question_id, lpad(position::VARCHAR, 2, '0') || '_' || replace(printf('%.2f', time_sec), '.', '_') || 's.png' AS file_name, 2 AS height, 2 AS width, pixels
FROM ev JOIN px ON px.video_key = ev.video_key AND px.native_index = ev.frame_index"""
)
def exported_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence frames as committed PNG files, listed and read back in tasks."""
    found = sinks.read_evidence(spark, _shown(spark, sf_dir))
    return found.select("video_key", "question_id", "file_name", "image.height", "image.width", F.hex("image.data").alias("pixels"))


@query(
    f"""WITH RECURSIVE {_EVENT_HITS}, {_evidence_sql("eh", "v", BUDGET)}, n AS (SELECT video_key, count(*)::INT AS n FROM ev GROUP BY 1)
SELECT u.video_key, 'q' AS question_id, coalesce(n, 64)::INT AS frame_budget FROM (SELECT DISTINCT user_id::VARCHAR AS video_key FROM events) u LEFT JOIN n USING (video_key)"""
)
def exported_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's budget from the folders that an export left; videos without one have the default."""
    asked = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_key"), F.lit("q").alias("question_id")).distinct()
    return retrieve.frame_budget(asked, sinks.exported_counts(spark, _shown(spark, sf_dir)), 64)


@query(
    f"""WITH RECURSIVE {_V}, {_segments_sql("v", "signal", *EVENT_HIGH, "high", "hi")}, {_PX}
SELECT hi.video_key, hi.segment_id, (px.native_index - hi.start_index)::INT AS frame_ordinal, px.pixels FROM hi JOIN px ON px.video_key = hi.video_key AND px.native_index BETWEEN hi.start_index AND hi.end_index WHERE hi.segment_no < 2"""
)
def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two segments of each video as committed clips, read back frame by frame."""
    root = fresh_folder(spark)
    found = segments.segment_by_threshold(event_frames(spark, sf_dir), *EVENT_HIGH, "high", score="signal")
    images = _pixel_frames(spark, sf_dir).select("video_key", F.col("native_index").cast("int").alias("frame_ordinal"), "image")
    sinks.write_raw_clips(found, images, root, 4.0, max_segments=2)
    return raw.raw_clips(spark, root).select("video_key", F.col("clip").alias("segment_id"), "frame_ordinal", F.hex("image.data").alias("pixels"))


@query(
    f"""WITH RECURSIVE act AS ({_SAMPLE}), lost AS (SELECT *, row_number() OVER (ORDER BY video_id, url) - 1 AS slot FROM act WHERE md5(url) < '1'),
fr AS (SELECT c_mktsegment AS duration, c_nationkey::VARCHAR AS domain, c_name AS url, md5('7|' || c_name) AS tie FROM customer WHERE md5(c_name) >= '1' AND c_name NOT IN (SELECT url FROM act)),
se AS (
  SELECT -1::BIGINT AS slot, NULL::VARCHAR AS replaced_url, NULL::VARCHAR AS replacement_url, NULL::INT AS stage, []::VARCHAR[] AS taken
  UNION ALL
  SELECT l.slot, l.url, x.url, x.stage, list_append(se.taken, x.url) FROM se JOIN lost l ON l.slot = se.slot + 1, LATERAL (
    SELECT fr.url, CASE WHEN fr.duration = l.duration AND fr.domain = l.domain THEN 0 WHEN fr.duration = l.duration THEN 1 ELSE 3 END AS stage
    FROM fr WHERE NOT list_contains(se.taken, fr.url) ORDER BY stage, tie, fr.url LIMIT 1) x)
SELECT slot::INT AS slot, replaced_url, replacement_url, stage::INT AS stage, 'unavailable' AS reason FROM se WHERE slot >= 0"""
)
def replacement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a sample whose unavailable videos were replaced, found in rounds."""
    videos = customer_videos(spark, sf_dir)
    here = videos.where(F.md5(F.col("url").cast("binary")) >= "1").select("url")
    sample = written_once(sampling.stratified_sample(videos, _strata_size(videos), 7))
    return matching.replace_lost(sample, videos, here, 7, enforce_duration=True)[1]


@query(f"WITH {_FLAT} SELECT {_FLAT_OUT} FROM fl")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested videos written as manifest documents and read back as one manifest, as question rows."""
    root = fresh_folder(spark)
    sinks.write_manifest_files(manifest.group_flat(flat_questions(spark, sf_dir)), root)
    return _joined_options(manifest.question_rows(read_manifest(spark, root)))


@query(f"WITH {_RESULTS} SELECT video_key, question_id, raw_text, generation_sec, predicted_letter, choice_correct, frames FROM re")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows as committed JSON files, one a question, read back."""
    root, rows = fresh_folder(spark), _results(spark, sf_dir)
    sinks.write_result_files(rows, root)
    back = sinks.read_result_files(spark, root, rows.schema)
    frames = F.array_join(F.transform("evidence_frames", lambda x: x["frame_index"].cast("string")), "|")
    return back.select("video_key", "question_id", "raw_text", "generation_sec", "predicted_letter", "choice_correct", frames.alias("frames"))


@query("SELECT c_custkey::BIGINT AS row_no, '/videos/' || c_name || '.mp4' AS path FROM customer")
def video_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos_source.video_paths(customer_videos(spark, sf_dir), "/videos/").select("row_no", "path")


# Models (stubs) -------------------------------------------------------------------


@query(
    """
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, list_transform(range(16), lambda i: ((('0x' || substr(h, 2 * i + 1, 2))::INT)::FLOAT / 127.5::FLOAT - 1::FLOAT)::FLOAT) AS v FROM h)
SELECT doc_id, 16 AS width, round(v[1]::DOUBLE / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS first, 1.0::DOUBLE AS norm FROM x"""
)
def encoder_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    coded = inference.encode(docs, "text", inference.StubEncoder)
    vector = F.col("embedding")
    return coded.select("doc_id", F.size(vector).alias("width"), F.round(vector[0].cast("double"), 4).alias("first"), F.round(dot(vector, vector), 4).alias("norm"))


@query(
    f"""WITH {_FLAT}, pr AS (SELECT question_id, answer AS gold_letter, chr(10) || 'Answer the multiple-choice question using only the evidence shown.' || chr(10) || 'Reply with only one letter: A, B, C, or D.' || chr(10) || chr(10)
  || 'Question: ' || question || chr(10) || 'Options:' || chr(10) || array_to_string(options, chr(10)) AS prompt FROM fl),
sd AS (SELECT question_id, gold_letter, substr('ABCD', (('0x' || substr(md5(prompt), 1, 2))::INT % 4 + 1)::INT, 1) AS predicted_letter FROM pr)
SELECT question_id, predicted_letter, gold_letter, predicted_letter = gold_letter AS choice_correct FROM sd"""
)
def answer_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat_questions(spark, sf_dir)
    asked = rows.select("question_id", F.col("answer").alias("gold_letter"), mcq_prompt(F.col("question"), F.col("options")).alias("prompt"), F.lit(None).cast("array<int>").alias("frames"))
    return evaluate.judged(inference.answer(asked, inference.StubAnswerer)).select("question_id", "predicted_letter", "gold_letter", "choice_correct")
