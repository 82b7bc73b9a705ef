"""Weights, sampling, splits, frames, smoothing, metrics, losses, reports and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.functions.scalar import item_clipped
from fieldtrace.operators import anchors as A
from fieldtrace.operators import durations as D
from fieldtrace.operators import frames as FR
from fieldtrace.operators import metrics as M
from fieldtrace.operators import reports as R
from fieldtrace.operators import scoring as SC
from fieldtrace.operators import splits as SP
from fieldtrace.operators import stats as N
from fieldtrace.operators.ordered import Order
from fieldtrace.operators.segments import behaviour_runs, run_ids
from fieldtrace.operators.smoothing import run_neighbours, smooth_runs
from fieldtrace.registry.book import BOOK, joined, q6, r6, rounded
from fieldtrace.registry.sequences import GAP, KEY, RECOMMENDED, SUMMARY, runs_sql, summary_frame, windows_sql
from fieldtrace.registry.views import DATED, ORDER, TRACK, dated, segmented, table, track
from fieldtrace.schema import CLASS_SHORT_NAMES, NUM_CLASSES
from fieldtrace.sources.writers import settled

SEG = segmented(GAP)
ANCHORS = f"{SEG}, anchor AS (SELECT * FROM seg WHERE seg_pos % 3 = 0 OR is_last)"
DIMS = "dims AS (SELECT CAST(range AS INTEGER) AS class_id FROM range(11))"


def anchors(spark, sf):
    return A.fixed_anchors(track(spark, sf), ORDER, GAP, 3)


# Class and sample weights.

COUNTS = f"""{ANCHORS}, {DIMS},
counts AS (SELECT d.class_id, count(a.label) AS rows, greatest(count(a.label), 1)::DOUBLE AS n
  FROM dims d LEFT JOIN anchor a ON a.label = d.class_id GROUP BY d.class_id)"""


def weights_of(expr: str) -> str:
    return f"WITH {COUNTS}, raw AS (SELECT class_id, rows, {expr} AS w FROM counts) SELECT class_id, rows, {q6('w / (SELECT sum(w) FROM raw) * 11', 'weight')} FROM raw"


@BOOK.query("class_weights", weights_of("pow(n, -0.5)"))
def class_weights(spark, sf):
    return rounded(N.class_weights(anchors(spark, sf)), ["weight"])


@BOOK.query("effective_number_weights", weights_of("(1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n))"))
def effective_number_weights(spark, sf):
    return rounded(N.effective_number_weights(anchors(spark, sf)), ["weight"])


@BOOK.query(
    "aux_pos_weights",
    f"""WITH {COUNTS} SELECT class_id, rows, {q6('pow(greatest((SELECT count(*) FROM anchor) - rows, 1) / n, 0.5)', 'pos_weight')}
    FROM counts WHERE class_id IN (3, 7)""",
)
def aux_pos_weights(spark, sf):
    return rounded(N.aux_pos_weights(anchors(spark, sf), [3, 7]), ["pos_weight"])


@BOOK.query(
    "sample_weights",
    f"WITH {COUNTS} SELECT entity_id, tie, {q6('pow(n, -0.5)', 'weight')} FROM anchor JOIN counts ON label = class_id",
)
def sample_weights(spark, sf):
    return rounded(N.sample_weights(anchors(spark, sf)), ["weight"]).select(*KEY, "weight")


@BOOK.query(
    "sample_weights_boost",
    f"""WITH {COUNTS} SELECT entity_id, tie, {q6('pow(n, -0.5) * CASE WHEN label IN (2, 5) THEN 3 ELSE 1 END', 'weight')}
    FROM anchor JOIN counts ON label = class_id""",
)
def sample_weights_boost(spark, sf):
    out = N.sample_weights(anchors(spark, sf), mode="class_boost", boost_classes=[2, 5], boost_factor=3.0)
    return rounded(out, ["weight"]).select(*KEY, "weight")


UNIT = "(('0x' || substr(md5({}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


@BOOK.query(
    "weighted_resample",
    f"""WITH {COUNTS}, w AS (SELECT entity_id, tie, label, pow(n, -0.5) AS weight, md5(entity_id || '#' || tie || '#42') AS h FROM anchor JOIN counts ON label = class_id),
    size AS (SELECT count(*) AS n, sum(weight) AS total, CASE WHEN count(*) <= {SP.BUCKET_ROWS} THEN 0 WHEN count(*) <= {SP.BUCKET_ROWS * 16} THEN 1 ELSE 2 END AS d FROM w),
    held AS (SELECT w.*, substr(h, 1, d) AS b FROM w, size),
    placed AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY b ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM held),
    sums AS (SELECT b, sum(weight) AS w FROM held GROUP BY b),
    offs AS (SELECT *, coalesce(sum(w) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sums),
    cuts AS (SELECT b, w, floor(off / total * n + {UNIT.format("'45'")}) AS c, n FROM offs, size),
    shares AS (SELECT b, w, (coalesce(lead(c) OVER (ORDER BY b), n) - c)::BIGINT AS draws FROM cuts),
    points AS (SELECT b, md5('b' || b || '#' || i || '#44') AS draw, {UNIT.format("'b' || b || '#' || i || '#43'")} * w AS x
      FROM (SELECT b, w, unnest(range(1, draws + 1)) AS i FROM shares))
    SELECT entity_id, tie, label, {q6('weight', 'weight')}, draw FROM points p ASOF JOIN placed h ON p.b = h.b AND p.x >= h.lo""",
)
def weighted_resample(spark, sf):
    weighted = settled(N.sample_weights(anchors(spark, sf)).select(*KEY, "label", "weight"))
    return rounded(SP.weighted_resample(weighted, KEY), ["weight"])


@BOOK.query("shuffle_samples", f"WITH {ANCHORS} SELECT entity_id, tie, label FROM anchor")
def shuffle_samples(spark, sf):
    return SP.shuffle_samples(anchors(spark, sf).select(*KEY, "label"), KEY)


# Splits. The hash order exists in both engines, so the split itself is checked.

HASH = "md5({keys} || '#42')"


@BOOK.query(
    "majority_label",
    f"""WITH {TRACK}, c AS (SELECT entity_id, label, count(*) AS n FROM track GROUP BY 1, 2)
    SELECT entity_id, arg_max(label, (n, -label)) AS majority, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY 1""",
)
def majority_label(spark, sf):
    return SP.majority_label(track(spark, sf))


STRATIFIED = f"""WITH {TRACK}, c AS (SELECT entity_id, label, count(*) AS n FROM track GROUP BY 1, 2),
    m AS (SELECT entity_id, arg_max(label, (n, -label)) AS majority FROM c GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY majority ORDER BY {HASH.format(keys='entity_id')}) - 1 AS rk,
      count(*) OVER (PARTITION BY majority) AS n FROM m)
    SELECT entity_id, majority, CASE WHEN rk < floor(n * 0.7::DOUBLE) THEN 'train'
      WHEN rk < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r"""


@BOOK.query("stratified_entity_split", STRATIFIED)
def stratified_entity_split(spark, sf):
    return SP.stratified_entity_split(track(spark, sf))


@BOOK.query(
    "small_split_fallback",
    f"""WITH {ANCHORS}, r AS (SELECT entity_id, tie, row_number() OVER (ORDER BY {HASH.format(keys="entity_id || '#' || tie")}) - 1 AS rk,
      count(*) OVER () AS n FROM anchor),
    t AS (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS nt FROM r),
    v AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(1, floor(n * 0.15::DOUBLE)), greatest(n - nt - 1, 0)) ELSE 0 END AS nv FROM t)
    SELECT entity_id, tie, CASE WHEN rk < nt THEN 'train' WHEN rk < nt + nv THEN 'val' ELSE 'test' END AS split FROM v""",
)
def small_split_fallback(spark, sf):
    return SP.small_split(anchors(spark, sf).select(*KEY), KEY)


@BOOK.query(
    "split_windows",
    f"""WITH {ANCHORS}, c AS (SELECT entity_id, label, count(*) AS n FROM anchor GROUP BY 1, 2),
    m AS (SELECT entity_id, arg_max(label, (n, -label)) AS majority FROM c GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY majority ORDER BY {HASH.format(keys='entity_id')}) - 1 AS rk,
      count(*) OVER (PARTITION BY majority) AS n FROM m)
    SELECT entity_id, tie, CASE WHEN rk < floor(n * 0.7::DOUBLE) THEN 'train'
      WHEN rk < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM anchor JOIN r USING (entity_id)""",
)
def split_windows(spark, sf):
    return SP.split_windows(anchors(spark, sf).select(*KEY, "label"), KEY).select(*KEY, "split")


# Frames of a sample.


def samples(spark, sf, context="causal", length=9):
    return A.build_windows(track(spark, sf), ORDER, length, ["tie", "second"], context, GAP, 3)


def chosen(rows):
    return FR.frames_at(rows, "tie").select(*KEY, joined("frames").alias("frames"))


def slots_sql(slot: str, k: int, back: int, ahead: int, length: int) -> str:
    """Frames picked by a slot formula of i in 0..k-1, on windows cut by definition."""
    return f"""WITH {SEG},
    sized AS (SELECT *, max(seg_pos) OVER (PARTITION BY entity_id, segment_id) AS last_pos FROM seg),
    slots AS (SELECT a.entity_id, a.tie, a.segment_id, i.range AS i,
        greatest(0, least(a.last_pos, a.seg_pos - {back} + {slot})) AS at
      FROM sized a, range({k}) i WHERE seg_pos % 3 = 0 OR is_last)
    SELECT s.entity_id, s.tie, string_agg(r.tie, ',' ORDER BY i) AS frames
    FROM slots s JOIN seg r ON r.entity_id = s.entity_id AND r.segment_id = s.segment_id AND r.seg_pos = s.at GROUP BY 1, 2"""


@BOOK.query("select_frames_causal", slots_sql("8 - 4 + i.range", 5, 8, 0, 9))
def select_frames_causal(spark, sf):
    return chosen(FR.select_frames(samples(spark, sf), "nearest_causal", 5))


@BOOK.query("select_frames_causal_padded", slots_sql("greatest(8 - 11 + i.range, 0)", 12, 8, 0, 9))
def select_frames_causal_padded(spark, sf):
    return chosen(FR.select_frames(samples(spark, sf), "nearest_causal", 12))


@BOOK.query("select_frames_uniform", slots_sql("CAST(round_even(i.range * 2.0::DOUBLE, 0) AS BIGINT)", 5, 4, 4, 9))
def select_frames_uniform(spark, sf):
    return chosen(FR.select_frames(samples(spark, sf, "centered"), "uniform", 5))


@BOOK.query("select_frame_single", slots_sql("8", 1, 8, 0, 9))
def select_frame_single(spark, sf):
    return chosen(FR.select_frames(samples(spark, sf), "uniform", 1))


def center_sql(radius: str, extra: str = "", size: int = 9, k: int = 5) -> str:
    return f"""{SEG}{extra},
    sized AS (SELECT seg.*, max(seg_pos) OVER (PARTITION BY entity_id, segment_id) AS last_pos FROM seg),
    slots AS (SELECT a.entity_id, a.tie, a.segment_id, a.second AS center, a.label, s.range AS slot,
        greatest(0, least(a.last_pos, a.seg_pos - {size // 2} + s.range)) AS at
      FROM sized a, range({size}) s WHERE seg_pos % 3 = 0 OR is_last),
    cand AS (SELECT s.*, r.second, r.tie AS row_tie FROM slots s JOIN seg r
      ON r.entity_id = s.entity_id AND r.segment_id = s.segment_id AND r.seg_pos = s.at),
    near AS (SELECT entity_id, tie, CAST(i.range AS INTEGER) AS target,
        arg_min((second, row_tie), (abs(second - (center + CAST(round_even(-({radius}) + i.range * (2.0::DOUBLE * ({radius}) / {k - 1}), 0) AS BIGINT))), slot)) AS best
      FROM cand, range({k}) i GROUP BY 1, 2, 3)"""


@BOOK.query("select_frames_center", f"WITH {center_sql('8')} SELECT entity_id, tie, string_agg(best[2], ',' ORDER BY target) AS frames FROM near GROUP BY 1, 2")
def select_frames_center(spark, sf):
    out = FR.center_frames(track(spark, sf), ORDER, 9, "tie", 5, F.lit(8), max_gap=GAP, stride=3)
    return out.select(*KEY, joined("frames").alias("frames"))


@BOOK.query("select_frames_center_slots", f"WITH {center_sql('8')} SELECT entity_id, tie, string_agg(best[2], ',' ORDER BY target) AS frames FROM near GROUP BY 1, 2")
def select_frames_center_slots(spark, sf):
    """The same frames as slots of windows that are there already."""
    return chosen(FR.select_frames(samples(spark, sf, "centered"), "center", 5, F.lit(8)))


@BOOK.query("select_frames_center_wide", f"WITH {center_sql('300', size=512, k=9)} SELECT entity_id, tie, string_agg(best[2], ',' ORDER BY target) AS frames FROM near GROUP BY 1, 2")
def select_frames_center_wide(spark, sf):
    """Windows of 512 rows: no window is built."""
    out = FR.center_frames(track(spark, sf), ORDER, 512, "tie", 9, F.lit(300), max_gap=GAP, stride=3)
    return out.select(*KEY, joined("frames").alias("frames"))


@BOOK.query("nearest_row_join", f"WITH {center_sql('5')} SELECT entity_id, tie, target, best[1] AS nearest_second, best[2] AS nearest_tie FROM near")
def nearest_row_join(spark, sf):
    out = FR.nearest_row_join(track(spark, sf), ORDER, 9, ["second", "tie"], 5, F.lit(5), max_gap=GAP, stride=3)
    return out.select(*KEY, "target", "nearest_second", "nearest_tie")


RADIUS = f"""WITH {SUMMARY}, {RECOMMENDED} SELECT entity_id, tie, CASE WHEN label IN (1, 3, 4) THEN
  CAST(greatest(1, least(32, round_even(coalesce(p75, 16) * 0.5::DOUBLE, 0))) AS INTEGER) ELSE 8 END AS radius
  FROM track LEFT JOIN recommended ON label = class_id"""


def config_frame(spark, sf):
    return D.duration_config(D.recommend_sampling(summary_frame(spark, sf)))


@BOOK.query("radius_for_class", RADIUS)
def radius_for_class(spark, sf):
    out = FR.with_radius(track(spark, sf), config_frame(spark, sf), 8, 0.5, [1, 3, 4])
    return out.select(*KEY, "radius")


def dropout_unit(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


FRAMES = slots_sql("8 - 4 + i.range", 5, 8, 0, 9)
DROPPED = f"""WITH clips AS ({FRAMES}), each AS (
    SELECT entity_id, tie, i.range AS i, string_split(frames, ',') AS f, {dropout_unit("entity_id || '#' || tie || '#' || i.range || '#42'")} < 0.4::DOUBLE AS drop,
      CAST(floor({dropout_unit("entity_id || '#' || tie || '#43'")} * 5) AS INTEGER) AS spared FROM clips, range(5) i),
    marked AS (SELECT *, bool_and(drop) OVER (PARTITION BY entity_id, tie) AS everything FROM each)
    SELECT entity_id, tie, string_agg(CASE WHEN drop AND NOT (everything AND i = spared) THEN f[5] ELSE f[i + 1] END, ',' ORDER BY i) AS frames
    FROM marked GROUP BY 1, 2"""


@BOOK.query("frame_dropout", DROPPED)
def frame_dropout(spark, sf):
    rows = FR.frames_at(FR.select_frames(samples(spark, sf), "nearest_causal", 5), "tie")
    return FR.frame_dropout(rows, 0.4, KEY).select(*KEY, joined("frames").alias("frames"))


# Frame vectors: ten consecutive embeddings of one label group play one clip.


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    clip = F.floor(F.col("vec_id") / 10)
    return e.select("vec_id", clip.alias("clip"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@BOOK.query(
    "mean_pool_frames",
    f"""SELECT CAST(floor(vec_id / 10) AS BIGINT) AS clip, CAST(r.range AS INTEGER) AS dim, {q6('avg(embedding[r.range + 1]::DOUBLE)', 'x')}
    FROM embeddings, range(64) r GROUP BY 1, 2""",
)
def mean_pool_frames(spark, sf):
    out = FR.mean_pool(vectors(spark, sf), ["clip"], "vector")
    return out.select("clip", F.posexplode("vector").alias("dim", "x")).withColumn("x", r6("x"))


@BOOK.query(
    "temporal_delta",
    f"""WITH v AS (SELECT vec_id, r.range AS dim, embedding[r.range + 1]::DOUBLE AS x, floor(vec_id / 10) AS clip FROM embeddings, range(64) r)
    SELECT vec_id, CAST(dim AS INTEGER) AS dim, {q6('x - coalesce(lag(x) OVER (PARTITION BY clip, dim ORDER BY vec_id), x)', 'x')} FROM v""",
)
def temporal_delta(spark, sf):
    out = FR.temporal_delta(vectors(spark, sf), ["clip"], "vec_id", "vector")
    return out.select("vec_id", F.posexplode("delta").alias("dim", "x")).withColumn("x", r6("x"))


# Smoothing.

CLASSES = [0, 3, 7]
PRED_RUNS = runs_sql("pred", 1)
SMOOTH = f"""{PRED_RUNS},
near AS (SELECT *, end_second - start_second + 1 AS span,
    lag(class_id) OVER w AS lp, lag(rows) OVER w AS ln, lead(class_id) OVER w AS rp, lead(rows) OVER w AS rn
  FROM runs WINDOW w AS (PARTITION BY entity_id ORDER BY run_id)),
fixed AS (SELECT entity_id, run_id, CASE WHEN class_id NOT IN (0, 3, 7) OR span >= 5 THEN class_id
    WHEN lp = rp THEN lp WHEN lp IS NULL AND rp IS NULL THEN class_id WHEN lp IS NULL THEN rp WHEN rp IS NULL THEN lp
    WHEN ln > rn OR (ln = rn AND lp > rp) THEN lp ELSE rp END AS smoothed FROM near),
smooth AS (SELECT * FROM run_rows JOIN fixed USING (entity_id, run_id))"""


def smoothed(spark, sf):
    return smooth_runs(track(spark, sf), ORDER, "pred", CLASSES, 5)


@BOOK.query("smooth_runs", f"WITH {SMOOTH} SELECT entity_id, tie, pred, smoothed FROM smooth")
def smooth(spark, sf):
    return smoothed(spark, sf).select(*KEY, "pred", "smoothed")


@BOOK.query("run_neighbours", f"WITH {SMOOTH} SELECT entity_id, run_id, lp AS left_pred, ln AS left_rows, rp AS right_pred, rn AS right_rows FROM near")
def neighbours(spark, sf):
    rows = run_ids(track(spark, sf), ORDER, "pred", 1).groupBy("entity_id", "run_id")
    runs = rows.agg(F.min("pred").alias("pred"), F.count(F.lit(1)).alias("rows"))
    out = run_neighbours(runs, ORDER)
    return out.select(
        "entity_id", "run_id", F.col("left.pred").alias("left_pred"), F.col("left.rows").alias("left_rows"),
        F.col("right.pred").alias("right_pred"), F.col("right.rows").alias("right_rows"),
    )


# Metrics over the track's labels and predictions.

MATRIX = f"""{{base}}, {DIMS},
pairs AS (SELECT {{t}} AS y_true, {{p}} AS y_pred, count(*) AS rows FROM {{source}} GROUP BY 1, 2),
matrix AS (SELECT a.class_id AS y_true, b.class_id AS y_pred, coalesce(rows, 0) AS rows
  FROM dims a CROSS JOIN dims b LEFT JOIN pairs ON y_true = a.class_id AND y_pred = b.class_id),
sides AS (SELECT class_id, (SELECT coalesce(sum(rows), 0) FROM pairs WHERE y_true = class_id) AS support,
    (SELECT coalesce(sum(rows), 0) FROM pairs WHERE y_pred = class_id) AS predicted,
    (SELECT coalesce(sum(rows), 0) FROM pairs WHERE y_pred = class_id AND y_true = class_id) AS hits FROM dims),
scores AS (SELECT class_id, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted::DOUBLE END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE hits / support::DOUBLE END AS recall,
    CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted)::DOUBLE END AS f1,
    CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted FROM sides)"""
RAW = MATRIX.format(base=TRACK, t="label", p="pred", source="track")
SMOOTHED = MATRIX.format(base=SMOOTH, t="label", p="smoothed", source="smooth")
YY = ("label", "pred")


@BOOK.query("confusion_matrix", f"WITH {RAW} SELECT * FROM matrix")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(track(spark, sf), *YY)


@BOOK.query(
    "class_pair_grid",
    f"""WITH {TRACK}, {DIMS} SELECT a.class_id AS y_true, b.class_id AS y_pred, (SELECT count(DISTINCT entity_id) FROM track WHERE label = a.class_id AND pred = b.class_id) AS entities
    FROM dims a CROSS JOIN dims b""",
)
def class_pair_grid(spark, sf):
    """How many entities have each pair of classes, zero included."""
    pairs = track(spark, sf).groupBy(F.col("label").alias("y_true"), F.col("pred").alias("y_pred")).agg(F.countDistinct("entity_id").alias("entities"))
    return M.class_pairs(spark).join(pairs, ["y_true", "y_pred"], "left").fillna(0, ["entities"])


@BOOK.query(
    "confusion_wide",
    f"WITH {RAW} SELECT y_true, "
    + ", ".join(f"CAST(sum(rows) FILTER (y_pred = {c}) AS BIGINT) AS pred_{c}" for c in range(NUM_CLASSES))
    + " FROM matrix GROUP BY y_true",
)
def confusion_wide(spark, sf):
    return M.confusion_wide(track(spark, sf), *YY)


@BOOK.query("normalised_confusion", f"WITH {RAW} SELECT y_true, y_pred, {q6('rows / greatest(sum(rows) OVER (PARTITION BY y_true), 1)', 'share')} FROM matrix")
def normalised_confusion(spark, sf):
    return rounded(M.normalised_confusion(track(spark, sf), *YY), ["share"])


SCORES = ["precision", "recall", "f1"]


@BOOK.query("per_class_metrics", f"WITH {RAW} SELECT class_id, {', '.join(q6(s, s) for s in SCORES)}, support, predicted FROM scores")
def per_class_metrics(spark, sf):
    return rounded(M.per_class_metrics(track(spark, sf), *YY), SCORES)


@BOOK.query("per_class_metrics_smoothed", f"WITH {SMOOTHED} SELECT class_id, {', '.join(q6(s, s) for s in SCORES)}, support, predicted FROM scores")
def per_class_metrics_smoothed(spark, sf):
    return rounded(M.per_class_metrics(smoothed(spark, sf), "label", "smoothed"), SCORES)


@BOOK.query("per_class_recall", f"WITH {RAW} SELECT class_id, {q6('recall', 'recall')} FROM scores")
def per_class_recall(spark, sf):
    return rounded(M.per_class_recall(track(spark, sf), *YY), ["recall"])


F1 = f"""{q6('avg(f1) FILTER (support + predicted > 0)', 'macro_f1')}, {q6('sum(f1 * support) / sum(support)', 'weighted_f1')}"""


@BOOK.query("macro_f1", f"WITH {RAW} SELECT {F1} FROM scores")
def macro_f1(spark, sf):
    return rounded(M.f1_scores(M.per_class_metrics(track(spark, sf), *YY)), ["macro_f1", "weighted_f1"])


@BOOK.query(
    "accuracy",
    f"""WITH {SMOOTH} SELECT {q6('avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END)', 'accuracy_raw')},
    {q6('avg(CASE WHEN label = smoothed THEN 1.0::DOUBLE ELSE 0 END)', 'accuracy_smoothed')} FROM smooth""",
)
def accuracy(spark, sf):
    out = M.accuracy_raw_and_smoothed(smoothed(spark, sf), "label", "pred", "smoothed")
    return rounded(out, ["accuracy_raw", "accuracy_smoothed"])


@BOOK.query("add_correct_flag", f"WITH {TRACK} SELECT tie, label = pred AS correct FROM track")
def add_correct_flag(spark, sf):
    return M.add_correct(track(spark, sf), *YY).select("tie", "correct")


@BOOK.query("label_union", f"WITH {TRACK} SELECT label AS class_id FROM track UNION SELECT pred FROM track")
def label_union(spark, sf):
    return M.label_union(track(spark, sf), *YY)


@BOOK.query("complete_classes", f"WITH {TRACK} SELECT CAST(range AS INTEGER) AS class_id, count(t.tie) AS rows FROM range({NUM_CLASSES + 2}) LEFT JOIN track t ON label = range GROUP BY 1")
def complete_classes(spark, sf):
    """Rows per class over a dimension with two classes that no row has."""
    return N.class_weights(track(spark, sf), num_classes=NUM_CLASSES + 2).select("class_id", "rows")


# Losses over logits: the first eleven embedding dimensions.


def logits(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, 11), lambda x: x.cast("double")).alias("logits"))


LOGITS = f"""{DIMS},
flat AS (SELECT vec_id, label, r.range AS c, embedding[r.range + 1]::DOUBLE AS x FROM embeddings, range(11) r),
lp AS (SELECT *, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS logp FROM flat),
cnt AS (SELECT class_id, greatest(count(e.label), 1)::DOUBLE AS n FROM dims LEFT JOIN embeddings e ON e.label = class_id GROUP BY 1),
cw0 AS (SELECT class_id, pow(n, -0.5) AS w, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)) AS e FROM cnt),
cw AS (SELECT class_id, w / (SELECT sum(w) FROM cw0) * 11 AS w, e / (SELECT sum(e) FROM cw0) * 11 AS e FROM cw0),
terms AS (SELECT vec_id, label, c, logp, w, e, CASE WHEN c = label THEN 0.9::DOUBLE + 0.1::DOUBLE / 11 ELSE 0.1::DOUBLE / 11 END AS t,
  CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot FROM lp JOIN cw ON class_id = c)"""


@BOOK.query("mean_loss_weighted_ce", f"WITH {LOGITS} SELECT {q6('sum(-t * w * logp) / sum(hot * w)', 'loss')} FROM terms")
def mean_loss_weighted_ce(spark, sf):
    rows = logits(spark, sf)
    return rounded(M.weighted_ce(rows, weights=N.class_weights(rows), smoothing=0.1), ["loss"])


FOCAL = "sum(-{t} * {w} * pow(1 - exp(logp), 2) * logp) / count(DISTINCT vec_id)"


@BOOK.query("mean_loss_focal", f"WITH {LOGITS} SELECT {q6(FOCAL.format(t='hot', w='w'), 'loss')} FROM terms")
def mean_loss_focal(spark, sf):
    rows = logits(spark, sf)
    return rounded(M.focal_loss(rows, weights=N.class_weights(rows)), ["loss"])


@BOOK.query("mean_loss_cb_focal", f"WITH {LOGITS} SELECT {q6(FOCAL.format(t='t', w='e'), 'loss')} FROM terms")
def mean_loss_cb_focal(spark, sf):
    rows = logits(spark, sf)
    return rounded(M.focal_loss(rows, weights=N.effective_number_weights(rows), smoothing=0.1), ["loss"])


@BOOK.query(
    "mean_loss_aux",
    f"""WITH a AS (SELECT label, unnest([3, 7]) AS c, unnest([embedding[1]::DOUBLE, embedding[2]::DOUBLE]) AS x FROM embeddings),
    p AS (SELECT c, sqrt(greatest(count(*) FILTER (label <> c), 1) / greatest(count(*) FILTER (label = c), 1)) AS pw FROM a GROUP BY c)
    SELECT {q6('avg(CASE WHEN label = c THEN pw * ln(1 + exp(-x)) ELSE ln(1 + exp(x)) END)', 'loss')} FROM a JOIN p USING (c)""",
)
def mean_loss_aux(spark, sf):
    rows = logits(spark, sf)
    return rounded(M.aux_bce(rows, [3, 7], "logits", "label", N.aux_pos_weights(rows, [3, 7])), ["loss"])


# Model comparison: three single models and two fused ones, predicted by rule from the track.

MODELS = {"audio": 3, "image": 4, "track": 5, "concat": 7, "gate": 9}
FUSED, SINGLES = ["concat", "gate"], ["audio", "image", "track"]


def model_rows(spark, sf, model):
    wrong = ((F.col("tie") * 7 + F.col("label")) % NUM_CLASSES).cast("int")
    pred = F.when(F.col("tie") % MODELS[model] == 0, wrong).otherwise(F.col("label"))
    return track(spark, sf).withColumn("pred", pred)


def per_model(spark, sf):
    return R.union_models({m: M.per_class_metrics(model_rows(spark, sf, m), *YY) for m in MODELS})


MODEL_ROWS = f"""{TRACK}, {DIMS},
models AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {k})" for m, k in MODELS.items())}) v(model, k)),
predicted AS (SELECT model, label AS y_true, CASE WHEN tie % k = 0 THEN CAST((tie * 7 + label) % 11 AS INTEGER) ELSE label END AS y_pred
  FROM track, models),
model_pairs AS (SELECT model, y_true, y_pred, count(*) AS rows FROM predicted GROUP BY 1, 2, 3),
model_sides AS (SELECT model, class_id,
    (SELECT coalesce(sum(rows), 0) FROM model_pairs p WHERE p.model = m.model AND y_true = class_id) AS support,
    (SELECT coalesce(sum(rows), 0) FROM model_pairs p WHERE p.model = m.model AND y_pred = class_id) AS predicted,
    (SELECT coalesce(sum(rows), 0) FROM model_pairs p WHERE p.model = m.model AND y_pred = class_id AND y_true = class_id) AS hits
  FROM models m, dims),
model_scores AS (SELECT model, class_id, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted::DOUBLE END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE hits / support::DOUBLE END AS recall,
    CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted)::DOUBLE END AS f1,
    CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted FROM model_sides),
pivoted AS (SELECT class_id, {', '.join(f"max(f1) FILTER (model = '{m}') * 100 AS {m}" for m in MODELS)} FROM model_scores GROUP BY 1)"""
SHORT = "CASE {c} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CLASS_SHORT_NAMES)) + " END"


@BOOK.query(
    "union_models",
    f"WITH {MODEL_ROWS} SELECT model, class_id, {SHORT.format(c='class_id')} AS class, {', '.join(q6(s, s) for s in SCORES)}, support, predicted FROM model_scores",
)
def union_models(spark, sf):
    return rounded(per_model(spark, sf), SCORES)


@BOOK.query(
    "metrics_long",
    f"""WITH {MODEL_ROWS}, s AS (SELECT model, class_id, precision, recall, f1 FROM model_scores),
    l AS (UNPIVOT s ON precision, recall, f1 INTO NAME metric VALUE score) SELECT model, class_id, metric, {q6('score', 'score')} FROM l""",
)
def metrics_long(spark, sf):
    return rounded(R.metrics_long(per_model(spark, sf), ["model", "class_id"], SCORES), ["score"])


@BOOK.query("f1_pivot", f"WITH {MODEL_ROWS} SELECT class_id, {', '.join(q6(m, m) for m in MODELS)} FROM pivoted")
def f1_pivot(spark, sf):
    return rounded(R.f1_pivot(per_model(spark, sf), list(MODELS)), list(MODELS))


@BOOK.query(
    "best_single_gain",
    f"""WITH {MODEL_ROWS} SELECT class_id, {q6('greatest(audio, image, track)', 'best_single')},
    {q6('gate - greatest(audio, image, track)', 'gain')} FROM pivoted""",
)
def best_single_gain(spark, sf):
    out = R.best_single_gain(R.f1_pivot(per_model(spark, sf), list(MODELS)), "gate", SINGLES)
    return rounded(out.select("class_id", "best_single", "gain"), ["best_single", "gain"])


@BOOK.query("fusion_delta", f"WITH {MODEL_ROWS} SELECT class_id, {q6('gate - concat', 'delta')} FROM pivoted")
def fusion_delta(spark, sf):
    out = R.fusion_delta(R.f1_pivot(per_model(spark, sf), list(MODELS)), "gate", "concat")
    return rounded(out.select("class_id", "delta"), ["delta"])


REDUCED = f"""{MODEL_ROWS},
cells AS (SELECT a.class_id AS y_true, b.class_id AS y_pred,
    (SELECT coalesce(sum(rows), 0) FROM model_pairs p WHERE model = 'concat' AND p.y_true = a.class_id AND p.y_pred = b.class_id)
    - (SELECT coalesce(sum(rows), 0) FROM model_pairs p WHERE model = 'gate' AND p.y_true = a.class_id AND p.y_pred = b.class_id) AS reduction
  FROM dims a CROSS JOIN dims b),
reduced AS (SELECT y_true, y_pred, CAST(reduction AS BIGINT) AS reduction FROM cells WHERE y_true <> y_pred AND reduction > 0)"""


def matrices(spark, sf):
    return tuple(M.confusion_matrix(model_rows(spark, sf, m), *YY) for m in FUSED)


@BOOK.query("compare_confusions", f"WITH {REDUCED} SELECT * FROM reduced")
def compare_confusions(spark, sf):
    return R.compare_confusions(*matrices(spark, sf))


@BOOK.query(
    "top_k_error_reductions",
    f"""WITH {REDUCED} SELECT {SHORT.format(c='y_true')} || ' -> ' || {SHORT.format(c='y_pred')} AS pair, reduction, y_true, y_pred
    FROM reduced ORDER BY reduction DESC, y_true, y_pred LIMIT 8""",
)
def top_k_error_reductions(spark, sf):
    return R.error_reductions(*matrices(spark, sf))


MODEL_SUMMARY = """sum(recall * support) / sum(support)"""


@BOOK.query(
    "model_summary",
    f"""WITH {MODEL_ROWS} SELECT model, {q6(MODEL_SUMMARY + ' * 100', 'accuracy')}, {q6('avg(f1) * 100', 'macro_f1')},
    {q6('sum(f1 * support) / sum(support) * 100', 'weighted_f1')} FROM model_scores GROUP BY model""",
)
def model_summary(spark, sf):
    columns = ["accuracy", "macro_f1", "weighted_f1"]
    return rounded(R.scale_percent(M.scores_from_table(per_model(spark, sf), ["model"]), columns), columns)


EPOCHS = f"""WITH {DATED}, e AS (SELECT label AS epoch, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) AS acc,
  avg(speed) AS loss, count(*)::DOUBLE AS n FROM dated GROUP BY 1)
SELECT epoch, loss AS train_loss, acc AS train_acc, n AS train_macro_f1, n AS train_weighted_f1, loss AS val_loss, acc AS val_acc,
  n AS val_macro_f1, n AS val_weighted_f1 FROM e"""
EPOCH_COLUMNS = [f"{s}_{m}" for s in ("train", "val") for m in ("loss", "acc", "macro_f1", "weighted_f1")]


@BOOK.query("epoch_metrics", f"SELECT epoch, {', '.join(q6(c, c) for c in EPOCH_COLUMNS)} FROM ({EPOCHS})")
def epoch_metrics(spark, sf):
    return rounded(epoch_frame(spark, sf), EPOCH_COLUMNS)


def epoch_frame(spark, sf):
    hit = (F.col("label") == F.col("pred")).cast("double")
    per_label = track(spark, sf).groupBy(F.col("label").alias("epoch")).agg(
        F.avg("speed").alias("loss"), F.avg(hit).alias("acc"), F.count(F.lit(1)).cast("double").alias("macro_f1")
    )
    side = F.struct("loss", "acc", "macro_f1", F.col("macro_f1").alias("weighted_f1"))
    history = F.array_sort(F.collect_list(F.struct("epoch", side.alias("train"), side.alias("val"))))
    return R.epoch_metrics(per_label.agg(F.to_json(history).alias("history")))


@BOOK.query(
    "diagnostic_summary",
    f"""WITH {DATED} SELECT date, count(*) AS rows, {q6('avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END)', 'accuracy')},
    count(*) FILTER (label <> pred) AS errors FROM dated GROUP BY date""",
)
def diagnostic_summary(spark, sf):
    return rounded(R.diagnostic_summary(dated(spark, sf), "date", *YY), ["accuracy"])


# Scoring.


@BOOK.query(
    "late_fusion",
    f"""WITH flat AS (SELECT vec_id, r.range AS c, embedding[c + 1]::DOUBLE AS a, embedding[c + 12]::DOUBLE AS b,
      embedding[23 + 2 * c]::DOUBLE AS ga, embedding[24 + 2 * c]::DOUBLE AS gb FROM embeddings, range(11) r),
    fused AS (SELECT vec_id, c, (a * exp(ga) + b * exp(gb)) / (exp(ga) + exp(gb)) AS x FROM flat),
    best AS (SELECT vec_id, CAST(arg_max(c, (x, -c)) AS INTEGER) AS y_pred FROM fused GROUP BY 1)
    SELECT vec_id, CAST(c AS INTEGER) AS class_id, {q6('x', 'fused')}, y_pred FROM fused JOIN best USING (vec_id)""",
)
def late_fusion(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    out = SC.late_fusion(rows, [F.slice("e", 1, 11), F.slice("e", 12, 11)], F.slice("e", 23, 22))
    return out.select("vec_id", "y_pred", F.posexplode("fused").alias("class_id", "fused")).withColumn("fused", r6("fused"))


@BOOK.query(
    "join_predictions",
    f"""WITH {ANCHORS} SELECT a.entity_id, a.tie, a.second, t.label AS y_true, t.pred AS y_pred, t.label = t.pred AS correct
    FROM anchor a JOIN track t USING (entity_id, tie)""",
)
def join_predictions(spark, sf):
    predictions = track(spark, sf).select(*KEY, F.col("label").alias("y_true"), F.col("pred").alias("y_pred"))
    out = SC.join_predictions(anchors(spark, sf), predictions, KEY)
    return out.select(*KEY, "second", "y_true", "y_pred", "correct")


SLOTS = f"""{ANCHORS}, sized AS (SELECT *, max(seg_pos) OVER (PARTITION BY entity_id, segment_id) AS last_pos FROM seg),
slots AS (SELECT a.entity_id, a.tie, a.label, i.range AS i, r.speed AS x
  FROM sized a, range(5) i, seg r WHERE (a.seg_pos % 3 = 0 OR a.is_last)
    AND r.entity_id = a.entity_id AND r.segment_id = a.segment_id AND r.seg_pos = greatest(0, a.seg_pos - 4 + i.range)),
means AS (SELECT label AS class_id, i, avg(x) AS m FROM slots GROUP BY 1, 2),
far AS (SELECT entity_id, tie, class_id, sum((x - m) * (x - m)) AS d FROM slots JOIN means USING (i) GROUP BY 1, 2, 3)"""


@BOOK.query("batch_score", f"WITH {SLOTS} SELECT entity_id, tie, CAST(arg_min(class_id, (round(d, 9), class_id)) AS INTEGER) AS y_pred FROM far GROUP BY 1, 2")
def batch_score(spark, sf):
    """A nearest-mean classifier over windows of speeds, fitted, stored, and loaded once by each worker."""
    windows = A.build_windows(track(spark, sf), ORDER, 5, ["speed"], "causal", GAP, 3)
    samples = settled(windows.select(*KEY, "label", F.transform("window", lambda r: r["speed"]).alias("speeds")))
    name = SC.ship_model(SC.centroids(samples, "speeds"))
    return SC.batch_score(samples, lambda: SC.load_linear(name), "speeds", 5).select(*KEY, "y_pred")


@BOOK.query("baseline_classifier", f"WITH {TRACK} SELECT entity_id, tie, label, label AS y_pred FROM track")
def baseline_classifier(spark, sf):
    """Trained on separable rows: each class has a feature that only its rows raise, beside others that tell nothing."""
    signs = {f"sign_{c}": F.when(F.col("label") == c, 4.0).otherwise(0.0) + F.col("tie") % 7 / 10 for c in range(NUM_CLASSES)}
    rows = settled(track(spark, sf).withColumns(signs).select(*KEY, "label", "lon", "heading", *signs))
    weights = N.class_weights(rows).select(F.col("class_id").alias("label"), "weight")
    train = rows.join(F.broadcast(weights), "label")
    out = SC.baseline_classifier(train, rows, ["lon", "heading", *signs], weight="weight", max_iter=30)
    return out.select(*KEY, "label", "y_pred")
