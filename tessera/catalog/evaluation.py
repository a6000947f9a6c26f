"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog.registry import Registry
from tessera.operators import metrics as M

QUERIES = Registry()

CURVE = A.sql("scored") + """,
grid AS (SELECT c.category, t.k FROM (SELECT DISTINCT category FROM scored) c, (SELECT CAST(unnest(range(256)) AS INT) AS k) t),
totals AS (SELECT category, sum(gt) AS p, sum(1 - gt) AS n FROM scored GROUP BY 1),
base AS (SELECT g.category, g.k, g.k / 255.0 AS thr,
  CAST(sum(CASE WHEN s.gt = 1 AND s.score < CAST(g.k AS DOUBLE) / 255 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN s.gt = 0 AND s.score >= CAST(g.k AS DOUBLE) / 255 THEN 1 ELSE 0 END) AS BIGINT) AS fp
  FROM grid g JOIN scored s USING (category) GROUP BY 1, 2),
counted AS (SELECT category, k, CAST(k AS DOUBLE) / 255 AS thr, fn, fp, CAST(p - fn AS BIGINT) AS tp, CAST(n - fp AS BIGINT) AS tn, CAST(p - fn AS DOUBLE) / (p - fn + fp + 1e-10) AS precision, CAST(p - fn AS DOUBLE) / p AS recall FROM base JOIN totals USING (category)),
curve AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-10) AS f FROM counted)"""
BEST = CURVE + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f DESC, k) AS rn FROM curve WHERE precision > 0 OR recall > 0),
best AS (SELECT * FROM ranked WHERE rn = 1)"""


def rounded(df, *names: str, digits: int = 9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@QUERIES.add(CURVE + " SELECT category, k, round(thr, 9) AS thr, fn, fp, tp, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f, 9) AS f FROM curve")
def pr_curve(spark, d):
    return rounded(M.pr_curve(A.scored(spark, d), "category"), "thr", "precision", "recall", "f")


@QUERIES.add(BEST + " SELECT category, k, round(thr, 9) AS thr, fn, fp, tp, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f, 9) AS f FROM best")
def max_f(spark, d):
    return rounded(M.max_f(M.pr_curve(A.scored(spark, d), "category"), "category"), "thr", "precision", "recall", "f")


@QUERIES.add(CURVE + """,
levels AS (SELECT CAST(unnest(range(11)) AS DOUBLE) * CAST(0.1 AS DOUBLE) AS level),
tops AS (SELECT category, level, max(precision) AS top FROM curve JOIN levels ON recall >= level WHERE precision > 0 OR recall > 0 GROUP BY 1, 2)
SELECT category, round(sum(top) / 11, 9) AS ap FROM tops GROUP BY 1""")
def avg_precision_11pt(spark, d):
    return rounded(M.average_precision(M.pr_curve(A.scored(spark, d), "category"), "category"), "ap")


@QUERIES.add(BEST + """ SELECT category, round(tp / CAST(tp + fp + fn AS DOUBLE), 9) AS quality, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 9) AS accuracy,
round(tp / CAST(tp + fn AS DOUBLE), 9) AS tpr, round(fp / CAST(fp + tn AS DOUBLE), 9) AS fpr, round(fn / CAST(tp + fn AS DOUBLE), 9) AS fnr, round(tn / CAST(fp + tn AS DOUBLE), 9) AS tnr,
round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall FROM best""")
def eval_measures(spark, d):
    best = M.max_f(M.pr_curve(A.scored(spark, d), "category"), "category")
    return rounded(M.measures(best, "category"), "quality", "accuracy", "tpr", "fpr", "fnr", "tnr", "precision", "recall")


@QUERIES.add(A.sql("lbl") + " SELECT image_id, gt, pred, count(*) AS n FROM lbl WHERE gt <> 0 GROUP BY 1, 2, 3")
def confusion_matrix(spark, d):
    return M.confusion(A.labelled(spark, d), "image_id")


CLASSES = A.sql("lbl") + """,
m AS (SELECT gt, pred, count(*) AS n FROM lbl WHERE gt <> 0 GROUP BY 1, 2),
dim AS (SELECT CAST(unnest([1, 2, 3]) AS INT) AS cls),
sums AS (SELECT cls, coalesce((SELECT sum(n) FROM m WHERE gt = cls), 0) AS g, coalesce((SELECT sum(n) FROM m WHERE pred = cls), 0) AS p, coalesce((SELECT sum(n) FROM m WHERE gt = cls AND pred = cls), 0) AS ok FROM dim),
metrics AS (SELECT cls, CAST(g AS BIGINT) AS gt_n, CAST(p AS BIGINT) AS pred_n, CAST(ok AS BIGINT) AS ok, CASE WHEN g = 0 THEN 0.0 ELSE CAST(ok AS DOUBLE) / g END AS recall, CASE WHEN g + p - ok = 0 THEN 0.0 ELSE CAST(ok AS DOUBLE) / (g + p - ok) END AS iou FROM sums)"""


@QUERIES.add(CLASSES + " SELECT cls, gt_n, pred_n, ok, round(CAST(recall AS DOUBLE), 9) AS recall, round(CAST(iou AS DOUBLE), 9) AS iou FROM metrics")
def confusion_metrics(spark, d):
    return rounded(M.class_metrics(M.confusion(A.labelled(spark, d)), 3), "recall", "iou")


@QUERIES.add(CLASSES + " SELECT round(CAST(sum(ok) AS DOUBLE) / sum(gt_n), 9) AS overall, round(CAST(avg(recall) AS DOUBLE), 9) AS average, round(CAST(avg(iou) AS DOUBLE), 9) AS waverage FROM metrics")
def confusion_summary(spark, d):
    return rounded(M.summary(M.class_metrics(M.confusion(A.labelled(spark, d)), 3)), "overall", "average", "waverage")


@QUERIES.add(CLASSES + """, cells AS (SELECT cls, string_agg(printf('%.2f', CASE WHEN gt_n = 0 THEN 0.0 ELSE 100.0 * coalesce((SELECT sum(n) FROM m WHERE gt = cls AND pred = k), 0) / gt_n END), ' ' ORDER BY k) AS shares FROM metrics, (SELECT unnest([1, 2, 3]) AS k) GROUP BY cls)
SELECT cls AS line, shares || printf(' recall %.2f iou %.2f', CAST(100 * recall AS DOUBLE), CAST(100 * iou AS DOUBLE)) AS value FROM metrics JOIN cells USING (cls)
UNION ALL SELECT 4, printf('overall %.2f average %.2f waverage %.2f', 100.0 * sum(ok) / sum(gt_n), CAST(100 * avg(recall) AS DOUBLE), CAST(100 * avg(iou) AS DOUBLE)) FROM metrics""")
def confusion_report(spark, d):
    return M.report(M.confusion(A.labelled(spark, d)), 3)


@QUERIES.add(A.sql("raster") + """,
images AS (SELECT count(DISTINCT image_id) AS n FROM raster)
SELECT x, y, round(sum(CASE WHEN v > 500 THEN 1 ELSE 0 END) / CAST((SELECT n FROM images) AS DOUBLE), 9) AS prior FROM raster GROUP BY 1, 2""")
def location_prior(spark, d):
    masks = A.raster(spark, d).withColumn("label", (F.col("v") > 500).cast("int"))
    return rounded(M.location_prior(masks), "prior")
