"""Queries on components of run-length rows and the boxes proposed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import boxes
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: Rows of an image, and columns that a line may fill, in the images drawn from order lines.
ROWS, WIDE = 24, 5


def drawn_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run-length rows drawn by order lines: an order is a row of an image of ROWS orders, a line a run in its own columns."""
    order, at = F.col("l_orderkey"), F.col("l_linenumber") * WIDE + F.col("l_suppkey") % 3
    return table(spark, d, "lineitem").filter("(l_partkey + l_linenumber) % 5 < 2").select(
        F.floor(order / ROWS).cast("long").alias("image"), (order % ROWS).cast("long").alias("y"), at.cast("long").alias("x0"), (at + 1 + F.col("l_partkey") % 3).cast("long").alias("x1")
    )


_COMPONENTS = f"""r AS (SELECT *, row_number() OVER (ORDER BY image, y, x0) AS id FROM (SELECT l_orderkey // {ROWS} AS image, l_orderkey % {ROWS} AS y, l_linenumber * {WIDE} + l_suppkey % 3 AS x0, l_linenumber * {WIDE} + l_suppkey % 3 + 1 + l_partkey % 3 AS x1 FROM lineitem WHERE (l_partkey + l_linenumber) % 5 < 2)),
e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.id <> b.id),
reach AS (SELECT id AS a, id AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
top AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1),
c AS (SELECT image, sum(x1 - x0)::BIGINT AS area, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) + 1 AS y1, sum((x1 - x0) * (x0 + x1 - 1) / 2.0) / sum(x1 - x0) AS centre_x, sum((x1 - x0) * y) / sum(x1 - x0) AS centre_y,
  min(struct_pack(y := y, x := x0)) AS f FROM r JOIN top USING (id) GROUP BY image, root)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT image, area, x0, y0, x1, y1, round(centre_x, 6) AS centre_x, round(centre_y, 6) AS centre_y, f.y AS first_y, f.x AS first_x FROM c")
def run_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the drawn images, joined up in strips of 8 rows."""
    out = boxes.components(drawn_runs(spark, d), "image", 8)
    return out.withColumns({c: F.round(c, 6) for c in ("centre_x", "centre_y")})


_IOU = "coalesce(greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) / nullif((p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)), 0)::DOUBLE, 0)"


@query(f"""WITH RECURSIVE {_COMPONENTS},
n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY f) AS idx FROM c),
m AS (SELECT image, 0 AS step, list(struct_pack(i := idx, x0 := greatest(0, x0 - 2), y0 := greatest(0, y0 - 2), x1 := least(42, x1 + 2), y1 := least({ROWS}, y1 + 2), area := area) ORDER BY idx) AS b, NULL::BIGINT AS li, NULL::BIGINT AS ri, NULL::DOUBLE AS iou
    FROM n WHERE area BETWEEN 3 AND 12 GROUP BY 1
  UNION ALL SELECT image, step + 1,
    list_transform(list_filter(range(1, len(b) + 1), lambda k: k <> h.j), lambda k: CASE WHEN k = h.i THEN struct_pack(i := b[k].i, x0 := least(b[k].x0, b[h.j].x0), y0 := least(b[k].y0, b[h.j].y0), x1 := greatest(b[k].x1, b[h.j].x1), y1 := greatest(b[k].y1, b[h.j].y1), area := b[k].area + b[h.j].area) ELSE b[k] END),
    b[h.i].i, b[h.j].i, h.iou
  FROM m, LATERAL (SELECT i, j, iou FROM (SELECT i, j, {_IOU} AS iou FROM (SELECT i, j, b[i] AS p, b[j] AS q FROM range(1, len(b) + 1) t(i), range(1, len(b) + 1) u(j) WHERE i < j)) WHERE iou >= 0.2 ORDER BY i, j LIMIT 1) h),
l AS (SELECT image, unnest(arg_max(b, step)) AS x FROM m GROUP BY 1),
o AS (SELECT image, x, row_number() OVER (PARTITION BY image ORDER BY x.y0, x.x0, x.area DESC, x.i) AS k FROM l)
SELECT image, 'skipped' AS decision, CASE WHEN area < 3 THEN 'component_area_below_minimum' ELSE 'component_area_above_maximum' END AS reason, NULL::BIGINT AS proposal_index, idx AS left_index, NULL::BIGINT AS right_index, NULL::DOUBLE AS iou, NULL::BIGINT AS x0, NULL::BIGINT AS y0, NULL::BIGINT AS x1, NULL::BIGINT AS y1, area FROM n WHERE area < 3 OR area > 12
UNION ALL SELECT image, 'merged', 'bbox_iou_at_or_above_merge_threshold', NULL, li, ri, round(iou, 6), NULL, NULL, NULL, NULL, NULL FROM m WHERE step > 0
UNION ALL SELECT image, CASE WHEN k <= 6 THEN 'generated' ELSE 'overflow' END, CASE WHEN k <= 6 THEN 'accepted' ELSE 'proposal_count_above_maximum' END, k, x.i, NULL, NULL, x.x0, x.y0, x.x1, x.y1, x.area FROM o""")
def merged_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Boxes proposed from the drawn images' components: skipped by area, padded by 2, merged at an overlap of 0.2, six an image."""
    found = boxes.components(drawn_runs(spark, d), "image", 8)
    return boxes.proposals(found, "image", F.lit(42), F.lit(ROWS), 3, 12, 2, 0.2, 6).withColumn("iou", F.round("iou", 6))
