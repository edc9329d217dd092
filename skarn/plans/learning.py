"""Queries over ``embeddings`` for training sets: hard negatives of three tiers, and the metrics a model is judged by inside training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, negatives
from ..sources import read_table
from .retrieval import _SQL, _asked, knn_topk

SEED, FAMILY, HARD, DRAWN, POOL = 17, 4, 8, 2, 20


def _negatives(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return rows, negatives.hard_negatives(rows, _asked(rows), SEED, FAMILY, HARD, DRAWN, POOL)


def tiered_negatives(spark, sf_dir):
    """Negatives of each query: family, neighbours, seeded draws from outside the family."""
    return _negatives(spark, sf_dir)[1]


def _draw(n: int) -> str:
    return f"('0x' || substr(md5('{SEED}:' || query_id || ':{n}'), 1, {negatives.DIGITS}))::BIGINT"


def _skip(draw: str, taken: str) -> str:
    return f"list_reduce(list_prepend({draw}, {taken}), lambda p, t: CASE WHEN t <= p THEN p + 1 ELSE p END)"


_NEGATIVES = _SQL + f""",
placed AS (SELECT vec_id, label, row_number() OVER (ORDER BY label NULLS LAST, vec_id) - 1 AS place FROM embeddings),
families AS (SELECT label, min(place) AS start, count(*) AS size FROM placed WHERE label IS NOT NULL GROUP BY label),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS n FROM s),
kin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS n FROM s WHERE item_label = query_label),
hard AS (
  SELECT query_id, item_id, CASE WHEN t = 0 THEN 'family' ELSE 'visual' END AS tier, row_number() OVER (PARTITION BY query_id ORDER BY t, n) AS slot
  FROM (SELECT query_id, item_id, min(t) AS t, arg_min(n, t) AS n FROM (SELECT query_id, item_id, 0 AS t, n FROM kin WHERE n <= {FAMILY} UNION ALL SELECT query_id, item_id, 1, n FROM near WHERE n <= {POOL}) GROUP BY ALL)
  QUALIFY slot <= {HARD}
),
anchors AS (
  SELECT p.vec_id AS query_id, coalesce(f.start, 0) AS start, coalesce(f.size, 0) AS size, (SELECT count(*) FROM placed) AS total,
    list_sort(list_append((SELECT list(h.place) FROM (SELECT x.place FROM hard JOIN placed x ON x.vec_id = hard.item_id WHERE hard.query_id = p.vec_id) h), p.place)) AS taken
  FROM placed p LEFT JOIN families f ON f.label = p.label WHERE p.vec_id % 100 = 0
),
open AS (
  SELECT *, list_transform(list_filter(taken, lambda p: p < start OR p >= start + size), lambda p: CASE WHEN p < start THEN p ELSE p - size END) AS outside FROM anchors
),
ready AS (SELECT *, total - size - len(outside) < {DRAWN} AS wide FROM open),
free AS (SELECT *, CASE WHEN wide THEN taken ELSE outside END AS closed, CASE WHEN wide THEN total - len(taken) ELSE total - size - len(outside) END AS left_over FROM ready),
one AS (SELECT *, {_skip(f"{_draw(0)} % greatest(left_over, 1)", 'closed')} AS d0 FROM free),
two AS (SELECT *, {_skip(f"{_draw(1)} % greatest(left_over - 1, 1)", 'list_sort(list_append(closed, d0))')} AS d1 FROM one),
picked AS (
  SELECT query_id, n, CASE WHEN wide OR d < start THEN d ELSE d + size END AS place
  FROM (SELECT *, 0 AS n, d0 AS d FROM two WHERE left_over > 0 UNION ALL SELECT *, 1, d1 FROM two WHERE left_over > 1)
),
sure AS (
  SELECT query_id, item_id, tier, slot FROM hard
  UNION ALL SELECT query_id, vec_id, 'random', n + {HARD + 1} FROM picked JOIN placed USING (place)
),
negatives AS (
  SELECT query_id, item_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY slot)::INTEGER AS slot
  FROM (SELECT * FROM sure UNION ALL SELECT query_id, item_id, 'fallback', n + {HARD + DRAWN} FROM near WHERE n <= {POOL} AND (query_id, item_id) NOT IN (SELECT (query_id, item_id) FROM sure))
  QUALIFY slot <= {HARD + DRAWN}
)"""
TIERED_NEGATIVES = _NEGATIVES + " SELECT query_id, item_id, tier, slot FROM negatives"


def internal_metrics(spark, sf_dir):
    """Two views of each query item, each half of its vector, against the whole catalogue, its candidates and its family."""
    rows, found = _negatives(spark, sf_dir)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 32)
    half = lambda first: F.concat(F.slice("embedding", 1, 32), zeros) if first else F.concat(zeros, F.slice("embedding", 33, 32))
    views = [_asked(rows).select((F.col("vec_id") * 2 + n).alias("view_id"), "vec_id", half(n == 0).alias("embedding"), F.lit(f"view{n}").alias("bucket")) for n in (0, 1)]
    return negatives.internal_metrics(views[0].unionByName(views[1]), found, rows)


INTERNAL_METRICS = _NEGATIVES + """,
v AS (
  SELECT q.vec_id AS target, e.vec_id AS item_id, bucket, round(CASE bucket WHEN 'view0' THEN list_inner_product(q.v[1:32], e.v[1:32]) ELSE list_inner_product(q.v[33:64], e.v[33:64]) END, 9) AS score
  FROM e q, e, (SELECT unnest(['view0', 'view1']) AS bucket) WHERE q.vec_id % 100 = 0
),
full_best AS (SELECT target, bucket, item_id FROM v QUALIFY row_number() OVER (PARTITION BY target, bucket ORDER BY score DESC, item_id) = 1),
listed AS (SELECT v.*, coalesce(n.tier, 'target') AS tier FROM v LEFT JOIN negatives n ON n.query_id = v.target AND n.item_id = v.item_id WHERE n.item_id IS NOT NULL OR v.item_id = v.target),
candidate AS (SELECT target, bucket, item_id FROM listed QUALIFY row_number() OVER (PARTITION BY target, bucket ORDER BY score DESC, item_id) = 1),
kin_best AS (SELECT target, bucket, item_id FROM listed WHERE tier IN ('family', 'target') QUALIFY row_number() OVER (PARTITION BY target, bucket ORDER BY score DESC, item_id) = 1),
each AS (SELECT target, bucket, max(score) FILTER (WHERE tier = 'target') AS positive, max(score) FILTER (WHERE tier = 'family') AS hardest FROM listed GROUP BY ALL)
SELECT x.bucket, count(*) AS views, round(avg((c.item_id = x.target)::INTEGER), 6) AS candidate_top1, round(avg((f.item_id = x.target)::INTEGER), 6) AS full_top1, count(hardest) AS family_views,
  round(avg(CASE WHEN hardest IS NOT NULL THEN (k.item_id = x.target)::INTEGER END), 6) AS family_top1, round(avg(positive - hardest), 6) AS margin_mean,
  round(avg(CASE WHEN hardest IS NOT NULL THEN positive END), 6) AS positive_mean, round(avg(hardest), 6) AS hardest_mean
FROM each x JOIN candidate c USING (target, bucket) JOIN full_best f USING (target, bucket) JOIN kin_best k USING (target, bucket) GROUP BY x.bucket"""

def repeat_check(spark, sf_dir):
    """The search run three times: the same rows each time."""
    return guards.repeated(lambda: knn_topk(spark, sf_dir), 3)


REPEAT_CHECK = _SQL + " SELECT 3 AS repeats, count(*) AS rows, true AS all_equal FROM c WHERE pos <= 5"

QUERIES = {"repeat_check": repeat_check, "tiered_negatives": tiered_negatives, "internal_metrics": internal_metrics}
ORACLES = {"repeat_check": REPEAT_CHECK, "tiered_negatives": TIERED_NEGATIVES, "internal_metrics": INTERNAL_METRICS}
