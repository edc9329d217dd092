"""Feature rows of name pairs and a fixed logistic score over search signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking
from ..operators.learned import logistic_score
from ..sources import read_table
from .retrieval import _SQL, _candidates, _top


def token_overlap_features(spark, sf_dir):
    """Distinct part names that share a token: shared, union, Jaccard and share of inverse document frequency in common."""
    names = read_table(spark, sf_dir, "part").select("p_name").distinct()
    t = names.select("p_name", F.explode(F.array_distinct(T.tokens(F.lower("p_name")))).alias("token"))
    n = names.agg(F.count(F.lit(1)).alias("n"))
    weight = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("token", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("w"))
    t = t.join(weight, "token")
    own = t.groupBy("p_name").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("total"))
    pairs = t.select("token", "w", F.col("p_name").alias("a")).join(t.select("token", F.col("p_name").alias("b")), "token").filter("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum("w").alias("common"))
    x, y = (own.select(F.col("p_name").alias(c), F.col("k").alias(f"k{c}"), F.col("total").alias(f"t{c}")) for c in "ab")
    out = pairs.join(x, "a").join(y, "b")
    union = F.col("ka") + F.col("kb") - F.col("shared")
    return out.select("a", "b", "shared", union.alias("n_union"), F.round(F.col("shared") / union, 6).alias("jaccard"), F.round(F.col("common") / (F.col("ta") + F.col("tb") - F.col("common")), 6).alias("idf_overlap"))


TOKEN_OVERLAP_FEATURES = """WITH t AS (SELECT p_name, unnest(list_distinct(string_split(lower(p_name), ' '))) AS token FROM (SELECT DISTINCT p_name FROM part)),
w AS (SELECT token, ln(((SELECT count(DISTINCT p_name) FROM part) + 1) / (count(*) + 1)) + 1 AS w FROM t GROUP BY token),
x AS (SELECT p_name, token, w FROM t JOIN w USING (token)), o AS (SELECT p_name, count(*) AS k, sum(w) AS total FROM x GROUP BY 1),
p AS (SELECT a.p_name AS a, b.p_name AS b, count(*) AS shared, sum(a.w) AS common FROM x a JOIN x b ON a.token = b.token AND a.p_name < b.p_name GROUP BY ALL)
SELECT a, b, shared, x.k + y.k - shared AS n_union, round(shared / (x.k + y.k - shared), 6) AS jaccard, round(common / (x.total + y.total - common), 6) AS idf_overlap FROM p JOIN o x ON p.a = x.p_name JOIN o y ON p.b = y.p_name"""


def logistic_rerank(spark, sf_dir):
    """The five best of a query by a fixed logistic score of both views and the lead over the next item."""
    c = _top(_candidates(spark, sf_dir), 10).withColumn("lead", F.coalesce(F.col("score") - F.lead("score").over(Window.partitionBy("query_id").orderBy("pos")), F.lit(0.0)))
    c = c.withColumn("p", F.round(logistic_score({"view0": 2.0, "view1": 1.5, "lead": 4.0}, -0.5), 9))
    return c.withColumn("rank", F.row_number().over(ranking.by_score("p"))).filter("rank <= 5").select("query_id", "item_id", F.round("p", 6).alias("probability"), "rank")


LOGISTIC_RERANK = _SQL + """, l AS (SELECT *, coalesce(score - lead(score) OVER (PARTITION BY query_id ORDER BY pos), 0) AS lead FROM c WHERE pos <= 10),
z AS (SELECT query_id, item_id, pos, round(1 / (1 + exp(-(-0.5::DOUBLE + view0 * 2.0::DOUBLE + view1 * 1.5::DOUBLE + lead * 4.0::DOUBLE))), 9) AS p FROM l)
SELECT query_id, item_id, round(p, 6) AS probability, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, pos) AS rank FROM z QUALIFY rank <= 5"""


def signal_policy_scores(spark, sf_dir):
    """One score of several signals by policy: the first, the second, the greatest, and each policy's winner."""
    c = _top(_candidates(spark, sf_dir))
    long = c.select("query_id", "item_id", "pos", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), s.alias("s")) for n, s in (("first", F.col("view0")), ("second", F.col("view1")), ("greatest", F.greatest("view0", "view1")))])).alias("p"))
    return long.groupBy("query_id", "p.policy").agg(F.max_by("item_id", F.struct("p.s", -F.col("pos"))).alias("winner"), F.round(F.max("p.s"), 6).alias("best"))


SIGNAL_POLICY_SCORES = _SQL + ", z AS (SELECT query_id, item_id, pos, unnest([{'policy': 'first', 's': view0}, {'policy': 'second', 's': view1}, {'policy': 'greatest', 's': greatest(view0, view1)}]) AS p FROM c WHERE pos <= 5) SELECT query_id, p.policy AS policy, arg_max(item_id, {'a': p.s, 'b': -pos}) AS winner, round(max(p.s), 6) AS best FROM z GROUP BY ALL"

_NAMES = ("token_overlap_features", "logistic_rerank", "signal_policy_scores")
QUERIES = {name: globals()[name] for name in _NAMES}
ORACLES = {name: globals()[name.upper()] for name in _NAMES}
