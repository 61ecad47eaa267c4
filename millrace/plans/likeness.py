"""Likeness across passes and vectors (DD-11, DD-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import vectors as V
from millrace.plans import Catalog
from millrace.plans.syllabus import RATIO
from millrace.streaming import jobs

catalog = Catalog()
query = catalog.query

NEAR_STEM = 85
STEMS = "(SELECT p_brand || '-' || p_size % 10 AS leaf, p_partkey AS item, p_name || ' ' || p_type || ' lote ' || p_partkey % 20 || CASE WHEN p_partkey % 6 = 0 THEN ' extra' ELSE '' END AS stem FROM part)"


def _stems(parts):
    c = F.col
    leaf = F.concat_ws("-", "p_brand", (c("p_size") % 10).cast("string"))
    stem = F.concat("p_name", F.lit(" "), "p_type", F.lit(" lote "), (c("p_partkey") % 20).cast("string"), F.when(c("p_partkey") % 6 == 0, " extra").otherwise(""))
    return parts.select(leaf.alias("leaf"), c("p_partkey").alias("place"), c("p_partkey").alias("item"), stem.alias("stem"))


@query("dd_11", f"""WITH s AS (SELECT * FROM {STEMS}), l AS (SELECT leaf, list_reduce(list_transform(list({{'item': item, 'stem': stem}} ORDER BY item), lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {RATIO('k.stem', 'x[1].stem')} >= {NEAR_STEM})) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM s GROUP BY 1)
SELECT s.leaf, s.item, CASE WHEN len(list_filter(kept, lambda k: k.item = s.item)) = 0 THEN list_filter(kept, lambda k: k.item < s.item AND {RATIO('k.stem', 's.stem')} >= {NEAR_STEM})[1].item END AS duplicate_of FROM s JOIN l USING (leaf)""")
def pass_decisions(t):
    """Stems published in a pass join what later ones of their leaf are compared with; state is kept by leaf."""
    return jobs.run_available(jobs.pass_decisions(_stems(jobs.table_stream(t.spark, t.sf_dir, "part")), NEAR_STEM), "append")


@query("dd_12", f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {V.SAME}),
r AS (SELECT vec_id AS node, vec_id AS unit FROM v UNION SELECT l.v, r.unit FROM r JOIN l ON l.u = r.node)
SELECT node AS vec_id, min(unit) AS unit, (SELECT count(*) FROM l WHERE l.u = node) AS links FROM r GROUP BY node""")
def merged_vectors(t):
    """Vectors of a cosine of 0.92 and more are one unit, as are those that such links connect."""
    return V.merged_vectors(t.embeddings, "vec_id", "embedding")
