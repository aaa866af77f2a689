"""Queries on vector collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import dense, search
from corpusloom.registry import Registry
from corpusloom.session import table

REGISTRY = Registry()
DOT = "list_sum(list_transform(generate_series(1, len({a})), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _d(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


BASE = """WITH v AS (SELECT DISTINCT vec_id AS id, embedding AS vector, label FROM embeddings), q AS (SELECT id AS q, vector AS qv, label AS ql FROM v WHERE id % 50 = 0)
"""


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label").distinct()


def probes(vectors: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return vectors.where("id % 50 = 0").select(F.col("id").alias("q"), "vector")


ALL = BASE + f", s AS (SELECT q, id, round({_d('qv', 'vector')}, 6) AS score FROM q, v), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 48)\n"


@REGISTRY.query("dense_top48", ALL + "SELECT q, id, score, rank FROM t")
def dense_top48(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    return search.dense_top(v, probes(v), 48)


@REGISTRY.query("relative_cutoff", ALL + "SELECT q, id, score FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM t) WHERE score >= greatest(0.05, best * 0.6)")
def relative_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    top = dense_top48(spark, sf_dir).withColumn("best", F.max("score").over(W.partitionBy("q")))
    return top.where(F.col("score") >= F.greatest(F.lit(0.05), F.col("best") * 0.6)).select("q", "id", "score")


ALLOWED = BASE + f""", allowed AS (SELECT DISTINCT event_id AS id FROM events WHERE event_type = 'purchase'),
s AS (SELECT q, id, round({_d('qv', 'vector')}, 6) AS score FROM q, v WHERE id IN (SELECT id FROM allowed))
SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10"""


@REGISTRY.query("allow_list_top10", ALLOWED)
def allow_list_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search within a list of ids, here of the purchases; unknown ids count for nothing."""
    v = collection(spark, sf_dir)
    allowed = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id")).distinct()
    return search.dense_top(v.join(allowed, "id", "left_semi"), probes(v), 10)


GIST = BASE + """, e AS (SELECT generate_subscripts(vector, 1) - 1 AS pos, unnest(vector)::DOUBLE AS x FROM v), m AS (SELECT pos, avg(x) AS m FROM e GROUP BY pos),
g AS (SELECT pos, m / sqrt(sum(m * m) OVER ()) AS value FROM m)
"""


@REGISTRY.query("gist_centroid", GIST + "SELECT pos::INT AS pos, round(value, 6) AS value FROM g")
def gist_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.centroid(collection(spark, sf_dir)).select("pos", F.round("value", 6).alias("value"))


@REGISTRY.query("gist_scores", GIST + ", l AS (SELECT list(value ORDER BY pos) AS g FROM g) SELECT id, round(" + _d("vector", "g") + ", 6) AS score FROM v, l")
def gist_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    gist = dense.centroid(v).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("g"))  # a row a dimension
    return v.join(F.broadcast(gist)).select("id", F.round(V.dot(F.col("vector"), F.col("g")), 6).alias("score"))


@REGISTRY.query("vector_norms", BASE + "SELECT id, round(sqrt(" + _d("vector", "vector") + "), 6) AS length FROM v")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir).select("id", F.round(V.norm(F.col("vector")), 6).alias("length"))


PARTS = 16
ASSIGN = BASE + f""", r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS num, greatest(1, (SELECT count(*) FROM v) // {PARTS}) AS stride FROM v), c AS (SELECT (num // stride)::INT AS part, vector AS cv FROM r WHERE num % stride = 0 AND num < stride * {PARTS}), s AS (SELECT id, part, round({_d('vector', 'cv')}, 9) AS s FROM v, c),
a AS (SELECT id, part::INT AS part FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, part) = 1)
"""


def _start(v: DataFrame) -> DataFrame:
    """PARTS vectors at equal strides of the collection."""
    return dense.strided(v, PARTS)


@REGISTRY.query("kmeans_assign_step", ASSIGN + "SELECT id, part FROM a")
def kmeans_assign_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    return dense.assign(v, _start(v))


@REGISTRY.query(
    "kmeans_update_step",
    ASSIGN
    + """, e AS (SELECT part, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector)::DOUBLE AS x FROM v JOIN a USING (id)),
m AS (SELECT part, pos, avg(x) AS m FROM e GROUP BY ALL)
SELECT part, pos::INT AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY part)), 6) AS value FROM m""",
)
def kmeans_update_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    centroids = dense.update(v, dense.assign(v, _start(v)), 64)
    return centroids.select("part", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


@REGISTRY.query("kmeans_parts")
def kmeans_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each part after spherical k-means over the whole collection."""
    _, parts = dense.kmeans(collection(spark, sf_dir), PARTS)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))


@REGISTRY.query(
    "ivf_probe",
    ASSIGN
    + f""", n AS (SELECT q, qv, part, row_number() OVER (PARTITION BY q ORDER BY {_d('qv', 'cv')} DESC, part) AS r FROM q, c QUALIFY r <= 4),
s2 AS (SELECT n.q, v.id, round({_d('n.qv', 'v.vector')}, 6) AS score FROM n JOIN a ON a.part = n.part JOIN v ON v.id = a.id)
SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank FROM s2 QUALIFY rank <= 10""",
)
def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    centroids = _start(v)
    return dense.probe(v.join(dense.assign(v, centroids), "id"), centroids, probes(v), 4, 10)


TERN = BASE + """, t AS (SELECT id, list_transform(vector, lambda x: CASE WHEN x > 0.3 / sqrt(len(vector)) THEN 1 WHEN x < -0.3 / sqrt(len(vector)) THEN -1 ELSE 0 END) AS c FROM v)
"""


@REGISTRY.query(
    "ternary_codes",
    TERN + "SELECT id, len(list_filter(c, lambda x: x > 0))::INT AS plus, len(list_filter(c, lambda x: x < 0))::INT AS minus FROM t",
)
def ternary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = collection(spark, sf_dir).select("id", V.ternary(F.col("vector")).alias("c"))
    return codes.select("id", F.size(F.filter("c", lambda x: x > 0)).alias("plus"), F.size(F.filter("c", lambda x: x < 0)).alias("minus"))


@REGISTRY.query(
    "ternary_top10",
    TERN
    + """, s AS (SELECT a.id AS q, b.id, list_sum(list_transform(generate_series(1, len(a.c)), lambda i: a.c[i] * b.c[i]))::INT AS agreement FROM t a, t b WHERE a.id % 50 = 0)
SELECT q, id, agreement, row_number() OVER (PARTITION BY q ORDER BY agreement DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""",
)
def ternary_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    return dense.ternary_top(v, probes(v), 10)


@REGISTRY.query(
    "coarse_to_fine_top10",
    TERN
    + f""", s AS (SELECT a.id AS q, b.id, list_sum(list_transform(generate_series(1, len(a.c)), lambda i: a.c[i] * b.c[i]))::INT AS agreement FROM t a, t b WHERE a.id % 50 = 0),
n AS (SELECT q, id FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY agreement DESC, id) <= 80), e AS (SELECT n.q, n.id, round({_d('q.qv', 'v.vector')}, 6) AS score FROM n JOIN q USING (q) JOIN v ON v.id = n.id)
SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank FROM e QUALIFY rank <= 10""",
)
def coarse_to_fine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = collection(spark, sf_dir)
    return dense.coarse_to_fine(v, probes(v), 10)


@REGISTRY.query(
    "ternary_gemv",
    BASE
    + """, e AS (SELECT id AS r, generate_subscripts(vector, 1) AS c, unnest(vector)::DOUBLE AS w FROM v), sc AS (SELECT r, avg(abs(w)) AS scale FROM e GROUP BY r),
x AS (SELECT generate_subscripts(vector, 1) AS c, unnest(vector)::DOUBLE AS x FROM v WHERE id = 0)
SELECT r AS "row", round(sum(CASE WHEN w > scale / 2 THEN x WHEN w < -scale / 2 THEN -x ELSE 0 END) * max(scale), 6) AS y FROM e JOIN sc USING (r) JOIN x USING (c) GROUP BY r""",
)
def ternary_gemv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection as a matrix, quantised row by row to signs and a scale, times one vector."""
    v = collection(spark, sf_dir)
    x = v.where("id = 0").select(F.col("vector").alias("x"))
    scale = F.aggregate("vector", F.lit(0.0), lambda s, w: s + F.abs(w.cast("double"))) / F.size("vector")
    signs = F.transform("vector", lambda w: F.when(w.cast("double") > F.col("scale") / 2, 1).when(w.cast("double") < -F.col("scale") / 2, -1).otherwise(0))
    rows = v.withColumn("scale", scale).withColumn("signs", signs).join(F.broadcast(x))
    return rows.select(F.col("id").alias("row"), F.round(V.dot(F.col("signs"), F.col("x")) * F.col("scale"), 6).alias("y"))


@REGISTRY.query("normalized_vectors", BASE + ", e AS (SELECT id, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector)::DOUBLE AS x FROM v) SELECT id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS value FROM e")
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collection(spark, sf_dir).select("id", F.posexplode(V.normalized(F.col("vector"))).alias("pos", "value"))
    return rows.withColumn("value", F.round("value", 6))


@REGISTRY.query("gist_cosines", GIST + ", l AS (SELECT list(value ORDER BY pos) AS g FROM g) SELECT id, round(" + _d("vector", "g") + " / sqrt(" + _d("vector", "vector") + " * " + _d("g", "g") + "), 6) AS cosine, round(sqrt(" + _d("vector", "vector") + " + " + _d("g", "g") + " - 2 * " + _d("vector", "g") + "), 6) AS surprise FROM v, l")
def gist_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the gist: true cosine, and the distance that counts as surprise."""
    v = collection(spark, sf_dir)
    gist = dense.centroid(v).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("g"))  # a row a dimension
    rows = v.join(F.broadcast(gist))
    return rows.select("id", F.round(V.true_cosine(F.col("vector"), F.col("g")), 6).alias("cosine"), F.round(V.distance(F.col("vector"), F.col("g")), 6).alias("surprise"))


TUNED = BASE + """, r AS (SELECT label, vector, row_number() OVER (PARTITION BY label ORDER BY id DESC) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM v),
e AS (SELECT label, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector)::DOUBLE AS x, CASE WHEN k = n - 1 THEN pow(0.75, k) ELSE 0.25 * pow(0.75, k) END AS w FROM r)
SELECT label::BIGINT AS label, pos::INT AS pos, round(sum(w * x), 6) AS value FROM e GROUP BY label, pos"""


@REGISTRY.query("tuned_vectors", TUNED)
def tuned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors blended in order of id, a quarter of the new one."""
    from corpusloom.operators import holographic

    out = holographic.tuned(collection(spark, sf_dir), "label", "id", 0.25)
    return out.select(F.col("label").cast("long").alias("label"), F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


@REGISTRY.query("index_recall")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, recall, scanned): what the approximate searches of the stated queries find of the exact
    ten best, and the part of the collection that they score exactly."""
    v = collection(spark, sf_dir)
    q = probes(v)
    exact = search.dense_top(v, q, 10).select("q", "id")
    centroids, parts = dense.kmeans(v, PARTS)
    held = v.join(parts, "id")
    n, asked, want = v.count(), q.count(), exact.count()
    sizes = held.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    read = dense.nearest_parts(q, centroids, 4).join(sizes, "part").agg(F.sum("size")).first()[0] or 0
    rows = []
    for name, got, seen in (("partitions", dense.probe(held, centroids, q, 4, 10), read), ("ternary", dense.coarse_to_fine(v, q, 10), 80 * asked)):
        both = got.select("q", "id").join(exact, ["q", "id"]).count()
        rows.append((name, round(both / max(want, 1), 4), round(seen / max(asked * n, 1), 4)))
    return spark.createDataFrame(rows, "method string, recall double, scanned double")
