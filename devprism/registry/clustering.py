"""Queries over matrices, neighbor joins, density and spectral clustering, and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devprism.operators import density, features as feature_ops, neighbors, silhouette, spectral, vectors
from devprism.registry.core import query
from devprism.registry.features import ALL_FEATURES, AUTHOR_ALL, COMMIT_ALL, author_features
from devprism.registry.tables import PLACES, commits, sql, sql_mean, table
from devprism.runtime import land

WIDTH = 64
PAIR = ["ns", "nm"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


# --- matrices --------------------------------------------------------------------------------


def sql_scaled(source: str, cols: list[str], key: str = "author", places: int | None = 6) -> str:
    z = lambda c: (
        f'coalesce(("{c}" - avg("{c}") OVER ()) / nullif(CASE WHEN min("{c}") OVER () < max("{c}") OVER () '
        f'THEN stddev_pop("{c}") OVER () END, 0), 0.0::DOUBLE)'
    )
    wrap = (lambda e: f"round({e}, {places})") if places else (lambda e: e)
    return f"SELECT {key}, " + ", ".join(f'{wrap(z(c))} AS "{c}"' for c in cols) + f" FROM ({source})"


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in feature_ops.COMMIT_FEATURES)


def matrix(spark: SparkSession, sf_dir: str, which: int):
    """One of the two matrices. Scaling reads its input twice, for the moments and for the rows, so that is landed."""
    whole, commit = author_features(spark, sf_dir), feature_ops.author_commit_features(commits(spark, sf_dir), places=PLACES)
    tables = [land(df, "matrix") if i == which else df for i, df in enumerate((whole, commit))]
    return vectors.load_matrices(*tables)[which]


@query("standardized_features", "P21 M1", sql_scaled(AUTHOR_ALL, ALL_FEATURES))
def standardized_features(spark, sf_dir):
    return rounded(matrix(spark, sf_dir, 0))


@query(
    "standardized_commit_features", "M1 F4",
    sql(sql_scaled(f"SELECT * FROM ({COMMIT_ALL}) WHERE {COMPLETE}", feature_ops.COMMIT_FEATURES), "commits"),
)
def standardized_commit_features(spark, sf_dir):
    return rounded(matrix(spark, sf_dir, 1))


PAIR_MEANS = f"SELECT author, {sql_mean('ns')} AS ns, {sql_mean('nm')} AS nm FROM commits GROUP BY author"
AUTHOR_POINTS = {
    "commits_means": PAIR_MEANS,
    "scaled": sql_scaled("SELECT * FROM commits_means", PAIR, places=None),
    "points": "SELECT CAST(substr(author, 4) AS BIGINT) AS id, ns AS x, nm AS y FROM scaled",
}


def author_points(spark, sf_dir):
    """Two standardized commit features per author: a matrix the reference grid fits."""
    means = feature_ops.author_commit_means(commits(spark, sf_dir), places=PLACES).select("author", *PAIR)
    scaled = vectors.standardize(land(means, "means"), PAIR).withColumn("id", F.expr("cast(substr(author, 4) as bigint)"))
    return land(vectors.to_points(scaled, "id", PAIR), "points")


def embedding_points(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"), F.col("label"))


# --- neighbor joins --------------------------------------------------------------------------

NEAR = """SELECT p.id AS a, q.id AS b, abs(p.x - q.x) + abs(p.y - q.y) AS dist FROM points p JOIN points q
    ON p.id < q.id AND abs(p.x - q.x) + abs(p.y - q.y) <= {}"""


@query("pairs_within_radius", "J7", sql("SELECT a, b, round(dist, 6) AS dist FROM near", "commits", **AUTHOR_POINTS, near=NEAR.format(0.3)))
def pairs_within_radius(spark, sf_dir):
    points = author_points(spark, sf_dir).withColumn("w", F.lit(1).cast("bigint"))
    return rounded(neighbors.eps_join(points, 0.3, 2).select("a", "b", "dist"))


LONG = """SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"""


@query(
    "embedding_pairs", "J7",
    f"""WITH long AS ({LONG}) SELECT p.id AS a, q.id AS b, round(sum(abs(p.x - q.x)), 6) AS dist FROM long p JOIN long q
        ON p.d = q.d AND p.id < q.id GROUP BY 1, 2 HAVING sum(abs(p.x - q.x)) <= 8.0""",
)
def embedding_pairs(spark, sf_dir):
    points = embedding_points(spark, sf_dir).withColumn("w", F.lit(1).cast("bigint"))
    return rounded(neighbors.eps_join(points, 8.0, WIDTH).select("a", "b", "dist"))


@query(
    "nearest_embeddings", "J8",
    f"""WITH long AS ({LONG}), near AS (SELECT p.id, q.id AS neighbor, sqrt(sum((p.x - q.x) * (p.x - q.x))) AS dist
        FROM long p JOIN long q ON p.d = q.d AND p.id <> q.id GROUP BY 1, 2)
        SELECT id, neighbor, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, neighbor) AS INTEGER) AS rank
        FROM near QUALIFY rank <= 10""",
)
def nearest_embeddings(spark, sf_dir):
    return rounded(neighbors.knn_join(embedding_points(spark, sf_dir).select("id", "x"), 10, WIDTH))


@query(
    "nearest_authors", "J8",
    sql(
        """SELECT id, neighbor, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, neighbor) AS INTEGER) AS rank
        FROM near QUALIFY rank <= 5""",
        "commits", points=f"SELECT CAST(substr(author, 4) AS BIGINT) AS id, ns AS x, nm AS y FROM ({PAIR_MEANS})",
        near="""SELECT p.id, q.id AS neighbor, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist
            FROM points p JOIN points q ON p.id <> q.id""",
    ),
)
def nearest_authors(spark, sf_dir):
    means = feature_ops.author_commit_means(commits(spark, sf_dir), places=PLACES)
    points = vectors.to_points(means, "author", PAIR).withColumn("id", F.expr("cast(substr(id, 4) as bigint)"))
    return rounded(neighbors.knn_join(land(points, "points"), 5, 2))


# --- density ---------------------------------------------------------------------------------

EPS, LEAST = 0.15, 10
DENSITY = {
    **AUTHOR_POINTS,
    "near": NEAR.format(EPS),
    "sides": "SELECT a AS id, b AS other FROM near UNION ALL SELECT b, a FROM near UNION ALL SELECT id, id FROM points",
    "core": f"SELECT id FROM sides GROUP BY id HAVING count(*) >= {LEAST}",
}


@query(
    "core_flags", "M2",
    sql("SELECT id, id IN (SELECT id FROM core) AS is_core FROM points", "commits", **DENSITY),
)
def core_flags(spark, sf_dir):
    return density.core_flags(author_points(spark, sf_dir), EPS, LEAST, 2)


@query(
    "density_clusters", "M2",
    sql(
        """SELECT points.id, coalesce(min(label), -1) AS cluster FROM points LEFT JOIN
        (SELECT sides.id, label FROM sides JOIN labels ON sides.other = labels.id) near ON near.id = points.id
        WHERE points.id NOT IN (SELECT id FROM core) GROUP BY points.id
        UNION ALL SELECT id, label FROM labels""",
        "commits", **DENSITY,
        links="SELECT sides.id, other FROM sides JOIN core ON core.id = sides.id WHERE other IN (SELECT id FROM core)",
        reach="SELECT id AS root, id AS node FROM core UNION SELECT root, other FROM reach JOIN links ON links.id = reach.node",
        labels="SELECT node AS id, min(root) AS label FROM reach GROUP BY node",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def density_clusters(spark, sf_dir):
    return density.density_cluster(author_points(spark, sf_dir), EPS, LEAST, 2)


GRID_EPS = ", ".join(f"{e!r}::DOUBLE" for e in density.EPS_VALUES)
GRID_LEAST = ", ".join(map(str, density.MIN_SAMPLE_VALUES))


@query(
    "density_core_counts", "M3",
    sql(
        """SELECT eps, min_samples, count(*) FILTER (n >= min_samples) AS cores FROM degrees,
        least GROUP BY eps, min_samples""",
        "commits", **AUTHOR_POINTS,
        radii=f"SELECT unnest([{GRID_EPS}]) AS eps",
        least=f"SELECT unnest([{GRID_LEAST}]) AS min_samples",
        near=NEAR.format("0.96"),
        sides="SELECT a AS id, dist FROM near UNION ALL SELECT b, dist FROM near UNION ALL SELECT id, 0.0 FROM points",
        degrees="SELECT eps, id, count(*) FILTER (dist <= eps) AS n FROM sides, radii GROUP BY eps, id",
    ),
)
def density_core_counts(spark, sf_dir):
    model = density.DensityModel(author_points(spark, sf_dir), 2, density.EPS_VALUES, density.MIN_SAMPLE_VALUES)
    return model.core_counts()


def density_scores(points: DataFrame, width: int) -> DataFrame:
    model = density.DensityModel(points, width, density.EPS_VALUES, density.MIN_SAMPLE_VALUES)
    labels = land(model.weighted_clusters(), "labels")
    return model.named(silhouette.silhouette_l1(labels))


@query("density_grid", "M3 M5")
def density_grid(spark, sf_dir):
    return density_scores(author_points(spark, sf_dir), 2)


@query("best_density", "M3 W3")
def best_density(spark, sf_dir):
    return silhouette.best_config(density_scores(author_points(spark, sf_dir), 2), ["eps", "min_samples"])


# --- quality ---------------------------------------------------------------------------------


@query(
    "silhouette", "M5",
    f"""WITH long AS ({LONG}), pair AS (SELECT p.id, p.label, q.label AS other, q.id AS oid, sum(abs(p.x - q.x)) AS dist
            FROM long p JOIN long q ON p.d = q.d GROUP BY 1, 2, 3, 4),
        mean AS (SELECT id, label, other, sum(dist) AS total, count(*) AS n FROM pair GROUP BY 1, 2, 3),
        ab AS (SELECT id, max(CASE WHEN label = other THEN n END) AS own,
            max(CASE WHEN label = other AND n > 1 THEN total / (n - 1) END) AS a,
            min(CASE WHEN label <> other THEN total / n END) AS b FROM mean GROUP BY id)
        SELECT 0 AS fit, (SELECT count(DISTINCT label) FROM embeddings) AS clusters,
            round(avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM ab""",
)
def silhouette_of_labels(spark, sf_dir):
    labels = embedding_points(spark, sf_dir).select(
        F.lit(0).alias("fit"), "id", F.col("label").alias("cluster"), "x", F.lit(1).cast("bigint").alias("w")
    )
    return rounded(silhouette.silhouette_l1(labels))


AVERAGES = ", ".join(f"round(avg(e[{i + 1}]), 6) AS f{i}" for i in range(WIDTH))


@query(
    "cluster_profile", "A16",
    f"SELECT label AS cluster, {AVERAGES} FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) GROUP BY label",
)
def cluster_profile(spark, sf_dir):
    names = [f"f{i}" for i in range(WIDTH)]
    wide = embedding_points(spark, sf_dir).select(
        F.col("label").alias("cluster"), *[F.col("x")[i].alias(n) for i, n in enumerate(names)]
    )
    return rounded(vectors.cluster_profile(wide, names))


SCORE = "round(avg(value), 2)"


@query(
    "best_config", "W3",
    """SELECT eps, min_samples, silhouette FROM (SELECT CAST(user_id AS DOUBLE) AS eps, event_type AS min_samples,
        CAST(count(*) FILTER (value > 50) AS DOUBLE) / count(*) AS silhouette FROM events GROUP BY ALL)
        WHERE silhouette > -1 ORDER BY silhouette DESC, eps, min_samples LIMIT 1""",
)
def best_config(spark, sf_dir):
    scores = table(spark, sf_dir, "events").groupBy(
        F.col("user_id").cast("double").alias("eps"), F.col("event_type").alias("min_samples")
    ).agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("silhouette"))
    return silhouette.best_config(scores, ["eps", "min_samples"])


# --- spectral, projection, report ------------------------------------------------------------


@query("spectral_clusters", "M4")
def spectral_clusters(spark, sf_dir):
    points = embedding_points(spark, sf_dir).select("id", "x")
    graph = land(spectral.affinity_graph(points, WIDTH), "graph")
    return spectral.spectral_cluster(points, graph, 10)


@query("spectral_grid", "M6 W3")
def spectral_grid(spark, sf_dir):
    """Silhouette of each of the 33 numbers of clusters."""
    points = embedding_points(spark, sf_dir).select("id", "x")
    labels = spectral.spectral_grid(points, WIDTH)
    return silhouette.silhouette_l1(land(labels, "labels"))


@query("projection", "M7")
def projection(spark, sf_dir):
    return vectors.project_2d(embedding_points(spark, sf_dir).select("id", "x"))
