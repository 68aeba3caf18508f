"""Queries of the operators on ``pages`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import centroids, html_extract, topk, url_filter
from lexispark.llm.common import read_table

#: The contract's rules.
URL_RULES = [
    url_filter.rule("block", "com/en/"),
    url_filter.rule("allow", "example.com/en/7"),
    url_filter.rule("allow", "net/de/"),
    url_filter.rule("block", "example.net/de/8"),
    url_filter.rule("block", "org/es/"),
]


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every 20th vector with all others."""
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), 20)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.fit_from_table(pages))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL by the rules, else by the character models."""
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the integer vectors after three rounds, with exact distances."""
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_topk": op2_topk, "op4_html_extract": op4_html_extract, "op10_url_filter": op10_url_filter, "op12_centroids": op12_centroids}


def _cluster_sql(rounds: int = 3) -> str:
    """Rounds of assignment and floored means, unrolled; components are (id, i, x) rows' arrays."""
    parts = [
        """v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (
                SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT 16))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
            SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT v.n, k.c, list_sum(list_transform(list_zip(v.v, k.v), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS d FROM v, c{r} k)
            GROUP BY n)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (
                SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS v FROM (
                    SELECT a.c, i, CAST(sum(v.v[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS k FROM a{r} a JOIN v USING (n), range(1, 65) t(i) GROUP BY a.c, i)
                GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{r} k LEFT JOIN m{r} m USING (c))")
    return f"""
        WITH {", ".join(parts)},
        t AS (SELECT a.n, a.c, a.d, sum(a.d) OVER (PARTITION BY a.c) AS within, sum(a.d) OVER () AS total FROM a{rounds} a)
        SELECT v.vec_id, t.c AS cluster, CAST(t.d AS BIGINT) AS distance, CAST(t.within AS BIGINT) AS cluster_inertia, CAST(t.total AS BIGINT) AS inertia,
            sha256(array_to_string(k.v, ',')) AS centroid_sha256
        FROM t JOIN v USING (n) JOIN c{rounds} k ON k.c = t.c"""

ORACLE = {
    "op2_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op12_centroids": _cluster_sql(),
}
