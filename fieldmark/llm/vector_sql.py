"""SQL twins of the vector codes and the hard negatives, in whole numbers throughout."""

from __future__ import annotations


def _whole(scale: int, where: str = "true") -> str:
    """Rows with usable vectors; x holds floor(scale * component)."""
    return f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda v: floor({scale} * CAST(v AS DOUBLE))) AS x
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND {where})"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    steps = [
        _whole(scale),
        f"""parts AS (SELECT rid, vec_id, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) AS y FROM kept, range({parts}) AS t(p))""",
        f"""c0 AS (SELECT p, e, y AS c FROM (SELECT p, y, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {entries})""",
    ]
    for t in range(rounds + 1):
        distance = "list_inner_product(y, y) - 2 * list_inner_product(y, c) + list_inner_product(c, c)"
        steps.append(
            f"""b{t} AS MATERIALIZED (SELECT rid, p, min(CAST({distance} AS BIGINT) * {entries} + e) AS m FROM parts JOIN c{t} USING (p) GROUP BY rid, p)"""
        )
        steps.append(f"""a{t} AS (SELECT rid, p, m % {entries} AS e, m // {entries} AS d FROM b{t})""")
        if t == rounds:
            break
        steps.append(
            f"""s{t} AS (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM
              (SELECT p, e, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM parts JOIN a{t} USING (rid, p)) GROUP BY p, e, i)"""
        )
        steps.append(f"""m{t} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s{t} GROUP BY p, e)""")
        steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (p, e))""")
    steps.append(
        f"""coded AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)"""
    )
    steps.append(
        f"""book AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
          FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c{rounds}))"""
    )
    return (
        "WITH " + ",\n".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), book"
    )


def negatives_sql(scale: int = 256) -> str:
    return f"""WITH {_whole(scale, "label IS NOT NULL")},
      v AS (SELECT rid, vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l FROM kept),
      scored AS MATERIALIZED (SELECT a.rid AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.l = b.l AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
        FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
      pos AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k
        FROM scored WHERE same QUALIFY k <= 5),
      neg AS (SELECT a, k, pos.anchor_id, positive_id, positive_score, n.id AS negative_id, n.score AS negative_score,
          row_number() OVER (PARTITION BY a, k ORDER BY n.score DESC, n.id) AS r
        FROM pos JOIN scored n USING (a) WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
      SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM neg WHERE r <= 3"""
