"""Comparison SQL of one-to-one matching and suppression, by recursion over small parts.

Nothing here is used by the operators. Optimal matching is solved by dynamic programming
over the labels that a part's songs have taken so far, greedy matching and suppression by
going through the rows of a part in their order.
"""

from __future__ import annotations


def sql_parts(edges: str) -> str:
    """CTEs ``sure`` and ``hp`` over edges (g, o, d, l, iou): edges alone at both ends, and the others by connected part.

    ``g`` is the key, ``d`` and ``l`` name detection and label, ``o`` orders detections.
    """
    return f"""al AS (SELECT *, count(*) OVER (PARTITION BY g, d) AS x, count(*) OVER (PARTITION BY g, l) AS y FROM {edges}),
sure AS (SELECT g, d, l, iou FROM al WHERE x = 1 AND y = 1),
h AS (SELECT g, o, d, l, iou FROM al WHERE NOT (x = 1 AND y = 1)),
ll AS (SELECT DISTINCT a.g, a.l AS l1, b.l AS l2 FROM h a JOIN h b ON a.g = b.g AND a.d = b.d),
reach AS (SELECT DISTINCT g, l AS l1, l AS l2 FROM h UNION SELECT r.g, r.l1, x.l2 FROM reach r JOIN ll x ON r.g = x.g AND r.l2 = x.l1),
comp AS (SELECT g, l1 AS l, min(l2) AS part FROM reach GROUP BY ALL),
hp AS (SELECT h.g, part, h.d, h.l, h.iou, dense_rank() OVER (PARTITION BY h.g, part ORDER BY h.o, h.d) AS i, dense_rank() OVER (PARTITION BY h.g, part ORDER BY h.l) - 1 AS bit
  FROM h JOIN comp ON comp.g = h.g AND comp.l = h.l)"""


def sql_optimal(edges: str) -> str:
    """CTEs up to ``mt`` (g, d, l, iou): most pairs, then most IoU. Needs WITH RECURSIVE."""
    return f"""{sql_parts(edges)},
opt AS (SELECT g, part, i, bit, iou, [struct_pack(d := d, l := l, iou := iou)] AS pair FROM hp
  UNION ALL SELECT DISTINCT g, part, i, NULL::BIGINT, 0.0::DOUBLE, [] FROM hp),
walk AS (SELECT DISTINCT g, part, 0::BIGINT AS i, 0::HUGEINT AS mask, 0.0::DOUBLE AS s, list_slice(pair, 2, 1) AS pairs FROM opt WHERE i = 1 AND bit IS NOT NULL
  UNION ALL SELECT g, part, i, mask, max(s) AS s, arg_max(pairs, s) AS pairs FROM (
    SELECT w.g, w.part, o.i, CASE WHEN o.bit IS NULL THEN w.mask ELSE w.mask + (1::HUGEINT << o.bit::INTEGER) END AS mask, w.s + o.iou AS s, list_concat(w.pairs, o.pair) AS pairs
    FROM walk w JOIN opt o ON o.g = w.g AND o.part = w.part AND o.i = w.i + 1
    WHERE o.bit IS NULL OR (w.mask >> o.bit::INTEGER) % 2 = 0) GROUP BY g, part, i, mask),
ends AS (SELECT g, part, max(i) AS n FROM hp GROUP BY ALL),
best AS (SELECT w.g, w.part, arg_max(pairs, (len(pairs), s)) AS pairs FROM walk w JOIN ends e ON e.g = w.g AND e.part = w.part AND e.n = w.i GROUP BY w.g, w.part),
mt AS (SELECT g, d, l, iou FROM sure UNION ALL SELECT g, p.d, p.l, p.iou FROM (SELECT g, unnest(pairs) AS p FROM best))"""


def sql_greedy(edges: str) -> str:
    """CTEs up to ``mt`` (g, d, l, iou): every detection in its order takes the best label left. Needs WITH RECURSIVE."""
    return f"""{sql_parts(edges)},
ends AS (SELECT g, part, max(i) AS n FROM hp GROUP BY ALL),
walk AS (SELECT g, part, n, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS l FROM ends
  UNION ALL SELECT g, part, n, i + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (
    SELECT w.g, w.part, w.n, w.i, w.used, arg_max(o.l, (o.iou, -o.l)) AS pick
    FROM walk w LEFT JOIN hp o ON o.g = w.g AND o.part = w.part AND o.i = w.i + 1 AND NOT list_contains(w.used, o.l)
    WHERE w.i < w.n GROUP BY w.g, w.part, w.n, w.i, w.used)),
mt AS (SELECT g, d, l, iou FROM sure UNION ALL SELECT w.g, o.d, o.l, o.iou FROM walk w JOIN hp o ON o.g = w.g AND o.part = w.part AND o.i = w.i AND o.l = w.l)"""


def sql_suppressed(rows: str, iou: float) -> str:
    """CTEs up to ``left_`` (det_id): rows (det_id, k, s, e, c) of key k left by suppression in time. Needs WITH RECURSIVE."""
    return f"""isl AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {rows}),
grp AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e, det_id ROWS UNBOUNDED PRECEDING) AS g FROM isl),
rk AS (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY c DESC, det_id) AS i, count(*) OVER (PARTITION BY k, g) AS n FROM grp),
go AS (SELECT k, g, n, i, det_id, true AS ok, [struct_pack(s := s, e := e)] AS kept FROM rk WHERE i = 1
  UNION ALL SELECT k, g, n, i, det_id, ok, CASE WHEN ok THEN list_append(kept, struct_pack(s := s, e := e)) ELSE kept END FROM (
    SELECT r.k, r.g, r.n, r.i, r.det_id, r.s, r.e, w.kept, len(list_filter(w.kept, lambda b: least(b.e, r.e) - greatest(b.s, r.s) > 0 AND
      least(b.e, r.e) - greatest(b.s, r.s) > {iou}::DOUBLE * ((b.e - b.s) + (r.e - r.s) - (least(b.e, r.e) - greatest(b.s, r.s))))) = 0 AS ok
    FROM go w JOIN rk r ON r.k = w.k AND r.g = w.g AND r.i = w.i + 1)),
left_ AS (SELECT det_id FROM go WHERE ok)"""
