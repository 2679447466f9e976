"""The trees of ``tracemill.operators.trees`` in SQL, one block of CTEs per level."""

from __future__ import annotations

from tracemill.workload.tables import SCORES_SQL


def _ranked(label: str, name: str, start: int) -> str:
    return f"row_number() OVER (PARTITION BY {label} ORDER BY md5('42|' || {name}), {name}) + {start - 1}"


def half_sql(source: str) -> str:
    """Training and test half of each class of ``source (trace_id, label)``."""
    return f"""
  SELECT trace_id, label, CASE WHEN {_ranked('label', 'trace_id', 1)} <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.5))
    THEN 'train' ELSE 'test' END AS split FROM {source}"""


# Traces with their class and half, and what each reaches: pattern and prefix length.
LABELLED_SQL = (
    SCORES_SQL.rstrip()
    + f""", halves AS ({half_sql("(SELECT trace_id, 'g' || grp AS label FROM seq) s")}),
feats AS MATERIALIZED (SELECT trace_id, pattern_id, unnest(range(1, score + 1)) AS k FROM scores)"""
)

TRAINED = ", nd0 AS (SELECT trace_id, label, 0 AS tree, 1::BIGINT AS node FROM halves WHERE split = 'train')"

FOLDS = 3
# Each row learns the trees of the folds it is not in, and the tree of all rows.
FOLDED = f""", dealt AS (
  SELECT trace_id, label, (coalesce(first, 0) + {_ranked('label', 'trace_id', 0)}) % {FOLDS} AS fold
  FROM halves JOIN (
    SELECT label, sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first
    FROM (SELECT label, count(*) AS n FROM halves WHERE split = 'train' GROUP BY label) c) f USING (label) WHERE split = 'train'),
nd0 AS (SELECT trace_id, label, tree, 1::BIGINT AS node FROM dealt, range({FOLDS + 1}) t(tree) WHERE tree <> fold)"""


def tree_sql(depth: int) -> str:
    """CTEs from ``nd0 (trace_id, label, tree, node)`` to ``nodes (tree, node, depth, pattern_id, k, cls, n)``."""
    out = []
    for d in range(depth):
        out.append(
            f"""tot{d} AS MATERIALIZED (SELECT tree, node, label, count(*) AS t FROM nd{d} GROUP BY ALL),
sum{d} AS MATERIALIZED (SELECT tree, node, sum(t)::HUGEINT AS n, sum(t * t)::HUGEINT AS sq FROM tot{d} GROUP BY ALL),
side{d} AS (
  SELECT c.tree, c.node, pattern_id, k, sum(c.n)::HUGEINT AS r, sum(c.n * c.n)::HUGEINT AS a, sum(c.n * t)::HUGEINT AS x
  FROM (SELECT tree, node, pattern_id, k, label, count(*) AS n FROM nd{d} JOIN feats USING (trace_id) GROUP BY ALL) c
  JOIN tot{d} USING (tree, node, label) GROUP BY ALL),
best{d} AS MATERIALIZED (
  SELECT tree, node, pattern_id, k FROM (
    SELECT *, a * (n - r) + (sq - 2 * x + a) * r AS top FROM side{d} JOIN sum{d} USING (tree, node) WHERE r < n) s
  WHERE top * n > sq * (n - r) * r
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY top * 1000 // ((n - r) * r) DESC, pattern_id, k) = 1),
nd{d + 1} AS MATERIALIZED (
  SELECT nd{d}.trace_id, label, tree, 2 * node + (f.k IS NOT NULL)::INT AS node
  FROM nd{d} JOIN best{d} USING (tree, node)
  LEFT JOIN feats f ON f.trace_id = nd{d}.trace_id AND f.pattern_id = best{d}.pattern_id AND f.k = best{d}.k)"""
        )
    levels = " UNION ALL ".join(
        f"""SELECT m.tree, m.node, {d} AS depth, {f'b.pattern_id, b.k' if d < depth else 'NULL::BIGINT, NULL::BIGINT'}, cls, n
  FROM (SELECT tree, node, (list(label ORDER BY t DESC, label))[1] AS cls, sum(t) AS n FROM (
    SELECT tree, node, label, count(*) AS t FROM nd{d} GROUP BY ALL) c GROUP BY ALL) m
  {f'LEFT JOIN best{d} b ON b.tree = m.tree AND b.node = m.node' if d < depth else ''}"""
        for d in range(depth + 1)
    )
    out.append(f"nodes(tree, node, depth, pattern_id, k, cls, n) AS MATERIALIZED ({levels})")
    return ", " + ",\n".join(out)


# Leaves of one tree with the conditions on their way; a tree of one leaf has a rule without conditions.
RULES = """, leaves AS (SELECT * FROM nodes WHERE pattern_id IS NULL),
conditions AS (
  SELECT l.cls, l.node AS rule_id, p.pattern_id, p.k, CASE WHEN (l.node >> (up - 1)) % 2 = 1 THEN '>' ELSE '<=' END AS op, p.k - 0.5 AS value
  FROM (SELECT *, unnest(range(1, depth + 1)) AS up FROM leaves) l JOIN nodes p ON p.tree = l.tree AND p.node = l.node >> up)"""

# The rules that hold for each trace.
HOLDS = """, holds AS (
  SELECT seq.trace_id, l.cls, l.node AS rule_id FROM seq, leaves l
  WHERE NOT EXISTS (
    FROM conditions c LEFT JOIN scores s ON s.trace_id = seq.trace_id AND s.pattern_id = c.pattern_id
    WHERE c.rule_id = l.node AND (coalesce(s.score, 0) > c.value) <> (c.op = '>')))"""


def walked(source: str, depth: int, columns: str) -> str:
    """CTE ``said``: the class of each row of ``source (trace_id, tree, ...)`` at every depth up to ``depth``."""
    own = ", ".join(f"w.{c.strip()}" for c in columns.split(","))
    return f""", said AS (
  SELECT {columns}, depth, cls FROM (
    WITH RECURSIVE w AS (
      SELECT {columns}, s.tree, 1::BIGINT AS node FROM {source} s
      UNION ALL
      SELECT {own}, w.tree, 2 * w.node + (f.k IS NOT NULL)::INT
      FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.pattern_id IS NOT NULL
      LEFT JOIN feats f ON f.trace_id = w.trace_id AND f.pattern_id = n.pattern_id AND f.k = n.k)
    SELECT w.*, n.depth, n.cls FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node) x)"""
