"""SQL of boosting, written out level by level over (task, case) rows."""

from __future__ import annotations

from collections.abc import Sequence

from lociq.operators.boost import DEFAULTS
from lociq.queries.sql import bits, draw


def settings_sql(points: Sequence[dict], tasks_per_point: int) -> str:
    """SELECT of one row of settings for each task; task ids run from 1, ``tasks_per_point`` for each point. A text is an expression."""
    names = [n for n in DEFAULTS if n != "lambda"]
    text = lambda v: v if isinstance(v, str) else str(float(v))
    rows = ", ".join(f"({k}, {', '.join(text(p.get(n, DEFAULTS[n])) for n in [*names, 'lambda'])}, {p.get('bandwidth', 'NULL')})" for k, p in enumerate(points))
    columns = ", ".join(f"{c}::DOUBLE AS {c}" for c in [*names, "l2", "bandwidth"])
    return f"SELECT CAST(k * {tasks_per_point} + i AS INTEGER) AS task_id, {columns} FROM (VALUES {rows}) v(k, {', '.join(names)}, l2, bandwidth), (SELECT unnest(range(1, {tasks_per_point + 1})) AS i)"


def boost_sql(rows: str, settings: str, width: int, rounds: int, depth: int, name: str = "b", seed: int = 1337) -> str:
    """CTEs ``<name>_scores`` (task_id, case_id, locus_id, role, label, margin) and ``<name>_splits``.

    ``rows`` has task_id, case_id, locus_id, role, label and bins (-1 for missing), ``settings`` one row for each
    task. Tasks with a bandwidth take the within-locus pair sums of their training rows as gradients.
    """
    out = [f"{name}_p0 AS MATERIALIZED (SELECT r.*, ln(base_score / (1 - base_score)) AS pred FROM {rows} r JOIN {settings} USING (task_id))"]
    splits = []
    for t in range(1, rounds + 1):
        p, g, k = f"{name}_p{t - 1}", f"{name}_g{t}", f"{name}_k{t}"
        feature_bits = bits(f"'{seed}|feature|' || task_id || '|{t}|' || feature")
        out.append(
            f"""{k} AS MATERIALIZED (SELECT task_id, feature FROM (
              SELECT task_id, feature, row_number() OVER (PARTITION BY task_id ORDER BY {feature_bits}, feature) AS i, greatest(1, floor(colsample_bytree * {width} + 0.5)) AS m
              FROM {settings}, (SELECT unnest(range(0, {width})) AS feature)) WHERE i <= m)"""
        )
        out.append(
            f"""{g}_pairs AS MATERIALIZED (
              SELECT a.task_id, a.case_id, CASE WHEN any_value(a.label) = 1 THEN -1 ELSE 1 END * sum(k) AS g, 2 / pow(any_value(b), 2) * sum((d + b) * k) AS h
              FROM (SELECT a.task_id, a.case_id, a.label, bandwidth AS b, abs(a.pred - o.pred) AS d, exp(-pow(a.pred - o.pred, 2) / pow(bandwidth, 2)) / (bandwidth * sqrt(pi())) AS k
                FROM {p} a JOIN {p} o ON a.task_id = o.task_id AND a.locus_id = o.locus_id AND a.label <> o.label AND a.role = 'train' AND o.role = 'train'
                JOIN {settings} s ON s.task_id = a.task_id AND bandwidth IS NOT NULL) a GROUP BY a.task_id, a.case_id)"""
        )
        out.append(
            f"""{g} AS MATERIALIZED (
              SELECT r.task_id, r.case_id, bins, 1::BIGINT AS node, max_depth, role = 'train' AND nrounds >= {t} AND {draw(f"'{seed}|' || r.task_id || '|{t}|' || r.case_id")} < subsample AS used,
                coalesce(q.g, w * (1 / (1 + exp(-pred)) - label)) AS g, coalesce(q.h, w * (1 / (1 + exp(-pred))) * (1 - 1 / (1 + exp(-pred)))) AS h
              FROM (SELECT r.*, CASE WHEN label = 1 AND bandwidth IS NULL THEN scale_pos_weight ELSE 1.0 END AS w, nrounds, subsample, max_depth FROM {p} r JOIN {settings} USING (task_id)) r
              LEFT JOIN {g}_pairs q ON q.task_id = r.task_id AND q.case_id = r.case_id)"""
        )
        nodes = g
        for level in range(1, depth + 1):
            s, nxt = f"{name}_s{t}_{level}", f"{name}_n{t}_{level}"
            term = "pow(greatest(abs({g}) - alpha, 0), 2) / ({h} + l2)"
            gain = f"({term.format(g='gl', h='hl')} + {term.format(g='(gt - gl)', h='(ht - hl)')} - {term.format(g='gt', h='ht')}) / 2 - gamma"
            out.append(
                f"""{s} AS MATERIALIZED (
              WITH cells AS (SELECT task_id, node, feature, bins[feature + 1] AS bin, sum(g) AS g, sum(h) AS h FROM {nodes} JOIN {k} USING (task_id)
                WHERE used AND node >= {2 ** (level - 1)} AND max_depth >= {level} GROUP BY ALL),
              sums AS (SELECT *, sum(g) OVER up AS ga, sum(h) OVER up AS ha, sum(g) OVER f AS gt, sum(h) OVER f AS ht, coalesce(sum(g) FILTER (bin = -1) OVER f, 0) AS gm, coalesce(sum(h) FILTER (bin = -1) OVER f, 0) AS hm
                FROM cells WINDOW f AS (PARTITION BY task_id, node, feature), up AS (PARTITION BY task_id, node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
              sides AS (SELECT task_id, node, feature, bin, gt, ht, true AS missing_left, ga AS gl, ha AS hl FROM sums
                UNION ALL SELECT task_id, node, feature, bin, gt, ht, false, ga - gm, ha - hm FROM sums)
              SELECT task_id, {t} AS tree, node, feature, bin, missing_left, {gain} AS gain, ht AS cover
              FROM sides JOIN {settings} USING (task_id) WHERE hl >= min_child_weight AND ht - hl >= min_child_weight AND hl + l2 > 0 AND ht - hl + l2 > 0 AND round({gain}, 9) > 0
              QUALIFY row_number() OVER (PARTITION BY task_id, node ORDER BY round(gain, 9) DESC, feature, bin, missing_left DESC) = 1)"""
            )
            right = f"CASE WHEN n.bins[s.feature + 1] = -1 THEN NOT missing_left ELSE n.bins[s.feature + 1] > s.bin END"
            out.append(
                f"""{nxt} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN s.feature IS NULL THEN n.node ELSE 2 * n.node + CAST({right} AS BIGINT) END AS node)
              FROM {nodes} n LEFT JOIN {s} s ON s.task_id = n.task_id AND s.node = n.node)"""
            )
            splits.append(s)
            nodes = nxt
        out.append(
            f"""{name}_w{t} AS MATERIALIZED (SELECT task_id, node, CASE WHEN sum(h) + any_value(l2) > 0 THEN -any_value(eta) * sign(sum(g)) * greatest(abs(sum(g)) - any_value(alpha), 0) / (sum(h) + any_value(l2)) ELSE 0 END AS weight
              FROM {nodes} JOIN {settings} USING (task_id) WHERE used GROUP BY task_id, node)"""
        )
        out.append(
            f"""{name}_p{t} AS MATERIALIZED (SELECT r.* REPLACE (r.pred + coalesce(weight, 0) AS pred) FROM {p} r
              JOIN {nodes} n ON n.task_id = r.task_id AND n.case_id = r.case_id LEFT JOIN {name}_w{t} w ON w.task_id = n.task_id AND w.node = n.node)"""
        )
    out.append(f"{name}_scores AS MATERIALIZED (SELECT task_id, case_id, locus_id, role, label, pred AS margin, 1 / (1 + exp(-pred)) AS score FROM {name}_p{rounds})")
    out.append(f"{name}_splits AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {s}' for s in splits)})")
    return ",\n".join(out)


def bins_sql(values: str, cuts: str) -> str:
    """The bins of a list of values, given a list of lists of cut points."""
    return f"list_transform(range(1, len({values}) + 1), lambda f: CASE WHEN {values}[f] IS NULL OR isnan({values}[f]) THEN -1 ELSE len(list_filter({cuts}[f], lambda c: c < {values}[f])) END)"


def cuts_sql(rows: str, width: int, n_bins: int, values: str = "x", name: str = "cuts") -> str:
    """CTEs ending in ``name`` (cuts, one row): the distinct values at rank ceil(i n / n_bins) of each feature."""
    return f"""{name}_v AS (SELECT f, v FROM (SELECT unnest(range(1, {width + 1})) AS f, unnest({values}) AS v FROM {rows}) WHERE v IS NOT NULL AND NOT isnan(v)),
    {name}_r AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS r, count(*) OVER (PARTITION BY f) AS n FROM {name}_v),
    {name}_q AS (SELECT f, i, v FROM {name}_r, (SELECT unnest(range(1, {n_bins})) AS i) WHERE r = (i * n + {n_bins - 1}) // {n_bins}),
    {name}_l AS (SELECT f, list(DISTINCT v ORDER BY v) AS c FROM {name}_q GROUP BY f),
    {name} AS MATERIALIZED (SELECT list(coalesce(c, []::DOUBLE[]) ORDER BY f) AS cuts FROM (SELECT unnest(range(1, {width + 1})) AS f) LEFT JOIN {name}_l USING (f))"""
