"""SQL building blocks shared by the query definitions (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence

N_REP, N_FOLD, SEED = 2, 5, 1337


def r6(expr: str, name: str) -> str:
    """A double rounded like the Spark side."""
    return f"CAST(round({expr}, 6) + 0.0 AS DOUBLE) AS {name}"


def bits(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def draw(text: str) -> str:
    return f"({bits(text)} / 1152921504606846976.0)"


CASES = """
cases AS (
  SELECT event_id AS case_id, CAST(user_id AS VARCHAR) AS chrom, epoch_us(ts) // 1000000 AS coord,
         CAST(event_type = 'purchase' AS INTEGER) AS label, value AS score
  FROM events)"""

LOCATED = CASES + """,
gaps AS (
  SELECT *, CASE WHEN coord - lag(coord) OVER (PARTITION BY chrom ORDER BY coord) <= 21600 THEN 0 ELSE 1 END AS brk
  FROM cases),
located AS (
  SELECT case_id, chrom, coord, label, score,
         chrom || '_' || CAST(sum(brk) OVER (PARTITION BY chrom ORDER BY coord RANGE UNBOUNDED PRECEDING) AS BIGINT) AS locus_id
  FROM gaps)"""

KEPT = LOCATED + """,
kept AS (
  SELECT * FROM located
  WHERE locus_id IN (SELECT locus_id FROM located GROUP BY locus_id HAVING sum(label) > 0))"""

REPS = f", reps AS (SELECT CAST(unnest(range(1, {N_REP + 1})) AS INTEGER) AS rep)"
FOLD_NOS = f", fold_nos AS (SELECT CAST(unnest(range(1, {N_FOLD + 1})) AS INTEGER) AS test_fold)"


def shuffled(by: str = "") -> str:
    """CTE ``folds``: plain folds of the kept cases, or folds within each value of ``by``."""
    part = f"rep, {by}" if by else "rep"
    d = draw(f"'{SEED}|' || rep || '|' || case_id")
    return f"""{KEPT}{REPS},
folds AS (
  SELECT case_id, rep, CAST((row_number() OVER (PARTITION BY {part} ORDER BY {d}, case_id) - 1) % {N_FOLD} + 1 AS INTEGER) AS fold
  FROM kept, reps)"""


SCORES = f""",
scores AS (
  SELECT 1 AS config_id, 'value' AS set_name, case_id, score FROM cases
  UNION ALL SELECT 2, 'negated', case_id, -score FROM cases
  UNION ALL SELECT 3, 'hashed', case_id, {draw("CAST(case_id AS VARCHAR)")} FROM cases)"""



def caps(n_fold: int) -> str:
    return f"""SELECT count(*) AS cases, CAST(sum(label) AS BIGINT) AS positives,
  CAST(ceil(1.5 * count(*) / {n_fold}) AS BIGINT) AS max_cases,
  CAST(ceil(1.5 * ceil(1.5 * count(*) / {n_fold}) * sum(label) / count(*)) AS BIGINT) AS max_positives FROM kept"""


CAPS = caps(N_FOLD)


def grouped(n_rep: int, n_fold: int) -> str:
    """CTEs ending in ``grouped``. Stands after WITH RECURSIVE: loci of every replication in their order, then one fold drawn at a time with two counters per fold as state."""
    zero = "[" + ", ".join(["0"] * n_fold) + "]::BIGINT[]"
    k = f"range(1, {n_fold + 1})"
    return f"""{KEPT}, reps AS (SELECT CAST(unnest(range(1, {n_rep + 1})) AS INTEGER) AS rep),
loci AS (SELECT locus_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM kept GROUP BY locus_id),
caps AS ({caps(n_fold)}),
ordered AS (
  SELECT rep, locus_id, n, p, row_number() OVER (
    PARTITION BY rep ORDER BY n DESC, p DESC, {draw(f"'{SEED}|' || rep || '|' || locus_id")}, locus_id) AS i
  FROM loci, reps),
queue AS (
  SELECT rep, list(n ORDER BY i) AS ns, list(p ORDER BY i) AS ps,
         list({draw(f"'{SEED}|' || rep || '|draw|' || i")} ORDER BY i) AS us, count(*) AS m,
         any_value(max_cases) AS mc, any_value(max_positives) AS mp
  FROM ordered, caps GROUP BY rep),
walk AS (
  SELECT rep, CAST(0 AS BIGINT) AS i, 0 AS fold, {zero} AS c, {zero} AS q FROM reps
  UNION ALL
  SELECT rep, i, CAST(fold AS INTEGER),
         list_transform({k}, lambda f: c[f] + CASE WHEN f = fold THEN n ELSE 0 END),
         list_transform({k}, lambda f: q[f] + CASE WHEN f = fold THEN p ELSE 0 END)
  FROM (
    SELECT *, 1 + len(list_filter({k}, lambda f: list_sum(w[1:f]) <= u * list_sum(w))) AS fold
    FROM (
      SELECT w0.rep, w0.i + 1 AS i, w0.c, w0.q, ns[w0.i + 1] AS n, ps[w0.i + 1] AS p, us[w0.i + 1] AS u,
             list_transform({k}, lambda f: CASE WHEN w0.c[f] + ns[w0.i + 1] <= mc AND w0.q[f] + ps[w0.i + 1] <= mp
               THEN (1 - w0.c[f] / mc) * (1 - w0.q[f] / mp) ELSE 0.0 END) AS w
      FROM walk w0 JOIN queue USING (rep) WHERE w0.i < m))),
grouped AS (
  SELECT k.case_id, k.label, o.locus_id, o.rep, w.fold
  FROM walk w JOIN ordered o ON o.rep = w.rep AND o.i = w.i JOIN kept k ON k.locus_id = o.locus_id)"""


GROUPED = grouped(N_REP, N_FOLD)


def _members(folds: str) -> str:
    """CTE ``members``: the kept cases in every (config, rep, test fold) with their role."""
    return f"""{folds}{FOLD_NOS}{SCORES},
members AS (
  SELECT s.config_id, f.rep, t.test_fold, CASE WHEN f.fold = t.test_fold THEN 'test' ELSE 'train' END AS role,
         k.case_id, k.locus_id, k.label, s.score
  FROM kept k JOIN folds f USING (case_id) JOIN scores s USING (case_id), fold_nos t)"""


PLAIN_MEMBERS = _members(shuffled())
# Stands after WITH RECURSIVE.
MEMBERS = _members(f"{GROUPED}, folds AS (SELECT case_id, rep, fold FROM grouped)")


def points(rel: str, keys: Sequence[str], name: str = "points") -> str:
    """CTE of thresholds: p, n at a score, tp, fp at or above it, totals pos, neg."""
    k = ", ".join(keys)
    return f"""
{name}_g AS (SELECT {k}, score, sum(label) AS p, sum(1 - label) AS n FROM {rel} GROUP BY {k}, score),
{name} AS (
  SELECT *, sum(p) OVER down AS tp, sum(n) OVER down AS fp, sum(p) OVER (PARTITION BY {k}) AS pos, sum(n) OVER (PARTITION BY {k}) AS neg
  FROM {name}_g WINDOW down AS (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


AUROC = "CASE WHEN max(pos) * max(neg) > 0 THEN sum(p * (neg - fp + n / 2.0)) / max(pos) / max(neg) END"
STEP = "CASE WHEN max(pos) > 0 THEN sum(p * tp / (tp + fp)) / max(pos) END"


def dg(name: str, keys: Sequence[str], out: str) -> str:
    """CTE of the interpolated area: every positive of a tie group is one step."""
    k = ", ".join(keys)
    return f"""
{out}_x AS (
  SELECT {k}, pos, tp - p AS tp0, fp - n AS fp0, p, n, unnest(range(1, CAST(p AS BIGINT) + 1)) AS x FROM {name} WHERE p > 0),
{out}_y AS (
  SELECT {k}, pos, (tp0 + x) / (tp0 + fp0 + x * (1 + n / p)) AS hi,
         CASE WHEN x = 1 AND tp0 + fp0 = 0 THEN p / (p + n) ELSE (tp0 + x - 1) / (tp0 + fp0 + (x - 1) * (1 + n / p)) END AS lo
  FROM (SELECT * REPLACE (tp0::DOUBLE AS tp0, fp0::DOUBLE AS fp0, p::DOUBLE AS p, n::DOUBLE AS n) FROM {out}_x)),
{out} AS (SELECT {k}, sum((hi + lo) / 2) / max(pos) AS aupvr_dg FROM {out}_y GROUP BY {k})"""


def ranks(rel: str, keys: Sequence[str], name: str) -> str:
    """CTE with both average ranks, straight from the definition: every positive against its locus."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""
{name}_r AS (
  SELECT {", ".join(f"a.{c}" for c in keys)}, a.case_id,
         1 + sum(CASE WHEN b.score > a.score THEN 1.0 WHEN b.score = a.score AND b.case_id <> a.case_id THEN 0.5 ELSE 0 END) AS r_all,
         1 + sum(CASE WHEN b.label = 1 THEN 0 WHEN b.score > a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0 END) AS r_neg
  FROM {rel} a JOIN {rel} b ON {on} AND a.locus_id = b.locus_id
  WHERE a.label = 1 GROUP BY ALL),
{name} AS (SELECT {k}, avg(r_all) AS avgrank_all, avg(r_neg) AS avgrank_neg FROM {name}_r GROUP BY {k})"""


TASK = ["config_id", "rep", "test_fold", "role"]
METRICS = ["auroc", "aupvr_step", "aupvr_dg", "avgrank_all", "avgrank_neg"]

# CTEs up to ``results``: one row per (config, rep, fold) with train and test metrics.
_picked = ", ".join(f"max(CASE WHEN role = '{r}' THEN {m} END) AS {r}_{m}" for r in ("train", "test") for m in METRICS)
# ``MEMBERS`` has recursion, so these stand after WITH RECURSIVE.
RESULTS = f"""{MEMBERS}, {points("members", TASK)}, {dg("points", TASK, "dg")}, {ranks("members", TASK, "rk")},
areas AS (SELECT {", ".join(TASK)}, {AUROC} AS auroc, {STEP} AS aupvr_step FROM points GROUP BY {", ".join(TASK)}),
by_role AS (SELECT * FROM areas LEFT JOIN dg USING ({", ".join(TASK)}) LEFT JOIN rk USING ({", ".join(TASK)})),
results AS (SELECT config_id, rep, test_fold AS fold, {_picked} FROM by_role GROUP BY config_id, rep, test_fold)"""

# The same for plain folds, areas only.
AREA_METRICS = [f"{r}_{m}" for r in ("train", "test") for m in METRICS[:3]]
_areas = ", ".join(f"max(CASE WHEN role = '{r}' THEN {m} END) AS {r}_{m}" for r in ("train", "test") for m in METRICS[:3])
PLAIN_AREAS = f"""{PLAIN_MEMBERS}, {points("members", TASK)}, {dg("points", TASK, "dg")},
areas AS (SELECT {", ".join(TASK)}, {AUROC} AS auroc, {STEP} AS aupvr_step FROM points GROUP BY {", ".join(TASK)}),
results AS (SELECT config_id, rep, test_fold AS fold, {_areas} FROM areas LEFT JOIN dg USING ({", ".join(TASK)}) GROUP BY config_id, rep, test_fold)"""

RESULT_METRICS = [f"{r}_{m}" for r in ("train", "test") for m in METRICS]
LONG = f"""{RESULTS},
long AS (SELECT * FROM results UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(RESULT_METRICS)})))"""
IS_AREA = "regexp_matches(metric, 'auroc|aupvr')"
LOGIT = "CASE WHEN {x} = 0 THEN '-inf'::DOUBLE WHEN {x} = 1 THEN 'inf'::DOUBLE ELSE ln({x} / (1 - {x})) END"


def logit(x: str) -> str:
    return LOGIT.format(x=x)


def inv_logit(x: str) -> str:
    """``exp`` of a large number is infinite, and 1 over it is 0."""
    return f"(1.0 / (1.0 + exp(-({x}))))"
