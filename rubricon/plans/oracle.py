"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark operators where a different formulation is
available (raw-row statistics instead of the contingency table, the matrix form
of QWK, global ``row_number`` instead of hash-bucket offsets, brute-force
decode distances), so agreement is evidence rather than repetition.  DuckDB
lambdas use the ``lambda x: ...`` form.
"""

from __future__ import annotations

# ------------------------------------------------------------------ fixtures as CTEs

ANS = """
ans_raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS BMH,
         CASE WHEN doc_id % 17 = 0 THEN NULL
              WHEN doc_id % 19 = 0 THEN '   '
              WHEN doc_id % 23 = 0 THEN ''
              ELSE text END AS text,
         lang
  FROM documents),
ans AS (SELECT BMH, text, lang FROM ans_raw WHERE text IS NOT NULL)"""

STORED = """
ans_raw AS (SELECT CAST(doc_id AS VARCHAR) AS BMH, text, lang FROM documents),
ans AS (SELECT BMH, text, lang FROM ans_raw WHERE text IS NOT NULL)"""

CAL = """
cal_parts AS (
  SELECT CAST(doc_id AS VARCHAR) AS BMH, quality + 0.5 * toxic AS ZZCJ FROM labels WHERE doc_id % 2 = 0
  UNION ALL BY NAME
  SELECT quality + 0.5 * toxic AS ZZCJ, CAST(doc_id AS VARCHAR) AS BMH FROM labels WHERE doc_id % 2 = 1),
cal AS (SELECT BMH, CAST(ZZCJ AS DOUBLE) AS label FROM cal_parts WHERE BMH IS NOT NULL AND ZZCJ IS NOT NULL)"""

RATE = """
rate AS (
  SELECT l_returnflag,
         CAST(greatest(1.0, least(50.0, l_quantity + round(l_tax * 100) - 4.0)) AS DOUBLE) AS pred,
         CAST(l_quantity AS DOUBLE) AS label
  FROM lineitem)"""

PROB = """
prob AS (
  SELECT e.vec_id, e.label AS label_idx, CAST(e.label AS DOUBLE) AS label, t.j,
         4.0 * sum(CAST(e.embedding[d.i + 1] AS DOUBLE)) AS logit,
         1.0 / (1.0 + exp(-4.0 * sum(CAST(e.embedding[d.i + 1] AS DOUBLE)))) AS p
  FROM embeddings e, range(9) t(j), range(64) d(i) WHERE d.i % 9 = t.j GROUP BY ALL)"""

TOK = """
tok AS (
  SELECT CAST(label AS BIGINT) AS seq_id,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS pos,
         embedding
  FROM embeddings),
tokm AS (
  SELECT seq_id, pos, embedding,
         CASE WHEN seq_id = 9 THEN 0 WHEN pos % 4 < 3 THEN 1 ELSE 0 END AS mask
  FROM tok),
tokd AS (
  SELECT seq_id, pos, mask, CAST(d.i AS INTEGER) AS dim, CAST(embedding[d.i + 1] AS DOUBLE) AS v
  FROM tokm, range(64) d(i))"""

LOG = """
log AS (
  SELECT user_id AS run,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         value AS metric, value AS batch_loss, 1 + event_id % 4 AS batch_size
  FROM events),
logx AS (SELECT *, CAST(floor((step - 1) / 5) AS BIGINT) AS epoch FROM log)"""

LABELLED = """
j AS (SELECT ans.BMH, ans.text, ans.lang, cal.label FROM ans JOIN cal ON ans.BMH = cal.BMH)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


METRICS = ["exact_accuracy", "mae", "rmse", "qwk", "kappa", "pearson", "spearman", "acc_0.5"]


def _metric_values(names, wide_alias="w") -> str:
    cases = " ".join(f"WHEN '{m}' THEN {wide_alias}.\"{m}\"" for m in names)
    vals = ", ".join(f"('{m}', {i})" for i, m in enumerate(names))
    return cases, vals


def _qwk_sql(src: str, g: str, pred: str = "pred", out: str = "qwk") -> str:
    """Matrix form of QWK over dense indices of observed values, per group ``g``."""
    return f"""
  vals_{out} AS (SELECT DISTINCT {g}, v FROM (SELECT {g}, {pred} AS v FROM {src} UNION SELECT {g}, label FROM {src})),
  idx_{out} AS (SELECT {g}, v, dense_rank() OVER (PARTITION BY {g} ORDER BY v) - 1 AS i FROM vals_{out}),
  ab_{out} AS (SELECT s.{g}, ia.i AS a, ib.i AS b FROM {src} s
               JOIN idx_{out} ia ON ia.{g} = s.{g} AND ia.v = s.{pred}
               JOIN idx_{out} ib ON ib.{g} = s.{g} AND ib.v = s.label),
  ma_{out} AS (SELECT {g}, a, count(*) AS na FROM ab_{out} GROUP BY ALL),
  mb_{out} AS (SELECT {g}, b, count(*) AS nb FROM ab_{out} GROUP BY ALL),
  num_{out} AS (SELECT {g}, sum((a - b) * (a - b)) AS num, count(*) AS N FROM ab_{out} GROUP BY ALL),
  den_{out} AS (SELECT ma.{g}, sum(ma.na * mb.nb * (ma.a - mb.b) * (ma.a - mb.b)) AS den
                FROM ma_{out} ma JOIN mb_{out} mb ON ma.{g} = mb.{g} GROUP BY ALL),
  {out} AS (SELECT n.{g}, 1 - n.num / (d.den / n.N) AS {out}
            FROM num_{out} n JOIN den_{out} d ON n.{g} = d.{g})"""


def _metrics_sql(src: str, g: str, tolerance: float | None = None) -> str:
    """Full metric bundle per group from raw rows ``(g, pred, label)``; returns CTE text ending in ``wide``."""
    tol_cols = ""
    tol_cte = ""
    tol_join = ""
    if tolerance is not None:
        t = float(tolerance)
        tol_cols = (f", avg(CASE WHEN abs(pred - label) <= {t} THEN 1.0 ELSE 0.0 END) AS \"tolerance_acc({t})\"")
        tol_cte = f""",
  snapped AS (SELECT {g}, CASE WHEN abs(pred - label) <= {t} THEN label ELSE pred END AS spred, label FROM {src}),""" + \
            _qwk_sql("snapped", g, "spred", "tqwk")
        tol_join = f" JOIN tqwk USING ({g})"
    return f"""
  base AS (
    SELECT {g},
      avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS exact_accuracy,
      avg(abs(pred - label)) AS mae,
      sqrt(avg((pred - label) * (pred - label))) AS rmse,
      avg(CASE WHEN abs(pred - label) <= 0.5 THEN 1.0 ELSE 0.0 END) AS "acc_0.5",
      corr(pred, label) AS pearson{tol_cols}
    FROM {src} GROUP BY {g}),
  ranked AS (
    SELECT {g},
      rank() OVER (PARTITION BY {g} ORDER BY pred) + (count(*) OVER (PARTITION BY {g}, pred) - 1) / 2.0 AS rp,
      rank() OVER (PARTITION BY {g} ORDER BY label) + (count(*) OVER (PARTITION BY {g}, label) - 1) / 2.0 AS rl
    FROM {src}),
  spear AS (SELECT {g}, corr(rp, rl) AS spearman FROM ranked GROUP BY {g}),
  mpk AS (SELECT {g}, pred AS v, count(*) AS c FROM {src} GROUP BY ALL),
  mlk AS (SELECT {g}, label AS v, count(*) AS c FROM {src} GROUP BY ALL),
  pek AS (SELECT mpk.{g}, sum(mpk.c * mlk.c) AS pp FROM mpk JOIN mlk ON mpk.{g} = mlk.{g} AND mpk.v = mlk.v GROUP BY ALL),
  nk AS (SELECT {g}, count(*) AS N, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS po FROM {src} GROUP BY {g}),
  kap AS (SELECT nk.{g}, (po - coalesce(pp, 0) / (N * N)) / nullif(1 - coalesce(pp, 0) / (N * N), 0) AS kappa
          FROM nk LEFT JOIN pek ON nk.{g} = pek.{g}),""" + _qwk_sql(src, g) + tol_cte + f""",
  wide AS (SELECT * FROM base JOIN qwk USING ({g}) JOIN kap USING ({g}) JOIN spear USING ({g}){tol_join})"""


def _metrics_long(g: str, tolerance: float | None = None, src: str = "src") -> str:
    names = list(METRICS)
    if tolerance is not None:
        t = float(tolerance)
        names += [f"tolerance_acc({t})", f"tolerance_qwk({t})"]
    cases, vals = _metric_values(names)
    if tolerance is not None:
        cases = cases.replace(f"w.\"tolerance_qwk({float(tolerance)})\"", "w.tqwk")
    return f"""
SELECT w.{g}, m.metric, round(CAST(CASE m.metric {cases} END AS DOUBLE), 6) AS value
FROM wide w, (VALUES {vals}) m(metric, o)"""


SQL: dict[str, str] = {}

SQL["answers_clean"] = with_(ANS) + "\nSELECT BMH, text FROM ans"

SQL["calibration_union"] = with_(CAL) + "\nSELECT BMH, label FROM cal"

SQL["labelled_join"] = with_(STORED, CAL, LABELLED, """
pts AS (SELECT lang, label, CAST(dense_rank() OVER (PARTITION BY lang ORDER BY label) - 1 AS INTEGER) AS label_idx
        FROM (SELECT DISTINCT lang, label FROM j))""") + """
SELECT j.lang, j.BMH, j.text, j.label, pts.label_idx FROM j JOIN pts ON j.lang = pts.lang AND j.label = pts.label"""

SQL["score_points"] = with_(CAL, """
pts AS (SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx, label,
               CAST(count(*) OVER () AS INTEGER) AS K
        FROM (SELECT DISTINCT label FROM cal))""") + """
SELECT label_idx, label, K, (label_idx < 5 OR label_idx >= K - 3) AS preview FROM pts"""

_SPLIT = with_(STORED, CAL, LABELLED, """
lab AS (SELECT j.*, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM j),
ordered AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || BMH), BMH, text, label) AS rn,
                   count(*) OVER () AS n FROM lab),
sp AS (SELECT *, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM ordered)""")

SQL["split_members"] = _SPLIT + "\nSELECT BMH, label, label_idx, split FROM sp"

SQL["split_counts"] = _SPLIT + """
SELECT item, CAST(n AS BIGINT) AS n FROM (
  SELECT 'total' AS item, count(*) AS n FROM sp
  UNION ALL SELECT 'train', count(*) FROM sp WHERE split = 'train'
  UNION ALL SELECT 'test', count(*) FROM sp WHERE split = 'test'
  UNION ALL SELECT 'score_points', count(DISTINCT label) FROM sp)"""

SQL["split_hash"] = with_(STORED) + """
SELECT BMH,
       CASE WHEN CAST(CAST(('0x' || substr(md5('42:' || BMH), 1, 8)) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) < 0.2
            THEN 'test' ELSE 'train' END AS split
FROM ans"""

SQL["pad_truncate"] = with_(STORED, """
t AS (SELECT BMH, list_transform(string_split(text, ' '), lambda w: length(w)) AS tok FROM ans)""") + """
SELECT BMH, CAST(p AS INTEGER) AS pos,
       CAST(CASE WHEN p < len(tok) THEN tok[p + 1] ELSE 0 END AS INTEGER) AS input_id,
       CAST(CASE WHEN p < len(tok) THEN 1 ELSE 0 END AS INTEGER) AS mask
FROM t, range(32) r(p)"""

SQL["shuffled_batches"] = with_(STORED, """
r AS (SELECT CAST(e.epoch AS INTEGER) AS epoch, a.BMH,
             row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42:' || e.epoch || ':' || a.BMH), a.BMH) - 1 AS r0
      FROM ans a, range(2) e(epoch))""") + """
SELECT epoch, BMH, CAST(floor(r0 / 16) AS BIGINT) AS batch_id, CAST(r0 % 16 AS INTEGER) AS batch_pos FROM r"""

SQL["contingency"] = with_(RATE) + """
SELECT l_returnflag, pred, label, count(*) AS n FROM rate GROUP BY l_returnflag, pred, label"""

SQL["agreement_metrics"] = with_(RATE, "src AS (SELECT l_returnflag AS g, pred, label FROM rate)",
                                 _metrics_sql("src", "g")).replace("WITH ,", "WITH ") + \
    _metrics_long("g").replace("SELECT w.g,", "SELECT w.g AS l_returnflag,")

SQL["tolerance_curve"] = with_(RATE, """
th AS (SELECT op, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES
  ('le', 0.0), ('le', 0.5), ('le', 1.0), ('le', 1.5), ('le', 2.0), ('le', 2.5), ('le', 3.0),
  ('le', 3.5), ('le', 4.0), ('le', 5.0), ('le', 6.0), ('le', 7.0),
  ('gt', 7.0), ('gt', 8.0), ('gt', 9.0), ('gt', 10.0)) v(op, threshold))""") + """
SELECT op, threshold,
       round(avg(CASE WHEN (op = 'le' AND abs(pred - label) <= threshold)
                        OR (op = 'gt' AND abs(pred - label) > threshold) THEN 1.0 ELSE 0.0 END), 6) AS share
FROM rate, th GROUP BY op, threshold"""

SQL["tolerance_qwk"] = with_(RATE, """
snapped AS (SELECT l_returnflag AS g, CASE WHEN abs(pred - label) <= 2.0 THEN label ELSE pred END AS spred, label FROM rate)""",
                             _qwk_sql("snapped", "g", "spred", "tq")) + """
SELECT g AS l_returnflag, round(tq, 6) AS tolerance_qwk FROM tq"""

# ------------------------------------------------------------------ ordinal

SQL["ordinal_decode"] = with_(PROB, """
d AS (SELECT vec_id, label, k, sum(abs(p - CASE WHEN k > j THEN 1.0 ELSE 0.0 END)) AS dist
      FROM prob, range(10) c(k) GROUP BY vec_id, label, k),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS rn FROM d)""") + """
SELECT vec_id, label, CAST(k AS DOUBLE) AS score FROM r WHERE rn = 1"""

SQL["ordinal_loss"] = with_(PROB) + """
SELECT round(avg(greatest(logit, 0.0) - logit * CASE WHEN label_idx > j THEN 1.0 ELSE 0.0 END
                 + ln(1 + exp(-abs(logit)))), 6) AS loss,
       CAST(count(DISTINCT vec_id) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_terms
FROM prob"""

SQL["linear_head"] = with_("""
x AS (SELECT vec_id, CAST(d.i AS INTEGER) AS dim,
             CASE WHEN d.i < 64 THEN CAST(embedding[d.i + 1] AS DOUBLE) ELSE CAST(vec_id % 5 AS DOUBLE) END AS v
      FROM embeddings, range(65) d(i))""") + """
SELECT vec_id, CAST(k AS INTEGER) AS k,
       round(CAST(k - 4 AS DOUBLE) / CAST(4 AS DOUBLE)
             + sum(v * (CAST(((7 * k + 3 * dim) % 11) - 5 AS DOUBLE) / CAST(10 AS DOUBLE))), 6) AS logit
FROM x, range(9) t(k) GROUP BY vec_id, k"""

_VAL_SRC = """
dec AS (SELECT vec_id, label, CAST(k AS DOUBLE) AS pred FROM (
          SELECT vec_id, label, k, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS rn FROM (
            SELECT vec_id, label, k, sum(abs(p - CASE WHEN k > j THEN 1.0 ELSE 0.0 END)) AS dist
            FROM prob, range(10) c(k) GROUP BY vec_id, label, k)) WHERE rn = 1),
src AS (SELECT 1 AS g, pred, label FROM dec)"""

SQL["validate_summary"] = with_(PROB, _VAL_SRC, _metrics_sql("src", "g", 1.0)) + """,
lng AS (""" + _metrics_long("g", 1.0) + """),
vl AS (SELECT 'val_loss' AS metric,
              round(avg(greatest(logit, 0.0) - logit * CASE WHEN label_idx > j THEN 1.0 ELSE 0.0 END
                        + ln(1 + exp(-abs(logit)))), 6) AS value FROM prob)
SELECT metric, value FROM lng UNION ALL SELECT metric, value FROM vl"""

# ------------------------------------------------------------------ pool

SQL["pool_mean"] = with_(TOK) + """
SELECT seq_id, dim, round(sum(v * mask) / greatest(sum(mask), 1), 6) AS value FROM tokd GROUP BY seq_id, dim"""

SQL["pool_last"] = with_(TOK, """
t AS (SELECT seq_id, sum(mask) AS s, max(pos) AS last FROM tokm GROUP BY seq_id)""") + """
SELECT tokd.seq_id, tokd.dim, round(tokd.v, 6) AS value
FROM tokd JOIN t ON tokd.seq_id = t.seq_id AND tokd.pos = CASE WHEN t.s = 0 THEN t.last ELSE t.s - 1 END"""

SQL["pool_attention"] = with_(TOK, """
sc AS (SELECT seq_id, pos, mask, sum(v * (1.0 / CAST(dim + 1 AS DOUBLE))) AS s FROM tokd GROUP BY seq_id, pos, mask),
st AS (SELECT seq_id, max(CASE WHEN mask = 1 THEN s END) AS mx, sum(mask) AS cnt FROM sc GROUP BY seq_id),
w AS (SELECT sc.seq_id, sc.pos,
             CASE WHEN st.cnt = 0 THEN 1.0 WHEN sc.mask = 1 THEN exp(sc.s - st.mx) ELSE 0.0 END AS w
      FROM sc JOIN st ON sc.seq_id = st.seq_id)""") + """
SELECT tokd.seq_id, tokd.dim, round(sum(w.w * tokd.v) / sum(w.w), 6) AS value
FROM tokd JOIN w ON tokd.seq_id = w.seq_id AND tokd.pos = w.pos GROUP BY tokd.seq_id, tokd.dim"""

# ------------------------------------------------------------------ batch scoring

SCORED = """
s AS (SELECT BMH, text, lang,
             (text IS NULL OR regexp_full_match(text, '[\\t\\n\\x0b\\f\\r \\x1c-\\x1f\\x{85}\\p{Z}]*')) AS skip
      FROM ans_raw),
nb AS (SELECT BMH, CAST(floor((row_number() OVER (ORDER BY CAST(BMH AS BIGINT)) - 1) / 16) AS BIGINT) AS batch
       FROM s WHERE NOT skip),
sb AS (SELECT s.*, nb.batch FROM s LEFT JOIN nb ON s.BMH = nb.BMH),
bad AS (SELECT batch, bool_or(contains(text, '@')) AS bad FROM sb WHERE NOT skip GROUP BY batch),
scored AS (
  SELECT sb.BMH, sb.text, sb.lang,
         CASE WHEN skip OR bad THEN NULL ELSE CAST(length(text) % 9 AS DOUBLE) / 2 END AS pred_score,
         CASE WHEN skip THEN 'skipped' WHEN bad THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN NOT skip AND bad THEN 'marker @ found in text' END AS error
  FROM sb LEFT JOIN bad ON sb.batch = bad.batch)"""

SQL["batch_score"] = with_(ANS, SCORED) + "\nSELECT BMH, text, lang, pred_score, status, error FROM scored"

SQL["status_counts"] = with_(ANS, SCORED) + "\nSELECT status, count(*) AS n FROM scored GROUP BY status"

SQL["flagship_agreement"] = with_(ANS, SCORED, CAL, """
src AS (SELECT scored.lang AS g, scored.pred_score AS pred, cal.label
        FROM scored JOIN cal ON scored.BMH = cal.BMH WHERE scored.pred_score IS NOT NULL)""",
                                  _metrics_sql("src", "g")) + \
    _metrics_long("g").replace("SELECT w.g,", "SELECT w.g AS lang,")

# ------------------------------------------------------------------ profile


def _describe_sql(src: str, x: str = "x") -> str:
    qs = ", ".join(f"round(quantile_cont({x}, {p}), 6) AS p{n}" for p, n in
                   [(0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90), (0.95, 95), (0.99, 99)])
    return f"""
SELECT count(*) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
       round(min({x}), 6) AS min, {qs}, round(max({x}), 6) AS max
FROM {src}"""


def _hist_sql(src: str, bins: int, x: str = "x") -> str:
    return f"""
r AS (SELECT min({x}) AS mn, max({x}) AS mx FROM {src}),
rr AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM r),
e AS (SELECT CAST(t.i AS INTEGER) AS bin,
             t.i * ((hi - lo) / CAST({bins} AS DOUBLE)) + lo AS lo,
             CASE WHEN t.i = {bins - 1} THEN hi ELSE (t.i + 1) * ((hi - lo) / CAST({bins} AS DOUBLE)) + lo END AS hi
      FROM range({bins}) t(i), rr),
v AS (SELECT {x} AS x, count(*) AS c FROM {src} GROUP BY ALL),
hist AS (SELECT e.bin, round(e.lo, 6) AS lo, round(e.hi, 6) AS hi, CAST(coalesce(sum(v.c), 0) AS BIGINT) AS n
         FROM e LEFT JOIN v ON v.x >= e.lo AND (v.x < e.hi OR (e.bin = {bins - 1} AND v.x <= e.hi))
         GROUP BY e.bin, e.lo, e.hi)"""


_LEN = "lens AS (SELECT CAST(length(coalesce(text, '')) AS DOUBLE) AS x FROM ans_raw)"

SQL["length_describe"] = with_(STORED, _LEN) + \
    _describe_sql("lens").replace("FROM lens", ", CAST(count_if(x = 0) AS BIGINT) AS n_zero\nFROM lens")

SQL["length_hist"] = with_(STORED, _LEN, _hist_sql("lens", 80)) + "\nSELECT bin, lo, hi, n FROM hist"

_PRED = "preds AS (SELECT pred AS x FROM rate WHERE pred IS NOT NULL)"

SQL["score_profile"] = with_(RATE, _PRED) + _describe_sql("preds")

SQL["score_hist"] = with_(RATE, _PRED, _hist_sql("preds", 50)) + "\nSELECT bin, lo, hi, n FROM hist WHERE n > 0"

SQL["length_vs_score"] = with_(STORED, CAL) + """
SELECT a.BMH, CAST(length(coalesce(a.text, '')) AS BIGINT) AS length, cal.label AS score
FROM ans_raw a LEFT JOIN cal ON a.BMH = cal.BMH WHERE cal.label IS NOT NULL"""

# ------------------------------------------------------------------ track

SQL["improvement_events"] = with_(LOG, """
r AS (SELECT run, step, metric,
             greatest(0.0, coalesce(max(metric) OVER (PARTITION BY run ORDER BY step
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS prev_best
      FROM logx)""") + "\nSELECT run, step, metric, prev_best FROM r WHERE metric > prev_best"

SQL["best_checkpoint"] = with_(LOG, """
r AS (SELECT run, step, metric, row_number() OVER (PARTITION BY run ORDER BY metric DESC, step) AS rn FROM logx)""") + \
    "\nSELECT run, step, metric FROM r WHERE rn = 1 AND metric > 0"

SQL["epoch_loss"] = with_(LOG) + """
SELECT run, epoch, count(*) AS n_steps, round(avg(batch_loss), 6) AS train_loss,
       round(sum(batch_loss * batch_size) / sum(batch_size), 6) AS weighted_loss
FROM logx GROUP BY run, epoch"""

SQL["logged_steps"] = with_(LOG) + "\nSELECT run, step, metric FROM logx WHERE step % 10 = 0"

# ------------------------------------------------------------------ deep head
# The rule weights of catalog.rule_deep_head, written out in SQL.  DuckDB has no
# erf, so GELU uses the Maclaurin series of erf (60 terms; accurate to ~1e-14
# for |q| <= 5, and erf = sign(q) beyond).


def _deep_block(i: int, src: str, a: int, h: int, out: str) -> str:
    w = f"CAST(((r * 5 + c * 3 + {i}) % 7) - 3 AS DOUBLE) / CAST(20 AS DOUBLE)"
    b = "CAST((r % 3) - 1 AS DOUBLE) / CAST(10 AS DOUBLE)"
    p = "CAST(((r + 2 * c) % 5) - 2 AS DOUBLE) / CAST(10 AS DOUBLE)"
    res = f"sum(v * {p})" if a != h else "sum(CASE WHEN c = r THEN v ELSE 0.0 END)"
    return f"""
n{i} AS (SELECT vec_id, c, v,
               (v - avg(v) OVER (PARTITION BY vec_id)) / sqrt(var_pop(v) OVER (PARTITION BY vec_id) + 1e-5) AS z
        FROM {src}),
a{i} AS (SELECT vec_id, r, sum(z * {w}) + {b} AS u, {res} AS res
        FROM n{i}, range({h}) s(r) GROUP BY vec_id, r),
f{i} AS (SELECT vec_id, r, any_value(u) AS u, any_value(res) AS res, any_value(u / sqrt(2.0)) AS q,
               sum(CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END * pow(u / sqrt(2.0), 2 * k + 1)
                   / (exp(lgamma(k + 1)) * (2 * k + 1))) AS ser
        FROM a{i}, range(60) t(k) GROUP BY vec_id, r),
{out} AS (SELECT vec_id, r AS c,
                0.5 * u * (1 + CASE WHEN abs(q) > 5 THEN sign(q) ELSE 2 / sqrt(pi()) * ser END) + res AS v
         FROM f{i})"""


SQL["deep_head"] = with_(
    """
x0 AS (SELECT vec_id, CAST(t.i AS BIGINT) AS c, CAST(embedding[t.i + 1] AS DOUBLE) AS v
       FROM embeddings, range(64) t(i))""",
    _deep_block(0, "x0", 64, 16, "x1"),
    _deep_block(1, "x1", 16, 8, "x2")) + """
SELECT vec_id, CAST(k AS INTEGER) AS k,
       round(sum(v * (CAST(((k + 2 * c) % 5) - 2 AS DOUBLE) / CAST(4 AS DOUBLE)))
             + CAST(k - 4 AS DOUBLE) / CAST(8 AS DOUBLE), 6) AS logit
FROM x2, range(9) o(k) GROUP BY vec_id, k"""

SQL["length_score_bins"] = with_(STORED, CAL, """
p AS (SELECT CAST(length(coalesce(a.text, '')) AS DOUBLE) AS x, cal.label AS score
      FROM ans_raw a JOIN cal ON a.BMH = cal.BMH),
r AS (SELECT min(x) AS mn, max(x) AS mx FROM p),
rr AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM r)""") + """
SELECT CAST(t.i AS INTEGER) AS bin, score, count(*) AS n
FROM p, rr, range(80) t(i)
WHERE x >= t.i * ((hi - lo) / CAST(80 AS DOUBLE)) + lo
  AND CASE WHEN t.i = 79 THEN x <= hi ELSE x < (t.i + 1) * ((hi - lo) / CAST(80 AS DOUBLE)) + lo END
GROUP BY ALL"""

# the regularised gradient of a minimum is zero, whatever the weights
SQL["fit_thresholds"] = """
SELECT CAST(k AS INTEGER) AS threshold, count(*) FILTER (WHERE label > k) AS positives, count(*) AS n_rows, 0.0::DOUBLE AS steepest
FROM embeddings, range(9) t(k) WHERE label IS NOT NULL GROUP BY k"""

SQL["fit_chain"] = """
SELECT item, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'train_rows' AS item, count(*) - ceil(count(*) * 0.2) AS value FROM embeddings
  UNION ALL SELECT 'test_rows', ceil(count(*) * 0.2) FROM embeddings
  UNION ALL SELECT unnest(['steepest', 'weights_changed_by_saving', 'metrics_changed_by_saving', 'best_head_misses_best_accuracy',
                           'best_below_final']), 0)"""

SQL["saved_head"] = SQL["linear_head"]

SQL["score_sequences"] = with_(TOK, """
pooled AS (SELECT seq_id, dim, sum(v * mask) / greatest(sum(mask), 1) AS v FROM tokd GROUP BY seq_id, dim),
lg AS (SELECT seq_id, CAST(k AS INTEGER) AS k, CAST(k - 4 AS DOUBLE) / CAST(4 AS DOUBLE)
              + sum(v * (CAST(((7 * k + 3 * dim) % 11) - 5 AS DOUBLE) / CAST(10 AS DOUBLE))) AS logit
       FROM pooled, range(9) t(k) GROUP BY seq_id, k),
dist AS (SELECT seq_id, c, sum(abs(1.0 / (1.0 + exp(-logit)) - CASE WHEN c > k THEN 1.0 ELSE 0.0 END)) AS d
         FROM lg, range(10) s(c) GROUP BY seq_id, c),
best AS (SELECT seq_id, CAST(c AS DOUBLE) AS score FROM (
           SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY d, c) AS rn FROM dist) WHERE rn = 1)""") + """
SELECT seq_id, score, k, round(logit, 6) AS logit FROM lg JOIN best USING (seq_id)"""

SQL["calibration_files"] = SQL["calibration_union"]

SQL["summed_metrics"] = f"""
SELECT * FROM ({SQL["agreement_metrics"]}) WHERE metric IN ('exact_accuracy', 'mae', 'rmse', 'acc_0.5', 'pearson', 'kappa')"""

_LINES = """
lines AS (SELECT nullif(l_returnflag, 'N') AS flag, l_orderkey * 8 + l_linenumber AS line, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem)"""

SQL["ranked_null_groups"] = with_(_LINES) + """
SELECT flag, line, row_number() OVER (PARTITION BY flag ORDER BY md5('42:' || line), line) AS rank FROM lines"""

SQL["positions"] = with_(_LINES) + """
SELECT flag, line, CAST(row_number() OVER (PARTITION BY flag ORDER BY line) - 1 AS INTEGER) AS pos FROM lines"""

SQL["describe_values"] = with_(_LINES, """
x AS (SELECT flag, price + line / CAST(1e9 AS DOUBLE) AS x FROM lines)""") + \
    _describe_sql("x").replace("SELECT count(*)", "SELECT flag, count(*)").replace("FROM x", "FROM x GROUP BY flag")

_TOKENS = """
tok AS (SELECT BMH, list_transform(string_split(text, ' '), lambda w: length(w)) AS tokens FROM ans),
cut AS (SELECT BMH, tokens[1:32] AS ids FROM tok)"""

SQL["pad_batches"] = with_(STORED, _TOKENS, """
b AS (SELECT BMH, ids, CASE WHEN CAST(BMH AS BIGINT) % 50 <> 0 THEN CAST(BMH AS BIGINT) // 16 END AS batch FROM cut)""") + """
SELECT BMH, CAST(CASE WHEN batch IS NULL THEN len(ids) ELSE max(len(ids)) OVER (PARTITION BY batch) END AS BIGINT) AS width,
       CAST(list_sum(ids) AS BIGINT) AS id_sum, CAST(len(ids) AS BIGINT) AS n_real FROM b"""

SQL["training_examples"] = with_(STORED, CAL, LABELLED, _TOKENS, """
lab AS (SELECT BMH, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM j)""") + """
SELECT lab.BMH, label, label_idx, CAST(32 AS BIGINT) AS width, CAST(list_sum(ids) AS BIGINT) AS id_sum, CAST(len(ids) AS BIGINT) AS n_real
FROM lab JOIN (SELECT DISTINCT * FROM cut) c ON lab.BMH = c.BMH"""

SQL["score_table"] = with_(ANS, SCORED) + """
SELECT BMH, text, lang, pred_score AS score,
       CASE status WHEN 'success' THEN '成功' WHEN 'skipped' THEN '跳过(空文本)' ELSE '失败: ' || error END AS status FROM scored"""

SQL["profile_job"] = with_(ANS, SCORED, "given AS (SELECT pred_score AS x FROM scored WHERE pred_score IS NOT NULL)") + _describe_sql("given")

SQL["question_files"] = """
SELECT CAST(doc_id AS VARCHAR) AS BMH, text FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents)"""

SQL["pool_unmasked"] = with_(TOK) + "\nSELECT seq_id, dim, round(avg(v), 6) AS value FROM tokd GROUP BY seq_id, dim"
