"""DuckDB oracle SQL for every registered query (independent formulation
of the same result over the pre-registered parquet views)."""

from __future__ import annotations

from .. import config

SIZES = ", ".join(str(s) for s in config.TRAIN_SIZES)
TOP = max(config.TRAIN_SIZES)
RUNS = config.RUNS
SEED = config.SEED
K = config.KEEP_BY_DISTANCE
T = config.THRESHOLD

# --- stand-in corpora -------------------------------------------------------

L = r"""L AS (
  SELECT lang AS intent, t AS text, min(pos) AS pos FROM (
    SELECT lang, trim(regexp_replace(line, '[^\x01-\x7F]', '', 'g')) AS t, doc_id * 1000000 + ln AS pos
    FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM documents) a
  ) b WHERE t <> '' GROUP BY lang, t)"""

P = """P AS (SELECT p_type AS intent, p_name AS text, min(p_partkey) AS pos FROM part GROUP BY p_type, p_name)"""

GRID = f"""GRID AS (SELECT CAST(s.train_n AS BIGINT) AS train_n, CAST(r.run AS BIGINT) AS run
  FROM (SELECT unnest([{SIZES}]) AS train_n) s, (SELECT unnest(range(1, {RUNS + 1})) AS run) r)"""


def fewshot(src: str = "L", name: str = "FS", seed=SEED) -> str:
    return f"""{name} AS (
  SELECT CAST(s.train_n AS BIGINT) AS train_n, CAST(x.run AS BIGINT) AS run, x.intent, x.text, x.pos, CAST(x.rk AS BIGINT) AS rk
  FROM (SELECT run, intent, text, pos,
               row_number() OVER (PARTITION BY run, intent
                   ORDER BY md5(concat_ws('|', '{seed}', CAST(run AS VARCHAR), text)), text) AS rk
        FROM {src}, (SELECT unnest(range(1, {RUNS + 1})) AS run) r) x,
       (SELECT unnest([{SIZES}]) AS train_n) s
  WHERE x.rk <= {TOP} AND x.rk <= s.train_n)"""


def lemma_sql(tok: str) -> str:
    return (f"CASE WHEN {tok} LIKE '%ing' AND length({tok}) >= 6 THEN left({tok}, length({tok}) - 3) "
            f"WHEN {tok} LIKE '%ed' AND length({tok}) >= 5 THEN left({tok}, length({tok}) - 2) "
            f"WHEN {tok} LIKE '%s' AND length({tok}) >= 4 THEN left({tok}, length({tok}) - 1) "
            f"ELSE {tok} END")


# candidates of every split: L minus that split's originals
CAND = """C AS (SELECT g.train_n, g.run, L.intent, L.text, L.pos FROM L, GRID g
  WHERE NOT EXISTS (SELECT 1 FROM FS f WHERE f.train_n = g.train_n AND f.run = g.run
                    AND f.intent = L.intent AND f.text = L.text))"""

DIST = """D AS (SELECT C.train_n, C.run, C.intent, C.text, C.pos, min(levenshtein(C.text, f.text)) AS dist
  FROM C LEFT JOIN FS f ON f.train_n = C.train_n AND f.run = C.run AND f.intent = C.intent
  GROUP BY C.train_n, C.run, C.intent, C.text, C.pos)"""


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


Q: dict[str, str] = {}

Q["fewshot"] = w(L, fewshot()) + "SELECT train_n, run, intent, text, pos, rk FROM FS"

Q["subtract"] = w(L, fewshot(), GRID, CAND) + "SELECT train_n, run, intent, pos FROM C"

Q["merge"] = w(L, fewshot(), fewshot(name="FS2", seed=7)) + """
SELECT train_n, run, intent, text, min(pos) AS pos FROM (
  SELECT train_n, run, intent, text, pos FROM FS UNION ALL SELECT train_n, run, intent, text, pos FROM FS2) u
GROUP BY train_n, run, intent, text"""

Q["limit_n"] = w(L, fewshot(), GRID, CAND) + f"""
SELECT train_n, run, intent, text, pos, CAST(pick AS BIGINT) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY train_n, run, intent
      ORDER BY md5(concat_ws('|', '{SEED}', text)), text) AS pick FROM C) x
WHERE pick <= {config.LIMIT_PER_INTENT}"""

Q["one_per_intent"] = w(L, fewshot(), GRID, CAND) + """
SELECT train_n, run, intent, text, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY train_n, run, intent
      ORDER BY md5(concat_ws('|', 'one', text)), text) AS pick FROM C) x
WHERE pick = 1"""

Q["min_distance"] = w(L, fewshot(), GRID, CAND, DIST) + (
    "SELECT train_n, run, intent, pos, CAST(dist AS BIGINT) AS dist FROM D")

Q["farthest"] = w(L, fewshot(), GRID, CAND, DIST) + f"""
SELECT train_n, run, intent, text, CAST(dist AS BIGINT) AS dist, CAST(rk AS BIGINT) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY train_n, run, intent ORDER BY dist DESC NULLS LAST, pos, text) AS rk FROM D) x
WHERE rk <= {K}"""

Q["lemmatise"] = w(L) + f"""
SELECT intent, pos, string_agg(lem, ' ' ORDER BY i) AS lemma FROM (
  SELECT intent, pos, i, {lemma_sql('tok')} AS lem FROM (
    SELECT intent, pos, unnest(string_split(text, ' ')) AS tok,
           unnest(range(0, len(string_split(text, ' ')))) AS i FROM L) a) b
GROUP BY intent, pos"""

CONV = r"""CV AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[^\x01-\x7F]', '', 'g')) AS t FROM conversations)"""

Q["pair_distance"] = w(CONV) + """
SELECT u.conv_id, CAST(u.turn AS BIGINT) AS turn, CAST(levenshtein(u.t, a.t) AS BIGINT) AS dist
FROM CV u JOIN CV a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""

Q["jaccard"] = w(L, fewshot(), GRID, CAND) + """
, W AS (SELECT C.*, list_distinct(list_filter(regexp_split_to_array(C.text, '\\s+'), lambda x: x <> '')) AS wa FROM C)
, O AS (SELECT f.*, list_distinct(list_filter(regexp_split_to_array(f.text, '\\s+'), lambda x: x <> '')) AS wb FROM FS f)
SELECT train_n, run, intent, pos, orig_pos, round(sim, 6) AS sim FROM (
  SELECT W.train_n, W.run, W.intent, W.pos, O.pos AS orig_pos,
         len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))) AS sim
  FROM W JOIN O ON O.train_n = W.train_n AND O.run = W.run AND O.intent = W.intent) x
WHERE sim >= 0.25"""

# --- predictions N (nearest centroid on embeddings) ---------------------------------

E = """E AS (SELECT CAST(label AS VARCHAR) AS intent, CAST(vec_id AS VARCHAR) AS text, vec_id AS pos,
  CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""

GRID1 = f"""GRID AS (SELECT CAST(s.train_n AS BIGINT) AS train_n, CAST(r.run AS BIGINT) AS run
  FROM (SELECT unnest([{SIZES}]) AS train_n) s, (SELECT unnest(range(1, {RUNS + 2})) AS run) r)"""

NCTE = [E, fewshot("E"), GRID, """CEN AS (SELECT train_n, run, intent, list(x ORDER BY i) AS c FROM (
  SELECT FS.train_n, FS.run, FS.intent, u.i, avg(u.x) AS x
  FROM FS JOIN (SELECT pos, unnest(vec) AS x, unnest(range(0, len(vec))) AS i FROM E) u ON u.pos = FS.pos
  GROUP BY FS.train_n, FS.run, FS.intent, u.i) a GROUP BY train_n, run, intent)""",
        """CE AS (SELECT g.train_n, g.run, E.intent, E.text, E.pos, E.vec FROM E, GRID g
  WHERE NOT EXISTS (SELECT 1 FROM FS f WHERE f.train_n = g.train_n AND f.run = g.run
                    AND f.intent = E.intent AND f.text = E.text))""",
        """S AS (SELECT CE.train_n, CE.run, CE.text, CE.intent, CEN.intent AS cls,
  list_dot_product(CE.vec, CEN.c) / (sqrt(list_dot_product(CE.vec, CE.vec)) * sqrt(list_dot_product(CEN.c, CEN.c))) AS s
  FROM CE JOIN CEN ON CEN.train_n = CE.train_n AND CEN.run = CE.run)""",
        """M AS (SELECT train_n, run, text, max(s) AS ms FROM S GROUP BY train_n, run, text)""",
        """N AS (SELECT S.train_n, S.run, S.text, S.intent, min(CASE WHEN S.s = M.ms THEN S.cls END) AS pred,
  1.0 / sum(exp((S.s - M.ms) * 20)) AS conf
  FROM S JOIN M ON M.train_n = S.train_n AND M.run = S.run AND M.text = S.text
  GROUP BY S.train_n, S.run, S.text, S.intent)"""]


def report(src: str, keys: list[str], name: str = "RPT") -> str:
    k = ", ".join(keys)
    return f"""{name}_R AS (SELECT {k}, c AS intent, sum(t) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
  SELECT {k}, intent AS c, 1 AS t, 0 AS p, CASE WHEN intent = pred THEN 1 ELSE 0 END AS tp
    FROM (SELECT DISTINCT {k}, text, intent, pred FROM {src}) a
  UNION ALL SELECT {k}, pred AS c, 0 AS t, 1 AS p, 0 AS tp
    FROM (SELECT DISTINCT {k}, text, intent, pred FROM {src}) b) u GROUP BY {k}, c),
{name}_P AS (SELECT {k}, intent, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
  CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp FROM {name}_R),
{name} AS (SELECT {k}, intent, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  support, tp FROM {name}_P)"""


def totals(src: str, keys: list[str], name: str = "TOT") -> str:
    k = ", ".join(keys)
    wv = "CASE WHEN sum(support) > 0 THEN sum({c} * support) / sum(support) ELSE 0.0 END"
    return f"""{name} AS (SELECT {k},
  CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0.0 END AS accuracy,
  avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
  {wv.format(c='precision')} AS weighted_precision, {wv.format(c='recall')} AS weighted_recall,
  {wv.format(c='f1')} AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM {src} GROUP BY {k})"""


def r6(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


KN = ["train_n", "run"]

Q["centroid_predict"] = w(*NCTE) + f"SELECT train_n, run, text, intent, pred, {r6(['conf'])} FROM N"

Q["uncertain"] = w(*NCTE) + f"""SELECT train_n, run, text, intent, pred, {r6(['conf'])}, pred <> intent AS is_error
FROM N WHERE pred <> intent OR conf < {T}"""

Q["class_report"] = w(*NCTE, report("N", KN)) + (
    f"SELECT train_n, run, intent, {r6(['precision', 'recall', 'f1'])}, support, tp FROM RPT")

Q["confused_top3"] = w(*NCTE) + """SELECT train_n, run, intent, confused, CAST(n AS BIGINT) AS n, CAST(rk AS BIGINT) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY train_n, run, intent ORDER BY n DESC, confused) AS rk FROM (
    SELECT train_n, run, intent, pred AS confused, count(*) AS n
    FROM (SELECT DISTINCT train_n, run, text, intent, pred FROM N) a WHERE pred <> intent
    GROUP BY train_n, run, intent, pred) b) c WHERE rk <= 3"""

TOT_COLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1",
            "weighted_precision", "weighted_recall", "weighted_f1"]

Q["totals"] = w(*NCTE, report("N", KN), totals("RPT", KN)) + (
    f"SELECT train_n, run, {r6(TOT_COLS)}, support FROM TOT")

Q["run_listing"] = w(*NCTE, report("N", KN), totals("RPT", KN), GRID1.replace("GRID AS", "GRID2 AS")) + """
SELECT g.train_n, g.run, round(t.weighted_precision, 6) AS precision, round(t.weighted_recall, 6) AS recall,
  round(t.weighted_f1, 6) AS f1_score, t.support, round(t.macro_f1, 6) AS macro_f1
FROM GRID2 g LEFT JOIN TOT t ON t.train_n = g.train_n AND t.run = g.run"""

# --- evaluation log V ------------------------------------------------------------------

V = """V AS (SELECT CAST([1, 3, 5][CAST(user_id % 3 AS INTEGER) + 1] AS BIGINT) AS train_n,
  CAST(dayofmonth(ts) % 10 + 1 AS BIGINT) AS run, CAST(event_id % 3 + 1 AS BIGINT) AS loop,
  CAST(event_id AS VARCHAR) AS text, event_type AS intent,
  TY.types[CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % len(TY.types) AS INTEGER) + 1] AS pred,
  value / (value + 10) AS conf
  FROM events, (SELECT list_sort(list(DISTINCT event_type)) AS types FROM events) TY)"""

KV = ["train_n", "run", "loop"]
VREP = [V, report("V", KV, "VR")]

Q["v_report"] = w(*VREP) + f"SELECT train_n, run, loop, intent, {r6(['precision', 'recall', 'f1'])}, support, tp FROM VR"

RS = [*VREP, totals("VR", KV, "VT"), """RS0 AS (SELECT train_n, run, avg(weighted_precision) AS precision,
  avg(weighted_recall) AS recall, avg(weighted_f1) AS f1_score, avg(support) AS support FROM VT GROUP BY train_n, run)""",
      """CS AS (SELECT train_n, run, count(*) FILTER (WHERE pred = intent) AS n_successes,
  count(*) FILTER (WHERE pred <> intent) AS n_errors FROM V GROUP BY train_n, run)""",
      """RS AS (SELECT RS0.*, CAST(coalesce(CS.n_successes, 0) AS BIGINT) AS n_successes,
  CAST(coalesce(CS.n_errors, 0) AS BIGINT) AS n_errors
  FROM RS0 LEFT JOIN CS ON CS.train_n = RS0.train_n AND CS.run = RS0.run)"""]

Q["run_summary"] = w(*RS) + f"SELECT train_n, run, {r6(['precision', 'recall', 'f1_score', 'support'])}, n_successes, n_errors FROM RS"

Q["size_summary"] = w(*RS) + f"""SELECT train_n, {r6(['precision', 'recall', 'f1_score', 'support'])},
  CAST(n_successes AS BIGINT) AS n_successes, CAST(n_errors AS BIGINT) AS n_errors FROM (
  SELECT train_n, avg(precision) AS precision, avg(recall) AS recall, avg(f1_score) AS f1_score,
    avg(support) AS support, sum(n_successes) AS n_successes, sum(n_errors) AS n_errors FROM RS GROUP BY train_n) a"""

Q["confidence_lists"] = w(V) + """SELECT train_n, run, CASE WHEN pred = intent THEN 'success' ELSE 'error' END AS outcome,
  round(conf, 6) AS conf FROM V"""

ISUM = [*VREP, """ISUM AS (SELECT train_n, intent, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM (
  SELECT train_n, run, intent, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1
  FROM VR GROUP BY train_n, run, intent) a GROUP BY train_n, intent)"""]

Q["intent_summary"] = w(*ISUM) + f"SELECT train_n, intent, {r6(['precision', 'recall', 'f1'])} FROM ISUM"

Q["new_counts"] = w(*VREP) + f"""SELECT train_n, intent, round(avg(new_examples), 6) AS new_examples FROM (
  SELECT i.train_n, i.run, i.intent, coalesce(c.n, 0) AS new_examples
  FROM (SELECT DISTINCT train_n, run, intent FROM VR) i
  LEFT JOIN (SELECT train_n, run, intent, count(*) AS n FROM V WHERE pred <> intent OR conf < {T}
             GROUP BY train_n, run, intent) c
    ON c.train_n = i.train_n AND c.run = i.run AND c.intent = i.intent) a GROUP BY train_n, intent"""

Q["pivot_intents"] = w(*ISUM) + "SELECT train_n, " + ", ".join(
    f"round(max({m}) FILTER (WHERE intent = '{i}'), 6) AS {i}_{m}"
    for i in ("click", "error", "purchase", "signup", "view") for m in ("precision", "recall", "f1")
) + " FROM ISUM GROUP BY train_n"

# --- naive Bayes on L, triage ------------------------------------------------------------

TOKS = "list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda x: x <> '')"

NB = [L, fewshot(), GRID, CAND,
      f"""TK AS (SELECT train_n, run, intent, unnest({TOKS.format(t='text')}) AS token FROM FS)""",
      """CNT AS (SELECT train_n, run, intent, token, count(*) AS n FROM TK GROUP BY train_n, run, intent, token)""",
      """VOC AS (SELECT train_n, run, count(DISTINCT token) AS v FROM CNT GROUP BY train_n, run)""",
      """NC AS (SELECT train_n, run, intent, sum(n) AS nc FROM CNT GROUP BY train_n, run, intent)""",
      """DC AS (SELECT train_n, run, intent, count(*) AS d FROM FS GROUP BY train_n, run, intent)""",
      """CLS AS (SELECT DC.train_n, DC.run, DC.intent,
  ln(DC.d / sum(DC.d) OVER (PARTITION BY DC.train_n, DC.run)) AS logprior,
  ln(coalesce(NC.nc, 0) + coalesce(VOC.v, 0)) AS dlog
  FROM DC LEFT JOIN NC ON NC.train_n = DC.train_n AND NC.run = DC.run AND NC.intent = DC.intent
  LEFT JOIN VOC ON VOC.train_n = DC.train_n AND VOC.run = DC.run)""",
      f"""CT AS (SELECT train_n, run, pos, unnest({TOKS.format(t='text')}) AS token FROM C)""",
      """CTV AS (SELECT CT.* FROM CT WHERE EXISTS (SELECT 1 FROM CNT WHERE CNT.train_n = CT.train_n
  AND CNT.run = CT.run AND CNT.token = CT.token))""",
      """TT AS (SELECT train_n, run, pos, count(*) AS t FROM CTV GROUP BY train_n, run, pos)""",
      """SS AS (SELECT CTV.train_n, CTV.run, CTV.pos, CNT.intent AS cls, sum(ln(CNT.n + 1)) AS s
  FROM CTV JOIN CNT ON CNT.train_n = CTV.train_n AND CNT.run = CTV.run AND CNT.token = CTV.token
  GROUP BY CTV.train_n, CTV.run, CTV.pos, CNT.intent)""",
      """SC AS (SELECT C.train_n, C.run, C.intent, C.text, C.pos, CLS.intent AS cls,
  CLS.logprior - coalesce(TT.t, 0) * CLS.dlog + coalesce(SS.s, 0) AS s
  FROM C JOIN CLS ON CLS.train_n = C.train_n AND CLS.run = C.run
  LEFT JOIN TT ON TT.train_n = C.train_n AND TT.run = C.run AND TT.pos = C.pos
  LEFT JOIN SS ON SS.train_n = C.train_n AND SS.run = C.run AND SS.pos = C.pos AND SS.cls = CLS.intent)""",
      """SM AS (SELECT train_n, run, pos, max(s) AS ms FROM SC GROUP BY train_n, run, pos)""",
      """NBP AS (SELECT SC.train_n, SC.run, SC.intent, SC.text, SC.pos, min(CASE WHEN SC.s = SM.ms THEN SC.cls END) AS pred,
  1.0 / sum(exp(SC.s - SM.ms)) AS conf
  FROM SC JOIN SM ON SM.train_n = SC.train_n AND SM.run = SC.run AND SM.pos = SC.pos
  GROUP BY SC.train_n, SC.run, SC.intent, SC.text, SC.pos)"""]

Q["nb_predict"] = w(*NB) + f"SELECT train_n, run, intent, pos, pred, {r6(['conf'])} FROM NBP"

def softmax_steps() -> list[str]:
    """The iterations of the softmax model, one set of tables each (W0 is empty)."""
    from ..operators.softmax import DECAY, ITERATIONS, RATE
    grams = """GR AS (SELECT t, substr(p, i, n) AS g FROM (
      SELECT t, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM (
        SELECT t, p, unnest(range(1, least(4, length(p)) + 1)) AS n FROM (
          SELECT text AS t, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS p
          FROM (SELECT DISTINCT text FROM P) a) b) c) d)"""
    feats = """FX AS (SELECT t, f, n / sqrt(sum(n * n) OVER (PARTITION BY t)) AS x FROM (
      SELECT t, CAST('0x' || left(md5(g), 4) AS INTEGER) AS f, CAST(count(*) AS DOUBLE) AS n FROM GR GROUP BY t, 2) a
      UNION ALL SELECT DISTINCT text, -1, 1.0 FROM P)"""
    out = [grams, feats, "SX AS (SELECT FS.*, f, x FROM FS JOIN FX ON FX.t = FS.text)",
           "SC AS (SELECT DISTINCT train_n, run, intent AS class FROM FS)",
           "SN AS (SELECT train_n, run, count(*) AS n FROM FS GROUP BY ALL)",
           "W0 AS (SELECT train_n, run, f, intent AS class, 0.0 AS w FROM SX WHERE false)"]
    for i in range(ITERATIONS):
        out += [f"""Z{i} AS (SELECT a.train_n, a.run, a.intent, a.pos, SC.class, coalesce(z, 0) AS z FROM FS a
      JOIN SC ON SC.train_n = a.train_n AND SC.run = a.run LEFT JOIN (
        SELECT s.train_n, s.run, s.intent, s.pos, class, sum(x * w) AS z FROM SX s JOIN W{i} v
        ON v.train_n = s.train_n AND v.run = s.run AND v.f = s.f GROUP BY ALL) b
      ON b.train_n = a.train_n AND b.run = a.run AND b.intent = a.intent AND b.pos = a.pos AND b.class = SC.class)""",
                f"""R{i} AS (SELECT train_n, run, intent, pos, class, exp(z - max(z) OVER q) / sum(exp(z)) OVER q * exp(max(z) OVER q)
      - CASE WHEN class = intent THEN 1 ELSE 0 END AS r FROM Z{i} WINDOW q AS (PARTITION BY train_n, run, intent, pos))""",
                f"""W{i + 1} AS (SELECT train_n, run, f, class, sum(w) AS w FROM (
        SELECT train_n, run, f, class, w * (1 - {RATE} * {DECAY}) AS w FROM W{i} UNION ALL
        SELECT s.train_n, s.run, f, class, -{RATE} * sum(x * r) / any_value(n) FROM SX s
        JOIN R{i} USING (train_n, run, intent, pos) JOIN SN USING (train_n, run) GROUP BY s.train_n, s.run, f, class) u GROUP BY ALL)"""]
    return out


Q["softmax_predict"] = (w(P, fewshot(src="P"), GRID, CAND.replace("L.", "P.").replace("FROM L,", "FROM P,"), *softmax_steps()) + """
, ZC AS (SELECT C.train_n, C.run, C.intent, C.pos, SC.class, coalesce(z, 0) AS z FROM C
   JOIN SC ON SC.train_n = C.train_n AND SC.run = C.run LEFT JOIN (
     SELECT c.train_n, c.run, c.intent, c.pos, class, sum(x * w) AS z FROM C c JOIN FX ON FX.t = c.text
     JOIN W4 v ON v.train_n = c.train_n AND v.run = c.run AND v.f = FX.f GROUP BY ALL) b
   ON b.train_n = C.train_n AND b.run = C.run AND b.intent = C.intent AND b.pos = C.pos AND b.class = SC.class)
, PC AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY train_n, run, intent, pos) AS p FROM ZC)
SELECT train_n, run, intent, pos, class AS pred, round(p, 6) AS conf FROM (
  SELECT *, row_number() OVER (PARTITION BY train_n, run, intent, pos ORDER BY round(z, 9) DESC, class) AS k FROM PC) x
WHERE k = 1""")

TRI = [*NB, """NEAR AS (SELECT * FROM (SELECT C.train_n, C.run, C.pos, f.pos AS origin_pos, levenshtein(C.text, f.text) AS dist,
    row_number() OVER (PARTITION BY C.train_n, C.run, C.pos ORDER BY levenshtein(C.text, f.text), f.pos) AS r
  FROM C JOIN FS f ON f.train_n = C.train_n AND f.run = C.run AND f.intent = C.intent) a WHERE r = 1)""",
       f"""TR AS (SELECT NBP.train_n, NBP.run, NBP.intent, NBP.text, NBP.pos, NEAR.origin_pos, NEAR.dist, NBP.pred, NBP.conf,
  CASE WHEN NBP.pred <> NBP.intent THEN 'error' WHEN NBP.conf < {T} THEN 'low cs' ELSE 'success' END AS category
  FROM NBP JOIN NEAR ON NEAR.train_n = NBP.train_n AND NEAR.run = NBP.run AND NEAR.pos = NBP.pos)"""]

Q["triage"] = w(*TRI) + f"""SELECT train_n, run, intent, pos, origin_pos, CAST(dist AS BIGINT) AS dist, pred,
  {r6(['conf'])}, category FROM TR"""

Q["best_per_origin"] = w(*TRI) + """SELECT train_n, run, intent, text, pos, false AS picked FROM FS
UNION ALL SELECT train_n, run, intent, text, pos, true AS picked FROM (
  SELECT *, row_number() OVER (PARTITION BY train_n, run, origin_pos
      ORDER BY (category = 'error') DESC, dist DESC NULLS LAST, pos) AS r
  FROM TR WHERE category IN ('error', 'low cs')) a WHERE r = 1"""

Q["avg_growth"] = w(L, fewshot(), GRID, CAND, DIST) + f"""
, FAR AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY train_n, run, intent
    ORDER BY dist DESC NULLS LAST, pos, text) AS rk FROM D) x WHERE rk <= {K})
, GR AS (SELECT train_n, run, count(*) AS sz FROM (SELECT DISTINCT train_n, run, intent, text FROM (
    SELECT train_n, run, intent, text FROM FS UNION ALL SELECT train_n, run, intent, text FROM FAR) u) x
  GROUP BY train_n, run)
SELECT train_n, round(avg(sz - train_n * (SELECT count(DISTINCT intent) FROM L)), 6) AS avg_new_examples
FROM GR GROUP BY train_n"""

# --- corpus files ------------------------------------------------------------------------

Q["corpus_scan"] = w(L) + r"""SELECT intent, t AS text FROM (
  SELECT intent, unnest(string_split(replace(replace(replace(regexp_replace(text, '\([^)]*\)', '', 'g'),
         '[', ''), ']', ''), ' -', ' '), '- ')) AS t FROM L) x WHERE t <> ''"""

Q["raw_scan"] = w(L) + """SELECT intent, t AS raw FROM (
  SELECT intent, unnest(string_split(text, '- ')) AS t FROM L) x WHERE t <> ''"""

ENT = r"'\[[^)]*\]\([^)]*\)'"
Q["entity_extract"] = w(P) + f"""
, PR AS (SELECT intent, pos, regexp_replace(text, ' (\\S+)$', ' [\\1](item)') AS raw FROM P)
, M AS (SELECT intent, pos, unnest(regexp_extract_all(raw, {ENT})) AS entity,
          unnest(range(0, len(regexp_extract_all(raw, {ENT})))) AS i FROM PR)
, FI AS (SELECT intent, entity, min(pos * 100 + i) AS f FROM M GROUP BY intent, entity)
SELECT intent, entity, replace(replace(regexp_replace(entity, '\\([^)]*\\)', '', 'g'), '[', ''), ']', '') AS surface,
  regexp_replace(regexp_replace(entity, '\\[[^)]*\\]', '', 'g'), '^\\(|\\)$', '', 'g') AS etype,
  CAST(row_number() OVER (PARTITION BY intent ORDER BY f) AS BIGINT) AS ord FROM FI"""

# --- evaluation outputs round trips -------------------------------------------------------

Q["prediction_scan"] = w(*NCTE) + f"""SELECT train_n, run, text, intent, pred, {r6(['conf'])},
  CASE WHEN pred <> intent THEN 'error' ELSE 'success' END AS outcome FROM N"""

CONFUSED = """CF AS (SELECT train_n, run, intent, string_agg(confused, ',' ORDER BY confused) AS confused FROM (
  SELECT *, row_number() OVER (PARTITION BY train_n, run, intent ORDER BY n DESC, confused) AS rk FROM (
    SELECT train_n, run, intent, pred AS confused, count(*) AS n
    FROM (SELECT DISTINCT train_n, run, text, intent, pred FROM N) a WHERE pred <> intent
    GROUP BY train_n, run, intent, pred) b) c WHERE rk <= 3 GROUP BY train_n, run, intent)"""

Q["report_scan"] = w(*NCTE, report("N", KN), CONFUSED) + f"""SELECT r.train_n, r.run, r.intent,
  {', '.join(f'round(r.{c}, 6) AS {c}' for c in ['precision', 'recall', 'f1'])}, r.support, cf.confused
FROM RPT r LEFT JOIN CF cf ON cf.train_n = r.train_n AND cf.run = r.run AND cf.intent = r.intent"""

Q["report_totals_scan"] = w(*NCTE, report("N", KN), totals("RPT", KN)) + (
    f"SELECT train_n, run, {r6(['accuracy', 'macro_f1', 'weighted_precision', 'weighted_recall', 'weighted_f1'])}, support FROM TOT")

Q["filter_scan"] = w(*NCTE) + f"SELECT train_n, run, intent, text FROM N WHERE pred <> intent OR conf < {T}"

Q["grid_scan"] = w(V) + """SELECT 'repository' AS dataset, 'augment_and_human' AS exp_type, train_n, run, loop,
  CAST(count(*) AS BIGINT) AS n FROM V GROUP BY train_n, run, loop"""

Q["results_csv"] = w(*NCTE, report("N", KN)) + (
    f"SELECT train_n, run, intent, {r6(['precision', 'recall', 'f1'])}, support, tp FROM RPT")

# --- EXP on P -------------------------------------------------------------------------------

TOKP = """TOK AS (SELECT intent, pos, unnest(string_split(text, ' ')) AS token,
  unnest(range(0, len(string_split(text, ' ')))) AS tok_pos FROM P)"""
LEX = f"""LEX AS (SELECT token AS word, min(CASE WHEN tok_pos = 0 THEN 'VERB' ELSE 'NOUN' END) AS upos,
  {lemma_sql('token')} AS lemma FROM TOK GROUP BY token)"""
SYN = """SYN AS (SELECT DISTINCT a.token AS word, b.token AS synonym, 1 AS rank
  FROM (SELECT DISTINCT intent, tok_pos, token FROM TOK) a
  JOIN (SELECT DISTINCT intent, tok_pos, token FROM TOK) b ON a.intent = b.intent AND a.tok_pos = b.tok_pos)"""
SL = """SL AS (SELECT word, synonym, row_number() OVER (PARTITION BY word ORDER BY synonym) - 1 AS r,
  count(*) OVER (PARTITION BY word) AS sz FROM SYN)"""
COMBO = """CB AS (SELECT t0.intent, t0.pos, CAST(a.r * b.sz + b.r AS BIGINT) AS idx, a.synonym || ' ' || b.synonym AS text
  FROM TOK t0 JOIN TOK t1 ON t1.intent = t0.intent AND t1.pos = t0.pos AND t0.tok_pos = 0 AND t1.tok_pos = 1
  JOIN SL a ON a.word = t0.token JOIN SL b ON b.word = t1.token)"""

Q["token_tags"] = w(P, TOKP, LEX) + """SELECT t.intent, t.pos, CAST(t.tok_pos AS BIGINT) AS tok_pos, t.token, l.upos, l.lemma
FROM TOK t LEFT JOIN LEX l ON l.word = t.token"""

Q["replaceable"] = w(P, TOKP, LEX) + """SELECT m.mode, t.intent, t.pos, CAST(t.tok_pos AS BIGINT) AS tok_pos, t.token,
  CASE m.mode WHEN 'verb' THEN l.upos = 'VERB' WHEN 'noun' THEN l.upos = 'NOUN'
              ELSE l.upos IN ('VERB', 'NOUN') END AS replaceable
FROM TOK t LEFT JOIN LEX l ON l.word = t.token, (SELECT unnest(['verb', 'noun', 'verb_and_noun']) AS mode) m"""

Q["synonym_tables"] = w(P, TOKP, SYN) + "SELECT word, synonym, CAST(rank AS BIGINT) AS rank FROM SYN"

Q["vector_table"] = w(E) + """SELECT text AS word, CAST(len(vec) AS BIGINT) AS dim,
  round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) AS v1, round(1.0, 6) AS norm2 FROM E"""

Q["lexical_synonyms"] = w(P, TOKP, SYN) + """SELECT t.token, s.synonym, CAST(s.rank AS BIGINT) AS rank
FROM (SELECT DISTINCT token FROM TOK) t LEFT JOIN SYN s ON s.word = t.token"""

Q["synonym_guard"] = w(P, TOKP, SYN) + f"""SELECT token, CASE WHEN lower(token) IN ({', '.join(repr(x) for x in config.WH_WORDS)})
  THEN token ELSE coalesce(syns, token) END AS syns FROM (
  SELECT t.token, string_agg(s.synonym, ',' ORDER BY s.rank, s.synonym) AS syns
  FROM (SELECT DISTINCT token FROM TOK) t LEFT JOIN SYN s ON s.word = t.token GROUP BY t.token) x"""

Q["vector_synonyms"] = w(E) + """SELECT token, synonym, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS sim FROM (
  SELECT a.text AS token, b.text AS synonym,
    list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) AS sim,
    row_number() OVER (PARTITION BY a.text ORDER BY list_dot_product(a.vec, b.vec)
        / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) DESC, b.text) AS rank
  FROM E a JOIN E b ON a.text <> b.text) x WHERE rank <= 3"""

Q["vector_recall"] = "SELECT true AS enough, count(*) AS words FROM embeddings"

Q["combinations"] = w(P, TOKP, SYN, SL, COMBO) + "SELECT intent, pos, idx, text FROM CB"

Q["provenance"] = w(P, TOKP, SYN, SL, COMBO) + """SELECT intent, text, min(origin_pos) AS origin_pos FROM (
  SELECT intent, text, pos AS origin_pos FROM P UNION ALL SELECT intent, text, pos FROM CB) u GROUP BY intent, text"""

# --- pairs, paraphrases ------------------------------------------------------------------------

PAIRS = """PR0 AS (
  SELECT 'conversations' AS source, 'paraphrase' AS prefix, u.text AS input_text, a.text AS target_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
  UNION ALL
  SELECT 'part', 'paraphrase', text, b FROM (
    SELECT text, lead(text) OVER (PARTITION BY intent ORDER BY md5(concat_ws('|', '7', text)), text) AS b FROM P) x
  WHERE b IS NOT NULL),
PR AS (SELECT * FROM PR0 WHERE input_text IS NOT NULL AND target_text IS NOT NULL)"""


def detok(c: str) -> str:
    out = c
    for a, b in config.DETOKENISE:
        out = f"replace({out}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return out


PRC = f"""PRC AS (SELECT source, prefix, {detok('input_text')} AS input_text, {detok('target_text')} AS target_text FROM PR)"""

Q["pairs_build"] = w(P, PAIRS) + "SELECT source, prefix, input_text, target_text FROM PR"
Q["pairs_clean"] = w(P, PAIRS, PRC) + "SELECT source, prefix, input_text, target_text FROM PRC"
Q["pairs_split"] = w(P, PAIRS, PRC) + f"""SELECT source, input_text, target_text,
  CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', input_text, target_text)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.25
       THEN 'test' ELSE 'train' END AS split FROM PRC"""

PARA = f"""G AS (SELECT intent, pos, text, string_split(text, ' ') AS t FROM P),
NL AS (SELECT DISTINCT len(string_split(input_text, ' ')) AS n FROM PRC),
NG AS (SELECT intent, pos, t, s, n, array_to_string(t[s + 1:s + n], ' ') AS g FROM (
  SELECT G.*, n, unnest(range(0, greatest(len(t) - n + 1, 0))) AS s FROM G, NL) z),
PM AS (SELECT NG.*, p.target_text, row_number() OVER (PARTITION BY intent, pos ORDER BY n DESC, s, p.target_text) AS k_i
  FROM NG JOIN (SELECT DISTINCT input_text, target_text FROM PRC) p ON p.input_text = NG.g),
PP AS (SELECT intent, pos, CAST(k_i AS BIGINT) AS k_i,
  concat_ws(' ', CASE WHEN s > 0 THEN array_to_string(t[1:s], ' ') END, target_text,
            CASE WHEN s + n < len(t) THEN array_to_string(t[s + n + 1:], ' ') END) AS pred
  FROM PM WHERE k_i <= {config.PARAPHRASES_PER_INPUT})"""

Q["paraphrase_pairs"] = w(P, PAIRS, PRC, PARA) + "SELECT intent, pos, k_i, pred FROM PP"

Q["paraphrase_clean"] = r"""WITH U AS (SELECT u.conv_id, u.turn, u.text, a.text AS reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
X AS (SELECT conv_id, turn, text, unnest([reply, lower(replace(replace(replace(text, '?', ''), '.', ''), ',', '')), text]) AS pred,
             unnest([1, 2, 3]) AS k_i FROM U),
D AS (SELECT conv_id, turn, text, pred, min(k_i) AS k_i FROM X GROUP BY conv_id, turn, text, pred)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(k_i AS BIGINT) AS k_i,
  trim(regexp_replace(pred, '[^\x01-\x7F]', '', 'g')) AS pred FROM D
WHERE pred <> text AND lower(replace(replace(replace(pred, '?', ''), '.', ''), ',', ''))
                    <> lower(replace(replace(replace(text, '?', ''), '.', ''), ',', ''))"""

Q["assemble"] = w(P, PAIRS, PRC, PARA) + r"""SELECT intent, text, pos AS origin_pos, 'original' AS gen_step FROM P
UNION ALL SELECT intent, trim(regexp_replace(pred, '[^\x01-\x7F]', '', 'g')), pos, 'paraphrase' FROM (
  SELECT PP.intent, PP.pos, PP.pred, min(PP.k_i) AS k_i, P.text FROM PP JOIN P ON P.intent = PP.intent AND P.pos = PP.pos
  GROUP BY PP.intent, PP.pos, PP.pred, P.text) x
WHERE pred <> text AND lower(replace(replace(replace(pred, '?', ''), '.', ''), ',', ''))
                    <> lower(replace(replace(replace(text, '?', ''), '.', ''), ',', ''))"""

# --- entities ----------------------------------------------------------------------------------

PENT = """PE AS (SELECT intent, e AS entity, min(pos * 10 + k) AS ord FROM (
  SELECT intent, pos, 0 AS k, '[' || split_part(text, ' ', 1) || '/' || split_part(text, ' ', 2) || '](item)' AS e FROM P
  UNION ALL SELECT intent, pos, 1, '[' || upper(left(split_part(text, ' ', 1), 1)) || lower(substr(split_part(text, ' ', 1), 2))
      || upper(left(split_part(text, ' ', 2), 1)) || lower(substr(split_part(text, ' ', 2), 2)) || '](Thing)' FROM P
  UNION ALL SELECT intent, pos, 2, '[' || split_part(text, ' ', 2) || '.java](file)' FROM P) x GROUP BY intent, e)"""

DATE = " OR ".join(f"lower(entity) LIKE '%{m}%'" for m in list(config.MONTH_NAMES) + list(config.MONTH_SHORT))

Q["entity_variants"] = w(P, PENT) + f"""SELECT intent, ord, CAST(vord AS BIGINT) AS vord, variant FROM (
  SELECT intent, ord, 0 AS vord, entity AS variant FROM PE
  UNION ALL SELECT intent, ord, 1, replace(entity, '/', ' ') FROM PE WHERE entity LIKE '%/%'
  UNION ALL SELECT intent, ord, 2, replace(entity, '/', '-') FROM PE WHERE entity LIKE '%/%'
  UNION ALL SELECT intent, ord, 3, array_to_string(regexp_extract_all(entity, '[A-Z][a-z]*'), ' ')
      || regexp_extract(entity, '(\\([^)]*\\))', 1) FROM PE
      WHERE len(regexp_extract_all(entity, '[A-Z][a-z]*')) > 0 AND NOT ({DATE})
  UNION ALL SELECT intent, ord, 4, replace(entity, '.java', ' .java') FROM PE WHERE entity LIKE '%.java%'
  UNION ALL SELECT intent, ord, 5, replace(entity, '.java', '. java') FROM PE WHERE entity LIKE '%.java%') x"""

Q["mentions"] = w(L) + f"""
, WC AS (SELECT intent, w, count(*) AS c FROM (SELECT intent, unnest({TOKS.format(t='text')}) AS w FROM L) a
         WHERE length(w) >= 5 GROUP BY intent, w)
, TOPW AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY c DESC, w) AS o FROM WC) b WHERE o <= 5)
SELECT * FROM (SELECT L.intent, L.pos, t.w AS surface, '(kw)' AS etype,
  CAST((length(lower(L.text)) - length(replace(lower(L.text), t.w, ''))) / length(t.w) AS BIGINT) AS n
  FROM L JOIN TOPW t ON t.intent = L.intent) x WHERE n > 0"""

Q["mention_spans"] = w(L).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, WC AS (SELECT intent, w, count(*) AS c FROM (SELECT intent, unnest({TOKS.format(t='text')}) AS w FROM L) a
         WHERE length(w) >= 5 GROUP BY intent, w)
, TOPW AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY c DESC, w) AS o FROM WC) b WHERE o <= 5)
, BOTH_ AS (SELECT intent, w AS s, '(kw)' AS etype, o FROM TOPW
            UNION ALL SELECT intent, left(w, 4), '(start)', o + 5 FROM TOPW)
, ONE AS (SELECT intent, s, min_by(etype, o) AS etype, min(o) AS o FROM BOTH_ GROUP BY intent, s)
, SF AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY length(s) DESC, o) AS k FROM ONE)
, R AS (SELECT intent, pos, text, lower(text) AS cur, 0 AS k, CAST([] AS BIGINT[]) AS starts, '' AS s, '' AS etype FROM L
        UNION ALL
        SELECT R.intent, pos, text, replace(cur, SF.s, repeat(chr(1), length(SF.s))), SF.k,
          list_transform(range(1, len(string_split(cur, SF.s))), lambda i: CAST(
            list_sum(list_transform(string_split(cur, SF.s)[1:i], lambda x: length(x))) + (i - 1) * length(SF.s) AS BIGINT)),
          SF.s, SF.etype
        FROM R JOIN SF ON SF.intent = R.intent AND SF.k = R.k + 1)
, H AS (SELECT intent, pos, text, unnest(starts) AS start, s, etype FROM R WHERE k > 0)
SELECT intent, pos, start, start + length(s) AS stop, substr(text, start + 1, length(s)) AS mention, s AS surface, etype FROM H"""

Q["annotate"] = w(P) + """SELECT intent, pos,
  '[' || split_part(text, ' ', 1) || '](adj) [' || split_part(text, ' ', 2) || '](item)' AS annotated FROM P"""

# --- experiment modes on P --------------------------------------------------------------------

PL = "L AS (SELECT intent, text, pos FROM P)"


def lemma_text(src: str, name: str) -> str:
    """Rule-lemmatised text per (train_n, run, intent, text) of ``src``."""
    return f"""{name} AS (SELECT train_n, run, intent, text, string_agg(lem, ' ' ORDER BY i) AS lemma FROM (
  SELECT train_n, run, intent, text, i, {lemma_sql('tok')} AS lem FROM (
    SELECT train_n, run, intent, text, unnest(string_split(text, ' ')) AS tok,
           unnest(range(0, len(string_split(text, ' ')))) AS i FROM (SELECT DISTINCT train_n, run, intent, text FROM {src}) a) b) c
  GROUP BY train_n, run, intent, text)"""


def nb_chain(train: str, cand: str, p: str) -> list[str]:
    """Naive Bayes trained on ``train`` (train_n, run, intent, text) scoring
    ``cand`` (train_n, run, intent, text, pos; distinct texts); result
    {p}NBP(train_n, run, intent, text, pos, pred, conf)."""
    tk = TOKS.format(t="text")
    return [
        f"{p}TK AS (SELECT train_n, run, intent, unnest({tk}) AS token FROM {train})",
        f"{p}CNT AS (SELECT train_n, run, intent, token, count(*) AS n FROM {p}TK GROUP BY train_n, run, intent, token)",
        f"{p}VOC AS (SELECT train_n, run, count(DISTINCT token) AS v FROM {p}CNT GROUP BY train_n, run)",
        f"{p}NC AS (SELECT train_n, run, intent, sum(n) AS nc FROM {p}CNT GROUP BY train_n, run, intent)",
        f"{p}DC AS (SELECT train_n, run, intent, count(*) AS d FROM {train} GROUP BY train_n, run, intent)",
        f"""{p}CLS AS (SELECT DC.train_n, DC.run, DC.intent,
  ln(DC.d / sum(DC.d) OVER (PARTITION BY DC.train_n, DC.run)) AS logprior,
  ln(coalesce(NC.nc, 0) + coalesce(VOC.v, 0)) AS dlog
  FROM {p}DC DC LEFT JOIN {p}NC NC ON NC.train_n = DC.train_n AND NC.run = DC.run AND NC.intent = DC.intent
  LEFT JOIN {p}VOC VOC ON VOC.train_n = DC.train_n AND VOC.run = DC.run)""",
        f"{p}CT AS (SELECT train_n, run, intent, text, unnest({tk}) AS token FROM {cand})",
        f"""{p}CTV AS (SELECT CT.* FROM {p}CT CT WHERE EXISTS (SELECT 1 FROM {p}CNT CNT WHERE CNT.train_n = CT.train_n
  AND CNT.run = CT.run AND CNT.token = CT.token))""",
        f"{p}TT AS (SELECT train_n, run, intent, text, count(*) AS t FROM {p}CTV GROUP BY train_n, run, intent, text)",
        f"""{p}SS AS (SELECT CTV.train_n, CTV.run, CTV.intent, CTV.text, CNT.intent AS cls, sum(ln(CNT.n + 1)) AS s
  FROM {p}CTV CTV JOIN {p}CNT CNT ON CNT.train_n = CTV.train_n AND CNT.run = CTV.run AND CNT.token = CTV.token
  GROUP BY CTV.train_n, CTV.run, CTV.intent, CTV.text, CNT.intent)""",
        f"""{p}SC AS (SELECT C.train_n, C.run, C.intent, C.text, C.pos, CLS.intent AS cls,
  CLS.logprior - coalesce(TT.t, 0) * CLS.dlog + coalesce(SS.s, 0) AS s
  FROM {cand} C JOIN {p}CLS CLS ON CLS.train_n = C.train_n AND CLS.run = C.run
  LEFT JOIN {p}TT TT ON TT.train_n = C.train_n AND TT.run = C.run AND TT.intent = C.intent AND TT.text = C.text
  LEFT JOIN {p}SS SS ON SS.train_n = C.train_n AND SS.run = C.run AND SS.intent = C.intent AND SS.text = C.text
       AND SS.cls = CLS.intent)""",
        f"""{p}SM AS (SELECT train_n, run, intent, text, max(s) AS ms FROM {p}SC GROUP BY train_n, run, intent, text)""",
        f"""{p}NBP AS (SELECT SC.train_n, SC.run, SC.intent, SC.text, SC.pos,
  min(CASE WHEN SC.s = SM.ms THEN SC.cls END) AS pred, 1.0 / sum(exp(SC.s - SM.ms)) AS conf
  FROM {p}SC SC JOIN {p}SM SM ON SM.train_n = SC.train_n AND SM.run = SC.run AND SM.intent = SC.intent AND SM.text = SC.text
  GROUP BY SC.train_n, SC.run, SC.intent, SC.text, SC.pos)"""]


def filter_chain(train: str, new: str, p: str) -> list[str]:
    """RUN-2 without the merge: result {p}TOP(train_n, run, intent, text, pos)."""
    return [f"""{p}CD AS (SELECT train_n, run, intent, text, min(origin_pos) AS pos FROM {new}
  GROUP BY train_n, run, intent, text)""",
            *nb_chain(train, f"{p}CD", p),
            f"{p}KEPT AS (SELECT * FROM {p}NBP WHERE pred <> intent OR conf < {T})",
            lemma_text(f"{p}KEPT", f"{p}LC"), lemma_text(train, f"{p}LO"),
            f"""{p}DI AS (SELECT k.train_n, k.run, k.intent, k.text, k.pos, k.pred <> k.intent AS is_error,
    min(levenshtein(lc.lemma, lo.lemma)) AS dist
  FROM {p}KEPT k JOIN {p}LC lc ON lc.train_n = k.train_n AND lc.run = k.run AND lc.intent = k.intent AND lc.text = k.text
  LEFT JOIN {p}LO lo ON lo.train_n = k.train_n AND lo.run = k.run AND lo.intent = k.intent
  GROUP BY k.train_n, k.run, k.intent, k.text, k.pos, k.pred)""",
            f"""{p}TOP AS (SELECT train_n, run, intent, text, pos FROM (SELECT *, row_number() OVER (
  PARTITION BY train_n, run, intent ORDER BY dist DESC NULLS LAST, is_error DESC, pos, text) AS rk FROM {p}DI) x WHERE rk <= {K})"""]


MODE_BASE = [P, PL, fewshot(), GRID, TOKP, LEX, SYN, SL, PAIRS, PRC,
             """STAGE AS (SELECT train_n, run, intent, text, pos AS origin_pos FROM FS
  UNION ALL SELECT FS.train_n, FS.run, FS.intent, a.synonym || ' ' || split_part(FS.text, ' ', 2), FS.pos
  FROM FS JOIN SL a ON a.word = split_part(FS.text, ' ', 1))""",
             """INP AS (SELECT train_n, run, intent, text, min(origin_pos) AS origin_pos FROM STAGE
  GROUP BY train_n, run, intent, text)""",
             """NL AS (SELECT DISTINCT len(string_split(input_text, ' ')) AS n FROM PRC)""",
             """NG2 AS (SELECT *, array_to_string(t[s + 1:s + n], ' ') AS g FROM (
  SELECT INP.*, n, string_split(text, ' ') AS t,
    unnest(range(0, greatest(len(string_split(text, ' ')) - n + 1, 0))) AS s FROM INP, NL) z)""",
             f"""PM2 AS (SELECT NG2.*, p.target_text, row_number() OVER (PARTITION BY train_n, run, intent, text
    ORDER BY n DESC, s, p.target_text) AS k_i
  FROM NG2 JOIN (SELECT DISTINCT input_text, target_text FROM PRC) p ON p.input_text = NG2.g)""",
             f"""PP2 AS (SELECT train_n, run, intent, text, origin_pos, k_i,
  concat_ws(' ', CASE WHEN s > 0 THEN array_to_string(t[1:s], ' ') END, target_text,
            CASE WHEN s + n < len(t) THEN array_to_string(t[s + n + 1:], ' ') END) AS pred
  FROM PM2 WHERE k_i <= {config.PARAPHRASES_PER_INPUT})""",
             r"""PARA AS (SELECT train_n, run, intent, trim(regexp_replace(pred, '[^\x01-\x7F]', '', 'g')) AS text, origin_pos
  FROM (SELECT train_n, run, intent, text, pred, min(k_i) AS k_i, min(origin_pos) AS origin_pos FROM PP2
        GROUP BY train_n, run, intent, text, pred) x
  WHERE pred <> text AND lower(replace(replace(replace(pred, '?', ''), '.', ''), ',', ''))
                      <> lower(replace(replace(replace(text, '?', ''), '.', ''), ',', '')))""",
             """CANDS AS (SELECT train_n, run, intent, text, pos AS origin_pos FROM FS
  UNION ALL SELECT train_n, run, intent, text, origin_pos FROM PARA)""",
             """HP AS (SELECT g.train_n, g.run, P.intent, P.text, P.pos FROM P, GRID g)"""]

OUT = "SELECT DISTINCT train_n, run, intent, text FROM "

Q["mode_baseline"] = w(P, fewshot("P")) + """SELECT train_n, run, intent, text,
  split_part(text, ' ', 1) || ' [' || split_part(text, ' ', 2) || '](item)' AS annotated FROM FS"""

Q["mode_human"] = w(P, fewshot("P"), GRID, MODE_BASE[-1]) + OUT + """(
  SELECT train_n, run, intent, text FROM FS UNION ALL SELECT train_n, run, intent, text FROM HP) u"""

Q["mode_augment"] = w(*MODE_BASE) + OUT + "CANDS"

Q["filter_chain"] = w(*MODE_BASE, *filter_chain("FS", "CANDS", "F1")) + OUT + """(
  SELECT train_n, run, intent, text FROM FS UNION ALL SELECT train_n, run, intent, text FROM F1TOP) u"""

Q["mode_mixed"] = w(*MODE_BASE, *filter_chain("FS", "CANDS", "F1"),
                    """FILT AS (SELECT DISTINCT train_n, run, intent, text FROM (
  SELECT train_n, run, intent, text FROM FS UNION ALL SELECT train_n, run, intent, text FROM F1TOP) u)""",
                    f"""ONE AS (SELECT train_n, run, intent, text FROM (SELECT h.*, row_number() OVER (
    PARTITION BY train_n, run, intent ORDER BY md5(concat_ws('|', '{SEED}', text)), text) AS r
  FROM HP h WHERE NOT EXISTS (SELECT 1 FROM FILT f WHERE f.train_n = h.train_n AND f.run = h.run
                              AND f.intent = h.intent AND f.text = h.text)) x WHERE r = 1)""") + OUT + """(
  SELECT * FROM FILT UNION ALL SELECT * FROM ONE) u"""

Q["mode_inspired"] = w(*MODE_BASE,
                       f"""INS AS (SELECT train_n, run, intent, text, pos FROM (SELECT h.*, row_number() OVER (
    PARTITION BY train_n, run, intent ORDER BY md5(concat_ws('|', '{SEED}', text)), text) AS r
  FROM HP h WHERE NOT EXISTS (SELECT 1 FROM FS f WHERE f.train_n = h.train_n AND f.run = h.run
                              AND f.intent = h.intent AND f.text = h.text)) x WHERE r <= {config.LIMIT_PER_INTENT})""",
                       """NEWC AS (SELECT c.* FROM CANDS c WHERE NOT EXISTS (SELECT 1 FROM FS f WHERE f.train_n = c.train_n
  AND f.run = c.run AND f.intent = c.intent AND f.text = c.text))""",
                       *filter_chain("INS", "NEWC", "F2")) + OUT + """(
  SELECT train_n, run, intent, text FROM F2TOP UNION ALL SELECT train_n, run, intent, text FROM FS) u"""

# --- triage by provenance, checked pair files ---------------------------------------------------

LINEAGE = [*MODE_BASE, """GCD AS (SELECT train_n, run, intent, text, min(origin_pos) AS pos FROM CANDS
  GROUP BY train_n, run, intent, text)""", *nb_chain("FS", "GCD", "G"), lemma_text("GCD", "GLC"), lemma_text("FS", "GLO"),
           f"""GT AS (SELECT p.train_n, p.run, p.intent, p.text, p.pos AS origin_pos, levenshtein(lc.lemma, lo.lemma) AS dist,
    p.pred, p.conf, CASE WHEN p.pred <> p.intent THEN 'error' WHEN p.conf < {T} THEN 'low cs' ELSE 'success' END AS category
  FROM GNBP p JOIN FS o ON o.train_n = p.train_n AND o.run = p.run AND o.intent = p.intent AND o.pos = p.pos
  JOIN GLC lc ON lc.train_n = p.train_n AND lc.run = p.run AND lc.intent = p.intent AND lc.text = p.text
  JOIN GLO lo ON lo.train_n = o.train_n AND lo.run = o.run AND lo.intent = o.intent AND lo.text = o.text
  WHERE p.text <> o.text)"""]

Q["triage_lineage"] = w(*LINEAGE) + """SELECT train_n, run, intent, text, origin_pos, CAST(dist AS BIGINT) AS dist, pred,
  round(conf, 6) AS conf, category FROM GT"""

Q["best_lineage"] = w(*LINEAGE) + """SELECT train_n, run, intent, text, pos, false AS picked FROM FS
UNION ALL SELECT train_n, run, intent, text, origin_pos, true FROM (
  SELECT *, row_number() OVER (PARTITION BY train_n, run, intent, origin_pos
    ORDER BY category = 'error' DESC, dist DESC, text) AS r FROM GT WHERE category <> 'success') x WHERE r = 1"""

Q["pairs_scan"] = w(P, PAIRS) + r"""
, S AS (SELECT translate(input_text, chr(10) || chr(9) || '"', '   ') AS a, translate(target_text, chr(10) || chr(9) || '"', '   ') AS b
        FROM PR)
, F AS (SELECT unnest(['tsv', 'csv']) AS source)
SELECT source, 'kept' AS channel, count(*) AS n, CAST(sum(length(a) + length(b)) AS BIGINT) AS chars
FROM S, F WHERE length(a) % 4 <> 0 GROUP BY source
UNION ALL SELECT source, 'malformed', count(*), CAST(sum(length(CAST(length(a) AS VARCHAR)) + 20) AS BIGINT)
FROM S, F WHERE length(b) % 5 = 0 GROUP BY source"""

Q["paraphrase_model"] = w(P, PAIRS, PRC) + f"""
, PT AS (SELECT input_text, target_text, ln(count(*) / sum(count(*)) OVER (PARTITION BY input_text)) AS lw
         FROM PRC GROUP BY input_text, target_text)
, T AS (SELECT intent, pos, text, string_split(text, ' ')[1] AS a, string_split(text, ' ')[2] AS b FROM P)
, O AS (SELECT DISTINCT a AS tok, a AS target, ln(0.5) AS lw FROM T UNION ALL SELECT DISTINCT b, b, ln(0.5) FROM T
        UNION ALL SELECT input_text, target_text, lw FROM PT)
, PATHS AS (SELECT intent, pos, x.target || ' ' || y.target AS pred, x.lw + y.lw AS lw
            FROM T JOIN (SELECT DISTINCT * FROM O) x ON x.tok = a JOIN (SELECT DISTINCT * FROM O) y ON y.tok = b
            UNION ALL SELECT intent, pos, target_text, PT.lw FROM T JOIN PT ON input_text = text)
, B AS (SELECT intent, pos, pred, max(lw) AS lw FROM PATHS GROUP BY ALL)
SELECT intent, pos, k_i, pred FROM (SELECT *, row_number() OVER (PARTITION BY intent, pos ORDER BY round(lw, 9) DESC, pred) AS k_i
  FROM B) x WHERE k_i <= {config.PARAPHRASES_PER_INPUT}"""

Q["mode_entities"] = " UNION ALL ".join(
    # marked where some name of the intent has the item
    f"SELECT '{mode}' AS mode, train_n, run, intent, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_type = intent "
    f"AND split_part(p_name, ' ', 2) = split_part(text, ' ', 2)) THEN split_part(text, ' ', 1) || ' [' || "
    f"split_part(text, ' ', 2) || '](item)' ELSE text END AS raw FROM ({Q[key]}) q_{key}" for mode, key in (
        ("human", "mode_human"), ("augment_and_human", "mode_mixed"), ("human_inspired", "mode_inspired")))
