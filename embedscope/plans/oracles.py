"""DuckDB SQL for the registered queries (independent oracle).

Written directly from the definitions (pairs are enumerated, means are
averaged, ranks are window functions) so that it does not share the
shortcuts of the Spark plans.  Vectors are cast to DOUBLE[] first and
floats are rounded to 6 digits.
"""

from __future__ import annotations

R = "round({x}, 6) + 0.0"


def r(x: str) -> str:
    return R.format(x=x)


# Common table expressions.
V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
PL = ("pl AS (SELECT id, list_transform(e, lambda x, i: CASE WHEN i - 1 = label THEN x + 2.0 "
      "ELSE x END) AS e, label FROM v)")
NORM = "sqrt(list_dot_product({a}, {a}))"


_TOKS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
_BUCKET = "CAST(('0x' || substr(md5({salt}{tok}), 1, 8)) AS BIGINT) % 64"

def dense_cte(src: str, keys: str, toks: str, salt: str = "", p: str = "d") -> str:
    """Dense 64-d hashed mean-pooled vectors ``{p}v`` of ``src`` rows keyed by ``keys``."""
    on = " AND ".join(f"c.{k} = s.{k}" for k in keys.split(", "))
    return f"""
{p}k AS (SELECT {keys}, unnest({toks}) AS tok FROM {src}),
{p}c AS (SELECT {keys}, {_BUCKET.format(salt=salt, tok='tok')} AS bucket, count(*) AS c FROM {p}k GROUP BY ALL),
{p}t AS (SELECT {keys}, sum(c) AS n FROM {p}c GROUP BY ALL),
{p}v AS (SELECT {', '.join('s.' + k for k in keys.split(', '))},
         list(coalesce(c.c / t.n, 0.0) ORDER BY b.b) AS e
       FROM {src} s CROSS JOIN range(64) b(b)
       LEFT JOIN {p}c c ON {on} AND c.bucket = b.b
       LEFT JOIN {p}t t ON {on.replace('c.', 't.')}
       GROUP BY ALL)"""


# Every document by the vector of its own text, five partial texts of each, and the
# benchmark texts.
DOCV = f"""{dense_cte('documents', 'doc_id', _TOKS)},
v AS MATERIALIZED (SELECT doc_id AS id, e, coalesce({_BUCKET.format(salt='', tok='lang')}, -1) AS label
      FROM dv JOIN documents USING (doc_id))"""
DOCRS = f"""pt AS (SELECT doc_id, (i - 1) % 5 AS rid, list(tok ORDER BY i) AS ts FROM (
        SELECT doc_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS i
        FROM (SELECT doc_id, {_TOKS} AS t FROM documents)) GROUP BY ALL),
{dense_cte('pt', 'doc_id, rid', 'ts', p='r')},
rs AS MATERIALIZED (SELECT doc_id AS id, rid, e FROM rv)"""
BENCHV = f"""{dense_cte('benchmark', 'item_id', _TOKS, p='b')},
cv AS MATERIALIZED (SELECT item_id AS id, e FROM bv)"""

def cos_raw(a: str, b: str) -> str:
    return f"(1.0 - list_dot_product({a}, {b}) / ({NORM.format(a=a)} * {NORM.format(a=b)}))"


def cos_lib(a: str, b: str) -> str:
    sim = (f"coalesce(list_dot_product({a}, {b}) / nullif({NORM.format(a=a)} * "
           f"{NORM.format(a=b)}, 0), 0.0)")
    return f"least(2.0, greatest(0.0, 1.0 - {sim}))"


def centres_cte(src: str, name: str = "c") -> str:
    """Element-wise mean per label (noise skipped)."""
    return (f"{name}_el AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, "
            f"unnest(generate_series(1, len(e))) AS i FROM {src} WHERE label <> -1) GROUP BY label, i), "
            f"{name} AS (SELECT label, list(x ORDER BY i) AS c, "
            f"(SELECT count(*) FROM {src} s WHERE s.label = q.label) AS n FROM {name}_el q GROUP BY label)")


def silhouette_sql(src: str, dist: str) -> str:
    """Exact silhouette by enumerating all ordered pairs."""
    return f"""
sp AS (SELECT a.id, a.label AS la, b.label AS lb, {dist} AS d
       FROM {src} a JOIN {src} b ON a.id <> b.id),
sl AS (SELECT id, la, lb, sum(d) / count(*) AS m FROM sp GROUP BY id, la, lb),
spt AS (SELECT id, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b
        FROM sl GROUP BY id),
sil AS (SELECT CASE WHEN (SELECT count(DISTINCT label) FROM {src}) >= 2 THEN
          avg(CASE WHEN a IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END)
        END AS silhouette FROM spt)"""


ORACLES: dict[str, str] = {}

ORACLES["manifold_score"] = f"""
WITH {DOCV}, {centres_cte('v')},
d AS (SELECT v.id, min({cos_raw('v.e', 'c.c')}) AS d FROM v, c GROUP BY v.id)
SELECT d.id, p.text AS prompt, {r('d.d')} AS manifold_distance,
       CAST(row_number() OVER (ORDER BY round(d.d, 12) DESC, d.id) AS BIGINT) AS rank
FROM d JOIN documents p ON p.doc_id = d.id
"""

ORACLES["manifold_summary"] = f"""
WITH {V}, {centres_cte('v')},
d AS (SELECT v.id, min({cos_raw('v.e', 'c.c')}) AS d FROM v, c GROUP BY v.id)
SELECT {r('avg(d)')} AS mean, {r('stddev_pop(d)')} AS std, {r('min(d)')} AS min, {r('max(d)')} AS max
FROM d
"""

ORACLES["cluster_centres"] = f"""
WITH {V}, {centres_cte('v')}
SELECT CAST(e.label AS BIGINT) AS label, CAST(c.n AS BIGINT) AS size, CAST(e.i - 1 AS BIGINT) AS pos,
       {r('e.x')} AS value
FROM c_el e JOIN c ON c.label = e.label
"""

ORACLES["cluster_stats"] = f"""
WITH {V}, {silhouette_sql('v', 'list_distance(a.e, b.e)')}
SELECT CAST(count(DISTINCT label) FILTER (WHERE label <> -1) AS BIGINT) AS n_clusters,
       CAST(count(*) FILTER (WHERE label = -1) AS BIGINT) AS n_noise_points,
       {r('100.0 * count(*) FILTER (WHERE label = -1) / count(*)')} AS noise_percentage,
       {r('(SELECT silhouette FROM sil)')} AS silhouette_score,
       CAST(3 AS BIGINT) AS min_cluster_size, CAST(2 AS BIGINT) AS min_samples
FROM v
"""

ORACLES["cluster_sizes"] = f"""
WITH {V}
SELECT CAST(label AS BIGINT) AS label, 'cluster_' || label AS cluster, CAST(count(*) AS BIGINT) AS size
FROM v WHERE label <> -1 GROUP BY label
"""

ORACLES["silhouette_planted"] = f"""
WITH {V}, {PL}, {silhouette_sql('pl', 'list_distance(a.e, b.e)')}
SELECT {r('silhouette')} AS silhouette FROM sil
"""

ORACLES["silhouette_cosine"] = f"""
WITH {V}, {PL}, {silhouette_sql('pl', cos_lib('a.e', 'b.e'))}
SELECT {r('silhouette')} AS silhouette FROM sil
"""

ORACLES["calinski_planted"] = f"""
WITH {V}, {PL}, {centres_cte('pl')},
g_el AS (SELECT i, avg(x) AS x FROM (SELECT unnest(e) AS x, unnest(generate_series(1, len(e))) AS i FROM pl)
         GROUP BY i),
g AS (SELECT list(x ORDER BY i) AS g FROM g_el),
bw AS (SELECT (SELECT sum(c.n * list_dot_product(list_transform(c.c, lambda x, i: x - g.g[i]),
                                              list_transform(c.c, lambda x, i: x - g.g[i])))
               FROM c, g) AS b,
              (SELECT sum(list_dot_product(list_transform(pl.e, lambda x, i: x - c.c[i]),
                                           list_transform(pl.e, lambda x, i: x - c.c[i])))
               FROM pl JOIN c ON c.label = pl.label) AS w,
              (SELECT count(*) FROM c) AS k, (SELECT count(*) FROM pl) AS n)
SELECT {r('CASE WHEN k < 2 THEN NULL WHEN w = 0 THEN 1.0 ELSE (b / (k - 1)) / (w / (n - k)) END')}
       AS calinski_harabasz FROM bw
"""

ORACLES["mean_pair_distance"] = f"""
WITH {V}
SELECT CAST((SELECT count(*) FROM v) AS BIGINT) AS n, {r(f"avg({cos_lib('a.e', 'b.e')})")} AS mean_distance
FROM v a JOIN v b ON a.id < b.id
"""

ORACLES["cluster_mean_distance"] = f"""
WITH {V}
SELECT CAST(a.label AS BIGINT) AS label,
       CAST((SELECT count(*) FROM v s WHERE s.label = a.label) AS BIGINT) AS n,
       {r(f"avg({cos_lib('a.e', 'b.e')})")} AS mean_distance
FROM v a JOIN v b ON a.label = b.label AND a.id < b.id
GROUP BY a.label
"""

ORACLES["cluster_members"] = """
SELECT CAST(label AS BIGINT) AS label, vec_id AS id, d.text AS prompt,
       CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS position
FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id
"""

# ---------------------------------------------------------------- corpus scores

QV = "qv AS (SELECT * FROM v WHERE label >= 5)"
CV = "cv AS (SELECT * FROM v WHERE label < 5)"
_DIST = {
    "cosine": cos_lib("q.e", "c.e"),
    "euclidean": "list_distance(q.e, c.e)",
    "manhattan": "list_sum(list_transform(q.e, lambda x, i: abs(x - c.e[i])))",
    "faiss_cosine": ("1.0 - list_dot_product(list_transform(q.e, lambda x: x / sqrt(list_dot_product(q.e, q.e))), "
                     "list_transform(c.e, lambda x: x / sqrt(list_dot_product(c.e, c.e))))"),
    "faiss_l2": "list_dot_product(list_transform(q.e, lambda x, i: x - c.e[i]), list_transform(q.e, lambda x, i: x - c.e[i]))",
}
_NORM = {
    "cosine": "least(s, 1.0)", "faiss_cosine": "least(s, 1.0)",
    "euclidean": "least(s / (2.0 * sqrt(dim)), 1.0)", "faiss_l2": "least(s / (2.0 * sqrt(dim)), 1.0)",
    "manhattan": "least(s / (2.0 * dim), 1.0)",
}


def corpus_sql(method: str, k: int = 5, normalize: bool = True) -> str:
    score = _NORM[method] if normalize else "s"
    return f"""{V}, {QV}, {CV},
pd AS (SELECT q.id, len(q.e) AS dim, {_DIST[method]} AS d,
              row_number() OVER (PARTITION BY q.id ORDER BY {_DIST[method]}, c.id) AS nn
       FROM qv q, cv c),
sc AS (SELECT id, any_value(dim) AS dim, avg(d) AS s FROM pd WHERE nn <= {k} GROUP BY id),
scored AS (SELECT id, {score} AS score FROM sc)"""


for _m in ("cosine", "euclidean", "manhattan", "faiss_cosine", "faiss_l2"):
    ORACLES[f"corpus_score_{_m}"] = f"WITH {corpus_sql(_m)} SELECT id, {r('score')} AS score FROM scored"

ORACLES["corpus_score_raw"] = (f"WITH {corpus_sql('euclidean', 7, False)} "
                               f"SELECT id, {r('score')} AS score FROM scored")

ORACLES["score_distribution"] = f"""WITH {corpus_sql('cosine')}
SELECT {r('avg(score)')} AS mean, {r('stddev_pop(score)')} AS std, {r('min(score)')} AS min,
       {r('max(score)')} AS max, {r('quantile_cont(score, 0.5)')} AS median,
       {r('quantile_cont(score, 0.25)')} AS percentile_25, {r('quantile_cont(score, 0.75)')} AS percentile_75,
       {r('quantile_cont(score, 0.9)')} AS percentile_90, {r('quantile_cont(score, 0.95)')} AS percentile_95,
       CAST(count(*) FILTER (WHERE score > 0.5) AS BIGINT) AS above_threshold,
       CAST(count(*) FILTER (WHERE score <= 0.5) AS BIGINT) AS below_threshold, 0.5 AS threshold
FROM scored"""

# ---------------------------------------------------------------- consistency

RS = "rs AS (SELECT id // 5 AS id, id % 5 AS rid, e FROM v)"


def consistency_cte(src: str = "rs", key: str = "id") -> str:
    return f"""
cpd AS (SELECT a.{key} AS k, {cos_lib('a.e', 'b.e')} AS d FROM {src} a
        JOIN {src} b ON a.{key} = b.{key} AND a.rid <> b.rid),
cps AS (SELECT k, avg(d) AS m, stddev_pop(d) AS s, max(d) AS mx, min(d) AS mn FROM cpd GROUP BY k),
cfv AS (SELECT k, i, var_pop(x) AS vp FROM (SELECT {key} AS k, unnest(e) AS x,
        unnest(generate_series(1, len(e))) AS i FROM {src}) GROUP BY k, i),
cfe AS (SELECT k, avg(vp) AS ev, -sum(((vp + 1e-8) / t) * ln((vp + 1e-8) / t)) AS ee
        FROM (SELECT k, vp, sum(vp + 1e-8) OVER (PARTITION BY k) AS t FROM cfv) GROUP BY k),
ccn AS (SELECT {key} AS k, count(*) AS n FROM {src} GROUP BY {key}),
cm AS (SELECT ccn.k, ccn.n,
         CASE WHEN n >= 2 THEN m END AS mean_pairwise_distance,
         CASE WHEN n >= 2 THEN s END AS std_pairwise_distance,
         CASE WHEN n >= 2 THEN mx END AS max_pairwise_distance,
         CASE WHEN n >= 2 THEN mn END AS min_pairwise_distance,
         CASE WHEN n >= 2 THEN ev END AS embedding_variance,
         CASE WHEN n >= 2 THEN ee END AS embedding_entropy,
         CASE WHEN n >= 2 THEN 1.0 - m END AS consistency_score
       FROM ccn LEFT JOIN cps ON cps.k = ccn.k LEFT JOIN cfe ON cfe.k = ccn.k)"""


CONS = f"""{V}, {RS}, {consistency_cte()},
cons AS (SELECT cm.k AS id, d.text AS prompt, CAST(cm.n AS BIGINT) AS n_responses, mean_pairwise_distance,
           std_pairwise_distance, max_pairwise_distance, min_pairwise_distance, embedding_variance,
           embedding_entropy, consistency_score,
           CAST(row_number() OVER (ORDER BY coalesce(consistency_score, 0.0), cm.k) AS BIGINT) AS rank
         FROM cm LEFT JOIN documents d ON d.doc_id = cm.k)"""

ORACLES["consistency"] = f"""WITH {CONS}
SELECT id, prompt, n_responses, {r('mean_pairwise_distance')} AS mean_pairwise_distance,
  {r('std_pairwise_distance')} AS std_pairwise_distance, {r('max_pairwise_distance')} AS max_pairwise_distance,
  {r('min_pairwise_distance')} AS min_pairwise_distance, {r('embedding_variance')} AS embedding_variance,
  {r('embedding_entropy')} AS embedding_entropy, {r('consistency_score')} AS consistency_score, rank
FROM cons"""

BATCH = """CAST(count(*) AS BIGINT) AS n_prompts,
  {mc} AS mean_consistency, {sc} AS std_consistency, {mv} AS mean_embedding_variance,
  {sv} AS std_embedding_variance""".format(
    mc=r("coalesce(avg(consistency_score), 0.0)"), sc=r("coalesce(stddev_pop(consistency_score), 0.0)"),
    mv=r("coalesce(avg(embedding_variance), 0.0)"), sv=r("coalesce(stddev_pop(embedding_variance), 0.0)"))

ORACLES["consistency_batch"] = f"WITH {CONS} SELECT {BATCH} FROM cons"


def _u(word: int) -> str:
    key = "concat_ws(':', '42', CAST(p.lvl AS VARCHAR), CAST(p.id AS VARCHAR), CAST(p.rid AS VARCHAR), " \
          "CAST(i - 1 AS VARCHAR))"
    return f"((CAST(('0x' || substr(md5({key}), {1 + 8 * word}, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


ORACLES["perturbation_sweep"] = f"""WITH {V},
p AS (SELECT l.lvl, v.id, r.rid, v.e, sqrt(list_dot_product(v.e, v.e)) AS n0
      FROM v, (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS lvl) l, (SELECT unnest(range(5)) AS rid) r),
pn AS (SELECT p.lvl, p.id, p.rid, p.n0,
         list_transform(p.e, lambda x, i: x + p.lvl * sqrt(-2.0 * ln({_u(0)})) * cos(2.0 * pi() * {_u(1)})) AS pe
       FROM p),
ps AS (SELECT lvl, CAST(lvl AS VARCHAR) || '#' || CAST(id AS VARCHAR) AS gk, rid,
         CASE WHEN sqrt(list_dot_product(pe, pe)) = 0 THEN pe
              ELSE list_transform(pe, lambda x: x / sqrt(list_dot_product(pe, pe)) * n0) END AS e
       FROM pn),
{consistency_cte('ps', 'gk')},
lv AS (SELECT DISTINCT gk, lvl FROM ps)
SELECT lv.lvl AS noise_level, {BATCH}
FROM cm JOIN lv ON lv.gk = cm.k GROUP BY lv.lvl"""

# ---------------------------------------------------------------- agreement

MODELS = f"""{PL},
m AS (SELECT 'raw' AS model, 0 AS pos, id, e FROM v
      UNION ALL SELECT 'reversed', 1, id, list_reverse(e) FROM v
      UNION ALL SELECT 'planted', 2, id, e FROM pl),
apd AS (SELECT a.id, a.model AS model1, b.model AS model2, {cos_lib('a.e', 'b.e')} AS distance
        FROM m a JOIN m b ON a.id = b.id AND a.pos < b.pos),
ap AS (SELECT model1, model2, avg(distance) AS mean_distance, stddev_pop(distance) AS std_distance,
         max(distance) AS max_distance, min(distance) AS min_distance, 1.0 - avg(distance) AS agreement_score,
         count(*) AS n_prompts FROM apd GROUP BY model1, model2)"""

ORACLES["agreement_pairs"] = f"""WITH {V}, {MODELS}
SELECT model1, model2, {r('mean_distance')} AS mean_distance, {r('std_distance')} AS std_distance,
  {r('max_distance')} AS max_distance, {r('min_distance')} AS min_distance,
  {r('agreement_score')} AS agreement_score, CAST(n_prompts AS BIGINT) AS n_prompts,
  model1 || '_vs_' || model2 AS pair
FROM ap"""

ORACLES["agreement_global"] = f"""WITH {V}, {MODELS}
SELECT CAST(count(*) AS BIGINT) AS n_model_pairs, {r('avg(agreement_score)')} AS mean_agreement,
  {r('stddev_pop(agreement_score)')} AS std_agreement, {r('min(agreement_score)')} AS min_agreement,
  {r('max(agreement_score)')} AS max_agreement, {r('avg(mean_distance)')} AS mean_distance,
  {r('stddev_pop(mean_distance)')} AS std_distance
FROM ap"""

PAGR = f"""{MODELS},
pa AS (SELECT v.id, d.text AS prompt, 1.0 - coalesce(avg(distance), 0.0) AS agreement_score,
         coalesce(avg(distance), 0.0) AS mean_distance, coalesce(stddev_pop(distance), 0.0) AS std_distance,
         coalesce(max(distance), 0.0) AS max_distance, count(distance) AS n_model_pairs
       FROM v JOIN documents d ON d.doc_id = v.id LEFT JOIN apd ON apd.id = v.id
       GROUP BY v.id, d.text),
par AS (SELECT *, row_number() OVER (ORDER BY round(agreement_score, 12), id) AS rank FROM pa)"""

ORACLES["agreement_prompts"] = f"""WITH {DOCV}, {PAGR}
SELECT id, prompt, {r('agreement_score')} AS agreement_score, {r('mean_distance')} AS mean_distance,
  {r('std_distance')} AS std_distance, {r('max_distance')} AS max_distance,
  CAST(n_model_pairs AS BIGINT) AS n_model_pairs, CAST(rank AS BIGINT) AS rank
FROM par"""

ORACLES["agreement_matrix"] = f"""WITH {V}, {MODELS},
mx AS (SELECT model1 AS model_a, model2 AS model_b, agreement_score FROM ap
       UNION ALL SELECT model2, model1, agreement_score FROM ap
       UNION ALL SELECT model, model, 1.0 FROM (SELECT DISTINCT model FROM m))
SELECT model_a, model_b, {r('agreement_score')} AS agreement_score,
  CASE WHEN agreement_score > 0.8 THEN 'high' WHEN agreement_score > 0.6 THEN 'medium' ELSE 'low' END AS band
FROM mx"""

# ---------------------------------------------------------------- fusion

COMB = f"""{DOCV}, {centres_cte('v')}, {DOCRS}, {consistency_cte()}, {PAGR},
man AS (SELECT d.text AS prompt, max(x.d) AS manifold_distance
        FROM (SELECT v.id, min({cos_raw('v.e', 'c.c')}) AS d FROM v, c GROUP BY v.id) x
        JOIN documents d ON d.doc_id = x.id GROUP BY d.text),
con AS (SELECT d.text AS prompt, min(consistency_score) AS consistency_score
        FROM cm JOIN documents d ON d.doc_id = cm.k GROUP BY d.text),
agr AS (SELECT prompt, min(agreement_score) AS agreement_score FROM par GROUP BY prompt),
lst AS (SELECT v.id, d.text AS prompt FROM v JOIN documents d ON d.doc_id = v.id),
j AS (SELECT lst.id, lst.prompt, manifold_distance, consistency_score, agreement_score,
        coalesce(0.4 * manifold_distance, 0.0) + coalesce(0.3 * (1.0 - consistency_score), 0.0)
          + coalesce(0.3 * (1.0 - agreement_score), 0.0) AS num,
        (CASE WHEN manifold_distance IS NOT NULL THEN 0.4 ELSE 0.0 END)
          + (CASE WHEN consistency_score IS NOT NULL THEN 0.3 ELSE 0.0 END)
          + (CASE WHEN agreement_score IS NOT NULL THEN 0.3 ELSE 0.0 END) AS den
      FROM lst LEFT JOIN man ON man.prompt = lst.prompt LEFT JOIN con ON con.prompt = lst.prompt
      LEFT JOIN agr ON agr.prompt = lst.prompt),
comb AS (SELECT *, CASE WHEN den > 0 THEN num / den ELSE 0.0 END AS combined_score FROM j),
combr AS (SELECT *, row_number() OVER (ORDER BY round(combined_score, 12) DESC, id) AS rank FROM comb)"""

ORACLES["combined"] = f"""WITH {COMB}
SELECT id, prompt, {r('manifold_distance')} AS manifold_distance, {r('consistency_score')} AS consistency_score,
  {r('agreement_score')} AS agreement_score, {r('manifold_distance')} AS norm_manifold,
  {r('1.0 - consistency_score')} AS norm_consistency, {r('1.0 - agreement_score')} AS norm_agreement,
  {r('combined_score')} AS combined_score, CAST(rank AS BIGINT) AS rank
FROM combr"""

ORACLES["combined_stats"] = f"""WITH {COMB}
SELECT {r('avg(combined_score)')} AS mean_combined_score, {r('stddev_pop(combined_score)')} AS std_combined_score,
  {r('min(combined_score)')} AS min_combined_score, {r('max(combined_score)')} AS max_combined_score
FROM comb"""

ORACLES["combined_top5"] = f"""WITH {COMB}
SELECT id, prompt, {r('combined_score')} AS combined_score, CAST(rank AS BIGINT) AS position
FROM combr WHERE rank <= 5"""

ORACLES["combined_bottom5"] = f"""WITH {COMB}
SELECT id, prompt, {r('combined_score')} AS combined_score,
  CAST(rank - (SELECT count(*) FROM combr) + 5 AS BIGINT) AS position
FROM combr WHERE rank > (SELECT count(*) FROM combr) - 5"""

# ---------------------------------------------------------------- comparison

LONG = f"""{DOCV}, {BENCHV}, qv AS (SELECT * FROM v),
""" + ",\n".join(
    f"""pd_{m} AS (SELECT q.id, len(q.e) AS dim, {_DIST[m]} AS d,
          row_number() OVER (PARTITION BY q.id ORDER BY {_DIST[m]}, c.id) AS nn FROM qv q, cv c),
s_{m} AS (SELECT id, '{m}' AS method, {_NORM[m]} AS score
          FROM (SELECT id, avg(d) AS s, any_value(dim) AS dim FROM pd_{m} WHERE nn <= 5 GROUP BY id))"""
    for m in ("cosine", "euclidean", "manhattan", "faiss_cosine")) + """,
lg AS (SELECT x.id, d.text AS prompt, x.score, x.method FROM
       (SELECT * FROM s_cosine UNION ALL SELECT * FROM s_euclidean UNION ALL SELECT * FROM s_manhattan
        UNION ALL SELECT * FROM s_faiss_cosine) x JOIN documents d ON d.doc_id = x.id)"""

ORACLES["method_stats"] = f"""WITH {LONG}
SELECT method, {r('avg(score)')} AS mean, {r('stddev_samp(score)')} AS std, {r('min(score)')} AS min,
  {r('max(score)')} AS max, CAST(count(score) AS BIGINT) AS count
FROM lg GROUP BY method"""

ORACLES["method_correlation"] = f"""WITH {LONG},
la AS (SELECT prompt, max_by(score, id) AS a FROM lg WHERE method = 'cosine' GROUP BY prompt),
lb AS (SELECT prompt, max_by(score, id) AS b FROM lg WHERE method = 'manhattan' GROUP BY prompt)
SELECT 'cosine' AS method_a, 'manhattan' AS method_b, {r('corr(a, b)')} AS correlation,
  CAST(count(*) AS BIGINT) AS n_common
FROM la JOIN lb ON la.prompt = lb.prompt"""

ORACLES["score_histogram"] = f"""WITH {LONG},
rg AS (SELECT method, min(score) AS lo, max(score) AS hi FROM lg GROUP BY method),
bn AS (SELECT lg.method, CASE WHEN hi = lo THEN 0 ELSE least(floor((score - lo) / ((hi - lo) / 20)), 19) END AS bin,
         lo, hi FROM lg JOIN rg ON rg.method = lg.method)
SELECT method, CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS count,
  {r('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20')} AS lo,
  {r('any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / 20')} AS hi
FROM bn GROUP BY method, bin"""

ORACLES["score_boxplot"] = f"""WITH {LONG},
q AS (SELECT method, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
        quantile_cont(score, 0.75) AS q3 FROM lg GROUP BY method)
SELECT q.method, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
  {r('min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
  {r('max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
  CAST(count(*) FILTER (WHERE score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM lg JOIN q ON q.method = lg.method GROUP BY q.method, q1, median, q3"""

ORACLES["vector_ops"] = f"""WITH {V},
w AS (SELECT v.id, v.e AS a, list_reverse(v.e) AS b, v.label, d.text AS prompt
      FROM v LEFT JOIN documents d ON d.doc_id = v.id)
SELECT id, {r('list_dot_product(a, b)')} AS dot, {r('sqrt(list_dot_product(a, a))')} AS norm,
  {r('sqrt(list_dot_product(list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))), list_transform(a, lambda x: x / sqrt(list_dot_product(a, a)))))')} AS unit_norm,
  {r(cos_raw('a', 'b'))} AS cos_raw, {r(cos_lib('a', 'b'))} AS cos_lib,
  {r('list_distance(a, b)')} AS euclid,
  {r('list_dot_product(list_transform(a, lambda x, i: x - b[i]), list_transform(a, lambda x, i: x - b[i]))')} AS sq_euclid,
  {r('list_sum(list_transform(a, lambda x, i: abs(x - b[i])))')} AS manhattan,
  {r('1.0 - list_dot_product(list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))), list_transform(b, lambda x: x / sqrt(list_dot_product(b, b))))')} AS ip_dist,
  {r('1.0 - ' + cos_lib('a', 'b'))} AS similarity, CAST(len(a) AS BIGINT) AS dim,
  CASE WHEN 1.0 - {cos_lib('a', 'b')} + 0.75 > 0.8 THEN 'high'
       WHEN 1.0 - {cos_lib('a', 'b')} + 0.75 > 0.6 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN length(prompt) > 30 THEN substr(prompt, 1, 30) || '...' ELSE prompt END AS short,
  'raw_vs_reversed' AS pair, 'cluster_' || label AS cluster
FROM w"""

# ---------------------------------------------------------------- density clustering

KD = f"""{V}, {PL},
kn AS (SELECT a.id, list_distance(a.e, b.e) AS d,
         row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS nn
       FROM pl a, pl b),
kd AS (SELECT id, d AS k_distance, row_number() OVER (ORDER BY d, id) - 1 AS position FROM kn WHERE nn = 3)"""

ORACLES["k_distance"] = f"""WITH {KD}
SELECT id, {r('k_distance')} AS k_distance, CAST(position AS BIGINT) AS position FROM kd"""

ORACLES["elbow_eps"] = f"""WITH {KD},
st AS (SELECT b.position AS elbow_position, b.k_distance AS after, b.k_distance - a.k_distance AS jump
       FROM kd a JOIN kd b ON b.position = a.position + 1),
best AS (SELECT * FROM st ORDER BY jump DESC, elbow_position LIMIT 1)
SELECT CAST(elbow_position AS BIGINT) AS elbow_position, {r('jump')} AS jump, m AS multiplier,
  {r('after * m')} AS eps
FROM best, (SELECT unnest([0.5, 1.0, 1.5, 2.0]::DOUBLE[]) AS m)"""


def dbscan_sql(cfgs: list[tuple[int, float]]) -> str:
    vals = ", ".join(f"({c}, {e})" for c, e in cfgs)
    return f"""RECURSIVE {V}, {PL},
cfg AS (SELECT * FROM (VALUES {vals}) t(cfg, eps)),
pd AS (SELECT a.id AS a, b.id AS b, list_distance(a.e, b.e) AS d FROM pl a, pl b),
nb AS (SELECT cfg.cfg, pd.a AS id, count(*) AS n FROM pd JOIN cfg ON pd.d <= cfg.eps GROUP BY cfg.cfg, pd.a),
core AS (SELECT cfg, id FROM nb WHERE n >= 3),
ce AS (SELECT c.cfg, pd.a, pd.b FROM pd JOIN cfg c ON pd.d <= c.eps
       JOIN core x ON x.cfg = c.cfg AND x.id = pd.a JOIN core y ON y.cfg = c.cfg AND y.id = pd.b),
reach(cfg, src, dst) AS (SELECT cfg, id, id FROM core
       UNION SELECT r.cfg, r.src, ce.b FROM reach r JOIN ce ON ce.cfg = r.cfg AND ce.a = r.dst),
comp AS (SELECT cfg, src AS id, min(dst) AS comp FROM reach GROUP BY cfg, src),
num AS (SELECT cfg, comp, dense_rank() OVER (PARTITION BY cfg ORDER BY comp) - 1 AS label
        FROM (SELECT DISTINCT cfg, comp FROM comp)),
corelab AS (SELECT comp.cfg, comp.id, num.label FROM comp JOIN num ON num.cfg = comp.cfg AND num.comp = comp.comp),
border AS (SELECT c.cfg, pd.a AS id, min(cl.label) AS label FROM pd JOIN cfg c ON pd.d <= c.eps
           JOIN corelab cl ON cl.cfg = c.cfg AND cl.id = pd.b GROUP BY c.cfg, pd.a),
lab AS (SELECT cfg.cfg, cfg.eps, pl.id, CAST(coalesce(corelab.label, border.label, -1) AS BIGINT) AS label
        FROM pl CROSS JOIN cfg LEFT JOIN corelab ON corelab.cfg = cfg.cfg AND corelab.id = pl.id
        LEFT JOIN border ON border.cfg = cfg.cfg AND border.id = pl.id)"""


ORACLES["dbscan"] = f"WITH {dbscan_sql([(0, 1.3)])} SELECT id, label FROM lab"

_SW = [(0, 1.1), (1, 1.25), (2, 1.3), (3, 1.5)]

ORACLES["dbscan_sweep_labels"] = f"""WITH {dbscan_sql(_SW)}
SELECT CAST(cfg AS BIGINT) AS cfg, {r('eps')} AS eps, id, label FROM lab"""

ORACLES["dbscan_sweep"] = f"""WITH {dbscan_sql(_SW)},
sp AS (SELECT a.cfg, a.id, a.label AS la, b.label AS lb, list_distance(x.e, y.e) AS d
       FROM lab a JOIN lab b ON a.cfg = b.cfg AND a.id <> b.id AND a.label <> -1 AND b.label <> -1
       JOIN pl x ON x.id = a.id JOIN pl y ON y.id = b.id),
sl AS (SELECT cfg, id, la, lb, avg(d) AS m FROM sp GROUP BY cfg, id, la, lb),
spt AS (SELECT cfg, id, max(CASE WHEN la = lb THEN m END) AS a, min(CASE WHEN la <> lb THEN m END) AS b
        FROM sl GROUP BY cfg, id),
sil AS (SELECT cfg, avg(CASE WHEN a IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) AS s
        FROM spt GROUP BY cfg),
sm AS (SELECT cfg, eps, count(DISTINCT label) FILTER (WHERE label <> -1) AS n_clusters,
         count(*) FILTER (WHERE label = -1) AS n_noise FROM lab GROUP BY cfg, eps)
SELECT CAST(sm.cfg AS BIGINT) AS cfg, {r('eps')} AS eps, CAST(n_clusters AS BIGINT) AS n_clusters,
  CAST(n_noise AS BIGINT) AS n_noise, {r('CASE WHEN n_clusters > 1 THEN sil.s END')} AS silhouette
FROM sm LEFT JOIN sil ON sil.cfg = sm.cfg"""

NOISY = dbscan_sql([(0, 1.25)]) + """,
nl AS (SELECT lab.id, lab.label, pl.e FROM lab JOIN pl ON pl.id = lab.id)"""

ORACLES["noise_nearest"] = f"""WITH {NOISY}, {centres_cte('nl')},
nd AS (SELECT n.id, c.label, {cos_lib('n.e', 'c.c')} AS d,
         row_number() OVER (PARTITION BY n.id ORDER BY {cos_lib('n.e', 'c.c')}, c.label) AS rk
       FROM nl n, c WHERE n.label = -1)
SELECT n.id, CAST(nd.label AS BIGINT) AS nearest_label, {r("coalesce(nd.d, 'inf'::DOUBLE)")} AS distance
FROM nl n LEFT JOIN nd ON nd.id = n.id AND nd.rk = 1 WHERE n.label = -1"""

ORACLES["dbscan_cluster_distance"] = f"""WITH {NOISY}
SELECT CAST(a.label AS BIGINT) AS label, CAST((SELECT count(*) FROM nl s WHERE s.label = a.label) AS BIGINT) AS n,
  {r(f"avg({cos_lib('a.e', 'b.e')})")} AS mean_distance
FROM nl a JOIN nl b ON a.label = b.label AND a.id < b.id WHERE a.label <> -1
GROUP BY a.label"""

# ---------------------------------------------------------------- model level

ORACLES["element_stats"] = f"""WITH {V}, {MODELS},
el AS (SELECT model, unnest(e) AS x FROM m)
SELECT model, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS std, {r('min(x)')} AS min, {r('max(x)')} AS max,
  CAST(count(*) AS BIGINT) AS n_elements
FROM el GROUP BY model"""

ORACLES["model_comparison"] = f"""WITH {V}, {MODELS},
sp AS (SELECT a.model, a.id, va.label AS la, vb.label AS lb, list_distance(a.e, b.e) AS d
       FROM m a JOIN m b ON a.model = b.model AND a.id <> b.id
       JOIN v va ON va.id = a.id JOIN v vb ON vb.id = b.id),
sl AS (SELECT model, id, la, lb, avg(d) AS mm FROM sp GROUP BY model, id, la, lb),
spt AS (SELECT model, id, max(CASE WHEN la = lb THEN mm END) AS a, min(CASE WHEN la <> lb THEN mm END) AS b
        FROM sl GROUP BY model, id),
sil AS (SELECT model, avg(CASE WHEN a IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) AS s
        FROM spt GROUP BY model),
mpd AS (SELECT a.model, avg({cos_lib('a.e', 'b.e')}) AS md FROM m a JOIN m b ON a.model = b.model AND a.id < b.id
        GROUP BY a.model),
dm AS (SELECT model, max(len(e)) AS dim, count(*) AS n FROM m GROUP BY model)
SELECT dm.model, {r('sil.s')} AS silhouette, {r('mpd.md')} AS avg_distance, CAST(dim AS BIGINT) AS dim,
  CAST(n AS BIGINT) AS n
FROM dm JOIN sil ON sil.model = dm.model JOIN mpd ON mpd.model = dm.model"""

ORACLES["best_dbscan_config"] = ORACLES["dbscan_sweep"].rstrip() .replace(
    "SELECT CAST(sm.cfg AS BIGINT) AS cfg", "SELECT * FROM (SELECT CAST(sm.cfg AS BIGINT) AS cfg", 1) + """)
WHERE silhouette IS NOT NULL AND silhouette > -1 ORDER BY silhouette DESC, cfg LIMIT 1"""

# ---------------------------------------------------------------- text

ORACLES["text_embedding"] = f"""WITH
tk AS (SELECT doc_id AS id, unnest({_TOKS}) AS tok FROM documents),
cnt AS (SELECT id, {_BUCKET.format(salt='', tok='tok')} AS bucket, count(*) AS c FROM tk GROUP BY ALL),
tot AS (SELECT id, sum(c) AS n FROM cnt GROUP BY id)
SELECT cnt.id, CAST(bucket AS BIGINT) AS bucket, {r('c / n')} AS weight, CAST(n AS BIGINT) AS n_tokens
FROM cnt JOIN tot ON tot.id = cnt.id"""


ORACLES["methods_listed"] = f"WITH {LONG} SELECT DISTINCT method FROM lg"

ORACLES["score_flags"] = f"""WITH {LONG}
SELECT id, {r('score')} AS score, score > 0.5 AS flagged FROM s_cosine"""

ORACLES["float32_vectors"] = f"""WITH {V}, {PL},
f AS (SELECT id, list_transform(e, lambda x: CAST(CAST(x / sqrt(list_dot_product(e, e)) AS FLOAT) AS DOUBLE)) AS e FROM pl)
SELECT id, {r('sqrt(list_dot_product(e, e))')} AS norm, {r('list_sum(e)')} AS total FROM f"""

ORACLES["masked_pool"] = f"""WITH
t AS (SELECT conv_id || ':' || turn AS id, {_TOKS} AS t FROM conversations),
k AS (SELECT id, unnest(t) AS tok, unnest(range(len(t))) AS i FROM t)
SELECT id, {r('avg(length(tok))')} AS length, {r('avg(' + _BUCKET.format(salt='', tok='tok') + ')')} AS bucket,
  {r('avg(i)')} AS place
FROM k WHERE length(tok) > 2 GROUP BY id"""

ORACLES["conversation_consistency"] = f"""WITH
pr AS (SELECT conv_id AS id, min_by(text, turn) FILTER (WHERE role = 'user') AS prompt
       FROM conversations GROUP BY conv_id),
ast AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
{dense_cte('ast', 'conv_id, turn', _TOKS)},
rs AS (SELECT conv_id AS id, turn AS rid, e FROM dv),
{consistency_cte()},
cons AS (SELECT pr.id, pr.prompt, CAST(coalesce(cm.n, 0) AS BIGINT) AS n_responses, mean_pairwise_distance,
           std_pairwise_distance, max_pairwise_distance, min_pairwise_distance, embedding_variance,
           embedding_entropy, consistency_score,
           CAST(row_number() OVER (ORDER BY coalesce(consistency_score, 0.0), pr.id) AS BIGINT) AS rank
         FROM pr LEFT JOIN cm ON cm.k = pr.id)
SELECT id, prompt, n_responses, {r('mean_pairwise_distance')} AS mean_pairwise_distance,
  {r('std_pairwise_distance')} AS std_pairwise_distance, {r('max_pairwise_distance')} AS max_pairwise_distance,
  {r('min_pairwise_distance')} AS min_pairwise_distance, {r('embedding_variance')} AS embedding_variance,
  {r('embedding_entropy')} AS embedding_entropy, {r('consistency_score')} AS consistency_score, rank
FROM cons"""

_BIGR = f"list_transform(range(1, len({_TOKS})), lambda i: {_TOKS}[i] || ' ' || {_TOKS}[i + 1])"

ORACLES["text_model_agreement"] = f"""WITH
docs AS (SELECT doc_id AS id, text FROM documents),
{dense_cte('docs', 'id', _TOKS).replace('dk AS', 'dk1 AS').replace('FROM dk ', 'FROM dk1 ').replace('dc AS', 'dc1 AS').replace('FROM dc ', 'FROM dc1 ').replace('dt AS', 'dt1 AS').replace('JOIN dc ', 'JOIN dc1 ').replace('JOIN dt ', 'JOIN dt1 ').replace('dv AS', 'dv1 AS')},
{dense_cte('docs', 'id', _BIGR).replace('dk AS', 'dk2 AS').replace('FROM dk ', 'FROM dk2 ').replace('dc AS', 'dc2 AS').replace('FROM dc ', 'FROM dc2 ').replace('dt AS', 'dt2 AS').replace('JOIN dc ', 'JOIN dc2 ').replace('JOIN dt ', 'JOIN dt2 ').replace('dv AS', 'dv2 AS')},
{dense_cte('docs', 'id', _TOKS, "'s2:' || ").replace('dk AS', 'dk3 AS').replace('FROM dk ', 'FROM dk3 ').replace('dc AS', 'dc3 AS').replace('FROM dc ', 'FROM dc3 ').replace('dt AS', 'dt3 AS').replace('JOIN dc ', 'JOIN dc3 ').replace('JOIN dt ', 'JOIN dt3 ').replace('dv AS', 'dv3 AS')},
m AS (SELECT 'words' AS model, 0 AS pos, id, e FROM dv1 UNION ALL SELECT 'bigrams', 1, id, e FROM dv2
      UNION ALL SELECT 'words_salted', 2, id, e FROM dv3),
apd AS (SELECT a.id, a.model AS model1, b.model AS model2, {cos_lib('a.e', 'b.e')} AS distance
        FROM m a JOIN m b ON a.id = b.id AND a.pos < b.pos)
SELECT model1, model2, {r('avg(distance)')} AS mean_distance, {r('stddev_pop(distance)')} AS std_distance,
  {r('max(distance)')} AS max_distance, {r('min(distance)')} AS min_distance,
  {r('1.0 - avg(distance)')} AS agreement_score, CAST(count(*) AS BIGINT) AS n_prompts,
  model1 || '_vs_' || model2 AS pair
FROM apd GROUP BY model1, model2"""

ORACLES["scores_roundtrip"] = (f"WITH {corpus_sql('cosine')} SELECT id, {r('score')} AS score, "
                               "'raw' AS model, 'cosine' AS method FROM scored")

# ---------------------------------------------------------------- reports

ORACLES["pipeline_report"] = f"""WITH {COMB}, {silhouette_sql('v', 'list_distance(a.e, b.e)')},
ranked AS (SELECT *, count(*) OVER () AS total FROM combr)
SELECT 'methods' AS section, CAST(1 AS BIGINT) AS position, 'distance to cluster centres' AS text
UNION ALL SELECT 'methods', 2, 'spread of responses'
UNION ALL SELECT 'methods', 3, 'agreement of models'
UNION ALL SELECT 'manifold', 1, printf('%d clusters', (SELECT count(DISTINCT label) FROM v WHERE label <> -1))
UNION ALL SELECT 'manifold', 2, printf('%d rows in none (%.1f%%)', (SELECT count(*) FROM v WHERE label = -1),
                                       (SELECT 100.0 * count(*) FILTER (WHERE label = -1) / count(*) FROM v))
UNION ALL SELECT 'manifold', 3, printf('silhouette %.3f', (SELECT silhouette FROM sil))
UNION ALL SELECT 'consistency', 1, printf('consistency %.3f on average', (SELECT coalesce(avg(consistency_score), 0.0) FROM cm))
UNION ALL SELECT 'consistency', 2, printf('variance of the vectors %.3f on average',
                                          (SELECT coalesce(avg(embedding_variance), 0.0) FROM cm))
UNION ALL SELECT 'agreement', 1, printf('agreement %.3f on average', (SELECT avg(agreement_score) FROM ap))
UNION ALL SELECT 'agreement', 2, printf('%d pairs of models', (SELECT count(*) FROM ap))
UNION ALL SELECT 'combined', 1, printf('fused score %.3f on average', (SELECT avg(combined_score) FROM comb))
UNION ALL SELECT 'combined', 2, printf('fused scores from %.3f to %.3f', (SELECT min(combined_score) FROM comb),
                                       (SELECT max(combined_score) FROM comb))
UNION ALL SELECT 'top', rank, printf('%d. Score %.3f: %s...', rank, combined_score, substr(prompt, 1, 60))
  FROM ranked WHERE rank <= 5
UNION ALL SELECT 'bottom', rank - total + 5, printf('%d. Score %.3f: %s...', rank - total + 5, combined_score,
                                                    substr(prompt, 1, 60))
  FROM ranked WHERE rank > total - 5"""

# ---------------------------------------------------------------- streaming

ORACLES["stream_manifold_scores"] = f"""WITH {V}, {centres_cte('v')},
d AS (SELECT v.id, c.label, {cos_raw('v.e', 'c.c')} AS d,
        row_number() OVER (PARTITION BY v.id ORDER BY {cos_raw('v.e', 'c.c')}, c.label) AS rk FROM v, c)
SELECT id, CAST(label AS BIGINT) AS nearest_label, {r('d')} AS manifold_distance FROM d WHERE rk = 1"""

ORACLES["stream_corpus_scores"] = ORACLES["corpus_score_cosine"]

DRIFT = f"""WITH
p AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, value AS f0,
        sin(2.0 * pi() / 24.0 * hour(ts)) AS f1, cos(2.0 * pi() / 24.0 * hour(ts)) AS f2 FROM events),
a AS (SELECT event_type, day, count(*) AS n, sum(f0) / count(*) AS c0, sum(f1) / count(*) AS c1,
        sum(f2) / count(*) AS c2 FROM p GROUP BY event_type, day),
l AS (SELECT *, lag(day) OVER w AS prev_day, lag(c0) OVER w AS p0, lag(c1) OVER w AS p1, lag(c2) OVER w AS p2
      FROM a WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n,
  strftime(prev_day, '%Y-%m-%d') AS prev_day,
  {r('CASE WHEN p0 IS NOT NULL THEN 1.0 - (c0 * p0 + c1 * p1 + c2 * p2) / (sqrt(c0 * c0 + c1 * c1 + c2 * c2) * sqrt(p0 * p0 + p1 * p1 + p2 * p2)) END')} AS drift
FROM l"""

ORACLES["event_drift"] = DRIFT
ORACLES["stream_event_drift"] = DRIFT

_CONV_WITH = ORACLES["conversation_consistency"].split("\nSELECT id, prompt, n_responses,")[0]

ORACLES["consistency_report"] = _CONV_WITH + """,
tot AS (SELECT count(*) AS total FROM cons)
SELECT 'summary' AS section, CAST(1 AS BIGINT) AS position, printf('Prompts analysed: %d', (SELECT total FROM tot)) AS text
UNION ALL SELECT 'summary', 2, printf('consistency %.3f on average (std %.3f)',
  (SELECT coalesce(avg(consistency_score), 0.0) FROM cons), (SELECT coalesce(stddev_pop(consistency_score), 0.0) FROM cons))
UNION ALL SELECT 'summary', 3, printf('variance of the vectors %.6f on average', (SELECT coalesce(avg(embedding_variance), 0.0) FROM cons))
UNION ALL SELECT 'least_consistent', rank, printf('%d. Score %.3f: %s...', rank, coalesce(consistency_score, 0.0),
  substr(prompt, 1, 60)) FROM cons WHERE rank <= 5
UNION ALL SELECT 'most_consistent', rank - (SELECT total FROM tot) + 5,
  printf('%d. Score %.3f: %s...', rank - (SELECT total FROM tot) + 5, coalesce(consistency_score, 0.0), substr(prompt, 1, 60))
  FROM cons WHERE rank > (SELECT total FROM tot) - 5"""

ORACLES["agreement_report"] = f"""WITH {DOCV}, {PAGR}
SELECT 'summary' AS section, CAST(1 AS BIGINT) AS position, printf('%d pairs of models', (SELECT count(*) FROM ap)) AS text
UNION ALL SELECT 'summary', 2, printf('agreement %.3f on average (std %.3f)', (SELECT avg(agreement_score) FROM ap),
  (SELECT stddev_pop(agreement_score) FROM ap))
UNION ALL SELECT 'pairs', row_number() OVER (ORDER BY model1, model2),
  printf('%s: agreement %.3f, mean distance %.3f', model1 || '_vs_' || model2, agreement_score, mean_distance) FROM ap
UNION ALL SELECT 'disagreement', rank, printf('%d. Score %.3f: %s...', rank, agreement_score, substr(prompt, 1, 60))
  FROM par WHERE rank <= 5"""
