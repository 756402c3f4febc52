"""

Every query reads the driver tables of ``sf_dir`` (or data Spark derives
from them) in full and returns a DataFrame whose floating columns are
rounded to 6 digits.  The matching DuckDB SQL is in :mod:`oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedscope.operators import clusters as C
from embedscope.plans.common import rounded
from embedscope.session import cut_lineage
from embedscope.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


def _given_labels(spark, sf):
    return T.vectors(spark, sf).select("id", "label")


# ---------------------------------------------------------------- clusters

@register("manifold_score")
def q_manifold_score(spark, sf):
    """Q1 (A1 -> J7 -> W1): distance of every document's vector to the nearest
    centre of the clusters (by language), ranked worst first."""
    v = T.doc_vectors(spark, sf)
    return C.manifold_score(v, T.prompts(spark, sf))


@register("manifold_summary")
def q_manifold_summary(spark, sf):
    """A4 over the manifold distances of all vectors."""
    v = T.vectors(spark, sf)
    model = C.ManifoldModel(C.centres(v))
    return C.score_summary(model.distances(v.select("id", "embedding")), "manifold_distance")


@register("cluster_centres")
def q_cluster_centres(spark, sf):
    """A1: centre per given label, one row per element."""
    c = C.centres(T.vectors(spark, sf))
    return c.select("label", "size", F.posexplode("centre").alias("pos", "value"))


@register("cluster_stats")
def q_cluster_stats(spark, sf):
    """A2 + A17: statistics of the given labels with the exact Euclidean
    silhouette."""
    v = T.vectors(spark, sf)
    return C.clustering_stats(v.select("label"), C.silhouette(v), 3, 2)


@register("cluster_sizes")
def q_cluster_sizes(spark, sf):
    """A2: size per cluster with its ``cluster_{label}`` key."""
    return C.cluster_sizes(T.vectors(spark, sf).select("label"))


@register("silhouette_planted")
def q_silhouette_planted(spark, sf):
    """A17 on the planted vectors (clear clusters)."""
    return C.silhouette(T.planted(spark, sf))


@register("silhouette_cosine")
def q_silhouette_cosine(spark, sf):
    """A17 with cosine distance on the planted vectors."""
    return C.silhouette(T.planted(spark, sf), metric="cosine")


@register("calinski_planted")
def q_calinski_planted(spark, sf):
    """A18 on the planted vectors."""
    return C.calinski_harabasz(T.planted(spark, sf))


@register("mean_pair_distance")
def q_mean_pair_distance(spark, sf):
    """Mean cosine distance over all pairs, closed form."""
    return C.mean_pair_distance(T.vectors(spark, sf))


@register("cluster_mean_distance")
def q_cluster_mean_distance(spark, sf):
    """Mean within-cluster cosine distance per given label."""
    return C.mean_pair_distance(T.vectors(spark, sf), group_col="label")


@register("cluster_members")
def q_cluster_members(spark, sf):
    """Members per given label with their prompt, position in id order."""
    return C.cluster_members(T.vectors(spark, sf).select("id", "label"), T.prompts(spark, sf))


# ---------------------------------------------------------------- corpus scores

def _corpus_method(method):
    def q(spark, sf):
        from embedscope.operators.scoring import corpus_scores
        return corpus_scores(T.queries(spark, sf), T.corpus(spark, sf), method=method, top_k=5)
    q.__doc__ = f"Q4: mean of the 5 smallest {method} distances from each query vector " \
                f"(label >= 5) to the corpus (label < 5), normalised."
    return q


for _m in ("cosine", "euclidean", "manhattan", "faiss_cosine", "faiss_l2"):
    register(f"corpus_score_{_m}")(_corpus_method(_m))


@register("corpus_score_raw")
def q_corpus_score_raw(spark, sf):
    """Q4 without normalisation, k = 7, euclidean."""
    from embedscope.operators.scoring import corpus_scores
    return corpus_scores(T.queries(spark, sf), T.corpus(spark, sf), method="euclidean",
                         top_k=7, normalize=False)


@register("score_distribution")
def q_score_distribution(spark, sf):
    """A5 over the cosine corpus scores, threshold 0.5 (exact quantiles)."""
    from embedscope.operators.scoring import corpus_scores, distribution
    s = corpus_scores(T.queries(spark, sf), T.corpus(spark, sf), method="cosine")
    return distribution(s, threshold=0.5)


# ---------------------------------------------------------------- consistency

def _response_prompts(spark, sf):
    ids = T.responses(spark, sf).select("id").distinct()
    return ids.join(T.prompts(spark, sf), "id", "left")


def _consistency(spark, sf):
    from embedscope.operators.consistency import prompt_consistency
    return prompt_consistency(_response_prompts(spark, sf), T.responses(spark, sf))


@register("consistency")
def q_consistency(spark, sf):
    """Q5 (J3, A6-A9, W2): consistency of the five responses of each prompt."""
    return _consistency(spark, sf)


@register("consistency_batch")
def q_consistency_batch(spark, sf):
    """A10: batch statistics of the consistency table."""
    from embedscope.operators.consistency import batch_statistics
    return batch_statistics(_consistency(spark, sf))


@register("perturbation_sweep")
def q_perturbation_sweep(spark, sf):
    """Q6: five hashed-Gaussian perturbations per vector at noise 0.05, 0.1,
    0.2; batch consistency per level."""
    from embedscope.operators.consistency import perturbation_sweep
    return perturbation_sweep(T.vectors(spark, sf).select("id", "embedding"))


# ---------------------------------------------------------------- agreement

def _agreement_dists(spark, sf):
    from embedscope.operators.agreement import pair_distances
    return pair_distances(T.models(spark, sf), names=list(T.MODEL_NAMES), check=False)


@register("agreement_pairs")
def q_agreement_pairs(spark, sf):
    """A11 (J4, J5): agreement of each model pair."""
    from embedscope.operators.agreement import pairwise_agreement
    return pairwise_agreement(_agreement_dists(spark, sf))


@register("agreement_global")
def q_agreement_global(spark, sf):
    """Global agreement over the model pairs."""
    from embedscope.operators.agreement import global_agreement, pairwise_agreement
    return global_agreement(pairwise_agreement(_agreement_dists(spark, sf)))


def _doc_dists(spark, sf, vecs=None):
    from embedscope.operators.agreement import pair_distances
    return pair_distances(T.doc_models(spark, sf, vecs), names=list(T.MODEL_NAMES), check=False)


def _prompt_agreement(spark, sf):
    from embedscope.operators.agreement import prompt_agreement
    return prompt_agreement(_doc_dists(spark, sf), T.prompts(spark, sf))


@register("agreement_prompts")
def q_agreement_prompts(spark, sf):
    """Agreement per prompt over model pairs, ranked."""
    return _prompt_agreement(spark, sf)


@register("agreement_matrix")
def q_agreement_matrix(spark, sf):
    """A14 + P15: agreement matrix with diagonal and band."""
    from embedscope.operators.agreement import agreement_matrix, pairwise_agreement
    return agreement_matrix(pairwise_agreement(_agreement_dists(spark, sf)), list(T.MODEL_NAMES))


# ---------------------------------------------------------------- fusion

def _combined(spark, sf):
    from embedscope.operators.consistency import response_metrics
    v = cut_lineage(T.doc_vectors(spark, sf))
    return _fused(spark, sf, v, response_metrics(T.doc_responses(spark, sf)), _doc_dists(spark, sf, v))


def _fused(spark, sf, v, cons, dists):
    from embedscope.operators.agreement import agreement_scores
    from embedscope.operators.fusion import combine_scores
    man = C.ManifoldModel(C.centres(v)).distances(v.select("id", "embedding"))
    return combine_scores(T.prompts(spark, sf), man, cons, agreement_scores(dists, v.select("id")))


@register("combined")
def q_combined(spark, sf):
    """Q8 (J6, W1): weighted fusion of manifold, consistency and agreement
    by prompt text, ranked."""
    return _combined(spark, sf)


@register("combined_stats")
def q_combined_stats(spark, sf):
    """A4 over the combined scores."""
    from embedscope.operators.fusion import combined_statistics
    return combined_statistics(_combined(spark, sf))


@register("combined_top5")
def q_combined_top5(spark, sf):
    """Five most likely hallucinations."""
    from embedscope.operators.ranking import top_k
    return top_k(_combined(spark, sf).select("id", "prompt", "combined_score"),
                 [F.round("combined_score", 12).desc(), F.col("id")], 5, "position")


@register("combined_bottom5")
def q_combined_bottom5(spark, sf):
    """Last five of the ranking, in ranking order, renumbered."""
    from embedscope.operators.ranking import last_k
    return last_k(_combined(spark, sf).select("id", "prompt", "combined_score"),
                  [F.round("combined_score", 12).desc(), F.col("id")],
                  [F.round("combined_score", 12).asc(), F.col("id").desc()], 5)


# ---------------------------------------------------------------- comparison

def _long_scores(spark, sf):
    from embedscope.operators.compare import long_scores
    from embedscope.operators.scoring import corpus_scores
    q, c = cut_lineage(T.doc_vectors(spark, sf)), cut_lineage(T.benchmark_vectors(spark, sf))
    prompts = T.prompts(spark, sf)
    frames = {m: corpus_scores(q, c, method=m).join(prompts, "id")
              for m in ("cosine", "euclidean", "manhattan", "faiss_cosine")}
    return long_scores(frames)


@register("method_stats")
def q_method_stats(spark, sf):
    """Q12/A20 (U1): per-method statistics of the long score table."""
    from embedscope.operators.compare import method_statistics
    return method_statistics(_long_scores(spark, sf))


@register("method_correlation")
def q_method_correlation(spark, sf):
    """A21 (J11, U2): correlation of cosine and manhattan scores on common
    prompts, last value winning."""
    from embedscope.operators.compare import method_correlation
    return method_correlation(_long_scores(spark, sf), "cosine", "manhattan")


@register("score_histogram")
def q_score_histogram(spark, sf):
    """20-bin histogram per method."""
    from embedscope.operators.compare import histogram
    return histogram(_long_scores(spark, sf), bins=20)


@register("score_boxplot")
def q_score_boxplot(spark, sf):
    """Box-plot statistics per method (exact quartiles)."""
    from embedscope.operators.compare import box_stats
    return box_stats(_long_scores(spark, sf))


@register("methods_listed")
def q_methods_listed(spark, sf):
    """The methods of the long score table."""
    from embedscope.operators.compare import distinct_methods
    return distinct_methods(_long_scores(spark, sf))


# ---------------------------------------------------------------- row-wise functions

@register("score_flags")
def q_score_flags(spark, sf):
    """Corpus scores of every document against the benchmark, flagged above 0.5."""
    from embedscope.operators.scoring import corpus_scores, threshold_flags
    s = corpus_scores(cut_lineage(T.doc_vectors(spark, sf)), cut_lineage(T.benchmark_vectors(spark, sf)), method="cosine")
    return s.select("id", "score", threshold_flags(s, "score", 0.5).alias("flagged"))


@register("float32_vectors")
def q_float32_vectors(spark, sf):
    """Length and sum of the normalised planted vectors in single precision."""
    from embedscope.functions import vectors as V
    v = T.planted(spark, sf).select("id", V.as_float(V.normalize("embedding")).alias("embedding"))
    return v.select("id", V.norm("embedding").alias("norm"), V.vsum(F.col("embedding")).alias("total"))


@register("vector_ops")
def q_vector_ops(spark, sf):
    """Row-wise vector functions of each
    vector against its reversed copy."""
    from embedscope.functions import vectors as V
    v = T.vectors(spark, sf).join(T.prompts(spark, sf), "id", "left")
    a, b = F.col("embedding"), F.reverse("embedding")
    cos = V.cosine_distance(a, b)
    return v.select(
        "id", V.dot(a, b).alias("dot"), V.norm(a).alias("norm"),
        V.norm(V.normalize(a)).alias("unit_norm"),
        V.cosine_distance_raw(a, b).alias("cos_raw"), cos.alias("cos_lib"),
        V.euclidean_distance(a, b).alias("euclid"), V.sq_euclidean_distance(a, b).alias("sq_euclid"),
        V.manhattan_distance(a, b).alias("manhattan"), V.ip_distance(a, b).alias("ip_dist"),
        V.invert(cos).alias("similarity"), V.dim(a).alias("dim"),
        V.agreement_band(V.invert(cos) + F.lit(0.75)).alias("band"),
        V.shorten("prompt", 30).alias("short"),
        V.pair_name(F.lit("raw"), F.lit("reversed")).alias("pair"),
        V.cluster_key("label").alias("cluster"))


# ---------------------------------------------------------------- density clustering

# Fixed eps values for the planted vectors (no pair distance lies within
# 1e-6 of them at sf0.01, so the inclusive comparison is stable).
DBSCAN_EPS = 1.3
DBSCAN_NOISY_EPS = 1.25
SWEEP_EPS = (1.1, 1.25, 1.3, 1.5)


@register("k_distance")
def q_k_distance(spark, sf):
    """W6 (J10): 3rd-neighbour distance of each planted vector, sorted."""
    from embedscope.operators.density import k_distance
    return k_distance(T.planted(spark, sf), k=3)


@register("elbow_eps")
def q_elbow_eps(spark, sf):
    """W7 + W8: elbow of the k-distance curve and the four sweep values."""
    from embedscope.operators.density import EPS_MULTIPLIERS, elbow_eps, k_distance
    e = elbow_eps(k_distance(T.planted(spark, sf), k=3))
    mult = F.explode(F.array(*[F.lit(m) for m in EPS_MULTIPLIERS])).alias("multiplier")
    return e.select("eps", "elbow_position", "jump", mult).select(
        "elbow_position", "jump", "multiplier", (F.col("eps") * F.col("multiplier")).alias("eps"))


@register("dbscan")
def q_dbscan(spark, sf):
    """M4 (J9): DBSCAN of the planted vectors, eps 1.3, min_samples 3."""
    from embedscope.operators.density import dbscan
    return dbscan(T.planted(spark, sf), DBSCAN_EPS, 3)


def _sweep(spark, sf):
    from embedscope.operators.density import dbscan_sweep
    return dbscan_sweep(T.planted(spark, sf), list(SWEEP_EPS), 3)


@register("dbscan_sweep_labels")
def q_dbscan_sweep_labels(spark, sf):
    """M5: labels of the planted vectors for four eps values, one job."""
    return _sweep(spark, sf)[0]


@register("dbscan_sweep")
def q_dbscan_sweep(spark, sf):
    """M5 + A17 + A19: clusters, noise and silhouette without noise per eps."""
    return _sweep(spark, sf)[1]


def _noisy_labels(spark, sf):
    from embedscope.operators.density import dbscan
    p = T.planted(spark, sf).select("id", "embedding")
    return p.join(dbscan(p, DBSCAN_NOISY_EPS, 3), "id")


@register("noise_nearest")
def q_noise_nearest(spark, sf):
    """J8 (Q10): each DBSCAN noise point's nearest cluster centre."""
    return C.noise_to_nearest(_noisy_labels(spark, sf))


@register("dbscan_cluster_distance")
def q_dbscan_cluster_distance(spark, sf):
    """A16 (Q10): mean within-cluster cosine distance of the DBSCAN clusters."""
    return C.mean_pair_distance(_noisy_labels(spark, sf).where("label <> -1"), group_col="label")


# ---------------------------------------------------------------- model level

@register("element_stats")
def q_element_stats(spark, sf):
    """A3 per model: mean, population std, min, max over all elements."""
    return C.element_statistics(T.models(spark, sf), group_col="model")


@register("model_comparison")
def q_model_comparison(spark, sf):
    """A25 (P19, A15, A17): model table on the given labels, one job."""
    m = T.models(spark, sf).select("model", "id", "embedding")
    return C.model_comparison(m, T.vectors(spark, sf).select("id", "label"))


@register("best_dbscan_config")
def q_best_dbscan_config(spark, sf):
    """Best eps of the DBSCAN sweep by silhouette."""
    return C.best_configuration(_sweep(spark, sf)[1])


# ---------------------------------------------------------------- text

def _docs(spark, sf):
    return T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@register("text_embedding")
def q_text_embedding(spark, sf):
    """Mean-pooled one-hot hashed word vectors of every whole
    document, sparse (id, bucket, weight, n_tokens)."""
    from embedscope.operators.featurize import hashed_embedding
    return hashed_embedding(_docs(spark, sf))


@register("masked_pool")
def q_masked_pool(spark, sf):
    """Masked mean pooling of token vectors (length, bucket and place of each word)
    of every conversation turn; words of one or two characters are masked."""
    from embedscope.operators.featurize import bucket, mean_pool, token_array
    turns = T.table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    tokens = turns.select("id", F.posexplode(token_array("text")).alias("token_pos", "token"))
    pooled = mean_pool(tokens.select(
        "id", (F.length("token") > 2).cast("int").alias("mask"),
        F.array(F.length("token").cast("double"), bucket(F.col("token"), 64).cast("double"),
                F.col("token_pos").cast("double")).alias("vec")))
    return pooled.select("id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(("length", "bucket", "place"))])


def _conversation_inputs(spark, sf):
    from embedscope.operators.featurize import text_embeddings
    conv = T.table(spark, sf, "conversations")
    prompts = conv.groupBy(F.col("conv_id").alias("id")).agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"))
    turns = conv.where(F.col("role") == "assistant").select(
        F.concat_ws(":", "conv_id", "turn").alias("key"), "conv_id", "turn", "text")
    vecs = text_embeddings(turns, id_col="key").join(turns.select("key", "conv_id", "turn"), "key")
    responses = vecs.select(F.col("conv_id").alias("id"), F.col("turn").alias("response_id"), "embedding")
    return prompts, responses


@register("conversation_consistency")
def q_conversation_consistency(spark, sf):
    """E2 -> Q5: consistency of the assistant turns of each conversation
    (0 to 4 responses, so A9's fewer-than-two rule is exercised)."""
    from embedscope.operators.consistency import prompt_consistency
    prompts, responses = _conversation_inputs(spark, sf)
    return prompt_consistency(prompts, responses)


@register("text_model_agreement")
def q_text_model_agreement(spark, sf):
    """E3 -> A11: agreement of three hashing text models on all documents."""
    from embedscope.operators.agreement import pair_distances, pairwise_agreement
    from embedscope.operators.featurize import TEXT_MODELS, text_models
    models = text_models(_docs(spark, sf))
    return pairwise_agreement(pair_distances(models, names=[m[0] for m in TEXT_MODELS], check=False))


@register("tfidf_embedding")
def q_tfidf_embedding(spark, sf):
    """E2 with MLlib HashingTF + IDF on all documents: (id, dim, norm)."""
    from embedscope.functions import vectors as V
    from embedscope.operators.featurize import mllib_embeddings
    e = mllib_embeddings(_docs(spark, sf), kind="tfidf")
    return e.select("id", V.dim("embedding").alias("dim"), V.norm("embedding").alias("norm"))


# ---------------------------------------------------------------- MLlib clustering (checked by invariants)

@register("kmeans")
def q_kmeans(spark, sf):
    """M1: k-means (k = 10, seed 42) of the planted vectors."""
    from embedscope.operators.mlmodels import kmeans
    return kmeans(T.planted(spark, sf), 10)[0]


@register("kmeans_sweep")
def q_kmeans_sweep(spark, sf):
    """M2 + A17: k-means for k = 2..5 scored by exact silhouette in one job."""
    from embedscope.operators.mlmodels import kmeans_sweep
    return kmeans_sweep(T.planted(spark, sf), ks=[2, 3, 4, 5])[1]


@register("bisecting_kmeans")
def q_bisecting_kmeans(spark, sf):
    """M7: hierarchical (bisecting) k-means, k = 10."""
    from embedscope.operators.mlmodels import bisecting_kmeans
    return bisecting_kmeans(T.planted(spark, sf), 10)


@register("ward")
def q_ward(spark, sf):
    """M7: Ward's agglomeration, cut at k = 2..5 and 10."""
    from embedscope.operators.mlmodels import ward
    return ward(T.planted(spark, sf), [2, 3, 4, 5, 10])


@register("gmm_uncertainty")
def q_gmm_uncertainty(spark, sf):
    """Q13 (M3, P20, W9): Gaussian-mixture posterior entropy, ranked, with
    the 75th-percentile cut."""
    from embedscope.operators.mlmodels import uncertainty
    return uncertainty(T.planted(spark, sf), 4)


@register("cluster_tournament")
def q_cluster_tournament(spark, sf):
    """M8: k-means / GMM / Ward for k = 2..5 and 10, and DBSCAN:
    silhouette and Calinski-Harabasz per configuration, best silhouette."""
    from embedscope.operators.mlmodels import tournament
    return tournament(T.planted(spark, sf), 10, DBSCAN_EPS)


@register("pca_projection")
def q_pca_projection(spark, sf):
    """M9: 2-D PCA projection with the given label (chart data)."""
    from embedscope.operators.mlmodels import pca_2d
    p = T.planted(spark, sf)
    return pca_2d(p).join(p.select("id", "label"), "id")


@register("model_analysis")
def q_model_analysis(spark, sf):
    """Q11: per-model element statistics, best k, silhouette, mean
    distance, dimension and count."""
    from embedscope.operators.mlmodels import model_analysis
    return model_analysis(T.models(spark, sf))


# ---------------------------------------------------------------- sinks and sources

@register("scores_roundtrip")
def q_scores_roundtrip(spark, sf):
    """S10 + read back: corpus scores of two methods written partitioned by
    model and method to the shared folder, read back pruned to one method."""
    from embedscope.operators.scoring import corpus_scores
    from embedscope.sources.files import output_dir, read_scores, write_scores
    q, c = T.queries(spark, sf), T.corpus(spark, sf)
    parts = [corpus_scores(q, c, method=m).select("id", "score", F.lit("raw").alias("model"),
                                                  F.lit(m).alias("method"))
             for m in ("cosine", "manhattan")]
    path = write_scores(parts[0].unionByName(parts[1]), output_dir(spark, "scores"))
    return read_scores(spark, path, model="raw", method="cosine").select("id", "score", "model", "method")


# ---------------------------------------------------------------- reports

@register("pipeline_report")
def q_pipeline_report(spark, sf):
    """Report lines from the cluster statistics, consistency batch,
    global agreement and the combined ranking."""
    from embedscope.operators.agreement import global_agreement, pairwise_agreement
    from embedscope.operators.consistency import batch_statistics, response_metrics
    from embedscope.operators.reports import pipeline_report
    v = cut_lineage(T.doc_vectors(spark, sf))
    # each part feeds several lines and some the ranking too: write it once
    stats = cut_lineage(C.clustering_stats(v.select("label"), C.silhouette(v), 3, 2))
    cons = cut_lineage(response_metrics(T.doc_responses(spark, sf)))
    dists = cut_lineage(_doc_dists(spark, sf, v))
    batch = cut_lineage(batch_statistics(cons))
    agr = cut_lineage(global_agreement(pairwise_agreement(dists)))
    return pipeline_report(stats, batch, agr, _fused(spark, sf, v, cons, dists))


@register("consistency_report")
def q_consistency_report(spark, sf):
    """R2: consistency report of the conversation responses."""
    from embedscope.operators.consistency import batch_statistics, prompt_consistency
    from embedscope.operators.reports import consistency_report
    prompts, responses = _conversation_inputs(spark, sf)
    scored = prompt_consistency(prompts, responses)
    return consistency_report(scored, batch_statistics(scored))


@register("agreement_report")
def q_agreement_report(spark, sf):
    """Agreement report of the three embedding models."""
    from embedscope.operators.agreement import global_agreement, pairwise_agreement
    from embedscope.operators.reports import agreement_report
    pairs = pairwise_agreement(_doc_dists(spark, sf))
    return agreement_report(global_agreement(pairs), pairs, _prompt_agreement(spark, sf))


# ---------------------------------------------------------------- streaming

@register("stream_manifold_scores")
def q_stream_manifold_scores(spark, sf):
    """The embeddings file as a stream scored against the centres of the
    given labels."""
    from embedscope.streaming.stream import embeddings_stream, run_to_table, score_stream
    cents = C.centres(T.vectors(spark, sf))
    return run_to_table(spark, lambda sink, ck: score_stream(spark, embeddings_stream(spark, sf), cents,
                                                            sink, ck), "x1").drop("epoch")


@register("stream_corpus_scores")
def q_stream_corpus_scores(spark, sf):
    """A stream of the query vectors scored against the fixed corpus."""
    from embedscope.streaming.stream import corpus_stream, embeddings_stream, run_to_table
    arriving = embeddings_stream(spark, sf, F.col("label") >= T.CORPUS_LABEL_LIMIT)
    return run_to_table(spark, lambda sink, ck: corpus_stream(spark, arriving, T.corpus(spark, sf), sink, ck),
                        "x1c").drop("epoch")


@register("event_drift")
def q_event_drift(spark, sf):
    """X2 (batch): daily profile of each event type and its cosine drift
    from the previous day."""
    from embedscope.streaming.stream import daily_profiles, drift
    ev = T.table(spark, sf, "events").select("ts", "event_type", "value")
    return drift(daily_profiles(ev))


@register("stream_event_drift")
def q_stream_event_drift(spark, sf):
    """X2 (streaming): watermarked daily profiles from the events stream,
    then the drift step on the sink."""
    from embedscope.streaming.stream import drift, events_stream, latest, run_to_table, stream_daily_profiles
    prof = run_to_table(spark, lambda sink, ck: stream_daily_profiles(spark, events_stream(spark, sf),
                                                                      sink, ck), "x2")
    return drift(latest(prof, ["event_type", "day"]))


# ---------------------------------------------------------------- hierarchical density clustering

@register("hdbscan")
def q_hdbscan(spark, sf):
    """M6: hierarchical density clustering of the planted vectors
    (min_cluster_size 3, min_samples 2), labels per vector."""
    from embedscope.operators.hdbscan import hdbscan
    return hdbscan(T.planted(spark, sf), 3, 2)[0]


@register("full_pipeline")
def q_full_pipeline(spark, sf):
    """Q9 on every document: HDBSCAN -> manifold score -> consistency of five partial texts
    -> agreement of three models -> fusion -> report, written to the shared
    folder; returns the combined ranking."""
    from embedscope.plans.pipeline import run_full_pipeline
    v = cut_lineage(T.doc_vectors(spark, sf))
    out = run_full_pipeline(v.select("id", "embedding"), T.prompts(spark, sf), models=T.doc_models(spark, sf, v),
                            responses=T.doc_responses(spark, sf))
    return out["combined"]
