"""Queries of the profiling and geometry operators over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.operators import kernels, metrics, outliers, profile, rankstats, sampling, tokens, vectors
from vecloom.operators.hotkeys import tag
from vecloom.operators.rejects import classify_sentences, label_set, separate
from vecloom.plans.parsing import P1_SQL
from vecloom.schema import METRIC_BY_LAYER
from vecloom.session import settle, shared_dir
from vecloom.sources import embedder, manifolds, tables

POINT_METRICS = ["iso", "sf", "erank", "pr", "stable_rank", "vmf_kappa", "lpca", "lpca99", "twonn", "gride", "mle", "mom", "tle", "corrint", "fishers", "ess", "mada"]
FEATURES = ["pos", "index", "length", "head_dist", "relation_type", "arity"]

def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The token table, tags in one form and the numeric features as whole numbers where they are."""
    t = _read(spark, sf, "sentence_tokens")
    whole = {c: F.when((F.col(f"`{c}`") == F.floor(f"`{c}`")) & (F.abs(f"`{c}`") < 1e15), F.col(f"`{c}`").cast("bigint")) for c in ("index", "head_dist", "arity")}
    return t.withColumns({"pos": F.nullif(tag("pos"), F.lit("")), **whole})


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings")


# --- profiles ---------------------------------------------------------------------------------------------------------
def token_index_counts(spark, sf):
    return profile.histogram(_read(spark, sf, "sentence_tokens"), "index", 1, 10)


def token_length_hist(spark, sf):
    return profile.histogram(_read(spark, sf, "sentence_tokens"), "length", 1, 10)


def head_dist_hist(spark, sf):
    return profile.histogram(_read(spark, sf, "sentence_tokens"), "head_dist", -6, 6)


def arity_hist(spark, sf):
    return profile.histogram(_read(spark, sf, "sentence_tokens"), "arity", 0, 6)


def topk_pos(spark, sf):
    return profile.top_k(_tokens(spark, sf), "pos", 14)


def topk_relation(spark, sf):
    return profile.top_k(_read(spark, sf, "sentence_tokens"), "relation_type", 12)


def _profile_of(cls: str):
    def query(spark, sf):
        return profile.class_profile_wide(_tokens(spark, sf), cls, [f for f in FEATURES if f != cls])

    query.__name__ = f"class_profile_{cls}"
    return query


def class_profile_head_dist(spark, sf):
    t = _tokens(spark, sf).where(F.col("head_dist").between(-6, 6))
    return profile.class_profile_lists(t, "head_dist", [f for f in FEATURES if f != "head_dist"])


def class_profile_top5(spark, sf):
    return profile.class_profile(_tokens(spark, sf), "pos", ["index", "length", "head_dist", "relation_type", "arity"], 5)


# --- filters, classes, balancing --------------------------------------------------------------------------------------
def exclude_class_tokens(spark, sf):
    return tokens.without_pos(_read(spark, sf, "sentence_tokens")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def first_word_removed(spark, sf):
    return tokens.without_first(_read(spark, sf, "sentence_tokens")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


def index_classes(spark, sf):
    t = _read(spark, sf, "sentence_tokens").withColumn("index_class", tokens.index_class(F.col("index").cast("int")))
    return t.where("index_class is not null").groupBy("index_class").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("word_norm").alias("n_types"))


def least_class_size(spark, sf):
    t = _read(spark, sf, "sentence_tokens").where("relation_type is not null")
    return tokens.least_size(t, "relation_type", 1000).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


def fixed_freq(spark, sf):
    t = tokens.keep_first(_tokens(spark, sf).where("pos is not null").select("row_id", "word_id", "pos", "loaded_at"), ["row_id", "word_id"], ["loaded_at"])
    return sampling.balanced_frequency(t.select("pos", "row_id", "word_id"), "pos", ["row_id", "word_id"]).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def fixed_type(spark, sf):
    t = _tokens(spark, sf).where("pos is not null")
    return sampling.balanced_types(t, "pos", "word_norm").groupBy("pos").agg(F.count_distinct("word_norm").alias("n_types"))


def pos_x_right_left(spark, sf):
    t = _read(spark, sf, "sentence_tokens").withColumn("pos", tag("pos")).where("head_dist <> 0 and pos is not null and not isnan(head_dist)")
    return t.groupBy("pos", F.signum("head_dist").cast("int").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word_norm").alias("n_types"))


def pos_x_head_dist(spark, sf):
    return _tokens(spark, sf).where("pos is not null and head_dist between -6 and 6").groupBy("pos", "head_dist").agg(F.count(F.lit(1)).alias("n"))


def explode_shortest(spark, sf):
    s = _read(spark, sf, "en_ewt_ud_train_sentences")
    good = separate(classify_sentences(s, label_set(_read(spark, sf, "relation_labels"), "relation_type"))).valid
    t = tokens.expand_tokens(good.drop("sentence_id").withColumnRenamed("row_id", "sid"))
    return t.groupBy(F.col("sentence_id").alias("row_id")).agg(F.count(F.lit(1)).alias("n"), F.max("word_id").alias("last"), F.sum("index").alias("index_sum"), F.sum("arity").alias("arity_sum"))


def expanded_tokens(spark, sf):
    return tokens.expand_tokens(_read(spark, sf, "en_ewt_ud_train_sentences"), keep=["row_id"])


def sorted_classes(spark, sf):
    t = _read(spark, sf, "sentence_tokens").select(tokens.index_class(F.col("index").cast("int")).alias("index_class"))
    return t.where("index_class is not null").distinct().select("index_class", F.col("index_class").cast("int").alias("ord")).orderBy("ord")


def semi_join_reduce(spark, sf):
    wanted = _tokens(spark, sf).where("pos = 'INTJ'").select("row_id")
    return tokens.reduce_to(_read(spark, sf, "en_ewt_ud_train_sentences"), wanted, "row_id").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


def csv_scan(spark, sf):
    """The sentences written as CSV and read again, three columns of them: values, characters and different values of each."""
    s = _read(spark, sf, "en_ewt_ud_train_sentences").select("sentence_id", "newdoc_id", "tokens", "pos", "index")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    tables.write_csv(s, path)
    back = tables.read_csv(spark, path, ["sentence_id", "tokens", "pos"])
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in back.columns])).alias("c")
    return back.select(one).select("c.*").groupBy("name").agg(F.count("value").alias("n"), F.sum(F.length("value")).alias("chars"), F.count_distinct("value").alias("n_values"))


def first_sentences(spark, sf):
    return tables.first_rows(_read(spark, sf, "en_ewt_ud_train_sentences").select("row_id", "sentence_id", "tokens"), "row_id", 100)


def layer_table(spark, sf):
    """A metric of every label as a layer in the ten columns, written as CSV and read again."""
    p = vectors.participation(_embeddings(spark, sf), ["label"], "embedding")
    n = _embeddings(spark, sf).where("embedding is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n_tokens"))
    p = p.join(n, "label").select("label", F.lit("pr").alias("metric"), F.round("pr", 6).alias("mean"), F.round("pr", 6).alias("ci_low"), F.round("pr", 6).alias("ci_high"), "n_tokens")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    tables.write_results(tables.layer_rows(p, "synthetic", "syn", "label", "mean", "embeddings"), path, "csv")
    back = tables.read_any(spark, path, "csv").select(*METRIC_BY_LAYER)
    return back.withColumns({"layer": F.col("layer").cast("int"), "n_tokens": F.col("n_tokens").cast("bigint")} | {c: F.col(c).cast("double") for c in ("mean", "ci_low", "ci_high")})


def dense_ids(spark, sf):
    return tables.dense_id(_read(spark, sf, "en_ewt_ud_train_sentences").select("row_id"), ["row_id"])


def pool_sample(spark, sf):
    p = sampling.pool(_embeddings(spark, sf).select("vec_id"), ["vec_id"], 400)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"), F.min("global_idx").alias("least"), F.max("global_idx").alias("most"), F.count_distinct("global_idx").alias("n_idx"))


def subsample_sizes(spark, sf):
    s = sampling.subsamples(_embeddings(spark, sf).select("vec_id"), ["vec_id"], 200, 50)
    return s.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_ids"))


def first_delivery(spark, sf):
    s = _read(spark, sf, "en_ewt_ud_train_sentences").select("sentence_id", "loaded_at", "row_id")
    return tokens.keep_first(s, ["sentence_id"], ["loaded_at", "row_id"])


def balanced_rows(spark, sf):
    t = _tokens(spark, sf).where("pos is not null").select("pos", "row_id", "word_id")
    return sampling.balanced_frequency(t, "pos", ["row_id", "word_id"]).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def index_form(spark, sf):
    s = _read(spark, sf, "en_ewt_ud_train_sentences").drop("sentence_id").withColumnRenamed("row_id", "sid")
    return tokens.expand_by_index(s).groupBy("index_class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sentence_id").alias("n_sentences"), F.max("word_id").alias("last"))


def pos_form(spark, sf):
    s = _read(spark, sf, "en_ewt_ud_train_sentences").drop("sentence_id").withColumnRenamed("row_id", "sid")
    return tokens.expand_by_pos(s).groupBy(F.col("sentence_id").cast("bigint").alias("row_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("word_id").alias("places"))


# --- tokens with vectors ----------------------------------------------------------------------------------------------
def _first_tokens(spark, sf):
    t = _read(spark, sf, "sentence_tokens").where("word is not null").select("row_id", "word_id", "word", "index", "loaded_at")
    t = tokens.keep_first(t, ["row_id", "word_id"], ["loaded_at", "word", "index"])
    return t.select(F.col("row_id").alias("sentence_id"), "word_id", "word", tokens.index_class(F.col("index").cast("int")).alias("index_class"))


def _token_vectors(spark, sf, keep=("index_class",), digits=None, wide=False):
    """Every token that has a class with its vector of both layers; a class token without a vector is an error."""
    t = _read(spark, sf, "sentence_tokens").where("word is not null").select(F.col("row_id").alias("sentence_id"), "word_id", "word", "index", "loaded_at")
    t = embedder.together(t, ["loaded_at", "word", "index"]).select("sentence_id", "word_id", "word", tokens.index_class(F.col("index").cast("int")).alias("index_class"))
    v = embedder.embed_tokens(t, embedder.digest_model, list(keep), "mean", digits, wide)
    return embedder.require_vectors(v.where("index_class is not null"))


def token_vectors(spark, sf):
    return _token_vectors(spark, sf, digits=6).select(F.col("sentence_id").alias("row_id"), "word_id", "index_class", "layer", "vec")


def class_layer_metrics(spark, sf):
    keys = ["index_class", "layer"]
    both = vectors.isotropy(_token_vectors(spark, sf), keys, "vec")
    return both.select(*keys, "d", *[F.round(c, 5).alias(c) for c in ("pr", "iso_score", "vmf_kappa")])


def class_layer_bootstrap(spark, sf):
    b = metrics.bootstrap_moments(_token_vectors(spark, sf, wide=True), "index_class", "vec", "layers", "pr")
    return tables.result_rows(b, "all", "digest", "index", "index_class", "layer", "mean", "sentence_tokens")


def bootstrap_heavy(spark, sf):
    e = _embeddings(spark, sf).select("label", "vec_id", F.posexplode(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("layer", "vec"))
    return metrics.bootstrap(e, "label", "layer", "vec_id", "vec", "twonn")


def pca3d_tokens(spark, sf):
    v = _token_vectors(spark, sf, ["index_class", "word"]).withColumn("token_id", F.concat_ws("-", "sentence_id", "word_id"))
    return metrics.pca_projection(v, ["layer"], "token_id", "vec", keep=["index_class", "word"], few=True, d=8)


def missing_vectors(spark, sf):
    """Token positions of the whole table that have no vector, as they have no word."""
    t = _read(spark, sf, "sentence_tokens").select(F.col("row_id").alias("sentence_id"), "word_id").distinct()
    with_word = _first_tokens(spark, sf).select("sentence_id", "word_id")
    return spark.createDataFrame([(tables.missing_vectors(t, with_word, ["sentence_id", "word_id"]),)], "n_missing bigint")


# --- vectors ----------------------------------------------------------------------------------------------------------
def layer_dim_means(spark, sf):
    m = vectors.dim_means(_embeddings(spark, sf), ["label"], "embedding")
    return m.select("label", "dim", F.round("mean", 9).alias("mean"))


def outlier_counts(spark, sf):
    m = vectors.dim_means(_embeddings(spark, sf), ["label"], "embedding")
    o = outliers.outlier_dimensions(m, "label", z=1.5)
    return o.withColumn("mean_exceed", F.round("mean_exceed", 7))


def participation_ratio(spark, sf):
    p = vectors.participation(_embeddings(spark, sf), ["label"], "embedding")
    return p.select("label", "d", F.round("pr", 6).alias("pr"), F.round("iso_score", 6).alias("iso_score"))


def vmf_kappa(spark, sf):
    return vectors.vmf_kappa(_embeddings(spark, sf), ["label"], "embedding").withColumn("vmf_kappa", F.round("vmf_kappa", 5))


def scatter_matrix(spark, sf):
    return vectors.scatter_matrix(_embeddings(spark, sf), ["label"], "embedding").withColumn("s", F.round("s", 6))


def mean_abs_cosine(spark, sf):
    w = W.partitionBy("label").orderBy("vec_id")
    pairs = _embeddings(spark, sf).withColumn("next", F.lead("embedding").over(w)).where("next is not null")
    return vectors.mean_abs_cosine(pairs, ["label"], "embedding", "next").withColumn("mean_abs_cosine", F.round("mean_abs_cosine", 7))


def _near(spark, sf, k):
    return vectors.nearest(_embeddings(spark, sf), ["label"], "vec_id", "embedding", k)


def twonn(spark, sf):
    return vectors.two_nn(_near(spark, sf, 2), ["label"]).withColumn("twonn", F.round("twonn", 5))


def neighbour_dimensions(spark, sf):
    d = vectors.neighbour_dimensions(_near(spark, sf, 20), ["label"])
    return d.select("label", *[F.round(c, 5).alias(c) for c in ("mle", "mom", "mada")])


def neighbour_metrics(spark, sf):
    n = vectors.nearest_metrics(_embeddings(spark, sf), ["label"], "vec_id", "embedding")
    return n.select("label", "metric", F.round("value", 5).alias("value"), "n")


def corrint(spark, sf):
    return vectors.correlation_integral(_embeddings(spark, sf), ["label"], "vec_id", "embedding", 1.2, 1.35).withColumn("corrint", F.round("corrint", 5))


def _pooled(how: str):
    def query(spark, sf):
        e = _embeddings(spark, sf)
        return vectors.pooled(e, ["label"], "vec_id", "embedding", how).select("label", "dim", F.round("x", 7).alias("x"))

    query.__name__ = f"pooled_{how}"
    return query


def tensor_shape(spark, sf):
    return vectors.tensor_shape(_embeddings(spark, sf), "label", "embedding")


def spectral_metrics(spark, sf):
    return metrics.spectral_agg(_embeddings(spark, sf), ["label"], "embedding")


def vector_metrics(spark, sf):
    return metrics.vector_agg(_embeddings(spark, sf), ["label"], "vec_id", "embedding")


def pca3d(spark, sf):
    return metrics.pca_projection(_embeddings(spark, sf), ["label"], "vec_id", "embedding")


def bootstrap_pr(spark, sf):
    e = _embeddings(spark, sf).withColumn("layer", F.lit(0))
    return metrics.bootstrap(e, "label", "layer", "vec_id", "embedding", "pr", reps=50)


def bootstrap_ci_summary(spark, sf):
    m = vectors.dim_means(_embeddings(spark, sf), ["label"], "embedding")
    return sampling.confidence(m, ["label"], "mean").select("label", *[F.round(c, 8).alias(c) for c in ("mean", "ci_low", "ci_high")])


def metric_points(spark, sf):
    e = _embeddings(spark, sf).where("embedding is not null")
    return metrics.points_table(sampling.subsamples(e, ["vec_id"], 200, 50), "point_id", "vec_id", "embedding", POINT_METRICS)


def metric_correlation(spark, sf):
    p = settle(metric_points(spark, sf))
    return rankstats.spearman_matrix(p, p.columns[2:])


NUMBERS = ["index", "length", "head_dist", "arity"]


def spearman_matrix(spark, sf):
    s = rankstats.spearman_matrix(_read(spark, sf, "sentence_tokens"), NUMBERS)
    return s.select("m1", "m2", F.round("rho", 6).alias("rho"))


def spearman_cells(spark, sf):
    return rankstats.spearman_matrix(_read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("m1", "m2", "cell", F.round("p", 4).alias("p"))


SHOWN = {"length": "Length", "index": "Index", "arity": "Arity", "head_dist": "Head distance"}


def spearman_table(spark, sf):
    m = rankstats.spearman_matrix(_read(spark, sf, "sentence_tokens"), NUMBERS)
    return rankstats.labelled(m, ["length", "index", "missing", "arity", "head_dist"], SHOWN)


def _metric_rows(spark, sf):
    e = _embeddings(spark, sf)
    p = vectors.participation(e, ["label"], "embedding").join(vectors.vmf_kappa(e, ["label"], "embedding"), "label")
    return p.select("label", F.expr("stack(3, 'pr', pr, 'iso_score', iso_score, 'vmf_kappa', vmf_kappa) as (metric, value)"))


def minmax_normalise(spark, sf):
    return rankstats.min_max(_metric_rows(spark, sf), "metric", "value").select("label", "metric", F.round("norm", 5).alias("norm"))


def pivot_metrics(spark, sf):
    p = rankstats.pivot(_metric_rows(spark, sf), "metric", "label", "value", list(range(10)))
    return p.select("metric", *[F.round(F.col(f"`{i}`"), 5).alias(f"l{i}") for i in range(10)])


def manifold_sweep(spark, sf):
    p = manifolds.points(spark, 200)
    return metrics.vector_agg(p, ["manifold"], "point_id", "vec").join(F.broadcast(manifolds.catalog(spark)), "manifold").drop("notes")


def metric_labels(spark, sf):
    return spark.createDataFrame(sorted(kernels.LABELS.items()), "metric string, label string")


_ALL = [
    token_index_counts, token_length_hist, head_dist_hist, arity_hist, topk_pos, topk_relation,
    *[_profile_of(c) for c in ("pos", "index", "length", "relation_type", "arity")], class_profile_head_dist, class_profile_top5,
    exclude_class_tokens, first_word_removed, index_classes, least_class_size, fixed_freq, fixed_type, pos_x_right_left, pos_x_head_dist, explode_shortest, expanded_tokens, sorted_classes, semi_join_reduce, tensor_shape,
    csv_scan, first_sentences, layer_table, dense_ids, pool_sample, subsample_sizes, first_delivery, balanced_rows, index_form, pos_form, token_vectors, class_layer_metrics, class_layer_bootstrap, bootstrap_heavy, pca3d_tokens, missing_vectors, spearman_table,
    layer_dim_means, outlier_counts, participation_ratio, vmf_kappa, scatter_matrix, mean_abs_cosine, twonn, neighbour_dimensions, neighbour_metrics, corrint,
    *[_pooled(h) for h in ("first", "last", "mean")], spectral_metrics, vector_metrics, pca3d, bootstrap_pr, bootstrap_ci_summary, metric_points, metric_correlation,
    spearman_matrix, spearman_cells, minmax_normalise, pivot_metrics, manifold_sweep, metric_labels,
]
QUERIES = {f.__name__: f for f in _ALL}


def _hist(col: str, lo: int, hi: int) -> str:
    return f"""
        with d as (select unnest(generate_series({lo}, {hi})) as bin),
        c as (select cast(round_even("{col}", 0) as bigint) as bin, count(*) as n from sentence_tokens where "{col}" between {lo} and {hi} group by 1)
        select cast(d.bin as integer) as bin, coalesce(n, 0) as n from d left join c using (bin)"""


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_TAG = f"nullif(upper(trim(pos, {_BLANKS})), '')"
_T = f"""t as (select {_TAG} as pos, case when "index" = floor("index") then cast("index" as bigint) end as "index", length,
    case when head_dist = floor(head_dist) then cast(head_dist as bigint) end as head_dist, relation_type, case when arity = floor(arity) then cast(arity as bigint) end as arity, word_norm
    from sentence_tokens)"""


def _profile_sql(cls: str, features: list[str], where: str = "true", k: int = 1) -> str:
    long = " union all ".join(f"""select "{cls}" as cls, '{f}' as feature, cast("{f}" as varchar) as value from t where "{cls}" is not null and {where}""" for f in features)
    return f"""
        with {_T}, l as ({long}), b as (select "{cls}" as cls, count(*) as n_tokens, count(distinct word_norm) as n_types from t where "{cls}" is not null and {where} group by 1),
        c as (select cls, feature, value, count(*) as n from l where value is not null group by all),
        r as (select *, row_number() over (partition by cls, feature order by n desc, try_cast(value as double) nulls last, value) as rank from c),
        p as (select cls, n_tokens, n_types, feature, rank, value, n, round(100.0::double * n / n_tokens, 2) as pct from r join b using (cls) where rank <= {k})"""


def _wide_sql(cls: str) -> str:
    features = [f for f in FEATURES if f != cls]
    cols = ", ".join(f"max(value) filter (feature = '{f}') as \"top_{f}\", max(pct) filter (feature = '{f}') as \"top_{f}_pct\"" for f in features)
    return _profile_sql(cls, features) + f' select cls as "{cls}", n_tokens, n_types, {cols} from p group by all'


def _lists_sql(cls: str) -> str:
    features = [f for f in FEATURES if f != cls]
    cols = ", ".join(f"list({c} order by rank) filter (feature = '{f}') as \"top_{f}_{name}\"" for f in features for c, name in (("value", "vals"), ("n", "counts"), ("pct", "pct")))
    return _profile_sql(cls, features, "head_dist between -6 and 6", 5) + f' select cls as "{cls}", n_tokens, n_types, {cols} from p group by all'


_LONG = 'e as (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings)'
_MEANS = f"{_LONG}, m as (select label, dim, avg(x) as mean from e group by all)"
_SCATTER = f"""{_MEANS}, z as (select label, vec_id, dim, x - mean as x from e join m using (label, dim)),
    s as (select a.label, a.dim as i, b.dim as j, sum(a.x * b.x) as s from z a join z b on a.label = b.label and a.vec_id = b.vec_id group by all)"""
_PR = f"""{_SCATTER}, pr as (select label, max(i) + 1 as d, pow(sum(s) filter (i = j), 2) / (sum(s * s) + 1e-12) as pr from s group by 1),
    pi as (select label, d, pr, (pr - 1) / (d - 1) as iso_score from pr)"""
_KAPPA = f"""nn as (select label, vec_id, sqrt(sum(x * x)) as nv from e group by all),
    km as (select label, dim, avg(x / (nv + 1e-9)) as m from e join nn using (label, vec_id) group by all),
    kr as (select label, sqrt(sum(m * m)) as r, count(*) as d from km group by 1), k as (select label, greatest(r * (d - r * r) / (1 - r * r + 1e-9), 0) as vmf_kappa from kr)"""
_DIST = """d as (select a.label, a.vec_id as id, b.vec_id as other, list_distance(a.embedding::double[], b.embedding::double[]) as r from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id),
    nb as (select label, id, r, row_number() over (partition by label, id order by r, other) as rank from d)"""
_RANKED = " union all ".join(f"""select '{a}' as m1, '{b}' as m2, "{a}"::double as x, "{b}"::double as y from sentence_tokens where "{a}" is not null and "{b}" is not null""" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :])
_STACK = "v as (select label, 'pr' as metric, pr as value from pi union all select label, 'iso_score', iso_score from pi union all select label, 'vmf_kappa', vmf_kappa from k)"


def _pooled_sql(pick: str) -> str:
    return f"with {_LONG}, p as (select label, {pick}(vec_id) as vec_id from embeddings group by 1) select label, cast(dim as integer) as dim, round(x, 7) as x from e join p using (label, vec_id)"


# Two-sided p of a rank correlation by t with n - 2 degrees of freedom: the density of t by Simpson's rule from 0 to |t|.
_P = """case when n < 3 or rho is null then null when abs(rho) >= 1 then 0 else (
        select greatest(0, 1 - 2 * sum(w * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + (t * i / 400) * (t * i / 400) / v, -(v + 1) / 2) * t / 1200))
        from (select i, abs(rho) * sqrt((n - 2) / nullif(1 - rho * rho, 0)) as t, n - 2.0::double as v, case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end as w from range(401) s(i))) end"""
_STARS = "case when p < 1e-3 then '***' when p < 1e-2 then '**' when p < 5e-2 then '*' else '' end"


def _cells_sql(table: str, columns: list[str]) -> str:
    pairs = " union all ".join(f"""select '{a}' as m1, '{b}' as m2, "{a}"::double as x, "{b}"::double as y from {table} where "{a}" is not null and "{b}" is not null""" for i, a in enumerate(columns) for b in columns[i + 1 :])
    return f"""p0 as ({pairs}), r as (select m1, m2, rank() over (partition by m1, m2 order by x) + (count(*) over (partition by m1, m2, x) - 1) / 2 as rx,
            rank() over (partition by m1, m2 order by y) + (count(*) over (partition by m1, m2, y) - 1) / 2 as ry from p0),
        c as (select m1, m2, count(*) as n, corr(rx, ry) as rho from r group by all), q as (select *, {_P} as p from c), h as (select m1, m2, printf('%.2f', rho) || {_STARS} as cell, p from q),
        cells as (select * from h union all select m2, m1, cell, p from h union all select m, m, '1.00', 1.0::double from (select unnest({columns}) as m))"""


# The reading rules of list cells, for their number of elements: a list as Python writes it, else one element.
_STR = r"""(?:'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")"""
_PY = rf"""(?:{_STR}(?:\s*{_STR})*|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?|None|True|False)"""  # strings side by side are one
_PY_LIST = rf"""^\s*\[\s*(?:{_PY}\s*(?:,\s*{_PY}\s*)*(?:,\s*)?)?\]\s*$"""


#: Of a string literal: escapes resolved.
_UNESCAPED = r"""array_to_string(list_transform(regexp_extract_all(y[2:-2], '\\x[0-9a-fA-F]{2}|\\.|[^\\]+'), lambda z: case when z like '\x%' and len(z) = 4 then chr(cast('0x' || z[3:4] as integer)) when z[1] = '\' then z[2:] else z end), '')"""


def _elements(c: str, malformed: str = "wrap") -> str:
    quoted = f"trim({c})"
    other = f"[{quoted}]" if malformed == "wrap" else f"case when {quoted} like '[%]' then [] else [{quoted}] end"
    return f"""case when {c} is null then [] when regexp_matches({quoted}, {_quote(_PY_LIST)}) then list_transform(regexp_extract_all({quoted}, {_quote(_PY)}),
        lambda x: case when x[1] in (chr(39), '"') then array_to_string(list_transform(regexp_extract_all(x, {_quote(_STR)}), lambda y: {_UNESCAPED}), '') when x = 'None' then null else x end) else {other} end"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", 2 * "'") + "'"


_LISTS = "l as (select row_id, " + ", ".join(f'{_elements(chr(34) + c + chr(34))} as "{c}"' for c in ("tokens", "pos", "index", "head_dist", "relation_type", "ariety")) + " from en_ewt_ud_train_sentences)"

# Tokens, first delivery of each, and the vectors that digest_model() gives their pieces, averaged.
_FIRST = """f as (select row_id, word_id, word, case when trunc("index") >= 1 then cast(cast(least(trunc("index"), 10) as bigint) as varchar) end as index_class from sentence_tokens where word is not null
        qualify row_number() over (partition by row_id, word_id order by loaded_at nulls last, word, "index" nulls last) = 1)"""
_VECTORS = f"""{_FIRST}, pc as (select row_id, word_id, index_class, layer, md5(substr(word, start_at + 1, 4) || '|' || layer) as digest
        from (select *, unnest(range(0, greatest(length(word), 1), 4)) as start_at from f where index_class is not null) cross join (select unnest([0, 1]) as layer)),
    tv as (select row_id, word_id, index_class, layer, j, avg((instr('0123456789abcdef', substr(digest, j, 1)) - 1) / 7.5::double - 1) as x from pc cross join (select unnest(range(1, 9)) as j) group by all)"""
_BY_CLASS = f"{_VECTORS}, e as (select index_class || '|' || layer as label, row_id || '-' || word_id as vec_id, x, j - 1 as dim from tv)"

ORACLE = {
    "csv_scan": " union all ".join(f"select '{c}' as name, count(nullif({c}, '')) as n, cast(sum(length(nullif({c}, ''))) as bigint) as chars, count(distinct nullif({c}, '')) as n_values from en_ewt_ud_train_sentences" for c in ("sentence_id", "tokens", "pos")),
    "first_sentences": "select row_id, sentence_id, tokens from en_ewt_ud_train_sentences order by row_id limit 100",
    "layer_table": f"""with {_PR} select 'synthetic' as model, 'syn' as model_tag, 'mean' as word_rep_mode, 'pr' as metric, cast(label as integer) as layer, round(pr, 6) as mean, round(pr, 6) as ci_low, round(pr, 6) as ci_high, n_tokens,
        'embeddings' as source_csv from pi join (select label, count(embedding) as n_tokens from embeddings group by 1) using (label)""",
    "dense_ids": "select row_id, row_number() over (order by row_id) - 1 as token_id from en_ewt_ud_train_sentences",
    "pool_sample": "select least(count(*), 400) as n, least(count(*), 400) as n_ids, 0 as least, least(count(*), 400) - 1 as most, least(count(*), 400) as n_idx from embeddings",
    "subsample_sizes": "select cast(i as integer) as point_id, 50 as n, 50 as n_ids from range(200) s(i)",
    "first_delivery": "select sentence_id, loaded_at, row_id from en_ewt_ud_train_sentences qualify row_number() over (partition by sentence_id order by loaded_at nulls last, row_id) = 1",
    "balanced_rows": f"with n as (select {_TAG} as pos, count(*) as n from sentence_tokens where {_TAG} is not null group by 1) select pos, (select min(n) from n) as n from n",
    "index_form": f"""with {_LISTS}, t as (select row_id, unnest("index"[1:least(len(tokens), len("index"))]) as i, generate_subscripts("index"[1:least(len(tokens), len("index"))], 1) - 1 as word_id from l),
        c as (select row_id, word_id, least(try_cast(i as integer), 10) as k from t where regexp_full_match(trim(i), '[-+]?[0-9]+') and try_cast(i as integer) >= 1)
        select cast(k as varchar) as index_class, count(*) as n, count(distinct row_id) as n_sentences, cast(max(word_id) as integer) as last from c group by 1""",
    "expanded_tokens": f"""with {_LISTS.replace("select row_id,", "select row_id, sentence_id,")},
        n as (select *, least(len(tokens), len(pos), len("index"), len(head_dist), len(relation_type), len(ariety)) as n from l),
        t as (select row_id, sentence_id, unnest(range(n)) as i, tokens, pos, "index", head_dist, relation_type, ariety from n),
        w as (select *, coalesce(tokens[i + 1], 'None') as word from t)
        select sentence_id, row_id, cast(i as integer) as word_id, word, upper(pos[i + 1]) as pos, try_cast("index"[i + 1] as double) as "index", cast(length(word) as integer) as length, try_cast(head_dist[i + 1] as double) as head_dist,
            relation_type[i + 1] as relation_type, try_cast(ariety[i + 1] as double) as arity, replace(replace(replace(lower(replace(word, 'İ', 'i̇')), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's') as word_norm from w""",
    "pos_form": f"""with l as (select row_id, {_elements("tokens", "empty")} as tokens, {_elements("pos", "empty")} as pos from en_ewt_ud_train_sentences),
        t as (select row_id, unnest(pos[1:least(len(tokens), len(pos))]) as pos, generate_subscripts(pos[1:least(len(tokens), len(pos))], 1) - 1 as word_id from l)
        select row_id, count(*) as n, cast(sum(word_id) as bigint) as places from t where coalesce(pos not in ('X', 'SYM', 'INTJ', 'PART'), true) group by 1""",
    "explode_shortest": f"""with {_LISTS}, p1 as ({P1_SQL}), g as (select * from l where row_id not in (select row_id from p1 where src_name = 'en_ewt_ud_train_sentences')),
        n as (select *, least(len(tokens), len(pos), len("index"), len(head_dist), len(relation_type), len(ariety)) as n from g)
        select row_id, n, cast(n - 1 as integer) as last, list_sum(list_transform("index"[1:n], lambda x: try_cast(x as double))) as index_sum, list_sum(list_transform(ariety[1:n], lambda x: try_cast(x as double))) as arity_sum from n where n > 0""",
    "token_vectors": f"with {_VECTORS} select row_id, word_id, index_class, cast(layer as integer) as layer, list(round(x, 6) + 0.0::double order by j) as vec from tv group by all",
    "class_layer_metrics": f"with {_PR.replace(_LONG, _BY_CLASS)}, {_KAPPA} select split_part(label, '|', 1) as index_class, cast(split_part(label, '|', 2) as integer) as layer, cast(d as integer) as d, round(pr, 5) as pr, round(iso_score, 5) as iso_score, round(vmf_kappa, 5) as vmf_kappa from pi join k using (label)",
    "missing_vectors": "select count(*) as n_missing from (select row_id, word_id from sentence_tokens group by all having count(word) = 0)",
    "spearman_cells": f"with {_cells_sql('lineitem', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])} select m1, m2, cell, round(p, 4) as p from cells",
    "spearman_table": f"with {_cells_sql('sentence_tokens', NUMBERS)} select cast(list_position({list(SHOWN)}, m1) - 1 as integer) as ord, case m1 "
    + " ".join(f"when '{k}' then '{v}'" for k, v in SHOWN.items()) + " end as metric, " + ", ".join(f"max(cell) filter (m2 = '{k}') as \"{v}\"" for k, v in SHOWN.items()) + " from cells group by m1",
    "metric_labels": "select unnest(" + repr(sorted(kernels.LABELS)) + ") as metric, unnest([" + ", ".join(_quote(v) for _, v in sorted(kernels.LABELS.items())) + "]) as label",
    "token_index_counts": _hist("index", 1, 10),
    "token_length_hist": _hist("length", 1, 10),
    "head_dist_hist": _hist("head_dist", -6, 6),
    "arity_hist": _hist("arity", 0, 6),
    "topk_pos": f"with {_T} select pos as value, count(*) as n from t where pos is not null group by 1 order by n desc, value limit 14",
    "topk_relation": "select relation_type as value, count(*) as n from sentence_tokens where relation_type is not null group by 1 order by n desc, value limit 12",
    **{f"class_profile_{c}": _wide_sql(c) for c in ("pos", "index", "length", "relation_type", "arity")},
    "class_profile_head_dist": _lists_sql("head_dist"),
    "class_profile_top5": _profile_sql("pos", ["index", "length", "head_dist", "relation_type", "arity"], k=5) + " select * from p",
    "exclude_class_tokens": "select pos, count(*) as n from sentence_tokens where coalesce(pos not in ('X', 'SYM', 'INTJ', 'PART'), true) group by 1",
    "first_word_removed": "select batch_id, count(*) as n from sentence_tokens where word_id <> 0 group by 1",
    "index_classes": 'select cast(cast(least(trunc("index"), 10) as bigint) as varchar) as index_class, count(*) as n_tokens, count(distinct word_norm) as n_types from sentence_tokens where trunc("index") >= 1 group by 1',
    "least_class_size": "select relation_type, count(*) as n from sentence_tokens where relation_type is not null group by 1 having count(*) >= 1000",
    "fixed_freq": f"with c as (select {_TAG} as pos, row_id, word_id, row_number() over (partition by row_id, word_id) as k from sentence_tokens where {_TAG} is not null), n as (select pos, count(distinct (row_id, word_id)) as n from c group by 1) select pos, (select min(n) from n) as n from n",
    "fixed_type": f"with n as (select {_TAG} as pos, count(distinct word_norm) as n from sentence_tokens where {_TAG} is not null group by 1) select pos, (select min(n) from n) as n_types from n",
    "pos_x_right_left": f"select upper(trim(pos, {_BLANKS})) as pos, cast(sign(head_dist) as integer) as side, count(*) as n, count(distinct word_norm) as n_types from sentence_tokens where head_dist <> 0 and pos is not null and not isnan(head_dist) group by all",
    "pos_x_head_dist": f"with {_T} select pos, head_dist, count(*) as n from t where pos is not null and head_dist between -6 and 6 group by all",
    "sorted_classes": 'select distinct cast(cast(least(trunc("index"), 10) as bigint) as varchar) as index_class, cast(least(trunc("index"), 10) as integer) as ord from sentence_tokens where trunc("index") >= 1',
    "semi_join_reduce": f"select batch_id, count(*) as n from en_ewt_ud_train_sentences where row_id in (select row_id from sentence_tokens where {_TAG} = 'INTJ') group by 1",
    "tensor_shape": "select max(label) + 1 as n_layers, count(*) as n_vectors, min(len(embedding)) as least_dim, max(len(embedding)) as most_dim from embeddings",
    "layer_dim_means": f"with {_MEANS} select label, cast(dim as integer) as dim, round(mean, 9) as mean from m",
    "outlier_counts": f"""with {_MEANS}, l as (select avg(mean) + 1.5 * stddev_pop(mean) as thr from m), k as (select label, dim, mean, thr, mean >= thr as mask from m cross join l),
        p as (select *, lag(mask, 1, false) over (partition by dim order by label) as before from k)
        select label, count(*) filter (mask) as n_outliers, count(*) filter (mask and before) as overlap_prev, round(coalesce(avg(mean - thr) filter (mask), 0), 7) as mean_exceed from p group by 1""",
    "participation_ratio": f"with {_PR} select label, cast(d as integer) as d, round(pr, 6) as pr, round(iso_score, 6) as iso_score from pi",
    "vmf_kappa": f"with {_LONG}, {_KAPPA} select label, round(vmf_kappa, 5) as vmf_kappa from k",
    "scatter_matrix": f"with {_SCATTER} select label, cast(i as integer) as i, cast(j as integer) as j, round(s, 6) as s from s",
    "mean_abs_cosine": """with p as (select label, embedding::double[] as a, lead(embedding::double[]) over (partition by label order by vec_id) as b from embeddings)
        select label, round(avg(abs(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9))), 7) as mean_abs_cosine from p where b is not null group by 1""",
    "twonn": f"""with {_DIST}, q as (select label, id, max(r) filter (rank = 1) as r1, max(r) filter (rank = 2) as r2 from nb group by all),
        x as (select label, ln(r2 / r1) as x, row_number() over (partition by label order by ln(r2 / r1), id) as i, count(*) over (partition by label) as n from q where r1 > 0)
        select label, round(sum(x * -ln(1 - i / n)) / sum(x * x), 5) as twonn from x where i <= floor(n * 0.9::double) group by 1""",
    "neighbour_dimensions": f"""with {_DIST}, q as (select label, id, list(r order by rank) as rs from nb where rank <= 20 group by all having count(*) = 20),
        f as (select label, case when rs[1] > 0 then list_sum(list_transform(rs[1:19], lambda v: ln(rs[20] / v))) / 19 end as inv, list_sum(rs) / 20 as m1, rs[20] as w, rs[10] as h, rs[1] as r1 from q)
        select label, round(1 / avg(inv), 5) as mle, round(avg(case when w > m1 then m1 / (w - m1) end), 5) as mom, round(avg(case when r1 > 0 and w > h then ln(2) / ln(w / h) end), 5) as mada from f group by 1""",
    "neighbour_metrics": f"""with {_DIST}, q as (select label, id, list(r order by rank) as rs from nb where rank <= 100 group by all),
        f as (select label, id, rs, len(rs) as m, least(len(rs), 20) as k, least(len(rs), 21) - 1 as j, list_sum(rs) / len(rs) as m1 from q),
        x as (select label, ln(rs[2] / rs[1]) as x, row_number() over (partition by label order by ln(rs[2] / rs[1]), id) as i, count(*) over (partition by label) as n from f where rs[1] > 0 and m > 1),
        dd as (select label, d, count(*) * ln(j * d) + (d - 1) * sum(ln(rho)) + (j - 1) * sum(ln(1 - pow(rho, d))) as like_
            from (select label, j, greatest(least(rs[1] / rs[j + 1], 1 - 1e-12), 1e-12) as rho from f) cross join (select unnest(range(1, 11)) as d) group by label, j, d),
        v as (select label, 'twonn' as metric, sum(x * -ln(1 - i / n)) / sum(x * x) as value from x where i <= floor(n * 0.9::double) group by 1
            union all select label, 'mle', 1 / avg(case when rs[1] > 0 then list_sum(list_transform(rs[1:k - 1], lambda v: ln(rs[k] / v))) / (k - 1) end) from f group by 1
            union all select label, 'mom', avg(case when rs[m] > m1 then m1 / (rs[m] - m1) end) from f group by 1
            union all select label, 'mada', avg(case when rs[1] > 0 and rs[k] > rs[k // 2] then ln(2) / ln(rs[k] / rs[k // 2]) end) from f group by 1
            union all select label, 'mind_ml', arg_max(d, (like_, -d)) from dd group by 1)
        select label, metric, round(value, 5) as value, n from v join (select label, count(*) as n from f group by 1) using (label)""",
    "corrint": f"with {_DIST}, c as (select label, avg((r < 1.2::double)::int) as a, avg((r < 1.35::double)::int) as b from d group by 1) select label, round(case when a > 0 then (ln(b) - ln(a)) / (ln(1.35::double) - ln(1.2::double)) end, 5) as corrint from c",
    "pooled_first": _pooled_sql("min"),
    "pooled_last": _pooled_sql("max"),
    "pooled_mean": f"with {_MEANS} select label, cast(dim as integer) as dim, round(mean, 7) as x from m",
    "bootstrap_ci_summary": f"with {_MEANS} select label, round(avg(mean), 8) as mean, round(quantile_cont(mean, 0.025), 8) as ci_low, round(quantile_cont(mean, 0.975), 8) as ci_high from m group by 1",
    "spearman_matrix": f"""with p as ({_RANKED}), r as (select m1, m2, rank() over (partition by m1, m2 order by x) + (count(*) over (partition by m1, m2, x) - 1) / 2 as rx,
            rank() over (partition by m1, m2 order by y) + (count(*) over (partition by m1, m2, y) - 1) / 2 as ry from p),
        c as (select m1, m2, round(corr(rx, ry), 6) as rho from r group by all)
        select * from c union all select m2, m1, rho from c union all select m, m, 1.0::double from (select unnest({NUMBERS}) as m)""",
    "minmax_normalise": f"with {_PR}, {_KAPPA}, {_STACK}, l as (select metric, min(value) as lo, max(value) as hi from v group by 1) select label, metric, round(case when hi > lo then (value - lo) / (hi - lo) else 0 end, 5) as norm from v join l using (metric)",
    "pivot_metrics": f"with {_PR}, {_KAPPA}, {_STACK} select metric, {', '.join(f'round(max(value) filter (label = {i}), 5) as l{i}' for i in range(10))} from v group by 1",
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Participation ratio, IsoScore and vMF concentration of the embeddings by label."""
    e = _embeddings(spark, sf)
    return vectors.participation(e, ["label"], "embedding").join(vectors.vmf_kappa(e, ["label"], "embedding"), "label").orderBy("label")
