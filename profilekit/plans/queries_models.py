"""Queries: segmentation, propensity, measures, prototypes, retrieval."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import clean, measures, model_runs, profiles, propensity, segments, tfidf, vectors, views
from ..session import materialize, scratch_path
from . import checks as q
from . import queries_users as users
from .queries_users import master_table, TYPES, replied  # noqa: F401
from .registry import query
from .role_views import duck, role

# --- H segmentation --------------------------------------------------------------------------------

Z = ["edad", "ingreso_mensual_mxn", "score_buro"]


@query(
    "zscores",
    duck("r_customers")
    + " select user_id, "
    + ", ".join(q.r(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()") + f" as z_{c}" for c in Z)
    + " from r_customers",
)
def zscores(spark, sf):
    return segments.zscores(role(spark, sf, "r_customers"), Z)


RULES = [
    segments.NameRule("Explorador", "txn_pct_atipico"),
    segments.NameRule("Inversionista", "intent_inversion"),
    segments.NameRule("Sobreendeudado", "prod_util_media"),
    segments.NameRule("Basico", "prod_n_activos", -1),
    segments.NameRule("Empresario", "ingreso_mensual_mxn"),
    segments.NameRule("Moderado", "prod_util_max"),
]


def written_master(spark, sf) -> DataFrame:
    """The master table, written once: model fits read it many times."""
    return materialize(master_table(spark, sf), "master")


@query("kmeans_sweep")
def kmeans_sweep(spark, sf):
    df = written_master(spark, sf)
    return segments.kmeans_sweep(segments.Standardizer.fit(df).vectors(df))


@query("kmeans_segments")
def kmeans_segments(spark, sf):
    df = written_master(spark, sf)
    fitted = segments.Segmentation.fit(df, RULES)
    return fitted.transform(df).select("user_id", "segmento_id", "segmento_nombre")


@query("pca2")
def pca2(spark, sf):
    df = written_master(spark, sf)
    return segments.pca2(segments.Standardizer.fit(df).vectors(df))


PICKS = [("Mayor", "edad", 1), ("Rico", "ingreso_mensual_mxn", 1), ("Riesgo", "score_buro", -1)]


@query(
    "segment_names",
    q.with_(q.CUST, roles=["r_customers"])
    + f""", z as (select user_id, cid, {', '.join(f'({c} - avg({c}) over ()) / stddev_pop({c}) over () as {c}' for c in Z)}
  from (select *, (dense_rank() over (order by coalesce(ocupacion, '0')) - 1)::int as cid from cust)),
 c as (select cid, {', '.join(f'avg({c}) as {c}' for c in Z)} from z group by cid),
 p1 as (select cid from c order by edad desc, cid limit 1),
 p2 as (select cid from c where cid not in (from p1) order by ingreso_mensual_mxn desc, cid limit 1),
 p3 as (select cid from c where cid not in (from p1) and cid not in (from p2) order by score_buro, cid limit 1)
 select user_id, cid as segmento_id, case when cid in (from p1) then 'Mayor' when cid in (from p2) then 'Rico' when cid in (from p3) then 'Riesgo' else 'Segmento ' || cid end as segmento_nombre from z""",
)
def segment_names(spark, sf):
    from ..operators import master

    df = master.fill_missing(clean.clean_customers(role(spark, sf, "r_customers")))
    coded = master.encode_categories(df, ["ocupacion"])
    scaler = segments.Standardizer.fit(coded, Z)
    z = scaler.transform(coded, "z_").select(
        "user_id", F.col("ocupacion_code").alias("segmento_id"), *[F.col(f"z_{c}").alias(c) for c in Z]
    )
    names = segments.name_clusters(
        segments.centres_of(z, "segmento_id", Z), [segments.NameRule(*p) for p in PICKS]
    )
    return z.select("user_id", "segmento_id", segments.named(F.col("segmento_id"), names).alias("segmento_nombre"))


# --- H measures --------------------------------------------------------------------------------------

# all pairs: only possible because the check runs on few vectors
PAIRS = """
 pr as (select a.doc_id as i, a.label as li, b.label as lj, {dist} as d from r_vectors a join r_vectors b on a.doc_id <> b.doc_id),
 pm as (select i, li, lj, avg(d) as m from pr group by all),
 pa as (select i, max(m) filter (where li = lj) as a, min(m) filter (where li <> lj) as b from pm group by i)"""
SQUARED = "list_distance(a.embedding::double[], b.embedding::double[]) ** 2"
PLAIN = "list_distance(a.embedding::double[], b.embedding::double[])"
MEAN = "(select avg(case when a is null then 0 else (b - a) / greatest(a, b) end) from {t})"


def _pairs(dist: str, suffix: str) -> str:
    text = PAIRS.format(dist=dist)
    for name in ("pr", "pm", "pa"):
        text = text.replace(f" {name} ", f" {name}{suffix} ").replace(f"from {name} ", f"from {name}{suffix} ")
    return text


@query(
    "silhouette",
    q.with_(_pairs(SQUARED, "2"), _pairs(PLAIN, "1"), roles=["r_vectors"])
    + f"select {q.r(MEAN.format(t='pa2'))} as silueta_cuadrada, {q.r(MEAN.format(t='pa1'))} as silueta",
)
def silhouette(spark, sf):
    v = role(spark, sf, "r_vectors")
    squared = measures.silhouette_squared(v, "embedding", "label")
    sampled = measures.silhouette_sample(v, "doc_id", "embedding", "label")
    return spark.createDataFrame([(squared, sampled)], "silueta_cuadrada double, silueta double")


@query(
    "davies_bouldin",
    duck("r_vectors")
    + f""", p as (select label, i, avg(x::double) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from r_vectors) group by all),
 c as (select label, list(m order by i) as c from p group by label),
 s as (select label, avg(list_distance(embedding::double[], c)) as s from r_vectors join c using (label) group by label),
 w as (select a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) as r from c a join c b on a.label <> b.label join s sa on sa.label = a.label join s sb on sb.label = b.label group by a.label)
 select {q.r('avg(r)')} as davies_bouldin from w""",
)
def davies_bouldin(spark, sf):
    value = measures.davies_bouldin(role(spark, sf, "r_vectors"), "embedding", "label")
    return spark.createDataFrame([(value,)], "davies_bouldin double")


@query(
    "roc_auc",
    duck("r_scored")
    + f""", k as (select quality, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from r_scored),
 g as (select sum(quality)::bigint as p, sum(1 - quality)::bigint as n, sum(rk) filter (where quality = 1) as rp from k)
 select p as n_pos, n as n_neg, {q.r('(rp - p * (p + 1) / 2) / (p * n)')} as auc from g""",
)
def roc_auc(spark, sf):
    return measures.roc_auc(role(spark, sf, "r_scored"), "score", "quality")


SPAN = 2147483647


def _mixed():
    return F.col("doc_id") * 48271 % SPAN


@query(
    "stratified_folds",
    duck("r_scored")
    + f" select doc_id, quality, ((row_number() over (partition by quality order by doc_id * 48271 % {SPAN}, doc_id) - 1) % 5)::int as fold from r_scored",
)
def stratified_folds(spark, sf):
    df = role(spark, sf, "r_scored").select("doc_id", "quality")
    return measures.stratified_folds(df, "doc_id", "quality", 5, _mixed(), span=SPAN)


@query(
    "stratified_split",
    duck("r_scored")
    + f" select doc_id, quality, row_number() over (partition by quality order by doc_id * 48271 % {SPAN}, doc_id) <= ceil(0.2::double * count(*) over (partition by quality)) as es_test from r_scored",
)
def stratified_split(spark, sf):
    df = role(spark, sf, "r_scored").select("doc_id", "quality")
    return measures.stratified_split(df, "doc_id", "quality", 0.2, _mixed(), span=SPAN)


TARGETS = ["tiene_a", "tiene_b", "tiene_c", "tiene_d", "tiene_x"]


@query(
    "target_eligibility",
    duck("r_propensity")
    + " "
    + " union all ".join(
        f"select '{t}' as col_target, {q.r(f'avg({t})')} as tasa, avg({t}) between 0.03 and 0.97 as elegible from r_propensity"
        for t in TARGETS[:-1]
    )
    + f" union all select '{TARGETS[-1]}', null, false",
)
def target_eligibility(spark, sf):
    out = propensity.target_eligibility(role(spark, sf, "r_propensity"), TARGETS)
    return out.withColumn("elegible", F.coalesce("elegible", F.lit(False)))


# --- H propensity ------------------------------------------------------------------------------------

# every product type; training leaves out those that are not eligible
MODELLED = {f"tiene_{t}": t for t in TYPES}


def trained_run(spark, sf) -> tuple[DataFrame, propensity.PropensityModels]:
    """The master table and the models trained on it with the library's defaults, for all targets.

    The first learner query of a session trains and writes the run; the others load it.
    """
    known = getattr(spark, "_profilekit_runs", None)
    if known is None:
        known = spark._profilekit_runs = {}
    if sf not in known:
        df, root = written_master(spark, sf), scratch_path(spark, "runs")
        model_runs.save_run(propensity.train_propensity(df, MODELLED), root)
        known[sf] = df, root
    df, root = known[sf]
    return df, model_runs.load_run(spark, root)


@query("propensity_train")
def propensity_train(spark, sf):
    _, trained = trained_run(spark, sf)
    return trained.metrics.select("producto", "col_target", F.explode("top_features").alias("variable"))


@query("propensity_metrics")
def propensity_metrics(spark, sf):
    _, trained = trained_run(spark, sf)
    return trained.metrics.drop("top_features")


@query("cv_auc")
def cv_auc(spark, sf):
    _, trained = trained_run(spark, sf)
    return trained.folds.select("fold", "auc", "col_target")


def all_scores(df: DataFrame, trained: propensity.PropensityModels) -> DataFrame:
    """``col_target, user_id, tiene, score``: every user's unrounded score for every modelled target."""
    names = list(trained.ensembles)
    frame, _ = propensity.training_frame(df, names, trained.features, trained.encoder)
    if not names:
        return frame.select(F.lit("").alias("col_target"), "user_id", F.lit(0).alias("tiene"), F.lit(0.0).alias("score")).limit(0)
    scored = frame.select("user_id", propensity.scores(F.col("features"), list(trained.ensembles.values())).alias("_s"), *names)
    rows = F.array(*[F.struct(F.lit(t).alias("col_target"), F.col(t).alias("tiene"), F.get("_s", F.lit(i)).alias("score")) for i, t in enumerate(names)])
    return scored.select("user_id", F.inline(rows))


@query("calibrated_scores")
def calibrated_scores(spark, sf):
    return all_scores(*trained_run(spark, sf)).select("user_id", "tiene", "score", "col_target")


@query("propensity_scores")
def propensity_scores(spark, sf):
    return propensity_scores_of(*trained_run(spark, sf))


def propensity_scores_of(df: DataFrame, trained: propensity.PropensityModels) -> DataFrame:
    owned = list(trained.ensembles)
    scored = propensity.score_propensity(df, trained).join(df.select("user_id", *owned), "user_id")
    props = {f"prop_{t.removeprefix('tiene_')}": t for t in owned}
    return scored.withColumns({p: profiles.mask_owned(F.col(p), F.col(t)) for p, t in props.items()})


# what must hold of trained models whatever their seeds: SQL states it from the tables
HELD = q.with_(
    q.PROD, " m as (select c.user_id, " + ", ".join(f"coalesce(tiene_{t}, 0) as tiene_{t}" for t in TYPES) + " from r_customers c left join prod p on p.user_id = c.user_id)",
    roles=["r_products", "r_customers"],
)


@query(
    "propensity_invariants",
    HELD + " union all ".join(
        f"select '{t}' as col_target, {q.r(f'avg({t})')} as tasa, count(*) as n_users, count(*) as n_in_range, sum({t})::bigint as n_owned, sum({t})::bigint as n_masked, 5::bigint as n_folds from m having avg({t}) between 0.03 and 0.97"
        for t in MODELLED
    ),
)
def propensity_invariants(spark, sf):
    """Per modelled target: all users scored, between 0 and 1; owned products masked; an AUC between 0 and 1 for each fold."""
    df, trained = trained_run(spark, sf)
    masked = propensity_scores_of(df, trained)
    raw = all_scores(df, trained).groupBy("col_target").agg(
        F.avg("tiene").alias("tasa"), F.count("score").alias("n_users"), F.count_if(F.col("score").between(0, 1)).alias("n_in_range"), F.sum("tiene").alias("n_owned")
    )
    zeros = F.array(*[F.struct(F.lit(t).alias("col_target"), ((F.col(t) == 1) & (F.col(f"prop_{t.removeprefix('tiene_')}") == 0)).alias("_z")) for t in trained.ensembles])
    hidden = masked.select(F.inline(zeros)).groupBy("col_target").agg(F.count_if("_z").alias("n_masked"))
    folds = trained.folds.groupBy("col_target").agg(F.count_if(F.col("auc").between(0, 1)).alias("n_folds"))
    return raw.join(hidden, "col_target").join(folds, "col_target")


@query(
    "propensity_folds",
    HELD + ", k as (" + " union all ".join(f"select '{t}' as col_target, {t}::int as tiene, count(*) as n from m group by {t}" for t in MODELLED) + """),
 s as (select *, ceil(0.2::double * n)::bigint as t from k), f as (select unnest(range(5))::int as fold)
 select col_target, tiene, 'cruzada' as sistema, fold, (n - fold + 4) // 5 as n from s, f where n > fold
 union all select col_target, tiene, 'interna', fold, (n - t - fold + 4) // 5 from s, f where n - t > fold
 union all select col_target, tiene, 'interna', -2, t from s""",
)
def propensity_folds(spark, sf):
    """Sizes of all folds and of the test part (-2) per target and label."""
    df, params = written_master(spark, sf), propensity.TreeParams()
    owned = df.select("user_id", *[F.col(t).cast("int").alias(t) for t in MODELLED])
    both = owned.join(propensity.fold_table(owned, list(MODELLED), params), "user_id")
    places = [
        F.struct(F.lit(t).alias("col_target"), F.col(t).alias("tiene"), F.lit(name).alias("sistema"), F.col("folds")[2 * i + system].cast("int").alias("fold"))
        for i, t in enumerate(MODELLED) for system, name in enumerate(("cruzada", "interna"))
    ]
    return both.select(F.inline(F.array(*places))).groupBy("col_target", "tiene", "sistema", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "segment_invariants",
    duck("r_customers") + " select count(*) as n_users, 6::bigint as n_segments, count(*) as n_nearest, true as sizes_fall, true as cost_holds from r_customers",
)
def segment_invariants(spark, sf):
    """Every user lies in the segment of the nearest centre, ids go by falling size, and the cost is the sum of squared distances."""
    df = written_master(spark, sf)
    fitted = segments.Segmentation.fit(df, RULES)
    z = fitted.scaler.vectors(fitted.transform(df), ["user_id", "segmento_id"]).select("user_id", "segmento_id", vector_to_array("features").alias("x"))
    far = F.array(*[F.aggregate(F.zip_with("x", F.lit(c.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in fitted.centres])
    own = z.select("user_id", "segmento_id", far.alias("far"))
    sizes = own.groupBy("segmento_id").agg(F.count(F.lit(1)).alias("n"))
    falls = sizes.withColumn("_next", F.lead("n").over(Window.orderBy("segmento_id"))).agg(F.min(F.coalesce(F.col("_next") <= F.col("n"), F.lit(True))).alias("sizes_fall"))
    near = own.agg(
        F.count(F.lit(1)).alias("n_users"), F.countDistinct("segmento_id").alias("n_segments"),
        F.count_if(F.get("far", F.col("segmento_id")) <= F.array_min("far") + 1e-9).alias("n_nearest"), F.sum(F.array_min("far")).alias("_cost"),
    )
    return near.join(falls).select("n_users", "n_segments", "n_nearest", "sizes_fall", (F.abs(F.col("_cost") / fitted.cost - 1) < 1e-3).alias("cost_holds"))


# --- I vectors -----------------------------------------------------------------------------------------


@query(
    "l2_normalize",
    f"""with n as (select vec_id as doc_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos, sqrt(list_inner_product(embedding::double[], embedding::double[])) + 1e-9 as nn from embeddings)
 select doc_id, pos::int as pos, {q.r('x / nn')} as valor from n""",
)
def l2_normalize(spark, sf):
    v = role(spark, sf, "r_vectors")
    return v.select("doc_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("pos", "valor"))


@query(
    "class_prototypes",
    q.with_(q.PROTOS, roles=["r_vectors"])
    + f"select label, n, pos::int as pos, {q.r('x')} as valor from (select label, n, unnest(proto) as x, generate_subscripts(proto, 1) - 1 as pos from protos)",
)
def class_prototypes(spark, sf):
    out = vectors.class_prototypes(role(spark, sf, "r_vectors"))
    return out.select("label", "n", F.posexplode("proto").alias("pos", "valor"))


SCORED = q.with_(q.PROTOS, f" s as ({q.proto_scores('r_vectors', 'doc_id, clase')})", roles=["r_vectors"])


def scored_vectors(spark, sf, calibrate: bool = False):
    v = role(spark, sf, "r_vectors")
    return v, vectors.PrototypeModel.fit(v, calibrate=calibrate)


@query("prototype_sims", SCORED + f"select doc_id, {q.r('sim_noise')} as sim_noise, {q.r('sim_on_topic')} as sim_on_topic from s")
def prototype_sims(spark, sf):
    v, model = scored_vectors(spark, sf)
    return model.sims(v).select("doc_id", "sim_noise", "sim_on_topic")


@query("noise_relative_score", SCORED + f"select doc_id, {q.r('score')} as score from s")
def noise_relative_score(spark, sf):
    v, model = scored_vectors(spark, sf)
    return model.transform(v).select("doc_id", "score")


GRID = ", ".join(f"({t!r}::double)" for t in fv.THRESHOLD_GRID)


def _sweep(source: str, score: str, truth: str) -> str:
    return f"""
 grid(umbral) as (values {GRID}),
 swp as (select umbral, count(*) filter (where {truth} and {score} >= umbral) as tp, count(*) filter (where not ({truth}) and {score} >= umbral) as fp,
  count(*) filter (where {truth} and not ({score} >= umbral)) as fn from grid cross join {source} group by umbral)"""


F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"


@query(
    "threshold_sweep",
    q.with_(_sweep("r_scored", "score", "toxic = 1"), roles=["r_scored"])
    + f"select {q.r('umbral')} as umbral, tp, fp, fn, {q.r(F1)} as f1 from swp",
)
def threshold_sweep(spark, sf):
    return vectors.threshold_sweep(role(spark, sf, "r_scored"), "score", "toxic")


@query(
    "prototype_classify",
    q.with_(
        q.PROTOS, f" s as ({q.proto_scores('r_vectors', 'doc_id, clase')})", _sweep("s", "score", "clase = 'noise'"),
        f" best as (select coalesce(arg_max(umbral, ({F1}, -umbral)) filter (where {F1} > 0), 0.5) as u from swp)",
        roles=["r_vectors"],
    )
    + f"select doc_id, {q.r('sim_noise')} as sim_noise, {q.r('sim_on_topic')} as sim_on_topic, {q.r('score')} as score, score >= u as es_noise from s, best",
)
def prototype_classify(spark, sf):
    v, model = scored_vectors(spark, sf, calibrate=True)
    return model.classify(v).select("doc_id", "sim_noise", "sim_on_topic", "score", "es_noise")


def _report_row(name: str, p: str, r: str, f: str, s: str) -> str:
    return f"select '{name}' as clase, {q.r(f'coalesce({p}, 0)')} as precision, {q.r(f'coalesce({r}, 0)')} as recall, {q.r(f'coalesce({f}, 0)')} as f1, ({s})::bigint as support from c"


P0, R0, F0 = "coalesce(tn / nullif(tn + fn, 0), 0)", "coalesce(tn / nullif(tn + fp, 0), 0)", "coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)"
P1, R1, F1C = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)", "coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0)"
ACC = "(tp + tn) / (tp + tn + fp + fn)"


@query(
    "classification_report",
    duck("r_scored")
    + """, c as (select count(*) filter (where t and p) as tp, count(*) filter (where not t and p) as fp, count(*) filter (where t and not p) as fn, count(*) filter (where not t and not p) as tn
 from (select quality = 1 as t, score >= 0.5 as p from r_scored)) """
    + " union all ".join(
        [
            _report_row("on_topic", P0, R0, F0, "tn + fp"),
            _report_row("noise", P1, R1, F1C, "tp + fn"),
            _report_row("accuracy", ACC, ACC, ACC, "tp + tn + fp + fn"),
            _report_row("macro avg", f"({P0} + {P1}) / 2", f"({R0} + {R1}) / 2", f"({F0} + {F1C}) / 2", "tp + tn + fp + fn"),
            _report_row(
                "weighted avg",
                *[f"({a} * (tn + fp) + {b} * (tp + fn)) / (tp + tn + fp + fn)" for a, b in ((P0, P1), (R0, R1), (F0, F1C))],
                "tp + tn + fp + fn",
            ),
        ]
    ),
)
def classification_report(spark, sf):
    df = role(spark, sf, "r_scored").select("quality", (F.col("score") >= 0.5).cast("int").alias("pred"))
    return measures.classification_report(df, "quality", "pred")


# --- I retrieval -----------------------------------------------------------------------------------------

# vectors of the test table are unrelated: the default limit of 0.65 would only find a vector itself
MIN_SIM = 0.25

DENSE = """
 vp as (select a.doc_id as q, b.doc_id as d, list_inner_product(a.embedding::double[], b.embedding::double[]) as sim from r_vectors a cross join r_vectors b),
 answers as (select doc_id as d, output from r_vectors)"""


@query(
    "dense_topk",
    q.with_(DENSE, q.topk("vp", MIN_SIM), roles=["r_vectors"])
    + f"select q as mensaje, rn::int as rn, d as doc_id, {q.r('similitud')} as similitud, output from hits",
)
def dense_topk(spark, sf):
    v = role(spark, sf, "r_vectors")
    asked = v.select(F.col("doc_id").alias("mensaje"), "embedding")
    return vectors.dense_topk(asked, v, "mensaje", "doc_id", min_sim=MIN_SIM)


CORPUS = """
 corpus_docs as (select doc_id, text from documents),
 query_docs as (select item_id as query_id, text from benchmark)"""


@query(
    "tfidf_postings",
    f"with {CORPUS}, {q.TFIDF} select doc_id, term, {q.r('weight')} as weight from postings",
)
def tfidf_postings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = tfidf.TfidfModel.fit(docs, "doc_id", "text")
    return model.postings(docs, "doc_id", "text").select(F.col("d").alias("doc_id"), "term", "weight")


SPARSE = """
 tp as (select query_id as q, doc_id as d, sum(qw.weight * postings.weight) as sim from qw join postings using (term) group by all),
 answers as (select doc_id as d, text as output from documents)"""
HITS = f"with {CORPUS}, {q.TFIDF}, {SPARSE}, {q.topk('tp', fv.SPARSE_MIN_SIM)}"


def benchmark_hits(spark, sf) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("text", "pregunta")
    model = tfidf.TfidfModel.fit(docs, "doc_id", "text")
    return tfidf.tfidf_topk(model, asked, docs, "item_id", "pregunta", "doc_id", "text", "text")


@query(
    "tfidf_topk",
    HITS + f" select q as item_id, rn::int as rn, d as doc_id, {q.r('similitud')} as similitud, md5(output) as respuesta from hits",
)
def tfidf_topk(spark, sf):
    hits = benchmark_hits(spark, sf)
    return hits.select("item_id", "rn", "doc_id", "similitud", F.md5("text").alias("respuesta"))


@query(
    "retrieval_context",
    q.with_(DENSE, q.topk("vp", MIN_SIM), roles=["r_vectors"])
    + """select q as mensaje, 'Ejemplos' || chr(10) || string_agg('Ejemplo ' || rn || ' (' || round(similitud * 100)::int || '%):' || chr(10) || 'Pregunta: vector ' || d || chr(10) || 'Respuesta: ' || output || chr(10), chr(10) order by rn) as contexto from hits group by q""",
)
def retrieval_context(spark, sf):
    v = role(spark, sf, "r_vectors")
    asked = v.select(F.col("doc_id").alias("mensaje"), "embedding")
    hits = vectors.dense_topk(asked, v, "mensaje", "doc_id", min_sim=MIN_SIM).withColumn(
        "input", F.concat(F.lit("vector "), F.col("doc_id").cast("string"))
    )
    return vectors.retrieval_context(hits, "mensaje", heading="Ejemplos\n", with_similarity=True)


TURN_TEMPLATE = users.TEMPLATE + "\nLargo: {largo}. Emojis: {emoji}. Urgencia: {urgente}\n{ejemplos}"


@query(
    "turn_agent_context",
    q.with_(
        q.CUST, q.TXN, q.PROD, q.CONV, users.MASTER_CTE, users.TOP, users.DIMS_CTE, users.PROFILES_CTE, users.STYLES, f"ins as ({users.INSTRUCTIONS})", DENSE, q.topk("vp", MIN_SIM),
        f"""lists as (select *, list_filter([case when noise_score_usuario >= 0.4::double then 'noise' end, case when flag_credito_estresado = 1 then 'estresado' end,
  case when flag_riesgo_churn = 1 then 'churn' end, case when flag_uso_atipico = 1 then 'atipico' end, case when conv_frustracion >= 2 then 'frustracion' end], lambda x: x is not null) as al,
  list_filter([producto_top_1, producto_top_2, producto_top_3], lambda x: x <> '') as l from prf)""",
        f"""known as (select user_id, ' (' || coalesce(segmento_nombre, '') || '), ingreso $' || format('{{:,}}', round(ingreso_mensual_mxn)::bigint) || ', ' || (antiguedad_dias // 365) || ' anios, tono ' || coalesce(tono, '')
  || chr(10) || 'Alertas: ' || case when len(al) = 0 then 'ok' else array_to_string(al, ',') end || chr(10) || 'Productos:' || chr(10) || {users.RECOMMENDED}
  || chr(10) || 'Largo: ' || largo || '. Emojis: ' || emoji || '. Urgencia: ' || urgente as body from lists join ins using (user_id))""",
        """blocks as (select q as message_id, 'Ejemplos' || chr(10) || string_agg('Ejemplo ' || rn || ' (' || round(similitud * 100)::int || '%):' || chr(10) || 'Pregunta: vector ' || d || chr(10) || 'Respuesta: ' || output || chr(10), chr(10) order by rn) as ejemplos from hits group by q)""",
        roles=["r_customers", "r_transactions", "r_products", "r_messages", "r_propensity", "r_vectors"],
    )
    + """select message_id, user_id, 'Cliente ' || coalesce(user_id::varchar, '')
  || coalesce(body, ' (), ingreso ,  anios, tono ' || chr(10) || 'Alertas: ' || chr(10) || 'Productos:' || chr(10) || chr(10) || 'Largo: . Emojis: . Urgencia: ') || chr(10) || coalesce(ejemplos, '') as contexto
 from r_messages left join known using (user_id) left join blocks using (message_id)""",
)
def turn_agent_context(spark, sf):
    known = users.agent_users(spark, sf).join(users.instructions(spark, sf), "user_id")
    blocks = retrieval_context(spark, sf).withColumnRenamed("mensaje", "message_id")
    return views.turn_contexts(role(spark, sf, "r_messages"), known, blocks, TURN_TEMPLATE)
