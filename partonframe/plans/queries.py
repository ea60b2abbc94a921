"""The engine's queries over the star-schema tables, and the same in DuckDB SQL.

Orders of a customer make an event, their line items its particles. Doubles are rounded to four places, and
0.0 is added to them so that there is no negative zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kinematics as K
from ..functions import udtf
from ..functions.angles import angular_distance, confine_angle
from ..functions.factors import ca_distance2, factor, singularity_factor
from ..operators import decay, history, integrity, jets, kmeans, matching, pairwise, references
from ..operators.cluster import cluster, cluster_batch, from_kinematics, nodes, spectral_trace, wavelet_values
from ..sources import external, particle_data
from ..sources.parquet import to_wide
from ..shared import new_folder
from ..streaming.clustering import cluster_stream, sessions, windowed
from . import oracles
from .eventset import EventSet

VIEW = """
    with e as (
      select {event} event_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate
      from {lineitem} join {orders} on l_orderkey = o_orderkey),
    b as (
      select event_id,
             row_number() over (partition by event_id order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 idx,
             l_quantity pt,
             ((cast(l_partkey as double) * cast(0.1 as double)) % (2 * pi())) - pi() phi,
             (l_extendedprice % cast(500 as double)) / cast(100 as double) - cast(2.5 as double) y,
             cast(1.01 as double) + l_tax m
      from e),
    k as (select event_id, idx, pt * cos(phi) px, pt * sin(phi) py, m * pt * (exp(y) - exp(-y)) / 2 pz, m * pt * (exp(y) + exp(-y)) / 2 energy from b)
    select event_id, cast(idx as bigint) idx, px, py, pz, energy from k"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_particles(spark: SparkSession, sf_dir: str, event: str = "o_custkey", partitions: int | None = None) -> DataFrame:
    """``partitions`` deals the events out to so many, which aren't put together again however few bytes they have."""
    text = VIEW.replace("{event}", f"/*+ repartition({partitions}, event_id) */ {event}" if partitions else event)
    return spark.sql(text, lineitem=read(spark, sf_dir, "lineitem"), orders=read(spark, sf_dir, "orders"))


def particles(spark: SparkSession, sf_dir: str, event: str = "o_custkey", partitions: int | None = None) -> DataFrame:
    return from_kinematics(raw_particles(spark, sf_dir, event, partitions))


def _even(spark: SparkSession) -> int:
    """Partitions for work that takes long for its bytes: a last task is a small part of a core's share then."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def rounded(x: Column | str, name: str, places: int = 4) -> Column:
    return (F.round(x, places) + F.lit(0.0)).alias(name)


def _sql(select: str, more: str = "", event: str = "o_custkey") -> str:
    view = VIEW.replace("{event}", event).replace("{lineitem}", "lineitem").replace("{orders}", "orders")
    rapidity = "sign(pz) * 0.5 * ln((pt * pt + greatest(energy * energy - pz * pz - pt * pt, 0)) / ((energy - abs(pz)) * (energy - abs(pz))))"
    p = f"p as (select *, case when pz = 0 then 0e0 else {rapidity} end rapidity from (select *, sqrt(px * px + py * py) pt, atan2(py, px) phi from ({view})))"
    return f"with {p}{', ' + more if more else ''} {select}"


def r(x: str, name: str, places: int = 4) -> str:
    return f"round({x}, {places}) + 0e0 as {name}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# kinematics
THETA = "atan2(pt, pz)"
PSEUDO = f"(case when {THETA} > pi() / 2 then -1e0 else 1e0 end) * -ln(tan(least({THETA}, pi() - {THETA}) / 2))"
MASS = "sqrt(energy * energy - px * px - py * py - pz * pz)"


def _kin(columns: Callable[[], dict[str, Column]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return particles(spark, sf_dir).select("event_id", "idx", *[rounded(c, n) for n, c in columns().items()])

    return run


def _kin_sql(**columns: str) -> str:
    return _sql(f"select event_id, idx, {', '.join(r(c, n) for n, c in columns.items())} from p")


for _name, _spark, _duck in (
    ("kin_pt_phi", lambda: {"pt": K.pt("px", "py"), "phi": K.phi("px", "py")}, {"pt": "pt", "phi": "phi"}),
    ("kin_theta", lambda: {"theta": K.theta("pt", "pz")}, {"theta": THETA}),
    ("kin_rapidity", lambda: {"rapidity": K.rapidity("pt", "pz", "energy")}, {"rapidity": "rapidity"}),
    ("kin_pseudorapidity", lambda: {"pseudorapidity": K.pseudorapidity(K.theta("pt", "pz"))}, {"pseudorapidity": PSEUDO}),
    ("kin_mass", lambda: {"mass": K.mass("energy", "px", "py", "pz")}, {"mass": MASS}),
    ("angle_confine", lambda: {"angle": confine_angle(F.col("phi") * 3)}, {"angle": "((((phi * 3 + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi())) - pi()"}),
    ("angle_distance", lambda: {"gap": angular_distance("phi", "rapidity")}, {"gap": "least((((phi - rapidity) % (2 * pi())) + 2 * pi()) % (2 * pi()), (((rapidity - phi) % (2 * pi())) + 2 * pi()) % (2 * pi()))"}),
    ("birr_fix", lambda: {"birr": references.birr(F.col("pt"), F.col("pz"))}, {"birr": "sqrt(pt * pt + pz * pz)"}),
    ("inverse_momenta", lambda: dict(zip(("x", "y", "z"), K.px_py_pz("energy", "pt", "rapidity", "phi"), strict=True)), {"x": "pt * cos(phi)", "y": "pt * sin(phi)", "z": "energy * (exp(rapidity) - exp(-rapidity)) / (exp(rapidity) + exp(-rapidity))"}),
):
    query(_name, _kin_sql(**_duck))(_kin(_spark))


@query("kin_all", _kin_sql(Theta=THETA, PT="pt", Phi="phi", Rapidity="rapidity", PseudoRapidity=PSEUDO, Mass=MASS))
def kin_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = raw_particles(spark, sf_dir).withColumnsRenamed({"px": "Px", "py": "Py", "pz": "Pz", "energy": "Energy"})
    return K.add_all(named, with_mass=True).select("event_id", "idx", *[rounded(c, c) for c in ("Theta", "PT", "Phi", "Rapidity", "PseudoRapidity", "Mass")])


@query("inf_rapidity_clean", _sql("select event_id, count(*) filter (pz * 50 > 999) as plus, count(*) filter (pz * 50 < -999) as minus from p group by event_id"))
def inf_rapidity_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = particles(spark, sf_dir).select("event_id", K.big_to_inf(F.col("pz") * 50).alias("x"))
    return cleaned.groupBy("event_id").agg(F.count_if(F.col("x") == float("inf")).alias("plus"), F.count_if(F.col("x") == float("-inf")).alias("minus"))


# pairs
DPHI = "least((((a.phi - b.phi) % (2 * pi())) + 2 * pi()) % (2 * pi()), (((b.phi - a.phi) % (2 * pi())) + 2 * pi()) % (2 * pi()))"
D2 = f"({DPHI} * {DPHI} + (a.rapidity - b.rapidity) * (a.rapidity - b.rapidity))"
PAIRS = f"q as (select a.event_id, a.idx i, b.idx j, a.pt pt_i, b.pt pt_j, {D2} d2 from p a join p b on a.event_id = b.event_id and a.idx < b.idx)"
BOTH = f"q as (select a.event_id, a.idx i, b.idx j, a.pt pt_i, b.pt pt_j, {D2} d2 from p a join p b on a.event_id = b.event_id and a.idx <> b.idx)"
SIGMA = 0.15


def _pair_sum(value: str) -> str:
    return _sql(f"select event_id, count(*) as n, {r(f'sum({value})', 'total')} from q group by event_id", PAIRS)


def _pair_query(value: Callable[[], Column]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pairwise.pairs(particles(spark, sf_dir)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(value()), "total"))

    return run


def _dist2() -> Column:
    return ca_distance2("rapidity_i", "phi_i", "rapidity_j", "phi_j")


@query("pairs_ca_dist2", _sql(f"select event_id, count(*) as n, {r('min(d2)', 'low')}, {r('avg(d2)', 'mean')}, {r('max(d2)', 'high')} from q group by event_id", PAIRS))
def pairs_ca_dist2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairwise.with_distance2(pairwise.pairs(particles(spark, sf_dir)))
    return d.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.min("dist2"), "low"), rounded(F.avg("dist2"), "mean"), rounded(F.max("dist2"), "high"))


for _name, _spark, _duck in (
    ("pairs_genkt", lambda: _dist2() * factor("genkt", -1, "pt_i", "pt_j") ** 2, "d2 * least(1 / pt_i, 1 / pt_j) * least(1 / pt_i, 1 / pt_j)"),
    ("pairs_ratiokt", lambda: _dist2() * factor("ratiokt", 1, "pt_i", "pt_j") ** 2, "d2 * (least(pt_i, pt_j) / greatest(pt_i, pt_j)) * (least(pt_i, pt_j) / greatest(pt_i, pt_j))"),
    ("pairs_suppressedkt", lambda: _dist2() * factor("suppressedkt", 2, "pt_i", "pt_j") ** 2, "d2 * (1 - 2e0 / (2e0 + least(pt_i, pt_j))) * (1 - 2e0 / (2e0 + least(pt_i, pt_j)))"),
    ("pairs_singularity", lambda: singularity_factor(0.01, _dist2(), "pt_i", "pt_j"), "1 - 1e-2 / (1e-2 + least(pt_i, pt_j) * sqrt(d2))"),
    ("pairs_affinity", lambda: F.exp(-_dist2() / SIGMA), f"exp(-d2 / {SIGMA}e0)"),
):
    query(_name, _pair_sum(_duck))(_pair_query(_spark))


def _affine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = particles(spark, sf_dir)
    return p, pairwise.with_affinity(pairwise.with_distance2(pairwise.pairs(p, ordered=True)), SIGMA)


@query("affinity_degree", _sql(f"select event_id, i, {r(f'sum(exp(-d2 / {SIGMA}e0))', 'degree')} from q group by event_id, i", BOTH))
def affinity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.degree(_affine(spark, sf_dir)[1]).select("event_id", "i", rounded("degree", "degree"))


def _laplacian(norm: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        on = F.col("i") == F.col("j")
        value = F.col("value")
        return pairwise.graph_laplacian(particles(spark, sf_dir), SIGMA, norm=norm).groupBy("event_id").agg(rounded(F.sum(F.when(on, value)), "trace"), rounded(F.sum(value * value), "frobenius2"), rounded(F.min(F.when(~on, value)), "low"))

    return run


def _laplacian_sql(scale: str) -> str:
    more = BOTH + f""", f as (select *, exp(-d2 / {SIGMA}e0) v from q), d as (select p.event_id, p.idx i, p.pt, coalesce(sum(v), 0) deg from p left join f on p.event_id = f.event_id and p.idx = f.i group by all),
        s as (select *, coalesce({scale}, 0) s from d), l as (select f.event_id, f.i, f.j, -f.v * a.s * b.s v from f join s a on f.event_id = a.event_id and f.i = a.i join s b on f.event_id = b.event_id and f.j = b.i
        union all select event_id, i, i, deg * s * s from s)"""
    return _sql(f"select event_id, {r('sum(v) filter (i = j)', 'trace')}, {r('sum(v * v)', 'frobenius2')}, {r('min(v) filter (i <> j)', 'low')} from l group by event_id", more)


for _norm, _scale in (("unnormed", "1e0"), ("symmetric", "case when deg > 0 then 1 / sqrt(deg) end"), ("pt", "1 / sqrt(pt)")):
    query(f"laplacian_{_norm}", _laplacian_sql(_scale))(_laplacian(_norm))


@query("knn_mask", _sql("select event_id, j, count(*) as n from (select distinct event_id, i, j from (select event_id, i, j from k where n <= 5 union all select event_id, j, i from k where n <= 5)) group by event_id, j", BOTH + ", k as (select event_id, i, j, row_number() over (partition by event_id, j order by d2, i) n from q)"))
def knn_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.nearest(particles(spark, sf_dir), 5, clustered=True).groupBy("event_id", "j").agg(F.count(F.lit(1)).alias("n"))


@query("seed_order", _sql("select p.event_id, p.idx as i, row_number() over (partition by p.event_id order by coalesce(w, 0), p.idx) - 1 as place from p left join (select event_id, i, sum(sqrt(d2) * least(1 / pt_i, 1 / pt_j)) w from q group by event_id, i) s on p.event_id = s.event_id and p.idx = s.i", BOTH))
def seed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.seed_order(particles(spark, sf_dir)).select("event_id", "i", F.col("place").cast("long").alias("place"))


@query("stop_mean_distance", _sql(f"select event_id, {r('avg(sqrt(d2))', 'mean')}, avg(sqrt(d2)) < 2.5e0 as below from q group by event_id", PAIRS))
def stop_mean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.mean_distance(pairwise.with_distance2(pairwise.pairs(particles(spark, sf_dir))), 2.5).select("event_id", rounded("mean", "mean"), "below")


@query("stop_min_distance", _sql(f"select event_id, {r('sqrt(min(d2))', 'least')}, sqrt(min(d2)) < 0.1e0 as below from q group by event_id", PAIRS))
def stop_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.min_distance(pairwise.with_distance2(pairwise.pairs(particles(spark, sf_dir))), 0.1).select("event_id", rounded("least", "least"), "below")


def _first_sql(f: str, own: str) -> str:
    return _sql(f"select event_id, i, j, {r('d', 'dist2')} from (select *, row_number() over (partition by event_id order by i, j) n from (select *, min(d) over (partition by event_id) least from c) where d <= least * (1 + 1e-9)) where n = 1", PAIRS + f", c as (select event_id, i, j, d2 * {f} * {f} d from q union all select event_id, idx, idx, 0.8e0 * 0.8e0 * {own} * {own} from p)")


for _name, _form, _exponent, _f, _own in (("kt_first_pair", "genkt", 1, "least(pt_i, pt_j)", "pt"), ("ca_first_pair", None, 0, "1e0", "1e0"), ("antikt_first_pair", "genkt", -1, "least(1 / pt_i, 1 / pt_j)", "(1 / pt)")):
    query(_name, _first_sql(_f, _own))(lambda s, d, form=_form, e=_exponent: pairwise.first_choice(particles(s, d), 0.8, form, e).select("event_id", "i", "j", rounded("dist2", "dist2")))


# jets of given groups
MANUAL = """g as (select event_id, idx % 3 g, count(*) n, sum(energy) energy, sum(px) px, sum(py) py, sum(pz) pz from p group by all),
    l as (select event_id, max(idx) last from p group by event_id), t as (select *, sqrt(px * px + py * py) pt from g),
    j as (select t.*, last + row_number() over (partition by t.event_id order by g) as label, atan2(py, px) phi,
          case when pz = 0 then 0e0 else sign(pz) * 0.5 * ln((pt * pt + greatest(energy * energy - pz * pz - pt * pt, 0)) / ((energy - abs(pz)) * (energy - abs(pz)))) end rapidity from t join l on t.event_id = l.event_id)"""


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jets.create_jets(particles(spark, sf_dir).withColumn("jet_id", F.col("idx") % 3))


@query("manual_jets", _sql(f"select event_id, label, {r('pt', 'pt')}, {r('rapidity', 'rapidity')}, {r('phi', 'phi')}, {r('energy', 'energy')}, n::double as size from j", MANUAL))
def manual_jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jets.roots(manual(spark, sf_dir)).select("event_id", "label", *[rounded(c, c) for c in ("pt", "rapidity", "phi", "energy")], "size")


@query("manual_jets_split", _sql("select event_id, label as jet_id, n as n_leaves, n + 1 as n_nodes from j", MANUAL))
def manual_jets_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jets.jets(manual(spark, sf_dir)).select("event_id", "jet_id", "n_leaves", "n_nodes")


@query("manual_jets_leaves", _sql("select p.event_id, p.idx as label, j.label as parent from p join j on p.event_id = j.event_id and p.idx % 3 = j.g", MANUAL))
def manual_jets_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jets.leaves(manual(spark, sf_dir)).select("event_id", "label", "parent")


@query("jets_by_pt", _sql("select event_id, label as jet_id, row_number() over (partition by event_id order by pt desc, label) - 1 as place from j", MANUAL))
def jets_by_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jets.by_pt(jets.jets(manual(spark, sf_dir))).select("event_id", "jet_id", F.col("place").cast("long").alias("place"))


def _filter_sql(lead: float, other: float, tracks: int) -> str:
    return _sql(f"select event_id, label as jet_id, {r('pt', 'pt')}, n as n_leaves from (select *, max(pt) over (partition by event_id) m from j) where m > {lead} and pt > {other} and n >= {tracks}", MANUAL)


@query("filter_jets_default", _filter_sql(30, 30, 2))
def filter_jets_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jets.filter_jets(jets.jets(manual(spark, sf_dir))).select("event_id", "jet_id", rounded("pt", "pt"), "n_leaves")


@query("filter_jets_custom", _filter_sql(80, 80, 10))
def filter_jets_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jets.filter_jets(jets.jets(manual(spark, sf_dir)), 80, 10).select("event_id", "jet_id", rounded("pt", "pt"), "n_leaves")


# vectors
def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    two = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("a"), "label").join(two.select("vec_id", F.col("other").cast("array<double>").alias("b")), "vec_id")


_NEXT = "with e as (select a.vec_id, a.embedding::double[] a, b.embedding::double[] b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
_ANGLE = "acos(greatest(least(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 1e0), -1e0))"
for _name, _spark, _duck in (
    ("embed_sqeuclid", lambda: A.embedding_distance2(F.col("a"), F.col("b")), "list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"),
    ("embed_angular", lambda: A.embedding_angular2(F.col("a"), F.col("b")), f"{_ANGLE} * {_ANGLE}"),
    ("embed_root_angular", lambda: A.embedding_root_angular2(F.col("a"), F.col("b")), _ANGLE),
    ("embed_norm", lambda: A.total(A.embedding_norm(F.col("a"))), "list_sum(list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))))"),
):
    query(_name, f"{_NEXT} select vec_id, {r(_duck, 'value')} from e")(lambda s, d, f=_spark: _next(s, d).select("vec_id", rounded(f(), "value")))


@query("parity_embeddings", "with x as (select a.vec_id, unnest(range(0, len(a.embedding))) dim, unnest(a.embedding::double[]) a, unnest(b.embedding::double[]) b from embeddings a join embeddings b on a.vec_id = b.vec_id - 1) select dim::int as dim, case when sum(abs(a + b)) < sum(abs(a - b)) then -1 else 1 end as parity from x group by dim")
def parity_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return references.parity(e, e.withColumn("vec_id", F.col("vec_id") - 1))


@query("kmeans_assign_step", f"with c as (select label centre, embedding::double[] position from embeddings where vec_id in (select min(vec_id) from embeddings group by label)), d as (select e.vec_id, c.centre, sqrt(list_sum(list_transform(list_zip(e.embedding::double[], c.position), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) d from embeddings e, c) select vec_id, arg_min(centre, (d, centre)) as centre, {r('min(d)', 'distance')} from d group by vec_id")
def kmeans_assign_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label is its centre."""
    e = read(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    centres = e.groupBy(F.col("label").alias("centre")).agg(F.min_by("embedding", "vec_id").alias("position"))
    return references.kmeans_assign(e, centres).select("vec_id", "centre", rounded("distance", "distance"))


# integrity, matching, decay, pointers
#: Copies of the particles whose momenta are scaled: the last two move faster than light, the last one in some events only.
_COPIES = {"A": "pz", "B": "pz * 0.5", "C": "pz * 1.01", "D": "case when event_id % 7 = 0 then pz * 1.01 else pz end"}
_BAD = "bool_or(energy * energy - px * px - py * py - ({z}) * ({z}) < -0.0001)"


@query("tachyon_check", _sql(" union all ".join(f"select '{k}' as prefix, {_BAD.format(z=z)} as bad from p" for k, z in _COPIES.items())))
def tachyon_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_particles(spark, sf_dir)
    copies = raw.select(*[F.expr(z if c == "Pz" else c.lower()).alias(f"{k}_{c}") for k, z in _COPIES.items() for c in ("Energy", "Px", "Py", "Pz")])
    bad = integrity.tachyons(copies)
    return spark.createDataFrame([(k, k in bad) for k in _COPIES], "prefix string, bad boolean")


@query("even_length_check", """select name, n from (select 'order_date' as name, count(distinct o_custkey) n from orders union all select 'order_total', count(distinct o_custkey) from orders where o_totalprice > 0
    union all select 'customer_name', count(*) from customer union all select 'part_size', count(distinct c_custkey) from customer where c_acctbal > 0) where n < (select count(*) from customer)""")
def even_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that have fewer events than the longest."""
    orders = read(spark, sf_dir, "orders").withColumn("event_id", F.col("o_custkey"))
    customers = read(spark, sf_dir, "customer").withColumn("event_id", F.col("c_custkey"))
    found = integrity.uneven({"order_date": orders, "order_total": orders.where("o_totalprice > 0"), "customer_name": customers, "part_size": customers.where("c_acctbal > 0")})
    return spark.createDataFrame(list(found.items()), "name string, n long")


def _match_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and four fifths of them with other balances and ids; keys and nations are shared by several."""
    c = read(spark, sf_dir, "customer")
    left = c.select(F.col("c_custkey").alias("event_id"), F.floor(F.col("c_custkey") / 7).alias("Event_n"), (F.col("c_nationkey") % 2).alias("nation"), F.col("c_acctbal").alias("balance"))
    return left, left.where("event_id % 5 != 0").withColumn("balance", F.col("balance") + F.col("event_id") % 11 * 301.0).withColumn("event_id", -F.col("event_id"))


_MATCH = """l as (select c_custkey id, floor(c_custkey / 7)::bigint k, c_nationkey % 2 n, c_acctbal b from customer),
    m as (select x.k, x.id as left_id, -y.id as right_id, abs(x.b - (y.b + y.id % 11 * 301e0)) gap from l x join l y on x.k = y.k and x.n = y.n and y.id % 5 <> 0)"""


@query("event_match_candidates", f"with {_MATCH} select k as Event_n, left_id, right_id, {r('gap', 'gap')} from m")
def event_match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(*_match_tables(spark, sf_dir)).select("Event_n", "left_id", "right_id", rounded("gap", "gap"))


@query("event_match", f"""with recursive {_MATCH},
    g as (select distinct k, []::bigint[] ls, []::bigint[] rs from m union all
        select g.k, list_append(any_value(ls), arg_min(left_id, {{'g': gap, 'l': left_id, 'r': right_id}})), list_append(any_value(rs), arg_min(right_id, {{'g': gap, 'l': left_id, 'r': right_id}}))
        from g join m on g.k = m.k where not list_contains(ls, left_id) and not list_contains(rs, right_id) group by g.k),
    h as (select unnest(ls) left_id, unnest(rs) right_id from (select arg_max(ls, len(ls)) ls, arg_max(rs, len(rs)) rs from g group by k))
    select id as left_id, coalesce(right_id, -1) as right_id from l left join h on id = left_id""")
def event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_events(*_match_tables(spark, sf_dir))


def _decay(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    p = particles(spark, sf_dir).select("event_id", "idx", F.floor(F.log2(F.col("idx") + 1) / 2).cast("long").alias("pid"), F.floor((F.col("idx") - 1) / 2).alias("parent"))
    # a row has its particle, its start and the edge from its parent, so that the three tables are read and dealt by event once
    own, edge = [decay.walk_row(decay.PARTICLE, "idx", pid="pid"), decay.walk_row(decay.START, "idx", pid="none")], decay.walk_row(decay.EDGE, *(("idx", "parent") if first else ("parent", "idx")), pid="none")
    rows = p.withColumn("none", F.lit(None).cast("long")).select("event_id", F.explode(F.when(F.col("idx") >= 1, F.array(*own, edge)).otherwise(F.array(*own))).alias("r"))
    return decay.ends(rows.select("event_id", "r.*"), clustered=True)


def _decay_sql(src: str, dst: str) -> str:
    more = f"""n as (select event_id, idx, floor(log2(idx + 1) / 2)::bigint pid from p), e as (select c.event_id, u.idx parent, c.idx child from n c join n u on c.event_id = u.event_id and u.idx = (c.idx - 1) // 2 and c.pid = u.pid where c.idx >= 1),
        w as (select event_id, idx start, idx place from n union all select w.event_id, w.start, e.{dst} from w join e on w.event_id = e.event_id and w.place = e.{src})"""
    return _sql("select distinct event_id, start, place as idx from w where not exists (select 1 from e where e.event_id = w.event_id and e." + src + " = w.place)", more).replace("with p as", "with recursive p as", 1)


query("decay_edge_first", _decay_sql("child", "parent"))(lambda s, d: _decay(s, d, True))
query("decay_edge_last", _decay_sql("parent", "child"))(lambda s, d: _decay(s, d, False))


@query("reflect_references", "select p_partkey as idx, coalesce(max(l_orderkey), -1) as ref from part left join lineitem on p_partkey = l_partkey group by p_partkey")
def reflect_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = read(spark, sf_dir, "lineitem").select(F.lit(0).alias("event_id"), F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("ref"))
    target = read(spark, sf_dir, "part").select(F.lit(0).alias("event_id"), F.col("p_partkey").alias("idx"))
    return references.reflect_references(source, target).select("idx", "ref")


#: Pointers of orders into parts and suppliers: a key's event is its remainder, its index the quotient; ids of parts are even, of suppliers odd.
#: Parts of some sizes don't exist, so references to them lead nowhere. An order's references are lists by return flag.
_WAYS = 40
_POINTERS = f"""p as (select p_partkey % {_WAYS} event_id, p_partkey // {_WAYS} idx from part where p_size % 10 <> 0), s as (select s_suppkey % {_WAYS} event_id, s_suppkey // {_WAYS} idx from supplier),
    g as (select l_orderkey % {_WAYS} event_id, l_orderkey // {_WAYS} idx, case when l_linenumber % 2 = 1 then 2 * (l_partkey // {_WAYS}) else 2 * (l_suppkey // {_WAYS}) + 1 end uid, l_returnflag f, l_linenumber n from lineitem),
    e as (select *, row_number() over (partition by event_id, idx order by f, n, uid) - 1 place from g),
    o as (select event_id, idx * 2 uid, 'part' kind, idx target from p union all select event_id, idx * 2 + 1, 'supplier', idx from s),
    x as (select e.event_id, e.idx, e.place, e.uid, o.kind, coalesce(o.target, -1) target from e left join o on e.event_id = o.event_id and e.uid = o.uid)"""


def _pointers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources with ragged references, the typed pointer table)."""
    split = lambda c: [F.pmod(F.col(c), F.lit(_WAYS)).alias("event_id"), F.floor(F.col(c) / _WAYS).alias("idx")]
    parts = read(spark, sf_dir, "part").where("p_size % 10 != 0").select(*split("p_partkey")).withColumn("uid", F.col("idx") * 2)
    suppliers = read(spark, sf_dir, "supplier").select(*split("s_suppkey")).withColumn("uid", F.col("idx") * 2 + 1)
    uid = F.when(F.col("l_linenumber") % 2 == 1, 2 * F.floor(F.col("l_partkey") / _WAYS)).otherwise(2 * F.floor(F.col("l_suppkey") / _WAYS) + 1)
    lines = read(spark, sf_dir, "lineitem").select(*split("l_orderkey"), F.struct("l_linenumber", uid.alias("uid")).alias("x"), "l_returnflag")
    inner = lines.groupBy("event_id", "idx", "l_returnflag").agg(F.sort_array(F.collect_list("x")).alias("l"))
    ragged = inner.groupBy("event_id", "idx").agg(F.sort_array(F.collect_list(F.struct("l_returnflag", "l"))).alias("all"))
    sources = ragged.select("event_id", "idx", F.transform("all", lambda f: F.transform(f["l"], lambda y: y["uid"])).alias("refs"))
    return sources, references.objects({"part": parts, "supplier": suppliers})


@query("typed_pointers", f"with {_POINTERS} select event_id, idx, place, uid, kind, target from x")
def typed_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of ragged lists into two tables, resolved by one join."""
    return references.resolve(*_pointers(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query("pointers_by_kind", f"""with {_POINTERS} select event_id, idx, string_agg(case when kind = 'part' then target else -1 end, ',' order by place) part, string_agg(case when kind = 'supplier' then target else -1 end, ',' order by place) supplier from x group by event_id, idx""")
def pointers_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each kind of target, put together again by place."""
    sources, objects = _pointers(spark, sf_dir)
    listed = references.by_kind(sources, references.resolve(sources, objects), ["part", "supplier"])
    return listed.select("event_id", "idx", *[F.array_join(k, ",").alias(k) for k in ("part", "supplier")])


@query("back_pointers", f"with {_POINTERS} select o.event_id, o.kind, o.target as idx, coalesce(max(x.idx), -1) as ref from o left join x on o.event_id = x.event_id and o.kind = x.kind and o.target = x.target group by all")
def back_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order that points to each part and supplier."""
    sources, objects = _pointers(spark, sf_dir)
    return references.back_pointers(references.resolve(sources, objects), objects)


@query("wide_back_pointers", f"""with {_POINTERS}, n as (select event_id, max(idx) + 1 as n from p group by event_id), i as (select event_id, unnest(range(n)) idx from n)
    select i.event_id, string_agg(coalesce(r, -1), ',' order by i.idx) refs from i left join (select event_id, uid // 2 idx, max(idx) r from e where uid % 2 = 0 group by all) b on i.event_id = b.event_id and i.idx = b.idx group by i.event_id""")
def wide_back_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where an event is one row: lists of lists of references, and a list as long as the particles."""
    sources, objects = _pointers(spark, sf_dir)
    own = F.transform(F.filter(F.flatten("refs"), lambda x: x % 2 == 0), lambda x: F.floor(x / 2))
    # a list's place is the order's index, so orders that aren't there have empty lists
    none = F.array().cast("array<array<bigint>>")
    lists = sources.select("event_id", F.struct("idx", own.alias("own")).alias("x")).groupBy("event_id").agg(F.sort_array(F.collect_list("x")).alias("all"))
    before = lambda a, i: F.coalesce(F.get(a, i - 1)["idx"], F.lit(-1).cast("long"))
    filled = F.transform(F.array("all"), lambda a: F.flatten(F.transform(a, lambda x, i: F.concat(F.array_repeat(F.array().cast("array<bigint>"), (x["idx"] - before(a, i) - 1).cast("int")), F.array(x["own"])))))[0]
    wide = lists.select("event_id", F.coalesce(filled, none).alias("refs"))
    sizes = objects.where("kind = 'part'").groupBy("event_id").agg((F.max("target") + 1).cast("int").alias("n"))
    return wide.join(sizes, "event_id").select("event_id", F.array_join(references.reflected(F.col("refs"), F.col("n"), deep=True), ",").alias("refs"))


# event sets
def _customers(spark: SparkSession, sf_dir: str) -> EventSet:
    return EventSet(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_acctbal").alias("balance")), {"weight": 1.0})


_SET = "with s as (select c_custkey event_id, c_acctbal balance from customer)"


@query("fragment_assign", f"{_SET} select least(place // ((select count(*) from s) // 7), 6)::int as part, count(*) as n, min(event_id) as first, {r('sum(balance)', 'balance', 2)} from (select *, row_number() over (order by event_id) - 1 place from (select event_id * 3 + 1000000 as event_id, balance from s)) group by 1")
def fragment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the number of events, whatever their ids."""
    s = _customers(spark, sf_dir)
    far = EventSet(s.df.withColumn("event_id", F.col("event_id") * 3 + 1_000_000), s.hyper)
    return far.parts(n_fragments=7).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), rounded(F.sum("balance"), "balance", 2))


@query("event_set_resave", f"{_SET} select event_id, {r('balance', 'balance', 2)}, {r('balance * 2 + 1', 'twice', 2)} from s")
def event_set_resave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set that is read, appended to and saved over itself, twice."""
    path = new_folder(spark)
    _customers(spark, sf_dir).save(path)
    EventSet.load(spark, path).append(twice=F.col("balance") * 2).save()
    found = EventSet.load(spark, path).append(twice=F.col("twice") + 1).save()
    return found.df.select("event_id", rounded("balance", "balance", 2), rounded("twice", "twice", 2))


@query("split_ranges", f"{_SET} select case when event_id < 50 then 0 else 1 end as part, count(*) as n from s where event_id < 120 group by 1")
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, none, two = _customers(spark, sf_dir).split([0, 50, 50], [50, 50, 120])
    assert none is None
    return one.df.withColumn("part", F.lit(0)).union(two.df.withColumn("part", F.lit(1))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("split_unfinished", "select c_custkey in (select o_custkey from orders) as finished, count(*) as n from customer group by 1")
def split_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"))
    sides = _customers(spark, sf_dir).split_unfinished(done)
    out = [s.df.agg(F.lit(k).alias("finished"), F.count(F.lit(1)).alias("n")) for s, k in zip(sides, (True, False), strict=True) if s is not None]
    return out[0].union(out[1]) if len(out) > 1 else out[0]


@query("combine_fragments", f"{_SET} select count(*) as n, {r('sum(balance)', 'balance', 2)}, count(*) filter (event_id < 50) as extra from s")
def combine_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    one, two = s.split([0, 50], [50, 1 << 40])
    joined = EventSet.combine([one.append(extra=F.lit(1)), two])
    return joined.df.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("balance"), "balance", 2), F.count("extra").alias("extra"))


@query("hyper_weighted_mean", f"{_SET} select {r('(50 * 1e0 + (count(*) - 50) * 3e0) / count(*)', 'weight')} from s")
def hyper_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _customers(spark, sf_dir).split([0, 50], [50, 1 << 40])
    joined = EventSet.combine([one, two.append_hyperparameters(weight=3.0)], averaged=lambda n: n == "weight")
    return spark.range(1).select(rounded(F.lit(joined.hyper["weight"]), "weight"))


# particle ids: an own small table
IDENTITIES = [
    '<particle id="1" name="d" antiName="dbar" spinType="2" chargeType="-1" colType="1" m0="0.33"/>',
    '<particle id="4" name="c" antiName="cbar" spinType="2" chargeType="2" colType="1" m0="1.50"/>',
    '<particle id="5" name="b" antiName="bbar" spinType="2" chargeType="-1" colType="1" m0="4.80"/>',
    '<particle id="11" name="e-" antiName="e+" spinType="2" chargeType="-3" colType="0" m0="0.00051"/>',
    '<particle id="22" name="gamma" spinType="3" chargeType="0" colType="0" m0="0.0"/>',
    '<particle id="25" name="h0" spinType="1" chargeType="0" colType="0" m0="125.0"/>',
]
_IDS = "(values (1, 'd', -1, 2), (4, 'c', 2, 2), (5, 'b', -1, 2), (11, 'e-', -3, 2), (22, 'gamma', 0, 3), (25, 'h0', 0, 1), (-1, 'dbar', 1, 2), (-4, 'cbar', -2, 2), (-5, 'bbar', 1, 2), (-11, 'e+', 3, 2)) t(pid, name, thirds, spin)"


def _identities(spark: SparkSession) -> DataFrame:
    lines = spark.createDataFrame([(x,) for x in IDENTITIES], "value string")
    return particle_data.with_antiparticles(particle_data.parse_identities(lines))


@query("pid_charges", f"select pid::bigint as pid, name, {r('thirds / 3e0', 'charge')}, {r('(spin - 1) / 2e0', 'spin')} from {_IDS}")
def pid_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identities(spark).select("pid", "name", rounded("charge", "charge"), rounded("spin", "spin"))


@query("pid_match", f"select x.pid, coalesce(name, x.pid::varchar) as name, contains(coalesce(name, x.pid::varchar), 'b') as found, count(*) as n from (select (l_partkey % 27) - 13 pid from lineitem) x left join {_IDS} on x.pid = t.pid group by all")
def pid_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pids = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 27 - 13).alias("pid"))
    named = particle_data.names(pids, _identities(spark))
    return named.withColumn("found", particle_data.match(F.col("name"), "b")).groupBy("pid", "name", "found").agg(F.count(F.lit(1)).alias("n"))


# clustering: the jet of every particle, named by its least index, and the jet's momentum
def _partition(found: DataFrame) -> DataFrame:
    jet = Window.partitionBy("event_id", "jet_id")
    leaf, root = F.col("child1") == -1, F.col("parent") == -1
    each = found.select(
        "event_id", F.col("label").alias("idx"), leaf.alias("leaf"), F.min(F.when(leaf, F.col("label"))).over(jet).alias("jet"), F.count_if(leaf).over(jet).alias("n"),
        *[rounded(F.max(F.when(root, F.col(c))).over(jet), c) for c in ("pt", "energy")],
    )
    return each.where("leaf").drop("leaf")


def _jets_sql(ctes: str, select: str = oracles.PARTITION, event: str = "o_custkey") -> str:
    return _sql(select, ctes, event).replace("with p as", "with recursive p as", 1)


ANTIKT = {"DeltaR": 0.4, "ExpofPTFormatInput": "genkt", "ExpofPTInput": -1.0}
_INVERSE = ("least(1 / a.pt, 1 / b.pt)", "(1 / pt)")
_ANTIKT_SQL = _jets_sql(oracles.recombination(0.4, *_INVERSE))
_SMALL = "l_orderkey"
for _name, _algorithm, _params, _duck, _event in (
    ("antikt_jets", "GeneralisedKT", ANTIKT, oracles.recombination(0.4, *_INVERSE), "o_custkey"),
    ("kt_jets", "GeneralisedKT", ANTIKT | {"ExpofPTInput": 1.0}, oracles.recombination(0.4, "least(a.pt, b.pt)", "pt"), "o_custkey"),
    ("ca_jets", "GeneralisedKT", {"DeltaR": 0.4}, oracles.recombination(0.4), "o_custkey"),
    ("ratiokt_jets", "GeneralisedKT", {"DeltaR": 0.4, "ExpofPTFormatInput": "ratiokt", "ExpofPTInput": 1.0}, oracles.recombination(0.4, "(least(a.pt, b.pt) / greatest(a.pt, b.pt))"), "o_custkey"),
    ("cone_jets", "IterativeCone", {"DeltaR": 0.6}, oracles.cone(0.6), "o_custkey"),
    ("wavelet_jets", "CALE", {}, oracles.wavelets(), _SMALL),
):
    query(_name, _jets_sql(_duck, event=_event))(lambda s, d, a=_algorithm, p=_params, e=_event: _partition(nodes(cluster(particles(s, d, e), a, p, clustered=True))))
#: SQL has no eigenvectors: these two have no oracle here; golden_jets and the tests hold their kernel against literal jets and brute force.
for _name, _algorithm in (("spectral_jets", "Spectral"), ("spectral_mean_jets", "SpectralMean")):
    query(_name)(lambda s, d, a=_algorithm: _partition(nodes(cluster(particles(s, d, partitions=_even(s)), a, {}, clustered=True))))

#: Particles (px, py, pz, energy) of three literal events, and the jets that the algorithms make of them, as lists of indices.
GOLDEN = [
    [(5.0, 0.2, 1.0, 6.0), (4.0, 0.4, 1.1, 5.0), (-3.0, 2.0, -1.0, 4.5), (-2.5, 2.2, -0.8, 4.0), (0.3, -4.0, 0.2, 4.6), (0.1, -3.5, 0.4, 4.2), (2.0, 0.1, 0.5, 2.5)],
    [(1.0, 0.0, 0.0, 1.0), (0.995, 0.0998, 0.0, 1.0)],
    [(1.0, 0.0, 0.0, 1.0), (-1.0, 0.0, 0.0, 1.0), (0.0, 3.0, 4.0, 6.0)],
]


def golden(spark: SparkSession) -> DataFrame:
    rows = [(e, i, *x) for e, event in enumerate(GOLDEN) for i, x in enumerate(event)]
    return spark.createDataFrame(rows, "event_id long, idx long, px double, py double, pz double, energy double")


GOLDEN_JETS = {name: [[[0, 1, 6], [2, 3], [4, 5]], [[0], [1]], [[0], [1], [2]]] for name in ("Spectral", "SpectralMean")}
_GOLDEN_VALUES = ", ".join(f"('{a}', {e}, {i}, {min(jet)}, {len(jet)}, {round(sum(GOLDEN[e][k][3] for k in jet), 4)}e0)" for a, events in GOLDEN_JETS.items() for e, found in enumerate(events) for jet in found for i in jet)


@query("golden_jets", f"select algorithm, event_id::bigint as event_id, idx::bigint as idx, jet::bigint as jet, n::bigint as n, energy from (values {_GOLDEN_VALUES}) v(algorithm, event_id, idx, jet, n, energy)")
def golden_jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal events clustered by algorithms that SQL can't express, against literal jets."""
    out = None
    for name in GOLDEN_JETS:
        found = _partition(nodes(cluster(golden(spark), name))).select(F.lit(name).alias("algorithm"), "event_id", "idx", "jet", "n", "energy")
        out = found if out is None else out.unionByName(found)
    return out


@query("antikt_two_particle_events", _sql("""select event_id, case when d12 < b1 and d12 <= b2 then 1::bigint else 2 end as n_jets from
    (select q.event_id, d2 * least(1 / pt_i, 1 / pt_j) * least(1 / pt_i, 1 / pt_j) d12, 0.8e0 * 0.8e0 / (pt_i * pt_i) b1, 0.8e0 * 0.8e0 / (pt_j * pt_j) b2 from q join (select event_id from p group by event_id having count(*) = 2) x on q.event_id = x.event_id)""", PAIRS, "l_orderkey"))  # fmt: skip
def antikt_two_particle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = particles(spark, sf_dir, "l_orderkey")
    pair = p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("event_id"))).where("n = 2").drop("n")
    found = nodes(cluster(pair, "GeneralisedKT", ANTIKT | {"DeltaR": 0.8}, clustered=True))
    return found.groupBy("event_id").agg(F.count_if(F.col("parent") == -1).alias("n_jets"))


@query("merge_sequence", _jets_sql(oracles.recombination(100.0, *_INVERSE), "select event_id, row_number() over (partition by event_id order by label) - 1 as step, child1, child2, label from n where child1 >= 0"))
def merge_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merge of events that end as one jet."""
    steps = jets.merge_sequence(nodes(cluster(particles(spark, sf_dir), "GeneralisedKT", ANTIKT | {"DeltaR": 100.0}, clustered=True)))
    return steps.withColumn("step", F.col("step").cast("long"))


# states of a clustering: the recursive SQL has the live nodes of every step
_STATES = {"antikt": (ANTIKT, _INVERSE), "kt": (ANTIKT | {"ExpofPTInput": 1.0}, ("least(a.pt, b.pt)", "pt"))}
_STEPS = (0, 1, 5, 20)


def _history(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return history.history(particles(spark, sf_dir), "GeneralisedKT", _STATES[name][0], clustered=True)


for _name in _STATES:
    _duck = oracles.recombination(0.4, *_STATES[_name][1])
    query(f"{_name}_live_nodes", _jets_sql(_duck, f"select event_id, step, label, {r('pt', 'pt')} from n where not jet and step in {_STEPS}"))(
        lambda s, d, k=_name: history.at_steps(_history(s, d, k), particles(s, d).select("event_id").distinct().withColumn("step", F.explode(F.array(*map(F.lit, _STEPS))))).select("event_id", "step", "label", rounded("pt", "pt")))
    query(f"{_name}_live_trace", _jets_sql(_duck, "select event_id, step::bigint as step, count(*) as n_live, sum(label)::bigint as labels, sum(len(members))::bigint as leaves from n where not jet group by event_id, step"))(
        lambda s, d, k=_name: history.running(_history(s, d, k), {"n_live": F.lit(1), "labels": F.col("label"), "leaves": F.col("size")}))


@query("antikt_live_minor", _jets_sql(oracles.recombination(0.4, *_INVERSE), f"""select a.event_id, a.step::bigint as step, count(*) as n, {r('sum(sqrt(' + oracles.DISTANCE2 + '))', 'total')}, {r('min(' + oracles.DISTANCE2 + ')', 'least')}
    from n a join n b on a.event_id = b.event_id and a.step = b.step and a.label < b.label and not a.jet and not b.jet where a.step in {_STEPS} group by all"""))
def antikt_live_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances between the live nodes of some states, from the pairs that are ever live at once."""
    nodes = history.ever(_history(spark, sf_dir, "antikt"), _STEPS)
    pairs = history.live_pairs(nodes, ["rapidity", "phi"]).withColumn("d2", _dist2())
    found = history.by_step(pairs, _STEPS, {"total": (F.sum, F.sqrt("d2")), "least": (F.min, F.col("d2"))})
    return found.select("event_id", "step", "n", rounded("total", "total"), rounded("least", "least"))


@query("resume_batches", _ANTIKT_SQL)
def resume_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls, the second of which does what the first has left; every event is clustered once."""
    path = new_folder(spark)
    p = particles(spark, sf_dir)
    cluster_batch(p, path, "GeneralisedKT", ANTIKT, "Anti", batch_events=100)
    assert cluster_batch(p, path, "GeneralisedKT", ANTIKT, "Anti")
    return _partition(nodes(spark.read.parquet(path)))


@query("stream_available_now", _ANTIKT_SQL)
def stream_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as files and clustered by a stream until it has caught up."""
    path = new_folder(spark)
    p = particles(spark, sf_dir)
    p.repartition("event_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{path}/in")
    cluster_stream(stream, f"{path}/out", f"{path}/checkpoint", "GeneralisedKT", ANTIKT).awaitTermination()
    return _partition(nodes(spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/out")))


@query("cluster_udtf", _jets_sql(oracles.recombination(0.4)))
def cluster_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cambridge/Aachen called from SQL."""
    udtf.register(spark)
    raw_particles(spark, sf_dir).createOrReplaceTempView("udtf_particles")
    together = "table(select * from udtf_particles distribute by event_id sort by event_id, idx)"
    return _partition(nodes(spark.sql(f"select * from cluster_events_together({together}, 'GeneralisedKT', '{{\"DeltaR\": 0.4}}')")))


@query("tree_descendants", _sql("select distinct event_id, start, idx as label from w where start <> idx", "w as (select event_id, idx as start, idx from p where idx in (1, 2) union all select w.event_id, start, p.idx from w join p on p.event_id = w.event_id and p.idx > 0 and (p.idx - 1) // 2 = w.idx)").replace("with p as", "with recursive p as", 1))
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes below the second and third of a binary heap of each event's particles."""
    p = particles(spark, sf_dir).withColumn("last", F.max("idx").over(Window.partitionBy("event_id")))
    child = lambda k: F.when(2 * F.col("idx") + k <= F.col("last"), 2 * F.col("idx") + k).otherwise(-1)
    heap = p.select("event_id", F.col("idx").alias("label"), F.when(F.col("idx") > 0, F.floor((F.col("idx") - 1) / 2)).otherwise(-1).alias("parent"), child(1).alias("child1"), child(2).alias("child2"))
    return jets.descendants(heap, heap.where("label in (1, 2)").select("event_id", "label"), last_only=False)


@query("tree_leaf_counts", _jets_sql(oracles.recombination(100.0, *_INVERSE), "select distinct event_id, label, len(members)::bigint as n_leaves from n"))
def tree_leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves below every node of trees that are as deep as their event has particles."""
    return jets.leaf_counts(nodes(cluster(particles(spark, sf_dir), "GeneralisedKT", ANTIKT | {"DeltaR": 100.0}, clustered=True)), clustered=True)


@query("nested_jets", _sql(f"""select p.event_id, j.label as jet_id, p.idx as label, j.label as parent, {r('p.pt', 'pt')} from p join j on p.event_id = j.event_id and p.idx % 3 = j.g
    union all select event_id, label, label, -1, {r('pt', 'pt')} from j""", MANUAL))
def nested_jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node after a way through nested lists and back."""
    back = jets.from_nested(jets.nested(manual(spark, sf_dir)))
    return back.select("event_id", "jet_id", "label", "parent", rounded("pt", "pt"))


@query("long_to_wide", _sql(f"select event_id, count(*) as n, {r('sum(pt * (idx + 1))', 'weighted')} from p group by event_id"))
def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = to_wide(particles(spark, sf_dir), ["pt"])
    weighted = F.aggregate(F.transform("pt", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return wide.select("event_id", F.size("pt").cast("long").alias("n"), rounded(weighted, "weighted"))


@query("matrix_dot_vector", _sql(f"select event_id, i, {r(f'sum(exp(-d2 / {SIGMA}e0) * pt_j)', 'value')} from q group by event_id, i", BOTH))
def matrix_dot_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affinity matrix times the vector of transverse momenta."""
    _, pairs = _affine(spark, sf_dir)
    return pairs.groupBy("event_id", "i").agg(rounded(F.sum(F.col("affinity") * F.col("pt_j")), "value"))


@query("wavelet_scaled", _jets_sql(oracles.wavelets(), f"select w.event_id, w.idx, {r('w.v', 'value')} from w join o on w.event_id = o.event_id and w.seed = o.seeds[1]", _SMALL))
def wavelet_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaled heat wavelet at each event's first seed."""
    return wavelet_values(particles(spark, sf_dir, _SMALL), 0.1, clustered=True).select("event_id", "idx", rounded("value", "value"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) + 0e0 as total from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows; the same code runs on a stream."""
    return windowed(read(spark, sf_dir, "events"), "1 hour").select("start", "event_type", "n", rounded("total", "total", 2))


@query("event_sessions", """with e as (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval '30 minutes', true) as fresh from events),
    s as (select *, sum(fresh::int) over (partition by user_id order by ts rows unbounded preceding) k from e)
    select min(ts) as start, max(ts) + interval '30 minutes' as end, user_id, count(*) as n, round(sum(value), 2) + 0e0 as total from s group by user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows; the same code runs on a stream."""
    return sessions(read(spark, sf_dir, "events"), "30 minutes").select("start", "end", "user_id", "n", rounded("total", "total", 2))


@query("external_answers", _ANTIKT_SQL)
def external_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jets written as an external clusterer's answers and read again."""
    found = nodes(cluster(particles(spark, sf_dir), "GeneralisedKT", ANTIKT, clustered=True))
    return _partition(external.read_answers(external.answer_lines(found, 0.4, "antikt"), clustered=True))


@query("summary_lines", _sql(f"select event_id, idx, {', '.join(r(c, c) for c in ('px', 'py', 'pz', 'energy'))} from p"))
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles written as an external clusterer's input lines and read again."""
    path = new_folder(spark)
    external.write_summary(raw_particles(spark, sf_dir), path)
    return external.read_summary(spark, path).select("event_id", "idx", *[rounded(c, c) for c in ("px", "py", "pz", "energy")])


_MASKED = f"""a2 as (select a.event_id, a.idx i, b.idx j, case when a.idx = b.idx then 0e0 else exp(-{oracles.DISTANCE2} / {SIGMA}e0) * (1 - 1e-4 / (1e-4 + least(a.pt, b.pt) * sqrt({oracles.DISTANCE2}))) end v from p a join p b on a.event_id = b.event_id),
    near as (select *, row_number() over (partition by event_id, j order by -v, i) <= 5 as close from a2),
    m as (select x.event_id, x.i, x.j, case when x.close or y.close then x.v else 0e0 end v from near x join near y on x.event_id = y.event_id and x.i = y.j and x.j = y.i),
    d as (select event_id, i, sum(v) d from m group by all)"""


@query("spectral_trace", _sql(f"select m.event_id, count(distinct m.i) as n_live, {r('sum(case when m.i = m.j then (x.d - v) / x.d else 0 end)', 'total')}, {r('sum(case when m.i = m.j then ((x.d - v) / x.d) * ((x.d - v) / x.d) else v * v / (x.d * y.d) end)', 'squares')} from m join d x on m.event_id = x.event_id and m.i = x.i join d y on m.event_id = y.event_id and m.j = y.i group by m.event_id having count(*) > 1", _MASKED))
def spectral_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the first step's eigenvalues and of their squares, which are those of the Laplacian's entries."""
    first = spectral_trace(particles(spark, sf_dir), steps=1, clustered=True)
    total = lambda f: F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + f(x))
    return first.select("event_id", "n_live", rounded(total(lambda x: x), "total"), rounded(total(lambda x: x * x), "squares"))


@query("kmeans_fit", "select count(*) as n, count(distinct label) as k, 0::bigint as misplaced from embeddings")
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many clusters as labels, every vector in the one whose mean is nearest."""
    e = read(spark, sf_dir, "embeddings")
    k = e.select("label").distinct().count()
    found = kmeans.kmeans(e, k, max_iter=300, tolerance=0.0, settle=True).withColumn("embedding", F.col("embedding").cast("array<double>"))
    axes = found.select("cluster", F.posexplode("embedding").alias("axis", "x")).groupBy("cluster", "axis").agg(F.avg("x").alias("m"))
    means = axes.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "m"))), lambda x: x["m"]).alias("position"))
    # k rows, as in a k-means step
    near = references.kmeans_assign(found, means.withColumnRenamed("cluster", "centre")).join(F.broadcast(means), "cluster")
    away = A.embedding_distance2(F.col("embedding"), F.col("position")) > F.col("distance") ** 2 + 1e-6
    return near.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("k"), F.count_if(away).alias("misplaced"))


@query("kmeans_by_event", _sql("select event_id, count(*) as n, least(count(*), 3) as k, 0::bigint as misplaced from p group by event_id"))
def kmeans_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = particles(spark, sf_dir)
    found = kmeans.kmeans_by_event(p, 3, ["rapidity", "phi"], patience=2, clustered=True)
    event = Window.partitionBy("event_id")
    means = F.array(*[F.struct(*[F.avg(F.when(F.col("cluster") == c, F.col(x))).over(event).alias(x) for x in ("rapidity", "phi")]) for c in range(3)])
    gap = lambda m: (F.col("rapidity") - m["rapidity"]) ** 2 + (F.col("phi") - m["phi"]) ** 2
    gaps = found.withColumn("_gaps", F.transform(means, gap))
    # a cluster that an event doesn't have has null means
    away = F.col("_gaps")[F.col("cluster").cast("int")] > F.array_min("_gaps") + 1e-6
    return gaps.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("k"), F.count_if(away).alias("misplaced"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-kt jets of good events: scan, join, window, kinematics, clustering, aggregate, selection."""
    found = nodes(cluster(particles(spark, sf_dir), "GeneralisedKT", ANTIKT, clustered=True))
    return jets.filter_jets(jets.jets(found)).select("event_id", "jet_id", "pt", "rapidity", "phi", "energy", "n_leaves")
