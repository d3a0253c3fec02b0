"""Queries: successive sampling and the coreset, whole and step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coreset, edge_sort, ranking, successive
from .fixtures import K, SEED, VIEW, V, dist, query, sample_sql

# --- Successive sampling ---------------------------------------------------------------------------------


def _round_sql(i: int, source: str) -> str:
    """One round over `source`, which does nothing once no more than K rows remain."""
    return f"""{sample_sql(f'c{i}', source, str(K), SEED + i)},
n{i} AS (SELECT r.id, c.id AS center_id, {dist('r.e', 'c.e')} AS d, r.id = c.id AS is_self, row_number() OVER (PARTITION BY r.id ORDER BY (r.id <> c.id), {dist('r.e', 'c.e')}, c.p) AS w FROM {source} r, c{i} c),
o{i} AS (SELECT id, center_id, d, is_self, row_number() OVER (ORDER BY is_self DESC, d, id) AS rank, count(*) OVER () AS m FROM n{i} WHERE w = 1),
p{i} AS (SELECT id, center_id FROM o{i} WHERE m > {K} AND rank <= greatest(1, ceil(0.5 * m))),
r{i} AS (SELECT * FROM {source} WHERE id NOT IN (SELECT id FROM p{i}))"""


_ONE = f"{VIEW}, {_round_sql(0, 'v')}"
#: Rounds in SQL: each at least halves the rows, so 40 are enough for K * 2 ** 40 of them; rounds over K rows or fewer do nothing.
_ROUNDS = 40
_MANY = ", ".join([VIEW, *[_round_sql(i, f"r{i - 1}" if i else "v") for i in range(_ROUNDS)]])
_FINAL = " UNION ALL ".join([*[f"SELECT id, center_id FROM p{i}" for i in range(_ROUNDS)], f"SELECT id, id AS center_id FROM r{_ROUNDS - 1}"])


@query(f"{VIEW}, {sample_sql('s', 'v', str(K), SEED)} SELECT id, p::INTEGER AS p FROM s")
def ss_sample(spark: SparkSession, d: str) -> DataFrame:
    return ranking.sample(V(spark, d), K, SEED).select("id", "p")


@query(f"{_ONE} SELECT id, center_id, d, is_self, rank FROM o0")
def ss_sorted_round(spark: SparkSession, d: str) -> DataFrame:
    rows = V(spark, d)
    return successive.sorted_round(rows, ranking.sample(rows, K, SEED)).select("id", "center_id", "d", "is_self", "rank")


@query(f"{_ONE} SELECT id, center_id FROM p0")
def ss_round1(spark: SparkSession, d: str) -> DataFrame:
    rows = V(spark, d)
    ordered = successive.sorted_round(rows, ranking.sample(rows, K, SEED))
    n = rows.count()
    return ordered.where(F.col("rank") <= max(1, -(-n // 2))).select("id", "center_id")


@query(f"{_MANY} {_FINAL}")
def ss_cluster(spark: SparkSession, d: str) -> DataFrame:
    return successive.successive_sampling(V(spark, d), K, seed=SEED).candidates.select("id", "center_id")


@query(f"""{_MANY}, f AS MATERIALIZED ({_FINAL}), g AS (SELECT center_id, row_number() OVER (ORDER BY count(*) DESC, center_id) AS p FROM f GROUP BY 1 QUALIFY p <= {K}),
q AS (SELECT v.id, g.center_id, row_number() OVER (PARTITION BY v.id ORDER BY (v.id <> g.center_id), {dist('v.e', 'w.e')}, g.p) AS r FROM v, g JOIN v w ON w.id = g.center_id)
SELECT id, center_id FROM q WHERE r = 1""")
def ss_cluster_exact_k(spark: SparkSession, d: str) -> DataFrame:
    return successive.successive_sampling(V(spark, d), K, seed=SEED, final=K).assigned.select("id", "center_id")


# --- The coreset, step by step ---------------------------------------------------------------------------

#: Sizes of a round over n rows, as SQL over the count; the kernel grows with the log of n.
_N = "(SELECT count(*) FROM v)"

_S = f"""z AS (SELECT {_N} AS n, greatest(12, floor(1.2 * greatest(1, floor(log2(greatest({_N}, 2) + 0.5))))::BIGINT) AS cg),
{sample_sql('s1', 'v', str(3 * K), 2 * SEED + 1)}, {sample_sql('s2', 'v', str(8 * K), 2 * SEED + 2)}"""
_REST = "rest AS (SELECT * FROM v WHERE id NOT IN (SELECT id FROM s1 UNION SELECT id FROM s2))"
_X = f"x AS (SELECT s1.id AS s, s2.id AS v, {dist('s1.e', 's2.e')} AS d, row_number() OVER (ORDER BY {dist('s1.e', 's2.e')}, s1.p, s2.p) AS xr FROM s1, s2 WHERE s1.id <> s2.id), xs AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY xr) AS r FROM x)"
_KERNELS = "k AS (SELECT s, v, d, xr FROM xs, z WHERE r <= cg)"
_GUARDS = "g AS (SELECT s, v, d FROM xs, z WHERE r > cg + 5 AND r <= cg + 5 + greatest(1, cg // 3))"
_CORE = """pairs AS (SELECT a.id AS a, b.id AS b FROM s1 a, s1 b WHERE a.p < b.p),
both_sides AS (SELECT a, b, 0 AS side, v, xr FROM pairs JOIN k ON k.s = a UNION ALL SELECT a, b, 1, v, xr FROM pairs JOIN k ON k.s = b),
merged AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY xr) AS zr FROM both_sides),
lasts AS (SELECT a, b, arg_max(side, zr) AS last FROM merged GROUP BY 1, 2),
core AS (SELECT CASE last WHEN 0 THEN a ELSE b END AS s, CASE last WHEN 0 THEN b ELSE a END AS t, v FROM merged JOIN lasts USING (a, b), z WHERE side <> last AND NOT zr BETWEEN 2 * cg - 5 AND 2 * cg)"""
_FILTER = f"""near AS (SELECT rest.id, g.s, count(*) FILTER ({dist('s1.e', 'rest.e')} < g.d) AS c FROM rest, g JOIN s1 ON s1.id = g.s GROUP BY 1, 2),
prox AS (SELECT rest.id, rest.pos, rest.e, coalesce(max(near.c), 0)::INTEGER AS prox FROM rest LEFT JOIN near USING (id) GROUP BY 1, 2, 3),
cand AS (SELECT id, pos, e, prox FROM prox QUALIFY row_number() OVER (ORDER BY prox, pos) <= 3 * (SELECT count(*) FROM prox) // 4)"""
_Y = f"y AS (SELECT s1.id AS s, cand.id AS v, {dist('s1.e', 'cand.e')} AS d, cand.e FROM s1, cand)"
_PIVOT = "pv AS (SELECT y.* FROM y JOIN s1 ON s1.id = y.s JOIN cand ON cand.id = y.v ORDER BY s1.p, cand.pos LIMIT 1)"
#: Each edge against the pivot by the literal vote of the core's members.
_TEST = f"""plus AS (SELECT s, t, v FROM core UNION ALL SELECT s, s, v FROM k),
one_way AS (SELECT y.s, y.v, count(*) AS l, count(*) FILTER (NOT y.d < {dist('m.e', 'pv.e')}) AS c FROM y, pv JOIN plus ON plus.s = y.s AND plus.t = pv.s JOIN v m ON m.id = plus.v GROUP BY 1, 2),
other_way AS (SELECT y.s, y.v, count(*) AS l, count(*) FILTER (NOT pv.d < {dist('m.e', 'y.e')}) AS c FROM y, pv JOIN plus ON plus.s = pv.s AND plus.t = y.s AND y.s <> pv.s JOIN v m ON m.id = plus.v GROUP BY 1, 2),
tested AS (SELECT y.s, y.v, CASE WHEN o.l IS NOT NULL THEN NOT (o.c > o.l // 2) WHEN w.l IS NOT NULL THEN w.c > w.l // 2 ELSE true END AS less FROM y LEFT JOIN one_way o USING (s, v) LEFT JOIN other_way w USING (s, v))"""


def _start(spark: SparkSession, d: str) -> tuple:
    rows = V(spark, d)
    sizes = coreset.round_sizes(rows.count(), K)
    return rows, sizes, *coreset.samples(rows, sizes, SEED)


def _sql(*parts: str) -> str:
    return ", ".join([VIEW, _S, *parts[:-1]]) + " " + parts[-1]


@query(_sql("SELECT 1 AS which, id, p::INTEGER AS p FROM s1 UNION ALL SELECT 2, id, p::INTEGER FROM s2"))
def algg_samples(spark: SparkSession, d: str) -> DataFrame:
    _, _, one, two = _start(spark, d)
    return one.select(F.lit(1).alias("which"), "id", "p").unionByName(two.select(F.lit(2).alias("which"), "id", "p"))


@query(_sql(_REST, "SELECT id, pos FROM rest"))
def algg_non_sample(spark: SparkSession, d: str) -> DataFrame:
    rows, _, one, two = _start(spark, d)
    return coreset.non_sample(rows, one, two).select("id", "pos")


@query(_sql(_X, "SELECT s, v, d, xr::INTEGER AS xr FROM x"))
def algg_edge_order(spark: SparkSession, d: str) -> DataFrame:
    _, _, one, two = _start(spark, d)
    return coreset.edge_order(one, two)


@query(_sql(_X, _KERNELS, "SELECT s, v, d, xr::INTEGER AS xr FROM k"))
def algg_kernels(spark: SparkSession, d: str) -> DataFrame:
    _, sizes, one, two = _start(spark, d)
    return coreset.kernels(coreset.edge_order(one, two), sizes)


@query(_sql(_X, _GUARDS, "SELECT s, v, d FROM g"))
def algg_guards(spark: SparkSession, d: str) -> DataFrame:
    _, sizes, one, two = _start(spark, d)
    return coreset.guards(coreset.edge_order(one, two), sizes)


@query(_sql(_X, _KERNELS, _CORE, "SELECT s, t, v FROM core"))
def algg_core_prime(spark: SparkSession, d: str) -> DataFrame:
    _, sizes, one, two = _start(spark, d)
    return coreset.core_prime(one, coreset.kernels(coreset.edge_order(one, two), sizes), sizes)


def _candidates(spark: SparkSession, d: str) -> tuple:
    rows, sizes, one, two = _start(spark, d)
    ordered = coreset.edge_order(one, two)
    return rows, sizes, one, ordered, coreset.guard_filter(coreset.non_sample(rows, one, two), one, coreset.guards(ordered, sizes))


@query(_sql(_REST, _X, _GUARDS, _FILTER, "SELECT id, pos, prox FROM cand"))
def algg_guard_filter(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)[-1].select("id", "pos", "prox")


def _tested(spark: SparkSession, d: str) -> DataFrame:
    """Every edge to a candidate against the edge of the first sample and the first candidate."""
    rows, sizes, one, ordered, chosen = _candidates(spark, d)
    kernel = coreset.kernels(ordered, sizes)
    found = coreset.table(edge_sort.edge_table(chosen, edge_sort.blocks(one, kernel, rows, sizes.kernel), SEED), "edges")
    first = chosen.orderBy("pos").limit(1).select(F.col("id").alias("v"))
    pivot = found.where("p = 1").join(F.broadcast(first), "v").select(*[F.col(c).alias(f"pivot_{c}") for c in found.columns])
    return edge_sort.test_edges(found.crossJoin(F.broadcast(pivot)), sizes.kernel)


_ALL_TO_TEST = (_REST, _X, _KERNELS, _GUARDS, _CORE, _FILTER, _Y, _PIVOT, _TEST)


@query(_sql(*_ALL_TO_TEST, "SELECT s, v, less FROM tested"))
def algg_alg_test(spark: SparkSession, d: str) -> DataFrame:
    return _tested(spark, d).select("s", "v", "less")


_LEVEL = "lvl AS (SELECT t.*, t.s = pv.s AND t.v = pv.v AS own, count(*) OVER () AS n, sum((less AND NOT (t.s = pv.s AND t.v = pv.v))::INTEGER) OVER () AS l FROM tested t, pv)"


@query(_sql(*_ALL_TO_TEST, _LEVEL, """SELECT s, v, (CASE WHEN own THEN l WHEN less THEN 0 ELSE l + 1 END)::BIGINT AS lo,
  (CASE WHEN own THEN l + 1 WHEN less THEN l ELSE n END)::BIGINT AS hi FROM lvl"""))
def algg_adv_sort_level(spark: SparkSession, d: str) -> DataFrame:
    own = (F.col("s") == F.col("pivot_s")) & (F.col("v") == F.col("pivot_v"))
    tested = coreset.table(_tested(spark, d).withColumn("own", own), "level")
    n, less = tested.agg(F.count("*"), F.count_if(F.col("less") & ~F.col("own"))).first()
    below = F.col("less") & ~F.col("own")
    return tested.select("s", "v", F.when(F.col("own"), less).when(below, 0).otherwise(less + 1).cast("long").alias("lo"), F.when(F.col("own"), less + 1).when(below, less).otherwise(n).cast("long").alias("hi"))


_GIVEN = f"{_Y}, o AS (SELECT s, v, row_number() OVER (ORDER BY d, s, v) - 1 AS ord FROM y), e AS (SELECT arg_min(s, ord) AS s, v, min(ord) AS ord FROM o GROUP BY v)"


def _given_order(spark: SparkSession, d: str) -> tuple:
    """The nearest edges where edges are in the plain order of distance."""
    rows, _, one, _, chosen = _candidates(spark, d)
    found = coreset.edges(one, chosen.withColumn("p", F.lit(0)))
    ordered = coreset.rank_rows(found.select(F.col("left_id").alias("s"), F.col("right_id").alias("v"), "d"), "d", "s", "v", name="ord")
    return rows, coreset.nearest_edges(ordered.withColumn("ord", F.col("ord") - 1))


@query(_sql(_REST, _X, _GUARDS, _FILTER, _GIVEN, "SELECT s, v, ord FROM e"))
def algg_nearest_edge(spark: SparkSession, d: str) -> DataFrame:
    return _given_order(spark, d)[1]


@query(_sql(_REST, _X, _GUARDS, _FILTER, _GIVEN, f"SELECT s, v, ord FROM e QUALIFY row_number() OVER (ORDER BY ord) <= greatest(1, {_N} // 2)"))
def algg_safe_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows, near = _given_order(spark, d)
    return coreset.safe_prefix(near, rows.count())


@query()
def algg_round(spark: SparkSession, d: str) -> DataFrame:
    rows = V(spark, d)
    return coreset.one_round(rows, rows.count(), K, SEED)[0]


@query()
def algg_cluster(spark: SparkSession, d: str) -> DataFrame:
    return coreset.coreset_cluster(V(spark, d), K, seed=SEED).candidates.select("id", "center_id")


@query()
def algg_cluster_exact_k(spark: SparkSession, d: str) -> DataFrame:
    return coreset.coreset_cluster(V(spark, d), K, seed=SEED, final=K).assigned.select("id", "center_id")
