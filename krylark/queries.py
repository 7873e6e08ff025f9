"""Registered queries on sparse systems, with independent DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import formats
from .model import SparseMatrix, matrix
from .operators import algebra, amg, partition
from .operators import solve as solving
from .plans import linop
from .sources import generators as gen
from .sources.matrix_market import dense_table
from .storage import shared_root

TIGHT = {"tolerance": 1e-13, "max_iters": 2000}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def kept(a: SparseMatrix) -> SparseMatrix:
    """A matrix that several steps use, written once."""
    shared_root(a.df.sparkSession)
    return SparseMatrix(a.df.checkpoint(), a.meta)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounded columns without negative zeros."""
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


# Matrices from the tables


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """(r, c, v): revenue by the customer's and the supplier's nation."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("r"))
    supp = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("c"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("r", "c").agg(F.sum("v").alias("v"))


def n_nations(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "nation").count()


TRADE = """trade as (select c_nationkey::bigint as r, s_nationkey::bigint as c, sum(l_extendedprice * (1 - l_discount)) as v
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2)"""


def influence(spark: SparkSession, sf: str) -> SparseMatrix:
    """I - 0.85 P^T with P the row-normalized trade matrix: nonsymmetric and diagonally dominant by columns."""
    n = n_nations(spark, sf)
    w = trade(spark, sf)
    p = w.join(w.groupBy("r").agg(F.sum("v").alias("s")), "r").select(F.col("c").alias("r"), F.col("r").alias("c"), (-0.85 * F.col("v") / F.col("s")).alias("v"))
    eye = spark.range(n).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("v"))
    return matrix(p.unionByName(eye).groupBy("r", "c").agg(F.sum("v").alias("v")), n)


INFLUENCE = TRADE + """, sums as (select r, sum(v) as s from trade group by r),
pt as (select c as r, trade.r as c, v / s as w from trade join sums using (r))"""


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(r, c, v): how often two parts stand on neighbouring lines of an order, both ways; linear in the lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("b is not null and a <> b")
    once = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").cast("double").alias("v"))  # half the rows to shuffle
    return once.selectExpr("inline(array(struct(a as r, b as c, v), struct(b as r, a as c, v)))")


EDGES = """pairs as (select l_partkey as a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as b from lineitem),
edges as (select a as r, b as c, count(*)::double as v from (select a, b from pairs where b is not null and a <> b union all select b, a from pairs where b is not null and a <> b) group by 1, 2)"""


def laplacian(spark: SparkSession, sf: str, mu: float = 1.0) -> SparseMatrix:
    """L + mu D of the part graph, with one on the diagonal of parts without neighbours; symmetric and dominant."""
    n = table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] + 1
    e = part_edges(spark, sf)
    diag = spark.range(n).toDF("r").join(e.groupBy("r").agg(F.sum("v").alias("d")), "r", "left").select("r", F.col("r").alias("c"), F.coalesce(F.col("d") * (1 + mu), F.lit(1.0)).alias("v"))
    return matrix(e.select("r", "c", (-F.col("v")).alias("v")).unionByName(diag), n, symmetric=True)


LAPLACIAN = EDGES + """, deg as (select r, sum(v) as d from edges group by r),
idx as (select i::bigint as i from range((select max(p_partkey) + 1 from part)) t(i)),
lap as (select r, c, -v as v from edges union all select i, i, coalesce(2 * d, 1.0) from idx left join deg on r = i)"""


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """(i, x): part prices in thousands, zero where a key has no part."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), (F.col("p_retailprice") / 1000).alias("x"))
    n = table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] + 1
    return spark.range(n).toDF("i").join(part, "i", "left").select("i", F.coalesce("x", F.lit(0.0)).alias("x"))


PRICES = "rhs as (select i, coalesce(p_retailprice / 1000, 0.0) as b from idx left join part on p_partkey = i)"


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    """(r, c, v): counts of event types that follow each other for a user; types are numbered by name."""
    events = table(spark, sf, "events")
    kinds = events.select("event_type").distinct()
    number = kinds.withColumn("k", F.row_number().over(Window.orderBy("event_type")) - 1)  # a row for each type
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.select("event_type", F.lead("event_type").over(w).alias("next")).where("next is not null").groupBy("event_type", "next").count()
    right = number.select(F.col("event_type").alias("next"), F.col("k").alias("c"))
    return pairs.join(F.broadcast(number), "event_type").join(F.broadcast(right), "next").select(F.col("k").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("count").cast("double").alias("v"))


TRANSITIONS = """kinds as (select event_type, row_number() over (order by event_type) - 1 as k from (select distinct event_type from events)),
steps as (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next from events),
trans as (select a.k::bigint as r, b.k::bigint as c, count(*)::double as v from steps join kinds a on a.event_type = steps.event_type join kinds b on b.event_type = steps.next group by 1, 2)"""


def gram(spark: SparkSession, sf: str) -> DataFrame:
    """(r, c, v): X^T X of the embeddings; every Arrow batch gives one small matrix, and those are summed."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float)
                g = x.T @ x
                r, c = np.indices(g.shape)
                yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(g.ravel())], names=["r", "c", "v"])

    return table(spark, sf, "embeddings").select("embedding").mapInArrow(run, "r long, c long, v double").groupBy("r", "c").agg(F.sum("v").alias("v"))


GRAM = """x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as k from embeddings),
gram as (select a.k::bigint as r, b.k::bigint as c, sum(a.v * b.v) as v from x a join x b using (vec_id) group by 1, 2)"""


def fixed_point(edges: str, nodes: str, sweeps: int, head: str = "", out: str = "i, round(x, 6) + 0.0 as x") -> str:
    """SQL of x <- (b + sum w x) / d from zero: ``edges`` has (r, c, w), ``nodes`` (i, b, d)."""
    return f"""with recursive {head}{', ' if head else ''}e as materialized ({edges}), nodes as materialized ({nodes}),
it as (select 0 as k, i, 0.0::double as x from nodes
  union all
  select (select max(k) from it) + 1, nodes.i, (any_value(b) + coalesce(sum(w * it.x), 0.0)) / any_value(d) from nodes left join e on e.r = nodes.i left join it on it.i = e.c
  where (select max(k) from it) < {sweeps} group by nodes.i)
select {out} from it where k = {sweeps}"""


def cg_sql(entries: str, rhs: str, steps: int, out: str, head: str = "") -> str:
    """SQL of ``steps`` of conjugate gradients from zero: ``entries`` has (r, c, v), ``rhs`` (i, b); ``out`` selects from it (k, i, x, r)."""
    return f"""with recursive {head}{', ' if head else ''}e as materialized ({entries}), rhs as materialized ({rhs}),
it as (select 0 as k, i, 0.0::double as x, b::double as r, b::double as p from rhs
  union all
  select k + 1, i, x, r, r + rr_new / rr * p from (
    select *, sum(r * r) over () as rr_new from (
      select k, i, x + rr / pq * p as x, r - rr / pq * q as r, p, rr from (
        select *, sum(r * r) over () as rr, sum(p * q) over () as pq from (
          select a.k, a.i, any_value(a.x) as x, any_value(a.r) as r, any_value(a.p) as p, coalesce(sum(e.v * b.p), 0.0) as q from it a left join e on e.r = a.i left join it b on b.i = e.c where a.k < {steps} group by a.k, a.i))))
  )
{out}"""


# Generators


@query("select i as r, i + s as c, case s when 0 then 4.0 else -1.0 end::double as v from range(64) t(i), (values (-1), (0), (1)) o(s) where i + s between 0 and 63")
def gen_tridiagonal(spark, sf):
    return gen.tridiagonal_matrix(spark, 64, 4.0).df


def _grid(n: int, lo: float, hi: float, centre: str = "4.0") -> str:
    return f"""select (y * {n} + x)::bigint as r, ((y + dy) * {n} + x + dx)::bigint as c, case when dx = 0 and dy = 0 then {centre} when dx < 0 or dy < 0 then {lo} else {hi} end::double as v
from range({n}) a(x), range({n}) b(y), (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dx, dy) where x + dx between 0 and {n - 1} and y + dy between 0 and {n - 1}"""


@query(_grid(12, -1.0, -1.0))
def gen_poisson2d(spark, sf):
    return gen.poisson_matrix(spark, 12).df


@query(_grid(9, -1.25, -0.75))
def gen_poisson2d_skew(spark, sf):
    return gen.poisson_matrix(spark, 9, 0.5).df


@query("""select (y * 7 + x)::bigint as r, ((y + dy) * 7 + x + dx)::bigint as c, case when dx = 0 and dy = 0 then 4.0 else -1.0 end::double as v
from range(7) a(x), range(4) b(y), (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dx, dy) where x + dx between 0 and 6 and y + dy between 0 and 3""")
def gen_poisson_rect(spark, sf):
    return gen.poisson_rect_matrix(spark, 7, 4).df


@query("""select (i * 25 + j * 5 + k)::bigint as r, ((i + di) * 25 + (j + dj) * 5 + k + dk)::bigint as c, case when di = 0 and dj = 0 and dk = 0 then 6.0 when di + dj + dk < 0 then -1.5 else -0.5 end::double as v
from range(5) a(i), range(5) b(j), range(5) d(k), (values (0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) o(di, dj, dk)
where i + di between 0 and 4 and j + dj between 0 and 4 and k + dk between 0 and 4""")
def gen_poisson3d(spark, sf):
    return gen.poisson3d_matrix(spark, 5, 1.0).df


@query("""with p as (select 0.01 * 49 as d, 1.0 * cos(0.7) * 7 as ax, 1.0 * sin(0.7) * 7 as ay)
select (y * 8 + x)::bigint as r, ((y + dy) * 8 + x + dx)::bigint as c,
  round(case when dx = 0 and dy = 0 then 4 * d + ax + ay when dx = -1 then -d - ax when dy = -1 then -d - ay else -d end, 6) + 0.0 as v
from p, range(8) a(x), range(8) b(y), (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dx, dy) where x + dx between 0 and 7 and y + dy between 0 and 7""")
def gen_convdiff(spark, sf):
    return rounded(gen.convection_diffusion_matrix_2d(spark, 8, 0.01, 0.7, 1.0).df, "v")


@query("select i, round(i / 49.0, 6) + 0.0 as x from range(50) t(i)")
def gen_rhs_linear(spark, sf):
    return rounded(gen.rhs_linear(spark, 50), "x")


@query("select i, 1.0::double as x from range(50) t(i)")
def gen_rhs_ones(spark, sf):
    return gen.rhs_ones(spark, 50)


@query(f"""with p as ({_grid(6, -1.0, -1.0)}), m(a, b, w) as (values (0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0))
select r * 2 + a as r, c * 2 + b as c, (v * w)::double as v from p, m""")
def gen_kron(spark, sf):
    return gen.kron(gen.poisson_matrix(spark, 6), formats.to_matrix(spark, [[2.0, 1.0], [1.0, 2.0]])).df


@query("select 4000::bigint as rows, true as dominant, 0::bigint as missing_diagonals")
def gen_random(spark, sf):
    """Every row is strictly dominant by rows and has its diagonal."""
    a = gen.random_matrix(spark, 4000, 0.002, seed=3)
    per = a.df.groupBy("r").agg(F.sum(F.when(F.col("r") == F.col("c"), F.col("v")).otherwise(-F.abs("v"))).alias("slack"), F.sum((F.col("r") == F.col("c")).cast("long")).alias("d"))
    return per.agg(F.count("*").alias("rows"), F.min(F.col("slack") > 0.999).alias("dominant"), F.sum((F.col("d") != 1).cast("long")).alias("missing_diagonals"))


@query("select 5000::bigint as n, true as centred, true as unit_variance")
def gen_rhs_random(spark, sf):
    return gen.rhs_random(spark, 5000, 1).agg(F.count("*").alias("n"), (F.abs(F.avg("x")) < 0.06).alias("centred"), (F.abs(F.stddev("x") - 1) < 0.06).alias("unit_variance"))


# Matrices and conversions


@query(f"with {TRADE} select r, c, round(v, 4) + 0.0 as v from trade")
def mat_trade(spark, sf):
    return rounded(trade(spark, sf), "v", digits=4)


@query(f"with {LAPLACIAN} select r, c, v from lap")
def mat_laplacian(spark, sf):
    return laplacian(spark, sf).df


@query(f"with {TRANSITIONS} select r, c, v from trans")
def mat_transition(spark, sf):
    return transitions(spark, sf)


@query(f"with {GRAM} select r, c, round(v, 4) + 0.0 as v from gram")
def mat_gram(spark, sf):
    return rounded(gram(spark, sf), "v", digits=4)


@query("select vec_id as r, c::bigint as c, v from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as c from embeddings) where v <> 0")
def dense_to_coo(spark, sf):
    return dense_table(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("select vec_id as r, c::bigint as c, v from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as c from embeddings) where abs(v) > 0.1")
def drop_zeros(spark, sf):
    return formats.drop_zeros(dense_table(table(spark, sf, "embeddings"), "vec_id", "embedding"), 0.1)


@query(f"with {LAPLACIAN} select r, list(c order by c) as cols, list(v order by c) as vals from lap group by r")
def csr_rows(spark, sf):
    return formats.to_csr_rows(laplacian(spark, sf).df)


@query(f"with {LAPLACIAN} select c, list(r order by r) as rows, list(v order by r) as vals from lap group by c")
def csc_columns(spark, sf):
    return formats.to_csc_columns(laplacian(spark, sf).df)


@query(f"with {LAPLACIAN}, n as (select r, count(*) as n from lap group by r) select r, (sum(n) over (order by r) - n)::bigint as start, sum(n) over (order by r)::bigint as stop from n")
def csr_indptr(spark, sf):
    return formats.csr_indptr(laplacian(spark, sf))


@query(f"with {LAPLACIAN} select r, c, v from lap")
def csr_round_trip(spark, sf):
    return formats.expand_csr(formats.to_csr_rows(laplacian(spark, sf).df))


@query(f"""with {LAPLACIAN}, cells as (select r // 2 as br, c // 2 as bc, (r % 2) * 2 + c % 2 as pos, v from lap)
select br, bc, [{", ".join(f"coalesce(sum(v) filter (where pos = {k}), 0.0)" for k in range(4))}] as blk from cells group by br, bc""")
def to_bsr(spark, sf):
    """An odd number of rows is rounded up: the last block ends in an empty row and column."""
    a = laplacian(spark, sf)
    return formats.to_bsr(matrix(a.df, a.shape[0] + a.shape[0] % 2), 2)


# Algebra


@query(f"with {LAPLACIAN}, {PRICES} select idx.i, round(coalesce(sum(v * b), 0.0), 6) + 0.0 as x from idx left join lap on r = idx.i left join rhs on rhs.i = c group by idx.i")
def spmv(spark, sf):
    return rounded(algebra.spmv(laplacian(spark, sf), prices(spark, sf)), "x")


@query(f"with {TRADE} select n_nationkey::bigint as i, round(coalesce(sum(v), 0.0), 4) + 0.0 as x from nation left join trade on c = n_nationkey group by 1")
def spmv_empty_rows(spark, sf):
    """Sales by supplier nation; nations without suppliers are empty rows of the transposed matrix and give zero."""
    n = n_nations(spark, sf)
    return rounded(algebra.spmv(algebra.transpose(matrix(trade(spark, sf), n)), gen.rhs_ones(spark, n)), "x", digits=4)


@query(f"with {TRANSITIONS} select a.r, b.c, sum(a.v * b.v) as v from trans a join trans b on a.c = b.r group by 1, 2")
def spgemm(spark, sf):
    t = matrix(transitions(spark, sf), 64)
    return algebra.spgemm(t, t).df


@query(f"with {TRADE} select c as r, r as c, round(v, 4) + 0.0 as v from trade")
def transpose(spark, sf):
    return rounded(algebra.transpose(matrix(trade(spark, sf), n_nations(spark, sf))).df, "v", digits=4)


@query(f"with {LAPLACIAN} select r as i, sum(v) as x, sum(abs(v)) as a from lap group by r")
def row_sums(spark, sf):
    return algebra.row_sums(laplacian(spark, sf))


@query(f"with {LAPLACIAN} select r as i, sum(case when r = c then v else abs(v) end) as x from lap group by r")
def l1_diagonal(spark, sf):
    return algebra.l1_diagonal(laplacian(spark, sf))


@query(f"with {LAPLACIAN} select r as i, v as x from lap where r = c")
def diag_extract(spark, sf):
    return algebra.diagonal(laplacian(spark, sf))


@query(f"with {LAPLACIAN}, d as (select sum(case when r = c then v else 0 end) as d, sum(case when r <> c then abs(v) else 0 end) as o from lap group by r) select min(d - o) as lo, max(d + o) as hi from d")
def gershgorin(spark, sf):
    return algebra.gershgorin(laplacian(spark, sf))


@query(f"with {LAPLACIAN}, {PRICES} select r, c, round(-(l.b * q.b), 10) + 0.0 as v from lap join rhs l on l.i = r join rhs q on q.i = c")
def sddmm(spark, sf):
    x = prices(spark, sf)
    return rounded(algebra.sddmm(laplacian(spark, sf), x, x), "v", digits=10)


@query("""with k as (select i::bigint as br from range(36) t(i)) select br, [round(8.0 / 48, 6) + 0.0, round(-4.0 / 48, 6) + 0.0, round(-4.0 / 48, 6) + 0.0, round(8.0 / 48, 6) + 0.0] as blk from k""")
def block_diag_inverse(spark, sf):
    a = gen.kron(gen.poisson_matrix(spark, 6), formats.to_matrix(spark, [[2.0, 1.0], [1.0, 2.0]]))
    return algebra.block_diagonal_inverse(a, 2).select("br", F.transform("blk", lambda x: F.round(x, 6) + 0.0).alias("blk"))


@query(f"with {LAPLACIAN} select (select count(*) from idx) as n_rows, count(*) as entries, true as same_pattern, false as other_pattern from lap")
def structure_hash(spark, sf):
    """Values do not change the key of a pattern, places do."""
    lap = laplacian(spark, sf)
    a, b, c = (algebra.structure_hash(m) for m in (lap, SparseMatrix(lap.df.select("r", "c", (F.col("v") * 3).alias("v")), lap.meta), SparseMatrix(lap.df.where("r <> 1 or c <> 1"), lap.meta)))
    return spark.createDataFrame([(a[0], a[-1], a == b, a[2:] == c[2:])], "n_rows long, entries long, same_pattern boolean, other_pattern boolean")


# Partitions


@query("select pid::int as pid, (pid * 14 + least(pid, 2))::bigint as row_start, (pid * 14 + least(pid, 2) + 14 + case when pid < 2 then 1 else 0 end)::bigint as row_end from range(7) t(pid)")
def partition_info(spark, sf):
    return partition.partition_info(spark, 100, 7)


PARTS = """meta as (select count(*) as n, count(*) // 5 as size, count(*) % 5 as extra from idx),
owned as (select lap.*, case when r < extra * (size + 1) then r // (size + 1) else extra + (r - extra * (size + 1)) // size end::int as pid,
  case when c < extra * (size + 1) then c // (size + 1) else extra + (c - extra * (size + 1)) // size end::int as owner from lap, meta)"""


@query(f"with {LAPLACIAN}, {PARTS} select pid, r, c, v from owned")
def partition_rows(spark, sf):
    return partition.with_owner(laplacian(spark, sf), 5)


@query(f"with {LAPLACIAN}, {PARTS} select distinct pid, c, owner from owned where owner <> pid")
def halo_columns(spark, sf):
    return partition.halo_columns(laplacian(spark, sf), 5)


@query(f"with {LAPLACIAN}, {PRICES}, {PARTS} select pid, c, b as x from (select distinct pid, c from owned where owner <> pid) join rhs on i = c")
def halo_gather(spark, sf):
    return partition.halo_gather(laplacian(spark, sf), prices(spark, sf), 5)


@query(f"with {LAPLACIAN}, {PARTS} select owner, pid, count(distinct c) as n from owned where owner <> pid group by 1, 2")
def halo_plan(spark, sf):
    return partition.halo_plan(laplacian(spark, sf), 5)


@query(f"with {LAPLACIAN}, {PARTS} select owner as pid, count(*) as nnz from owned group by 1")
def transpose_nnz(spark, sf):
    return partition.transpose_nnz(laplacian(spark, sf), 5)


@query(f"with {LAPLACIAN}, {PARTS} select count(*) as nnz, true as rows_from_zero, true as rows_in_range, true as columns_in_range from owned where pid = 2")
def validate_partition(spark, sf):
    a = laplacian(spark, sf)
    size, extra = divmod(a.shape[0], 5)
    start = 2 * size + min(2, extra)
    return partition.validate_partition(partition.partition_rows(a, 2, 5), a.shape[1], start, start + size + (2 < extra))


# Solves

TRADE_SOLUTION = fixed_point("select r, c, 0.85 * w as w from pt", "select n_nationkey::bigint as i, 0.15 / (select count(*) from nation) as b, 1.0 as d from nation", 200, INFLUENCE)


def _solved(a: SparseMatrix, b: DataFrame, name: str, inner: object = "BLOCK_JACOBI", digits: int = 6, **options) -> DataFrame:
    x, _ = solving.solve(a, b, None, {"solver": name, "preconditioner": inner, **TIGHT, **options})
    return rounded(x, "x", digits=digits)


def _teleport(spark: SparkSession, sf: str) -> DataFrame:
    n = n_nations(spark, sf)
    return spark.range(n).select(F.col("id").alias("i"), F.lit(0.15 / n).alias("x"))


@query(TRADE_SOLUTION)
def solve_trade(spark, sf):
    """The flagship: influence of nations in trade, a nonsymmetric system from four joined tables."""
    return _solved(influence(spark, sf), _teleport(spark, sf), "PBICGSTAB")


LAP_SOLUTION = fixed_point("select r, c, v as w from edges", "select idx.i, b, coalesce(2 * d, 1.0) as d from idx left join deg on deg.r = idx.i join rhs on rhs.i = idx.i", 60, LAPLACIAN + ", " + PRICES)
for _name, _solver, _inner in (
    ("solve_cg_laplacian", "CG", {}), ("solve_pcg", "PCG", "BLOCK_JACOBI"), ("solve_pcgf", "PCGF", "BLOCK_JACOBI"), ("solve_bicgstab", "BICGSTAB", {}), ("solve_gmres", "GMRES", "JACOBI_L1"), ("solve_fgmres", "FGMRES", "CHEBYSHEV"),
    ("solve_idr", "IDR", "BLOCK_JACOBI"), ("solve_idrmsync", "IDRMSYNC", "BLOCK_JACOBI"), ("solve_amg_pcg", "PCG", {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_2", "min_coarse_rows": 64}),
    ("solve_amg_w_size4", "PBICGSTAB", {"solver": "AMG", "algorithm": "AGGREGATION", "selector": "SIZE_4", "cycle": "W", "min_coarse_rows": 64}), ("solve_dilu", "PCG", "MULTICOLOR_DILU"), ("solve_gs", "PBICGSTAB", "MULTICOLOR_GS"),
    ("solve_jacobi", "BLOCK_JACOBI", {}), ("solve_jacobi_l1", "JACOBI_L1", {}), ("solve_chebyshev", "CHEBYSHEV", {}), ("solve_cf_jacobi", "PBICGSTAB", "CF_JACOBI"),
):
    def _run(spark, sf, solver=_solver, inner=_inner):
        return _solved(laplacian(spark, sf), prices(spark, sf), solver, inner)

    _run.__name__ = _name
    query(LAP_SOLUTION)(_run)


@query(LAP_SOLUTION)
def solve_table_cg(spark, sf):
    """The same system by the loop over distributed tables."""
    x, _ = solving.solve(laplacian(spark, sf), prices(spark, sf), None, {"solver": "PCG", "preconditioner": "BLOCK_JACOBI", **TIGHT, "tolerance": 1e-10}, strategy="table", num_partitions=4)
    return rounded(x, "x", digits=6)


@query(fixed_point("select r, c, 0.85 * w as w from pt", "select n_nationkey::bigint as i, 0.15 / (select count(*) from nation) as b, 1.0 as d from nation", 200, INFLUENCE))
def solve_warm(spark, sf):
    """Started from the right-hand side instead of zero; the answer is the same."""
    b = _teleport(spark, sf)
    x, _ = solving.solve(influence(spark, sf), b, b, {"solver": "BICGSTAB", "convergence": "ABSOLUTE", "tolerance": 1e-14, "max_iters": 500})
    return rounded(x, "x")


@query(fixed_point("select c as r, r as c, 0.85 * w as w from pt", "select n_nationkey::bigint as i, (1.0 + n_nationkey) / 100 as b, 1.0 as d from nation", 250, INFLUENCE))
def solve_transpose(spark, sf):
    g = spark.range(n_nations(spark, sf)).select(F.col("id").alias("i"), ((1.0 + F.col("id")) / 100).alias("x"))
    x, _ = solving.solve_transpose(influence(spark, sf), g, {"solver": "PBICGSTAB", "preconditioner": "BLOCK_JACOBI", **TIGHT})
    return rounded(x, "x")


@query(cg_sql("select r, c, v + case when r = c then 100.0 else 0.0 end as v from gram", "select distinct r as i, 1.0 as b from gram", 60, "select i, round(x, 6) + 0.0 as x from it where k = 60", GRAM))
def solve_gram_direct(spark, sf):
    """Dense factorization of the Gram matrix + 100 I, against conjugate gradients in SQL."""
    g = gram(spark, sf)
    d = g.agg(F.max("r")).first()[0] + 1
    shift = spark.range(d).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(100.0).alias("v"))
    a = matrix(g.unionByName(shift).groupBy("r", "c").agg(F.sum("v").alias("v")), d)
    x, _ = solving.solve(a, gen.rhs_ones(spark, d), None, {"solver": "DENSE_LU_SOLVER", "tolerance": 1e-12})
    return rounded(x, "x")


KRON = f"p as ({_grid(6, -1.0, -1.0)}), m(a, b, w) as (values (0, 0, 3.0), (0, 1, 1.0), (1, 0, 0.5), (1, 1, 2.0)), full_a as (select r * 2 + a as r, c * 2 + b as c, (v * w)::double as v from p, m)"


@query(fixed_point("select r, c, case when r = c then 14.0 - v else -v end as w from full_a", "select i::bigint as i, 1.0 as b, 14.0 as d from range(72) t(i)", 2500, KRON))
def solve_block(spark, sf):
    a = gen.kron(gen.poisson_matrix(spark, 6), formats.to_matrix(spark, [[3.0, 1.0], [0.5, 2.0]]))
    x, _ = solving.solve(a, gen.rhs_ones(spark, 72), None, {"solver": "PBICGSTAB", **TIGHT}, block_dim=2)
    return rounded(x, "x")


@query("\nunion all\n".join("select %d::bigint as batch, i, x from (%s)" % (k, fixed_point("select i as r, i + s as c, 1.0 as w from range(32) t(i), (values (-1), (1)) o(s) where i + s between 0 and 31", f"select i::bigint as i, {k + 1}.0 as b, {k + 3}.0 as d from range(32) t(i)", 120)) for k in range(3)))
def solve_batched(spark, sf):
    a = b = None
    for k in range(3):
        m = gen.tridiagonal_matrix(spark, 32, k + 3.0).df.withColumn("batch", F.lit(k).cast("long"))
        r = spark.range(32).select(F.lit(k).cast("long").alias("batch"), F.col("id").alias("i"), F.lit(k + 1.0).alias("x"))
        a, b = (m, r) if a is None else (a.unionByName(m), b.unionByName(r))
    return rounded(solving.solve_batched(a, b, 32, {"solver": "PCG", "preconditioner": "BLOCK_JACOBI", **TIGHT}).select("batch", "i", "x"), "x")


@query(fixed_point("select r, c, -v as w from (" + _grid(8, -1.25, -0.75) + ") where r <> c", "select i::bigint as i, 1.0 as b, 4.0 as d from range(64) t(i)", 600))
def solve_amg_classical(spark, sf):
    """Classical multigrid: PMIS and distance-two interpolation, as the default preconditioner."""
    x, _ = solving.solve(gen.poisson_matrix(spark, 8, 0.5), gen.rhs_ones(spark, 64), None, {"tolerance": 1e-13})
    return rounded(x, "x")


# Fixed numbers of sweeps: every intermediate value is determined


@query(fixed_point("select i as r, i + s as c, 1.0 as w from range(64) t(i), (values (-1), (1)) o(s) where i + s between 0 and 63", "select i::bigint as i, 1.0 as b, 4.0 as d from range(64) t(i)", 7))
def jacobi_k_sweeps(spark, sf):
    x, _ = solving.solve(gen.tridiagonal_matrix(spark, 64, 4.0), gen.rhs_ones(spark, 64), None, {"solver": "BLOCK_JACOBI", "relaxation_factor": 1.0, "tolerance": 1e-30, "max_iters": 7})
    return rounded(x, "x")


@query(fixed_point("select i as r, i + s as c, case when s = 0 then (case when i in (0, 63) then 1.0 else 2.0 end) else 1.0 end as w from range(64) t(i), (values (-1), (0), (1)) o(s) where i + s between 0 and 63", "select i::bigint as i, 1.0 as b, case when i in (0, 63) then 5.0 else 6.0 end as d from range(64) t(i)", 9))
def l1_jacobi_k_sweeps(spark, sf):
    x, _ = solving.solve(gen.tridiagonal_matrix(spark, 64, 4.0), gen.rhs_ones(spark, 64), None, {"solver": "JACOBI_L1", "tolerance": 1e-30, "max_iters": 9})
    return rounded(x, "x")


@query(cg_sql("select i as r, i + s as c, case s when 0 then 4.0 else -1.0 end as v from range(100) t(i), (values (-1), (0), (1)) o(s) where i + s between 0 and 99", "select i::bigint as i, 1.0 as b from range(100) t(i)", 12, "select k::int as iteration, round(sqrt(sum(r * r)), 9) + 0.0 as residual from it group by k"))
def residual_history(spark, sf):
    """Residual norms of plain conjugate gradients, entry by entry."""
    _, info = solving.solve(gen.tridiagonal_matrix(spark, 100, 4.0), gen.rhs_ones(spark, 100), None, {"solver": "CG", "convergence": "ABSOLUTE", "tolerance": 1e-6})
    return rounded(spark.createDataFrame(list(enumerate(info["residual_history"])), "iteration int, residual double"), "residual", digits=9)


@query(cg_sql("select i as r, i + s as c, case s when 0 then 4.0 else -1.0 end as v from range(32) t(i), (values (-1), (0), (1)) o(s) where i + s between 0 and 31", "select i::bigint as i, 1.0 as b from range(32) t(i)", 30, """select 'SUCCESS' as status, min(k)::int as iterations from (select k, sqrt(sum(r * r)) as n from it group by k) where n <= 1e-6 * sqrt(32)"""))
def solve_info(spark, sf):
    """Status and the number of steps to a relative residual of 1e-6."""
    _, info = solving.solve(gen.tridiagonal_matrix(spark, 32, 4.0), gen.rhs_ones(spark, 32), None, {"solver": "CG", "max_iters": 100})
    return spark.createDataFrame([(info["status"].name, info["iterations"])], "status string, iterations int")


_REUSED = "\nunion all\n".join("select %d::bigint as scale, i, x from (%s)" % (k, fixed_point("select r, c, -v as w from (" + _grid(6, -1.25, -0.75) + ") where r <> c", f"select i::bigint as i, {1 / k} as b, 4.0 as d from range(36) t(i)", 400)) for k in (1, 2))


@query(_REUSED)
def solve_reuse_setup(spark, sf):
    """A and then 2 A with the setup of A's pattern: each solution is its own matrix's."""
    a, b = gen.poisson_matrix(spark, 6, 0.5), gen.rhs_ones(spark, 36)
    solving.clear_cache()
    out = None
    for k in (1, 2):
        scaled = SparseMatrix(a.df.select("r", "c", (F.col("v") * k).alias("v")), a.meta)
        x, _ = solving.solve(scaled, b, None, {"tolerance": 1e-13}, reuse_setup=True)
        x = rounded(x, "x").select(F.lit(k).cast("long").alias("scale"), "i", "x")
        out = x if out is None else out.unionByName(x)
    return out


@query("select 1::bigint as size, 1::bigint as capacity, false as isolated_mode, 32::bigint as n_rows, 94::bigint as entries")
def cache_info(spark, sf):
    solving.clear_cache()
    solving.solve(gen.tridiagonal_matrix(spark, 32, 4.0), gen.rhs_ones(spark, 32), reuse_setup=True, config={"solver": "CG"})
    info = solving.cache_info()
    solving.clear_cache()
    entry = info["entries"][0]
    return spark.createDataFrame([(info["size"], info["capacity"], info["isolated_mode"], entry["shape"][0], entry["entries"])], "size long, capacity long, isolated_mode boolean, n_rows long, entries long")


# Adjoint


@query(fixed_point("select c as r, r as c, 0.85 * w as w from pt", "select n_nationkey::bigint as i, 1.0 as b, 1.0 as d from nation", 250, INFLUENCE))
def adjoint_b(spark, sf):
    """The gradient of sum(x) by the right-hand side."""
    a = kept(influence(spark, sf))
    x, _ = solving.solve(a, _teleport(spark, sf), None, {"preconditioner": "BLOCK_JACOBI", **TIGHT})
    grad, _, _ = solving.solve_vjp(a, x, gen.rhs_ones(spark, a.shape[0]), {"preconditioner": "BLOCK_JACOBI", **TIGHT})
    return rounded(grad, "x")


_ADJOINT = fixed_point("select c as r, r as c, 0.85 * w as w from pt", "select n_nationkey::bigint as i, 1.0 as b, 1.0 as d from nation", 250, INFLUENCE, "i, x")
_PRIMAL = fixed_point("select r, c, 0.85 * w as w from pt", "select n_nationkey::bigint as i, 0.15 / (select count(*) from nation) as b, 1.0 as d from nation", 200, INFLUENCE, "i, x")


@query(f"with {INFLUENCE}, lam as ({_ADJOINT}), sol as ({_PRIMAL}), pattern as (select r, c from pt union select n_nationkey, n_nationkey from nation) select r, c, round(-lam.x * sol.x, 6) + 0.0 as v from pattern join lam on lam.i = r join sol on sol.i = c")
def adjoint_a_sddmm(spark, sf):
    """The gradient of sum(x) by the matrix, on its pattern."""
    a = kept(influence(spark, sf))
    x, _ = solving.solve(a, _teleport(spark, sf), None, {"preconditioner": "BLOCK_JACOBI", **TIGHT})
    _, grad, _ = solving.solve_vjp(a, x, gen.rhs_ones(spark, a.shape[0]), {"preconditioner": "BLOCK_JACOBI", **TIGHT})
    return rounded(grad, "v")


_TRI = lambda d: fixed_point("select i as r, i + s as c, 1.0 as w from range(32) t(i), (values (-1), (1)) o(s) where i + s between 0 and 31", f"select i::bigint as i, 1.0 as b, {d} as d from range(32) t(i)", 150, "", "i, x")


@query(f"select round((select sum(x) from ({_TRI(4.0001)})) / 0.0002 - (select sum(x) from ({_TRI(3.9999)})) / 0.0002, 4) + 0.0 as gradient")
def param_gradient(spark, sf):
    """d sum(x) / d(diagonal) of a tridiagonal system: the adjoint against central differences."""
    a = gen.tridiagonal_matrix(spark, 32, 4.0)
    ones = gen.rhs_ones(spark, 32)
    x, _ = solving.solve(a, ones, None, {"solver": "CG", **TIGHT})
    _, grad, _ = solving.solve_vjp(a, x, ones, {"solver": "CG", **TIGHT})
    da = spark.range(32).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("d"))
    return rounded(solving.parameter_gradient(grad, da), "gradient", digits=4)


# Multigrid steps


@query(f"with {LAPLACIAN}, top as (select r, max(-v) as top from lap where r <> c group by r) select lap.r, c, v from lap join top using (r) where r <> c and top > 0 and -v >= 0.5 * top")
def strength_graph(spark, sf):
    return amg.strength_graph(laplacian(spark, sf))


@query(f"""with {LAPLACIAN}, sym as (select r as i, c as j, 2 * abs(v) as w from lap where r <> c), best as (select i, j from (select *, row_number() over (partition by i order by w desc, (least(i, j) % 1000003 * 7919 + greatest(i, j) % 1000003 * 104729) % 1000003 desc, j) as k from sym) where k = 1),
shakes as (select a.i, least(a.i, a.j) as agg from best a join best b on a.j = b.i and b.j = a.i) select idx.i, coalesce(agg, idx.i) as agg from idx left join shakes on shakes.i = idx.i""")
def aggregate_size2(spark, sf):
    return amg.aggregates(laplacian(spark, sf))


@query(f"""with {LAPLACIAN} select r // 2 * 2 as r, c // 2 * 2 as c, sum(v) as v from lap group by 1, 2""")
def galerkin_rap(spark, sf):
    a = laplacian(spark, sf)
    pairs = spark.range(a.shape[0]).select(F.col("id").alias("i"), (F.floor(F.col("id") / 2) * 2).alias("agg"))
    return amg.galerkin(a, pairs).df


def _shaken(source: str, name: str) -> str:
    """SQL: a level of handshakes on ``source`` (r, c, v) and the summed matrix ``name`` below it."""
    return f"""{name}_sym as (select r as i, c as j, sum(abs(v)) as w from (select r, c, v from {source} where r <> c union all select c, r, v from {source} where r <> c) group by 1, 2),
{name}_best as (select i, j from (select *, row_number() over (partition by i order by w desc, (least(i, j) % 1000003 * 7919 + greatest(i, j) % 1000003 * 104729) % 1000003 desc, j) as k from {name}_sym) where k = 1),
{name}_agg as (select a.i, least(a.i, a.j) as agg from {name}_best a join {name}_best b on a.j = b.i and b.j = a.i),
{name} as (select coalesce(x.agg, r) as r, coalesce(y.agg, c) as c, sum(v) as v from {source} left join {name}_agg x on x.i = r left join {name}_agg y on y.i = c group by 1, 2)"""


@query(f"with {LAPLACIAN}, {_shaken('lap', 'one')}, {_shaken('one', 'two')}\n" + " union all ".join(f"select {k}::int as level, count(distinct r) as rows, count(*) as entries from {t}" for k, t in enumerate(("lap", "one", "two"))))
def grid_stats(spark, sf):
    """Rows and entries of three levels of pairwise aggregation."""
    a = laplacian(spark, sf)
    levels = [SparseMatrix(a.df.persist(), a.meta)]
    for _ in range(2):
        coarse = amg.galerkin(levels[-1], amg.handshake(levels[-1]))
        levels.append(SparseMatrix(coarse.df.persist(), coarse.meta))
    stats = amg.grid_stats(levels)
    for level in levels:
        level.df.unpersist()
    return spark.createDataFrame(stats, "level int, rows long, entries long")


# Patterns of operators


def _pattern(spark: SparkSession, op: linop.Op) -> DataFrame:
    return linop.trace_pattern(spark, op)


@query(f"select r, c from ({_grid(10, -1.0, -1.0)})")
def pattern_conv(spark, sf):
    return _pattern(spark, linop.poisson_operator(10))


@query("select i as r, (i * 5 + 3) % 12 as c from range(12) t(i)")
def pattern_gather(spark, sf):
    return _pattern(spark, linop.Move(linop.Input(12), 12, lambda o: (o * 5 + 3) % 12))


@query("select i as r, i as c from range(16) t(i) where i % 2 = 1 union select 2 * i, i from range(8) t(i)")
def pattern_scatter(spark, sf):
    x = linop.Input(16)
    return _pattern(spark, linop.Scatter(x, linop.Move(x, 8, lambda o: o), lambda u: 2 * u))


@query("select i as r, case when i < 5 then i else 11 - i end as c from range(12) t(i)")
def pattern_select(spark, sf):
    x = linop.Input(12)
    return _pattern(spark, linop.Where(lambda o: o < 5, x, linop.Move(x, 12, lambda o: 11 - o)))


@query(f"with {TRANSITIONS} select distinct r, c from trans")
def pattern_dot(spark, sf):
    return _pattern(spark, linop.Dot(matrix(transitions(spark, sf), 64), linop.Input(64)))


@query("select i as r, j as c from range(12) a(i), range(12) b(j) where j between i - 3 and i")
def pattern_scan(spark, sf):
    """Three steps of x + shift(x)."""
    return _pattern(spark, linop.scan(linop.Input(12), lambda c, k: c + linop.Move(c, 12, lambda o: o - 1), 3))


@query("select i as r, i as c from range(48) t(i) where i % 2 = 0")
def pattern_zero_skip(spark, sf):
    return _pattern(spark, linop.Weights(linop.Input(48), lambda o: F.when(o % 2 == 0, 1.0).otherwise(0.0)))


@query("select i // 4 as r, i as c from range(12) t(i) union all select 3 + i, i from range(12) t(i)")
def pattern_reduce_concat(spark, sf):
    x = linop.Input(12)
    return _pattern(spark, linop.Concat([linop.Reduce(x, 3, lambda i: F.floor(i / 4)), x]))


@query(f"select r, c, v from ({_grid(7, -1.25, -0.75)})")
def probe_pattern(spark, sf):
    return rounded(linop.probe(spark, linop.poisson_operator(7, 0.5).apply, 49), "v")


@query(f"select r, c, v from ({_grid(7, -1.0, -1.0)})")
def materialize_op(spark, sf):
    """The operator's matrix from one evaluation for each color."""
    a, _ = linop.cache_coloring(spark, linop.poisson_operator(7), 49)
    return rounded(a.df, "v")


@query("select 0::bigint as conflicts, 0::bigint as uncolored")
def coloring_valid(spark, sf):
    """Columns that share a row never share a color."""
    p = gen.poisson_matrix(spark, 8).df.select("r", "c")
    colors = linop.color_columns(p)
    clash = linop.conflict_graph(p).join(colors.toDF("a", "ka"), "a").join(colors.toDF("b", "kb"), "b").where("ka = kb").count()
    missing = p.select("c").distinct().join(colors, "c", "left_anti").count()
    return spark.range(1).select(F.lit(clash).cast("long").alias("conflicts"), F.lit(missing).cast("long").alias("uncolored"))


@query(f"with p as (select r, c from ({_grid(8, -1.0, -1.0)})) select distinct x.c as a, y.c as b from p x join p y using (r) where x.c <> y.c")
def conflict_graph(spark, sf):
    return linop.conflict_graph(gen.poisson_matrix(spark, 8).df)


from . import queries_parts  # noqa: E402, F401  (registers its own)
