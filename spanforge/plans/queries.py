"""The registered queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counts as C
from ..functions import region as R
from ..functions import text as X
from ..operators import flow, frames, joins, program, reads, scan, stats, tracks
from ..operators.flow import Flow
from ..operators.table import Catalog, View
from ..sources import text as files
from . import store
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
RD, GN, TX, TK = V.READS, V.GENES, V.TRANSCRIPTS, V.TRACK
OVER1 = "r.ref = g.ref AND r.strand = g.strand AND s1 < ge AND gs < e1"
OVER2 = "r.ref = g.ref AND r.strand = g.strand AND ((s1 < ge AND gs < e1) OR (s2 < ge AND gs < e2))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import more_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# --- scans, projections, filters, order, paging -------------------------------------------------


@query(f"WITH {RD} SELECT l_orderkey, l_partkey, s1, e2 FROM reads WHERE ref = 'A' AND strand = '+' AND ((s1 < 4000 AND 2000 < e1) OR (s2 < 4000 AND 2000 < e2))")
def scan_location(spark, d):
    path = store.folder(spark, "regions")
    files.write_regions(V.reads(spark, d), path)
    hits = files.scan_regions(spark, path, "A+:2000-4000")
    return hits.select("l_orderkey", "l_partkey", R.start("parts").alias("s1"), R.end("parts").alias("e2"))


@query(f"""WITH {RD} SELECT ref, strand, sum(cnt)::BIGINT AS n_all, sum(CASE WHEN multiplicity <= 1 THEN cnt ELSE 0 END)::BIGINT AS n_unique,
  count(*) FILTER (cnt > 0)::BIGINT AS n_collapse, count(*) FILTER (cnt > 0 AND multiplicity <= 1)::BIGINT AS n_collapse_unique,
  sum(6 * cnt // multiplicity)::BIGINT AS n_divide6 FROM reads WHERE cnt >= 10 GROUP BY ALL""")
def filter_modes(spark, d):
    c, m = F.col("cnt"), F.col("multiplicity")
    r = V.reads(spark, d).where("cnt >= 10")
    return r.groupBy("ref", "strand").agg(
        F.sum(C.count("All", c, m)).alias("n_all"), F.sum(C.count("Unique", c, m)).cast("bigint").alias("n_unique"), F.sum(C.count("CollapseAll", c, m)).cast("bigint").alias("n_collapse"),
        F.sum(C.count("CollapseUnique", c, m)).cast("bigint").alias("n_collapse_unique"), F.sum(F.round(6 * C.count("Divide", c, m)).cast("bigint")).alias("n_divide6"),
    )


@query("SELECT o_orderkey, o_orderkey * 2 AS twice, o_orderkey * 2 + 1 AS odd FROM orders WHERE o_orderkey % 7 = 3")
def project_lateral_alias(spark, d):
    return Flow(V.table(spark, d, "orders")).filter("o_orderkey % 7 = 3").df.selectExpr("o_orderkey", "o_orderkey * 2 AS twice", "twice + 1 AS odd")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT'")
def where_and_or_new(spark, d):
    v = View(V.table(spark, d, "orders")).where("o_orderstatus = 'O'").where("o_orderstatus = 'F'", "NEW").where("o_totalprice > 200000").where("o_orderpriority = '1-URGENT'", "OR")
    return v.select("o_orderkey", "o_orderstatus").iterate()


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def order_page(spark, d):
    return View(V.table(spark, d, "orders")).order_by(F.desc("o_totalprice"), "o_orderkey").page(100, 150).select("o_orderkey", "o_custkey").iterate()


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) WHERE rn >= (n - 1) // 400 * 400")
def page_last(spark, d):
    return View(V.table(spark, d, "orders"), page_size=400).order_by("o_orderkey").last().select("o_orderkey").iterate()


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'P') WHERE rn > 20 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def view_delete(spark, d):
    return View(V.table(spark, d, "orders")).where("o_orderstatus = 'P'").order_by("o_orderkey").page(0, 20).delete().select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_k(spark, d):
    return Flow(V.table(spark, d, "customer").select("c_custkey", "c_acctbal")).sort(F.desc("c_acctbal"), "c_custkey").head(25).df


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 70")
def head_skip_sub(spark, d):
    return Flow(V.table(spark, d, "customer").select("c_custkey")).sub(70, 100, "c_custkey").df


@query("SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b FROM events) WHERE b = 1")
def skip_while(spark, d):
    return Flow(V.table(spark, d, "events").select("user_id", "event_id", "event_type")).skip_while(["user_id"], ["event_id"], F.col("event_type") == "click").df.drop("event_type")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL")
def cast_filtered(spark, d):
    return Flow(V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))).cast_filtered("k", "bigint").df


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error'")
def json_path(spark, d):
    return V.table(spark, d, "events").where("event_type = 'error'").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- aggregation -------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def tabulate(spark, d):
    return Flow(V.table(spark, d, "events")).tabulate("event_type").df


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most, min(o_orderkey) AS first FROM orders GROUP BY ALL")
def fold_by_key(spark, d):
    return Flow(V.table(spark, d, "orders")).fold(["o_custkey"], n=F.count("*"), most=F.max("o_totalprice"), first=F.min("o_orderkey")).df


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS keys, count(*) AS n FROM orders GROUP BY ALL")
def group_collect_count(spark, d):
    g = Flow(V.table(spark, d, "orders").select("o_custkey", "o_orderkey")).group(["o_custkey"]).df
    return g.select("o_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"), F.size("rows").cast("bigint").alias("n"))


@query("SELECT o_custkey, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
def index_smallest(spark, d):
    return Flow(V.table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey")).index_smallest(["o_custkey"], ["o_totalprice", "o_orderkey"]).df


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY ALL")
def index_multi(spark, d):
    return Flow(V.table(spark, d, "nation").select("n_regionkey", "n_name")).index_combine(["n_regionkey"], "n_name", lambda c: F.array_join(F.array_sort(F.collect_list(c)), "|")).df.withColumnRenamed("n_name", "names")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def index_unique_lookup(spark, d):
    names = joins.unique_lookup(V.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    return V.table(spark, d, "nation").join(names, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query(f"""WITH {RD} SELECT ref, strand, count(*) FILTER (sample = 0) AS s0, count(*) FILTER (sample = 1) AS s1, count(*) FILTER (sample = 2) AS s2, count(*) FILTER (sample = 3) AS s3 FROM reads GROUP BY ALL""")
def counter_pivot(spark, d):
    return stats.counter(V.reads(spark, d), ["ref", "strand"], "sample", [0, 1, 2, 3]).withColumnsRenamed({str(i): f"s{i}" for i in range(4)})


@query(f"WITH {RD} SELECT sample, sum(cnt)::BIGINT AS n, sum(CASE WHEN multiplicity <= 1 THEN cnt ELSE 0 END)::BIGINT AS uniq FROM reads GROUP BY ALL")
def readcount_modes(spark, d):
    c, m = F.col("cnt"), F.col("multiplicity")
    return V.reads(spark, d).groupBy("sample").agg(F.sum(C.count("All", c, m)).alias("n"), F.sum(C.count("Unique", c, m)).cast("bigint").alias("uniq"))


@query(f"WITH {RD} SELECT sample, sum(cnt)::BIGINT AS n, sum(CASE WHEN ref = 'A' THEN cnt ELSE 0 END)::BIGINT AS mito, sum(CASE WHEN ref <> 'A' THEN cnt ELSE 0 END)::BIGINT AS rest FROM reads GROUP BY ALL")
def readcount_mito_split(spark, d):
    mito = F.col("ref") == "A"
    return V.reads(spark, d).groupBy("sample").agg(F.sum("cnt").alias("n"), F.sum(F.when(mito, F.col("cnt")).otherwise(0)).alias("mito"), F.sum(F.when(~mito, F.col("cnt")).otherwise(0)).alias("rest"))


@query(f"""WITH {RD}, t AS (SELECT sample, sum(cnt) AS total FROM reads GROUP BY ALL)
  SELECT ref, r.sample, round(sum(cnt) * 1e6 / any_value(total), 4) AS rpm FROM reads r JOIN t ON r.sample = t.sample GROUP BY ref, r.sample""")
def rpm_normalize(spark, d):
    r = V.reads(spark, d)
    total = r.groupBy("sample").agg(F.sum("cnt").alias("total"))
    return r.groupBy("ref", "sample").agg(F.sum("cnt").alias("n")).join(F.broadcast(total), "sample").select("ref", "sample", F.round(C.rpm(F.col("n"), F.col("total")), 4).alias("rpm"))


def _vectors(spark, d):
    """A count vector over four samples for each part."""
    r = V.reads(spark, d)
    return r.groupBy("l_partkey").agg(F.array(*[F.sum(F.when(F.col("sample") == i, F.col("cnt")).otherwise(0)).cast("double") for i in range(4)]).alias("v"))


VEC = RD + """, vec AS (SELECT l_partkey, sum(CASE WHEN sample = 0 THEN cnt ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN sample = 1 THEN cnt ELSE 0 END)::DOUBLE AS b,
  sum(CASE WHEN sample = 2 THEN cnt ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN sample = 3 THEN cnt ELSE 0 END)::DOUBLE AS d FROM reads GROUP BY ALL)"""


@query(f"WITH {VEC}, m AS (SELECT *, greatest(a, b, c, d) AS m FROM vec) SELECT l_partkey, round(CASE WHEN m > 0 THEN (a + b + c + d) / m * log2(m) ELSE 0 END, 9) AS logsc, round(CASE WHEN m > 1 THEN (a + b + c + d) / m ELSE a + b + c + d END, 9) AS scaled FROM m")
def downsample_logsc(spark, d):
    v = F.col("v")
    return _vectors(spark, d).select("l_partkey", F.round(C.vector_sum(C.downsample("Logsc", v)), 9).alias("logsc"), F.round(C.vector_sum(C.downsample("Max", v)), 9).alias("scaled"))


@query(f"WITH {VEC} SELECT l_partkey, round(log2((a + 1) / (b + 1)), 6) AS lfc FROM vec")
def log2fc(spark, d):
    return _vectors(spark, d).select("l_partkey", F.round(C.log2_fold_change(F.get("v", F.lit(0)), F.get("v", F.lit(1))), 6).alias("lfc"))


@query(f"""WITH {VEC}, x AS (SELECT l_partkey, list_sort([a, b, c, d]) AS v FROM vec)
  SELECT l_partkey, list_sum(v) AS total, v[1] AS low, v[4] AS high, (v[2] + v[3]) / 2 AS median, list_avg(v) AS mean, list_sum(list_transform(v, lambda y: y * y)) AS squares,
    round(sqrt(list_sum(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))) / 3), 6) AS sd FROM x""")
def vector_stats(spark, d):
    v, f = F.col("v"), C.VECTOR
    return _vectors(spark, d).select(
        "l_partkey", f["Sum"](v).alias("total"), f["Min"](v).alias("low"), f["Max"](v).alias("high"), f["Median"](v).alias("median"), f["Mean"](v).alias("mean"),
        f["SumOfSquares"](v).alias("squares"), F.round(f["StandardDeviation"](v), 6).alias("sd"),
    )


@query(f"""WITH {VEC}, x AS (SELECT l_partkey, list_sort([a, b, c, d]) AS v FROM vec)
  SELECT l_partkey, v[1] + (v[2] - v[1]) * 0.75 AS q1, v[3] + (v[4] - v[3]) * 0.25 AS q3, v[2] AS second, (v[2] + v[3]) / 2 AS trimmed FROM x""")
def quantiles(spark, d):
    v = F.col("v")
    return _vectors(spark, d).select("l_partkey", C.quantile(v, 0.25).alias("q1"), C.quantile(v, 0.75).alias("q3"), C.order_statistic(v, 1).alias("second"), C.trimmed_mean(v, 0.25).alias("trimmed"))


@query(f"WITH {VEC} SELECT l_partkey, a AS c0, a + b AS c1, a + b + c AS c2, a + b + c + d AS c3 FROM vec")
def cumsum_decumsum(spark, d):
    v = _vectors(spark, d).withColumn("c", C.cumulative(F.col("v"))).withColumn("back", C.decumulate(F.col("c"))).where(F.col("v") == F.col("back"))
    return v.select("l_partkey", *[F.get("c", F.lit(i)).alias(f"c{i}") for i in range(4)])


@query("SELECT CASE WHEN value <= 20 - 60.0 / 10 THEN -1 WHEN (value - 20) * 10 / 60 >= 10 THEN 10 ELSE trunc((value - 20) * 10 / 60)::BIGINT END AS bin, count(*) AS n FROM events GROUP BY ALL")
def binning_fixed(spark, d):
    return Flow(V.table(spark, d, "events").select(C.bin_fixed(F.col("value"), 20.0, 80.0, 10).alias("bin"))).tabulate("bin").df


@query("SELECT (value >= 5)::BIGINT + (value >= 25)::BIGINT + (value >= 50)::BIGINT + (value >= 90)::BIGINT - 1 AS bin, count(*) AS n FROM events GROUP BY ALL")
def binning_boundaries(spark, d):
    return Flow(V.table(spark, d, "events").select(C.bin_boundaries(F.col("value"), [5, 25, 50, 90]).alias("bin"))).tabulate("bin").df


@query("""WITH k AS (SELECT p_partkey, unnest([substr(p_name, i, 2) FOR i IN range(1, length(p_name))]) AS m FROM part), n AS (SELECT p_partkey, m, count(*) AS c FROM k GROUP BY ALL),
  t AS (SELECT p_partkey, sum(c) AS t FROM n GROUP BY ALL) SELECT n.p_partkey, round(-sum(c / t * log2(c / t)), 5) AS entropy FROM n JOIN t ON n.p_partkey = t.p_partkey GROUP BY n.p_partkey""")
def entropy_kmer(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.round(X.kmer_entropy(F.col("p_name"), 2), 5).alias("entropy"))


@query(f"""WITH {TK}, g AS (SELECT ref, user_id, value, count(*) OVER (PARTITION BY ref, user_id) AS t, count(*) OVER (PARTITION BY ref, user_id, value) AS c FROM track)
  SELECT ref, user_id, round(-sum(DISTINCT_P), 5) AS entropy FROM (SELECT DISTINCT ref, user_id, value, c / t * log2(c / t) AS DISTINCT_P FROM g) GROUP BY ALL""")
def column_entropy(spark, d):
    e = stats.column_entropy(V.numeric_track(spark, d), ["ref", "user_id"], "value")
    return e.select("ref", "user_id", F.round("entropy", 5).alias("entropy"))


# --- distinct, sets, union -----------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events QUALIFY coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true)")
def unique_adjacent(spark, d):
    return Flow(V.table(spark, d, "events").select("user_id", "event_id", "event_type")).unique_adjacent(["user_id"], ["event_id"], "event_type").df


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def unique_global(spark, d):
    return Flow(V.table(spark, d, "orders").select("o_custkey", "o_orderstatus")).unique_global().df


@query("SELECT s_nationkey AS k, 's' AS src FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer")
def chain_union(spark, d):
    return flow.chain(V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src")), V.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")))


@query("SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS turn, 0 AS src FROM supplier UNION ALL SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1, 1 FROM nation")
def alternating(spark, d):
    return flow.alternating(["k"], V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), V.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k")))


@query("SELECT s_nationkey AS k, 0 AS src FROM supplier UNION ALL SELECT n_nationkey, 1 FROM nation")
def merge_sorted(spark, d):
    return flow.merge_sorted(["k"], V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), V.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")))


@query("""WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey FROM supplier), b AS (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)
  SELECT 'intersect' AS op, k FROM a UNION ALL SELECT 'subtract', k FROM b""")
def set_intersect_subtract(spark, d):
    c, s = V.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("k")), V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    both, rest = joins.intersect_maps(c.distinct(), s.distinct(), ["k"]), joins.subtract_maps(n, s, ["k"])
    return flow.chain(both.select(F.lit("intersect").alias("op"), "k"), rest.select(F.lit("subtract").alias("op"), "k"))


@query(f"""WITH {RD}, s AS (SELECT l_orderkey, list_sort(list(DISTINCT ref)) AS a, list_sort(list(DISTINCT strand)) AS b, list_sort(list(DISTINCT CASE WHEN cnt > 25 THEN ref END) FILTER (cnt > 25)) AS c FROM reads GROUP BY ALL)
  SELECT l_orderkey, array_to_string(a, ',') AS a, array_to_string(list_sort(list_filter(a, lambda x: list_contains(coalesce(c, []), x))), ',') AS common, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(coalesce(c, []), x))), ',') AS rest FROM s""")
def feature_set_ops(spark, d):
    g = V.reads(spark, d).groupBy("l_orderkey").agg(F.collect_set("ref").alias("a"), F.collect_set(F.when(F.col("cnt") > 25, F.col("ref"))).alias("c"))
    a, c = F.col("a"), F.col("c")
    text = lambda op, x, y: F.array_join(flow.set_operation(op, x, y), ",")
    return g.select("l_orderkey", text("Union", a, a).alias("a"), text("Intersect", a, c).alias("common"), text("Subtract", a, c).alias("rest"))


@query("SELECT s_suppkey, variable, value FROM (UNPIVOT (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nationkey FROM supplier) ON s_acctbal, s_nationkey INTO NAME variable VALUE value)")
def melt(spark, d):
    return Flow(V.table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))).melt(["s_suppkey"], ["s_acctbal", "s_nationkey"]).df


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_nationkey AS k, n_name, n_regionkey FROM nation")
def frame_merge(spark, d):
    n = V.table(spark, d, "nation")
    return flow.frame_merge(["k"], n.select(F.col("n_nationkey").alias("k"), "n_name"), n.select(F.col("n_nationkey").alias("k"), "n_regionkey"))


@query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), b AS (SELECT p_partkey * 10 AS y, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)
  SELECT i, p_partkey AS x, y FROM a JOIN b USING (i)""")
def positional_zip(spark, d):
    p = V.table(spark, d, "part")
    z = flow.positional_zip(["k"], p.select(F.col("p_partkey").alias("k")), p.select((F.col("p_partkey") * 10).alias("k")))
    return z.select("i", F.col("a.k").alias("x"), F.col("b.k").alias("y"))


@query(f"""WITH {RD}, a AS (SELECT ref, strand, s1, sum(cnt)::BIGINT AS n FROM reads WHERE l_suppkey % 2 = 0 GROUP BY ALL), b AS (SELECT ref, strand, s1, sum(cnt)::BIGINT AS n FROM reads WHERE l_suppkey % 2 = 1 GROUP BY ALL)
  SELECT coalesce(a.ref, b.ref) AS ref, coalesce(a.strand, b.strand) AS strand, coalesce(a.s1, b.s1) AS s1, coalesce(a.n, 0) AS even, coalesce(b.n, 0) AS odd
  FROM a FULL JOIN b ON a.ref = b.ref AND a.strand = b.strand AND a.s1 = b.s1""")
def zip_full_outer(spark, d):
    r = V.reads(spark, d).withColumn("s1", R.start("parts"))
    side = lambda k: r.where(F.col("l_suppkey") % 2 == k).groupBy("ref", "strand", "s1").agg(F.sum("cnt").alias("n"))
    z = joins.zip_join({"even": side(0), "odd": side(1)}, ["ref", "strand", "s1"])
    return z.select("ref", "strand", "s1", F.coalesce("even.n", F.lit(0)).alias("even"), F.coalesce("odd.n", F.lit(0)).alias("odd"))


@query("SELECT a.n_regionkey AS g, a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def unordered_pairs(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("k"))
    return joins.unordered_pairs(n, ["g"], "k").select("g", F.col("a.k").alias("x"), F.col("b.k").alias("y"))


# --- interval joins --------------------------------------------------------------------------------


@query(f"WITH {RD}, {GN} SELECT gid, count(*) AS n, sum(cnt)::BIGINT AS total FROM reads r JOIN genes g ON {OVER1} GROUP BY gid")
def overlap_join_inner(spark, d):
    j = joins.overlap(V.first_parts(spark, d), V.genes(spark, d), "inner", "bounds")
    return j.groupBy(F.col("r.gid").alias("gid")).agg(F.count("*").alias("n"), F.sum("l.cnt").alias("total"))


@query(f"WITH {RD}, {GN} SELECT gid FROM genes g WHERE EXISTS (SELECT 1 FROM reads r WHERE {OVER2})")
def overlap_semi(spark, d):
    return joins.overlap(V.genes(spark, d), V.reads(spark, d), "semi", "any").select("gid")


@query(f"WITH {RD}, {GN} SELECT gid FROM genes g WHERE NOT EXISTS (SELECT 1 FROM reads r WHERE {OVER2})")
def overlap_anti(spark, d):
    return joins.overlap(V.genes(spark, d), V.reads(spark, d), "anti", "any").select("gid")


@query(f"WITH {RD}, {GN} SELECT gid, count(r.ref) AS n FROM genes g LEFT JOIN reads r ON {OVER2} GROUP BY gid")
def overlap_count(spark, d):
    return joins.overlap(V.genes(spark, d), V.reads(spark, d), "count", "any").select("gid", "n")


@query(f"WITH {RD}, {GN} SELECT gid, l_orderkey FROM genes g LEFT JOIN reads r ON {OVER2}")
def overlap_left(spark, d):
    j = joins.overlap(V.genes(spark, d), V.reads(spark, d), "left", "any")
    return j.select("l.gid", F.col("r.l_orderkey").alias("l_orderkey"))


@query(f"WITH {RD}, {GN} SELECT gid, count(*) AS n FROM reads r JOIN genes g ON r.ref = g.ref AND r.strand <> g.strand AND s1 < ge AND gs < e2 GROUP BY gid")
def overlap_antisense(spark, d):
    j = joins.overlap(V.genes(spark, d), V.reads(spark, d), "inner", "bounds", strand="antisense")
    return j.groupBy(F.col("l.gid").alias("gid")).agg(F.count("*").alias("n"))


@query(f"WITH {RD}, {GN} SELECT gid, count(*) AS n FROM reads r JOIN genes g ON r.ref = g.ref AND r.strand = g.strand AND gs <= s1 AND e2 <= ge GROUP BY gid")
def contained_join(spark, d):
    j = joins.overlap(V.reads(spark, d), V.genes(spark, d), "inner", "contained")
    return j.groupBy(F.col("r.gid").alias("gid")).agg(F.count("*").alias("n"))


@query(f"WITH {RD}, {GN} SELECT gid, count(*) AS n FROM reads r JOIN genes g ON r.ref = g.ref AND r.strand = g.strand AND s1 < ge AND gs < e2 AND NOT (e1 < ge AND gs < s2) GROUP BY gid")
def intron_consistent_join(spark, d):
    j = joins.overlap(V.reads(spark, d), V.genes(spark, d), "inner", "intron_consistent")
    return j.groupBy(F.col("r.gid").alias("gid")).agg(F.count("*").alias("n"))


@query(f"WITH {RD}, {GN} SELECT gid, count(*) AS n FROM genes g JOIN reads r ON r.ref = g.ref AND r.strand = g.strand AND s1 - gs BETWEEN -40 AND 40 AND e1 - ge BETWEEN -100 AND 100 GROUP BY gid")
def tolerance_join(spark, d):
    j = joins.tolerance(V.genes(spark, d), V.first_parts(spark, d), (-40, 40), (-100, 100))
    return j.groupBy("l.gid").agg(F.count("*").alias("n"))


def _nearest(side: str):
    distance = {"left": "gs - e1", "right": "s1 - ge", "any": "greatest(0, gs - e1, s1 - ge)"}[side]
    return f"""WITH {RD}, {GN}, p AS (SELECT gid, {distance} AS distance, count(*) AS n FROM genes g JOIN reads r ON r.ref = g.ref AND r.strand = g.strand AND {distance} BETWEEN 0 AND 500 GROUP BY ALL)
  SELECT gid, distance, n FROM p QUALIFY row_number() OVER (PARTITION BY gid ORDER BY distance) = 1"""


@query(_nearest("left"))
def nearest_left(spark, d):
    return joins.nearest(V.genes(spark, d), V.first_parts(spark, d), "left", 500, "gid").groupBy("gid", "distance").agg(F.count("*").alias("n"))


@query(_nearest("right"))
def nearest_right(spark, d):
    return joins.nearest(V.genes(spark, d), V.first_parts(spark, d), "right", 500, "gid").groupBy("gid", "distance").agg(F.count("*").alias("n"))


@query(_nearest("any"))
def nearest_any(spark, d):
    return joins.nearest(V.genes(spark, d), V.first_parts(spark, d), "any", 500, "gid").groupBy("gid", "distance").agg(F.count("*").alias("n"))


@query(f"WITH {RD}, {GN} SELECT gid, count(r.ref) AS depth FROM genes g LEFT JOIN reads r ON r.ref = g.ref AND r.strand = g.strand AND ((s1 <= gs AND gs < e1) OR (s2 <= gs AND gs < e2)) GROUP BY gid")
def spanning_depth(spark, d):
    points = V.genes(spark, d).select("gid", "ref", "strand", R.start("parts").alias("pos"))
    return joins.spanning(V.reads(spark, d), points).select("gid", "depth")


@query(f"WITH {RD}, {GN} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN EXISTS (SELECT 1 FROM genes g WHERE {OVER2}) THEN 'Exonic' WHEN EXISTS (SELECT 1 FROM genes g WHERE r.ref = g.ref AND r.strand = g.strand AND s1 < ge AND gs < e2) THEN 'Intronic' ELSE 'Intergenic' END AS class FROM reads r")
def exon_intron_class(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    both = joins.meets(V.reads(spark, d).select(*keys, "ref", "strand", "parts"), V.genes(spark, d))
    return both.select(*keys, program.exon_intron_class(F.col("exonic"), F.col("genic")).alias("class"))


@query(f"""WITH {RD}, {GN}, c AS (SELECT sum((r.strand = g.strand)::BIGINT) AS n_sense, sum((r.strand <> g.strand)::BIGINT) AS n_anti FROM reads r JOIN genes g ON r.ref = g.ref AND s1 < ge AND gs < e1)
  SELECT n_sense::BIGINT AS n_sense, n_anti::BIGINT AS n_anti, CASE WHEN n_sense > 2 * n_anti THEN 'Sense' WHEN n_anti > 2 * n_sense THEN 'Antisense' ELSE 'Unspecific' END AS strandness FROM c""")
def infer_strandness(spark, d):
    j = joins.overlap(V.first_parts(spark, d), V.genes(spark, d), "inner", "bounds", strand="unspecific")
    same = F.col("l.strand") == F.col("r.strand")
    c = j.agg(F.sum(same.cast("bigint")).alias("n_sense"), F.sum((~same).cast("bigint")).alias("n_anti"))
    return c.select("n_sense", "n_anti", F.when(F.col("n_sense") > 2 * F.col("n_anti"), "Sense").when(F.col("n_anti") > 2 * F.col("n_sense"), "Antisense").otherwise("Unspecific").alias("strandness"))


@query(f"""WITH {RD}, {GN}, o AS (SELECT gid, sample, sum(greatest(0, least(e1, ge) - greatest(s1, gs)) + greatest(0, least(e2, ge) - greatest(s2, gs)))::BIGINT AS bases FROM reads r JOIN genes g ON {OVER2} GROUP BY ALL) SELECT gid, sample, bases FROM o""")
def overlap_bases(spark, d):
    j = joins.overlap(V.reads(spark, d), V.genes(spark, d), "inner", "any")
    return j.groupBy("r.gid", "l.sample").agg(F.sum(R.intersect_length("l.parts", "r.parts")).alias("bases"))


@query(f"""WITH {RD}, {GN}, {TX} SELECT ids, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_sort(list(DISTINCT tid)), ',') AS ids FROM reads r JOIN tx g ON r.ref = g.ref AND r.strand = g.strand AND ((a1 <= s1 AND e1 <= b1) OR (a2 <= s1 AND e1 <= b2)) GROUP BY ALL) GROUP BY ids""")
def equivalence_classes(spark, d):
    j = joins.overlap(V.first_parts(spark, d), V.transcripts(spark, d), "inner", "contained")
    ec = stats.equivalence_classes(j.select(F.struct("l.l_orderkey", "l.l_linenumber", "l.l_partkey", "l.l_suppkey").alias("row"), "r.tid"), "row", "tid")
    return ec.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("ids"), "n")


@query()
def em_proportions(spark, d):
    j = joins.overlap(V.first_parts(spark, d), V.transcripts(spark, d), "inner", "contained")
    ec = stats.equivalence_classes(j.select(F.struct("l.l_orderkey", "l.l_linenumber", "l.l_partkey", "l.l_suppkey").alias("row"), "r.tid"), "row", "tid")
    return stats.em_proportions(ec).select(F.col("m").alias("tid"), "pi")


@query(f"""WITH chain AS (SELECT 'A' AS ref, i * 1000 AS s, i * 1000 + 900 AS e, 'B' AS to_ref, i * 1000 + 7 AS to_s FROM range(0, 2000) t(i) UNION ALL SELECT 'A', i * 5000 + 100, i * 5000 + 200, 'C', i FROM range(0, 400) t(i)),
  {GN}, m AS (SELECT gid, to_ref, to_s + gs - s AS pos FROM genes g LEFT JOIN chain c ON g.ref = c.ref AND gs >= s AND gs < e)
  SELECT gid, CASE count(DISTINCT to_ref || pos) WHEN 0 THEN 'unmapped' WHEN 1 THEN 'mapped' ELSE 'multimapped' END AS status, CASE WHEN count(DISTINCT to_ref || pos) = 1 THEN any_value(to_ref) END AS ref, CASE WHEN count(DISTINCT to_ref || pos) = 1 THEN any_value(pos) END AS pos FROM m GROUP BY gid""")
def liftover_unique(spark, d):
    i = F.col("id")
    a = spark.range(2000).select(F.lit("A").alias("ref"), (i * 1000).alias("s"), (i * 1000 + 900).alias("e"), F.lit("B").alias("to_ref"), (i * 1000 + 7).alias("to_s"))
    b = spark.range(400).select(F.lit("A").alias("ref"), (i * 5000 + 100).alias("s"), (i * 5000 + 200).alias("e"), F.lit("C").alias("to_ref"), i.alias("to_s"))
    return joins.liftover(V.genes(spark, d).select("gid", "ref", R.start("parts").alias("pos")), a.union(b), "gid")


# --- tracks and windows ------------------------------------------------------------------------------


@query(f"""WITH {RD}, m AS (SELECT *, max(e1) OVER (PARTITION BY ref, strand ORDER BY s1, e1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM reads),
  i AS (SELECT *, sum(CASE WHEN p IS NULL OR s1 >= p THEN 1 ELSE 0 END) OVER (PARTITION BY ref, strand ORDER BY s1, e1, p NULLS FIRST ROWS UNBOUNDED PRECEDING) AS isl FROM m)
  SELECT ref, strand, min(s1) AS s, max(e1) AS e, count(*) AS n, sum(cnt)::BIGINT AS total FROM i GROUP BY ref, strand, isl""")
def cluster_merge(spark, d):
    r = V.first_parts(spark, d).select("ref", "strand", R.start("parts").alias("s"), R.end("parts").alias("e"), "cnt")
    return tracks.clusters(r, 0, [F.sum("cnt").alias("total")])


@query(f"""WITH {RD}, m AS (SELECT *, max(e1) OVER (PARTITION BY ref, strand ORDER BY s1, e1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM reads),
  i AS (SELECT *, sum(CASE WHEN p IS NULL OR s1 >= p + 15 THEN 1 ELSE 0 END) OVER (PARTITION BY ref, strand ORDER BY s1, e1, p NULLS FIRST ROWS UNBOUNDED PRECEDING) AS isl FROM m)
  SELECT ref, strand, min(s1) AS s, max(e1) AS e, count(*) AS n FROM i GROUP BY ref, strand, isl HAVING count(*) > 1""")
def cluster_tolerance(spark, d):
    r = V.first_parts(spark, d).select("ref", "strand", R.start("parts").alias("s"), R.end("parts").alias("e"))
    return tracks.clusters(r, 15).where("n > 1")


@query(f"""WITH {RD}, ev AS (SELECT ref, strand, s1 AS pos, cnt AS v FROM reads UNION ALL SELECT ref, strand, e1, -cnt FROM reads UNION ALL SELECT ref, strand, s2, cnt FROM reads UNION ALL SELECT ref, strand, e2, -cnt FROM reads),
  st AS (SELECT ref, strand, pos, sum(v) AS v FROM ev GROUP BY ALL HAVING sum(v) <> 0), r AS (SELECT ref, strand, pos AS s, lead(pos) OVER w AS e, sum(v) OVER w AS depth FROM st WINDOW w AS (PARTITION BY ref, strand ORDER BY pos))
  SELECT ref, strand, s, e, depth::BIGINT AS depth FROM r WHERE depth <> 0 AND e IS NOT NULL""")
def coverage_runs(spark, d):
    return tracks.coverage(V.reads(spark, d), F.col("cnt"))


@query(f"WITH {RD} SELECT ref, strand, e1 AS s, s2 AS e, sum(6 * cnt // multiplicity)::BIGINT AS v FROM reads GROUP BY ALL")
def junction_counts(spark, d):
    return tracks.junctions(V.reads(spark, d), F.round(6 * C.count("Divide", F.col("cnt"), F.col("multiplicity"))).cast("bigint"))


@query(f"WITH {RD} SELECT ref, strand, CASE WHEN strand = '-' THEN e2 - 1 - 3 ELSE s1 + 3 END AS pos, sum(cnt)::BIGINT AS v FROM reads GROUP BY ALL")
def position_profile(spark, d):
    return tracks.position_profile(V.reads(spark, d), "FivePrime", F.col("cnt"), offset=3)


@query(f"""WITH {TK}, b AS (SELECT *, sum((ref = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM track) SELECT user_id, block::BIGINT AS block, count(*) AS n, min(pos) AS first FROM b GROUP BY ALL""")
def block_by_predicate(spark, d):
    b = Flow(V.numeric_track(spark, d)).blocks_by(["user_id"], "pos", F.col("ref") == "signup").df
    return b.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS block, o_orderkey FROM orders")
def fixed_blocks(spark, d):
    return Flow(V.table(spark, d, "orders").select("o_orderkey")).blocks_of(100, ["o_orderkey"]).df.select("block", "o_orderkey")


@query(f"""WITH {TK} SELECT ref, pos, list_reverse(list(value) OVER (PARTITION BY ref ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))::VARCHAR AS p FROM track""")
def previous_n(spark, d):
    p = Flow(V.numeric_track(spark, d)).previous(3, ["ref"], ["pos"], "value").df
    text = F.concat(F.lit("["), F.array_join(F.transform("previous", lambda x: x.cast("string")), ", "), F.lit("]"))
    return p.select("ref", "pos", F.when(F.size("previous") > 0, text).alias("p"))


@query(f"WITH {TK} SELECT ref, pos, sum(value) OVER w::BIGINT AS total, count(*) OVER w AS n, max(value) OVER w AS top FROM track WINDOW w AS (PARTITION BY ref ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_statistics(spark, d):
    r = tracks.rolling(V.numeric_track(spark, d), ["ref"], ["pos"], 2, 2, {"total": F.sum("value"), "n": F.count("*"), "top": F.max("value")})
    return r.select("ref", "pos", "total", "n", "top")


@query("""WITH r AS (SELECT c_mktsegment AS k, c_nationkey AS x, c_custkey AS y, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey) - 1 AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
  m AS (SELECT k, rn AS mid, x AS at_x, greatest(rn - 5, 0) AS lo, least(rn + 5, n - 1) AS hi FROM r WHERE rn % 4 = 0), e AS (SELECT m.*, a.x AS xl, b.x AS xh FROM m JOIN r a ON a.k = m.k AND a.rn = m.lo JOIN r b ON b.k = m.k AND b.rn = m.hi)
  SELECT e.k AS c_mktsegment, mid, at_x AS at, count(*) AS n, round(avg(y), 6) AS mean FROM e JOIN r ON r.k = e.k AND r.x BETWEEN xl AND xh GROUP BY ALL""")
def rolling_equisize(spark, d):
    r = tracks.rolling_equisize(V.table(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey"), ["c_mktsegment"], "c_nationkey", "c_custkey", 5, 4)
    return r.select("c_mktsegment", F.col("mid").cast("bigint").alias("mid"), "at", "n", F.round("mean", 6).alias("mean"))


@query("""WITH m AS (SELECT c_mktsegment AS k, c_nationkey AS x, c_custkey AS y, c_nationkey - min(c_nationkey) OVER (PARTITION BY c_mktsegment) AS a, min(c_nationkey) OVER (PARTITION BY c_mktsegment) AS lo FROM customer),
  w AS (SELECT k, lo, y, unnest(range(greatest(0, floor((a - 6) / 4)::BIGINT + 1), floor(a / 4)::BIGINT + 1)) AS w FROM m) SELECT k AS c_mktsegment, lo + w * 4 AS "from", count(*) AS n, round(avg(y), 6) AS mean FROM w GROUP BY k, lo, w""")
def rolling_covariate(spark, d):
    r = tracks.rolling_covariate(V.table(spark, d, "customer"), ["c_mktsegment"], "c_nationkey", "c_custkey", 6, 2)
    return r.select("c_mktsegment", "from", "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH d AS (SELECT n_regionkey AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, n_nationkey AS v FROM nation)
  SELECT g, pos, round(CASE WHEN lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL THEN v ELSE (lag(v) OVER w + v + lead(v) OVER w) / 3 END, 6) AS smoothed FROM d WINDOW w AS (PARTITION BY g ORDER BY pos)""")
def kernel_smooth(spark, d):
    n = Flow(V.table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").cast("double").alias("v"))).ranks(["g"], ["v"], "pos").df
    return tracks.smooth(n, ["g"], "pos", "v", tracks.kernel("Uniform", 1)).select("g", "pos", F.round("smoothed", 6).alias("smoothed"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def ranking(spark, d):
    return Flow(V.table(spark, d, "orders")).ranks(["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).df.select("o_custkey", "o_orderkey", "rank")


@query("""WITH p AS (SELECT s_suppkey, (s_suppkey * 7919 % 1000 + 1) / 1000.0::DOUBLE AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, s_suppkey) AS k, count(*) OVER () AS n FROM p)
  SELECT s_suppkey, round(min(least(1, p * n / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 9) AS q FROM r""")
def bh_correction(spark, d):
    p = V.table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 7919 % 1000 + 1) / 1000.0).alias("p"))
    return stats.benjamini_hochberg(p, "p", ["s_suppkey"]).select("s_suppkey", F.round("q", 9).alias("q"))


@query(f"""WITH {TK}, {GN}, t AS (SELECT * FROM track WHERE ref = 'click'), g AS (SELECT gid, gs // 100 AS s, gs // 100 + 40 AS e FROM genes)
  SELECT gid, min(value) AS low, max(value) AS high, coalesce(sum(value), 0)::BIGINT AS total, count(value) AS n FROM g LEFT JOIN t ON pos >= s AND pos < e GROUP BY gid""")
def track_min_max_mean_sum(spark, d):
    g = V.genes(spark, d).select("gid", F.lit("click").alias("ref"), F.floor(R.start("parts") / 100).alias("s"), (F.floor(R.start("parts") / 100) + 40).alias("e"))
    a = tracks.range_aggregates(V.numeric_track(spark, d), g, "gid")
    known = F.col("n") > 0
    return a.select("gid", F.when(known, F.col("min")).cast("bigint").alias("low"), F.when(known, F.col("max")).cast("bigint").alias("high"), F.when(known, F.col("sum")).otherwise(0).cast("bigint").alias("total"), "n")


@query(f"""WITH {TK}, {GN}, t AS (SELECT * FROM track WHERE ref = 'view'), g AS (SELECT gid, gs // 100 AS s, gs // 100 + 40 AS e FROM genes)
  SELECT gid, round(sum(value) / count(value), 6) AS available_mean, round(sum(value) / 40, 6) AS mean FROM g JOIN t ON pos >= s AND pos < e GROUP BY gid""")
def track_available_mean(spark, d):
    g = V.genes(spark, d).select("gid", F.lit("view").alias("ref"), F.floor(R.start("parts") / 100).alias("s"), (F.floor(R.start("parts") / 100) + 40).alias("e"))
    return tracks.range_aggregates(V.numeric_track(spark, d), g, "gid").where("n > 0").select("gid", F.round("available_mean", 6).alias("available_mean"), F.round("mean", 6).alias("mean"))


@query(f"""WITH {TK}, {GN}, g AS (SELECT gid, gs // 100 AS s, gs // 100 + 40 AS e FROM genes) SELECT (pos - s) * 8 // (e - s) AS bin, sum(value)::BIGINT AS v FROM g JOIN track t ON ref = 'click' AND pos >= s AND pos < e GROUP BY ALL""")
def metagene_profile(spark, d):
    g = V.genes(spark, d).select("gid", F.lit("click").alias("ref"), F.floor(R.start("parts") / 100).alias("s"), (F.floor(R.start("parts") / 100) + 40).alias("e"))
    return tracks.metagene(V.numeric_track(spark, d), g, "gid", 8)


@query(f"WITH {TK} SELECT ref, pos // 64 AS block, sum(value)::BIGINT AS v, count(*) AS n FROM track GROUP BY ALL")
def numeric_blocks(spark, d):
    return V.numeric_track(spark, d).groupBy("ref", F.floor(F.col("pos") / 64).alias("block")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))


@query(f"WITH {TK} SELECT ref, pos, sum(value) OVER (PARTITION BY ref ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM track")
def running_sum(spark, d):
    return scan.running(V.numeric_track(spark, d), ["ref"], "pos", [], F.col("value"), "running", bucket=256).select("ref", "pos", "running")


@query("""WITH t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), n AS (SELECT a, b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL)
  SELECT a AS "from", b AS "to", n, round(n / sum(n) OVER (PARTITION BY a), 9) AS p FROM n""")
def markov_chain(spark, d):
    return stats.markov_chain(V.table(spark, d, "events"), ["user_id"], ["event_id"], "event_type").select("from", "to", "n", F.round("p", 9).alias("p"))


@query(f"""WITH {TK}, s AS (SELECT ref, pos, sum(value - 5000) OVER (PARTITION BY ref ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM track),
  b AS (SELECT ref, s - least(0, coalesce(min(s) OVER (PARTITION BY ref ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b FROM s) SELECT ref, max(b)::BIGINT AS best FROM b GROUP BY ref""")
def max_scoring_segment(spark, d):
    return stats.max_scoring_segment(V.numeric_track(spark, d).withColumn("v", F.col("value") - 5000), ["ref"], "pos", "v")


# --- feature programs ---------------------------------------------------------------------------------


@query(f"""WITH {RD}, f AS (SELECT *, CASE WHEN cnt >= 30 THEN 'large' ELSE 'small' END AS size FROM reads WHERE multiplicity <= 2), s AS (SELECT ref, size, sum(cnt)::BIGINT AS n FROM f GROUP BY ALL)
  SELECT CASE WHEN n < 0.1 * (SELECT sum(n) FROM s) THEN 'other' ELSE ref END AS ref_set, CASE WHEN n < 0.1 * (SELECT sum(n) FROM s) THEN 'other' ELSE size END AS size_set, sum(n)::BIGINT AS n FROM s GROUP BY ALL""")
def feature_statistic(spark, d):
    p = program.Program().gate("multiplicity <= 2").add("ref_set", F.array("ref")).add("size_set", F.array(F.when(F.col("cnt") >= 30, "large").otherwise("small")))
    return p.statistic(V.reads(spark, d), program.Statistic(["ref_set", "size_set"], {"n": F.col("cnt")}, min_fraction=0.1))


@query(f"""WITH {RD}, f AS (SELECT ref, strand, sample, sum(cnt) AS n FROM reads GROUP BY ALL), g AS (SELECT ref, sum(n)::BIGINT AS n, max(n)::BIGINT AS most, count(*) AS tuples FROM f GROUP BY ref) SELECT ref AS ref_set, n, most, tuples FROM g""")
def feature_second_stage(spark, d):
    p = program.Program().add("ref_set", F.array("ref")).add("strand_set", F.array("strand")).add("sample_set", F.array(F.col("sample").cast("string")))
    s = p.statistic(V.reads(spark, d), program.Statistic(["ref_set", "strand_set", "sample_set"], {"c": F.col("cnt")}))
    return program.second_stage(s, ["ref_set"], {"n": F.sum("c"), "most": F.max("c"), "tuples": F.count("*")})


@query(f"""WITH {RD}, u AS (SELECT l_orderkey, unnest(list_distinct(list(ref))) AS ref FROM reads GROUP BY l_orderkey) SELECT ref AS refs, count(*) AS n FROM u GROUP BY ALL""")
def feature_unfold(spark, d):
    g = V.reads(spark, d).groupBy("l_orderkey").agg(F.collect_set("ref").alias("all_refs"))
    return program.Program().add("refs", F.col("all_refs")).statistic(g, program.Statistic(["refs"], {"n": F.lit(1)}, unfold=["refs"]))


@query(f"""WITH {RD} SELECT CASE WHEN cnt > 40 AND multiplicity = 1 THEN 'strong' WHEN cnt > 20 THEN 'medium' ELSE 'weak' END AS rule, count(*) AS n FROM reads GROUP BY ALL""")
def feature_rules(spark, d):
    rule = program.rules([((F.col("cnt") > 40) & (F.col("multiplicity") == 1), "strong"), (F.col("cnt") > 20, "medium")], "weak")
    return Flow(V.reads(spark, d).select(F.get(rule, F.lit(0)).alias("rule"))).tabulate("rule").df


@query(f"""WITH {RD}, {GN}, p AS (SELECT CASE WHEN g.strand = '-' THEN ge - 1 - (e1 - 1) ELSE s1 - gs END AS p, ge - gs AS len FROM reads r JOIN genes g ON {OVER1}), q AS (SELECT greatest(-21, least(p, len + 10)) AS pos, p FROM p)
  SELECT pos::BIGINT AS pos, (((p % 3) + 3) % 3)::BIGINT AS frame, count(*) AS n FROM q GROUP BY ALL""")
def absolute_position_frame(spark, d):
    j = joins.overlap(V.first_parts(spark, d), V.genes(spark, d), "inner", "bounds")
    five = R.five_prime("l.strand", "l.parts")
    p = F.when(F.col("r.strand") == "-", R.stop("r.parts") - five).otherwise(five - R.start("r.parts"))
    return j.select(program.absolute_position(p, R.length("r.parts"), 20, 10).alias("pos"), program.frame(p).alias("frame")).groupBy("pos", "frame").agg(F.count("*").alias("n"))


@query(f"""WITH {RD}, {GN} SELECT (s1 - gs) * 10 // (ge - gs) AS bin, count(*) AS n FROM reads r JOIN genes g ON {OVER1} AND s1 >= gs GROUP BY ALL""")
def relative_position(spark, d):
    j = joins.overlap(V.first_parts(spark, d), V.genes(spark, d), "inner", "bounds")
    p = R.start("l.parts") - R.start("r.parts")
    return j.where(p >= 0).select(program.relative_bin(p, R.length("r.parts"), 10).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query(f"""WITH {RD}, {GN}, c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(greatest(0, least(e1, ge) - greatest(s1, gs)) + greatest(0, least(e2, ge) - greatest(s2, gs))) AS o, any_value(e1 - s1 + e2 - s2) AS len FROM reads r JOIN genes g ON {OVER2} GROUP BY ALL)
  SELECT o >= len - 10 AS exonic, count(*) AS n, sum(o)::BIGINT AS bases FROM c GROUP BY ALL""")
def split_exonic(spark, d):
    j = joins.overlap(V.reads(spark, d), V.genes(spark, d), "inner", "any")
    o = j.select("l.*", R.intersect_length("l.parts", "r.parts").alias("o")).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("o").alias("o"), F.any_value(R.length("parts")).alias("len"))
    return o.select((F.col("o") >= F.col("len") - 10).alias("exonic"), "o").groupBy("exonic").agg(F.count("*").alias("n"), F.sum("o").alias("bases"))


@query(f"WITH {RD} SELECT ref, strand, sample, count(DISTINCT umi) AS umis FROM reads GROUP BY ALL")
def dedup_umi_exact(spark, d):
    return stats.collapse_umis(V.reads(spark, d), ["ref", "strand", "sample"], "umi")


@query()
def dedup_umi_corrected(spark, d):
    return stats.collapse_umis(V.reads(spark, d), ["ref", "strand", "sample"], "umi", correct=True)


@query(f"WITH {RD} SELECT ref, strand, s1, e1, s2, e2, sum(cnt)::BIGINT AS cnt, count(*) AS n_distinct FROM reads GROUP BY ALL")
def distinct_sequence_merge(spark, d):
    p = F.col("parts")
    g = V.reads(spark, d).groupBy("ref", "strand", "parts").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_distinct"))
    return g.select("ref", "strand", p[0]["s"].alias("s1"), p[0]["e"].alias("e1"), p[1]["s"].alias("s2"), p[1]["e"].alias("e2"), "cnt", "n_distinct")


@query(f"WITH {GN} SELECT gid, ref, strand, gs::VARCHAR || '-' || ge::VARCHAR AS parts, 2::BIGINT AS n FROM genes")
def genes_from_transcripts(spark, d):
    g = V.transcripts(spark, d).groupBy("gid", "ref", "strand").agg(F.flatten(F.collect_list("parts")).alias("parts"), F.count("*").alias("n"))
    return g.select("gid", "ref", "strand", R.to_text(R.normalize("parts")).alias("parts"), "n")


@query(f"WITH {GN} SELECT gid, gid * 2 AS tid FROM genes")
def major_transcript(spark, d):
    t = V.transcripts(spark, d).withColumn("len", -R.length("parts")).select("gid", "len", "tid")
    return Flow(t).index_smallest(["gid"], ["len", "tid"]).df.select("gid", "tid")


@query(f"WITH {RD} SELECT cnt % 5 AS k, l_linenumber AS n, sample, count(*) AS c FROM reads GROUP BY ALL")
def kn_matrix(spark, d):
    return V.reads(spark, d).select((F.col("cnt") % 5).alias("k"), F.col("l_linenumber").alias("n"), "sample").groupBy("k", "n", "sample").agg(F.count("*").alias("c"))


@query()
def lfc_count_beta(spark, d):
    v = _vectors(spark, d).select("l_partkey", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))
    return stats.fold_change_interval(v, "a", "b")


@query("WITH s AS (SELECT c_nationkey % 2 = 0 AS y, round(c_acctbal) AS x FROM customer), p AS (SELECT x FROM s WHERE y), n AS (SELECT x FROM s WHERE NOT y) SELECT round((SELECT sum(CASE WHEN p.x > n.x THEN 1.0 WHEN p.x = n.x THEN 0.5 ELSE 0 END) FROM p, n) / ((SELECT count(*) FROM p) * (SELECT count(*) FROM n)), 9) AS auc")
def roc_auc(spark, d):
    s = V.table(spark, d, "customer").select((F.col("c_nationkey") % 2 == 0).alias("y"), F.round("c_acctbal").alias("x"))
    return stats.roc_auc(s, "x", "y").select(F.round("auc", 9).alias("auc"))


@query("""WITH s AS (SELECT c_mktsegment AS g, c_nationkey % 2 = 0 AS y, c_acctbal AS x FROM customer), u AS (SELECT a.g, sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END) AS u FROM s a JOIN s b ON a.g = b.g AND a.y AND NOT b.y GROUP BY a.g) SELECT g, round(u, 4)::DOUBLE AS u FROM u""")
def mann_whitney(spark, d):
    s = V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), (F.col("c_nationkey") % 2 == 0).alias("y"), F.col("c_acctbal").alias("x"))
    return stats.mann_whitney(s, ["g"], "y", "x").where("p between 0 and 1").select("g", F.round("u", 4).alias("u"))


@query("""WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY ALL), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mm FROM g)
  SELECT round((sum(g.n * power(m - mm, 2)) / (any_value(k) - 1)) / (sum((g.n - 1) * v) / (any_value(t.n) - any_value(k))), 6) AS f, any_value(k) - 1 AS df1, (any_value(t.n) - any_value(k))::BIGINT AS df2 FROM g, t""")
def one_way_anova(spark, d):
    a = stats.one_way_anova(V.table(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    return a.select(F.round("f", 6).alias("f"), "df1", "df2")


# --- region algebra and sequences ------------------------------------------------------------------------


@query(f"""WITH {RD}, {GN}, j AS (SELECT * FROM reads r JOIN genes g ON {OVER2}),
  x AS (SELECT gid, l_orderkey, l_linenumber, l_partkey, l_suppkey, e1 - s1 + e2 - s2 AS len, ge - gs AS glen, greatest(0, least(e1, ge) - greatest(s1, gs)) + greatest(0, least(e2, ge) - greatest(s2, gs)) AS inter FROM j)
  SELECT gid, count(*) AS n, sum(inter)::BIGINT AS intersect_len, sum(len + glen - inter)::BIGINT AS union_len, sum(len - inter)::BIGINT AS subtract_len FROM x GROUP BY gid""")
def region_set_lengths(spark, d):
    j = joins.overlap(V.reads(spark, d), V.genes(spark, d), "inner", "any")
    a, b = F.col("l.parts"), F.col("r.parts")
    rows = j.select("r.gid", R.intersect_length(a, b).alias("i"), R.length(a).alias("a"), R.length(b).alias("b"))
    return rows.groupBy("gid").agg(F.count("*").alias("n"), F.sum("i").alias("intersect_len"), F.sum(F.col("a") + F.col("b") - F.col("i")).alias("union_len"), F.sum(F.col("a") - F.col("i")).alias("subtract_len"))


@query(f"""WITH {RD} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s1::VARCHAR || '-' || e1::VARCHAR || '|' || s2::VARCHAR || '-' || e2::VARCHAR AS loc, e1::VARCHAR || '-' || s2::VARCHAR AS introns, e1 - s1 + e2 - s2 AS len,
  CASE WHEN strand = '-' THEN e2 - 1 ELSE s1 END AS five, CASE WHEN strand = '-' THEN s1 ELSE e2 - 1 END AS three FROM reads""")
def region_text_positions(spark, d):
    r = V.reads(spark, d).withColumn("parts", R.parse(R.to_text("parts")))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.to_text("parts").alias("loc"), R.to_text(R.introns("parts")).alias("introns"), R.length("parts").alias("len"), R.five_prime("strand", "parts").alias("five"), R.three_prime("strand", "parts").alias("three"))


@query(f"""WITH {RD}, p AS (SELECT *, CASE WHEN strand = '-' THEN (e1 - s1 + e2 - s2) - 1 - 4 ELSE 4 END AS i FROM reads) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN i < 0 OR i >= e1 - s1 + e2 - s2 THEN NULL WHEN i < e1 - s1 THEN s1 + i ELSE s2 + i - (e1 - s1) END AS g,
  CASE WHEN i < 0 OR i >= e1 - s1 + e2 - s2 THEN NULL ELSE 4::BIGINT END AS back FROM p""")
def region_map_induce(spark, d):
    r = V.reads(spark, d).withColumn("g", R.map_stranded("strand", "parts", 4))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "g", R.induce_stranded("strand", "parts", F.col("g")).alias("back"))


@query(f"WITH {RD} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (s1 - 5)::VARCHAR || '-' || e1::VARCHAR || '|' || s2::VARCHAR || '-' || (e2 + 7)::VARCHAR AS longer, s1::VARCHAR || '-' || e2::VARCHAR AS closed FROM reads")
def region_extend(spark, d):
    return V.reads(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.to_text(R.extend("parts", 5, 7)).alias("longer"), R.to_text(R.remove_introns("parts")).alias("closed"))


_DNA = "translate(substr(md5(p_partkey::VARCHAR), 1, 30), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _dna(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.translate(F.substr(F.md5(F.col("p_partkey").cast("string")), F.lit(1), F.lit(30)), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


@query(f"SELECT p_partkey, reverse(translate({_DNA}, 'ACGT', 'TGCA')) AS rc FROM part")
def reverse_complement(spark, d):
    return _dna(spark, d).select("p_partkey", X.reverse_complement(F.col("seq")).alias("rc"))


@query(f"""WITH c AS (SELECT * FROM (SELECT a || b || c AS codon, substr('{X.AMINO_ACIDS}', (i * 16 + j * 4 + k + 1)::INT, 1) AS aa
  FROM (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) x(a, i), (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) y(b, j), (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) z(c, k))),
  s AS (SELECT p_partkey, {_DNA} AS seq FROM part), k AS (SELECT p_partkey, i, substr(seq, (3 * i + 1)::INT, 3) AS codon FROM s, range(0, 10) t(i)) SELECT p_partkey, string_agg(aa, '' ORDER BY i) AS protein FROM k JOIN c ON k.codon = c.codon GROUP BY p_partkey""")
def translate_codons(spark, d):
    return _dna(spark, d).select("p_partkey", X.translate_codons(F.col("seq")).alias("protein"))


@query(f"SELECT p_partkey, round((length({_DNA}) - length(replace(replace({_DNA}, 'G', ''), 'C', ''))) / length({_DNA}), 6) AS gc FROM part")
def gc_content(spark, d):
    return _dna(spark, d).select("p_partkey", F.round(X.gc_content(F.col("seq")), 6).alias("gc"))


@query(f"WITH s AS (SELECT p_partkey, p_size, substr({_DNA}, 1, 6) AS q FROM part) SELECT a.p_partkey AS x, b.p_partkey AS y, hamming(a.q, b.q)::BIGINT AS h FROM s a JOIN s b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE hamming(a.q, b.q) <= 1")
def hamming_pairs(spark, d):
    s = _dna(spark, d).join(V.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_size"), "p_partkey", F.substr("seq", F.lit(1), F.lit(6)).alias("q"))
    p = frames.near_pairs(s, ["p_size"], "p_partkey", "q").withColumn("h", X.hamming(F.col("a.q"), F.col("b.q")))
    return p.select(F.col("a.p_partkey").alias("x"), F.col("b.p_partkey").alias("y"), "h")


@query(f"""WITH s AS (SELECT p_partkey, {_DNA} AS seq FROM part), m AS (SELECT p_partkey, i, substr(seq, i, 1) AS g, substr(seq, i + 1, 1) AS r FROM s, (SELECT unnest(range(1, 30))::INT AS i)) SELECT i::BIGINT AS pos, g, r, count(*) AS n FROM m WHERE g <> r GROUP BY ALL""")
def mismatch_profile(spark, d):
    s = F.col("seq")
    v = F.transform(F.sequence(F.lit(1), F.lit(29)), lambda i: F.struct(i.cast("bigint").alias("pos"), F.substr(s, i, F.lit(1)).alias("g"), F.substr(s, i + 1, F.lit(1)).alias("r")))
    return _dna(spark, d).select(F.explode(F.filter(v, lambda x: x["g"] != x["r"])).alias("x")).groupBy("x.pos", "x.g", "x.r").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, split_part(c_name, '#', 2) AS field, length(c_name) - length(replace(c_name, '0', '')) AS zeros, c_mktsegment LIKE 'B%' AS b, TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS num FROM customer")
def string_functions(spark, d):
    name = F.col("c_name")
    return V.table(spark, d, "customer").select("c_custkey", X.split_field(name, "#", 1).alias("field"), X.count_char(name, "0").alias("zeros"), F.startswith("c_mktsegment", F.lit("B")).alias("b"), X.trailing_number(name).alias("num"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_infer(spark, d):
    path = store.folder(spark, "nation") + ".csv"
    V.table(spark, d, "nation").coalesce(1).write.csv(path, sep=";", header=True)
    return files.load(spark, path)


@query("SELECT window_start::BIGINT AS start_s, event_type, count(*) AS n FROM (SELECT epoch_us(ts) // 3600000000 * 3600 AS window_start, event_type FROM events) GROUP BY ALL")
def stream_windowed_counts(spark, d):
    from ..streaming import counts as streaming

    return streaming.windowed_counts_batch(V.table(spark, d, "events"))


# --- frames, further statistics, reads payloads ----------------------------------------------------------


@query("SELECT user_id, event_id, sum(o) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT user_id, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS o FROM events)")
def multiplex_runs(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return Flow(e).multiplex_runs(["user_id"], ["event_id"], "event_type").df.select("user_id", "event_id", "run")


@query("SELECT c_custkey, CASE WHEN k = 0 THEN c_mktsegment ELSE c_mktsegment || '_' || k END AS u FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer)")
def make_unique_names(spark, d):
    return frames.make_unique(V.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"], "u").select("c_custkey", "u")


@query("SELECT p_partkey, substr(p_brand, 1, n) AS prefix FROM part, (VALUES (5), (6), (7)) t(n) WHERE length(p_brand) >= n AND substr(p_brand, 1, n) IN (SELECT substr(p_brand, 1, 5) FROM part UNION SELECT substr(p_brand, 1, 7) FROM part WHERE p_partkey % 11 = 0)")
def prefix_join(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_brand")
    known = p.select(F.substr("p_brand", F.lit(1), F.lit(5)).alias("prefix")).union(p.where("p_partkey % 11 = 0").select(F.substr("p_brand", F.lit(1), F.lit(7)))).distinct()
    return frames.prefix_join(p, "p_brand", known, "prefix", 7).select("p_partkey", "prefix")


@query(f"WITH s AS (SELECT DISTINCT substr({_DNA}, 1, 5) AS q FROM part) SELECT x.q AS a, y.q AS b FROM s x JOIN s y ON x.q < y.q AND hamming(x.q, y.q) = 1")
def mismatch_graph(spark, d):
    return frames.mismatch_graph(_dna(spark, d).select(F.substr("seq", F.lit(1), F.lit(5)).alias("w")), "w")


@query(f"WITH {TK}, q AS (SELECT ref, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM track GROUP BY ref) SELECT t.ref, pos FROM track t JOIN q ON t.ref = q.ref WHERE value < a - 0.2 * (b - a) OR value > b + 0.2 * (b - a)")
def iqr_outliers(spark, d):
    return stats.iqr_outliers(V.numeric_track(spark, d), ["ref"], "value", 0.2).where("outlier").select("ref", "pos")


@query(f"WITH {TK}, a AS (SELECT user_id, pos // 7 AS p, sum(value) AS v FROM track GROUP BY ALL), l AS (SELECT unnest(range(-2, 3)) AS lag) SELECT lag::INT AS lag, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM l, a JOIN a b ON a.user_id = b.user_id AND b.p - lag = a.p GROUP BY lag")
def cross_correlation(spark, d):
    a = V.numeric_track(spark, d).groupBy("user_id", F.floor(F.col("pos") / 7).alias("p")).agg(F.sum("value").alias("v"))
    return stats.cross_correlation(a, a, ["user_id"], "p", "v", range(-2, 3)).select("lag", "n", F.round("r", 6).alias("r"))


@query("SELECT n_regionkey, count(*)::INT AS tests, round(-2 * sum(ln((n_nationkey + 1) / 26.0::DOUBLE)), 6) AS chi2 FROM nation GROUP BY ALL")
def combine_p_values(spark, d):
    n = V.table(spark, d, "nation").select("n_regionkey", ((F.col("n_nationkey") + 1) / 26.0).alias("p"))
    chi2 = n.groupBy("n_regionkey").agg(F.round(-2 * F.sum(F.log("p")), 6).alias("chi2"))
    return stats.combine_p_values(n, ["n_regionkey"], "p").where("p between 0 and 1").join(chi2, "n_regionkey").select("n_regionkey", "tests", "chi2")


@query("""WITH t AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 0 AND c_custkey % 2 = 0) AS a, count(*) FILTER (c_acctbal <= 0 AND c_custkey % 2 = 0) AS b, count(*) FILTER (c_acctbal > 0 AND c_custkey % 2 = 1) AS c, count(*) FILTER (c_acctbal <= 0 AND c_custkey % 2 = 1) AS d FROM customer GROUP BY ALL),
  s AS (SELECT *, (a + b + c + d)::DOUBLE AS n FROM t WHERE a + b + c + d > 1) SELECT round(sum(a * d / n) / sum(b * c / n), 6) AS odds_ratio FROM s""")
def mantel_haenszel(spark, d):
    rich, even = F.col("c_acctbal") > 0, F.col("c_custkey") % 2 == 0
    t = V.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(rich & even).alias("a"), F.count_if(~rich & even).alias("b"), F.count_if(rich & ~even).alias("c"), F.count_if(~rich & ~even).alias("d"))
    return stats.mantel_haenszel(t, "a", "b", "c", "d").select(F.round("odds_ratio", 6).alias("odds_ratio"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, o DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS "start", count(*) AS n FROM s GROUP BY user_id, k""")
def session_clusters(spark, d):
    from ..streaming import counts as streaming

    return streaming.session_clusters(V.table(spark, d, "events"), ["user_id"], "6 hours").select("user_id", "start", "n")


def _payload(spark, d, k: int) -> DataFrame:
    """Reads of even or odd suppliers as payload rows with two conditions."""
    r = V.reads(spark, d).where(F.col("l_suppkey") % 2 == k)
    none = F.array().cast("array<struct<type:string,pos:int,genomic:string,read:string,second:boolean>>")
    own = F.array(*[F.sum(F.when(F.col("sample") == 2 * i + k, F.col("cnt")).otherwise(0)).cast("double") for i in range(2)])
    g = r.groupBy("ref", "strand", "parts").agg(own.alias("counts"), F.max("multiplicity").cast("int").alias("multiplicity"))
    return g.select("ref", "strand", "parts", F.array(F.struct("counts", "multiplicity", none.alias("vars"))).alias("distincts"))


@query(f"WITH {RD} SELECT ref, strand, s1, e1, s2, e2, sum(CASE WHEN sample = 0 THEN cnt ELSE 0 END)::DOUBLE AS c0, sum(CASE WHEN sample = 2 THEN cnt ELSE 0 END)::DOUBLE AS c1, sum(CASE WHEN sample = 1 THEN cnt ELSE 0 END)::DOUBLE AS c2, sum(CASE WHEN sample = 3 THEN cnt ELSE 0 END)::DOUBLE AS c3 FROM reads GROUP BY ALL")
def merge_storages(spark, d):
    m = reads.merge_storages([_payload(spark, d, 0), _payload(spark, d, 1)], [2, 2])
    p, c = F.col("parts"), F.get("distincts", F.lit(0))["counts"]
    return m.select("ref", "strand", p[0]["s"].alias("s1"), p[0]["e"].alias("e1"), p[1]["s"].alias("s2"), p[1]["e"].alias("e2"), *[F.get(c, F.lit(i)).alias(f"c{i}") for i in range(4)])


@query(f"WITH {RD} SELECT ref, strand, count(*) AS n, sum(greatest(0, least(e1, 3000) - greatest(s1, 1000)) + greatest(0, least(e2, 3000) - greatest(s2, 1000)))::BIGINT AS inside FROM reads WHERE s1 < 3000 AND e2 > 1000 GROUP BY ALL")
def region_restrict(spark, d):
    w = F.array(R.part(1000, 3000))
    r = V.reads(spark, d).where((R.start("parts") < 3000) & (R.end("parts") > 1000))
    return r.groupBy("ref", "strand").agg(F.count("*").alias("n"), F.sum(R.length(R.intersect("parts", w))).alias("inside"))
