"""The operators over the supplied tables, each with the SQL that an independent engine runs over the same tables.

A part stands for a phenotype, a line item for a tested variant, a nation for a chromosome, l_discount for a p-value,
l_extendedprice for an effect and l_quantity for its standard error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.functions import statistics as S
from genomark.operators import intervals as I
from genomark.session import table as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem")


@query("""WITH x AS (SELECT DISTINCT l_suppkey, l_orderkey AS k FROM lineitem), y AS (SELECT *, k - row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS g FROM x)
SELECT l_suppkey, min(k) AS run_start, max(k) AS run_end, count(*) AS n FROM y GROUP BY l_suppkey, g""")
def islands(spark, d):
    return I.islands(lines(spark, d), ["l_suppkey"], "l_orderkey")


ORDER_SPANS = "SELECT o_orderkey, o_custkey, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS day0, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT + o_orderkey % 60 AS day1 FROM orders"


def order_spans(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", day.alias("day0"), (day + F.col("o_orderkey") % 60).alias("day1"))


@query(f"""WITH x AS ({ORDER_SPANS}), y AS (SELECT *, max(day1) OVER (PARTITION BY o_custkey ORDER BY day0, day1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
z AS (SELECT *, sum(CASE WHEN before IS NULL OR day0 > before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY day0, day1 ROWS UNBOUNDED PRECEDING) AS g FROM y)
SELECT o_custkey, min(day0) AS day0, max(day1) AS day1, count(*) AS n FROM z GROUP BY o_custkey, g""")
def interval_union(spark, d):
    return I.interval_union(order_spans(spark, d), ["o_custkey"], "day0", "day1")


@query("""WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, (l_returnflag = 'R')::BIGINT AS hit FROM lineitem),
y AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS row FROM x),
z AS (SELECT *, lag(row - rank) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS was FROM y WHERE hit = 1)
SELECT l_suppkey, l_orderkey, l_linenumber, rank, row FROM z WHERE was IS NULL OR was <> row - rank""")
def rank_prefix(spark, d):
    from genomark.operators.overlap import breakpoints

    x = lines(spark, d).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_returnflag") == "R").alias("hit"))
    return breakpoints(x, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "hit").select("l_suppkey", "l_orderkey", "l_linenumber", "rank", "row")


@query("""WITH x AS (SELECT *, floor(o_totalprice / 50000)::BIGINT AS k, row_number() OVER (PARTITION BY o_orderpriority, floor(o_totalprice / 50000) ORDER BY o_totalprice, o_orderkey) AS rn FROM orders)
SELECT o_orderpriority, k * 50000 AS bin_start, (k + 1) * 50000 AS bin_end, max(o_orderkey) FILTER (WHERE rn = 1) AS lead_o_orderkey, max(o_custkey) FILTER (WHERE rn = 1) AS lead_o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(*) AS n_rows FROM x GROUP BY o_orderpriority, k""")
def tumbling_bins(spark, d):
    return I.tumbling_bins(t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 50000, ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_custkey"], {"n_done": F.col("o_orderstatus") == "F"})


MASKS = "SELECT l_partkey, bit_or(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END)::BIGINT AS mask FROM lineitem WHERE l_discount > 0.04 GROUP BY l_partkey"


def catalogs(spark, d):
    x = lines(spark, d).where("l_discount > 0.04")
    return {f: x.where(F.col("l_returnflag") == f).select("l_partkey") for f in ("A", "N", "R")}


@query(f"SELECT l_partkey, mask, bit_count(mask)::INT AS n_catalogs FROM ({MASKS})")
def overlap_mask(spark, d):
    from genomark.operators.overlap import site_masks

    return site_masks(catalogs(spark, d), ["l_partkey"]).select("l_partkey", "mask", F.bit_count("mask").alias("n_catalogs"))


@query(f"""WITH m AS ({MASKS}), p AS (SELECT * FROM (VALUES ('A', 'N', 1, 2), ('A', 'R', 1, 4), ('N', 'R', 2, 4)) v(a, b, x, y))
SELECT a, b, count(*) FILTER (WHERE mask & x <> 0 AND mask & y <> 0) AS shared, count(*) FILTER (WHERE mask & x <> 0 AND mask & y = 0) AS a_only, count(*) FILTER (WHERE mask & x = 0 AND mask & y <> 0) AS b_only,
round(count(*) FILTER (WHERE mask & x <> 0 AND mask & y <> 0) / nullif(count(*) FILTER (WHERE mask & x <> 0 OR mask & y <> 0), 0), 6) AS jaccard FROM m, p GROUP BY a, b""")
def overlap_pairs(spark, d):
    from genomark.operators.overlap import pair_counts, site_masks

    return pair_counts(site_masks(catalogs(spark, d), ["l_partkey"]), ["A", "N", "R"])


@query("""SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND b.p_partkey - a.p_partkey BETWEEN 1 AND 50""")
def band_self_join(spark, d):
    p = t(spark, d, "part")
    a, b = (p.select("p_brand", "p_size", F.col("p_partkey").alias(f"{k}_key")) for k in "ab")
    return I.band_join(a, b, ["p_brand", "p_size"], "a_key", "b_key", 1, 50).select("a_key", "b_key")


@query("""SELECT s_suppkey, c_custkey, distance FROM (SELECT s_suppkey, c_custkey, round(abs(c_acctbal - s_acctbal), 6) AS distance, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c_acctbal - s_acctbal), c_custkey) AS rn
FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(c_acctbal - s_acctbal) <= 200) WHERE rn = 1""")
def nearest(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey", "s_acctbal")
    b = t(spark, d, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", "c_acctbal")
    return I.nearest(a, b, ["n"], "s_acctbal", "c_acctbal", 200, ["n", "s_suppkey", "s_acctbal"], ["c_custkey"]).select("s_suppkey", "c_custkey", F.round("distance", 6).alias("distance"))


@query(f"""WITH x AS ({ORDER_SPANS}) SELECT a.o_orderkey, count(*) AS n_open FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.day0 BETWEEN b.day0 AND b.day1 GROUP BY a.o_orderkey""")
def point_in_interval(spark, d):
    x = order_spans(spark, d)
    points = x.select("o_custkey", "o_orderkey", F.col("day0").alias("at"))
    return I.point_in_interval(points, x.select("o_custkey", "day0", "day1"), ["o_custkey"], "at", ("day0", "day1"), 64).groupBy("o_orderkey").agg(F.count("*").alias("n_open"))


@query(f"""WITH x AS ({ORDER_SPANS}) SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.day1 >= b.day0 AND a.day0 <= b.day1 AND a.o_orderkey < b.o_orderkey""")
def interval_overlap(spark, d):
    x = order_spans(spark, d)
    a, b = (x.select("o_custkey", F.col("o_orderkey").alias(f"{k}_key"), F.col("day0").alias(f"{k}0"), F.col("day1").alias(f"{k}1")) for k in "ab")
    return I.overlap_join(a, b, ["o_custkey"], ("a0", "a1"), ("b0", "b1"), 64).where("a_key < b_key").select("a_key", "b_key")


@query("""SELECT e.event_id, max(o.o_orderkey) AS last_order FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderkey <= e.event_id GROUP BY e.event_id""")
def asof_lookup(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("user_id").alias("who"))
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("last_order"))
    return I.last_before(e, o, ["who"], "event_id", "at", "last_order").select("event_id", "last_order")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'as_is' WHEN l_returnflag = 'R' THEN 'swapped' ELSE 'dropped' END AS kind,
CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS beta, round(CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN 1 - l_discount ELSE l_discount END, 6) AS af FROM lineitem""")
def orientation(spark, d):
    ref = F.when(F.col("l_linestatus") == "O", "x").otherwise("R")
    kind = X.orientation(ref, F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", "x").otherwise("y"))
    x = lines(spark, d).withColumn("kind", kind)
    o = X.oriented(F.col("kind"), F.lit("e"), F.lit("o"), F.col("l_extendedprice"), F.col("l_discount"))
    return x.select("l_orderkey", "l_linenumber", "kind", o["beta"].alias("beta"), F.round(o["af"], 6).alias("af"))


@query("""SELECT p_partkey, g.n IS NOT NULL AND coalesce(g.p < 0.01, false) AS significant, CASE WHEN g.n IS NOT NULL THEN g.p END AS sig_value, NULL::BOOLEAN AS unassessed
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, min(l_discount) AS p FROM lineitem WHERE l_tax > 0.03 GROUP BY 1) g ON l_partkey = p_partkey""")
def significance_rule(spark, d):
    g = lines(spark, d).where("l_tax > 0.03").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_discount").alias("p_perm"))
    flag, value = X.significance({"column": "p_perm", "op": "<", "threshold": 0.01}, ["p_perm"], F.col("n").isNotNull())
    return t(spark, d, "part").join(g, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", flag.alias("significant"), value.alias("sig_value"), X.significance(None, [], F.lit(True))[0].alias("unassessed"))


@query("""WITH x AS (SELECT p_brand, p_partkey, p_type, CASE WHEN p_brand LIKE '%1' THEN NULL ELSE p_retailprice > 1300 END AS sig FROM part)
SELECT p_brand, count(*) AS phenotypes, CASE WHEN bool_or(sig IS NOT NULL) THEN count(*) FILTER (WHERE sig) END AS significant, CASE WHEN bool_or(sig IS NOT NULL) THEN count(DISTINCT p_type) FILTER (WHERE sig) END AS significant_genes FROM x GROUP BY p_brand""")
def type_counts(spark, d):
    from genomark.operators.results import type_counts as counts

    x = t(spark, d, "part").select("p_brand", F.lit("chr1").alias("chr"), F.lit(1).alias("n_rows"), F.col("p_type").alias("gene_id"), F.when(F.col("p_brand").endswith("1"), None).otherwise(F.col("p_retailprice") > 1300).alias("significant"))
    return counts(x, ["p_brand"]).select("p_brand", "phenotypes", "significant", "significant_genes")


@query("""WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS b, max(abs(l_extendedprice)) OVER (PARTITION BY l_suppkey) AS m, l_discount AS p, max(-log10(nullif(l_discount, 0))) OVER (PARTITION BY l_suppkey) AS nm FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(b / m * 32766, 0)::INT AS beta_code, CASE WHEN p = 0 THEN 65534 ELSE round_even(-log10(nullif(p, 0)) / nm * 65533, 0)::INT END AS nlp_code, round(round_even(b / m * 32766, 0) * m / 32766, 4) AS beta FROM x""")
def quantize_roundtrip(spark, d):
    over = W.partitionBy("l_suppkey")
    x = lines(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", F.max(F.abs("l_extendedprice")).over(over).alias("m"), F.max(X.neglog10(F.col("l_discount"))).over(over).alias("nm"))
    y = x.select("*", X.beta_code(F.col("l_extendedprice"), F.col("m")).alias("beta_code"), X.nlp_code(F.col("l_discount"), F.col("nm")).alias("nlp_code"))
    return y.select("l_orderkey", "l_linenumber", "beta_code", "nlp_code", F.round(X.beta_value(F.col("beta_code"), F.col("m")), 4).alias("beta"))


@query("""WITH x AS (SELECT l_suppkey, l_returnflag, l_extendedprice AS b, max(abs(l_extendedprice)) OVER (PARTITION BY l_suppkey) AS m FROM lineitem),
y AS (SELECT l_suppkey, l_returnflag, max(abs(round_even(b / m * 32766, 0) * m / 32766 - b)) AS e, max(m / 65532) AS lim, count(*) AS n FROM x GROUP BY ALL)
SELECT l_returnflag, round(max(lim), 6) AS limit_beta, round(max(e), 6) AS measured_beta, sum(n)::BIGINT AS n_rows, max(e) > max(lim) * (1 + 1e-9) AS breach FROM y GROUP BY l_returnflag""")
def precision_fold(spark, d):
    x = lines(spark, d).select("l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("b"), F.max(F.abs("l_extendedprice")).over(W.partitionBy("l_suppkey")).alias("m"))
    e = F.abs(X.beta_value(X.beta_code(F.col("b"), F.col("m")), F.col("m")) - F.col("b"))
    y = x.groupBy("l_suppkey", "l_returnflag").agg(F.max(e).alias("e"), F.max(F.col("m") / 65532).alias("lim"), F.count("*").alias("n"))
    return y.groupBy("l_returnflag").agg(F.round(F.max("lim"), 6).alias("limit_beta"), F.round(F.max("e"), 6).alias("measured_beta"), F.sum("n").alias("n_rows"), (F.max("e") > F.max("lim") * (1 + 1e-9)).alias("breach"))


@query("""SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag, year(l_shipdate) ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) <= 40""")
def budget_sample(spark, d):
    from genomark.sources.readers import budget_sample as sample

    x = lines(spark, d).select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"))
    return sample(x, ["l_returnflag", "year"], 40, ["l_orderkey", "l_linenumber"], 7).drop("year")


@query("""WITH q AS (SELECT l_partkey, l_suppkey % 50 AS v, l_discount * 4 - 0.2 AS b, 0.02 + l_tax AS s FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey % 50 ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1),
g AS (SELECT l_partkey, l_suppkey % 50 AS v, l_tax * 6 - 0.2 AS b, 0.03 + l_discount AS s FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey % 50 ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_extendedprice) = 1),
x AS (SELECT l_partkey, v, 0.5 * (ln(1 - 0.0225 / (0.0225 + q.s * q.s)) + 0.0225 / (0.0225 + q.s * q.s) * (q.b / q.s) ^ 2) AS l1, 0.5 * (ln(1 - 0.04 / (0.04 + g.s * g.s)) + 0.04 / (0.04 + g.s * g.s) * (g.b / g.s) ^ 2) AS l2 FROM q JOIN g USING (l_partkey, v)),
m AS (SELECT l_partkey, max(l1) AS m1, max(l2) AS m2, max(l1 + l2) AS m12 FROM x GROUP BY 1),
s AS (SELECT l_partkey, count(*) AS n_variants, any_value(m1) + ln(sum(exp(l1 - m1))) AS s1, any_value(m2) + ln(sum(exp(l2 - m2))) AS s2, any_value(m12) + ln(sum(exp(l1 + l2 - m12))) AS s12 FROM x JOIN m USING (l_partkey) GROUP BY 1),
h AS (SELECT *, 0.0 AS h0, ln(1e-4) + s1 AS h1, ln(1e-4) + s2 AS h2, CASE WHEN n_variants > 1 THEN 2 * ln(1e-4) + s1 + s2 + ln(greatest(1 - exp(s12 - s1 - s2), 1e-300)) ELSE -1e300 END AS h3, ln(1e-5) + s12 AS h4 FROM s),
z AS (SELECT *, greatest(h0, h1, h2, h3, h4) AS top FROM h)
SELECT l_partkey, n_variants, round(exp(h0 - top) / (exp(h0 - top) + exp(h1 - top) + exp(h2 - top) + exp(h3 - top) + exp(h4 - top)), 6) AS pp0, round(exp(h3 - top) / (exp(h0 - top) + exp(h1 - top) + exp(h2 - top) + exp(h3 - top) + exp(h4 - top)), 6) AS pp3,
round(exp(h4 - top) / (exp(h0 - top) + exp(h1 - top) + exp(h2 - top) + exp(h3 - top) + exp(h4 - top)), 6) AS pp4 FROM z""")
def coloc_abf(spark, d):
    li = lines(spark, d).withColumn("v", F.col("l_suppkey") % 50)
    one = W.partitionBy("l_partkey", "v").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    two = W.partitionBy("l_partkey", "v").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_extendedprice")
    q = li.withColumn("rn", F.row_number().over(one)).where("rn = 1").select("l_partkey", "v", (F.col("l_discount") * 4 - 0.2).alias("b1"), (F.col("l_tax") + 0.02).alias("s1"))
    g = li.withColumn("rn", F.row_number().over(two)).where("rn = 1").select("l_partkey", "v", (F.col("l_tax") * 6 - 0.2).alias("b2"), (F.col("l_discount") + 0.03).alias("s2"))
    c = S.coloc(q.join(g, ["l_partkey", "v"]), ["l_partkey"], ["v"], "b1", "s1", "b2", "s2")
    return c.select("l_partkey", "n_variants", *(F.round(f"pp{k}", 6).alias(f"pp{k}") for k in (0, 3, 4)))


@query()
def top_loci(spark, d):
    from genomark.operators.results import top_loci as top

    x = lines(spark, d).groupBy("l_partkey").agg(F.max("l_extendedprice").alias("lead_nlp"), F.min_by("l_orderkey", F.struct("l_discount", "l_orderkey", "l_linenumber")).alias("lead_pos"))
    x = x.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("phenotype_id"), F.col("p_brand").alias("chr"), "lead_pos", "lead_nlp", F.col("p_type").alias("gene_id"))
    return top(x, apart=1000)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'b%' ORDER BY p_size > 20 DESC, length(p_name), p_name, p_partkey LIMIT 12")
def prefix_search(spark, d):
    return t(spark, d, "part").where(X.gene_search("B", "p_name", "p_name")).orderBy((F.col("p_size") > 20).desc(), F.length("p_name"), "p_name", "p_partkey").limit(12).select("p_partkey", "p_name")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props::JSON) = 'OBJECT' AS is_object, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extra(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT"), F.lit(False)).alias("is_object"), F.get_json_object("props", "$.missing").alias("missing"))


@query("""SELECT vec_id, len(embedding)::INT AS n, len(list_filter(embedding, lambda x: x > 0))::INT AS n_positive, round(list_transform(embedding[1:2], lambda x: x * 2)[1]::DOUBLE, 5) AS doubled FROM embeddings""")
def array_ops(spark, d):
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", F.size(e).alias("n"), F.size(F.filter(e, lambda x: x > 0)).alias("n_positive"), F.round(F.get(F.transform(F.slice(e, 1, 2), lambda x: x * 2), F.lit(0)).cast("double"), 5).alias("doubled"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digest(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query()
def identity_digest(spark, d):
    return t(spark, d, "documents").select("doc_id", X.digest24(F.col("text")).alias("digest"))


@query()
def dof_fit(spark, d):
    """p from |t| of the lines, at 40 degrees of freedom; the fit finds them again."""
    x = lines(spark, d).select(((F.col("l_extendedprice") % 97) / 97 * 6 - 3).alias("beta"), F.lit(1.0).alias("se")).where("beta != 0")
    x = x.withColumn("pvalue", F.pow(F.lit(10.0), -S.neglog10_of_t(F.col("beta"), F.lit(40.0))))
    found = S.fit_dof(x, n_samples=60)
    return spark.createDataFrame([(found["dof"], found["usable"], found["identified"])], "dof int, usable boolean, identified boolean")


@query("""SELECT 'lineitem key unique' AS rule, (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS bad FROM lineitem
UNION ALL SELECT 'lineitem orders exist', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'discount in [0,1]', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 1)
UNION ALL SELECT 'props is an object', count(*) FROM events WHERE json_type(props::JSON) <> 'OBJECT'
UNION ALL SELECT 'customers have a nation', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)""")
def contract_checks(spark, d):
    from genomark.operators import checks as C

    li = lines(spark, d)
    return C.report(
        C.unique(li, ["l_orderkey", "l_linenumber"], "lineitem key unique"),
        C.orphans(li, t(spark, d, "orders"), {"l_orderkey": "o_orderkey"}, "lineitem orders exist"),
        C.violations(li, F.col("l_discount").between(0, 1), "discount in [0,1]"),
        C.violations(t(spark, d, "events"), F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT"), "props is an object"),
        C.orphans(t(spark, d, "customer"), t(spark, d, "nation"), {"c_nationkey": "n_nationkey"}, "customers have a nation"),
    )


@query("""SELECT l_partkey, l_linestatus, count(*) AS n, arg_max(l_orderkey * 10 + l_linenumber, (l_discount, -l_orderkey, -l_linenumber)) AS top, round(sum(l_discount), 4) AS sum_pip, min(l_orderkey) AS first_pos, max(l_orderkey) AS last_pos FROM lineitem GROUP BY ALL""")
def credible_set_summary(spark, d):
    from genomark.operators.results import credible_set_summary as summary

    x = lines(spark, d).select("l_partkey", "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("v"), F.col("l_orderkey").alias("pos"), F.col("l_discount").alias("pip"), "l_linenumber")
    return summary(x, ["l_partkey", "l_linestatus"], "v", "pip", "pos", ["pos", "l_linenumber"]).select("l_partkey", "l_linestatus", "n", F.col("top"), F.round("sum_pip", 4).alias("sum_pip"), "first_pos", "last_pos")


@query("""WITH x AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 3600 THEN 1 ELSE 0 END AS far FROM events)
SELECT event_id, sum(far) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS cluster FROM x""")
def gap_clusters(spark, d):
    x = t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return I.clusters(x, ["user_id"], "at", 3_600_000_000).select("event_id", "cluster")
