"""Queries of scans, shapes, joins, windows, sorts, sets, exchanges, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import aggregates as A
from lodestone.operators import joins as J
from lodestone.operators import shapes
from lodestone.session import table as T


def define(register, F=F, S=S, A=A, W=W) -> None:
    """Registers the queries; columns need a running session, so the modules that make them are parameters."""

    def q(key: str, sql: str | None, f) -> None:
        register(key, f, sql)


    # --- scans and shapes
    q("scan_table", "select o_orderkey, o_custkey from orders", lambda s, d: T(s, d, "orders").select("o_orderkey", "o_custkey"))
    q("scan_partition", "select o_orderstatus, count(*) as n from (select * from orders where o_orderkey % 2 = 0 union all select * from orders where o_orderkey % 2 = 1) group by all",
      lambda s, d: T(s, d, "orders").where("o_orderkey % 2 = 0").unionByName(T(s, d, "orders").where("o_orderkey % 2 = 1")).groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    q("scan_pushdown", "select l_orderkey, l_linenumber from lineitem where l_quantity > 45 and l_returnflag = 'R'", lambda s, d: T(s, d, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber"))
    q("scan_late_mat", "select * exclude (props, ts) from events where event_type = 'error' and value > 50", lambda s, d: T(s, d, "events").where("event_type = 'error' and value > 50").drop("props", "ts"))
    q("scan_fast", "select event_id from events where event_type <> 'error'", lambda s, d: T(s, d, "events").where("event_type <> 'error'").select("event_id"))
    q("scan_raw", "select event_id, user_id from events", lambda s, d: T(s, d, "events").select("event_id", "user_id"))
    _MVCC = "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) r from events where event_id <= {0}) where r = 1 and event_type <> 'error'"
    q("scan_mvcc", _MVCC.format(8000), lambda s, d: shapes.newest_version(T(s, d, "events"), "user_id", "event_id", F.lit(8000), F.col("event_type") == "error").select("user_id", "event_id", "value"))
    q("scan_bitmap", _MVCC.format(3000), lambda s, d: shapes.newest_version(T(s, d, "events"), "user_id", "event_id", F.lit(3000), F.col("event_type") == "error").select("user_id", "event_id", "value"))
    q("scan_system", "select range as number from range(100)", lambda s, d: s.range(100).toDF("number"))
    q("scan_inverted", "select p_partkey from part where p_size in (1, 7, 15) or p_size between 40 and 42", lambda s, d: T(s, d, "part").where("p_size in (1, 7, 15) or p_size between 40 and 42").select("p_partkey"))
    q("scan_generated", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem", lambda s, d: T(s, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))).select("l_orderkey", "l_linenumber", "net"))
    q("scan_extra_table_id", "select r_regionkey, 7 as table_id from region", lambda s, d: T(s, d, "region").select("r_regionkey", F.lit(7).alias("table_id")))
    q("source_memory_numbers", "select * from (values (1, 'a'), (2, null), (3, 'c')) t(id, v)", lambda s, d: s.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string"))
    q("dictionaries", "select c_custkey, coalesce(n_name, '?') as nation from customer left join nation on c_nationkey = n_nationkey",
      lambda s, d: T(s, d, "customer").join(J.sized_broadcast(T(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("?")).alias("nation")))


    def scan_ann(spark: SparkSession, d: str) -> DataFrame:
        rows = T(spark, d, "embeddings")
        asked = F.array(*(F.lit(float(i % 7 - 3) / 10) for i in range(64)))
        return shapes.nearest(rows, S.l2_distance(F.col("embedding"), asked), "vec_id", 10).select("vec_id", F.round("distance", 6).alias("distance"))


    q("scan_ann", "select vec_id, round(d, 6) as distance from (select vec_id, sqrt(list_sum(list_transform(range(64), lambda i: (cast(embedding[i + 1] as double) - (i % 7 - 3) / 10.0) ** 2))) as d from embeddings) order by d, vec_id limit 10", scan_ann)
    q("scan_fts", r"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents),
    t as (select doc_id, len(ws) as n, len(list_filter(ws, lambda x: x = 'hand')) as a, len(list_filter(ws, lambda x: x = 'worthless')) as b from w),
    g as (select count(*) as docs, avg(n) as mean, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from t)
    select doc_id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) as score from t, g where a + b > 0""",
      lambda s, d: shapes.bm25(T(s, d, "documents"), "doc_id", "text", ["hand", "worthless"]).select("doc_id", F.round("score", 6).alias("score")))
    q("project", "select c_custkey as id, c_acctbal * 2 as twice from customer", lambda s, d: T(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 2).alias("twice")))
    q("filter", "select c_custkey from customer where c_acctbal > 0 and c_mktsegment <> 'BUILDING'", lambda s, d: T(s, d, "customer").where("c_acctbal > 0 and c_mktsegment <> 'BUILDING'").select("c_custkey"))
    _SETS = "select {0}, count(*) as n, sum(o_totalprice) as total from orders group by {1}"
    q("expand", _SETS.format("o_orderstatus, o_orderpriority", "grouping sets ((o_orderstatus), (o_orderpriority))"),
      lambda s, d: T(s, d, "orders").groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))
    q("expand2", _SETS.format("o_orderstatus, o_orderpriority", "rollup (o_orderstatus, o_orderpriority)"), lambda s, d: T(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))

    # --- joins
    # Whole tables: rows without a match come from the price and the segment in the ON clause, or from doubled keys.
    _ON = "o_custkey = c_custkey and o_totalprice > 150000 and c_mktsegment <> 'BUILDING'"
    for _key, _how in (("join_inner", "inner"), ("join_left_outer", "left"), ("join_right_outer", "right"), ("join_full_outer", "full")):
        q(_key, f"select o_orderkey, c_custkey, c_name from orders {_how} join customer on {_ON}", lambda s, d, how=_how: T(s, d, "orders").join(T(s, d, "customer"), F.expr(_ON), how).select("o_orderkey", "c_custkey", "c_name"))
    for _key, _how in (("join_semi", "semi"), ("join_anti", "anti")):
        q(_key, f"select o_orderkey from orders {_how} join customer on {_ON}", lambda s, d, how=_how: T(s, d, "orders").join(T(s, d, "customer"), F.expr(_ON), f"left_{how}").select("o_orderkey"))
    for _key, _not in (("join_right_semi", ""), ("join_right_anti", "not ")):
        q(_key, f"select c_custkey from customer where {_not}exists (select 1 from orders where o_custkey * 2 = c_custkey)",
          lambda s, d, how="left_anti" if _not else "left_semi": T(s, d, "customer").join(T(s, d, "orders"), F.expr("o_custkey * 2 = c_custkey"), how).select("c_custkey"))
    for _key, _neg in (("join_left_outer_semi", False), ("join_left_outer_anti", True)):
        q(_key, f"select c_custkey, {'not ' if _neg else ''}exists (select 1 from orders where o_custkey = c_custkey) as matched from customer",
          lambda s, d, neg=_neg: J.flag_join(T(s, d, "customer"), T(s, d, "orders"), "c_custkey", "o_custkey", negate=neg).select("c_custkey", "matched"))
    q("join_cross", "select r_name, n_name from region, nation", lambda s, d: T(s, d, "nation").crossJoin(T(s, d, "region")).select("r_name", "n_name"))
    q("join_cross_left_outer", "select r_name, n_name from region left join nation on r_regionkey > n_nationkey", lambda s, d: T(s, d, "region").join(T(s, d, "nation"), F.col("r_regionkey") > F.col("n_nationkey"), "left").select("r_name", "n_name"))
    q("join_cross_semi", "select s_suppkey from supplier where exists (select 1 from nation where s_acctbal < n_nationkey * 10)", lambda s, d: T(s, d, "supplier").join(T(s, d, "nation"), F.col("s_acctbal") < F.col("n_nationkey") * 10, "left_semi").select("s_suppkey"))
    q("join_cross_anti", "select s_suppkey from supplier where not exists (select 1 from nation where s_acctbal < n_nationkey * 10)", lambda s, d: T(s, d, "supplier").join(T(s, d, "nation"), F.col("s_acctbal") < F.col("n_nationkey") * 10, "left_anti").select("s_suppkey"))
    for _key, _neg in (("join_cross_left_outer_semi", False), ("join_cross_left_outer_anti", True)):
        q(_key, f"select s_suppkey, {'not ' if _neg else ''}exists (select 1 from nation where s_acctbal < n_nationkey * 10) as matched from supplier",
          lambda s, d, neg=_neg: J.condition_flag_join(T(s, d, "supplier"), T(s, d, "nation"), F.col("s_acctbal").outer() < F.col("n_nationkey") * 10, negate=neg).select("s_suppkey", "matched"))
    # Keys of all orders: doubled, or NULL for cheap ones.
    q("join_null_aware_anti", "select c_custkey from customer where c_custkey not in (select o_custkey * 2 from orders)", lambda s, d: J.null_aware_anti_join(T(s, d, "customer"), T(s, d, "orders").select((F.col("o_custkey") * 2).alias("k")), "c_custkey", "k").select("c_custkey"))
    for _key, _neg in (("join_null_aware_left_outer_semi", False), ("join_null_aware_left_outer_anti", True)):
        q(_key, f"select c_custkey, c_custkey {'not ' if _neg else ''}in (select case when o_totalprice > 300000 then o_custkey end from orders) as matched from customer",
          lambda s, d, neg=_neg: J.null_aware_flag_join(T(s, d, "customer"), T(s, d, "orders").select(F.expr("case when o_totalprice > 300000 then o_custkey end").alias("k")), "c_custkey", "k", negate=neg).select("c_custkey", "matched"))
    q("join_other_condition", "select o_orderkey from orders join customer on o_custkey = c_custkey and o_totalprice > c_acctbal * 30", lambda s, d: T(s, d, "orders").join(T(s, d, "customer"), F.expr("o_custkey = c_custkey and o_totalprice > c_acctbal * 30")).select("o_orderkey"))
    q("join_side_condition", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and c_acctbal > 0 and o_totalprice > 200000", lambda s, d: T(s, d, "customer").join(T(s, d, "orders"), F.expr("c_custkey = o_custkey and c_acctbal > 0 and o_totalprice > 200000"), "left").select("c_custkey", "o_orderkey"))
    q("join_key_coercion", "select o_orderkey, c_name from orders join customer on cast(o_custkey as decimal(20,2)) = cast(c_custkey as decimal(20,4))",
      lambda s, d: T(s, d, "orders").join(T(s, d, "customer"), J.coerced_equal(F.col("o_custkey"), F.col("c_custkey"), "decimal(20,4)")).select("o_orderkey", "c_name"))
    q("join_collation", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on lower(a.n_name) = lower(upper(b.n_name))",
      lambda s, d: T(s, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).join(T(s, d, "nation").select(F.col("n_nationkey").alias("b"), F.upper("n_name").alias("y")), J.collated_equal(F.col("x"), F.col("y"), "UTF8_LCASE")).select("a", "b"))
    q("join_broadcast", "select l_orderkey, l_linenumber, s_name from lineitem join supplier on l_suppkey = s_suppkey", lambda s, d: T(s, d, "lineitem").join(J.sized_broadcast(T(s, d, "supplier")), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_name"))

    # --- aggregation shapes
    q("agg_scalar", "select count(*) as n, sum(l_quantity) as total, max(l_shipdate) as last from lineitem", lambda s, d: T(s, d, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"), F.max("l_shipdate").alias("last")))
    q("agg_empty_input", "select count(*) as n, sum(l_quantity) as total, min(l_tax) as least from lineitem where l_quantity < 0", lambda s, d: T(s, d, "lineitem").where("l_quantity < 0").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"), F.min("l_tax").alias("least")))
    for _key in ("agg_partial_final", "agg_build", "agg_two_level", "agg_local_fine_grained", "agg_auto_pass_through", "agg_spill"):
        q(_key, "select l_suppkey, count(*) as n, sum(l_quantity) as total, avg(l_discount) as mean from lineitem group by l_suppkey", lambda s, d: T(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"), F.avg("l_discount").alias("mean")))
    q("agg_first_row_elim", "select o_custkey, min(o_custkey) as k from orders group by o_custkey", lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg(F.first("o_custkey").alias("k")))
    q("agg_collation", "select lower(c_mktsegment) as seg, count(*) as n from customer group by 1", lambda s, d: T(s, d, "customer").groupBy(F.collate("c_mktsegment", "UTF8_LCASE").alias("g")).agg(F.first(F.lower("c_mktsegment")).alias("seg"), F.count("*").alias("n")).select("seg", "n"))
    q("agg_distinct", "select l_returnflag, count(distinct l_suppkey) as a, count(distinct l_partkey) as b, sum(distinct l_quantity) as c from lineitem group by 1", lambda s, d: T(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("a"), F.count_distinct("l_partkey").alias("b"), F.sum_distinct("l_quantity").alias("c")))
    q("agg_rollup", "select l_returnflag, l_linestatus, grouping(l_linestatus) as g, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)", lambda s, d: T(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").alias("g"), F.count("*").alias("n")))
    q("agg_cube", "select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as g, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)", lambda s, d: T(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n")))
    q("agg_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), ())", lambda s, d: T(s, d, "lineitem").groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))
    q("agg_having", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 12", lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12"))
    q("agg_totals", "select o_orderstatus, sum(o_totalprice) as total from orders group by grouping sets ((o_orderstatus), ())", lambda s, d: A.with_totals(T(s, d, "orders"), ["o_orderstatus"], total=F.sum("o_totalprice")))
    q("agg_distinct_rows", "select distinct l_returnflag, l_linestatus from lineitem", lambda s, d: T(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct())

    # --- aggregate functions, by return flag
    _AGGS = {
        "count": ("count(l_tax)", F.count("l_tax")), "count_second_stage": ("count(*)", F.count("*")), "sum": ("sum(l_extendedprice)", F.sum("l_extendedprice")),
        "sum_on_partial_result": ("sum(l_tax)", F.sum("l_tax")), "sum_int": ("sum(cast(l_linenumber as bigint))", F.sum(F.col("l_linenumber").cast("long"))),
        "sum_kahan": ("round(sum(cast(l_extendedprice as decimal(18,4))), 2)", F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")), 2)), "avg": ("avg(l_quantity)", F.avg("l_quantity")),
        "min": ("min(l_shipdate)", F.min("l_shipdate")), "max": ("max(l_extendedprice)", F.max("l_extendedprice")), "any": ("any_value(l_returnflag)", F.any_value("l_returnflag")), "first_row": ("first(l_returnflag)", F.first("l_returnflag")), "any_last": ("last(l_returnflag)", F.last("l_returnflag")),
        "any_heavy": ("mode(l_linestatus)", F.mode("l_linestatus")), "arg_min": ("arg_min(l_orderkey * 8 + l_linenumber, (l_extendedprice, l_orderkey, l_linenumber))", F.min_by(F.expr("l_orderkey * 8 + l_linenumber"), F.struct("l_extendedprice", "l_orderkey", "l_linenumber"))),
        "arg_max": ("arg_max(l_orderkey * 8 + l_linenumber, (l_extendedprice, l_orderkey, l_linenumber))", F.max_by(F.expr("l_orderkey * 8 + l_linenumber"), F.struct("l_extendedprice", "l_orderkey", "l_linenumber"))),
        "uniq_exact": ("count(distinct l_partkey)", F.count_distinct("l_partkey")), "uniq_up_to": ("least(count(distinct l_suppkey), 11)", A.uniq_up_to(F.col("l_suppkey"), 10)),
        "group_concat": ("string_agg(l_linestatus, '-' order by l_linestatus)", A.group_concat(F.col("l_linestatus"), "-")), "group_array": ("list_sort(list(l_linenumber))", F.array_sort(F.collect_list("l_linenumber"))), "group_uniq_array": ("list_sort(list(distinct l_linenumber))", F.array_sort(F.collect_set("l_linenumber"))),
        "group_bit_or": ("cast(bit_or(l_orderkey) as decimal(20,0))", A.bit_or(F.col("l_orderkey"))), "group_bit_xor": ("cast(bit_xor(l_orderkey) as decimal(20,0))", A.bit_xor(F.col("l_orderkey"))), "group_bit_and": ("cast(bit_and(l_orderkey) as decimal(20,0))", A.bit_and(F.col("l_orderkey"))),
        "var_samp": ("round(var_samp(l_quantity), 6)", F.round(F.var_samp("l_quantity"), 6)), "var_pop": ("round(var_pop(l_quantity), 6)", F.round(F.var_pop("l_quantity"), 6)), "stddev_samp": ("round(stddev_samp(l_quantity), 6)", F.round(F.stddev_samp("l_quantity"), 6)), "stddev_pop": ("round(stddev_pop(l_quantity), 6)", F.round(F.stddev_pop("l_quantity"), 6)),
        "covar_samp": ("round(covar_samp(l_quantity, l_discount), 6)", F.round(F.covar_samp("l_quantity", "l_discount"), 6)), "covar_pop": ("round(covar_pop(l_quantity, l_discount), 6)", F.round(F.covar_pop("l_quantity", "l_discount"), 6)), "corr": ("round(corr(l_quantity, l_extendedprice), 6)", F.round(F.corr("l_quantity", "l_extendedprice"), 6)),
        "var_samp_stable": ("round(var_samp(l_extendedprice), 2)", F.round(F.var_samp("l_extendedprice"), 2)),
        "if": ("sum(l_quantity) filter (l_discount > 0.05)", F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")))), "null": ("count(nullif(l_linenumber, 1))", F.count(F.nullif(F.col("l_linenumber"), F.lit(1)))), "distinct_argument": ("count(distinct l_linenumber)", F.count_distinct("l_linenumber")),
    }
    for _name, (_sql, _col) in _AGGS.items():
        q(f"agg_{_name}", f"select l_returnflag, {_sql} as v from lineitem group by l_returnflag", lambda s, d, c=_col: T(s, d, "lineitem").groupBy("l_returnflag").agg(c.alias("v")))
    for _name, _col in {"uniq": A.uniq(F.col("l_partkey")), "uniq_hll12": F.approx_count_distinct("l_partkey", 0.016), "uniq_combined": F.approx_count_distinct("l_partkey", 0.01), "uniq_raw_res": F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")), "quantile": F.percentile_approx("l_extendedprice", 0.5), "quantiles": F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.9]), "quantile_deterministic": F.percentile_approx("l_extendedprice", 0.9, 100000), "quantile_timing": F.percentile_approx(F.col("l_quantity").cast("int"), 0.9), "quantile_tdigest": F.percentile_approx("l_extendedprice", 0.99)}.items():
        q(f"agg_{_name}", None, lambda s, d, c=_col: T(s, d, "lineitem").groupBy("l_returnflag").agg(c.alias("v")))
    q("agg_min_count", "select l_returnflag, count(*) as n from lineitem t where l_quantity = (select min(l_quantity) from lineitem u where u.l_returnflag = t.l_returnflag) group by 1", lambda s, d: A.extreme_count(T(s, d, "lineitem"), ["l_returnflag"], "l_quantity", False))
    q("agg_max_count", "select l_returnflag, count(*) as n from lineitem t where l_quantity = (select max(l_quantity) from lineitem u where u.l_returnflag = t.l_returnflag) group by 1", lambda s, d: A.extreme_count(T(s, d, "lineitem"), ["l_returnflag"], "l_quantity", True))
    q("agg_top_k", "select l_partkey, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 10", lambda s, d: A.top_values(T(s, d, "lineitem"), "l_partkey", 10))
    q("agg_sum_map", "select l_returnflag, l_linenumber as k, sum(l_quantity) as total from lineitem group by all", lambda s, d: A.sum_map(T(s, d, "lineitem").select("l_returnflag", F.array("l_linenumber").alias("ks"), F.array("l_quantity").alias("vs")), ["l_returnflag"], "ks", "vs"))
    q("agg_max_intersections", 'with e as (select user_id % 5 as g, event_id as "at", 1 as d from events union all select user_id % 5, event_id + 40, -1 from events), s as (select g, "at", sum(sum(d)) over (partition by g order by "at") as depth from e group by g, "at") select g, max(depth) as depth, arg_min("at", (-depth, "at")) as "at" from s group by g',
      lambda s, d: A.max_intersections(T(s, d, "events").select((F.col("user_id") % 5).alias("g"), F.col("event_id").alias("a"), (F.col("event_id") + 40).alias("b")), "a", "b", ["g"]))
    q("agg_sequence_match", "with t as (select user_id, string_agg(case event_type when 'view' then 'v' when 'click' then 'c' else '.' end, '' order by event_id) as t from events group by 1) select user_id, regexp_matches(t, 'v.*c') as matched, cast(len(regexp_extract_all(t, 'v.*c')) as bigint) as n from t",
      lambda s, d: A.sequence_match(T(s, d, "events"), ["user_id"], "event_id", "event_type", {"view": "v", "click": "c"}, "v.*c"))
    q("agg_array", "select label, round(sum(x), 4) as v from (select label, unnest(embedding) as x from embeddings) group by 1", lambda s, d: T(s, d, "embeddings").select("label", F.explode("embedding").alias("x")).groupBy("label").agg(F.round(F.sum("x"), 4).alias("v")))
    q("agg_for_each", "select i, round(sum(x), 4) as v from (select generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as x from embeddings) group by 1", lambda s, d: T(s, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy(F.col("i").cast("long").alias("i")).agg(F.round(F.sum("x"), 4).alias("v")))
    q("agg_state_merge", None, lambda s, d: T(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.hll_sketch_agg("l_partkey").alias("state")).groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("v")))
    q("agg_group_array_insert_at", "select l_orderkey, list_transform(range(1, 8), lambda i: coalesce(map_from_entries(list((l_linenumber, l_quantity)))[i], -1.0)) as v from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_quantity desc) group by 1",
      lambda s, d: T(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("x")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "x"))).alias("m")).select("l_orderkey", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1.0))).alias("v")))

    # --- windows
    _W = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    _OVER = "over (partition by o_custkey order by o_orderdate, o_orderkey{0})"
    _WINDOWS = {
        "win_row_number": ("row_number()", "", F.row_number().over(_W)), "win_rank": ("rank()", "", F.rank().over(_W)), "win_dense_rank": ("dense_rank()", "", F.dense_rank().over(_W)),
        "win_lead": ("lead(o_totalprice, 2, -1)", "", F.lead("o_totalprice", 2, -1.0).over(_W)), "win_lag": ("lag(o_totalprice)", "", F.lag("o_totalprice").over(_W)),
        "win_first_value": ("first_value(o_totalprice)", "", F.first_value("o_totalprice").over(_W)), "win_last_value": ("last_value(o_totalprice)", "", F.last_value("o_totalprice").over(_W)),
        "win_agg": ("sum(o_totalprice)", "", F.sum("o_totalprice").over(_W)), "frame_rows": ("max(o_totalprice)", " rows between 2 preceding and 1 following", F.max("o_totalprice").over(_W.rowsBetween(-2, 1))),
        "frame_default": ("count(*)", "", F.count("*").over(_W)), "win_partition_hash": ("count(*)", " rows between unbounded preceding and unbounded following", F.count("*").over(_W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))),
        "win_ntile": ("ntile(3)", "", F.ntile(3).over(_W)), "win_nth_value": ("nth_value(o_totalprice, 2)", "", F.nth_value("o_totalprice", 2).over(_W)), "win_cume_dist": ("round(cume_dist() {over}, 6)", "", F.round(F.cume_dist().over(_W), 6)), "win_percent_rank": ("round(percent_rank() {over}, 6)", "", F.round(F.percent_rank().over(_W), 6)),
        "min_for_window": ("min(o_totalprice)", " rows between 1 preceding and current row", F.min("o_totalprice").over(_W.rowsBetween(-1, 0))),
    }
    for _key, (_sql, _frame, _col) in _WINDOWS.items():
        _over = _OVER.format(_frame)
        _expr = _sql.format(over=_over) if "{over}" in _sql else f"{_sql} {_over}"
        q(_key, f"select o_orderkey, {_expr} as v from orders", lambda s, d, c=_col: T(s, d, "orders").select("o_orderkey", c.alias("v")))
    q("frame_range", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey range between 1000 preceding and 1000 following) as v from orders", lambda s, d: T(s, d, "orders").select("o_orderkey", F.count("*").over(W.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-1000, 1000)).alias("v")))
    q("frame_groups", "select p_partkey, sum(p_size) over (partition by p_brand order by p_size groups between 1 preceding and 1 following) as v from part", lambda s, d: shapes.groups_frame(T(s, d, "part"), F.sum("p_size"), ["p_brand"], "p_size", 1, 1, "v").select("p_partkey", "v"))

    # --- sorts, limits, sets
    q("limit", "select 10 as n", lambda s, d: T(s, d, "orders").limit(10).agg(F.count("*").cast("int").alias("n")))
    q("topn", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20", lambda s, d: T(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"))
    q("sort_window", "select o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderkey) as v from orders", lambda s, d: T(s, d, "orders").select("o_orderkey", F.sum("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("v")))
    q("sort_external", "select l_orderkey, l_linenumber from lineitem", lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber"))
    q("sort_by_constant", "select 5 as n", lambda s, d: T(s, d, "nation").orderBy(F.lit(1)).limit(5).agg(F.count("*").cast("int").alias("n")))
    q("sort_collation_nulls", "select c_custkey from customer order by nullif(c_nationkey, 3) nulls first, c_custkey limit 15", lambda s, d: T(s, d, "customer").orderBy(F.expr("nullif(c_nationkey, 3)").asc_nulls_first(), "c_custkey").limit(15).select("c_custkey"))
    q("limit_by", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) where r <= 2", lambda s, d: shapes.limit_by(T(s, d, "orders"), 2, ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey"))
    q("limit_offset", "select o_orderkey from orders order by o_orderkey limit 10 offset 5", lambda s, d: T(s, d, "orders").orderBy("o_orderkey").offset(5).limit(10).select("o_orderkey"))
    q("merge_sorted", "select s_suppkey from supplier", lambda s, d: T(s, d, "supplier").select("s_suppkey").sort("s_suppkey"))
    _A, _B = (lambda s, d: T(s, d, "customer").select(F.col("c_nationkey").alias("k"))), (lambda s, d: T(s, d, "supplier").select((F.col("s_nationkey") + 4).alias("k")))
    for _key, _sql, _f in (("union_all", "union all", lambda a, b: a.unionByName(b)), ("union_distinct", "union", lambda a, b: a.unionByName(b).distinct()), ("intersect", "intersect", lambda a, b: a.intersect(b)), ("except", "except", lambda a, b: a.subtract(b)), ("concat", "union all", lambda a, b: a.union(b))):
        q(_key, f"select c_nationkey as k from customer {_sql} select s_nationkey + 4 from supplier", lambda s, d, f=_f: f(_A(s, d), _B(s, d)).select("k"))
    q("cte_sink", "with t as (select o_custkey, sum(o_totalprice) as x from orders group by 1) select count(*) as n from t where x > (select avg(x) from t)", lambda s, d: (lambda t: t.join(F.broadcast(t.agg(F.avg("x").alias("m"))), how="inner").where("x > m").agg(F.count("*").alias("n")))(T(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x"))))
    q("subquery_in", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')", lambda s, d: T(s, d, "customer").join(T(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))

    # --- exchanges and clauses
    q("exchange_hash", "select o_custkey, count(*) as n from orders group by 1", lambda s, d: T(s, d, "orders").repartition("o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n")))
    q("exchange_fine_grained", "select user_id, count(*) as n from events group by 1", lambda s, d: T(s, d, "events").repartition(64, "user_id").groupBy("user_id").agg(F.count("*").alias("n")))
    q("exchange_broadcast", "select n_name, r_name from nation join region on n_regionkey = r_regionkey", lambda s, d: T(s, d, "nation").join(J.sized_broadcast(T(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"))
    q("select_sample", None, lambda s, d: T(s, d, "orders").sample(fraction=0.1, seed=1).select("o_orderkey"))
    q("select_final", _MVCC.format(10**9), lambda s, d: shapes.newest_version(T(s, d, "events"), "user_id", "event_id", None, F.col("event_type") == "error").select("user_id", "event_id", "value"))
