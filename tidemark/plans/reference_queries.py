"""One query for each operator, and the same in DuckDB SQL where SQL can tell it.

Task T1: will a customer place no order in the 90 days after a monthly cutoff of 1996; eligible with an order in the
365 days before. A score made from the keys stands in for a model where metrics are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.formula import formula
from tidemark.operators import clean, dfs, feasibility, leakage, metrics, profile, scoring, splits, verify
from tidemark.operators import features as fs
from tidemark.operators import labels as lb
from tidemark.operators.features import Feature, Path, Predicate
from tidemark.operators.labels import Rule, Target
from tidemark.sources import tables as src
from tidemark.sources.shared import new_path, ship, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


AS_OF = "2001-08-01"


def t1_windows(spark: SparkSession, horizon: int = 90) -> DataFrame:
    return lb.windows(lb.cutoffs(spark, "1996-01-01", "1996-12-01", 1, "months"), horizon, AS_OF)[0]


def t1_rule(spark: SparkSession, d: str, days: int = 365) -> Rule:
    return Rule(load(spark, d, "orders"), "o_custkey", "o_orderdate", f"o_orderdate >= :cutoff - interval {days} days")


def t1_spine(spark: SparkSession, d: str, windows: DataFrame | None = None) -> DataFrame:
    """Written, since whatever follows reads it several times; of some of the windows, if given."""
    every = load(spark, d, "customer"), "c_custkey", t1_windows(spark) if windows is None else windows
    return written(lb.apply_rule(lb.entity_cutoffs(*every), t1_rule(spark, d), made_of=every), "spine")


def orders_target(spark: SparkSession, d: str, **more) -> Target:
    return Target(load(spark, d, "orders"), "o_custkey", "o_orderdate", **more)


def t1_labels(spark: SparkSession, d: str, windows: DataFrame | None = None) -> DataFrame:
    return lb.labels(t1_spine(spark, d, windows), orders_target(spark, d, compare=("=", 0)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    s = F.pmod(F.col("entity_id") * 7919 + F.month("cutoff_time") * 104729, F.lit(1000)) / F.lit(1000.0)
    return written(t1_labels(spark, d), "labels").select("entity_id", "cutoff_time", "label", s.alias("score"), (F.col("entity_id") * 100 + F.month("cutoff_time")).alias("row_id"), (s >= 0.5).cast("int").alias("pred"))


def split(rows: DataFrame) -> DataFrame:
    return splits.partition(rows, "1996-07-01", "1996-10-01")


def parted_windows(spark: SparkSession, parts: tuple[str, ...] = (), where: str | None = None) -> DataFrame:
    """Windows with their part; only those of some parts, or that pass `where`, if given."""
    windows = split(t1_windows(spark))
    windows = windows.where(F.col("part").isin(*parts)) if parts else windows
    return windows.where(where) if where else windows


def parted(spark: SparkSession, d: str, parts: tuple[str, ...] = (), where: str | None = None) -> DataFrame:
    """Labels with their part; a part follows from the window, so rows of other parts (or windows that fail `where`) are not built."""
    return split(written(t1_labels(spark, d, parted_windows(spark, parts, where).drop("part")), "labels"))


def orders_path(spark: SparkSession, d: str) -> Path:
    return Path(load(spark, d, "orders"), "o_custkey", "o_orderdate", tie="o_orderkey")


def items_path(spark: SparkSession, d: str) -> Path:
    """Order lines, timed by their order: joined once, whatever the cutoffs. Lines are not sorted for it, they look their order up by hash."""
    items = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate", "l_linenumber")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return Path(items.join(orders.hint("shuffle_hash"), items["l_orderkey"] == orders["o_orderkey"]), "o_custkey", "o_orderdate", sizes=items)


W = "cutoffs as (select (timestamp '1996-01-01' + to_months(i::int))::timestamp as cutoff_time from range(12) r(i)), windows as (select cutoff_time, (cutoff_time + interval 90 day)::timestamp as label_window_end from cutoffs)"
S = W + ", spine as (select c_custkey as entity_id, cutoff_time, label_window_end from customer cross join windows w where exists (select 1 from orders where o_custkey = c_custkey and o_orderdate < w.cutoff_time and o_orderdate >= w.cutoff_time - interval 365 day))"
L = S + ", lab as (select entity_id, cutoff_time, (case when count(o_orderkey) = 0 then 1 else 0 end)::integer as label, label_window_end from spine left join orders on o_custkey = entity_id and o_orderdate > cutoff_time and o_orderdate <= label_window_end group by entity_id, cutoff_time, label_window_end)"
SC = L + ", sc as (select entity_id, cutoff_time, label, ((entity_id * 7919 + month(cutoff_time) * 104729) % 1000)::double / 1000 as score, entity_id * 100 + month(cutoff_time) as row_id, (case when (entity_id * 7919 + month(cutoff_time) * 104729) % 1000 >= 500 then 1 else 0 end)::integer as pred from lab)"
P = L + ", parts as (select *, case when cutoff_time >= timestamp '1996-10-01' then 'test' when cutoff_time >= timestamp '1996-07-01' then case when label_window_end <= timestamp '1996-10-01' then 'val' else 'purged_val' end when label_window_end <= timestamp '1996-07-01' then 'train' else 'purged_train' end as part from lab)"


def r(c: str | object, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---- sources


@query("A2", "select * from orders")
def a2(spark, d):
    return load(spark, d, "orders")


@query("A3", "select c_custkey, c_name, c_acctbal from customer")
def a3(spark, d):
    """A table of Spark's catalog; tables of other databases come through `sources.tables.read_jdbc`, in ranges of a key."""
    path = new_path(spark, "customer")
    name = f"tidemark_customer_{path[-32:]}"  # a name of its own, so that two runs on one catalog don't meet
    load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the rows are outside the catalog's folder and stay
    return table


@query("A4", "select o_custkey, count(*) as n_orders from orders group by o_custkey having count(*) > 12")
def a4(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("tidemark_orders")
    return src.select_import(spark, "select o_custkey, count(*) as n_orders from tidemark_orders group by o_custkey having count(*) > 12", 10_000_000)


@query("A5", "select o_orderkey, o_custkey, o_orderdate from orders where o_orderdate <= timestamp '1998-01-01'")
def a5(spark, d):
    return src.as_of(load(spark, d, "orders"), "o_orderdate", "1998-01-01", ["o_orderkey", "o_custkey"])


CHECK = "sum((concat('0x', substr(md5(concat_ws(chr(31), {})), 17, 16))::ubigint)::hugeint)::varchar"
_ORDER_FIELDS = ", ".join(f"coalesce({c}::varchar, chr(0))" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("A6", f"select count(*) as n_rows, max(o_orderdate) as max_time, count(*) filter (where o_orderdate is null) as null_time_rows, {CHECK.format(_ORDER_FIELDS)} as checksum from orders")
def a6(spark, d):
    o = load(spark, d, "orders")
    rec = src.table_record(o, "o_orderdate").select("n_rows", "max_time", "null_time_rows")
    return rec.crossJoin(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").agg(src.checksum(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).cast("string").alias("checksum")))


@query("A7", "select " + CHECK.format("coalesce(c_custkey::varchar, chr(0)), coalesce(c_name, chr(0)), coalesce(c_mktsegment, chr(0))") + " as checksum from customer")
def a7(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.agg(src.checksum(c).cast("string").alias("checksum"))


_LINE_FIELDS = ", ".join(f"coalesce({c}::varchar, chr(0))" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
_HALF = "printf('%08x', bit_xor(concat('0x', substr(md5(concat_ws(chr(31), {})), {}, 8))::bigint))"


@query("A9", f"select count(*) as n_rows, {_HALF.format(_LINE_FIELDS, 17)} || {_HALF.format(_LINE_FIELDS, 25)} as hash from lineitem")
def a9(spark, d):
    return src.fingerprint(load(spark, d, "lineitem"))


@query("A10", "select 'orders' as table_name, count(*) as n_rows, max(o_orderdate) as max_time from orders where o_orderdate <= timestamp '1999-01-01' union all select 'lineitem', count(*), max(l_shipdate) from lineitem where l_shipdate <= timestamp '1999-01-01'")
def a10(spark, d):
    one = lambda t, c: src.as_of(load(spark, d, t), c, "1999-01-01").agg(F.count("*").alias("n_rows"), F.max(c).alias("max_time")).select(F.lit(t).alias("table_name"), "n_rows", "max_time")
    return one("orders", "o_orderdate").union(one("lineitem", "l_shipdate"))


@query("A11", "select * from supplier")
def a11(spark, d):
    return src.bounded(load(spark, d, "supplier"), 100_000_000)


@query("A12", "select * from customer")
def a12(spark, d):
    from tidemark.sources.shared import shared_dir

    return spark.read.parquet(src.store_version(load(spark, d, "customer"), f"{shared_dir(spark)}/tidemark/versions"))


@query("A17", "select event_id, date_trunc('second', ts)::timestamp as ts from events")
def a17(spark, d):
    text = load(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return src.typed_time(text, "ts")


# ---- schema discovery


@query("E5", " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in ("customer", "orders", "lineitem", "events")))
def e5(spark, d):
    out = None
    for t in ("customer", "orders", "lineitem", "events"):
        one = load(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.union(one)
    return out


@query("E6")
def e6(spark, d):
    t = {"customer": load(spark, d, "customer").withColumnRenamed("c_custkey", "customer_id"), "orders": load(spark, d, "orders").withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "customer_id"}).select("order_id", "customer_id"), "lineitem": load(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_quantity")}
    edges = profile.infer_edges(t, {"customer": "customer_id", "orders": "order_id"})
    return spark.createDataFrame([(e["child"], e["column"], e["parent"], e["key"], e["confidence"]) for e in edges], "child string, child_column string, parent string, parent_key string, confidence double")


@query("E7", "select 'o_custkey' as child_column, 'c_custkey' as parent_column, count(*) as n_keys, count(c_custkey) as matched, count(c_custkey)::double / count(*) as overlap from (select distinct o_custkey from orders where o_custkey is not null) left join (select distinct c_custkey from customer) on o_custkey = c_custkey")
def e7(spark, d):
    return profile.key_overlap(load(spark, d, "orders"), load(spark, d, "customer"), [("o_custkey", "c_custkey")])


@query("E8", " union all ".join(f"select '{c}' as column_name, count({c}) as non_null, count(distinct {c}) as n_distinct, count({c}) = count(distinct {c}) as is_unique from orders" for c in ("o_orderkey", "o_custkey")))
def e8(spark, d):
    return profile.uniqueness(load(spark, d, "orders"), ["o_orderkey", "o_custkey"])


@query("E11", "select 'o_orderstatus' as column_name, count(*) filter (where o_orderkey % 7 = 0 and o_orderstatus is distinct from 'F') as n_changed from orders union all select 'o_totalprice', count(*) filter (where o_orderkey % 11 = 0 and o_totalprice is not null) from orders")
def e11(spark, d):
    o = load(spark, d, "orders")
    new = o.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))})
    return profile.changed_columns(o, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


# ---- profiles

_NUM = ("l_quantity", "l_extendedprice", "l_discount")


def _stats_sql(c: str) -> str:
    return f"select '{c}' as column_name, count({c}) as non_null, count(distinct {c}) as n_distinct, round(count(*) filter (where {c} is null)::double / count(*), 6) as null_fraction, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c})::double, 4) as min, round(max({c})::double, 4) as max from lineitem"


@query("P1", " union all ".join(map(_stats_sql, _NUM)))
def p1(spark, d):
    s = profile.table_stats(load(spark, d, "lineitem"), list(_NUM))
    return s.select("column_name", "non_null", "n_distinct", r("null_fraction").alias("null_fraction"), r("mean", 4).alias("mean"), r("std", 4).alias("std"), r(F.col("min_text").cast("double"), 4).alias("min"), r(F.col("max_text").cast("double"), 4).alias("max"))


@query("P2", " union all ".join(f"select '{c}' as column_name, " + ", ".join(f"round(quantile_cont({c}::double, {q}), 4) as p{round(q * 100)}" for q in (0.01, 0.5, 0.99)) + " from lineitem" for c in _NUM))
def p2(spark, d):
    return profile.table_stats(load(spark, d, "lineitem"), list(_NUM)).select("column_name", *[r(c, 4).alias(c) for c in ("p1", "p50", "p99")])


def _top_sql(cols: dict[str, str], k: int) -> str:
    return " union all ".join(f"(select '{c}' as column_name, {c}::varchar as value, count(*) as n, row_number() over (order by count(*) desc, {c}::varchar)::integer as position from {t} where {c} is not null group by {c} qualify position <= {k})" for c, t in cols.items())


@query("P3", _top_sql({"l_returnflag": "lineitem", "l_linestatus": "lineitem"}, 10))
def p3(spark, d):
    return profile.top_values(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("P5", "with n as (select count(*) as n, least(1.0::double, 5000.0::double / count(*)) as fraction from lineitem) select count(*) filter (where concat('0x', substr(md5(concat_ws(chr(31), '42', l_orderkey::varchar, l_linenumber::varchar)), 1, 8))::bigint < floor(fraction * 4294967296)) as n_rows, any_value(fraction) as fraction from lineitem cross join n")
def p5(spark, d):
    li = load(spark, d, "lineitem")
    part, told = profile.sampled(li, li.count(), 5000, ["l_orderkey", "l_linenumber"])
    return part.agg(F.count("*").alias("n_rows")).withColumn("fraction", F.lit(told["fraction"]))


@query("P6", " union all ".join(f"select '{c}' as column_name, count({c}) as non_null, count(distinct {c}) as n_distinct from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")))
def p6(spark, d):
    return profile.table_stats(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], chunk=2).select("column_name", "non_null", "n_distinct")


@query("P7", "with e as (select user_id, event_type from events) select (select count(*) from e) as n_rows, 2 as n_columns, 0.0::double as missing_rate, ((select count(*) from e) - (select count(*) from (select distinct * from e)))::bigint as duplicate_rows")
def p7(spark, d):
    return profile.dataset_profile(load(spark, d, "events").select("user_id", "event_type"))


@query("P8", " union all ".join(f"select '{c}' as column_name, count({c}) as n, count(*) filter (where {c} is null) as missing, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(quantile_cont({c}, 0.25), 4) as q25, round(median({c}), 4) as median, round(quantile_cont({c}, 0.75), 4) as q75, round(max({c}), 4) as max, round(skewness({c}), 4) as skew, round(kurtosis({c}), 4) as kurtosis from (select l_extendedprice::double as l_extendedprice, l_quantity::double as l_quantity from lineitem)" for c in ("l_extendedprice", "l_quantity")))
def p8(spark, d):
    s = profile.numeric_stats(load(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    return s.select("column_name", "n", "missing", *[r(c, 4).alias(c) for c in s.columns[3:]])


@query("P9", "with v as (select o_orderpriority as value, count(*) as value_n from orders where o_orderpriority is not null group by 1), t as (select value, value_n, (row_number() over (order by value_n desc, value))::integer as position from v qualify position <= 10), w as (select count(o_orderpriority) as n, count(*) - count(o_orderpriority) as missing, count(distinct o_orderpriority) as n_unique from orders) select 'o_orderpriority' as column_name, n, missing, n_unique, value, value_n, position from w left join t on true")
def p9(spark, d):
    return profile.text_stats(load(spark, d, "orders"), ["o_orderpriority"], 10)


@query("P9_values", _top_sql({"o_orderpriority": "orders"}, 10))
def p9_values(spark, d):
    return profile.top_values(load(spark, d, "orders"), ["o_orderpriority"], 10)


@query("P10", "select o_orderstatus as measure, round(count(*)::double / sum(count(*)) over (), 6) as value from orders where o_orderstatus is not null group by o_orderstatus")
def p10(spark, d):
    return profile.target_balance(load(spark, d, "orders"), "o_orderstatus").select("measure", r("value").alias("value"))


@query("P12", "with b as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), c as (select least(floor((o_totalprice - lo) / ((hi - lo) / 12)), 11)::integer as bin, count(*) as n from orders, b where o_totalprice is not null group by 1) select g.bin::integer as bin, coalesce(n, 0) as n, round(coalesce(n, 0)::double / (select max(n) from c), 6) as height from range(12) g(bin) left join c using (bin)")
def p12(spark, d):
    return profile.column_shape(load(spark, d, "orders"), "o_totalprice").select("bin", "n", r("height").alias("height"))


@query("P14", _top_sql({"o_orderstatus": "orders", "o_orderpriority": "orders"}, 5))
def p14(spark, d):
    return profile.top_values(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], 5, 50)


# ---- cutoffs, eligibility, labels


#: From the first month of the orders to their last day, in SQL: monthly cutoffs, windows of 90 days.
MONTHS = "b as (select date_trunc('month', min(o_orderdate)) as lo, max(o_orderdate) as hi from orders), m as (select i, (lo + to_months(i::int))::timestamp as cutoff_time, hi from b, range(1200) t(i) where lo + to_months(i::int) <= hi)"


def order_range(spark, d):
    """The first day of the orders' first month and their last day."""
    r = load(spark, d, "orders").agg(F.date_format(F.date_trunc("month", F.min("o_orderdate")), "yyyy-MM-dd").alias("lo"), F.max("o_orderdate").cast("date").cast("string").alias("hi")).first()
    return r["lo"], r["hi"]


@query("L1", f"with {MONTHS} select cutoff_time from m where i % 2 = 0")
def l1(spark, d):
    return lb.cutoffs(spark, *order_range(spark, d), 2, "months")


@query("L2", f"with {MONTHS} select cutoff_time, (cutoff_time + interval 90 day)::timestamp as label_window_end, cutoff_time + interval 90 day <= hi as kept from m")
def l2(spark, d):
    lo, hi = order_range(spark, d)
    kept, gone = lb.windows(lb.cutoffs(spark, lo, hi, 1, "months"), 90, hi)
    return kept.withColumn("kept", F.lit(True)).union(gone.withColumn("kept", F.lit(False)))


@query("L3", f"with {W} select c_custkey as entity_id, cutoff_time, label_window_end from customer cross join windows")
def l3(spark, d):
    return lb.entity_cutoffs(load(spark, d, "customer"), "c_custkey", t1_windows(spark))


@query("L4", f"with {W}, f as (select o_custkey, min(o_orderdate) as since from orders group by 1) select o_custkey as entity_id, cutoff_time, label_window_end from f, windows where since < cutoff_time")
def l4(spark, d):
    first = load(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    return lb.entity_cutoffs(first, "o_custkey", t1_windows(spark), created="since")


@query("L5", f"with {W}, f as (select o_custkey, max(o_orderdate) as last from orders where o_orderdate < timestamp '1996-06-01' group by 1) select o_custkey as entity_id, cutoff_time, label_window_end from f, windows where last >= cutoff_time - interval 60 day and last < cutoff_time")
def l5(spark, d):
    last = load(spark, d, "orders").where("o_orderdate < timestamp_ntz '1996-06-01'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return lb.entity_cutoffs(last, "o_custkey", t1_windows(spark), where="last >= :cutoff - interval 60 days and last < :cutoff")


@query("L6", f"with {S} select * from spine")
def l6(spark, d):
    return t1_spine(spark, d)


@query("L7", f"with {W} select c_custkey as entity_id, cutoff_time, label_window_end from customer cross join windows w where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate < w.cutoff_time and o_orderstatus = 'F')")
def l7(spark, d):
    every = lb.entity_cutoffs(load(spark, d, "customer"), "c_custkey", t1_windows(spark))
    return lb.apply_rule(every, Rule(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderstatus = 'F'"), exists=False)


@query("L8", f"with {W} select s_suppkey as entity_id, cutoff_time, label_window_end from supplier cross join windows w where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_shipdate < w.cutoff_time and l_shipdate >= w.cutoff_time - interval 30 day)")
def l8(spark, d):
    every = lb.entity_cutoffs(load(spark, d, "supplier"), "s_suppkey", t1_windows(spark))
    return lb.apply_rule(every, Rule(load(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_shipdate >= :cutoff - interval 30 days"))


def _label_sql(value: str, where: str = "", having: str = "") -> str:
    return f"with {S} select entity_id, cutoff_time, {value} as label, label_window_end from spine left join orders on o_custkey = entity_id and o_orderdate > cutoff_time and o_orderdate <= label_window_end {where} group by entity_id, cutoff_time, label_window_end {having}"


@query("L9", _label_sql("count(distinct o_orderstatus)", "and o_totalprice > 1000"))
def l9(spark, d):
    return lb.labels(t1_spine(spark, d), orders_target(spark, d, agg="count_distinct", column="o_orderstatus", where="o_totalprice > 1000"))


@query("L10", f"with {L} select * from lab")
def l10(spark, d):
    return t1_labels(spark, d)


@query("L11", _label_sql("round(avg(o_totalprice), 6)", "", "having avg(o_totalprice) is not null"))
def l11(spark, d):
    out = lb.labels(t1_spine(spark, d), orders_target(spark, d, agg="avg", column="o_totalprice"))
    return out.withColumn("label", r("label"))


@query("L12", f"with {S} select entity_id, cutoff_time, o_orderstatus as label, label_window_end from spine join orders on o_custkey = entity_id and o_orderdate > cutoff_time and o_orderdate <= label_window_end where o_orderstatus is not null qualify row_number() over (partition by entity_id, cutoff_time order by o_orderdate, o_orderstatus) = 1")
def l12(spark, d):
    return lb.labels(t1_spine(spark, d), orders_target(spark, d, agg="first", column="o_orderstatus"))


COUNTS = L + ", counts as (select cutoff_time, count(*) as eligible, sum(label)::bigint as positives, avg(label) as base_rate from lab group by 1)"


@query("L13", f"with {COUNTS} select cutoff_time, eligible, positives, round(base_rate, 6) as base_rate from counts")
def l13(spark, d):
    return lb.label_counts(t1_labels(spark, d)).withColumn("base_rate", r("base_rate"))


@query("L14", f"with {S}, f as (select * from spine where cutoff_time = (select min(cutoff_time) from spine)) select 'orders' as table_name, count(*) as eligible, count(*) filter (where exists (select 1 from orders where o_custkey = entity_id and o_orderdate < cutoff_time)) as covered from f union all select 'events', count(*), count(*) filter (where exists (select 1 from events where user_id = entity_id and ts < cutoff_time)) from f")
def l14(spark, d):
    return lb.coverage(t1_spine(spark, d), {"orders": (load(spark, d, "orders"), "o_custkey", "o_orderdate"), "events": (load(spark, d, "events"), "user_id", "ts")})


@query("L15", f"with {L} select * from lab")
def l15(spark, d):
    from tidemark.sources.shared import written

    return written(t1_labels(spark, d), "labels")


@query("L16", "select c_custkey as entity_id, timestamp '2001-05-01' as cutoff_time from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderdate < timestamp '2001-05-01' and o_orderdate >= timestamp '2001-05-01' - interval 365 day)")
def l16(spark, d):
    one = lb.cutoffs(spark, "2001-05-01", "2001-05-01", 1, "months")
    return lb.apply_rule(lb.entity_cutoffs(load(spark, d, "customer"), "c_custkey", one), t1_rule(spark, d))


@query("L17", "select date_trunc('day', least((select max(o_orderdate) from orders), (select max(l_shipdate) from lineitem)))::timestamp as cutoff_time, greatest((select max(o_orderdate) from orders), (select max(l_shipdate) from lineitem)) as data_end")
def l17(spark, d):
    return lb.latest_cutoff([(load(spark, d, "orders"), "o_orderdate"), (load(spark, d, "lineitem"), "l_shipdate")])


@query("L19", "select o_orderkey as entity_id, o_orderdate as cutoff_time, (case when o_orderstatus = 'F' then 1 else 0 end)::integer as label, (o_orderdate + interval 30 day)::timestamp as label_window_end from orders")
def l19(spark, d):
    own = load(spark, d, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return lb.own_labels(own, "o_orderkey", "o_orderdate", "y", 30)


# ---- feasibility


def part_counts(spark, d):
    return parted(spark, d).groupBy("cutoff_time", "part").agg(F.count("*").alias("eligible"), F.sum("label").alias("positives"), F.avg("label").alias("base_rate"))


@query("Q1", f"with {P}, x as (select part, sum(label)::bigint as positives from parts where part in ('train', 'val', 'test') group by part) select part, positives, case when positives < case when part = 'train' then 50 else 20 end then 'block' when positives < 200 then 'warn' else 'ok' end as status from x")
def q1(spark, d):
    return feasibility.positives_per_part(part_counts(spark, d))


@query("Q2", f"with {COUNTS}, x as (select min(base_rate) as lo, max(base_rate) as hi, count(*) filter (where positives = 0) as e from counts) select round(lo, 6) as min_rate, round(hi, 6) as max_rate, e as empty_cutoffs, case when e > 0 or hi / nullif(lo, 0) > 3 then 'warn' else 'ok' end as status from x")
def q2(spark, d):
    return feasibility.base_rate_per_cutoff(lb.label_counts(t1_labels(spark, d))).select(r("min_rate").alias("min_rate"), r("max_rate").alias("max_rate"), "empty_cutoffs", "status")


@query("Q3", f"with {COUNTS}, x as (select cutoff_time, lag(eligible) over (order by cutoff_time) as before, eligible from counts) select *, case when eligible * 2 < before then 'warn' else 'ok' end as status from x where before is not null")
def q3(spark, d):
    return feasibility.eligible_drops(lb.label_counts(t1_labels(spark, d)))


@query("Q4", f"with {COUNTS}, x as (select sum(positives)::double / sum(eligible) as rate from counts) select round(rate, 6) as rate, round(least(rate, 1 - rate), 6) as rarer_share, case when least(rate, 1 - rate) < 0.01 then 'warn' else 'ok' end as status from x")
def q4(spark, d):
    return feasibility.imbalance(lb.label_counts(t1_labels(spark, d))).select(r("rate").alias("rate"), r("rarer_share").alias("rarer_share"), "status")


@query("Q5", f"with {S}, f as (select * from spine where cutoff_time = (select min(cutoff_time) from spine)), x as (select avg((exists (select 1 from orders where o_custkey = entity_id and o_orderdate < cutoff_time))::int) as best from f) select round(best, 6) as best, case when coalesce(best < 0.05, true) then 'warn' else 'ok' end as status from x")
def q5(spark, d):
    got = lb.coverage(t1_spine(spark, d), {"orders": (load(spark, d, "orders"), "o_custkey", "o_orderdate")})
    return feasibility.coverage(got).withColumn("best", r("best"))


@query("Q6", f"with {MONTHS} select count(*) as n_dropped, case when count(*) > 0 then 'warn' else 'ok' end as status from m where cutoff_time + interval 90 day > hi")
def q6(spark, d):
    lo, hi = order_range(spark, d)
    return feasibility.dropped(lb.windows(lb.cutoffs(spark, lo, hi, 1, "months"), 90, hi)[1])


REG = S + ", reg as (select entity_id, cutoff_time, coalesce(sum(o_totalprice), 0) as label, label_window_end from spine left join orders on o_custkey = entity_id and o_orderdate > cutoff_time and o_orderdate <= label_window_end group by entity_id, cutoff_time, label_window_end), rp as (select *, case when cutoff_time >= timestamp '1996-10-01' then 'test' when cutoff_time >= timestamp '1996-07-01' then case when label_window_end <= timestamp '1996-10-01' then 'val' else 'purged_val' end when label_window_end <= timestamp '1996-07-01' then 'train' else 'purged_train' end as part from reg)"


@query("Q7", f"with {REG}, x as (select part, count(*) as n, avg(label) as m, stddev_pop(label) as s, avg((label = 0)::int) as z from rp where part in ('train', 'val', 'test') group by part) select part, n, round(m, 2) as mean, round(s, 2) as std, round(z, 6) as zero_share, case when (part = 'train' and s = 0) or round(n * (1 - z)) < case when part = 'train' then 50 else 20 end then 'block' when z > 0.9 then 'warn' else 'ok' end as status from x")
def q7(spark, d):
    rows = lb.labels(t1_spine(spark, d), orders_target(spark, d, agg="sum", column="o_totalprice"))
    parts = splits.partition(rows, "1996-07-01", "1996-10-01")
    counts = lb.label_counts(parts, "regression").join(parts.select("cutoff_time", "part").distinct(), "cutoff_time")
    return feasibility.target_moments(counts).select("part", "n", r("mean", 2).alias("mean"), r("std", 2).alias("std"), r("zero_share").alias("zero_share"), "status")


MULTI = S + ", mc as (select entity_id, cutoff_time, o_orderstatus as label, label_window_end from spine join orders on o_custkey = entity_id and o_orderdate > cutoff_time and o_orderdate <= label_window_end where o_orderstatus is not null qualify row_number() over (partition by entity_id, cutoff_time order by o_orderdate, o_orderstatus) = 1), mp as (select *, case when cutoff_time >= timestamp '1996-10-01' then 'test' when cutoff_time >= timestamp '1996-07-01' then case when label_window_end <= timestamp '1996-10-01' then 'val' else 'purged_val' end when label_window_end <= timestamp '1996-07-01' then 'train' else 'purged_train' end as part from mc)"


@query("Q8", f"with {MULTI}, x as (select part, label, count(*) as n from mp where part in ('train', 'val', 'test') group by 1, 2), y as (select part, count(*) as n_classes, sum(n)::bigint as n_rows, min(n) as smallest, count(*) filter (where label not in (select label from x where part = 'train')) as unseen from x group by part) select *, case when n_classes > 30 or (part = 'train' and n_classes < 2) or (part <> 'train' and n_rows < 20) then 'block' when (part = 'train' and smallest < 30) or unseen > 0 then 'warn' else 'ok' end as status from y")
def q8(spark, d):
    parts = splits.partition(written(lb.labels(t1_spine(spark, d), orders_target(spark, d, agg="first", column="o_orderstatus")), "labels"), "1996-07-01", "1996-10-01")
    return feasibility.classes_per_part(parts.groupBy("part", "label").agg(F.count("*").alias("n")))


# ---- features


def _feature_sql(columns: str, extra: str = "") -> str:
    return f"with {S} select entity_id, cutoff_time, {columns} from spine left join orders on o_custkey = entity_id and o_orderdate < cutoff_time {extra} group by entity_id, cutoff_time"


def one(name: str, sql: str, *feats: Feature, rounded: int | None = None) -> None:
    @query(name, sql)
    def run(spark, d):
        out = fs.compute(t1_spine(spark, d), orders_path(spark, d), list(feats))
        return out.select(*lb.KEYS, *[(r(f.name, rounded) if rounded is not None else F.col(f.name)).alias(f.name) for f in feats])


@query("F1", f"with {S} select entity_id, cutoff_time, o_orderkey from spine left join orders on o_custkey = entity_id and o_orderdate < cutoff_time and o_orderdate >= cutoff_time - interval 90 day")
def f1(spark, d):
    return fs.pit_join(t1_spine(spark, d), orders_path(spark, d), 90).select(*lb.KEYS, "o_orderkey")


ITEMS = "left join (select l_quantity, l_returnflag, l_shipdate, o_custkey, o_orderdate from lineitem join orders on l_orderkey = o_orderkey) on o_custkey = entity_id and o_orderdate < cutoff_time"


@query("F2", f"with {S} select entity_id, cutoff_time, count(o_custkey) as n_items, count(o_custkey) filter (where o_orderdate >= cutoff_time - interval 365 day) as n_items_365, round(coalesce(sum(l_quantity), 0), 2) as quantity from spine {ITEMS} group by 1, 2")
def f2(spark, d):
    out = fs.compute(t1_spine(spark, d), items_path(spark, d), [Feature("n_items", "count"), Feature("n_items_365", "count", days=365), Feature("quantity", "sum", "l_quantity")])
    return out.withColumn("quantity", r("quantity", 2))


one("F3", _feature_sql("count(o_orderkey) as n_orders"), Feature("n_orders", "count"))
one("F4", _feature_sql("count(distinct o_orderstatus) as n_status"), Feature("n_status", "count_distinct", "o_orderstatus"))
one("F5", _feature_sql("round(coalesce(sum(o_totalprice), 0), 2) as spent"), Feature("spent", "sum", "o_totalprice"), rounded=2)
one("F6", _feature_sql("round(avg(o_totalprice), 6) as mean_price"), Feature("mean_price", "mean", "o_totalprice"), rounded=6)
one("F7", _feature_sql("round(min(o_totalprice), 2) as least, round(max(o_totalprice), 2) as most"), Feature("least", "min", "o_totalprice"), Feature("most", "max", "o_totalprice"), rounded=2)
one("F8", _feature_sql("round(stddev_samp(o_totalprice), 2) as price_std"), Feature("price_std", "std", "o_totalprice"), rounded=2)
one("F9", _feature_sql("round(date_diff('second', max(o_orderdate), cutoff_time) / 86400.0::double, 6) as since_last"), Feature("since_last", "days_since_last"), rounded=6)
one("F10", _feature_sql("round(date_diff('second', min(o_orderdate), cutoff_time) / 86400.0::double, 6) as since_first"), Feature("since_first", "days_since_first"), rounded=6)
one("F11", _feature_sql("round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end)::double, 6) as share_f"), Feature("share_f", "share", where=(Predicate("o_orderstatus", "=", "F"),)), rounded=6)
one("F12", _feature_sql("count(o_orderkey) filter (where o_orderstatus in ('F', 'O') and o_totalprice > 1000 and o_orderpriority is not null) as n_some"), Feature("n_some", "count", where=(Predicate("o_orderstatus", "in", ("F", "O")), Predicate("o_totalprice", ">", 1000), Predicate("o_orderpriority", "is_not_null"))))
one("F13", _feature_sql(", ".join(f"count(o_orderkey) filter (where o_orderdate >= cutoff_time - interval {n} day) as n_{n}" for n in (7, 30, 90, 365))), *[Feature(f"n_{n}", "count", days=n) for n in (7, 30, 90, 365)])
one("F15", _feature_sql("round(ln(1 + count(o_orderkey)), 6) as log_n"), Feature("log_n", "count", log1p=True), rounded=6)
one("F18", _feature_sql("arg_max(o_orderstatus, struct_pack(t := o_orderdate, k := o_orderkey)) as last_status"), Feature("last_status", "latest", "o_orderstatus"))
one("F19", _feature_sql("(case when count(o_orderkey) filter (where o_totalprice > 400000) > 0 then 1 else 0 end)::integer as had_large"), Feature("had_large", "exists", where=(Predicate("o_totalprice", ">", 400000),)))


@query("F14", _feature_sql("round(1.0::double * count(o_orderkey) filter (where o_orderdate >= cutoff_time - interval 90 day) / nullif(count(o_orderkey) filter (where o_orderdate >= cutoff_time - interval 365 day), 0), 6) as recent"))
def f14(spark, d):
    out = fs.compute(t1_spine(spark, d), orders_path(spark, d), [Feature("a", "count", days=90), Feature("b", "count", days=365)])
    return fs.ratio(out, "recent", "a", "b").select(*lb.KEYS, r("recent").alias("recent"))


@query("F16", f"with {S} select entity_id, cutoff_time, c_mktsegment, c_acctbal from spine left join customer on c_custkey = entity_id")
def f16(spark, d):
    return fs.entity_values(t1_spine(spark, d), load(spark, d, "customer"), "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("F17", f"with {S}, f as (select o_custkey, min(o_orderdate) as since from orders group by 1) select entity_id, cutoff_time, round(date_diff('second', since, cutoff_time) / 86400.0::double, 6) as age from spine left join f on o_custkey = entity_id and since < cutoff_time")
def f17(spark, d):
    first = load(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    return fs.entity_values(t1_spine(spark, d), first, "o_custkey", [], "since", "age").withColumn("age", r("age"))


def catalog(spark, d):
    return {"customer": dfs.Table(load(spark, d, "customer"), "c_custkey", static=True), "orders": dfs.Table(load(spark, d, "orders"), "o_orderkey", "o_orderdate", {"o_custkey": "customer"})}


_D = (30, 90, 365)
_WITHIN = "filter (where o_orderdate >= cutoff_time - interval {} day)"
_DFS = ", ".join(
    [f"count(o_orderkey) {_WITHIN.format(n)} as orders_count_{n}d" for n in (7, 30, 90, 365)]
    + ["count(o_orderkey) as orders_count_all", "round(date_diff('second', max(o_orderdate), cutoff_time) / 86400.0::double, 6) as orders_days_since_last"]
    + [f"round({'coalesce(' if a == 'sum' else ''}{f}(o_totalprice) {_WITHIN.format(n)}{', 0)' if a == 'sum' else ''}, {6 if a == 'mean' else 2}) as orders_o_totalprice_{a}_{n}d" for a, f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp")) for n in _D]
    + [f"count(o_orderkey) filter (where o_orderstatus = '{v}' and o_orderdate >= cutoff_time - interval {n} day) as \"orders_o_orderstatus_{v}_count_{n}d\"" for v in ("F", "O", "P") for n in _D]
)


@query("F22", _feature_sql(_DFS).replace("select entity_id, cutoff_time,", "select entity_id, cutoff_time,", 1).replace(f"with {S}", f"with {S}, base as (", 1) + ") select b.*, round(1.0::double * orders_count_7d / nullif(orders_count_30d, 0), 6) as orders_count_7_over_30, round(1.0::double * orders_count_30d / nullif(orders_count_90d, 0), 6) as orders_count_30_over_90, c_mktsegment from base b left join customer on c_custkey = entity_id")
def f22(spark, d):
    out = dfs.feature_table(t1_spine(spark, d).select(*lb.KEYS), catalog(spark, d), "customer", {"orders": ["o_totalprice", "o_orderstatus"]}, ["c_mktsegment"])
    return out.select(*[r(c, 2 if "totalprice" in c and "_mean_" not in c else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("F24", _feature_sql("count(o_orderkey) as n_orders, round(avg(o_totalprice), 6) as mean_price"))
def f24(spark, d):
    from tidemark.sources.shared import shared_dir

    spine, feats = t1_spine(spark, d), [Feature("n_orders", "count"), Feature("mean_price", "mean", "o_totalprice")]
    version = str(load(spark, d, "orders").agg(src.checksum(load(spark, d, "orders"))).first()[0])
    out = src.cached_features(spark, f"{shared_dir(spark)}/tidemark/features", feats, version, spine, lambda: fs.compute(spine, orders_path(spark, d), feats))
    return out.withColumn("mean_price", r("mean_price"))


@query("F25", f"with {S}, a as (select entity_id, cutoff_time, count(o_orderkey) as n_orders from spine left join orders on o_custkey = entity_id and o_orderdate < cutoff_time group by 1, 2), b as (select entity_id, cutoff_time, count(o_custkey) as n_items from spine {ITEMS} group by 1, 2) select s.entity_id, s.cutoff_time, n_orders, n_items from spine s left join a using (entity_id, cutoff_time) left join b using (entity_id, cutoff_time)")
def f25(spark, d):
    spine = t1_spine(spark, d).select(*lb.KEYS)
    return fs.wide(spine, [fs.compute(spine, orders_path(spark, d), [Feature("n_orders", "count")]), fs.compute(spine, items_path(spark, d), [Feature("n_items", "count")])])


@query("F25_running", f"with {S} select entity_id, cutoff_time, count(o_custkey) as n, round(coalesce(sum(l_quantity), 0), 2) as quantity from spine {ITEMS} group by 1, 2")
def f25_running(spark, d):
    return fs.running(t1_spine(spark, d), items_path(spark, d), {"quantity": "l_quantity"}).withColumn("quantity", r("quantity", 2))


@query("F26", f"with {S} select count(*) filter (where entity_id % 10 = 0) as repeated_keys, count(*) filter (where entity_id % 10 = 2) as foreign_rows, count(*) filter (where entity_id % 10 = 1) as missing_rows from spine")
def f26(spark, d):
    """Faults are planted: of every ten entities one stands twice, one is left out, and one has a copy under a key of no entity."""
    spine, last = t1_spine(spark, d), F.col("entity_id") % 10
    made = fs.compute(spine, orders_path(spark, d), [Feature("value", "count")])
    key = lambda k: F.explode(F.when(last == 0, F.array(k, k)).when(last == 1, F.array().cast("array<bigint>")).when(last == 2, F.array(k, -1 - k)).otherwise(F.array(k)))
    return verify.contract(made.select(key(F.col("entity_id").cast("long")).alias("entity_id"), "cutoff_time", "value"), spine)


def _count(spine, tables):
    return fs.compute(spine, Path(tables["orders"], "o_custkey", "o_orderdate"), [Feature("value", "count", days=365)])


def _leaky(spine, tables):
    o = tables["orders"].groupBy("o_custkey").agg(F.count("*").alias("value"))
    return spine.select(*lb.KEYS).join(o, F.col("entity_id") == F.col("o_custkey"), "left").select(*lb.KEYS, "value")


@query("F27")
def f27(spark, d):
    t = {"orders": (load(spark, d, "orders"), "o_orderdate")}
    k = {"orders": ["o_custkey", "o_orderkey"]}
    good = verify.truncation(_count, t1_spine(spark, d), t, keys=k).agg(F.count("*").alias("changed")).select(F.lit("bounded").alias("feature"), "changed")
    return good.union(verify.truncation(_leaky, t1_spine(spark, d), t, keys=k).agg(F.count("*")).select(F.lit("unbounded"), "count(1)"))


@query("F28")
def f28(spark, d):
    lab = t1_labels(spark, d)
    return verify.sample_entities(lab, lab.count() // 4)


@query("F29")
def f29(spark, d):
    t = {"orders": (load(spark, d, "orders"), "o_orderdate")}
    k = {"orders": ["o_custkey", "o_orderkey"]}
    a = verify.accept(_count, t1_spine(spark, d), t, k).select(F.lit("bounded").alias("feature"), "*")
    return a.union(verify.accept(_leaky, t1_spine(spark, d), t, k).select(F.lit("unbounded"), "*"))


# ---- row formulas

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_K = "l_orderkey, l_linenumber"


def row_formula(name: str, text: str, sql: str) -> None:
    @query(name, f"select l_orderkey, l_linenumber, round({sql}, 6) as value from lineitem")
    def run(spark, d):
        return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(formula(text, _COLS)).alias("value"))


row_formula("R1", "l_extendedprice * (1 - l_discount) + -l_tax", "l_extendedprice * (1 - l_discount) + -l_tax")
row_formula("R2", "l_extendedprice / (l_quantity - 7)", "l_extendedprice / nullif(l_quantity - 7, 0)")
row_formula("R3", "(0 - l_quantity) // l_linenumber + (0 - l_quantity) % l_linenumber", "floor(-l_quantity / l_linenumber) + (-l_quantity - l_linenumber * floor(-l_quantity / l_linenumber))")
row_formula("R4", "l_quantity ** 2", "pow(l_quantity, 2)")
row_formula("R5", "2 < l_linenumber <= 5", "(case when 2 < l_linenumber and l_linenumber <= 5 then 1.0 else 0.0 end)::double")
row_formula("R6", "(l_quantity > 10) & ~(l_discount > 0.05) | (l_tax == 0)", "(case when (l_quantity > 10 and not l_discount > 0.05) or l_tax = 0 then 1.0 else 0.0 end)::double")
row_formula("R7", "log1p(l_quantity) + sqrt(l_quantity - 25) + abs(0 - l_tax)", "case when l_quantity >= 25 then ln(1 + l_quantity) + sqrt(l_quantity - 25) + abs(-l_tax) end")
row_formula("R8", "isnull(l_quantity / (l_linenumber - 1))", "(case when l_linenumber = 1 or l_quantity is null then 1.0 else 0.0 end)::double")
row_formula("R9", "minimum(l_quantity, l_linenumber) + maximum(l_tax, l_discount)", "least(l_quantity, l_linenumber) + greatest(l_tax, l_discount)")
row_formula("R10", "clip(l_quantity, 10, 20)", "least(greatest(l_quantity, 10), 20)::double")
row_formula("R11", "where(l_quantity > 25, l_tax, l_discount)", "case when l_quantity > 25 then l_tax else l_discount end")


# ---- splits


@query("S1", f"with {P} select * from parts")
def s1(spark, d):
    return parted(spark, d)


@query("S2", f"with {P} select part, count(*) as n, max(label_window_end) as max_window_end from parts group by part")
def s2(spark, d):
    return splits.summary(parted(spark, d))


@query("S3", f"with {P}, t as (select * from parts where part = 'train'), c as (select cutoff_time, ntile(3) over (order by cutoff_time) as block from (select distinct cutoff_time from t)), b as (select block, min(cutoff_time) as s from c group by 1) select t.*, " + ", ".join(f"case when block = {i + 1} then 'val' when block <= {i} and label_window_end <= (select s from b where block = {i + 1}) then 'train' end as fold_{i}" for i in (1, 2)) + " from t join c using (cutoff_time)")
def s3(spark, d):
    return splits.expanding_folds(parted(spark, d).where("part = 'train'"), 2)


@query("S4", f"with {P}, e as (select distinct entity_id, part from parts) select a.part, b.part as other, count(*) as n_entities from e a join e b using (entity_id) where a.part < b.part group by 1, 2")
def s4(spark, d):
    return splits.entity_overlap(parted(spark, d))


@query("S5", f"with {P} select cutoff_time, label_window_end, part, count(*) as n from parts group by all")
def s5(spark, d):
    return splits.timeline(parted(spark, d))


@query("S6")
def s6(spark, d):
    return splits.random_split(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus")


@query("S7")
def s7(spark, d):
    return splits.k_fold(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 5, "o_orderstatus")


@query("S8")
def s8(spark, d):
    return splits.repeated_k_fold(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 5, 3, "o_orderstatus")


@query("S9", "with x as (select o_orderkey, o_orderdate, row_number() over (order by o_orderkey) - 1 as r, (select count(*) from orders) as n from orders) select o_orderkey, o_orderdate, " + ", ".join(f"case when r >= n - {4 - i} * (n // 4) and r < n - {4 - i} * (n // 4) + n // 4 then 'val' when r < n - {4 - i} * (n // 4) - 10 then 'train' end as fold_{i}" for i in (1, 2, 3)) + " from x")
def s9(spark, d):
    return splits.time_series_folds(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 3, 10)


@query("S10")
def s10(spark, d):
    return splits.holdout(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


# ---- cleaning


@query("C1", " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as n_distinct, {'false' if f else ''}{'' if f else f'count(distinct {c}) = count(*)'} as is_id from orders" for c, f in (("o_orderkey", 0), ("o_custkey", 0), ("o_totalprice", 1), ("o_orderstatus", 0))))
def c1(spark, d):
    return clean.id_columns(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))


_TEXTED = "(select case when o_orderkey % 50 = 0 then 'n/a' else ' ' || o_orderkey::varchar || ' ' end as a, o_orderpriority as b from orders)"


@query("C2", " union all ".join(f"select '{c}' as column_name, count({c}) as present, count(try_cast(trim({c}) as double)) as parsed, count({c}) - count(try_cast(trim({c}) as double)) as failures, count(try_cast(trim({c}) as double)) >= 0.95 * count({c}) as is_numeric from {_TEXTED}" for c in ("a", "b")))
def c2(spark, d):
    t = load(spark, d, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" "))).alias("a"), F.col("o_orderpriority").alias("b"))
    return clean.numeric_text(t, ["a", "b"])


_HOLED = "(select o_orderkey, case when o_orderkey % 5 <> 0 then o_totalprice end as x, case when o_orderkey % 4 <> 0 then o_orderstatus end as s from orders)"


def holed(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("x"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("s"))


@query("C3", f"with t as {_HOLED} select o_orderkey, round(coalesce(x, (select quantile_cont(x, 0.5) from t)), 4) as x, coalesce(s, 'missing') as s from t")
def c3(spark, d):
    t = holed(spark, d)
    return clean.impute(clean.impute(t, t, "x", "median"), t, "s", "constant").withColumn("x", r("x", 4))


@query("C4", "with a as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s, min(o_custkey) as lo, max(o_custkey) as hi from orders) select o_orderkey, round((o_totalprice - m) / s, 6) as o_totalprice, round((o_custkey - lo)::double / (hi - lo), 6) as o_custkey from orders, a")
def c4(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = clean.scale(clean.scale(t, t, "o_totalprice", "standard"), t, "o_custkey", "min_max")
    return out.select("o_orderkey", r("o_totalprice").alias("o_totalprice"), r("o_custkey").alias("o_custkey"))


@query("C5", "with t as (select o_orderstatus, row_number() over (order by count(*) desc, o_orderstatus) as p from orders group by 1) select o_orderkey, " + ", ".join(f"(case when o_orderstatus = '{v}' then 1 else 0 end)::integer as \"s_{v}\"" for v in ("F", "O", "P")) + ", 0::integer as s_other from orders")
def c5(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return clean.one_hot(t, t, "s").select("o_orderkey", "s_F", "s_O", "s_P", "s_other")


@query("C6")
def c6(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return clean.target_encode(t, "o_orderpriority", "y", "o_orderkey")


@query("C7", "select o_orderkey, round(ln(1 + o_totalprice), 6) as o_totalprice from orders")
def c7(spark, d):
    t = load(spark, d, "orders")
    return clean.build(t, t, {"o_totalprice": ["log1p"]}, key="o_orderkey").withColumn("o_totalprice", r("o_totalprice"))


@query("C8")
def c8(spark, d):
    t = holed(spark, d)
    return clean.build(t, t, {"x": ["impute_median", "scale_robust"], "s": ["impute_most_frequent", "one_hot"]}, key="o_orderkey")


@query("C9", "with c as (select o_orderstatus = 'F' as b, count(*) as n from orders group by 1) select o_orderkey, (case when (o_orderstatus = 'F')::varchar = (select b::varchar from c order by n, b desc limit 1) then 1 else 0 end)::integer as label_code from orders")
def c9(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("string").alias("b"))
    return clean.label_encode(t, "b").select("o_orderkey", "label_code")


@query("C10", "select o_orderkey, case when o_orderpriority in (select o_orderpriority from orders where o_orderkey < 3) then o_orderpriority end as o_orderpriority from orders")
def c10(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return clean.to_category(t, t.where("o_orderkey < 3"), "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("C11", "select column_name, round(max(n)::double / sum(n), 6) as top_share, max(n)::double / sum(n) > 0.99 as drop from (select 'l_linestatus' as column_name, l_linestatus::varchar as v, count(*) as n from lineitem group by 2 union all select 'one', 'x', count(*) from lineitem) group by column_name")
def c11(spark, d):
    return clean.constant_columns(load(spark, d, "lineitem").withColumn("one", F.lit("x")), ["l_linestatus", "one"]).withColumn("top_share", r("top_share"))


@query("C12")
def c12(spark, d):
    t = load(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") * 2 + 1).alias("q2"), "l_extendedprice", "l_tax")
    return spark.createDataFrame(clean.duplicate_columns(t, t.columns), "column_name string, kept string")


@query("C15", "select o_totalprice::double as o_totalprice, round(epoch_us(o_orderdate) / 86400e6, 6) as o_orderdate, o_orderstatus from orders")
def c15(spark, d):
    return clean.model_frame(load(spark, d, "orders"), ["o_totalprice", "o_orderdate", "o_orderstatus"]).withColumn("o_orderdate", r("o_orderdate"))


# ---- leakage


@query("K1", "with n as (select count(*) as n, count(distinct o_orderkey) as a, count(distinct o_custkey) as b from orders) select 'o_orderkey' as column_name, round(a::double / n, 6) as distinct_share, true as rising, n >= 20 and a::double / n > 0.95 as flagged from n union all select 'o_custkey', round(b::double / n, 6), false, false from n")
def k1(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_custkey").withColumn("_o", F.col("o_orderkey"))
    return leakage.id_like(t, "_o", ["o_orderkey", "o_custkey"]).withColumn("distinct_share", r("distinct_share"))


@query("K2", "select 'code' as column_name, count(*) as n_pairs, count(distinct o_orderstatus) as n_values, true as flagged from orders union all select 'o_orderpriority', count(o_orderpriority), count(distinct o_orderpriority), false from orders")
def k2(spark, d):
    t = load(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.ascii("o_orderstatus").alias("code"))
    return leakage.target_copies(t, "o_orderstatus", ["code", "o_orderpriority"])


@query("K3", "with r as (select (rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0)::double as a, (rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0)::double as b from lineitem) select round(corr(a, b), 6) as spearman, abs(corr(a, b)) > 0.999 as flagged from r")
def k3(spark, d):
    return leakage.spearman(load(spark, d, "lineitem"), "l_extendedprice", "l_quantity").withColumn("spearman", r("spearman"))


@query("K5")
def k5(spark, d):
    t = load(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("y"), "l_quantity", "l_extendedprice", "l_tax")
    return leakage.single_feature(t, "y", ["l_quantity", "l_extendedprice", "l_tax"])


@query("K6", "with g as (select count(*) as n, count(distinct o_orderstatus) as k from orders group by o_custkey, o_orderpriority) select sum(n)::bigint as n_rows, sum(n - 1)::bigint as duplicates, round(sum(n - 1)::double / sum(n), 6) as share, count(*) filter (where n > 1 and k > 1) as mixed_groups, sum(n) >= 20 and sum(n - 1)::double / sum(n) > 0.05 as flagged from g")
def k6(spark, d):
    return leakage.duplicate_rows(load(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus").withColumn("share", r("share"))


@query("K7", "with s as (select (l_extendedprice - min(l_extendedprice) over ()) / (max(l_extendedprice) over () - min(l_extendedprice) over ()) as unit, l_tax from lineitem) select 'unit' as column_name, round(min(unit), 6) as min, round(max(unit), 6) as max, round(avg(unit), 6) as mean, round(stddev_samp(unit), 6) as std, true as flagged from s union all select 'l_tax', round(min(l_tax), 6), round(max(l_tax), 6), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6), false from s")
def k7(spark, d):
    t = load(spark, d, "lineitem")
    s = clean.scale(t.withColumn("unit", F.col("l_extendedprice")), t.withColumn("unit", F.col("l_extendedprice")), "unit", "min_max")
    out = leakage.normalised(s, ["unit", "l_tax"])
    return out.select("column_name", *[r(c).alias(c) for c in ("min", "max", "mean", "std")], "flagged")


@query("K8", "select 'day' as column_name, count(*) as present, count(*) as parsed, true as flagged from orders union all select 'o_orderpriority', count(o_orderpriority), 0, false from orders")
def k8(spark, d):
    t = load(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    return leakage.date_like(t, ["day", "o_orderpriority"])


@query("K9")
def k9(spark, d):
    t = load(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("churn"), F.ascii("o_orderstatus").alias("final_code"), "o_totalprice", "o_orderpriority")
    return leakage.scan(t, "churn", ["final_code", "o_totalprice", "o_orderpriority"])


# ---- metrics over a score made from the keys


def metric(name: str, sql: str, make) -> None:
    @query(name, f"with {SC} {sql}")
    def run(spark, d):
        out = make(scored(spark, d))
        return out.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


G = ", g as (select score as s, count(*) as n, sum(label) as pos from sc group by 1), q as (select *, sum(n) over (order by s desc) as cn, sum(pos) over (order by s desc) as cp from g)"
metric("V1", f"select 1", lambda t: metrics.average_precision(t, "score", "label"))
ORACLE_SQL["V1"] = f"with {SC}{G} select round(sum(pos * cp::double / cn) / sum(pos), 6) as pr_auc from q"
metric("V2", "", lambda t: metrics.roc_auc(t, "score", "label"))
ORACLE_SQL["V2"] = f"with {SC}, k as (select label, (rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0)::double as r from sc) select round((sum(case when label = 1 then r else 0 end) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::double * (count(*) - sum(label))), 6) as roc_auc from k"
_CUTS = "cuts as (select 'top_1pct' as cut, greatest(1, ceil(0.01 * n - 1e-9))::bigint as k from (select count(*) as n from sc) union all select 'top_5pct', greatest(1, ceil(0.05 * n - 1e-9))::bigint from (select count(*) as n from sc) union all select 'top_10pct', greatest(1, ceil(0.1 * n - 1e-9))::bigint from (select count(*) as n from sc) union all select 'top_100', least(100, n)::bigint from (select count(*) as n from sc))"
metric("V3", "", lambda t: metrics.top_k_metrics(t, "score", "label", "row_id"))
ORACLE_SQL["V3"] = f"with {SC}, {_CUTS}, k as (select label, row_number() over (order by score desc, row_id) as r from sc), t as (select sum(label)::double as t, count(*) as n from sc), x as (select cut, cuts.k, sum(label)::double as y from cuts join k on r <= cuts.k group by 1, 2) select cut, k, round(y / k, 6) as precision, round(y / t, 6) as recall, round(y / k / (t / n), 6) as lift from x, t"
metric("V4", "select round(avg(label), 6) as base_rate from sc", lambda t: metrics.base_rate(t, "label"))
metric("V5", "", lambda t: metrics.top_k_metrics(t, "score", "label", "row_id", value=True))
ORACLE_SQL["V5"] = f"with {SC}, {_CUTS}, k as (select label, row_number() over (order by score desc, row_id) as r from sc), t as (select sum(label)::double as t from sc) select cut, cuts.k, round(sum(label) / max(t), 6) as captured from cuts join k on r <= cuts.k, t group by 1, 2"
metric("V6", "select round(avg(pow(score - label, 2)), 6) as brier from sc", lambda t: metrics.brier(t, "score", "label"))
REL = ", rel as (select b.bin::integer as bin, count(label) as n, avg(score) as mean_p, avg(label) as rate from range(10) b(bin) left join sc on least(floor(score * 10), 9) = b.bin group by 1)"
metric("V7", "", lambda t: metrics.reliability(t, "score", "label"))
ORACLE_SQL["V7"] = f"with {SC}{REL} select bin, n, round(mean_p, 6) as mean_p, round(rate, 6) as rate from rel"
metric("V8", "", lambda t: metrics.calibration_error(t, "score", "label"))
ORACLE_SQL["V8"] = f"with {SC}{REL} select round(sum(n * abs(mean_p - rate)) / sum(n), 6) as ece from rel"
metric("V10", "", lambda t: metrics.best_threshold(t, "score", "label"))
ORACLE_SQL["V10"] = f"with {SC}{G}, f as (select s, 2.0 * cp / (cn + (select sum(pos) from g)) as f1 from q) select round(s, 6) as threshold, round(f1, 6) as f1 from f order by f1 desc, s desc limit 1"
_CM = ", c as (select count(*) filter (where label = 1 and pred = 1)::double as tp, count(*) filter (where label = 0 and pred = 1) as fp, count(*) filter (where label = 1 and pred = 0) as fn, avg((label = pred)::int) as a from sc) select round(a, 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c"
metric("V11", "", lambda t: metrics.classification(t, "label", "pred"))
ORACLE_SQL["V11"] = f"with {SC}{_CM}"
metric("V12_half", "", lambda t: metrics.classification(t.withColumn("pred", (F.col("score") >= 0.5).cast("int")), "label", "pred"))
ORACLE_SQL["V12_half"] = f"with {SC}{_CM}"


def _chosen(t: DataFrame) -> DataFrame:
    threshold = metrics.best_threshold(t.where("cutoff_time < timestamp_ntz '1996-07-01'"), "score", "label").first()["threshold"]
    return metrics.at_threshold(t.where("cutoff_time >= timestamp_ntz '1996-07-01'"), "score", "label", threshold)


metric("V12_threshold", "", _chosen)
ORACLE_SQL["V12_threshold"] = f"with {SC}, early as (select * from sc where cutoff_time < timestamp '1996-07-01'), g as (select score as s, count(*) as n, sum(label) as pos from early group by 1), q as (select s, sum(pos) over (order by s desc) as cp, sum(n) over (order by s desc) as cn from g), f as (select s, 2.0 * cp / (cn + (select sum(pos) from g)) as f1 from q), t as (select s as th from f order by f1 desc, s desc limit 1), c as (select th, count(*) filter (where label = 1 and score >= th)::double as tp, count(*) filter (where label = 0 and score >= th) as fp, count(*) filter (where label = 1 and score < th) as fn, avg(((label = 1) = (score >= th))::int) as a from sc, t where cutoff_time >= timestamp '1996-07-01' group by th) select round(th, 6) as threshold, round(a, 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c"


def _against_median(t: DataFrame) -> DataFrame:
    median = profile.quantile(t.where("cutoff_time <= timestamp_ntz '1996-04-01'"), "label", [0.5])[0]
    return metrics.regression(t.where("cutoff_time >= timestamp_ntz '1996-07-01'"), "label", "score", median)


metric("V13", "select round(avg(abs(label - score)), 6) as mae, round(sqrt(avg(pow(label - score, 2))), 6) as rmse, round(1 - avg(pow(label - score, 2)) / var_pop(label), 6) as r2, round(avg(abs((label - score) / label)) filter (where label <> 0), 6) as mape, round(avg(abs(label - (select quantile_cont(label::double, 0.5) from sc where cutoff_time <= timestamp '1996-04-01'))), 6)::double as trivial_mae from sc where cutoff_time >= timestamp '1996-07-01'", _against_median)


@query("V14", "with o as (select *, 1 + (o_orderkey % 3) as pick from orders where o_orderpriority is not null), k as (select o_orderpriority as y, case pick when 1 then '1-URGENT' when 2 then '3-MEDIUM' else '5-LOW' end as p, case when o_orderpriority = case pick when 1 then '1-URGENT' when 2 then '3-MEDIUM' else '5-LOW' end then 0.6 else 0.1 end as q from o where o_orderdate >= timestamp '1997-01-01'), tr as (select o_orderpriority as c, count(*)::double / sum(count(*)) over () as s from o where o_orderdate < timestamp '1997-01-01' and o_orderpriority <> '2-HIGH' group by 1), kn as (select k.*, s from k join tr on y = c), cl as (select y as c from kn union select p from kn), f as (select c, (select count(*) from kn where y = c and p = c)::double as tp, (select count(*) from kn where y = c) as t, (select count(*) from kn where p = c) as q from cl) select round((select avg(2 * tp / (t + q)) from f), 6) as macro_f1, round(avg((y = p)::int), 6) as accuracy, round(avg(-ln(q)), 6) as log_loss, round(avg(-ln(s)), 6) as trivial_log_loss, (select count(*) from k where y not in (select c from tr)) as n_unseen_class from kn")
def v14(spark, d):
    """The priority of orders from 1997 on; a class is kept out of training, so that some rows' class is unseen."""
    t = load(spark, d, "orders").where("o_orderpriority is not null").select("o_orderkey", "o_orderdate", "o_orderpriority")
    pick = F.col("o_orderkey") % 3
    t = t.withColumn("p", F.when(pick == 0, "1-URGENT").when(pick == 1, "3-MEDIUM").otherwise("5-LOW"))
    train, now = t.where("o_orderdate < timestamp_ntz '1997-01-01' and o_orderpriority <> '2-HIGH'"), t.where("o_orderdate >= timestamp_ntz '1997-01-01'")
    out = metrics.multiclass(now, "o_orderpriority", "p", F.when(F.col("o_orderpriority") == F.col("p"), 0.6).otherwise(0.1), train)
    return out.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


metric("V14_log_loss", "select round(avg(-ln(greatest(least(case when label = 1 then score else 1 - score end, 1.0), 1e-15))), 6) as log_loss from sc", lambda t: metrics.log_loss(t, F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))))
metric("V11_weighted", "", lambda t: metrics.classification_weighted(t, "label", "pred"))
ORACLE_SQL["V11_weighted"] = f"with {SC}, c as (select k, count(*) filter (where label = k)::double as t, count(*) filter (where pred = k)::double as q, count(*) filter (where label = k and pred = k)::double as tp from sc, range(2) r(k) group by k) select round(sum(tp) / sum(t), 6) as accuracy, round(sum(tp / q * t) / sum(t), 6) as precision, round(sum(tp / t * t) / sum(t), 6) as recall, round(sum(2 * tp / (t + q) * t) / sum(t), 6) as f1, round(avg(2 * tp / (t + q)), 6) as macro_f1 from c"


@query("M8", f"with {SC}, f as (select month(cutoff_time) as fold, avg(abs(label - 0.5)) as base, avg(abs(label - score)) as cand from sc group by 1) select round(avg(cand - base), 6)::double as mean_gain, round(stddev_samp(cand - base), 6)::double as std, round(avg(cand - base) - stddev_samp(cand - base) * 1.96 / sqrt(count(*)), 6)::double as ci_low, round(avg(cand - base) + stddev_samp(cand - base) * 1.96 / sqrt(count(*)), 6)::double as ci_high, avg(cand - base) > greatest(0.002, stddev_samp(cand - base)) as accepted from f")
def m8(spark, d):
    folds = scored(spark, d).groupBy(F.month("cutoff_time").alias("fold")).agg(F.avg(F.abs(F.col("label") - 0.5)).alias("base"), F.avg(F.abs(F.col("label") - F.col("score"))).alias("cand"))
    out = metrics.paired_gain(folds)
    return out.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# ---- scoring and drift


def last_scored(spark, d):
    return scored(spark, d).where("cutoff_time = timestamp_ntz '1996-12-01'")


@query("D2", f"with {SC}, k as (select entity_id, score, row_number() over (order by score desc, entity_id) as rank, count(*) over () as n from sc where cutoff_time = timestamp '1996-12-01') select entity_id, score, rank, least(10, 1 + (rank - 1) * 10 // n)::integer as decile from k")
def d2(spark, d):
    return scoring.rank_rows(last_scored(spark, d).select("entity_id", "score"))


_FEAT = S + ", ft as (select entity_id, cutoff_time, count(o_orderkey)::double as n_orders, avg(o_totalprice) as mean_price from spine left join orders on o_custkey = entity_id and o_orderdate < cutoff_time and o_orderdate >= cutoff_time - interval 90 day group by 1, 2)"


def drift_features(spark, d):
    return fs.compute(t1_spine(spark, d), orders_path(spark, d), [Feature("n_orders", "count", days=90), Feature("mean_price", "mean", "o_totalprice", days=90)])


_TRAIN, _NOW = "cutoff_time < timestamp '1996-07-01'", "cutoff_time = timestamp '1996-12-01'"
_EDGES = ", ed as (" + " union all ".join(f"select '{c}' as feature, list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as e from ft where {_TRAIN}" for c in ("n_orders", "mean_price")) + ")"


@query("D3", f"with {_FEAT} " + " union all ".join(f"select '{c}' as feature, round(avg(({c} is null)::int), 6) as null_rate, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, len(list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))::integer as n_edges from ft where {_TRAIN}" for c in ("n_orders", "mean_price")))
def d3(spark, d):
    s = scoring.feature_stats(drift_features(spark, d).where(_TRAIN.replace("timestamp", "timestamp_ntz")), ["n_orders", "mean_price"])
    return s.select("feature", r("null_rate").alias("null_rate"), r("mean", 4).alias("mean"), r("std", 4).alias("std"), F.size("edges").alias("n_edges"))


_PSI = _FEAT + _EDGES + ", v as (" + " union all ".join(f"select '{c}' as feature, {c} as x, {w} as now from ft where {c} is not null and ({_TRAIN} or {_NOW})" for c in ("n_orders", "mean_price") for w in (_NOW,)) + "), b as (select feature, now, len(list_filter(e, lambda t: t <= x)) as bin, count(*) as n from v join ed using (feature) group by 1, 2, 3), gr as (select feature, unnest(range(len(e) + 1)) as bin from ed), sh as (select g.feature, g.bin, coalesce(sum(n) filter (where not now), 0)::double / (select sum(n) from b z where z.feature = g.feature and not now) as a, coalesce(sum(n) filter (where now), 0)::double / (select sum(n) from b z where z.feature = g.feature and now) as c from gr g left join b using (feature, bin) group by 1, 2), psi as (select feature, sum((greatest(c, 1e-4) - greatest(a, 1e-4)) * ln(greatest(c, 1e-4) / greatest(a, 1e-4))) as psi from sh group by 1)"


@query("D4", f"with {_PSI} select feature, round(psi, 6) as psi from psi")
def d4(spark, d):
    f = written(drift_features(spark, d), "features")  # read several times below
    train, now = f.where(_TRAIN.replace("timestamp", "timestamp_ntz")), f.where(_NOW.replace("timestamp", "timestamp_ntz"))
    cols = ["n_orders", "mean_price"]
    return scoring.psi(train, now, cols, scoring.feature_stats(train, cols)).withColumn("psi", r("psi"))


@query("D5", f"with {_PSI}, st as (" + " union all ".join(f"select '{c}' as feature, avg(({c} is null)::int) filter (where {_TRAIN}) as n0, avg(({c} is null)::int) filter (where {_NOW}) as n1, avg({c}) filter (where {_TRAIN}) as m0, avg({c}) filter (where {_NOW}) as m1, stddev_samp({c}) filter (where {_TRAIN}) as s0 from ft" for c in ("n_orders", "mean_price")) + ") select feature, round(abs(n1 - n0), 6) as null_gap, round(abs(m1 - m0) / s0, 6) as mean_shift, round(psi, 6) as psi, abs(n1 - n0) > 0.1 as null_drift, coalesce(abs(m1 - m0) / s0 > 3, false) as mean_drift, psi > 0.2 as psi_drift from st join psi using (feature)")
def d5(spark, d):
    f = written(drift_features(spark, d), "features")  # read several times below
    out = scoring.drift(f.where(_TRAIN.replace("timestamp", "timestamp_ntz")), f.where(_NOW.replace("timestamp", "timestamp_ntz")), ["n_orders", "mean_price"])
    return out.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("D6", f"with {SC}, k as (select score, row_number() over (order by score desc, entity_id) as rank from sc where cutoff_time = timestamp '1996-12-01') select count(*) as n_scored, min(score) filter (where rank <= 100) as score_at_k, round(sum(score) filter (where rank <= 100), 6) as expected_in_top, round(sum(score), 6) as expected from k")
def d6(spark, d):
    out = scoring.summary(scoring.rank_rows(last_scored(spark, d).select("entity_id", "score")), 100)
    return out.select("n_scored", "score_at_k", r("expected_in_top").alias("expected_in_top"), r("expected").alias("expected"))


@query("D7_order", f"with {SC} select entity_id, score from sc where cutoff_time = timestamp '1996-12-01' order by score desc, entity_id limit 20")
def d7_order(spark, d):
    return last_scored(spark, d).select("entity_id", "score").orderBy(F.desc("score"), "entity_id").limit(20)


# ---- flagship


@query("T1", f"with {L} select entity_id, cutoff_time, label, " + ", ".join(f"count(o_orderkey) filter (where o_orderdate >= cutoff_time - interval {n} day) as n_{n}" for n in (7, 30, 90, 365)) + ", round(date_diff('second', max(o_orderdate), cutoff_time) / 86400.0::double, 6) as since_last from lab left join orders on o_custkey = entity_id and o_orderdate < cutoff_time group by 1, 2, 3")
def t1(spark, d):
    """Labels with windowed counts and recency: the minimum that answers a prediction question."""
    lab = t1_labels(spark, d)
    feats = [*[Feature(f"n_{n}", "count", days=n) for n in (7, 30, 90, 365)], Feature("since_last", "days_since_last")]
    out = fs.wide(lab.select(*lb.KEYS, "label"), [fs.compute(t1_spine(spark, d), orders_path(spark, d), feats)])
    return out.withColumn("since_last", r("since_last"))
