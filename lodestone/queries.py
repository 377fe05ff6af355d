"""Driver-facing queries for the engine's operators, each over whole tables, with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.engine import Engine
from lodestone.functions import scalar as S
from lodestone.functions.arith import compile_arithmetic
from lodestone.operators import constraints as C
from lodestone.operators import rewrite as R
from lodestone.operators.referential import NEW, OLD, Statement, rewritten
from lodestone.operators.select import SEQ, Query, select
from lodestone.plans.conditions import Conditions, condition, where
from lodestone.schema import CASCADE, RESTRICT, SET_DEFAULT, SET_NULL, ForeignKey, Schema
from lodestone.scratch import fresh, numbered
from lodestone.sources.storage import parquet_table
from lodestone.types import DataType

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}
_TYPES = {T.LongType: DataType.LONG, T.IntegerType: DataType.INT, T.DoubleType: DataType.DOUBLE, T.TimestampNTZType: DataType.TIMESTAMP, T.StringType: DataType.CHAR}
TEXT = 1 << 20


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table; ``key`` names a unique whole-number column that serves as the hidden row number."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn(SEQ, F.col(key).cast("long")) if key else df


def schema_of(df: DataFrame, primary: str | None = None, **defaults: object) -> Schema:
    out = Schema()
    for f in df.schema:
        if f.name != SEQ:
            out.column(f.name, _TYPES[type(f.dataType)], TEXT, primary=f.name == primary, default=defaults.get(f.name))
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is null in every seventh row."""
    return load(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


EVENTS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, props FROM events)"


def _pick(df: DataFrame, cond: Conditions | None, columns: str, **q: object) -> DataFrame:
    return select(df, schema_of(df, next((c for c in ("o_orderkey", "event_id") if c in df.columns), None)), Query(cond, columns=columns, **q))


# -- scans and projections ------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_star(spark, sf):
    return _pick(load(spark, sf, "nation"), None, "*")


@query("SELECT c_name, c_acctbal FROM customer")
def project_columns(spark, sf):
    return _pick(load(spark, sf, "customer"), None, "c_name , c_acctbal")


@query("SELECT n_name, n_name AS n_name_again FROM nation")
def project_duplicate(spark, sf):
    return _pick(load(spark, sf, "nation"), None, "n_name, n_name").toDF("n_name", "n_name_again")


@query("SELECT count(*) AS n FROM orders")
def project_nothing(spark, sf):
    """A blank column list keeps the number of rows."""
    return _pick(load(spark, sf, "orders"), None, " ").agg(F.count("*").alias("n"))


# -- predicates -----------------------------------------------------------------------------------


def _filter(name: str, table: Callable, cond: Callable[[], Conditions], columns: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _pick(table(spark, sf), cond(), columns)

    run.__name__ = name
    query(sql)(run)


def _orders(spark, sf):
    return load(spark, sf, "orders")


for _name, _cond, _sql in (
    ("filter_eq", lambda: where("value").is_equal(12.31), "value IS NOT DISTINCT FROM 12.31::DOUBLE"),
    ("filter_neq_null", lambda: where("value").is_not_equal(12.31), "value IS DISTINCT FROM 12.31::DOUBLE"),
    ("filter_is_null", lambda: where("value").is_null(), "value IS NULL"),
    ("filter_not_null", lambda: where("value").not_null(), "value IS NOT NULL"),
    ("filter_null_order", lambda: where("value").is_smaller(20.0), "value < 20"),
):
    _filter(_name, _events, _cond, "event_id, value", f"SELECT event_id, value FROM {EVENTS} WHERE {_sql}")
for _name, _cond, _sql in (
    ("filter_gt", lambda: where("o_totalprice").is_bigger(250000.0), "o_totalprice > 250000"),
    ("filter_lt", lambda: where("o_totalprice").is_smaller(100000), "o_totalprice < 100000"),
    ("filter_ge", lambda: where("o_custkey").is_bigger_or_equal(700), "o_custkey >= 700"),
    ("filter_le", lambda: where("o_custkey").is_smaller_or_equal(70), "o_custkey <= 70"),
    ("filter_between", lambda: where("o_orderkey").is_bigger_or_equal(1000).is_smaller_or_equal(1010), "o_orderkey BETWEEN 1000 AND 1010"),
    ("filter_multi", lambda: where("o_totalprice").is_bigger(100000.0).is_smaller(150000.0).is_not_equal(112946.26), "o_totalprice > 100000 AND o_totalprice < 150000 AND o_totalprice <> 112946.26"),
    ("filter_repeated_operator", lambda: where("o_custkey").is_bigger(10).is_bigger(900), "o_custkey > 900"),
    ("filter_and", lambda: where("o_totalprice").is_bigger(100000.0).AND().column("o_orderstatus").is_equal("F"), "o_totalprice > 100000 AND o_orderstatus = 'F'"),
    ("filter_or", lambda: where("o_orderkey").is_smaller(50).OR().column("o_orderstatus").is_equal("P"), "o_orderkey < 50 OR o_orderstatus = 'P'"),
    ("filter_left_fold", lambda: where("o_orderstatus").is_equal("F").OR().column("o_orderstatus").is_equal("P").AND().column("o_totalprice").is_bigger(200000.0), "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 200000"),
    ("index_point_lookup", lambda: where("o_orderkey").is_equal(777), "o_orderkey = 777"),
    ("index_range_scan", lambda: where("o_orderkey").is_bigger_or_equal(14000), "o_orderkey >= 14000"),
):
    _filter(_name, _orders, _cond, "o_orderkey, o_custkey, o_orderstatus, o_totalprice", f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE {_sql}")


def _checked(df: DataFrame, cond: Conditions) -> Column:
    from lodestone.plans.conditions import fold

    s = schema_of(df)
    return fold(cond.items, {c: F.col(c) for c in s.names}, s.types, False)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 OR (l_returnflag = 'A' AND (l_discount > 0.08 OR l_tax < 0.01))")
def check_group_nested(spark, sf):
    df = load(spark, sf, "lineitem")
    c = condition("l_quantity").is_bigger(45.0).OR().open().column("l_returnflag").is_equal("A").AND().open().column("l_discount").is_bigger(0.08).OR().column("l_tax").is_smaller(0.01).close().close()
    return df.where(_checked(df, c)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 60000")
def check_expression(spark, sf):
    df = load(spark, sf, "lineitem")
    return df.where(_checked(df, condition().expression("l_extendedprice * (1 - l_discount)").is_bigger(60000.0))).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(f"SELECT event_id FROM {EVENTS} WHERE NOT coalesce(value <> 12.31, false)")
def check_null_fails(spark, sf):
    df = _events(spark, sf)
    s = schema_of(df).check("odd", condition("value").is_not_equal(12.31))
    return C.check_violations(df, s, "odd").select("event_id")


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 899) AS found")
def exists_value(spark, sf):
    df = load(spark, sf, "orders")
    return _pick(df, where("o_custkey").is_equal(899), "o_orderkey").limit(1).agg((F.count("*") > 0).alias("found"))


# -- order and paging -----------------------------------------------------------------------------


def _keyed(spark, sf):
    return load(spark, sf, "orders", "o_orderkey")


def _positions(spark: SparkSession, sf: str, ascending: bool) -> DataFrame:
    """Every event and its position in the operator's order."""
    df = _events(spark, sf).withColumn(SEQ, F.col("event_id"))
    return numbered(_pick(df, None, "event_id, value", order=("value", ascending)), "position", 1)


@query(f"SELECT event_id, value, row_number() OVER (ORDER BY value ASC NULLS FIRST, event_id) AS position FROM {EVENTS}")
def order_nulls_asc(spark, sf):
    """Nulls come first."""
    return _positions(spark, sf, True)


@query(f"SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS position FROM {EVENTS}")
def order_nulls_desc(spark, sf):
    """Nulls come last."""
    return _positions(spark, sf, False)


@query("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 10)")
def page_then_sort(spark, sf):
    """The page is taken in the order of the rows and only then sorted by price."""
    c = where("o_totalprice").is_bigger_or_equal(100000.0).AND().column("o_orderstatus").is_equal("F")
    return _pick(_keyed(spark, sf), c, "o_orderkey, o_totalprice", begin=10, limit=25, order=("o_totalprice", False))


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100)")
def offset_only(spark, sf):
    return _pick(_keyed(spark, sf), None, "o_orderkey", begin=100)


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(spark, sf):
    return _pick(_keyed(spark, sf), None, "o_orderkey", limit=0)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 20 OR o_orderstatus = 'P' ORDER BY CASE WHEN o_orderkey < 20 THEN 0 ELSE 1 END, o_orderkey LIMIT 100")
def access_order_or(spark, sf):
    """Rows that the second condition brings in follow those of the first."""
    return _pick(_keyed(spark, sf), where("o_orderkey").is_smaller(20).OR().column("o_orderstatus").is_equal("P"), "o_orderkey", limit=100)


@query("SELECT max(o_orderkey) AS max_key FROM orders")
def max_key(spark, sf):
    return load(spark, sf, "orders").agg(F.max("o_orderkey").alias("max_key"))


@query("SELECT count(*) AS affected FROM orders WHERE o_orderstatus = 'F'")
def affected_count(spark, sf):
    df = load(spark, sf, "orders")
    return R.chosen(df, schema_of(df), Query(where("o_orderstatus").is_equal("F"))).agg(F.count("*").alias("affected"))


@query("SELECT l_orderkey, count(*) AS \"count\" FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return C.duplicate_keys(load(spark, sf, "lineitem"), "l_orderkey")


# -- foreign keys ---------------------------------------------------------------------------------

_LINES = ForeignKey("line_order", ["l_orderkey"], "orders", ["o_orderkey"])
_NATION = ForeignKey("nation_region", ["n_regionkey"], "region", ["r_regionkey"])


def _some_orders(spark, sf):
    return load(spark, sf, "orders").where(F.col("o_orderstatus") != "F")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey = l_orderkey)")
def fk_orphans(spark, sf):
    return C.orphans(load(spark, sf, "lineitem"), _some_orders(spark, sf), _LINES).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey = l_orderkey)")
def fk_valid_rows(spark, sf):
    return C.referencing(load(spark, sf, "lineitem"), _some_orders(spark, sf), _LINES).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)")
def fk_restrict_blockers(spark, sf):
    doomed = load(spark, sf, "region").where("r_regionkey < 2")
    return C.referencing(load(spark, sf, "nation"), doomed, _NATION).select("n_nationkey", "n_name")


def _moved(df: DataFrame, old: str, new: Column | None = None) -> DataFrame:
    return df.select(F.col(old).alias(f"{OLD}0"), *([new.alias(f"{NEW}0")] if new is not None else []))


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey < 2 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def fk_set_null(spark, sf):
    df = load(spark, sf, "nation")
    return rewritten(df, _moved(load(spark, sf, "region").where("r_regionkey < 2"), "r_regionkey"), _NATION, schema_of(df), SET_NULL)


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey < 2 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation")
def fk_set_default(spark, sf):
    df = load(spark, sf, "nation")
    return rewritten(df, _moved(load(spark, sf, "region").where("r_regionkey < 2"), "r_regionkey"), _NATION, schema_of(df, n_regionkey=4), SET_DEFAULT)


@query("SELECT c_custkey, c_nationkey + 100 AS c_nationkey FROM customer")
def fk_update_cascade(spark, sf):
    df = load(spark, sf, "customer")
    key = ForeignKey("customer_nation", ["c_nationkey"], "nation", ["n_nationkey"])
    moved = _moved(load(spark, sf, "nation"), "n_nationkey", F.col("n_nationkey") + 100)
    return rewritten(df, moved, key, schema_of(df), CASCADE).select("c_custkey", "c_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)")
def fk_update_restrict(spark, sf):
    """Children that forbid a change of their parent's key; rows whose key stays forbid nothing."""
    moved = load(spark, sf, "region").withColumn("new", F.when(F.col("r_regionkey") < 2, F.col("r_regionkey") + 10).otherwise(F.col("r_regionkey"))).where(~F.col("new").eqNullSafe(F.col("r_regionkey")))
    return C.referencing(load(spark, sf, "nation"), moved, _NATION).select("n_nationkey")


# -- delete and update ----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)")
def delete_where(spark, sf):
    df = load(spark, sf, "orders")
    return R.delete(df, schema_of(df), Query(where("o_orderstatus").is_equal("F").AND().column("o_totalprice").is_bigger(100000.0))).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50)")
def delete_limit(spark, sf):
    df = _keyed(spark, sf)
    return R.delete(df, schema_of(df), Query(where("o_orderstatus").is_equal("F"), limit=50)).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, sf):
    """Orders go, and the lines that name them."""
    orders, lines = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    schemas = {"orders": schema_of(orders, "o_orderkey"), "lineitem": schema_of(lines).foreign_key("line_order", "l_orderkey", "orders", "o_orderkey", CASCADE)}
    tables = {"orders": orders.withColumn(SEQ, F.col("o_orderkey")), "lineitem": lines.withColumn(SEQ, F.lit(0).cast("long"))}
    q = Query(where("o_orderstatus").is_equal("F"))
    s = Statement(tables, schemas)
    s.delete("orders", R.delete(tables["orders"], schemas["orders"], q), R.chosen(tables["orders"], schemas["orders"], q))
    return s.now("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


def _updated(spark: SparkSession, sf: str, what: R.Update, cond: Conditions | None = None, limit: int = -1, **defaults: object) -> DataFrame:
    df = load(spark, sf, "part", "p_partkey")
    return R.update(df, schema_of(df, **defaults), Query(cond, limit=limit), what).select("p_partkey", "p_name", "p_size", "p_retailprice")


def _part(name: str = "p_name", size: str = "p_size", price: str = "p_retailprice") -> str:
    return f"SELECT p_partkey, {name} AS p_name, {size} AS p_size, {price} AS p_retailprice FROM part"


@query(_part(size="CASE WHEN p_size > 25 THEN 7 ELSE p_size END"))
def update_set(spark, sf):
    return _updated(spark, sf, R.Update().column("p_size").set(7), where("p_size").is_bigger(25))


@query(_part(name="upper(p_name) || '!'", size="CAST((p_size + 1) * 2 AS INTEGER)", price="p_retailprice + (p_size + 1) * 2"))
def update_sequential(spark, sf):
    """Each assignment sees the ones before it."""
    u = R.Update().column("p_size").operation("p_size + 1").operation("p_size * 2").column("p_retailprice").operation("p_retailprice + p_size")
    return _updated(spark, sf, u.column("p_name").apply(S.upper_case()).apply(lambda c: F.concat(c, F.lit("!"))))


@query(_part(size="CASE WHEN p_size > 20 THEN 1 ELSE p_size END", name="CASE WHEN p_size > 20 THEN reverse(p_name) ELSE p_name END", price="CASE WHEN p_size <= 5 OR p_size > 20 THEN 0 ELSE p_retailprice END"))
def update_conditional(spark, sf):
    u = R.Update().condition(condition("p_size").is_bigger(20)).column("p_size").set(1).column("p_name").apply(S.reverse()).end_condition()
    u.condition(condition("p_size").is_smaller_or_equal(5)).column("p_retailprice").set(0.0).end_condition()
    return _updated(spark, sf, u)


@query(_part(size="CASE WHEN p_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 30) THEN 0 ELSE p_size END"))
def update_limit(spark, sf):
    return _updated(spark, sf, R.Update().column("p_size").set(0), where("p_size").is_bigger(10), limit=30)


@query(_part(size="CASE WHEN p_partkey < 100 THEN 18 ELSE p_size END"))
def update_default(spark, sf):
    return _updated(spark, sf, R.Update().column("p_size").set_default(), where("p_partkey").is_smaller(100), p_size=18)


# -- arithmetic -----------------------------------------------------------------------------------


def _computed(name: str, table: str, key: str, text: str, double: bool, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = load(spark, sf, table)
        keys = [F.col(k) for k in key.split(", ")]
        return df.select(*keys, compile_arithmetic(text, {c: F.col(c) for c in df.columns}, double).alias("result"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS result FROM {table}")(run)


_computed("op_long", "part", "p_partkey", "((p_size + 3) * 4 - 10 / 3 + 10 % 4) * -1 / 7", False, "CAST(-((p_size + 3) * 4 - 3 + 2) // 7 AS BIGINT)")
_computed("op_double", "lineitem", "l_orderkey, l_partkey, l_linenumber", "l_extendedprice * (1 - l_discount) / l_quantity", True, "l_extendedprice * (1 - l_discount) / l_quantity")
_computed("op_power", "part", "p_partkey", "-p_size ^ 2 + 2 ^ 3 ^ 2 + p_size ^ (p_size % 4)", False, "CAST(-(p_size * p_size) + 512 + pow(p_size, p_size % 4) AS BIGINT)")
_computed("op_modulo", "part", "p_partkey", "(5 - p_size) % 7", False, "CAST((5 - p_size) % 7 AS BIGINT)")

# -- text -----------------------------------------------------------------------------------------


def _text(name: str, column: str, fn: S.Fn, sql: str, prepare: Callable[[Column], Column] | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = F.col(column)
        return load(spark, sf, "part").select("p_partkey", fn(prepare(c) if prepare else c).alias("result"))

    run.__name__ = name
    query(f"SELECT p_partkey, {sql} AS result FROM part")(run)


_text("str_upper", "p_name", S.upper_case(), "upper(p_name)")
_text("str_lower", "p_type", S.lower_case(), "lower(p_type)")
_text("str_trim", "p_name", S.trim(), "p_name", lambda c: F.concat(F.lit("\t \n\x01"), c, F.lit(" \r\n ")))
_text("str_substring", "p_name", S.substring(1, 3), "substring(p_name, 2, 3)")
_text("str_substring_clamped", "p_name", S.substring(-1, 3), "substring(p_name, 1, 2)")
_text("str_left", "p_name", S.left(4), "left(p_name, 4)")
_text("str_right", "p_name", S.right(4), "right(p_name, 4)")
_text("str_replace", "p_name", S.replace("red", "blue"), "replace(p_name, 'red', 'blue')")
_text("str_regexp", "p_brand", S.regexp_replace(r"(\w+)#(\d+)", "$2-$1"), r"regexp_replace(p_brand, '(\w+)#(\d+)', '\2-\1', 'g')")
_text("str_lpad", "p_name", S.left_pad(10, "0"), "CASE WHEN length(p_name) >= 10 THEN p_name ELSE lpad(p_name, 10, '0') END")
_text("str_rpad", "p_name", S.right_pad(10, "xy"), "CASE WHEN length(p_name) >= 10 THEN p_name ELSE rpad(p_name, 10, 'xy') END")
_text("str_reverse", "p_name", S.reverse(), "reverse(p_name)")
_text("str_concat", "p_name", lambda c: S.concat("Hello", None, " ", F.col("p_brand"), 123)(c), "'Hello ' || p_brand || '123'")

# -- time -----------------------------------------------------------------------------------------


@query("SELECT event_id, ts + INTERVAL 5 DAY AS days, ts + INTERVAL 1 MONTH AS months, ts + INTERVAL 2 YEAR AS years, ts + INTERVAL 90 MINUTE AS minutes, ts AS same FROM events")
def ts_add(spark, sf):
    c = F.col("ts")
    return load(spark, sf, "events").select(
        "event_id", S.date_add("days", 5)(c).alias("days"), S.date_add("months", 1)(c).alias("months"), S.date_add("years", 2)(c).alias("years"),
        S.date_add("minutes", 90)(c).alias("minutes"), S.date_add("fortnights", 1)(c).alias("same"),
    )


@query("SELECT event_id, ts - INTERVAL 10 DAY AS days, ts - INTERVAL 3 HOUR AS hours, ts - INTERVAL 7 SECOND AS seconds FROM events")
def ts_sub(spark, sf):
    c = F.col("ts")
    return load(spark, sf, "events").select("event_id", *(S.date_subtract(u, n)(c).alias(u) for u, n in (("days", 10), ("hours", 3), ("seconds", 7))))


_PARTS = ("year", "month", "day", "hour", "minute", "second")


@query("SELECT event_id, " + ", ".join(f"CAST(extract({p} FROM ts) AS INTEGER) AS {p}_part" for p in _PARTS) + " FROM events")
def ts_extract(spark, sf):
    return load(spark, sf, "events").select("event_id", *(S.extract_part(p)(F.col("ts")).alias(f"{p}_part") for p in _PARTS))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def ts_format(spark, sf):
    return load(spark, sf, "events").select("event_id", S.format_date("yyyy-MM-dd HH:mm:ss")(F.col("ts")).alias("text"))


@query("SELECT o_orderkey, datesub('day', o_orderdate, TIMESTAMP '2001-03-04 05:06:07') AS days, datesub('hour', o_orderdate, TIMESTAMP '2001-03-04 05:06:07') AS hours FROM orders")
def ts_diff(spark, sf):
    to = F.lit("2001-03-04 05:06:07").cast("timestamp_ntz")
    return load(spark, sf, "orders").select("o_orderkey", *(S.date_difference(F.col("o_orderdate"), to, u).alias(u) for u in ("days", "hours")))


@query("SELECT count(*) AS n, count(*) AS filled, true AS recent FROM nation")
def current_timestamp(spark, sf):
    """How many rows, how many with a time, and whether all times are of the last hour."""
    df = load(spark, sf, "nation").withColumn("at", F.lit(None).cast("timestamp_ntz"))
    df = R.update(df, schema_of(df), Query(), R.Update().column("at").current_timestamp())
    age = F.abs(F.timestamp_diff("SECOND", F.col("at"), F.localtimestamp()))
    return df.agg(F.count("*").alias("n"), F.count("at").alias("filled"), F.every(age < 3600).alias("recent"))


# -- insert and constraints -----------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100 + n_nationkey, 'UNNAMED', n_regionkey FROM nation")
def insert_defaults(spark, sf):
    df = load(spark, sf, "nation")
    rows = df.select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_regionkey")
    return df.unionByName(R.aligned(rows, schema_of(df, "n_nationkey", n_name="UNNAMED")))


@query("SELECT s_name, row_number() OVER (ORDER BY s_suppkey) + (SELECT max(p_partkey) FROM part) AS id FROM supplier")
def insert_auto_increment(spark, sf):
    """Rows without a number continue behind the largest one."""
    top = load(spark, sf, "part").agg(F.max("p_partkey")).first()[0]
    rows = load(spark, sf, "supplier", "s_suppkey").select("s_name", F.lit(None).cast("long").alias("id"), SEQ)
    return R.auto_increment(rows, "id", top + 1).select("s_name", "id")


@query(f"SELECT event_id FROM {EVENTS} WHERE value IS NULL")
def constraint_not_null(spark, sf):
    return C.null_violations(_events(spark, sf), "value").select("event_id")


@query("SELECT user_id, count(*) AS \"count\" FROM events GROUP BY user_id HAVING count(*) > 1")
def constraint_unique(spark, sf):
    return C.duplicate_keys(load(spark, sf, "events"), "user_id")


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) > 10")
def constraint_size(spark, sf):
    return C.size_violations(load(spark, sf, "part"), "p_name", 10).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size >= 18 AND p_size < 40)")
def constraint_check(spark, sf):
    df = load(spark, sf, "part")
    s = schema_of(df).check("size_check", condition("p_size").is_bigger_or_equal(18).AND().column("p_size").is_smaller(40))
    return C.check_violations(df, s, "size_check").select("p_partkey", "p_size")


# -- engine ---------------------------------------------------------------------------------------


def _engine(spark: SparkSession, sf: str) -> Engine:
    e = Engine(spark).add_database("main")
    region, nation = load(spark, sf, "region"), load(spark, sf, "nation")
    e.create_table("region", schema_of(region, "r_regionkey"), region)
    s = schema_of(nation, "n_nationkey", n_regionkey=0).foreign_key("nation_region", "n_regionkey", "region", "r_regionkey", CASCADE, RESTRICT)
    return e.create_table("nation", s, nation)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def txn_rollback(spark, sf):
    e = _engine(spark, sf).begin("outer").begin("inner")
    e.delete("region")
    return e.rollback().select("*").from_("nation").to_df()


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def txn_commit(spark, sf):
    e = _engine(spark, sf).begin("outer")
    e.delete("region", where("r_regionkey").is_equal(1))
    e.begin("inner").update("nation", R.Update().column("n_name").set("two"), where("n_regionkey").is_equal(2))
    return e.commit().commit().select("*").from_("nation").to_df()


_NATION_COLUMNS = (("n_nationkey", "INT", 4, "PRIMARY KEY, NOT NULL", None), ("n_name", "CHAR", TEXT, "", None), ("n_regionkey", "INT", 4, "", "0"))


def _values(rows: tuple[tuple, ...], names: str) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int | bool) else f"'{v}'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


@query(_values(_NATION_COLUMNS, '"column", "type", "size", "constraints", "default"'))
def describe_table(spark, sf):
    return _engine(spark, sf).describe_table("nation")


_TABLES = tuple((t, c, k) for t, cs in (("nation", _NATION_COLUMNS), ("region", (("r_regionkey", "INT"), ("r_name", "CHAR")))) for c, k, *_ in cs)


@query(_values(_TABLES, '"table", "column", "type"'))
def describe_database(spark, sf):
    return _engine(spark, sf).describe_database()


@query(_values(tuple(("main", *r) for r in _TABLES), '"database", "table", "column", "type"'))
def describe_all(spark, sf):
    return _engine(spark, sf).add_database("other").describe_all()


# Statements through the engine, over whole tables.


def _shop(spark: SparkSession, sf: str, path: str | None = None, on_delete: str = CASCADE, on_update: str = RESTRICT) -> Engine:
    """Customers, orders and lines, each a child of the one before."""
    e = Engine(spark, path).add_database("shop")
    for name, key, own, parent, its in (("customer", "c_custkey", "", "", ""), ("orders", "o_orderkey", "o_custkey", "customer", "c_custkey"), ("lineitem", None, "l_orderkey", "orders", "o_orderkey")):
        df = parquet_table(spark, f"{sf}/{name}.parquet")
        s = schema_of(df, key, **({own: 1} if own else {}))
        e.create_table(name, s.foreign_key(f"{name}_{parent}", own, parent, its, on_delete, on_update) if parent else s, df)
    return e


def _count(n: int) -> Column:
    return F.lit(n).cast("long")


def _raised(run: Callable[[], object]) -> bool:
    try:
        run()
    except Exception:
        return True
    return False


@query("SELECT p_name, row_number() OVER (ORDER BY p_partkey) + 500 AS id, 'new' AS state FROM part UNION ALL SELECT 'first', 500, NULL")
def engine_insert(spark, sf):
    """Rows get defaults for what they leave out and numbers behind the largest one that was given."""
    s = Schema().column("id", auto_increment=True, primary=True).column("p_name", "CHAR", 60, required=True).column("state", "CHAR", 9, default="new")
    e = Engine(spark).add_database("main").create_table("t", s)
    e.insert("t", {"p_name": "first", "id": 500, "state": None})
    e.insert_df("t", load(spark, sf, "part").orderBy("p_partkey").select("p_name"))
    return e.select("p_name, id, state").from_("t").to_df()


@query("SELECT 3 AS refused, (SELECT count(*) FROM nation) AS n")
def engine_insert_error(spark, sf):
    """A repeated key, an orphan and a broken expression: none of their rows stays."""
    e = _engine(spark, sf)
    rows = load(spark, sf, "nation").select((F.col("n_nationkey") + 1000).alias("n_nationkey"), "n_name", "n_regionkey")
    bad = (rows.withColumn("n_nationkey", F.when(F.col("n_nationkey") == 1007, 7).otherwise(F.col("n_nationkey"))), rows.withColumn("n_regionkey", F.col("n_regionkey") + 1), rows.withColumn("n_regionkey", F.expr("100 div n_regionkey")))
    refused = sum(_raised(lambda df=df: e.insert_df("nation", df)) for df in bad)
    return e.table("nation").agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN (p_size + 1) * 2 ELSE p_size END::INTEGER AS p_size FROM part")
def engine_update(spark, sf):
    df = load(spark, sf, "part")
    e = Engine(spark).add_database("main").create_table("part", schema_of(df, "p_partkey"), df)
    e.update("part", R.Update().column("p_size").operation("p_size + 1").operation("p_size * 2").column("p_name").apply(S.upper_case()), where("p_size").is_bigger(25))
    return e.select("p_partkey, p_name, p_size").from_("part").to_df()


@query("SELECT p_partkey, p_size, 5 AS refused FROM part")
def engine_update_error(spark, sf):
    """Division by zero, overflow, a null operand, a bad cast and a check that breaks late: each is refused whole."""
    df = load(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.when(F.col("p_partkey") % 50 != 0, F.col("p_size")).alias("spare"))
    s = schema_of(df, "p_partkey").check("least", condition("p_size").is_bigger_or_equal(1))
    e = Engine(spark).add_database("main").create_table("part", s, df)
    size = lambda: R.Update().column("p_size")
    bad = (size().operation("100 / (p_size - 7)"), size().operation("p_size + 9223372036854775807"), size().operation("p_size + spare"), size().apply(lambda _: F.col("p_name")), size().operation("p_size - 49"))
    refused = sum(_raised(lambda u=u: e.update("part", u)) for u in bad)
    return e.select("p_partkey, p_size").from_("part").to_df().withColumn("refused", F.lit(refused))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 2000))")
def engine_delete(spark, sf):
    """Customers go, their orders, and the lines of those."""
    e = _shop(spark, sf)
    e.delete("customer", where("c_acctbal").is_smaller(2000))
    return e.select("l_orderkey, l_linenumber, l_partkey").from_("lineitem").to_df()


@query("SELECT true AS refused, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM lineitem) AS lines")
def engine_delete_restrict(spark, sf):
    e = _shop(spark, sf, on_delete=RESTRICT)
    refused = _raised(lambda: e.delete("customer", where("c_acctbal").is_smaller(2000)))
    return spark.range(1).select(F.lit(refused).alias("refused"), _count(e.size("customer")).alias("customers"), _count(e.size("lineitem")).alias("lines"))


@query("SELECT o_orderkey, o_custkey + 1000000 AS o_custkey FROM orders")
def engine_update_cascade(spark, sf):
    """Customers get other keys, and orders follow."""
    e = _shop(spark, sf, on_update=CASCADE)
    e.update("customer", R.Update().column("c_custkey").operation("c_custkey + 1000000"))
    return e.select("o_orderkey, o_custkey").from_("orders").to_df()


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000 AND c_custkey <> 1) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def engine_delete_set_null(spark, sf):
    """Keys of customers that are gone become null, which refers to nothing."""
    e = _shop(spark, sf, on_delete=SET_NULL)
    e.delete("customer", where("c_acctbal").is_smaller(2000).AND().column("c_custkey").is_not_equal(1))
    return e.select("o_orderkey, o_custkey").from_("orders").to_df()


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000 AND c_custkey <> 1) THEN 1 ELSE o_custkey END AS o_custkey FROM orders")
def engine_delete_set_default(spark, sf):
    e = _shop(spark, sf, on_delete=SET_DEFAULT)
    e.delete("customer", where("c_acctbal").is_smaller(2000).AND().column("c_custkey").is_not_equal(1))
    return e.select("o_orderkey, o_custkey").from_("orders").to_df()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 ORDER BY o_orderkey LIMIT 40 OFFSET 7)")
def engine_select_unselected_order(spark, sf):
    """A page, sorted by a column that is not selected."""
    e = _shop(spark, sf)
    return e.select("o_orderkey").from_("orders").where(where("o_totalprice").is_bigger(50000)).begin(7).limit(40).DEC("o_totalprice").to_df()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def engine_reopen(spark, sf):
    """What was committed is there for the next engine over the same path; what was not is not."""
    path = fresh(spark, "database")
    e = _shop(spark, sf, path)
    e.delete("orders", where("o_orderstatus").is_equal("F"))
    e.begin().delete("lineitem")
    e.rollback().close()
    e.begin().delete("orders")
    again = Engine(spark, path).add_database("shop")
    for name in ("customer", "orders", "lineitem"):
        again.create_table(name, e.schema(name))
    return again.select("o_orderkey, o_orderstatus").from_("orders").to_df()


@query("SELECT (SELECT count(*) FROM orders) AS orders, EXISTS (SELECT 1 FROM orders WHERE o_custkey = 7) AS seven, false AS minus")
def engine_size_and_contains(spark, sf):
    e = _shop(spark, sf)
    return spark.range(1).select(_count(e.size("orders")).alias("orders"), F.lit(e.contains("orders", "o_custkey", 7)).alias("seven"), F.lit(e.contains("orders", "o_custkey", -7)).alias("minus"))


@query("SELECT 0 AS in_transaction, count(*) AS after_rollback, (SELECT count(*) FROM orders) AS at_last FROM orders")
def engine_snapshots(spark, sf):
    """A select inside a transaction sees its changes, one made before it goes on seeing what was there."""
    e = _shop(spark, sf)
    before = e.select().from_("orders").to_df()
    e.begin().delete("orders")
    inside = e.size("orders")
    e.rollback()
    after = e.size("orders")
    e.begin().delete("orders")
    e.commit()
    return before.agg(F.lit(inside).alias("in_transaction"), _count(after).alias("after_rollback"), F.count("*").alias("at_last"))


_GUARDS = (
    ("check of an unknown column", lambda e: Schema().column("a", "INT").check("c", condition("b").is_null()).validate({})),
    ("expression with an unknown column", lambda e: Schema().column("a", "INT").check("c", condition().expression("a + b").is_bigger(1)).validate({})),
    ("foreign key to no key", lambda e: Schema().column("a", "CHAR", 9).foreign_key("f", "a", "nation", "n_name").validate({"nation": e.schema("nation")})),
    ("foreign key of another type", lambda e: Schema().column("a", "LONG").foreign_key("f", "a", "nation", "n_nationkey").validate({"nation": e.schema("nation")})),
    ("foreign key of another length", lambda e: Schema().column("a", "INT").foreign_key("f", ["a", "a"], "nation", "n_nationkey").validate({"nation": e.schema("nation")})),
    ("foreign key to no table", lambda e: Schema().column("a", "INT").foreign_key("f", "a", "nowhere", "a").validate({})),
    ("group in a where", lambda e: where("a").is_null().AND().open()),
    ("parent is dropped", lambda e: e.drop_table("region")),
    ("second column without a connective", lambda e: where("a").is_null().column("b")),
    ("table twice", lambda e: e.create_table("nation", e.schema("nation"))),
    ("unknown column in a select", lambda e: e.select("nothing").from_("nation").to_df()),
    ("unknown column in a where", lambda e: e.select().from_("nation").where(where("nothing").is_null()).to_df()),
    ("unknown table", lambda e: e.size("nothing")),
)


@query(_values(tuple((n, True) for n, _ in _GUARDS), '"rule", "refused"'))
def engine_guards(spark, sf):
    """What is refused before any row is read."""
    e = _engine(spark, sf)
    return spark.createDataFrame([(n, _raised(lambda f=f: f(e))) for n, f in _GUARDS], "rule string, refused boolean")


@query("SELECT count(*) AS violations FROM nation")
def check_empty_group(spark, sf):
    """A group without conditions is false for every row."""
    df = load(spark, sf, "nation")
    return C.check_violations(df, schema_of(df).check("none", condition().open().close()), "none").agg(F.count("*").alias("violations"))


BULK = 1_000_000


def bulk(spark: SparkSession) -> Engine:
    """A table with a text key and an indexed number, filled in one statement."""
    s = Schema().column("username", "CHAR", 50, primary=True).column("num", "INT", index=True).column("message", "CHAR", 10).column("data", "BYTE", 10, required=True, default=bytes(10))
    e = Engine(spark).add_database("main").create_table("users", s)
    e.begin().insert_df("users", spark.range(BULK).select(F.concat(F.lit("INSERTION"), "id").alias("username"), F.col("id").cast("int").alias("num"), F.lit("TEST").alias("message")))
    return e.commit()


@query(f"SELECT {BULK} AS deleted, 0 AS in_transaction, {BULK} AS after_rollback, 11 AS few, 10001 AS some, {BULK} AS every")
def bulk_rollback(spark, sf):
    """A million rows: insert, delete all, roll back, then ranges of three widths."""
    e = bulk(spark)
    deleted = e.begin().delete("users")
    seen = [deleted, e.size("users")]
    e.rollback()
    seen.append(e.size("users"))
    for low, high in ((1000, 1010), (10000, 20000), (0, BULK - 1)):
        seen.append(e.select("username").from_("users").where(where("num").is_bigger_or_equal(low).is_smaller_or_equal(high)).to_df().count())
    names = ("deleted", "in_transaction", "after_rollback", "few", "some", "every")
    return spark.range(1).select(*(F.lit(v).cast("int").alias(n) for v, n in zip(seen, names, strict=True)))
