"""Semantics of the engine on small literal tables, and a random model of inserts, updates and deletes."""

import datetime as dt
import random
import uuid

import pytest

from lodestone.engine import Engine
from lodestone.errors import CheckConstraintError, EntryValidationError, ForeignKeyError, SchemaError
from lodestone.functions import scalar as S
from lodestone.functions.arith import compile_arithmetic
from lodestone.operators.rewrite import Update
from lodestone.plans.conditions import condition, where
from lodestone.schema import CASCADE, RESTRICT, SET_DEFAULT, SET_NULL, Schema
from lodestone.types import DataType


def people(spark, path=None):
    e = Engine(spark, path).add_database("main")
    e.create_table("people", Schema().column("id", "INT", primary=True).column("name", "CHAR", 20).column("age", "INT"))
    e.insert("people", [{"id": 1, "name": "Charlie", "age": 35}, {"id": 2, "name": "Alice", "age": 30}, {"id": 3, "name": "Bob", "age": 25}])
    return e


def names(rows):
    return [r.name for r in rows]


def test_order_and_page(spark):
    e = people(spark)
    assert names(e.select("name").from_("people").ASC("name").fetch()) == ["Alice", "Bob", "Charlie"]
    assert names(e.select("name").from_("people").DEC("age").fetch()) == ["Charlie", "Alice", "Bob"]
    assert names(e.select("name").from_("people").begin(1).limit(1).ASC("name").fetch()) == ["Alice"]
    assert names(e.select("name").from_("people").begin(1).limit(2).DEC("age").fetch()) == ["Alice", "Bob"]
    assert e.select("name").from_("people").limit(0).fetch() == []
    assert len(e.select(" ").from_("people").to_df().columns) == 0
    assert [tuple(r) for r in e.select("name, name").from_("people").where(where("id").is_equal(3)).fetch()] == [("Bob", "Bob")]
    with pytest.raises(SchemaError):
        e.select("nobody").from_("people").to_df()
    with pytest.raises(SchemaError):
        e.select("*").from_("people").where(where("nobody").is_null()).to_df()
    assert e.contains("people", "name", "Bob") and not e.contains("people", "name", "Eve")


def test_nulls_and_left_fold(spark):
    e = people(spark)
    e.insert("people", [{"id": 4, "name": None, "age": None}])
    get = lambda c: sorted(r.id for r in e.select("id").from_("people").where(c).fetch())
    assert get(where("age").is_not_equal(30)) == [1, 3, 4]
    assert get(where("age").is_equal(None)) == [4] and get(where("age").not_null()) == [1, 2, 3]
    assert get(where("age").is_smaller(100)) == [1, 2, 3]
    assert get(where("id").is_equal(1).OR().column("id").is_equal(2).AND().column("age").is_smaller(31)) == [2]
    assert [r.id for r in e.select("id").from_("people").ASC("age").fetch()][0] == 4
    assert [r.id for r in e.select("id").from_("people").DEC("age").fetch()][-1] == 4
    with pytest.raises(ValueError):
        where("id").is_equal(1).column("age")
    with pytest.raises(ValueError):
        where("id").is_equal(1).AND().open()
    with pytest.raises(ValueError):
        e.select().from_("people").where(where("age").is_bigger(None)).to_df()


def test_checks_types_and_sizes(spark):
    e = Engine(spark).add_database("main")
    s = Schema().column("username", "CHAR", 5, primary=True).column("age", "INT").column("email", "CHAR", 9, unique=True).column("n", "LONG")
    e.create_table("t", s.check("adult", condition("age").is_bigger_or_equal(18).AND().column("age").is_smaller(130)))
    assert e.insert("t", {"username": "ann", "age": 20, "email": None}) == 1
    assert e.insert("t", {"username": "bob", "age": 21, "email": None}) == 1  # nulls are exempt from uniqueness
    for row, error in (
        ({"username": "cy", "age": 17}, CheckConstraintError), ({"username": "cy", "age": None}, CheckConstraintError),
        ({"username": "ann", "age": 30}, EntryValidationError), ({"username": "toolong", "age": 30}, EntryValidationError),
        ({"username": None, "age": 30}, EntryValidationError), ({"username": "cy", "age": "30"}, EntryValidationError),
        ({"username": "cy", "age": 30, "n": 1.0}, EntryValidationError), ({"username": "cy", "age": 30, "x": 1}, EntryValidationError),
        ({"username": "cy", "age": True}, EntryValidationError),
    ):
        with pytest.raises(error):
            e.insert("t", row)
    with pytest.raises(EntryValidationError):  # all or nothing
        e.insert("t", [{"username": "x", "age": 20, "email": "e"}, {"username": "y", "age": 20, "email": "e"}])
    assert e.table("t").count() == 2
    with pytest.raises(CheckConstraintError):
        e.update("t", Update().column("age").operation("age - 10"))
    assert e.update("t", Update().column("age").operation("age + 1")) == 2
    assert sorted(r.age for r in e.select("age").from_("t").fetch()) == [21, 22]


def test_auto_increment_and_defaults(spark):
    e = Engine(spark).add_database("main")
    e.create_table("t", Schema().column("id", auto_increment=True, primary=True).column("name", "CHAR", 20, default="Hello").column("at", "TIMESTAMP"))
    e.insert("t", [{"name": "a"}, {"id": 10, "name": None}, {}, {"id": 5}, {}])
    rows = e.select("*").from_("t").fetch()
    assert [(r.id, r.name) for r in rows] == [(1, "a"), (5, "Hello"), (10, None), (11, "Hello"), (12, "Hello")]
    assert all(abs(r.at - dt.datetime.now(dt.UTC).replace(tzinfo=None)) < dt.timedelta(hours=1) for r in rows)
    e.begin()
    e.insert("t", {})
    e.rollback()
    e.insert("t", {"at": None})
    assert e.select("id, at").from_("t").where(where("id").is_equal(14)).fetch()[0].at is None  # numbers aren't given twice


def test_auto_increment_over_blocks(spark, monkeypatch):
    from lodestone.operators import rewrite

    rng, following, want = random.Random(4), 5, []
    given = [None if rng.random() < 0.7 else rng.randrange(60) for _ in range(200)]
    for v in given:
        want.append(following if v is None else v)
        following = max(following, want[-1] + 1)
    rows = spark.createDataFrame(list(enumerate(given)), "_seq bigint, id bigint")
    monkeypatch.setattr(rewrite, "BLOCK_BITS", 3)
    got = rewrite.auto_increment(rows, "id", 5).orderBy("_seq").collect()
    assert [r.id for r in got] == want


def family(spark, on_delete, on_update=RESTRICT, required=False):
    e = Engine(spark).add_database("main")
    e.create_table("users", Schema().column("username", "CHAR", 15, primary=True).column("age", "INT", default=18))
    e.insert("users", [{"username": u, "age": a} for u, a in (("Alice", 25), ("Bob", 30), ("DefaultUser", 0))])
    child = Schema().column("id", auto_increment=True, primary=True).column("username", "CHAR", 15, default="DefaultUser", required=required)
    e.create_table("posts", child.foreign_key("fk", "username", "users", "username", on_delete, on_update))
    e.insert("posts", [{"username": "Alice"}, {"username": "Bob"}, {"username": None}] if not required else [{"username": "Alice"}, {"username": "Bob"}])
    return e


def posts(e):
    return [r.username for r in e.select("username").from_("posts").fetch()]


def test_foreign_keys_on_delete(spark):
    gone = where("username").is_equal("Alice")
    e = family(spark, RESTRICT)
    with pytest.raises(ForeignKeyError):
        e.delete("users", gone)
    with pytest.raises(ForeignKeyError):
        e.insert("posts", {"username": "Nobody"})
    assert e.table("users").count() == 3
    e = family(spark, CASCADE)
    assert e.delete("users", gone) == 1 and posts(e) == ["Bob", None]
    e = family(spark, SET_NULL)
    e.delete("users", gone)
    assert posts(e) == [None, "Bob", None]
    e = family(spark, SET_DEFAULT)
    e.delete("users", gone)
    assert posts(e) == ["DefaultUser", "Bob", None]
    with pytest.raises(ForeignKeyError):  # the default must exist
        e.delete("users", where("username").is_equal("DefaultUser"))
    with pytest.raises(EntryValidationError):
        family(spark, SET_NULL, required=True).delete("users", gone)
    with pytest.raises(SchemaError):
        e.drop_table("users")


def test_foreign_keys_on_update(spark):
    renamed, alice = Update().column("username").set("Eve"), where("username").is_equal("Alice")
    e = family(spark, RESTRICT, RESTRICT)
    with pytest.raises(ForeignKeyError):
        e.update("users", renamed, alice)
    assert e.update("users", Update().column("age").set(1), alice) == 1  # the key stays
    for action, want in ((CASCADE, "Eve"), (SET_NULL, None), (SET_DEFAULT, "DefaultUser")):
        e = family(spark, RESTRICT, action)
        e.update("users", renamed, alice)
        assert posts(e) == [want, "Bob", None]


def test_transactions_nest_and_tables_persist(spark, tmp_path):
    e = people(spark, f"file://{tmp_path}")
    e.begin("a")
    e.delete("people", where("id").is_equal(1))
    e.begin("b")
    e.delete("people")
    assert e.table("people").count() == 0
    e.rollback()
    assert e.table("people").count() == 2
    e.commit().commit()
    e.rollback()  # nothing is open
    again = Engine(spark, f"file://{tmp_path}").add_database("main")
    again.create_table("people", Schema().column("id", "INT", primary=True).column("name", "CHAR", 20).column("age", "INT"))
    assert names(again.select("*").from_("people").fetch()) == ["Alice", "Bob"]
    again.update("people", Update().column("age").set(1), limit=1)
    again.close()
    assert sorted(r.age for r in again.select("age").from_("people").fetch()) == [1, 25]
    again.drop_table("people")
    again.drop_table("people")


def test_update_conditions(spark):
    e = people(spark)
    u = Update().condition(condition().expression("age * 2").is_bigger(55.0)).column("age").set(0).column("name").apply(S.upper_case()).end_condition().column("name").apply(S.right_pad(8, "."))
    e.update("people", u)
    assert [tuple(r) for r in e.select("name, age").from_("people").fetch()] == [("CHARLIE.", 0), ("ALICE...", 0), ("Bob.....", 25)]
    with pytest.raises(ValueError):
        Update().set(1)
    with pytest.raises(ValueError):
        Update().condition(condition("age").is_null()).condition(condition("age").is_null())
    e.update("people", Update().column("age").set_default())
    assert [r.age for r in e.select("age").from_("people").fetch()] == [None] * 3


@pytest.mark.parametrize(
    "text,columns,double,want",
    [
        ("((c1+c2)*c3 - c4/c5 + c4%c3)^c1", (2, 3, 4, 10, 3), False, 361), ("((c1+c2)*c3 - c4/c5 + c4%c3)^c1", (2.0, 3.0, 4.0, 10.0, 3.0), True, 348.4444444444445),
        ("c1+c2*c3", (10, 5, 2), False, 20), ("-2^2", (), False, -4), ("2^3^2", (), False, 512), ("2^-1", (), False, 1), ("(0-7)/2", (), False, -3),
        ("1/0", (), True, float("inf")), ("-1.5e1 % 4", (), True, -3.0), ("c1 ^ c2", (3, 40 - 20), False, 3**20),
    ],
)
def test_arithmetic(spark, text, columns, double, want):
    from pyspark.sql import functions as F

    got = spark.range(1).select(compile_arithmetic(text, {f"c{i + 1}": F.lit(c) for i, c in enumerate(columns)}, double)).first()[0]
    assert got == pytest.approx(want)


def test_arithmetic_errors():
    for text in ("1 +", "(1", "1 $ 2", "1.5", "x", "1 2"):
        with pytest.raises(ValueError):
            compile_arithmetic(text, {}, False)


def test_functions(spark):
    from pyspark.sql import functions as F

    def run(fn, value):
        c = F.lit(value)
        return spark.range(1).select(fn(c)).first()[0]

    for fn, value, want in (
        (S.concat("Hello", " ", "World", 123), "x", "Hello World123"), (S.substring(1, 3), "abcdef", "bcd"), (S.substring(-1, 3), "abcdef", "ab"),
        (S.substring(4, 9), "abcdef", "ef"), (S.left(2), "abcdef", "ab"), (S.right(2), "abcdef", "ef"), (S.right(0), "abc", ""), (S.replace("123", "XXX"), "foo123bar123", "fooXXXbarXXX"),
        (S.regexp_replace(r"\d+", ""), "foo1bar22", "foobar"), (S.left_pad(4, "0"), "7", "0007"), (S.right_pad(4, "x"), "7", "7xxx"), (S.left_pad(2, "0"), "long", "long"),
        (S.left_pad(3, None), "a", "  a"), (S.reverse(), "abcd", "dcba"), (S.trim(), "\x01 a b\n", "a b"),
    ):
        assert run(fn, value) == want
    with pytest.raises(Exception, match="behind the end"):
        run(S.substring(7, 1), "abcdef")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.date_add("months", 1)(at("2020-01-31 00:00:00"))) == dt.datetime(2020, 2, 29)
    assert one(S.date_subtract("days", 10)(at("2025-07-24 12:00:00"))) == dt.datetime(2025, 7, 14, 12)
    assert [one(S.extract_part(p)(at("2025-12-31 23:59:58"))) for p in ("year", "month", "day", "hour", "minute", "second")] == [2025, 12, 31, 23, 59, 58]
    assert [one(S.date_difference(at("2020-01-01 00:00:00"), at("2025-01-01 00:00:00"), u)) for u in ("days", "months", "years")] == [1827, 60, 5]
    assert [one(S.date_difference(at("2025-07-24 00:00:00"), at("2025-07-25 01:30:15"), u)) for u in ("hours", "minutes", "seconds")] == [25, 1530, 91815]
    for bad in (lambda: S.extract_part("era"), lambda: S.date_difference(at("2020-01-01"), at("2020-01-01"), "eras"), lambda: S.left(-1), lambda: S.replace("", "x")):
        with pytest.raises(ValueError):
            bad()


def test_types(spark):
    assert DataType.of("timestamptz") is DataType.TIMESTAMP_WITH_TIME_ZONE and DataType.of("bool") is DataType.BOOLEAN
    values = {
        DataType.SHORT: 3, DataType.INT: -4, DataType.LONG: 1 << 40, DataType.FLOAT: 0.5, DataType.DOUBLE: 0.1, DataType.CHAR: "é", DataType.VARCHAR: "x",
        DataType.BOOLEAN: True, DataType.DATE: dt.date(2020, 2, 29), DataType.TIME: dt.time(23, 59, 58, 7), DataType.TIMESTAMP: dt.datetime(2020, 1, 2, 3, 4, 5, 6),
        DataType.TIMESTAMP_WITH_TIME_ZONE: dt.datetime(2020, 1, 2, 3, tzinfo=dt.UTC), DataType.INTERVAL: dt.timedelta(days=1, seconds=1.5), DataType.UUID: uuid.UUID(int=5),
        DataType.BYTE: b"\0\xff", DataType.VARBYTE: b"",
    }
    e, s = Engine(spark).add_database("main"), Schema()
    for t, v in values.items():
        assert t.parse(t.format(v)) == v and t.parse("NULL") is None
        s.column(t.name.lower(), t, 64)
    e.create_table("t", s)
    e.insert("t", {t.name.lower(): v for t, v in values.items()})
    assert list(e.select().from_("t").fetch()[0]) == list(values.values())
    with pytest.raises(ValueError):
        DataType.of("decimal")
    with pytest.raises(ValueError):
        DataType.BOOLEAN.parse("yes")


def test_schema_rules():
    ok = Schema().column("a", "INT", primary=True)
    for s in (
        Schema(), Schema().column("a", "INT").column("a", "INT"), Schema().column("a", "CHAR"), Schema().column("a", None), Schema().column("a", "VARCHAR", 5, index=True),
        Schema().column("a", "INT", primary=True, unique=True), Schema().column("a", "INT", primary=True).column("b", "INT", primary=True), Schema().column("a", "INT", default="x"),
        Schema().column("a", auto_increment=True).column("b", auto_increment=True), Schema().column("a", "INT").check("c", condition("b").is_null()),
        Schema().column("a", "INT").foreign_key("f", "a", "nowhere", "a"), Schema().column("a", "LONG").foreign_key("f", "a", "ok", "a"),
        Schema().column("a", "INT").foreign_key("f", ["a", "a"], "ok", "a"),
    ):
        with pytest.raises(SchemaError):
            s.validate({"ok": ok})


def test_stream(spark, tmp_path):
    from lodestone.streaming import insert_stream

    spark.range(5).selectExpr("cast(id as int) id", "'n' as name").write.parquet(f"{tmp_path}/in")
    e = people(spark)
    e.delete("people")
    insert_stream(e, "people", spark.readStream.schema("id int, name string").parquet(f"{tmp_path}/in"), f"{tmp_path}/cp").awaitTermination()
    assert [r.id for r in e.select("id").from_("people").fetch()] == [0, 1, 2, 3, 4]


def test_random_statements(spark):
    rng, e, model = random.Random(42), people(spark), {}
    e.delete("people")
    for k in range(4):
        batch = [{"id": 10 * k + i, "name": None if i % 4 == 0 else f"n{rng.randrange(5)}", "age": rng.randrange(20)} for i in range(10)]
        e.insert("people", batch)
        model |= {r["id"]: (r["name"], r["age"]) for r in batch}
        low, name = rng.randrange(20), f"n{rng.randrange(5)}"
        if k % 2:
            hit = [i for i, (n, a) in model.items() if a >= low and n != name]
            assert e.update("people", Update().column("age").operation("age / 2 + 1"), where("age").is_bigger_or_equal(low).AND().column("name").is_not_equal(name)) == len(hit)
            model |= {i: (model[i][0], model[i][1] // 2 + 1) for i in hit}
        else:
            hit = sorted(i for i, (n, a) in model.items() if n == name or a < 3)[:4]
            assert e.delete("people", where("age").is_smaller(3).OR().column("name").is_equal(name), limit=-1) >= len(hit)
            model = {i: (n, a) for i, (n, a) in model.items() if not (n == name or a < 3)}
        assert {r.id: (r.name, r.age) for r in e.select().from_("people").fetch()} == model


# -- statements are all or nothing ------------------------------------------------------------------


def wide(n, names):
    s = Schema().column("id", "INT", primary=True)
    for c in names:
        s.column(c, "CHAR", 20)
    return s


@pytest.mark.parametrize(
    "what",
    [
        Update().column("age").operation("10 / age"), Update().column("age").operation("age + 9223372036854775807"), Update().column("age").operation("age + spare"),
        Update().column("age").operation("age * 1000000000"), Update().column("age").apply(lambda c: c.cast("string") + "x"), Update().column("name").set("a" * 21),
        Update().column("age").set(2).column("id").set(1),
    ],
)
def test_a_failing_update_changes_nothing(spark, what):
    """Division by zero, overflow of the sum and of the column, a null operand, a bad cast, a late constraint."""
    e = Engine(spark).add_database("main")
    e.create_table("people", Schema().column("id", "INT", primary=True).column("name", "CHAR", 20).column("age", "INT").column("spare", "INT"))
    rows = [{"id": 1, "name": "a", "age": 30, "spare": 1}, {"id": 2, "name": "b", "age": 0, "spare": None}, {"id": 3, "name": "c", "age": 5, "spare": 2}]
    e.insert("people", rows)
    e.begin()
    for _ in range(2):
        with pytest.raises(Exception):  # noqa: B017
            e.update("people", what)
    assert [r.asDict() for r in e.select().from_("people").fetch()] == rows
    e.commit()
    assert e.update("people", Update().column("age").operation("age + 1"), where("age").is_bigger(0)) == 2
    assert e.insert("people", {"id": 4, "name": None, "age": 1, "spare": None}) == 1
    assert sorted(r.age for r in e.select("age").from_("people").fetch()) == [0, 1, 6, 31] and e.size("people") == 4


def test_a_failing_insert_changes_nothing(spark):
    from pyspark.sql import functions as F

    e = people(spark)
    with pytest.raises(Exception):  # noqa: B017
        e.insert_df("people", spark.range(8, 12).select(F.col("id").cast("int").alias("id"), (F.lit(1) / (F.col("id") - 10)).cast("int").alias("age")))
    with pytest.raises(EntryValidationError):
        e.insert_df("people", spark.range(3, 5).select(F.col("id").cast("int").alias("id")))
    assert e.size("people") == 3 and e.insert_unsafe("people", {"id": 9}) == 1


def test_hidden_names_touch_no_column(spark):
    """Columns named like helpers of other engines, like results, and like SQL functions."""
    own = ["hit", "_hit", "_block", "_nulls", "_id", "_o0", "_n0", "_p0", "_if0", "count", "i", "s", "a", "n"]
    s = wide(0, own)
    s.column("number", auto_increment=True).column("uniq", "INT", unique=True)
    e = Engine(spark).add_database("main").create_table("t", s)
    row = {c: f"v{k}" for k, c in enumerate(own)}
    e.insert("t", [{"id": 1, "uniq": 1, **row}, {"id": 2, "uniq": 2, **row}])
    e.update("t", Update().condition(condition("id").is_equal(1)).column("uniq").set(7).end_condition(), where("id").is_smaller(9))
    e.update("t", Update().column("uniq").operation("uniq + 1"), limit=1)
    got = e.select().from_("t").fetch()
    assert [{c: r[c] for c in own} for r in got] == [row, row] and [(r.number, r.uniq) for r in got] == [(1, 8), (2, 2)]
    for bad in ("_seq", "_SEQ_hit", "ID"):
        with pytest.raises(SchemaError):
            wide(0, [bad]).validate({})


def test_float_literals_have_the_type_of_the_column(spark):
    e = Engine(spark).add_database("main").create_table("t", Schema().column("id", "INT", primary=True).column("x", "FLOAT").column("d", "DOUBLE"))
    e.insert("t", [{"id": 1, "x": 0.1, "d": 0.1}, {"id": 2, "x": 0.5, "d": 0.5}, {"id": 3, "x": float("nan"), "d": None}, {"id": 4, "x": 16777216.0, "d": 1e300}, {"id": 5}])
    get = lambda c: sorted(r.id for r in e.select("id").from_("t").where(c).fetch())
    assert get(where("x").is_equal(0.1)) == [1] and get(where("x").is_not_equal(0.1)) == [2, 3, 4, 5]
    assert get(where("x").is_smaller_or_equal(0.1)) == [1] and get(where("x").is_bigger(0.1).is_smaller(1)) == [2]
    assert get(where("x").is_equal(float("nan"))) == [3] and get(where("x").is_equal(16777217)) == [] and get(where("x").is_bigger_or_equal(16777216)) == [3, 4]
    assert get(where("x").is_smaller(1e300).is_bigger(1)) == [4] and get(where("id").is_equal(2.0)) == [2] and get(where("id").is_bigger(2.5)) == [3, 4, 5]
    assert e.delete("t", where("x").is_bigger(0.2).is_smaller(1e9)) == 2 and get(where("id").not_null()) == [1, 3, 5]  # nulls survive


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_reach_the_scan(spark):
    import re

    e = Engine(spark).add_database("main").create_table("t", Schema().column("id", "INT", primary=True).column("x", "DOUBLE").column("f", "FLOAT").column("at", "TIMESTAMP").column("name", "CHAR", 9))
    e.insert("t", [{"id": k, "x": k / 2, "f": 0.1, "name": f"n{k}"} for k in range(20)])
    for c, *want in (
        (where("id").is_bigger_or_equal(3).is_smaller(9), "GreaterThanOrEqual(id,3)", "LessThan(id,9)"), (where("x").is_bigger(3), "GreaterThan(x,3.0)"),
        (where("f").is_smaller_or_equal(0.1), "LessThanOrEqual(f,0.1)"), (where("id").is_smaller(3).OR().column("name").is_bigger("n5"), "Or(LessThan(id,3),GreaterThan(name,n5))"),
        (where("at").is_smaller(dt.datetime(2030, 1, 1)), "LessThan(at,2030-01-01T00:00)"), (where("id").is_equal(4), "EqualNullSafe(id,4)"), (where("id").is_not_equal(4), "Not(EqualNullSafe(id,4))"),
    ):
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(e.select("id").from_("t").where(c).to_df()))[1]
        assert all(w in pushed for w in want), (want, pushed)


def test_far_pages(spark, monkeypatch):
    from lodestone.operators import select as module

    e = Engine(spark).add_database("main").create_table("t", Schema().column("id", "INT", primary=True).column("x", "INT"))
    order = random.Random(2).sample(range(400), 400)
    e.insert_df("t", spark.createDataFrame([(k, k % 7) for k in order], "id int, x int").repartition(5))
    get = lambda q: [r.id for r in q.from_("t").fetch()]
    for top in (module.TOP, 10):
        monkeypatch.setattr(module, "TOP", top)
        assert get(e.select("id").begin(13)) == list(range(13, 400)) and get(e.select("id").begin(500)) == []
        assert get(e.select("id").begin(50).limit(20)) == list(range(50, 70)) and get(e.select("id").limit(3)) == [0, 1, 2]
        assert get(e.select("id").where(where("id").is_bigger(99)).begin(12).limit(100)) == list(range(112, 212))
        assert not any(x in plan_of(e.select("id").from_("t").begin(13).to_df()) for x in ("CollectLimit", "GlobalLimit"))
    e.delete("t", begin=100)
    assert get(e.select("id")) == list(range(100))


def test_numbers_are_dense(spark):
    from lodestone.operators.select import SEQ

    e = people(spark)
    for k in range(3):
        e.insert_df("people", spark.range(10 + 10 * k, 18 + 10 * k, numPartitions=4).selectExpr("cast(id as int) id"))
    assert sorted(r[SEQ] for r in e.table("people").collect()) == list(range(27))


def test_many_small_inserts_are_one_part_again(spark, monkeypatch):
    from lodestone import engine

    monkeypatch.setattr(engine, "PARTS", 3)
    e = people(spark)
    for k in range(10, 15):
        e.insert("people", {"id": k})
        assert len(e._parts("people")) <= 3
    assert e.size("people") == 8


def test_a_large_part_is_not_written_again_for_small_inserts(spark, monkeypatch):
    from lodestone import engine

    monkeypatch.setattr(engine, "PARTS", 3)
    e = Engine(spark).add_database("main")
    e.create_table("people", Schema().column("id", "LONG", primary=True), spark.range(100_000).toDF("id"))
    (large,) = e._parts("people")
    for k in range(8):
        e.insert("people", {"id": 100_000 + k})
        assert large in e._parts("people") and len(e._parts("people")) <= 3
    assert e.size("people") == 100_008
    assert [r.id for r in e.select("id").from_("people").where(where("id").is_bigger_or_equal(100_000)).fetch()] == list(range(100_000, 100_008))
    folder = e.storage._fs.listStatus(e.storage._at(e.storage._folder("main", "people")))
    assert {*e._parts("people")} <= {x.getPath().getName() for x in folder}


def test_databases(spark, tmp_path):
    at, one = f"file://{tmp_path}", Schema().column("id", "INT", primary=True)
    e = Engine(spark, at).add_database("a").add_database("b")
    e.create_table("t", one).create_table("u", one)
    e.begin("outer").begin("inner").insert("t", [{"id": 1}, {"id": 2}])
    e.select_database("b")  # commits all that is open in a
    e.create_table("t", one).insert("t", {"id": 9})
    assert [tuple(r) for r in e.describe_all().collect()] == [("a", "t", "id", "INT"), ("a", "u", "id", "INT"), ("b", "t", "id", "INT")]
    assert [r.table for r in e.describe_database().collect()] == ["t"]
    e.close()
    again = Engine(spark, at).add_database("a").add_database("b")
    again.create_table("t", one)
    again.insert("t", {"id": 3})
    again.commit()  # u isn't declared yet and stays
    again.create_table("u", one).select_database("b").create_table("t", one)
    assert again.size("t") == 1 and again.select_database("a").size("t") == 3 and again.size("u") == 0
    again.drop_table("t")
    assert not (tmp_path / "a" / "tables" / "t").exists()
    for bad in (lambda: again.select_database("c"), lambda: again.drop_database("c"), lambda: again.add_database("a"), lambda: again.create_table("u", one)):
        with pytest.raises(SchemaError):
            bad()
    again.drop_database("a")
    assert not (tmp_path / "a").exists() and again.name == ""
    with pytest.raises(Exception, match="no database is selected"):
        again.select().from_("u").fetch()


def test_one_pointer_commits_parent_and_child_together(spark, tmp_path):
    e = people(spark, f"file://{tmp_path}")
    e.create_table("pets", Schema().column("owner", "INT").foreign_key("fk", "owner", "people", "id", CASCADE))
    e.insert("pets", [{"owner": 1}, {"owner": 2}])
    e.commit()
    e.delete("people", where("id").is_equal(1))

    before = e.storage.tables("main")
    e.commit()
    after = e.storage.tables("main")
    assert set(before) == set(after) == {"people", "pets"} and before["people"] != after["people"] and before["pets"] != after["pets"]
    parts = {p.name for t in ("people", "pets") for p in (tmp_path / "main" / "tables" / t).iterdir()}
    assert parts == {p for m in (before, after) for ps in m.values() for p in ps}  # the version before can still be read


def test_empty_groups_and_parquet(spark, tmp_path):
    from lodestone.sources.storage import parquet_table

    spark.range(4).selectExpr("cast(id as int) id", "'n' name").write.parquet(f"{tmp_path}/p")
    s = Schema().column("id", "INT", primary=True).column("name", "CHAR", 5)
    e = Engine(spark).add_database("main").create_table("t", s, parquet_table(spark, f"{tmp_path}/p"))
    assert e.size("t") == 4
    e.create_table("never", Schema().column("id", "INT").check("none", condition().open().close()))
    with pytest.raises(CheckConstraintError):  # an empty group is false
        e.insert("never", {"id": 1})
    e.create_table("all", Schema().column("id", "INT").check("none", condition().open().close().OR().column("id").is_bigger(0)))
    assert e.insert("all", {"id": 1}) == 1
