import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from quern import catalog
from quern.functions import conversions, dates, numbers, text
from quern.operators import cursors, dml, fulltext, nullmode, quantified, setops
from quern.plans import ddl, routines, sql_compat
from quern.types import spark_type, stored


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("quantifier", ["ALL", "ANY"])
def test_quantified_truth_tables(spark, op, quantifier):
    sets = [s for n in range(4) for s in itertools.combinations_with_replacement((None, 1, 2, 3), n)]
    left = [(k, x) for k in range(len(sets)) for x in (None, 1, 2, 3)]
    right = [(k, c) for k, s in enumerate(sets) for c in s]
    df = spark.createDataFrame(left, "k int, x int")
    values = spark.createDataFrame(right, "k int, c int")
    got = {(r.k, r.x): r.holds for r in quantified.quantified(df, "x", op, quantifier, values, "c", ["k"]).collect()}
    duck = duckdb.connect()
    for k, x in left:
        rows = " UNION ALL ".join(f"SELECT {'NULL::int' if c is None else c} AS c" for c in sets[k]) or "SELECT 1 AS c WHERE false"
        expected = duck.execute(f"SELECT {'NULL::int' if x is None else x} {op} {quantifier} (SELECT c FROM ({rows}) t)").fetchone()[0]
        assert got[k, x] is expected, (sets[k], x)


@pytest.mark.parametrize("query", ["x > ALL", "x <> ALL", "x = ANY", "x <= SOME", "x = ALL", "x <> ANY"])
def test_quantified_sql(spark, query):
    duck = duckdb.connect()
    spark.createDataFrame([(None,), (1,), (2,), (3,)], "x int").createOrReplaceTempView("l")
    duck.execute("CREATE TABLE l AS SELECT * FROM (VALUES (NULL::int), (1), (2), (3)) t(x)")
    for values in ([], [1, 2], [1, None], [None], [2, 2]):
        spark.createDataFrame([(v,) for v in values], "c int").createOrReplaceTempView("r")
        duck.execute("CREATE OR REPLACE TABLE r (c int)")
        for v in values:
            duck.execute("INSERT INTO r VALUES (?)", [v])
        text_ = f"SELECT x, {query} (SELECT c FROM r) AS h FROM l"
        assert sorted(map(tuple, sql_compat.run(spark, text_).collect()), key=str) == sorted(duck.execute(text_.replace("SOME", "ANY")).fetchall(), key=str)


def test_preprocessor_leaves_strings_and_names_alone():
    t = sql_compat.translate
    assert t("SELECT 'a != b .= c' AS `x !< y`, \"it's\" FROM t -- != \nWHERE a !< 3") == "SELECT 'a != b .= c' AS `x !< y`, 'it''s' FROM t WHERE a >= 3"
    assert t("SELECT a FROM t LIMIT 5, 10") == "SELECT a FROM t LIMIT 10 OFFSET 5"
    assert "startswith(a.b, 'x')" in t("SELECT 1 FROM a WHERE a.b .= 'x' AND c = 2")
    assert "contains(lower(n), concat('x', y))" in t("SELECT 1 FROM a WHERE lower(n) .=. concat('x', y) OR z = 1")
    assert t("SELECT {d '2001-02-03'} FROM {oj a LEFT JOIN b ON a.x = b.x}") == "SELECT DATE '2001-02-03' FROM a LEFT JOIN b ON a.x = b.x"
    with pytest.raises(ValueError):
        t("SELECT {d '2001-02-03' FROM a")


def test_set_operations_by_name(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "x", 6), (2, None, 7)], "k int, v string, w int")
    b = spark.createDataFrame([("x", 1, 0), (None, 2, 0), ("z", 3, 0)], "v string, k int, z int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(setops.corresponding(a, b, "UNION")) == [(1, "x"), (2, None), (3, "z")]
    assert rows(setops.corresponding(a, b, "UNION", True, ["v"])) == [("x",), ("x",), ("x",), ("z",), (None,), (None,)]
    assert rows(setops.corresponding(a, b, "EXCEPT", True)) == [(1, "x")]
    assert rows(setops.corresponding(a, b, "INTERSECT")) == [(1, "x"), (2, None)]
    assert setops.union_join(a, b.toDF("p", "q", "r")).count() == 6
    with pytest.raises(ValueError):
        setops.union_join(a, b)
    with pytest.raises(ValueError):
        setops.corresponding(a, b.select("z"), "UNION")
    assert setops.differences(a, a).count() == 0


def test_null_modes(spark):
    df = spark.createDataFrame([(a, b) for a in (None, 1, 2) for b in (None, 1, 2)], "a int, b int")
    rank = lambda v: -1 if v is None else v
    for op, f in (("=", lambda x, y: x == y), ("<>", lambda x, y: x != y), ("<", lambda x, y: x < y), (">", lambda x, y: x > y), ("<=", lambda x, y: x <= y), (">=", lambda x, y: x >= y)):
        for r in df.withColumn("h", nullmode.compare(F.col("a"), op, F.col("b"))).collect():
            assert r.h is f(rank(r.a), rank(r.b))
    e = spark.createDataFrame([("", bytearray(2), 1), ("a", bytearray(b"\0\1"), 2)], "s string, b binary, n int")
    assert [tuple(r) for r in nullmode.empty_as_null(e).orderBy("n").collect()] == [(None, None, 1), ("a", bytearray(b"\0\1"), 2)]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    s = F.lit("abcdef")
    assert one(spark, text.strinsert(F.lit("XY"), s, F.lit(3)), text.strinsert(F.lit("X"), s, F.lit(9)), text.strinsert(F.lit("X"), s, F.lit(0))) == ("abXYcdef", "abcdef  X", "abcdef")
    assert one(spark, text.strdelete(s, F.lit(2), F.lit(3)), text.strdelete(s, F.lit(0), F.lit(3)), text.strdelete(s, F.lit(5), F.lit(9))) == ("aef", "abcdef", "abcd")
    assert one(spark, text.substring(s, F.lit(0), F.lit(3)), text.substring(s, F.lit(-2), F.lit(4)), text.substring(s, F.lit(4))) == ("ab", "a", "def")
    assert one(spark, text.like(F.lit("a\\b"), "a\\b"), text.like(F.lit("a%"), "a#%", "#"), text.like(F.lit("ab"), "a#%", "#"), text.like(F.lit("ABC"), "a_c", ignore_case=True)) == (True, True, False, True)
    assert one(spark, text.pref(F.lit("ab"), s), text.substr(F.lit("cd"), s), text.strpos(F.lit("d"), s), text.ord_(F.lit("A")), text.chr_(F.lit(66)), text.regexp_like(F.lit("ABC"), "^a.c$", "i")) == (True, True, 4, 65, "B", True)


def test_number_functions(spark):
    assert one(spark, *[numbers.round_(F.lit(x)) for x in (2.5, -2.5, 2.4, 1e12)]) == (3, -3, 2, None)
    assert one(spark, *[numbers.trunc(F.lit(x)) for x in (2.9, -2.9, 0.0)]) == (2, -2, 0)
    assert one(spark, *[numbers.div(F.lit(a), F.lit(b)) for a, b in ((7, 2), (-7, 2), (7, -2))]) == (3, -3, -3)
    n = F.lit(None).cast("decimal(15,2)")
    five = F.lit("5.00").cast("decimal(15,2)")
    assert [None if x is None else float(x) for x in one(spark, numbers.add_money(n, five), numbers.add_money(n, n), numbers.subtract_money(n, five), numbers.subtract_money(five, n))] == [5.0, None, -5.0, 5.0]
    assert one(spark, numbers.odd(F.lit(3)), numbers.odd(F.lit(-4)), numbers.sqr(F.lit(5))) == (True, False, 25)


def test_date_functions(spark):
    import datetime

    d = lambda *x: dates.make_date(*map(F.lit, x))
    assert one(spark, d(29, 2, 2000), d(29, 2, 1900), d(31, 4, 2001), d(1, 1, 1)) == (datetime.date(2000, 2, 29), None, None, datetime.date(1, 1, 1))
    t = F.lit(86_399_999)
    assert one(spark, dates.hours(t), dates.minutes(t), dates.seconds(t), dates.sec1000(t)) == (23, 59, 59, 999)
    assert one(spark, dates.make_time(*map(F.lit, (23, 59, 59, 999))), dates.make_time(*map(F.lit, (24, 0, 0, 0))), dates.time_minus(F.lit(500), F.lit(1000))) == (86_399_999, None, 86_399_500)
    assert one(spark, dates.day_of_week(F.lit("2024-01-07").cast("date")), dates.day_of_week(F.lit(None).cast("date"))) == (0, 7)


def test_conversions(spark):
    import datetime
    from decimal import Decimal

    assert one(spark, *[conversions.str2int(F.lit(x)) for x in ("12", " 7 ", "x", "99999999999")]) == (12, 7, None, None)
    assert one(spark, conversions.str2date(F.lit("1.2.2003")), conversions.str2date(F.lit("31.02.2003")), conversions.str2date(F.lit("2003-02-01"), "CCYY-MM-DD")) == (datetime.date(2003, 2, 1), None, datetime.date(2003, 2, 1))
    assert one(spark, *[conversions.str2time(F.lit(x)) for x in ("1:02", "23:59:59.5", "24:00", "x")]) == (3_720_000, 86_399_500, None, None)
    assert one(spark, conversions.str2money(F.lit("1 234,50")), conversions.str2money(F.lit("12,-")), conversions.str2money(F.lit("a"))) == (Decimal("1234.50"), Decimal("12.00"), None)
    assert one(spark, conversions.real2str(F.lit(1234.5), -2), conversions.real2str(F.lit(1234.5), 2), conversions.real2str(F.lit(1234.5), -102)) == ("1234.50", "1.23e+03", "1,234.50")
    assert one(spark, conversions.money2str(F.lit(5.0), 0), conversions.money2str(F.lit(5.5), 0), conversions.money2str(F.lit(5.5), 1)) == ("5,-", "5,50", "5.50")
    assert one(spark, conversions.time2str(F.lit(3_723_004), 0), conversions.time2str(F.lit(3_723_004), 1), conversions.time2str(F.lit(3_723_004), 2)) == ("01:02", "01:02:03", "01:02:03.004")
    assert one(spark, conversions.str2bool(F.lit("true")), conversions.str2bool(F.lit("no"), "yes", "no"), conversions.str2bool(F.lit("?"))) == (True, False, None)
    assert one(spark, conversions.str2timestamp(F.lit("05.06.2007 08:09:10"))) == (datetime.datetime(2007, 6, 5, 8, 9, 10),)


def test_types(spark):
    assert spark_type("numeric(12, 3)").simpleString() == "decimal(12,3)"
    assert spark_type("DEC").simpleString() == "decimal(10,0)"
    assert spark_type("double  precision").simpleString() == "double"
    assert spark_type("price", {"price": "MONEY"}).simpleString() == "decimal(15,2)"
    assert one(spark, stored(F.lit("1990"), "CHAR(3)"), stored(F.lit("x"), "INT"), stored(F.lit("70000"), "SMALLINT")) == ("199", None, None)
    assert one(spark, F.lit("ABC").cast(spark_type("CHAR(3) COLLATE IGNORE_CASE")) == F.lit("abc")) == (True,)
    with pytest.raises(ValueError):
        spark_type("interval")


DOCS = [(1, "The quick brown-fox jumps over the lazy DOG"), (2, "quick the fox; brown Dog"), (3, "a dog and a fox and a quick one, quick!"), (4, None), (5, "")]


def test_full_text(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    system = fulltext.System(stop_words=frozenset({"the", "a"}))
    index = fulltext.postings(docs, system)
    ids = lambda q, **kw: sorted(r.doc_id for r in fulltext.search(index, q, system, **kw).collect())
    assert ids("quick AND dog") == [1, 2, 3]
    assert ids("fox OR lazy") == [1, 2, 3]
    assert ids("quick AND NOT lazy") == [2, 3]
    assert ids("NOT (fox OR lazy)", documents=docs) == [4, 5]
    assert ids("NOT (NOT fox)") == [2, 3]
    assert ids('"brown dog"') == [2]
    assert ids('"over the lazy"') == [1]
    assert ids("=DOG") == [1]
    assert ids("=Dog") == [1, 2]
    assert ids("brown-fox") == [1]
    assert ids("quick lazy") == [1]
    assert ids("quick dog") == [2]
    assert ids("jumps NEAR dog") == [1]
    weights = {r.doc_id: (r.weight, r.position) for r in fulltext.search(index, "quick OR dog", system).collect()}
    assert weights == {1: (1, 1), 2: (1, 0), 3: (2, 1)}
    for bad in ("(fox", "fox AND", "fox )", "OR fox"):
        with pytest.raises(ValueError):
            fulltext.parse(bad)
    changed = fulltext.add_documents(index, spark.createDataFrame([(2, "new words")], "doc_id long, text string"), system)
    assert sorted(r.doc_id for r in fulltext.search(changed, "quick OR new", system).collect()) == [1, 2, 3]
    assert spark.range(1).select(fulltext.snippet(F.lit(DOCS[0][1]), F.lit(1), 2, 2)).first()[0] == "The [quick] brown-fox jumps"


def test_changes_and_constraints(spark, tmp_path):
    t = spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (3, 30, None)], "id int, n int, s string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(dml.update(t, {"n": F.col("n") + F.col("id"), "id": F.col("id") * 2}, F.col("n") > 5)) == [(2, 11, "a"), (2, None, "b"), (6, 33, None)]
    assert sorted(r.id for r in dml.delete(t, F.col("n") > 5).collect()) == [2]
    assert dml.delete(t).count() == 0
    assert sorted(r.id for r in dml.insert(t, spark.createDataFrame([("z", 9)], "x string, y int"), ["s", "id"], {"n": F.lit(7)}).where("n = 7").collect()) == [9]
    assert dml.unique_violations(spark.createDataFrame([(1, None), (1, None), (2, 3), (2, 3)], "a int, b int"), ["a", "b"]).collect()[0].n == 2
    parent, child = t.select("id"), spark.createDataFrame([(7, 1), (8, 4), (9, None)], "c int, ref int")
    assert [r.c for r in dml.orphans(child, ["ref"], parent, ["id"]).collect()] == [8]
    moved = dml.cascade_update(parent, "id", F.col("id") + 100, F.col("id") == 1, child, "ref")
    assert sorted(r.id for r in moved[0].collect()) == [2, 3, 101]
    assert {r.c: r.ref for r in moved[1].collect()} == {7: 101, 8: 4, 9: None}
    t.write.parquet(f"{tmp_path}/t")
    dml.replace_table(dml.delete(spark.read.parquet(f"{tmp_path}/t"), F.col("id") == 1), f"{tmp_path}/t")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [2, 3]
    many = spark.range(1000).withColumn("k", 1000 - F.col("id"))
    assert [r.value for r in dml.sequence(many, ["k"], 10, 2).orderBy("k").collect()] == list(range(10, 2010, 2))


def test_cursors_and_routines(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, s string")
    assert cursors.aggregate(df, "SUM", "k").first()[0] == 6
    assert cursors.aggregate(df, "COUNT").first()[0] == 3
    assert cursors.look_up(df, "s", "b").count() == 1
    assert cursors.fetch(df, ["k"], -1).first().k == 3
    assert [r.k for r in cursors.rows_between(df, ["k"], 2, 3).collect()] == [2, 3]
    assert [r.k for r in cursors.without_repeats(df, ["s"], ["k"]).orderBy("k").collect()] == [1, 2]
    assert one(spark, cursors.find_text(F.lit("xAbab"), "ab", 1, True), cursors.find_text(F.lit("xAbab"), "ab", 5)) == (2, 0)
    df.createOrReplaceTempView("cur")
    assert cursors.single_value(spark, "SELECT max(k) FROM cur") == 3
    assert routines.prepare(spark, "SELECT k FROM cur WHERE k > ? AND s = ?")(1, "b").count() == 2
    assert routines.select_into(spark, "SELECT k, s FROM cur WHERE k = 1") == (1, "a")
    with pytest.raises(LookupError):
        routines.select_into(spark, "SELECT k FROM cur")
    assert routines.checked(spark, "SELECT k FROM cur WHERE k !< 2") == "struct<k:int>"


def values(spark, **sets):
    for name, rows in sets.items():
        spark.createDataFrame([(k, f"{name}{k}") for k in rows], f"k int, {name}_only string").createOrReplaceTempView(name)


def test_corresponding_chains_and_trailing_clauses(spark):
    values(spark, ca=[1, 2, 3, 4], cb=[2, 3], cc=[3])
    keys = lambda q: [r.k for r in sql_compat.run(spark, q).collect()]
    star = "SELECT * FROM"
    assert sorted(keys(f"{star} ca EXCEPT CORRESPONDING {star} cb EXCEPT CORRESPONDING {star} cc")) == [1, 4]
    assert keys(f"{star} ca EXCEPT CORRESPONDING {star} cb ORDER BY k DESC LIMIT 1") == [4]
    assert keys(f"{star} ca UNION ALL CORRESPONDING BY (k) {star} cb ORDER BY k LIMIT 1, 3") == [2, 2, 3]
    assert sorted(keys(f"{star} cc UNION CORRESPONDING {star} ca INTERSECT CORRESPONDING {star} cb")) == [2, 3]
    assert sorted(keys(f"({star} cc UNION CORRESPONDING {star} ca) INTERSECT CORRESPONDING ({star} cb LIMIT 9)")) == [2, 3]
    assert sorted(keys(f"WITH w AS (SELECT k FROM ca WHERE k > 1) {star} w EXCEPT CORRESPONDING {star} cb")) == [4]
    assert sorted(keys("SELECT k FROM ca UNION SELECT k FROM cb EXCEPT CORRESPONDING SELECT k FROM cc")) == [1, 2, 4]


def test_union_join_in_any_query(spark):
    values(spark, ua=[1, 2])
    spark.createDataFrame([(7, "x")], "m int, n string").createOrReplaceTempView("ub")
    rows = sql_compat.run(spark, "SELECT a.k, b.m + 1 AS more FROM ua AS a UNION JOIN ub b WHERE b.n = 'x' OR a.k < 2").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, None), (None, 8)]
    assert sql_compat.run(spark, "SELECT * FROM ua UNION JOIN ub").count() == 3


def test_index_is_a_hint_only_behind_a_table(spark):
    spark.createDataFrame([(5, 6)], "index int, k int").createOrReplaceTempView("ix")
    one = lambda q: tuple(sql_compat.run(spark, q).first())
    assert one("SELECT index AS k FROM ix") == (5,)
    assert one("SELECT k, index FROM ix WHERE index = 5 ORDER BY index") == (6, 5)
    assert one("SELECT i.index FROM ix i INDEX by_k WHERE k = 6") == (5,)
    assert one("SELECT k index FROM ix INDEX by_k") == (6,)


def test_tokens_and_escapes_of_spark_and_odbc(spark):
    one = lambda q: tuple(sql_compat.run(spark, q).first())
    assert one("SELECT NULL <=> NULL AS a, '7' :: int AS b, transform(array(1), x -> x + 1)[0] AS c") == (True, 7, 2)
    assert one("SELECT {fn UCASE('a')} AS a, {t '01:00:02'} AS t, {fn IFNULL(NULL, 3)} AS n") == ("A", 3602000, 3)
    assert one("{call abs(-4)}") == (4,) and one("{? = call abs(-4)}") == (4,)
    with pytest.raises(ValueError):
        sql_compat.run(spark, "SELECT {guid 'x'} AS a")


def test_dates_outside_their_ranges_and_exact_quotients(spark):
    rows = [(310, 1, 2000), (1, 123, 2000), (1, 1, 12345), (29, 2, 1999), (29, 2, 2000), (1, 1, -4), (None, 1, 1)]
    df = spark.createDataFrame(rows, "d int, m int, y int")
    assert [str(r[0]) for r in df.select(dates.make_date(F.col("d"), F.col("m"), F.col("y"))).collect()] == ["None"] * 4 + ["2000-02-29", "None", "None"]
    big = spark.createDataFrame([(9007199254740993, 1), (-7, 2)], "a long, b long")
    assert [r[0] for r in big.select(numbers.div(F.col("a"), F.col("b"))).collect()] == [9007199254740993, -3]
    assert big.groupBy("b").agg(numbers.legacy_avg(F.col("a")).alias("v")).where("b = 1").first().v == 9007199254740993


def test_sequence_bounds_and_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d")], "k int, s string")
    got = lambda **o: [r.value for r in dml.sequence(df, ["k"], **o).orderBy("k", "s").collect()]
    assert got(start=2, maximum=3, cycle=True) == [2, 3, 1, 2]
    assert got(start=5, step=-2, minimum=2, maximum=6, cycle=True) == [5, 3, 6, 4]
    assert got(maximum=4) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="exhausted"):
        got(maximum=3)


def test_written_index_and_single_pass(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The cat and the dog"), (2, "a DOG"), (3, "cat cat"), (4, None)], "doc_id long, text string")
    index = fulltext.postings(docs)
    fulltext.write_index(index, f"{tmp_path}/ix")
    written = spark.read.parquet(f"{tmp_path}/ix")
    for query in ("cat", "cat AND dog", "cat OR dog", "dog AND NOT cat", "(cat OR =DOG) AND NOT the", '"the dog" OR a', "NOT (cat AND dog)"):
        plain = sorted(map(tuple, fulltext.search(index, query, documents=docs).collect()))
        assert plain == sorted(map(tuple, fulltext.search(written, query, documents=docs).collect())), query
    assert sorted(map(tuple, fulltext.search(index, "cat OR dog").collect())) == [(1, 1, 1), (2, 1, 1), (3, 2, 0)]
    assert sorted(map(tuple, fulltext.search(index, "=DOG").collect())) == [(2, 1, 1)]
    assert [f for f in fulltext.search(written, "cat")._jdf.queryExecution().toString().split() if "PushedFilters" in f]
    with pytest.raises(ValueError):
        fulltext.parse('cat AND "the dog')


def test_fulltext_statements(spark):
    docs = [(1, "The cat-fish and the dog"), (2, "a DOG"), (3, "cat cat"), (4, None)]
    spark.createDataFrame(docs, "id long, body string").createOrReplaceTempView("ft_docs")
    run = lambda q, **o: sorted(map(tuple, sql_compat.run(spark, q, **o).collect()))
    ddl.execute(spark, "CREATE FULLTEXT ft_a LANGUAGE = 3 NOT LEMMATIZED SEPARATED LIMITS '9' (ft_docs id body)")
    assert run("SELECT id FROM ft_docs WHERE FULLTEXT(ft_a, id, 'cat OR \"a dog\"')") == [(2,), (3,)]
    assert run("SELECT id FROM ft_docs WHERE FULLTEXT('ft_a', ft_docs.id, :q)", args={"q": "NOT cat"}) == [(1,), (2,), (4,)]
    assert run("SELECT d.id, @@FULLTEXT_WEIGHT AS w FROM ft_docs d WHERE id < 9 AND FULLTEXT(ft_a, d.id, 'cat')") == [(3, 2)]
    ddl.execute(spark, "CREATE FULLTEXT ft_b WORD_STARTERS 'a-zA-Z' WORD_CHARS 'a-zA-Z' (ft_docs id body)")
    assert run("SELECT id FROM ft_docs WHERE FULLTEXT(ft_b, id, 'cat')") == [(1,), (3,)]
    spark.createDataFrame([(5, "cat")], "id long, body string").createOrReplaceTempView("ft_docs")
    ddl.execute(spark, "ALTER FULLTEXT ft_b")
    assert run("SELECT id FROM ft_docs WHERE FULLTEXT(ft_b, id, 'cat')") == [(5,)]
    for wrong in ("CREATE FULLTEXT ft_b (ft_docs id body)", "CREATE FULLTEXT ft_c LEMMATIZED (ft_docs id body)"):
        with pytest.raises(ValueError):
            ddl.execute(spark, wrong)
    for name in ("ft_a", "ft_b"):
        ddl.execute(spark, f"DROP FULLTEXT {name}")
        assert not spark.catalog.tableExists(name)


def test_emphasis_of_parts(spark):
    docs = spark.createDataFrame([(1, "Cat", "cat dog", None), (2, None, "cat", "dog cat")], "doc_id long, title string, body string, head string")
    index = fulltext.postings(docs, parts={"title": 2, "body": 0, "head": 1})
    got = lambda q: sorted(map(tuple, fulltext.search(index, q).collect()))
    assert got("cat") == [(1, 102, 0), (2, 12, 0)]
    assert got("dog") == [(1, 1, 2), (2, 11, 1)]
    assert got('"cat dog"') == [(1, 1, 1), (2, 1, 0)]
    assert got("cat AND dog") == [(1, 1, 0), (2, 11, 0)]


def test_values_parts_and_pointers_in_sql(spark):
    spark.createDataFrame([(1, [5, 6], "abcdef", 2), (2, None, None, None)], "k int, v array<int>, t string, p int").createOrReplaceTempView("vp")
    run = lambda q, **o: sorted(map(tuple, sql_compat.run(spark, q, **o).collect()), key=str)
    assert run("SELECT k, v# AS n, x.v[k - 1] AS e, t[1, 2] AS s, t# AS b FROM vp AS x WHERE k = 1") == [(1, 2, 5, "bc", 6)]
    assert run("SELECT x.k, x.p^.t IS NULL AS none, p^.k AS to FROM vp x", pointers={"p": ("vp", "k")}) == [(1, True, 2), (2, True, None)]
    assert run("SELECT 5 ^ 1 AS x, transform(array(1, 2), y -> y + 1)[1] AS z") == [(4, 3)]
    ddl.execute(spark, "CREATE TABLE quern_child (c INTEGER REFERENCES vp (k))")
    spark.createDataFrame([(1,), (7,)], "c int").write.insertInto("quern_child")
    assert run("SELECT c, c^.t AS t FROM quern_child") == [(1, "abcdef"), (7, None)]
    ddl.execute(spark, "DROP TABLE quern_child")
    user, schema = sql_compat.run(spark, "SELECT WHO_AM_I AS u, LOCAL_SCHEMA_NAME() AS s WHERE TODAY() = current_date").first()
    assert user and schema == "default"


def test_signal_and_words_in_literals(spark):
    body = "BEGIN DECLARE x STRING = 'SIGNAL a;'; BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SET x = x || '!'; END; SIGNAL stop_here; SET x = 'not reached'; END; SELECT x AS x; END"
    assert routines.script(spark, body).first().x == "SIGNAL a;!"
    with pytest.raises(Exception, match="45001"):
        routines.script(spark, "BEGIN SIGNAL SQLSTATE '45001'; SELECT 1 AS k; END").collect()


def test_extremes_come_from_footers(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 0.5D AS x").write.parquet(f"{tmp_path}/t")
    df = catalog.extremes(spark, f"{tmp_path}/t", ["id", "x"])
    assert tuple(df.first()) == (0, 9, 0.0, 4.5)
    assert "PushedAggregation: [MIN(id)" in df._jdf.queryExecution().toString()
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
