import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.plans import catalogue, ddl
from quern.sources import dbf, etl, infoviews, markup
from quern.streaming import events

COLUMNS = {"id": "int", "name": "string", "price": "double", "day": "date", "good": "boolean"}
ROWS = [(1, "a;b", 1.5, datetime.date(2001, 2, 3), True), (2, 'q"q', None, None, False), (3, "žluť", -2.25, datetime.date(1999, 12, 31), None)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
    form = etl.Format(separator=";", decimal=",", encoding="CP1250", true="ANO", false="NE")
    etl.write_csv(df, f"{tmp_path}/c", form)
    assert sorted(map(tuple, etl.read_csv(spark, f"{tmp_path}/c", COLUMNS, form).collect())) == ROWS


@pytest.fixture
def plain_session(spark):
    """The session as another program may have made it: Spark's own list of encodings."""
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, before)


def test_csv_round_trip_query_in_a_plain_session(plain_session, tmp_path):
    """Names with marks, blanks, separators, line breaks, quotes, empty and null."""
    rows = [(1, "Žluťoučký kůň €", 7, -1.5), (2, " blanks  ", None, None), (3, 'a;b\n"c"\r\nd,e', 0, 1e15), (4, "", 1, 0.1), (5, None, 2, -0.0), (None, "#x\\", 3, 1e-7)]
    plain_session.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalogue.QUERIES["csv_round_trip"](plain_session, str(tmp_path))
    assert found.dtypes == [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize(("encoding", "python", "text"), [("CP1250", "cp1250", "žluť€"), ("CP1252", "cp1252", "été€"), ("8859-1", "latin-1", "été"), ("8859-2", "iso8859-2", "žluť"), ("IBM852", "cp852", "žluť")])
def test_files_hold_the_bytes_of_their_encoding(plain_session, tmp_path, encoding, python, text):
    df = plain_session.createDataFrame([(1, text)], "id int, `dé` string").coalesce(1)
    form = etl.Format(separator="§" if encoding != "IBM852" else "|", encoding=encoding)
    etl.write_csv(df, f"{tmp_path}/c", form)
    (file,) = (tmp_path / "c").glob("part-*")
    assert file.read_bytes() == f"id{form.separator}dé\n1{form.separator}{text}\n".encode(python)
    assert [tuple(r) for r in etl.read_csv(plain_session, f"{tmp_path}/c", {"id": "int", "dé": "string"}, form).collect()] == [(1, text)]
    skipping = etl.Format(separator=form.separator, encoding=encoding, header=False, skip_lines=1)
    assert [tuple(r) for r in etl.read_csv(plain_session, f"{tmp_path}/c", {"id": "int", "dé": "string"}, skipping).collect()] == [(1, text)]
    etl.write_fixed(df, f"{tmp_path}/f", [2, 6], etl.Format(header=False, encoding=encoding))
    (file,) = (tmp_path / "f").glob("part-*")
    assert file.read_bytes() == f"1 {text:6}\n".encode(python)
    assert etl.read_fixed(plain_session, f"{tmp_path}/f", [("id", 2, "int"), ("s", 6, "string")], etl.Format(header=False, encoding=encoding)).first().s == text


def test_a_character_that_the_encoding_lacks_is_an_error(plain_session, tmp_path):
    for text in ("日本", "ñ"):
        with pytest.raises(Exception, match="CP1250 has no code"):
            etl.write_csv(plain_session.createDataFrame([(text,)], "s string"), f"{tmp_path}/{ord(text[0])}", etl.Format(encoding="CP1250"))


def test_csv_with_lines_to_skip(spark, tmp_path):
    (tmp_path / "f.csv").write_text("about\nid;v\nid;v\n1;2,5\nx;y\n1;2,5\n")
    form = etl.Format(separator=";", decimal=",", skip_lines=1)
    assert sorted(map(tuple, etl.read_csv(spark, str(tmp_path / "f.csv"), {"id": "int", "v": "double"}, form).collect()), key=str) == [(1, 2.5), (1, 2.5), (None, None), (None, None)]


def test_fixed_width(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (22, None)], "n int, s string")
    etl.write_fixed(df, f"{tmp_path}/f", [4, 6])
    assert sorted(map(tuple, etl.read_fixed(spark, f"{tmp_path}/f", [("n", 4, "int"), ("s", 6, "string")]).collect())) == [(1, "ab"), (22, None)]


def test_dbf(spark, tmp_path, monkeypatch):
    rows = [(1, "abc", True, datetime.date(2001, 2, 3), Decimal("12.50"), 1.25), (2, None, None, None, None, None), (3, "š", False, datetime.date(1999, 1, 1), Decimal("-3.00"), -2.0)]
    df = spark.createDataFrame(rows, "id long, s string, b boolean, d date, m decimal(8,2), f double").coalesce(1)
    dbf.write(df, f"{tmp_path}/t.dbf", {"s": 10})
    dbf.register(spark)
    back = spark.read.format("dbf").load(f"{tmp_path}/t.dbf")
    assert sorted(map(tuple, back.collect())) == rows


def test_xml_and_transport(spark, tmp_path):
    df = spark.createDataFrame([(1, "x<y"), (2, "z")], "id long, s string")
    etl.write_xml(df, f"{tmp_path}/x")
    assert sorted(map(tuple, etl.read_xml(spark, f"{tmp_path}/x", "row", "id long, s string").collect())) == [(1, "x<y"), (2, "z")]
    moved = etl.transport(spark.createDataFrame([("1", "2.3.2004"), ("x", "?")], "a string, b string"), "a <> ''", {"n": ("a", "INT"), "d": ("b", "DATE")})
    assert sorted(map(tuple, moved.collect()), key=str) == [(1, datetime.date(2004, 3, 2)), (None, None)]


def test_markup(spark):
    html = "<html><head><title>t</title></head><body><p>A&amp;B</p><script>x<1</script> c\n d<!-- no --></body>"
    assert spark.range(1).select(markup.html_text(F.lit(html))).first()[0] == "A&B c d"


def test_info_views(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert infoviews.table_space(spark, ["three"]).first().n_rows == 3
    assert infoviews.table_columns(spark).where("table_name = 'three'").count() == 1
    assert infoviews.type_info(spark).count() > 10


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.write.parquet(f"{tmp_path}/in")
    stream = events.by_window(events.source(spark, f"{tmp_path}/in", "*.parquet"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    plain = lambda df: sorted((r.event_type, r.start, r.n) for r in df.collect())
    assert plain(spark.table("counted")) == plain(events.by_window(batch))


def test_definitions_and_their_views(spark):
    domains = {}
    run = lambda s: ddl.execute(spark, s, domains)
    run("CREATE DOMAIN amount NUMERIC(12, 2)")
    run("CREATE TABLE orders_d (id INT NOT NULL PRIMARY KEY, total amount DEFAULT 1.5 CHECK (total > 0), note VARCHAR(20) REFERENCES notes (n), CONSTRAINT c UNIQUE (id, note), FOREIGN KEY (note) REFERENCES notes (n))")
    assert spark.table("orders_d").dtypes == [("id", "int"), ("total", "decimal(12,2)"), ("note", "string")]
    spark.sql("INSERT INTO orders_d (id, note) VALUES (1, 'x')")
    assert tuple(spark.table("orders_d").first()) == (1, Decimal("1.50"), "x")
    kinds = sorted((r.kind, r.text) for r in infoviews.constraints(spark).where("table_name = 'orders_d'").collect())
    assert [k for k, _ in kinds] == ["CHECK", "FOREIGN KEY", "FOREIGN KEY", "PRIMARY KEY", "UNIQUE"] and kinds[0][1] == "(total > 0)"
    run("ALTER TABLE orders_d DROP COLUMN note")
    run("ALTER TABLE orders_d ADD COLUMN at DATE")
    run("RENAME TABLE orders_d TO orders_e")
    assert spark.table("orders_e").columns == ["id", "total", "at"] and spark.table("orders_e").count() == 1
    run("DROP TABLE orders_e")
    assert not spark.catalog.tableExists("orders_e") and "amount" in domains
    run("DROP DOMAIN amount")
    assert not domains and infoviews.session_info(spark).first().schema_name == "default"


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:quern;create=true"
    df = spark.createDataFrame([(k, f"n{k}") for k in range(50)], "id int, name string")
    etl.write_jdbc(df, url, "numbers", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = etl.read_jdbc(spark, url, "numbers", column="id", bounds=(0, 50), partitions=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_external_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\xff")
    row = etl.read_files(spark, str(tmp_path)).first()
    assert bytes(row.content) == b"\x00\xff" and row.length == 2


def test_foxpro_memo(spark, tmp_path):
    """Blocks of 64 bytes; memo numbers as text and as four bytes."""
    import struct

    for kind, width, number in (("text", 10, lambda n: (str(n) if n else "").rjust(10).encode()), ("bytes", 4, lambda n: n.to_bytes(4, "little"))):
        path = f"{tmp_path}/{kind}"
        field = b"NOTE".ljust(11, b"\0") + b"M" + bytes(4) + bytes([width, 0]) + bytes(14)
        records = b"".join(b" " + number(n) for n in (8, 0, 10))
        with open(f"{path}.dbf", "wb") as f:
            f.write(struct.pack("<BBBBIHH", 0xF5, 120, 1, 1, 3, 32 + 32 + 1, 1 + width).ljust(32, b"\0") + field + b"\r" + records + b"\x1a")
        with open(f"{path}.fpt", "wb") as f:
            long = ("ä" * 100).encode("cp852")
            f.write(struct.pack(">IHH", 13, 0, 64).ljust(512, b"\0") + (struct.pack(">II", 1, 5) + b"first").ljust(128, b"\0") + struct.pack(">II", 1, len(long)) + long)
        dbf.register(spark)
        assert [r.NOTE for r in spark.read.format("dbf").load(f"{path}.dbf").collect()] == ["first", None, "ä" * 100]
