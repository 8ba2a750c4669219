"""Parsers, ledger laws, table operators and streams on small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import fuzzy, ledger, tables
from ledgerloom.plans.reads import scope
from ledgerloom.streaming import events as stream


def one(spark, f, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(f(F.col("c"))).collect()]


CELLS = ["$1,234.56", "(5.00)", "($5.00)", "-5", "-$5", "$ 5", "5%", "abc", "", "1e5", "1d", "1_000"]


@pytest.mark.parametrize(
    "f, expected",
    [
        (S.amount_ledger, [1234.56, -5, -5, -5, -5, 5, 0, 0, 0, 1e5, 0, 0]),
        (S.amount_legacy, [1234.56, -5, -5, -5, -5, 5, 5, 0, 0, 15, 1, 1000]),
        (S.amount_strict, [1234.56, -5, -5, -5, -5, 5, None, None, None, 1e5, None, None]),
        (S.amount_tolerant, [1234.56, -5, -5, -5, -5, 5, None, None, None, 1e5, None, None]),
        (S.amount_client, [1234.56, 5, 5, -5, -5, 5, 5, 0, 0, 15, 1, 1000]),
    ],
)
def test_amounts(spark, f, expected):
    assert one(spark, f, CELLS) == expected


def test_brackets_dates_headers(spark):
    assert one(spark, S.bracket_rewrite, ["(1,234.5)", "($5.00)", "plain", "($1,234.56)"]) == ["-$1234.5", "-$5.00", "plain", "-$1234.56"]
    assert one(spark, S.statement_date, ["01/15/2025", "2025-01-15", "January 15, 2025", "Jan 15, 2025", "13/01/2025", "junk", None]) == [dt.date(2025, 1, 15)] * 4 + [dt.date(2025, 1, 13), None, None]
    assert one(spark, S.range_start, ["01/01/2025 through 01/31/2025", "01/01/2025"]) == ["01/01/2025"] * 2
    assert one(spark, S.header, ["Commission \nAmount", "  a  b "]) == ["Commission Amount", "a b"]
    assert one(spark, S.match_name, ["Acme Corp", "ACME, Inc.", "LLC", "AcmeLLC", "Acme Limited Liability Co."]) == ["acme", "acme", "llc", "acme", "acme"]
    assert one(spark, S.value_type, ["01/02/2024", "$5.00", "5%", "1,000", "x", " "]) == ["date", "currency", "percentage", "number", "text", "empty"]


def test_similarity_is_symmetric(spark):
    df = spark.createDataFrame([("acme west", "acme east"), ("a b", "a b"), ("x", "y")], "a string, b string")
    for r in df.select(S.name_similarity(F.col("a"), F.col("b")).alias("p"), S.name_similarity(F.col("b"), F.col("a")).alias("q"), (F.col("a") == F.col("b")).alias("e")).collect():
        assert r.p == pytest.approx(r.q)
        assert not r.e or r.p == 1


@pytest.fixture
def rows(spark):
    data = [(c, n, m, 2024, u, e, i, dt.datetime(2024, m, 1), inv, com) for c, n, m, u, e, i, inv, com in [(1, "a", 1, 7, "x", 10, 5, 1), (1, "a", 1, 7, "x", 11, 7, 2), (1, "b", 2, None, None, 10, 3, 1), (2, "a", 1, 7, "x", 12, 9, 4)]]
    return spark.createDataFrame(data, "carrier_id int, client_name string, month int, year int, user_id long, environment_id string, upload_id long, statement_date timestamp_ntz, invoice int, commission int").withColumn("invoice", F.col("invoice").cast("decimal(15,2)")).withColumn("commission", F.col("commission").cast("decimal(20,4)"))


def snapshot(df):
    return sorted(((r.carrier_id, r.client_name, r.month, r.user_id, float(r.invoice_total), tuple(r.upload_ids)) for r in df.collect()), key=str)


def test_ledger_replay_changes_nothing(rows):
    built = ledger.build(rows)
    assert snapshot(ledger.merge(built, built)) == snapshot(built)


def test_ledger_add_then_retract(rows):
    first, second = ledger.build(rows.where("upload_id <> 11")), ledger.build(rows.where("upload_id = 11"))
    both = ledger.merge(first, second)
    assert snapshot(both) == snapshot(ledger.build(rows))
    assert snapshot(ledger.retract(both, second, 11)) == snapshot(first)


def test_ledger_null_keys_meet(rows):
    old, new = ledger.build(rows.where("client_name = 'b'")), ledger.build(rows.where("client_name = 'b'").withColumn("upload_id", F.lit(99).cast("long")))
    assert [x[4:] for x in snapshot(ledger.merge(old, new))] == [(6.0, (10, 99))]


def test_carrier_merge(rows):
    out = snapshot(ledger.rekey_carrier(ledger.build(rows), 2, 1))
    assert (1, "a", 1, 7, 21.0, (10, 11, 12)) in out and len(out) == 2


def test_tables(spark):
    grid = [["acme", "$5.00"], ["beta", "$7.00"], ["Total", "$12.00"], ["gamma", None], ["short"]]
    df = spark.createDataFrame([(1, [(["Name ", "Paid\nAmount"], grid, [2])])], "upload_id long, tables array<struct<header array<string>, rows array<array<string>>, summaryRows array<int>>>".replace("struct<header array", "struct<header: array").replace(", rows array", ", rows: array").replace(", summaryRows array", ", summaryRows: array"))
    r = tables.explode_tables(df)
    assert {tuple(x.cells) for x in r.collect()} == {("acme", "$5.00"), ("beta", "$7.00"), ("Total", "$12.00"), ("gamma", ""), ("short", "")}
    assert {x.client_name for x in tables.flatten(r, "Name", "Paid Amount", "none").collect()} == {"acme", "beta"}
    t = df.select(F.col("tables")[0]["header"].alias("header"), F.transform(F.col("tables")[0]["rows"], lambda x: S.pad_row(x, 2)).alias("rows"), F.array(F.lit(1)).alias("numeric"))
    assert tables.running_summaries(t).first().summaries == [2]
    assert tables.refined_summaries(t.withColumn("summaries", F.array(F.lit(4)))).first().summaries == [2, 4]  # marks stay unless a row is dense and named
    assert {x.name: x.kind for x in tables.column_profile(r).collect()} == {"Name": "text", "Paid Amount": "currency"}
    heads = [(["total amount", "commission due"], 1, 0), (["client name", "amount"], 1, 1), (["Paid Amount"], 3, 0), (["rate"], 2, 2), (["Total paid"], 3, 0), (["Total paid"], 4, 4)]
    g = spark.createDataFrame(heads, "h array<string>, n int, s int")
    assert [x[0] for x in g.select(tables.is_grand_total(F.col("h"), F.col("n"), F.col("s"))).collect()] == [True, False, False, True, True, False]
    p = spark.createDataFrame([("abcd", "bcde")], "a string, b string")
    assert tables.difflib_ratio(p, "a", "b").first().ratio == 0.75


def test_wide_table(spark):
    header = ["Name", *(f"c{i}" for i in range(98)), "Commission"]
    grid = [["acme", *["x"] * 98, "$5.00"], ["short"]]
    df = spark.createDataFrame([(1, [(header, grid, [])])], "upload_id long, tables array<struct<header: array<string>, rows: array<array<string>>, summaryRows: array<int>>>")
    r = tables.explode_tables(df)
    assert [len(x.cells) for x in r.collect()] == [100, 100]
    assert [(x.client_name, float(x.commission)) for x in tables.flatten(r, "Name", "Commission", "none").collect()] == [("acme", 5.0)]


def test_scope(spark):
    people = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None)], "user_id long, company_id int")
    data = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    ids = lambda *a, **k: sorted(r.user_id for r in scope(data, people, *a, **k).collect())
    assert ids(1, "my_data") == [1] and ids(1, "all_data") == [1, 2] and ids(4, "all_data") == [4] and ids(1, "my_data", admin=True) == [1, 2, 3, 4]


def test_greedy_groups(spark):
    df = spark.createDataFrame([(1, "Acme Widgets Inc"), (2, "Acme Widget LLC"), (3, "Zeta Co"), (4, "acme widgets")], "id long, name string")
    led = {r.id: r.leader for r in fuzzy.greedy_groups(df).collect()}
    assert led[1] == led[2] == led[4] and led[3] == "zeta"


def test_greedy_groups_like_a_loop(spark):
    """The same leaders as a loop over all names in the order of their ids."""
    import random

    rng = random.Random(4)
    words = ["acme", "acm", "north", "northern", "freight", "fre", "works", "global", "box", "services", "serv"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    distinct = df.select("id", S.match_name(F.col("name")).alias("core")).groupBy("core").agg(F.min("id").alias("n")).orderBy("n").collect()
    x = spark.createDataFrame([(a.core, b.core) for a in distinct for b in distinct if a.n < b.n and a.core[:3] == b.core[:3]], "x string, y string")
    near = {(r.x, r.y) for r in x.where(S.name_similarity(F.col("x"), F.col("y")) >= 0.85).collect()}
    leaders, want = [], {}
    for r in distinct:
        found = next((c for c in leaders if (c, r.core) in near), None)
        if found is None:
            leaders.append(r.core)
        want[r.core] = found or r.core
    assert {r.core: r.leader for r in fuzzy.greedy_groups(df).collect()} == want


EVENTS = [(1, 0, "click"), (2, 10, "error"), (3, 20, "error"), (4, 30, "error"), (5, 40, "click"), (6, 4000, "click"), (7, 4010, "error")]


def events(spark):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + dt.timedelta(seconds=s), 1, k, 1.0) for i, s, k in EVENTS], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_events(spark):
    e = events(spark)
    assert [r.in_hour for r in stream.sliding_rate(e, 3600, 3).orderBy("event_id").collect()] == [1, 2, 3, 4, 5, 1, 2]
    assert sorted(r.beats for r in stream.sessions(e, 300).collect()) == [2, 5]
    assert {r.event_id for r in stream.replay(e, 2).collect()} == {6, 7}


def test_streams_match_batch(spark, tmp_path):
    events(spark).repartition(1).write.parquet(str(tmp_path / "e"))
    source = lambda: spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "e"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    assert sorted(r.n for r in drain(stream.streamed_rate(source(), "1 hour", "1 hour"), "rate", "complete")) == [2, 5]
    assert sorted(r.beats for r in drain(stream.streamed_sessions(source(), "300 seconds", "1 hour"), "live", "complete")) == [2, 5]
