"""Format matching against the double loop over tables and formats, and the repair of codes against plain substitutions."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import formats

TABLES = "company_id long, upload_id long, table_idx long, header array<string>, n_columns int, n_rows int, has_header boolean, h2 string, g string"
FORMATS = "company_id long, format_id long, last_used long, header array<string>, n_columns int, n_rows int, has_header boolean, score string"


def likeness(a, b):
    if not a or not b:
        return 0.0
    rest, exact, left = list(b), 0, []
    for x in a:
        if x in rest:
            rest.remove(x)
            exact += 1
        else:
            left.append(x)
    fuzzy = 0
    for x in left:
        scores = [SequenceMatcher(None, x, y).ratio() for y in rest]
        if scores and max(scores) > 0.6:
            del rest[scores.index(max(scores))]
            fuzzy += 1
    return exact / max(len(a), len(b)) * 0.8 + fuzzy / max(len(a), len(b)) * 0.2


def shape(a, b):
    def near(x, y, same, close, worth):
        most, away = max(x, y), abs(x - y)
        return 0.0 if most <= 0 else 1.0 if away <= same else worth if away <= close else max(0.0, 1 - away / most)

    return (near(a[0], b[0], 2, 4, 0.7) + near(a[1], b[1], 5, 10, 0.8) + (1.0 if a[2] == b[2] else 0.5)) / 3


def test_best_formats(spark):
    rng = random.Random(3)
    names = ["Client Name", "client name", "Clients Name", "Premium", "Premium Amt", "Premium Amount", "Rate", "Rate %", "Group No", "Group No.", "Paid", "Paid Date", "", None, "Commission Earned", "Comm. Earned"]
    head = lambda: [rng.choice(names) for _ in range(rng.randrange(0, 7))]
    tables = [(rng.randrange(3), u, i, head(), rng.randrange(0, 9), rng.randrange(0, 30), rng.random() < 0.5, "x", "y") for u in range(60) for i in range(2)]
    known = [(rng.randrange(3), f, rng.randrange(20), head() if rng.random() < 0.6 else rng.choice(tables)[3], rng.randrange(0, 9), rng.randrange(0, 30), rng.random() < 0.5, "z") for f in range(40)]
    t, f = spark.createDataFrame(tables, TABLES), spark.createDataFrame(known, FORMATS)
    plain = lambda df: [r.c for r in df.select(formats.canonical(F.col("header")).alias("c")).collect()]
    heads, forms = plain(t), plain(f)
    for least in (0.5, 0.4):
        want = {}
        for row, h in zip(tables, heads):
            scores = [(likeness(h, g) * 0.8 + shape(row[4:7], k[4:7]) * 0.2, k[2], -k[1]) for k, g in zip(known, forms) if k[0] == row[0]]
            best = max(scores, default=(0,))
            if best[0] > least:
                want[row[1:3]] = (-best[2], round(best[0], 9))
        got = {(r.upload_id, r.table_idx): (r.format_id, round(r.score, 9)) for r in formats.best_formats(t, f, least).collect()}
        assert got == want and len(want) > 20
    assert formats.best_formats(t.where("upload_id < 0"), f).count() == 0 and formats.best_formats(t, f.where("format_id < 0")).count() == 0


def repaired(name):
    def rule(pattern, make, x):
        return re.sub(pattern, make(re.search(pattern, x)), x)

    five = lambda m: m[1] + "0" * (5 - len(m[2])) + m[2]
    seen = re.search(r"([A-Z]{2})O+(\d+)", name)
    x = rule(r"([A-Z]{2})O+(\d+)", five, name) if seen else name
    m = re.search(r"([A-Z]{2}\d+)O+", x)
    if m and len(m[1]) < 7:
        x = rule(r"([A-Z]{2}\d+)O+", lambda m: m[1].ljust(7, "0"), x)
    m = re.search(r"([A-Z]{2})[0O]+(\d+)", x)
    if m and (seen is None or m[0] != seen[0]):
        x = rule(r"([A-Z]{2})[0O]+(\d+)", five, x)
    return rule(r"([A-Z]{2}\d)O(\d+)", lambda m: f"{m[1]}0{m[2]}", x) if re.search(r"([A-Z]{2}\d)O(\d+)", x) else x


def test_repaired_codes(spark):
    rng = random.Random(1)
    names = ["", "Acme", "B & D MNOO867", "MD005OO x", "MN0O867", "MN0O67 LAO9", "NYOO12345678", "FOOD 12 CO9"] + ["".join(rng.choice(["MN", "O", "0", "7", "48", " ", "x", "LA"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    got = [r.x for r in spark.createDataFrame(list(enumerate(names)), "id long, n string").orderBy("id").select(S.repair_state_codes(F.col("n")).alias("x")).collect()]
    assert got == [repaired(n) for n in names]
    assert spark.createDataFrame([(None,)], "n string").select(S.repair_state_codes(F.col("n")).alias("x")).first().x is None
