"""Names: keys against all pairs, groups against a loop, names of any length, chains, and names that share their first words."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import fuzzy


def frame(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "id long, name string")


def some_names(rng, n):
    words = ["north", "northern", "american", "freight", "fre", "works", "global", "globe", "box", "services", "serv", "acme", "acm", "a1", "and", "logistics", "co"]
    out = []
    for _ in range(n):
        w = [rng.choice(words) if rng.random() < 0.8 else rng.choice("xyz") * 3 + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, 9, 11]))]
        out.append(" ".join(w))
        while rng.random() < 0.5:
            other = list(w)
            change = rng.randrange(5)
            k = rng.randrange(len(w))
            if change == 0:
                other[k] = other[k][:-1] or "q"
            elif change == 1:
                del other[k]
            elif change == 2:
                other.insert(k, rng.choice(words))
            elif change == 3:
                other = ["".join(other)]
            out.append((" ".join(other) + rng.choice(["", " llc", ", Inc.", "corp"])).strip() or "q")
    return out


def near_of(spark, cores, least, blocked):
    c = spark.createDataFrame(cores, "n long, core string")
    x = c.select(F.col("n").alias("i"), F.col("core").alias("x")).join(c.select(F.col("n").alias("j"), F.col("core").alias("y")), F.col("i") < F.col("j"))
    if blocked:
        x = x.where(F.substring("x", 1, 3) == F.substring("y", 1, 3))
    return {(r.i, r.j) for r in x.where(S.name_similarity(F.col("x"), F.col("y")) >= least).select("i", "j").collect()}


def test_keys_are_complete(spark):
    names = some_names(random.Random(6), 260)
    cores = [(r.n, r.core) for r in frame(spark, names).select(F.col("id").alias("n"), S.match_name(F.col("name")).alias("core")).groupBy("core").agg(F.min("n").alias("n")).collect() if r.core]
    held = spark.createDataFrame(cores, "n long, core string")
    for least, blocked in ((0.75, False), (0.85, True)):
        want = near_of(spark, cores, least, blocked)
        got = [(r.i, r.j) for r in fuzzy.alike_names(held, least, blocked).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_groups_equal_a_loop(spark):
    names = some_names(random.Random(7), 160) + ["", " ", "LLC", "Acme & Co", "acme and company", "A1 box", "a1box", "Arc Couriers", "ArcCouriers LLC"]
    df = frame(spark, names)
    norms = {r.id: r.n for r in df.select("id", S.company_name(F.col("name")).alias("n")).collect()}
    cores = {r.id: r.c for r in df.select("id", S.match_name(F.col("name")).alias("c")).collect()}
    near = near_of(spark, [(i, c) for i, c in cores.items()], 0.75, False)
    done, want = set(), {}
    for i in range(len(names)):
        if i in done:
            continue
        group = [i] + [j for j in range(i + 1, len(names)) if j not in done and (norms[i].lower() == norms[j].lower() or (cores[i] == cores[j] and cores[i]) or (cores[i] and cores[j] and (i, j) in near))]
        done |= set(group)
        canonical = max((norms[j] for j in group), key=len)
        want |= {j: (i, canonical, len(group)) for j in group}
    assert {r.id: (r.leader, r.canonical, r.size) for r in fuzzy.company_groups(df).collect()} == want
    assert fuzzy.company_groups(df.where("id < 0")).count() == 0
    assert fuzzy.company_groups(df.select("id", F.lit(None).cast("string").alias("name"))).count() == 0


def normal(name):
    """The normal form by plain steps."""
    if not name.strip():
        return name
    t = re.sub(r"[,._-]", " ", re.sub(r"\s+", " ", name.strip())).replace("&", " and ").replace("+", " and ")
    low = t.lower()
    for w in S.BUSINESS_WORDS:
        if re.search(f"[a-z0-9]+{w}", low) and (m := re.search(f"([a-z0-9]+)({w})([a-z]*)", t, re.I)):
            t = t[: m.start()] + m[1] + " " + w + (" " + m[3] if m[3] else "") + t[m.end() :]
    t, suffix = t.lower().strip(), ""
    for s in sorted(S.CANONICAL_SUFFIXES, key=len, reverse=True):
        if t.endswith(s) and len(t) > len(s) and t[len(t) - len(s) - 1] != " ":
            t, suffix = t[: -len(s)], S.CANONICAL_SUFFIXES[s]
            break
    parts = t.split()
    if not suffix:
        for i in range(max(0, len(parts) - 3), len(parts)):
            if " ".join(parts[i:]) in S.CANONICAL_SUFFIXES:
                parts, suffix = parts[:i], S.CANONICAL_SUFFIXES[" ".join(parts[i:])]
                break
    parts = [p.upper() if re.fullmatch(r"[0-9]+[a-z]+|[a-z][0-9]+", p) else p[0].upper() + p[1:] for p in parts if p not in S.SMALL_WORDS]
    return (" ".join(parts) + (f" {suffix}" if suffix else "")).strip() or name


def test_normal_forms(spark):
    names = some_names(random.Random(8), 200)
    names += ["Alcologistics LLC", "ALCOLOGISTICS,INC.", "The Box of Acme & Sons + Co.", "A1 trucking 2C", "PLLC", "foo pllc", "Foo Professional LLC", "arccouriers", "expressglobalgroup llc", "the of", "", "  ", "x limited liability company", "xlimited", "box", "abox", "my boxbox boxes"]
    got = [r.n for r in frame(spark, names).orderBy("id").select(S.company_name(F.col("name")).alias("n")).collect()]
    assert got == [normal(x) for x in names]


def test_names_of_any_length(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (3, 9, 10, 12, 19, 20, 22, 27, 28, 29, 30, 31, 45, 80, 200)] + ["abc" + "z" * 60, "abc" + "aa" * 20]
    names = []
    for b in base:
        b = "abc" + b
        names.append(b)
        for _ in range(8):
            x = list(b)
            for _ in range(rng.randint(1, max(1, len(b) // 9))):
                at = rng.randrange(3, len(x) + 1)
                x[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "q", "r"])
            names.append("".join(x))
    df = frame(spark, names + ["", "ab", names[0]]).withColumn("nation", F.lit(1))
    low = [n.lower() for n in names] + ["", "ab", names[0]]
    for least in (0.9, 0.8):
        x = df.select(F.col("id").alias("i"), F.lower("name").alias("x")).join(df.select(F.col("id").alias("j"), F.lower("name").alias("y")), F.col("i") < F.col("j")).where(F.substring("x", 1, 3) == F.substring("y", 1, 3))
        want = {(r.i, r.j) for r in x.where(1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"), F.lit(1)) >= least).collect()}
        got = [(r.i, r.j) for r in fuzzy.similar_pairs(df, ["nation"], least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and any(len(low[i]) > 150 for i, _ in want)


def test_chain_and_hot_words(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(24)], "i long, j long")
    led = {r.n: r.leader for r in fuzzy.led_by(spark.range(25).withColumnRenamed("id", "n"), chain).collect()}
    assert led == {i: i - i % 2 for i in range(25)}
    rng = random.Random(10)
    hot = [f"north american {''.join(rng.choices('abcdefghij', k=6))} {''.join(rng.choices('abcdefghij', k=6))}" for _ in range(3000)]
    cores = spark.createDataFrame(list(enumerate(sorted(set(hot)))), "n long, core string")
    assert fuzzy.alike_names(cores, 0.75, False).count() < 50  # not one pair in a thousand meets


def test_each_business_word_is_looked_for_once(spark):
    plan = frame(spark, ["x"]).select(S.company_name(F.col("name")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("courier") <= 8 and "aggregate(" not in plan  # two words hold it; before, 70 copies of the search were nested


def test_begun_pairs_are_filtered_where_they_meet(spark):
    cores = spark.createDataFrame([(i, f"{w} works k{i}") for i, w in enumerate(["alco", "borden", "cinder", "delmar"] * 30)], "n long, core string")
    plan = fuzzy.alike_names(cores, 0.75, False, True)._jdf.queryExecution().optimizedPlan().toString()
    before = plan[: plan.rindex("forall(zip_with(slice(v")]
    assert before.count("Aggregate") >= 1  # under the duplicates' aggregate, not only in the measure after it


def test_written_tables_never_go_through_the_driver(spark):
    table = fuzzy.Tables(spark).write(spark.range(1000).withColumnRenamed("id", "n"))
    plan = spark.range(5000).withColumnRenamed("id", "n").join(table.select("n"), "n")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
