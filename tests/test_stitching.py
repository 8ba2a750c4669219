"""Stitching against the double loop over tables, with nulls, empty tables and odd headers."""

import itertools
import random
import re

from pyspark.sql import functions as F

from ledgerloom.operators import stitching

SCHEMA = "upload_id long, table_idx long, header array<string>, rows array<array<string>>, place2 string, summary_ string"


def similar(a, b, wide):
    """The measure as plain loops over two (header, rows) tables."""
    (h, r), (g, q) = a, b
    h, g = [x.lower().strip() for x in h], [x.lower().strip() for x in g]

    def letters(x, y):
        return 0.0 if not x or not y else 1.0 if x == y else sum(c in y for c in x) / max(len(x), len(y))

    def jaccard(x, y):
        return len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 0.0

    x, y = " ".join(h), " ".join(g)
    common = set(x.split()) & set(y.split())
    wider = len(h) != len(g)
    side = any(f"{v} {w}" in x or f"{v} {w}" in y for v, w in itertools.permutations(common, 2))
    if not h or not g:
        head = 0.0
    elif (len(common) >= 3 and wider and side) or (letters(x, y) >= 0.7 and abs(len(x.split()) - len(y.split())) >= 2) or (wider and jaccard(x.split(), y.split()) * 0.7 + jaccard(x, y) * 0.3 >= 0.6):
        head = letters(x, y) * 0.7 + jaccard(x.split(), y.split()) * 0.3
    else:
        pairs = list(itertools.zip_longest(h, g, fillvalue=""))
        head = sum(1.0 if v == w else letters(v, w) for v, w in pairs) / len(pairs)
    cols = 1.0 if len(h) == len(g) else 0.0 if not h or not g else 1 - abs(len(h) - len(g)) / max(len(h), len(g))
    fit = lambda rows: sum(abs(len(z) - wide) <= 1 for z in rows) / len(rows)
    form = (fit(r) + fit(q)) / 2 if r and q else 0.0

    def profile(rows):
        out = []
        for k in range(max((len(z) for z in rows), default=0)):
            cells = [(z[k] or "").strip() for z in rows if len(z) > k]
            number = any(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", re.sub("[,$%]", "", c).strip()) for c in cells)
            out.append((number, any("$" in c for c in cells), any(re.search(stitching.DATES, c) for c in cells), any(map(str.isalpha, "".join(cells))), sum(map(len, cells)) / len(cells)))
        return out

    one, two = profile(r[:3]), profile(q[:3])
    hits = sum(sum(v == w for v, w in zip(s[:4], t[:4])) + (abs(s[4] - t[4]) <= 5) >= 4 for s, t in zip(one, two))
    pat = hits / min(len(one), len(two)) if r and q and one and two else 0.0
    alike = (bool(h) == bool(g)) + (bool(r) == bool(q))
    shape = (alike + (abs(len(r) - len(q)) / max(len(r), len(q)) <= 0.5)) / 3 if r and q else alike / 2
    return 0.3 * head + 0.2 * cols + 0.25 * form + 0.15 * pat + 0.1 * shape


def total(h, r):
    low = [x.lower() for x in h]
    named = any(w in x for x in low for w in ("group id", "client", "company", "policy", "member", "subscriber", "agent", "producer", "group name"))
    money = sum(any(w in x for w in ("total", "commission", "amount", "paid", "invoice", "premium")) for x in low) >= 0.8 * len(low)
    return bool(h) and bool(r) and not named and ((len(r) == 1 and money) or (len(r) <= 3 and money and any("total" in x for x in low)))


def plain(tables, least):
    """Stitched tables of one document: (first, is_total, header, rows, parts)."""
    detail = [i for i, (h, r) in enumerate(tables) if not total(h, r)]
    wide = max((len(tables[i][0]) for i in detail), default=0)
    groups = {}
    for i in detail:
        groups.setdefault(tuple(x.lower().strip() for x in tables[i][0]), []).append(i)
    groups, used, out = list(groups.values()), set(), []
    for k, base in enumerate(groups):
        if k in used:
            continue
        parts = list(base)
        for m in range(k + 1, len(groups)):
            if m not in used and similar(tables[base[0]], tables[groups[m][0]], wide) >= least:
                parts += groups[m]
                used.add(m)
        out.append((False, parts))
    out += [(True, [i]) for i in range(len(tables)) if i not in detail]
    found = []
    for is_total, parts in out:
        header = max((tables[i][0] for i in parts), key=len)
        rows = [(z + [""] * len(header))[: len(header)] for i in parts for z in tables[i][1]]
        found.append((parts[0], is_total, header, rows, parts))
    return found


def frame(spark, documents):
    return spark.createDataFrame([(d, i, h, r, "p", "s") for d, tables in documents.items() for i, (h, r) in enumerate(tables)], SCHEMA)


def test_equals_double_loop(spark):
    rng = random.Random(4)
    words = ["Client", "client name", "Paid", "Paid Amount", "Amount", "Rate", "Rate %", "Policy No", "Premium Total", "Total", "", " Commission "]
    cells = ["Acme", "$1,200.50", "12", "5%", "01/02/2024", "", "n/a", "2024-01-02", "-3.5", "a much longer piece of text"]
    documents = {}
    for d in range(40):
        headers = [[rng.choice(words) for _ in range(rng.randrange(0, 5))] for _ in range(4)]
        tables = []
        for _ in range(rng.randrange(1, 9)):
            h = list(rng.choice(headers))
            if h and rng.random() < 0.4:
                h[rng.randrange(len(h))] = rng.choice(words)
            tables.append((h, [[rng.choice(cells) for _ in range(max(0, len(h) + rng.choice([0, 0, 0, -1, 1])))] for _ in range(rng.randrange(0, 5))]))
        documents[d] = tables
    for least in (0.6, 0.8):
        got = {}
        for r in stitching.stitched(frame(spark, documents), least).collect():
            got.setdefault(r.upload_id, []).append((r.first_table, r.is_total, r.header, r.rows, r.parts))
        for d, tables in documents.items():
            assert sorted(got[d], key=str) == sorted(plain(tables, least), key=str), (d, tables)


def test_cases(spark):
    assert stitching.stitched(frame(spark, {1: [(["a"], [["1"]])]}).where("upload_id < 0")).count() == 0
    odd = frame(spark, {1: [([], []), ([None, "Client"], [[None, "x"], []]), (["", "client"], [["y"]])]})
    got = {r.first_table: r for r in stitching.stitched(odd).collect()}
    assert got[1].parts == [1, 2] and len(got[1].rows) == 3
    plan = stitching.stitched(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    same = frame(spark, {7: [(["Client", "Paid"], [["a", "1"]])] * 300})  # one hot header is one group
    assert [len(r.parts) for r in stitching.stitched(same).collect()] == [300]
    assert stitching.with_summary(odd).select(F.col("summary.n_rows")).count() == 3
