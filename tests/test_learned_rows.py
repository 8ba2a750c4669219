"""Learned summary rows against plain loops over tables and patterns."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.operators import learned_rows as learned

SCHEMA = "company_id long, upload_id long, table_idx int, header array<string>, rows array<array<string>>, summaries array<int>, learned2 string, name string, cues string"


def sig(header, rows):
    return (len(header), len(rows), f"{sum(map(len, rows)) / max(len(rows), 1):.2f}", "|".join(header))


def cell(row, k):
    return row[k] if k < len(row) else ""


def plain_learn(tables):
    out = {}
    for company, upload, idx, header, rows, marks, *_ in sorted(tables, key=lambda t: (t[1], t[2])):
        header, rows = [h or "" for h in header], [[c or "" for c in r] for r in rows]
        marked = sorted({i for i in marks or [] if i is not None and 0 <= i < len(rows)})
        if company is None or not marked:
            continue
        columns = {}
        for k, name in enumerate(header):
            inside, outside = [cell(rows[i], k) for i in marked], [cell(r, k) for i, r in enumerate(rows) if i not in marked]
            words = lambda cells: {w for c in cells for w in re.findall(r"\b[A-Za-z]+\b", c)}
            numbers = sum(bool(re.match(r"^\d+(\.\d+)?$", c.replace(",", ""))) for c in inside)
            kind = "numeric" if numbers > len(inside) * 0.5 else "string"
            kind = "currency" if sum(bool(re.match(r"^\$?\d+(,\d{3})*(\.\d{2})?$", c)) for c in inside) > len(inside) * 0.3 else kind
            kind = "date" if sum(bool(re.match(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", c)) for c in inside) > len(inside) * 0.3 else kind
            columns[name] = (sorted(words(inside) - words(outside))[:10], kind, [any(f in c.lower() for c in inside) for f in learned.FLAGS])
        text = [" ".join(rows[i]).lower() for i in marked]
        flags = [len(marked) < len(rows) and any(f in t for t in text) for f in learned.FLAGS]
        old = out.get((company, sig(header, rows)))
        usage = old["usage"] + 1 if old else 1
        out[company, sig(header, rows)] = {"columns": columns, "flags": flags, "samples": [rows[i] for i in marked], "usage": usage, "confidence": min(100, 80 + 5 * (usage - 1))}
    return out


def plain_apply(table, patterns):
    company, _, _, header, rows, *_ = table
    header, rows = [h or "" for h in header], [[c or "" for c in r] for r in rows]
    found = set()
    for (owner, signature), p in patterns.items():
        if owner != company:
            continue
        if signature == sig(header, rows):
            found |= {rows.index(s) for s in p["samples"] if s in rows}
            continue
        for i, row in enumerate(rows):
            for k, name in enumerate(header):
                if name in p["columns"] and k < len(row):
                    keywords, _, flags = p["columns"][name]
                    cues = [w.lower() for w in keywords] + [f for f, on in zip(learned.FLAGS, flags) if on]
                    if any(w in row[k].lower() for w in cues):
                        found.add(i)
            if any(on and f in " ".join(row).lower() for f, on in zip(learned.FLAGS, p["flags"])):
                found.add(i)
    return sorted(found)


def test_like_loops(spark):
    rng = random.Random(9)
    words = ["Total", "Acme", "Subtotal for", "summary", "12", "$1,200.50", "01/02/2024", "", None, "Net Due", "carried", "3.5", "ACME"]
    names = ["Client", "Amount", "Qty", "Client", None, ""]
    tables = []
    for u in range(80):
        for i in range(rng.randrange(1, 3)):
            header = [rng.choice(names) for _ in range(rng.randrange(0, 4))]
            rows = [[rng.choice(words) for _ in range(rng.randrange(0, len(header) + 2))] for _ in range(rng.randrange(0, 5))]
            tables.append((rng.choice([1, 2, None]), u, i, header, rows, rng.choice([None, [], [0], [1, 3], [2, None, 99, -1, 2]]), "x", "y", "z"))
    df = spark.createDataFrame(tables, SCHEMA)
    teach, rest = [t for t in tables if t[1] % 2 == 0], [t for t in tables if t[1] % 2]
    want = plain_learn(teach)
    patterns = learned.learn(df.where("upload_id % 2 = 0"))
    got = patterns.collect()
    facts = lambda c: (c.name, (list(c.keywords), c.data_type, [c.total, c.summary, c.subtotal]))
    key = lambda p: str((sorted((n, str(v)) for n, v in p[0].items()), p[1], p[2], p[3], p[4]))
    assert sorted(key((dict(map(facts, r.columns)), [list(s) for s in r.samples], r.usage, r.confidence, [r.row.total, r.row.summary, r.row.subtotal])) for r in got) == sorted(key((p["columns"], p["samples"], p["usage"], p["confidence"], p["flags"])) for p in want.values())
    found = {(r.upload_id, r.table_idx): r.learned for r in learned.apply(df.where("upload_id % 2 = 1"), patterns).collect()}
    assert found == {(t[1], t[2]): plain_apply(t, want) for t in rest} and sum(map(len, found.values())) > 10
    none = learned.apply(df, patterns.where("company_id < 0"))
    assert none.count() == len(tables) and none.where(F.size("learned") > 0).count() == 0
    assert learned.learn(df.where("upload_id < 0")).count() == 0


def test_fixed_rows(spark):
    rows = [["Total for Group: ABC", "", "$5"], ["Group Total"], ["FALCON 29 x $1,270.91"], ["a 29 b $12.5"], ["Acme", "total for group x"], ["Acme", "5"], [], ["account"], ["Grand  total"], ["x Summary"], [None, None], ["Net"]]
    got = [r.x for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<string>").orderBy("i").select(learned.looks_like_summary(F.col("r")).alias("x")).collect()]

    def plain(row):
        text = " ".join(c or "" for c in row).strip()
        return bool(row) and (any(re.search(p, text, re.I) for p in learned.ROW_PATTERNS) or any(w in (row[0] or "").lower() for w in learned.FIRST_CELL_WORDS) or "total for group" in text.lower())

    assert got == [plain(r) for r in rows] and 4 < sum(got) < 12
