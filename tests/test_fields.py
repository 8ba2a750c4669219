"""Field mapping and flattening against plain loops."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import fields as X
from ledgerloom.functions import scalars as S
from ledgerloom.operators import tables
from tests.test_formats import repaired

NAMES = ["Group Name", "group  name", "Company", "Customer", "Paid Amount", "Amount Paid", "Commission Due", "commission earned", "Earned Commission", "Invoice Total", "Invoice Amount", "Premium Amount", "Premium", "Rate", "", "Consultant Due", "Total Amount", "Client Name"]
TARGETS = ["Client Name", "company name", "Commission Earned", "Commission Paid", "commission amount", "Invoice Total", "Total Amount", "Invoice sub total", "Notes", "", None]
UPLOADS = f"upload_id long, carrier_id long, company_id long, config {X.CONFIG}, tables array<struct<header:array<string>,rows:array<array<string>>,summaryRows:array<int>>>, m string, h string, a string, t string"


def mapping(config):
    found = [(c[0] or c[2] or c[3] or "", (c[1] or c[3] or c[4] or "").lower()) for c in config or []]
    tests = [
        (lambda s, t: t in X.CLIENT_TARGETS or ("client" in t and "name" in t) or ("company" in t and "name" in t), X.CLIENT_SOURCES),
        (lambda s, t: t in X.COMMISSION_TARGETS or ("commission" in t and ("earned" in t or "amount" in t)), X.COMMISSION_SOURCES),
        (lambda s, t: t in X.INVOICE_TARGETS or ("invoice" in s and ("amount" in s or "total" in s)) or ("invoice" in t and "total" in t), X.INVOICE_SOURCES),
    ]
    out = []
    for test, words in tests:
        hit = next((s for s, t in found if s and test(s.lower(), t)), None)
        out.append(hit or next((s for s, _ in found if any(w in s.lower() for w in words)), None))
    return tuple(out)


def resolve(target, header):
    if target in header:
        return len(header) - 1 - header[::-1].index(target)
    same = [i for i, h in enumerate(header) if h.lower() == target.lower()]
    if same:
        return same[0]
    if target.lower().strip() in S.COLUMNS_WITHOUT_SUBSTITUTE:
        return None
    bare = lambda x: re.sub("[ _]", "", x.lower())
    scores = [sum(t in bare(h) and t in bare(target) for t in S.COLUMN_TERMS) if any(w in bare(h) for w in ("commission", "due", "earned", "paid")) and h.lower().strip() not in S.NEVER_SUBSTITUTES else 0 for h in header]
    return scores.index(max(scores)) if scores and max(scores) >= 2 else None


def client(cell):
    x = repaired(cell.strip())
    for n in range(5, 0, -1):
        if re.search(rf"\s+[A-Z]{{2}}\d{{{n}}}", x):
            return re.sub(rf"\s+[A-Z]{{2}}\d{{{n}}}\s*", " ", x).strip()
    return x


def amount(cell):
    t = re.sub(r"[$,\s]", "", cell)
    sign = -1 if t.startswith("(") and t.endswith(")") else 1
    try:
        return sign * float(t.strip("()"))
    except ValueError:
        return 0.0


def flat(uploads):
    out = []
    for upload, carrier, company, config, tabs, *_ in uploads:
        head = lambda h: [re.sub(r"\s+", " ", x).strip() for x in h]
        if not config:
            if not tabs or not tabs[0][1]:
                continue
            row = tabs[0][1][0]
            config = [(h, None, None, None, h) for i, h in enumerate(head(tabs[0][0])) if h and i < len(row) and row[i]]
        a, b, c = mapping(config)
        if not a or not b:
            continue
        for header, rows, marked in tabs:
            h = head(header)
            i, j = resolve(a, h), resolve(b, h)
            if i is None or j is None:
                continue
            k = len(h) - 1 - h[::-1].index(c) if c in h else None
            for n, row in enumerate(rows):
                cell = lambda x: row[x] if x is not None and x < len(row) else ""  # noqa: B023, E731
                name, com, inv = client(cell(i)), amount(cell(j)), amount(cell(k))
                if n not in (marked or []) and name and (com or inv):
                    out.append((carrier if carrier is not None else company, upload, name, com, inv))
    return sorted(out, key=str)


def test_mapping_and_flattening(spark):
    rng = random.Random(11)
    cells = ["Acme MNOO867", "Borden LA00748 Inc", "x", "", "$1,200.50", "(12.5)", "7", "0", "$0.00", "3.25", "TX9"]
    uploads = []
    for u in range(300):
        pool = rng.sample(NAMES, 6)
        likely = [(rng.choice(pool), goal, None, None, None) for goal in ("Client Name", "Commission Earned", "Invoice Total")] if rng.random() < 0.7 else []
        config = likely + [tuple(rng.choice([None, "", rng.choice(NAMES)]) if k in (0, 2) else rng.choice(TARGETS) if rng.random() < 0.7 else None for k in range(5)) for _ in range(rng.randrange(0, 5))]
        tabs = []
        for _ in range(rng.randrange(0, 3)):
            header = [rng.choice([x, x.upper(), f" {x}"]) if rng.random() < 0.2 else x for x in rng.choices(pool, k=rng.randrange(2, 8))]
            rows = [[rng.choice(cells) for _ in range(max(0, len(header) - rng.choice([0, 0, 1])))] for _ in range(rng.randrange(0, 5))]
            tabs.append((header, rows, rng.choice([None, [], [0], [1, 7]])))
        uploads.append((u, rng.choice([None, 5]), rng.choice([None, 6]), config if rng.random() < 0.8 else None, tabs, "m", "h", "a", "t"))
    df = spark.createDataFrame(uploads, UPLOADS)
    got = df.orderBy("upload_id").select(X.field_mapping(F.col("config")).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [mapping(u[3]) for u in uploads]
    rows = sorted((tuple(r) for r in tables.flatten_mapped(df).collect()), key=str)
    want = flat(uploads)
    assert [r[:3] for r in rows] == [r[:3] for r in want] and len(want) > 40
    assert [(round(float(r[3]), 6), round(float(r[4]), 6)) for r in rows] == [(round(r[3], 6), round(r[4], 6)) for r in want]
    assert tables.flatten_mapped(df.where("upload_id < 0")).count() == 0
