"""Composite cells against plain searches."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import composites


def plain_components(cell):
    rest, out = (cell or "").strip(), []
    for kind, pattern in composites.COMPONENTS.items():
        for x in re.findall(pattern, rest):
            out.append((x, kind))
            rest = rest.replace(x, " ", 1) if kind == "pure_number" else rest.replace(x, " ") if x in rest else rest
    now = []
    for part in (p for p in rest.split() if len(p) > 1):
        now.append(part)
        if len(" ".join(now)) > composites.LONGEST_PHRASE or part.endswith("."):
            out.append((" ".join(now), "text_phrase"))
            now = []
    return out + ([(" ".join(now), "text_phrase")] if now else [])


def plain_fit(value, ref):
    value, ref = value or "", ref or ""
    if not value.strip():
        return 1.0 if not ref.strip() else 0.0
    if not ref.strip():
        return 0.0
    s = lambda p, x: re.search(p, x) is not None
    kind = "code" if s(r"[A-Z]+\d+", ref) else "date" if s(r"\d+[/\-]\d+[/\-]\d+", ref) else "money" if s("[$£€¥]", ref) and s(r"\d", ref) else "share" if "%" in ref and s(r"\d", ref) else ""
    same = {"code": s(r"[A-Z]+\d+", value), "date": s(r"\d+[/\-]\d+[/\-]\d+", value), "money": s("[$£€]", value) or ("(" in value and ")" in value), "share": "%" in value, "": False}[kind]
    same = same or (s(r"^\d+\Z", ref) and s(r"^\d+\Z", value)) or (s(r"^\d+\.\d+\Z", ref) and s(r"^\d+\.\d+\Z", value))
    score = 0.8 * same + 0.3 * (s(r"\d", ref) and s(r"\d", value)) + 0.3 * (s("[A-Za-z]", ref) and s("[A-Za-z]", value))
    return min(1.0, score + max(0, 1 - abs(len(value) - len(ref)) / max(len(value), len(ref))) * 0.2)


def test_like_plain_searches(spark):
    rng = random.Random(12)
    bits = ["L22", "SKU-1", "$5", "(1,200.50)", "25%", "1/2/2024", "2024-01-05", "7", "17", "1", "acme", "Acme.", "of", "x", ",", "£9", "3.5", "A1B2", "long-word-here", "é", "  ", "\t"]
    cells = [None, "", "  ", ",", "x", "word " * 4000] + [rng.choice([" ", " ", ""]).join(rng.choice(bits) for _ in range(rng.randrange(1, 10))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(cells)), "id long, c string")
    got = df.orderBy("id").select(composites.components(F.col("c")).alias("x")).collect()
    assert [[tuple(p) for p in r.x] for r in got] == [plain_components(c) for c in cells]
    pairs = [(rng.choice(cells[:5] + cells[6:60] + bits), rng.choice(bits + [None, "", "ACME INC", "small box"])) for _ in range(600)]
    fits = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, v string, r string").orderBy("id").select(composites.column_fit(F.col("v"), F.col("r")).alias("x")).collect()
    assert [round(r.x, 9) for r in fits] == [round(plain_fit(*p), 9) for p in pairs]
