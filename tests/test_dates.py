"""Dates in texts against a plain search with Python's own patterns, and odd texts."""

import datetime
import random
import re

from ledgerloom.operators import text_dates as T


def plain_valid(v):
    def day(y, m, d):
        try:
            datetime.date(int(y), int(m), int(d))
            return True
        except ValueError:
            return False

    sep = v.split("/" if "/" in v else "-")
    full = {m.lower(): i + 1 for i, m in enumerate(T.MONTHS)}
    for pattern, order in ((rf"\b{T.M}[/-]{T.D}[/-]{T.Y}\b", (2, 0, 1)), (rf"\b{T.M}[/-]{T.D}[/-]\d{{2}}\b", "pivot"), (rf"\b{T.Y}-{T.M}-{T.D}\b", (0, 1, 2)), (rf"\b({T.NAMES}|{T.SHORT})\s+\d{{1,2}},?\s+{T.Y}\b", "words"), (rf"\b{T.D}[/-]{T.M}[/-]{T.Y}\b", (2, 1, 0)), (rf"({T.NAMES}|{T.SHORT}\.?)\d{{1,2}},?\d{{4}}", "glued")):
        if not re.match(pattern, v, re.I):
            continue
        if order == "words":
            name, d, y = v.replace(",", "").split()
            return day(y, next(i for n, i in full.items() if n.startswith(name.lower()[:3])), d)
        if order == "glued":
            m = re.fullmatch(r"([a-z]+)\.?(\d{1,2}),?(\d{4})", v, re.I)
            return day(m[3], next(i for n, i in full.items() if n.startswith(m[1].lower()[:3])), m[2])
        if len(sep) != 3:
            return False
        if order == "pivot":
            return day(int(sep[2]) + (2000 if int(sep[2]) < 50 else 1900), sep[0], sep[1])
        return day(*(sep[k] for k in order))
    return False


def plain(text):
    lines, found = (text or "").split("\n"), {}
    for i, raw in enumerate(lines):
        line, context = raw.strip(), " ".join(lines[max(0, i - 2) : i + 3])
        low, around = line.lower(), context.lower()
        for pattern in T.DATE_PATTERNS:
            for m in re.finditer(pattern, line, re.I):
                v = m.group()
                if not plain_valid(v):
                    continue
                if not any(w in around for w in T.PERMISSIVE) and ((any(w in around for w in T.IDENTIFIERS) and re.search(r"\d{4,}", v)) or re.search(r"\$.*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", context)):
                    continue
                here = next((x for x, _ in T.LABELS if x in low), None)
                there = next((x for x, _ in T.LABELS if x in around), None)
                if here:
                    label, sure = here, max(0.8, 1 - abs(low.find(v.lower()) - low.find(here)) / 100)
                elif there:
                    label, sure = there, 0.6
                else:
                    label, sure = ("commission date", 0.5) if "commission" in around else ("date", 0.3)
                kind = T.type_of(label)
                score = (round(sure, 9), -T.TYPE_RANK.get(kind, 99))
                if v.lower() not in found or score > found[v.lower()][0]:
                    found[v.lower()] = (score, (v, label, round(sure, 9), kind, i))
    return sorted(x for _, x in found.values())


def test_like_a_plain_search(spark):
    rng = random.Random(5)
    dates = ["01/15/2024", "1-5-24", "2/30/2024", "13/12/2023", "31/12/1999", "2024-02-29", "2023-02-29", "March 5, 2024", "Mar 5 2024", "Mar. 5, 2024", "MAY 7 2021", "February 30, 2024", "5 March 2024", "January52024", "Feb12,2023", "jan.312023", "Feb302023", "x01/02/20249", "1/2/51", "12 / 31 / 2024", "StatementDate1/2/2024", "PaymentDate1-2-2024", "1/2-2024", "05/06/2007", "0/1/2024", "99/99/9999"]
    words = ["statement", "Statement Date:", "policy", "number", "amount $12", "commission", "Period Ending", "due date", "billing", "effective", "x", "", "lorem ipsum", "report", "\t", "id"]
    texts = [None, "", "\n\n", "01/02/2024", " 3/4/24 \n\n\nstatement", "$5 01/02/2024", "policy 01/02/2024", "x" * 100_000 + " 01/02/2024\n" + "y\n" * 20_000 + "Payment 5/6/2020"]
    for _ in range(250):
        texts.append("\n".join(" ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(dates) for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(1, 9))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    got = {}
    for r in T.found_dates(df, "doc_id", "body").collect():
        got.setdefault(r.doc_id, []).append((r.date_value, r.label, round(r.confidence, 9), r.date_type, r.line))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == plain(text), text[:300]
    assert sum(map(len, got.values())) > 400
    assert T.found_dates(df.where("doc_id < 0"), "doc_id", "body").count() == 0
