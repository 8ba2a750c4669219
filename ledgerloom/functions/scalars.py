"""Cell-level functions: amounts, dates, names, headers, types. All are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
HEADER_SYNONYMS = {"group": "company", "client": "company", "organization": "company", "plan": "policy", "earned": "commission", "paid": "payment", "no": "number", "adj": "adjustment"}
GRAND_TOTAL_IDENTIFIERS = ["group id", "client", "company", "policy", "member", "subscriber", "agent", "producer", "group name"]
GRAND_TOTAL_AMOUNTS = ["total", "commission", "amount", "paid", "invoice", "premium"]
SUMMARY_KEYWORDS = ["total", "subtotal", "grand total", "net total", "overall total", "sum"]
SUMMARY_PHRASES = {r"\btotal\s+for\s+vendor\b": 0.4, r"\btotal\s+for\s+group\b": 0.4, r"\btotal\s+for\s+(carrier|company|broker)\b": 0.4, r"\btotal\s+for\b": 0.35, r"\bcommission\s+total\b": 0.35, r"\bnet\s+(payment|commission)\b": 0.32, r"\bgrand\s+total\b": 0.35, r"\bstatement\s+total\b": 0.35, r"\btotal\s+commission\s+payment\b": 0.35}
SUMMARY_ROWS = [r"\btotal\s+for\b", r"\bgrand\s+total\b", r"\bnet\s+(?:payment|commission)\b", r"\bsummary\b", r"\bcommission\s+total\b", r"\bwriting\s+agent\b", r"\bplan\s+summary\b"]
NAME_SUFFIXES = ["llc", "l l c", "ll", "limited liability company", "limited liability co", "inc", "incorporated", "corporation", "corp", "cor", "ltd", "limited", "co", "company", "pllc", "p l l c", "professional llc", "llp", "l l p", "limited liability partnership", "lp", "l p", "limited partnership"]
CARRIER_NAMES = {
    "allied": "Allied Benefit Systems", "allied benefit": "Allied Benefit Systems", "allied benefit systems": "Allied Benefit Systems", "absf": "Allied Benefit Systems",
    "united healthcare": "UnitedHealthcare", "unitedhealthcare": "UnitedHealthcare", "uhc": "UnitedHealthcare", "united health group": "UnitedHealthcare", "unitedhealth": "UnitedHealthcare",
    "blue cross blue shield": "Blue Cross Blue Shield", "bcbs": "Blue Cross Blue Shield", "blue cross": "Blue Cross Blue Shield",
    "aetna": "Aetna", "aetna inc": "Aetna", "cigna": "Cigna", "cigna health": "Cigna", "humana": "Humana", "humana inc": "Humana",
}
CARRIER_SUFFIXES = [" llc", " inc", " inc.", " corporation", " corp"]
CANONICAL_SUFFIXES = {"llc": "LLC", "ll": "LLC", "limited liability company": "LLC", "limited liability co": "LLC", "inc": "Inc.", "incorporated": "Inc.", "corporation": "Corp.", "corp": "Corp.", "cor": "Corp.", "ltd": "Ltd.", "limited": "Ltd.", "co": "Co.", "company": "Co.", "pllc": "PLLC", "professional llc": "PLLC", "llp": "LLP", "limited liability partnership": "LLP", "lp": "LP", "limited partnership": "LP"}
BUSINESS_WORDS = ["logistics", "transport", "shipping", "delivery", "freight", "cargo", "express", "global", "international", "services", "solutions", "group", "companies", "corporation", "enterprises", "industries", "systems", "trucking", "hauling", "moving", "storage", "warehouse", "distribution", "couriers", "courier", "box"]
SMALL_WORDS = ["the", "of", "and", "&", "at", "in", "on", "for", "to", "a", "an"]
COLUMN_TERMS = ["consultant", "due", "this", "period", "commission", "earned", "paid", "amount"]
COLUMNS_WITHOUT_SUBSTITUTE = ["consultant due this period", "consultant due", "consultant paid"]
NEVER_SUBSTITUTES = ["consultant due", "consultant paid", "consultant", "due", "consultant due this period"]
COMMISSION_COLUMNS = {"commission earned": 8, "commission amount": 7, "commission paid": 6, "total commission": 6, "net commission": 5, "net payment": 4, "payment amount": 4, "paid amount": 3, "paid amt": 3, "total payment": 3, "commission": 1}
NOT_COMMISSION_COLUMNS = ["commissionable", "rate", "percentage", "percent", "comm rate", "comm. rate"]
NUMBER = r"^[+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$"


def bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it; inside lambdas Spark repeats what is written twice."""
    return F.get(F.transform(F.array(value), then), 0)


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number(c: Column) -> Column:
    """A plain number as double, null for anything else; no locale, suffix or separator is accepted."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def amount_ledger(c: Column) -> Column:
    """Ledger path: parentheses negate, currency signs and separators go, anything else is zero."""
    t = F.regexp_replace(strip(c), r"[$,\s]", "")
    paren = t.rlike(r"^\(.*\)$")
    inner = F.regexp_replace(t, r"[()]", "")
    value = number(inner)
    return F.coalesce(F.when(paren, -F.abs(value)).otherwise(value), F.lit(0.0))


def amount_legacy(c: Column) -> Column:
    """Legacy path: every character but digits and points goes; a minus or parentheses negate."""
    t = strip(c)
    value = number(F.regexp_replace(t, r"[^0-9.]", ""))
    negative = t.rlike(r"^\(") | t.rlike(r"^[$]?-") | t.rlike(r"^-")
    return F.coalesce(F.when(negative, -value).otherwise(value), F.lit(0.0))


def amount_strict(c: Column) -> Column:
    """Null instead of zero for what is no amount; also other currencies."""
    t = F.regexp_replace(strip(c), r"[$€£¥,\s]", "")
    paren = t.rlike(r"^\(.+\)$")
    value = number(F.regexp_replace(t, r"^\(|\)$", ""))
    return F.when(paren, -F.abs(value)).otherwise(value)


def amount_tolerant(c: Column) -> Column:
    """Like the strict parser, without a plus sign or ``usd``; dashes and n/a are null."""
    t = F.lower(F.regexp_replace(strip(c), r"[$,+\s]", ""))

    def signed(t: Column) -> Column:
        value = bound(F.regexp_replace(t, r"^\(|\)$", ""), number)
        return F.when(t.isin("", "-", "--", "—", "n/a", "na", "none"), None).when(t.rlike(r"^\(.+\)$"), -F.abs(value)).otherwise(value)

    return bound(F.regexp_replace(t, "usd", ""), signed)


def amount_client(c: Column) -> Column:
    """Client path: digits, points and minus signs are kept, so parentheses lose their meaning."""
    return F.coalesce(number(F.regexp_replace(c, r"[^0-9.\-]", "")), F.lit(0.0))


def amount_approval(c: Column) -> Column:
    """Approval path: parentheses negate; what fails is null and adds nothing."""
    t = F.regexp_replace(strip(c), r"[$,]", "")
    return number(F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(t, r"[()]", ""))).otherwise(t))


def amount_dollar(c: Column) -> Column:
    """Parentheses negate whatever sign is inside; null where nothing fits."""
    t = strip(F.regexp_replace(c, r"[$,]", ""))
    paren = t.rlike(r"^\(.*\)$")
    value = number(F.when(paren, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t))
    return F.when(paren, -value).otherwise(value)


def amount_textual(c: Column) -> Column:
    """An opening parenthesis becomes a minus sign by text, so two signs make no number."""
    return number(strip(F.regexp_replace(F.regexp_replace(c, r"[$,)]", ""), r"\(", "-")))


def value_pattern(c: Column) -> Column:
    """The pattern that a column's first value suggests, null for free text."""
    money, percent, phone, ssn = r"^\$?\d{1,3}(,\d{3})*(\.\d{2})?$", r"^\d+(\.\d+)?%$", r"^\d{3}-\d{3}-\d{4}$", r"^\d{3}-\d{2}-\d{4}$"
    out = F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}"), r"\d{1,2}/\d{1,2}/\d{2,4}")
    for p in (money, percent, phone, ssn):
        out = out.when(c.rlike(p), p)
    return out


def is_date(c: Column) -> Column:
    """True if some layout, month or day first, makes the text a date that exists."""
    layouts = ("MM/dd/yyyy", "dd/MM/yyyy", "MM/dd/yy", "dd/MM/yy", "yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(x)) for x in layouts]).isNotNull()


def month_of_record(json: Column, clock: Column) -> Column:
    """yyyy-MM of a JSON date record: its year and month, else its date, else its value, else the clock's."""
    at = lambda k: F.get_json_object(json, f"$.{k}")
    whole = F.format_string("%s-%02d", at("year"), at("month").cast("int"))
    iso = F.coalesce(at("date"), at("value")).try_cast("timestamp_ntz")
    return F.when(at("year").isNotNull() & at("month").isNotNull(), whole).when(iso.isNotNull(), F.date_format(iso, "yyyy-MM")).otherwise(F.date_format(clock, "yyyy-MM"))


def progress_summary(step: Column, count: Column) -> Column:
    n = count.cast("string")
    return (
        F.when(step == "upload", "File uploaded, ready for processing")
        .when(step == "table_editor", F.concat(F.lit("Tables extracted, ready for editing ("), n, F.lit(" tables)")))
        .when(step == "field_mapper", F.concat(F.lit("Tables edited, ready for field mapping ("), n, F.lit(" fields mapped)")))
        .when(step == "dashboard", "Field mapping completed, ready for review")
        .when(step == "completed", "Processing completed")
        .otherwise(F.concat(F.lit("At step: "), step))
    )


# Fixed values of the domain: amounts in brackets are negative; what follows a match is dropped.
BRACKETS = [r"^\(\s*\\?\$\s*([0-9,]+\.?\d*)\s*\)", r"^\(\s*\\?\$?\s*-?\s*([0-9,]+\.?\d*)\s*\$?\s*\)", r"^\\?\(\s*\\?\$\s*([0-9,]+\.?\d*)\s*\\?\)"]
PLAIN_AMOUNT = r"^\\?\$\s*([0-9,]+\.?\d*)"


def bracket_rewrite(c: Column) -> Column:
    """Accounting brackets as a signed amount: (1,234.5) becomes -$1234.5, also with currency signs, a minus or escapes inside;
    amounts with a currency sign lose their separators; other text stays, without outer blanks."""
    t = strip(c)
    found = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    bare = lambda m: F.when(F.replace(m, F.lit(","), F.lit("")).rlike(r"^(\d+\.?\d*|\.\d+)$"), F.replace(m, F.lit(","), F.lit(""))).otherwise(m)
    inside = F.coalesce(*[found(p) for p in BRACKETS])
    plain = found(PLAIN_AMOUNT)
    return F.when(t == "", c).when(inside.isNotNull(), F.concat(F.lit("-$"), bare(inside))).when(plain.isNotNull(), F.concat(F.lit("$"), bare(plain))).otherwise(t)


def growth(current: Column, previous: Column) -> Column:
    return F.when(previous == 0, F.when(current > 0, 100.0).otherwise(0.0)).otherwise((current - previous) / previous * 100)


def within_bps(a: Column, b: Column, bps: float = 75.0, least: float = 0.01) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(b) * (bps / 10000), F.lit(least))


def reconcile(calculated: Column, extracted: Column) -> Column:
    """Approval status: nothing calculated needs review; a difference under five per cent is approved."""
    share = F.abs(calculated - extracted) / F.abs(extracted) * 100
    return F.when(calculated < 0.01, "needs_review").when(extracted.isNull() | (extracted == 0), "Approved").when(share < 5, "Approved").otherwise("needs_review")


def auto_reconcile(calculated: Column, extracted: Column) -> Column:
    """Automatic approval: within the larger of five and five per cent."""
    match = F.abs(calculated - extracted) <= F.greatest(F.lit(5.0), F.abs(extracted) * 0.05)
    return F.when(extracted.isNull() & (calculated > 0), "accepted_unverified").when(extracted.isNull(), "no_totals").when(match, "match").otherwise("mismatch")


def statement_date(c: Column) -> Column:
    """The first of several layouts that fits, month before day; else the glued month name; else null."""
    t = strip(c)
    tries = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd", "MM/dd/yy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "MMMMd,yyyy")]
    return F.coalesce(*tries)


def range_start(c: Column) -> Column:
    """The first date of a range written with through, thru, to, until or a dash between spaces."""
    return strip(F.element_at(F.split(c, r"(?i)\s+(?:through|thru|to|until|-|–|—)\s+", 2), 1))


def header(c: Column) -> Column:
    """White space and line breaks in a header collapsed."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def header_canonical(c: Column) -> Column:
    """Lower-case header with synonyms replaced one after another, then without punctuation."""
    out = strip(F.lower(c))
    for word, to in HEADER_SYNONYMS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", to)
    return strip(F.regexp_replace(F.regexp_replace(out, r"[^\w\s]", ""), r"\s+", " "))


def match_name(c: Column) -> Column:
    """The name companies are matched by: lower case, some punctuation as blanks, the longest legal suffix off, spaced or glued."""
    t = strip(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[,._-]", " "), r"\s+", " "))
    longest = "|".join(sorted(NAME_SUFFIXES, key=lambda x: (-len(x), x)))
    return strip(F.regexp_replace(t, rf"(?<=\S)\s?(?:{longest})$", ""))


def repair_state_codes(c: Column) -> Column:
    """State codes whose zeros were read as the letter O: two capitals and five digits again. Four rules in turn; each takes its
    correction from the first code it meets and writes it in place of all of them."""
    part = lambda x, pattern, k: F.regexp_extract(x, pattern, k)
    filled_up = lambda state, digits: F.concat(state, F.repeat(F.lit("0"), F.greatest(5 - F.length(digits), F.lit(0))), digits)
    letters, trailing, mixed, single = r"([A-Z]{2})O+(\d+)", r"([A-Z]{2}\d+)O+", r"([A-Z]{2})[0O]+(\d+)", r"([A-Z]{2}\d)O(\d+)"

    def first(x: Column) -> Column:
        fixed = F.when(x.rlike(letters), F.regexp_replace(x, F.lit(letters), filled_up(part(x, letters, 1), part(x, letters, 2)))).otherwise(x)
        return F.struct(fixed.alias("x"), part(x, letters, 0).alias("seen"))

    def second(s: Column) -> Column:
        code = part(s["x"], trailing, 1)
        fixed = F.regexp_replace(s["x"], F.lit(trailing), F.concat(code, F.repeat(F.lit("0"), F.greatest(7 - F.length(code), F.lit(0)))))
        return F.struct(F.when((code != "") & (F.length(code) < 7), fixed).otherwise(s["x"]).alias("x"), s["seen"].alias("seen"))

    def third(s: Column) -> Column:
        x = s["x"]
        return F.when((part(x, mixed, 0) != "") & (part(x, mixed, 0) != s["seen"]), F.regexp_replace(x, F.lit(mixed), filled_up(part(x, mixed, 1), part(x, mixed, 2)))).otherwise(x)

    last = lambda x: F.when(x.rlike(single), F.regexp_replace(x, F.lit(single), F.concat(part(x, single, 1), F.lit("0"), part(x, single, 2)))).otherwise(x)
    return bound(bound(bound(bound(c, first), second), third), last)


def company_name(c: Column) -> Column:
    """A company name in normal form: punctuation as blanks, "&" and "+" as words, glued business words apart, one legal suffix
    in its canonical form at the end, small words left out, words capitalised, codes like A1 in capitals; blank names as they are."""
    t = F.regexp_replace(F.regexp_replace(strip(c), r"\s+", " "), r"[,._-]", " ")
    t = F.regexp_replace(t, r"[&+]", " and ")

    def apart(name: Column) -> Column:
        out = name
        for word in BUSINESS_WORDS:  # blanks that one word brings glue no other
            out = F.regexp_replace(out, rf"(?is)^(?=.*[a-zA-Z0-9]{word})(.*?)([a-zA-Z0-9]+)({word})([a-zA-Z]*)", f"$1$2 {word} $4")
        return F.when(name.rlike(rf"(?i)[a-z0-9](?:{'|'.join(BUSINESS_WORDS)})"), out).otherwise(name)

    longest = "|".join(sorted(CANONICAL_SUFFIXES, key=lambda x: (-len(x), x)))
    forms = F.create_map(*[F.lit(x) for pair in CANONICAL_SUFFIXES.items() for x in pair])

    def unglued(main: Column) -> Column:
        return F.struct(main.alias("main"), F.regexp_extract(main, rf"(?<=[^ ])({longest})$", 1).alias("glued"))

    def without_glued(s: Column) -> Column:
        main, glued = s["main"], s["glued"]
        rest = F.when(glued != "", F.substring(main, F.lit(1), F.length(main) - F.length(glued))).otherwise(F.trim(F.regexp_replace(main, " +", " ")))
        return F.struct(rest.alias("rest"), glued.alias("glued"))

    def unspaced(s: Column) -> Column:
        spaced = F.when(s["glued"] == "", F.regexp_extract(s["rest"], rf"(?:^| )({longest})$", 1)).otherwise("")
        return F.struct(s["rest"].alias("rest"), s["glued"].alias("glued"), spaced.alias("spaced"))

    def joined(s: Column) -> Column:
        rest, glued, spaced = s["rest"], s["glued"], s["spaced"]
        rest = F.when(spaced != "", F.substring(rest, F.lit(1), F.length(rest) - F.length(spaced))).otherwise(rest)
        parts = F.filter(F.split(rest, " "), lambda p: (p != "") & ~p.isin(SMALL_WORDS))
        shown = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+[a-zA-Z]+$|^[a-zA-Z][0-9]+$"), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))))
        suffix = F.coalesce(F.element_at(forms, F.when(glued != "", glued).otherwise(spaced)), F.lit(""))
        return F.trim(F.concat_ws(" ", F.array_join(shown, " "), suffix))

    out = bound(bound(bound(bound(F.trim(F.lower(bound(t, apart))), unglued), without_glued), unspaced), joined)
    return bound(out, lambda x: F.when(x == "", c).otherwise(x))


def carrier_name(c: Column) -> Column:
    """A carrier's canonical name: looked up in lower case without the legal suffixes that do not tell carriers apart; unknown names as they are, without outer blanks."""
    low = strip(F.lower(c))
    for suffix in CARRIER_SUFFIXES:
        low = F.replace(low, F.lit(suffix), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in CARRIER_NAMES.items() for x in pair])
    return F.when(c == "", c).otherwise(F.coalesce(F.element_at(known, strip(low)), strip(c)))


def company_similarity(a: Column, b: Column) -> Column:
    """Similarity of two company names: one if their normal forms are equal, else that of their match names."""
    return F.when(F.lower(company_name(a)) == F.lower(company_name(b)), 1.0).otherwise(name_similarity(match_name(a), match_name(b)))


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two match names: one if equal, with or without blanks; steps for cut-off names; else a mix.

    The mix is 0.4 edit similarity, 0.5 word overlap, and a tenth of 0.3 or 0.2 if one name is a short form.
    """
    first = F.length(a) > F.length(b)
    longer, shorter = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    less = F.length(longer) - F.length(shorter)
    wl, ws = F.split(longer, " "), F.split(shorter, " ")
    fewer = F.size(F.split(a, " ")) > F.size(F.split(b, " "))
    wa, wb = F.when(fewer, F.split(a, " ")).otherwise(F.split(b, " ")), F.when(fewer, F.split(b, " ")).otherwise(F.split(a, " "))
    begins = F.forall(F.zip_with(F.slice(wa, F.lit(1), F.size(wb)), wb, lambda x, y: x.startswith(y)), lambda x: x)
    some = (F.length(shorter) > 0)
    cut = some & longer.startswith(shorter)
    longest = F.greatest(F.length(a), F.length(b))
    words = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    plain = lambda x: F.regexp_replace(x, r" (llc|inc|corp|ltd|co|lp|llp|pllc)$", "")
    boost = F.when(longer.startswith(shorter) & (less <= 4), 0.3).when(plain(longer).contains(plain(shorter)), 0.2).otherwise(0.0)
    return (
        F.when(a == b, 1.0)
        .when(cut & (less <= 3), 0.98)
        .when(cut & (less <= 10) & (F.length(shorter) >= 10), 0.95)
        .when(cut & (less <= 20) & (F.length(shorter) >= 15) & (F.size(ws) == F.size(wl) - 1), 0.90)
        .when(some & (F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit(""))), 1.0)
        .when(some & begins & (F.size(wb) >= 2), 0.92)
        .otherwise((1 - F.levenshtein(a, b) / longest) * 0.4 + words * 0.5 + boost * 0.1)
    )


def clean_client(c: Column) -> Column:
    """A client name without a state code and its number; the first family of codes that occurs is the one removed."""

    def without(t: Column) -> Column:
        out = t
        for n in (1, 2, 3, 4, 5):
            found = rf"\s+[A-Z]{{2}}\d{{{n}}}\s*"
            out = F.when(t.rlike(found), strip(F.regexp_replace(t, found, " "))).otherwise(out)
        return out

    return bound(strip(c), without)


def similar_column(target: str, header: Column) -> Column:
    """The header that stands for ``target``: equal, equal but for case, else at least two shared terms, first best."""
    same = F.filter(header, lambda h: F.lower(h) == target.lower())
    exact = F.when(F.array_contains(header, target), F.lit(target)).otherwise(F.get(same, F.lit(0)))
    if target.lower().strip() in COLUMNS_WITHOUT_SUBSTITUTE:
        return exact
    joined = target.lower().replace(" ", "").replace("_", "")
    terms = [t for t in COLUMN_TERMS if t in joined]

    def score(h: Column) -> Column:
        n = F.regexp_replace(F.lower(h), r"[ _]", "")
        hits = sum((n.contains(t).cast("int") for t in terms), F.lit(0))
        key = n.contains("commission") | n.contains("due") | n.contains("earned") | n.contains("paid")
        return F.when(key & ~F.lower(strip(h)).isin(NEVER_SUBSTITUTES), hits).otherwise(0)

    scores = F.transform(header, score)
    best = F.array_max(scores)
    return F.coalesce(exact, F.when(best >= 2, F.element_at(header, F.array_position(scores, best).cast("int"))))


def commission_column(header: Column) -> Column:
    """Position of the commission column: the heaviest term, leftmost of equals; null if no header has one."""

    def weight(h: Column) -> Column:
        t = F.lower(h)
        out = F.lit(0)
        for term, w in sorted(COMMISSION_COLUMNS.items(), key=lambda x: x[1]):
            out = F.when(t.contains(term), w).otherwise(out)
        barred = F.lit(False)
        for term in NOT_COMMISSION_COLUMNS:
            barred = barred | t.contains(term)
        return F.when(barred, 0).otherwise(out)

    weights = F.transform(header, weight)
    return F.when(F.array_max(weights) > 0, F.array_position(weights, F.array_max(weights)) - 1)


def filled(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def is_numeric_cell(c: Column) -> Column:
    t = F.regexp_replace(strip(c), r"[,$]", "")
    return bound(F.regexp_replace(t, r"^\((.*)\)$", "$1"), lambda x: number(x).isNotNull())


def row_is_summary(cells: Column) -> Column:
    """Rows that read like totals: a phrase, few cells with a keyword, or amounts without identifiers."""
    text = F.array_join(F.filter(F.transform(cells, lambda x: F.lower(strip(x))), lambda x: x != ""), " ")
    facts = F.struct(text.alias("text"), F.size(F.filter(cells, filled)).alias("n"), F.size(F.filter(cells, is_numeric_cell)).alias("numeric"))

    def reads(x: Column) -> Column:
        text, n, numeric = x["text"], x["n"], x["numeric"]
        phrase = F.lit(False)
        for pattern in SUMMARY_ROWS:
            phrase = phrase | text.rlike(pattern)
        phrase = phrase | (F.size(F.split(text, "total", -1)) > 2)
        words = text.contains("total") | text.contains("vendor") | text.contains("summary") | text.contains("plan")
        blank = ~F.exists(F.slice(cells, 1, 2), filled)
        return (n > 0) & (phrase | ((n <= 3) & text.contains("total")) | ((n <= 4) & (numeric <= 2) & words) | ((n <= 5) & blank & (numeric >= 1)))

    return bound(facts, reads)


def value_type(c: Column) -> Column:
    """Date before currency before percentage before number before text; blank is empty."""
    t = strip(c)
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$") | t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(t.rlike(r"^[(-]?\$\s?[0-9][0-9,]*(\.[0-9]+)?\)?$"), "currency")
        .when(t.rlike(r"^-?[0-9]+(\.[0-9]+)?\s?%$"), "percentage")
        .when(t.rlike(r"^-?[0-9][0-9,]*(\.[0-9]+)?$"), "number")
        .otherwise("text")
    )


def pad_row(cells: Column, width: int | Column) -> Column:
    """A row cut or filled with blanks to the header's width, nulls blank."""
    full = F.concat(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), F.lit(width)))
    return F.slice(full, F.lit(1), F.lit(width))
