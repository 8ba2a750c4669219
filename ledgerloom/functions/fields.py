"""Which columns of a statement feed the ledger: by the field configuration, else by the names of its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

# Fixed values of the domain.
CLIENT_TARGETS = ["client name", "company name", "clientname", "companyname"]
COMMISSION_TARGETS = ["commission earned", "commissionearned", "commission_earned", "commission paid", "paid amount"]
INVOICE_TARGETS = ["invoice total", "invoicetotal", "invoice_total", "premium amount", "premiumamount", "statement total amount", "total amount"]
CLIENT_SOURCES = ["group name", "group", "employer", "organization", "customer"]
COMMISSION_SOURCES = ["paid amount", "commission", "earned", "paid", "amount"]
INVOICE_SOURCES = ["invoice amount", "invoice total", "premium amount", "total invoice"]
INFERRED = {"client_name": ["company", "client", "group", "name"], "commission_earned": ["commission", "earned", "paid"], "invoice_total": ["invoice", "premium", "total", "amount"]}

CONFIG = "array<struct<field:string,mapping:string,source_field:string,display_name:string,label:string>>"


def _has(c: Column, *words: str) -> Column:
    """Whether a text has all of the words."""
    out = F.lit(True)
    for w in words:
        out = out & c.contains(w)
    return out


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def field_mapping(config: Column) -> Column:
    """(client, commission, invoice): the table columns that a configuration maps to the three ledger fields, null where none does.

    A configuration names its source column under field, source_field or display_name and its target under
    mapping, display_name or label, the first that is not empty. Each field takes the first entry whose target (for invoices also
    source) fits, else the first whose source has one of the field's words.
    """
    first = lambda x, *names: F.coalesce(*[F.when(x[n] != "", x[n]) for n in names], F.lit(""))
    sides = lambda x: F.struct(first(x, "field", "source_field", "display_name").alias("source"), F.lower(first(x, "mapping", "display_name", "label")).alias("target"))
    entries = F.transform(F.coalesce(config, F.array().cast(CONFIG)), sides)
    entries = F.transform(entries, lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), F.lower(x["source"]).alias("low")))
    client = lambda x: x["target"].isin(CLIENT_TARGETS) | _has(x["target"], "client", "name") | _has(x["target"], "company", "name")
    commission = lambda x: x["target"].isin(COMMISSION_TARGETS) | (x["target"].contains("commission") & _any(x["target"], ["earned", "amount"]))
    low = lambda x: x["low"]
    invoice = lambda x: x["target"].isin(INVOICE_TARGETS) | (low(x).contains("invoice") & _any(low(x), ["amount", "total"])) | _has(x["target"], "invoice", "total")

    def pick(entries: Column, test, words: list[str]) -> Column:
        fits = F.filter(entries, lambda x: test(x) & (x["source"] != ""))
        other = F.filter(entries, lambda x: _any(low(x), words))
        return F.coalesce(F.get(fits, 0)["source"], F.get(other, 0)["source"])

    return S.bound(entries, lambda e: F.struct(pick(e, client, CLIENT_SOURCES).alias("client"), pick(e, commission, COMMISSION_SOURCES).alias("commission"), pick(e, invoice, INVOICE_SOURCES).alias("invoice")))


def inferred_config(header: Column, row: Column) -> Column:
    """A configuration from the names of the columns that hold something in a table's first row: each stands for itself, with the kind its name shows."""
    named = F.filter(F.transform(header, lambda h, i: F.struct(h.alias("name"), F.get(row, i).alias("value"))), lambda x: (F.coalesce(x["name"], F.lit("")) != "") & (F.coalesce(x["value"], F.lit("")) != ""))
    none = F.lit(None).cast("string")
    return F.transform(named, lambda x: F.struct(x["name"].alias("field"), none.alias("mapping"), none.alias("source_field"), none.alias("display_name"), x["name"].alias("label")))


def inferred_kind(name: Column) -> Column:
    """The ledger field a column's name speaks of."""
    low = F.lower(name)
    out = F.when(_any(low, INFERRED["client_name"]), "client_name")
    for kind in ("commission_earned", "invoice_total"):
        out = out.when(_any(low, INFERRED[kind]), kind)
    return out.otherwise("unknown")


def resolved(target: Column, header: Column) -> Column:
    """Position (from 0) of the column that stands for a name: equal (the last such), equal but for case, else the first best of at
    least two shared terms; null if none does or the name allows no substitute."""
    last = F.size(header) - F.array_position(F.reverse(header), target).cast("int")
    same = lambda low: F.array_position(F.transform(header, F.lower), low).cast("int") - 1

    def score(h: Column, joined: Column) -> Column:
        def shared(n: Column) -> Column:
            hits = sum(((n.contains(t) & joined.contains(t)).cast("int") for t in S.COLUMN_TERMS), F.lit(0))
            return F.when(_any(n, ["commission", "due", "earned", "paid"]) & ~F.lower(S.strip(h)).isin(S.NEVER_SUBSTITUTES), hits).otherwise(0)

        return S.bound(F.regexp_replace(F.lower(h), "[ _]", ""), shared)

    def close(low: Column) -> Column:
        scores = S.bound(F.regexp_replace(low, "[ _]", ""), lambda joined: F.transform(header, lambda h: score(h, joined)))
        best = S.bound(scores, lambda x: F.when(F.array_max(x) >= 2, F.array_position(x, F.array_max(x)).cast("int") - 1))
        return F.when(~S.strip(low).isin(S.COLUMNS_WITHOUT_SUBSTITUTE), best)

    other = S.bound(F.lower(target), lambda low: S.bound(same(low), lambda k: F.when(k >= 0, k).otherwise(close(low))))
    return F.when(F.array_contains(header, target), last).otherwise(other)


def client_of(cell: Column) -> Column:
    """A client's name from its cell: state codes repaired, then taken off."""
    return S.clean_client(S.repair_state_codes(S.strip(cell)))
