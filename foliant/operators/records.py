"""Field rows of documents assembled into records with a fixed set of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t

# Detector labels and the fields they fill.
VAT = {c: c for c in ("invoice_code", "invoice_code2", "invoice_number", "invoice_number2", "check_code", "check_code2", "title", "tax", "amount_with_tax", "buy_title", "buy_tax", "buy_addr", "buy_bank", "sale_title", "sale_tax", "sale_addr", "sale_bank", "seal_1", "seal_2")} | {"bill_date": "billing_date", "total": "total_amount"}
#: Fields of the older detectors; what isn't found is "0".
OLDER = {
    "train": {"invoice_number": "invoice_number", "totalAmount": "amount", "ids": "ids", "date": "billing_date", "start": "star_station", "end": "end_station"},
    "taxi": {"invoice_code": "invoice_code", "invoice_number": "invoice_number", "totalAmount": "amount_tax"},
    "roll": {"invoice_code": "invoice_code", "invoice_number": "invoice_number", "totalAmount": "total_amount", "billingDate": "billing_date", "checkcode": "check_code", "QRCode": "qrcode", "title": "title"},
    "evat": {"invoice_code": "invoice_code", "invoice_number": "invoice_number", "totalAmount": "total_amount", "billingDate": "billing_date", "checkcode": "check_code", "title": "title"},
}
VAT_AMOUNTS = ("total_amount", "tax", "amount_with_tax")
STOCK_AMOUNTS = ("total", "total2", "total3")
NO_AMOUNT = "¥ 0.00"


def second_check_codes(rows: DataFrame, doc: str, seq: str) -> DataFrame:
    """All but a document's first check_code become check_code2. The first ones are found by a small aggregate."""
    first = rows.where("label = 'check_code'").groupBy(F.col(doc).alias("__doc")).agg(F.min(seq).alias("__first"))
    later = (F.col("label") == "check_code") & (F.col(seq) > F.col("__first"))
    return rows.join(first, F.col(doc) == F.col("__doc"), "left").withColumn("label", F.when(later, "check_code2").otherwise(F.col("label"))).drop("__doc", "__first")


def assemble(rows: DataFrame, doc: str, seq: str, fields: Mapping[str, str], kind: str, as_of: Column, amounts: Sequence[str] = (), skipped: Sequence[str] = ()) -> DataFrame:
    """A record per document from rows (doc, seq, label, text): the last row of each label, cleaned, under its field's name.

    Labels without a field are dropped; those in `skipped` are only told to be there. Missing fields are
    empty, amounts 0. One aggregation with fixed columns, so the schema doesn't depend on the data.
    """
    known = rows.where(F.col("label").isin(*fields))
    last = known.groupBy(doc).agg(*(F.max_by("text", F.when(F.col("label") == label, F.col(seq))).alias(f"__{label}") for label in fields), *(F.count_if(F.col("label") == label).alias(f"__n_{label}") for label in fields))
    clean = t.cleaners(kind, as_of)

    def value(label: str) -> Column:
        text = F.col(f"__{label}")
        if label in skipped or (label.startswith("seal_") and kind in ("vat", "bill")):
            got = F.lit("detected")
        else:
            got = clean[label](text) if label in clean else t.strip(text)
        return F.when(F.col(f"__n_{label}") > 0, got).otherwise(NO_AMOUNT if fields[label] in amounts else "").alias(fields[label])

    return last.select(doc, *(value(label) for label in fields))


def plain(docs: DataFrame, rows: DataFrame, doc: str, seq: str, fields: Mapping[str, str], missing: str = "0") -> DataFrame:
    """A record for each of docs (its ids): the last text of each label as it was read (the greatest of one place); `missing` where there is none, or a null."""
    last = rows.where(F.col("label").isin(*fields)).groupBy(F.col(doc).alias("__doc")).agg(*(F.max(F.when(F.col("label") == label, F.struct(F.col(seq), "text")))["text"].alias(name) for label, name in fields.items()))
    return docs.select(doc).join(last, F.col(doc) == F.col("__doc"), "left").select(doc, *(F.coalesce(name, F.lit(missing)).alias(name) for name in fields.values()))


def settle_tax(records: DataFrame) -> DataFrame:
    """A tax of 0 becomes total_amount less amount_with_tax; it is negative wherever either amount is."""
    number = lambda c: F.coalesce(F.array_join(F.regexp_extract_all(c, F.lit(r"-?[0-9][0-9]*\.*"), F.lit(0)), "").try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    tax = F.when(F.col("tax") == NO_AMOUNT, F.concat(F.lit("¥ "), (number("total_amount") - number("amount_with_tax")).cast("double").cast("string"))).otherwise(F.col("tax"))
    minus = F.col("total_amount").contains("-") | F.col("amount_with_tax").contains("-")
    return records.withColumn("tax", tax).withColumn("tax", F.when(~F.col("tax").contains("-") & minus, F.replace("tax", F.lit("¥ "), F.lit("¥ -"))).otherwise(F.col("tax")))


def settle_doubles(records: DataFrame) -> DataFrame:
    """Of fields read twice the better reading: codes of 12 characters or the longer, numbers of 8 or the longer; the second ones go."""
    code, code2, number, number2 = (F.col(c) for c in ("invoice_code", "invoice_code2", "invoice_number", "invoice_number2"))
    n, n2 = F.length(number), F.length(number2)
    better_code = F.when(((F.length(code) != 12) & (F.length(code2) == 12)) | (F.length(code) < F.length(code2)), code2).otherwise(code)
    better = F.when(n == 8, number).when((n2 == 8) | (n2 > n), number2).otherwise(number)
    both = t.check_code(F.col("check_code"), F.col("check_code2"))
    return records.withColumns({"invoice_code": better_code, "invoice_number": better, "check_code": both}).drop("invoice_code2", "invoice_number2", "check_code2")


def document_kind(stock1: Column, stock2: Column, bill: Column, bill_type: Column, vat_type: Column, any_stock: Column) -> Column:
    """02 for goods receipts, 01 for bills and invoices, 03 for others, by titles and type codes; the earlier rule holds."""
    has = lambda s, *words: F.coalesce(s, F.lit("")).rlike("|".join(words))
    filled = lambda s: F.coalesce(s, F.lit("")) != ""
    return F.when(has(stock1, "总务", "结算") | has(stock2, "药"), "02").when(has(bill, "据") & filled(bill_type), "01").when(filled(vat_type), "01").when(any_stock, "02").otherwise("03")


def distinct_joined(df: DataFrame, key: str, value: str, of: Column | None = None, mark: str = "、") -> DataFrame:
    """key and its different values in order, joined by a mark; only those that meet `of`, if given."""
    kept = F.col(value) if of is None else F.when(of, F.col(value))
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(kept)), mark).alias(value))


def entities(df: DataFrame, key: str, label: str, text: str, order: Sequence[str]) -> DataFrame:
    """key and its entities (label, text) as one array, by label and then in the given order."""
    rows = F.sort_array(F.collect_list(F.struct(label, *order, text)))
    return df.groupBy(key).agg(F.transform(rows, lambda x: F.struct(x[label].alias(label), x[text].alias(text))).alias("entities"))


def entity_pairs(df: DataFrame, key: str, label: str, value: str, first: str = "QUESTION", second: str = "ANSWER") -> DataFrame:
    """key, first, second: every question of a document with each of its answers."""
    a = df.where(F.col(label) == first).select(key, F.col(value).alias("first"))
    return a.join(df.where(F.col(label) == second).select(key, F.col(value).alias("second")), key)


def zipped(df: DataFrame, labels: str, texts: str) -> DataFrame:
    """A row for each place at which both of two arrays have an element: the other columns, seq, label, text."""
    rest = [c for c in df.columns if c not in (labels, texts)]
    n = F.least(F.size(labels), F.size(texts))
    both = F.arrays_zip(F.slice(labels, F.lit(1), n).alias("label"), F.slice(texts, F.lit(1), n).alias("text"))
    return df.select(*rest, F.posexplode(both).alias("seq", "__p")).select(*rest, "seq", "__p.label", "__p.text")


def with_ids(df: DataFrame, known: DataFrame, path: str, name: str) -> DataFrame:
    """df with the id (column `name` of `known`) of its path; paths that aren't known are left out."""
    return df.join(known.select(path, name), path)


def shared_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a whose keys and shapes b has too."""
    return a.join(b, list(keys), "left_semi")


def split_of(key: Column, shares: Sequence[tuple[str, int]]) -> Column:
    """The split of a row by shares in percent; it depends on nothing but the key's text, so it is the same everywhere."""
    at = F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100))
    out, upto = F.lit(shares[-1][0]), 100
    for (name, _), (_, after) in reversed(list(zip(shares, shares[1:], strict=False))):
        upto -= after
        out = F.when(at < upto, name).otherwise(out)
    return out
