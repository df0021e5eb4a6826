"""Keys: fingerprints, identities, codes inside account numbers and attribute texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART, _NONE = "\x1f", "\x00"


def fingerprint(*columns: Column) -> Column:
    """32 hex digits of the SHA-256 over all values in order; null differs from empty. Format numbers before."""
    return F.substring(F.sha2(F.concat_ws(_PART, *[F.coalesce(c.cast("string"), F.lit(_NONE)) for c in columns]), 256), 1, 32)


def operation_identity(signed_no: Column, *others: Column) -> Column:
    """The signed document's number, or 16 hex digits over the other columns where there is none."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in others])
    return F.coalesce(F.concat(F.lit("pk17:"), F.nullif(F.trim(signed_no), F.lit(""))), F.concat(F.lit("fp:"), F.substring(F.sha1(joined), 1, 16)))


def harvest_key(contract: Column, record_no: Column, signed_no: Column, print_: Column) -> Column:
    """By contract and record, else by signed document, else by fingerprint."""
    return F.coalesce(
        F.concat(F.lit("rec:"), contract, F.lit(":"), record_no), F.concat(F.lit("pk17:"), signed_no), F.concat(F.lit("fp:"), print_)
    )


def payment_key(tx_id: Column, print_: Column) -> Column:
    return F.coalesce(F.concat(F.lit("tx:"), tx_id), F.concat(F.lit("fp:"), print_))


def shipment_key(deal: Column, document: Column, day: Column) -> Column:
    return F.concat(F.lit("shp:"), F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (deal, document, day)]))


def client_code(account: Column, length: int = 9) -> Column:
    """The last digits of an account number that has more of them."""
    digits = F.regexp_replace(account, r"\D", "")
    return F.when(F.length(digits) > length, F.right(digits, F.lit(length)))


def tax_id(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"\s", ""), F.lit(""))


def first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


# How attributes and payment details write numbers of deals, contracts and invoices, words of a reversal, and an account with its currency.
DEAL_ATTRIBUTE, DEAL_IN_DETAILS = r"D:\s*(\d+)", r"(?iu)сд\.?\s*№\s*(\d+)"
CONTRACT_ATTRIBUTE, INVOICE_IN_DETAILS = r"C:\s*(\d+)", r"(?iu)с/ф\.?\s*№\s*([^\s,]+)"
REVERSAL = "(?iu)возврат|qaytar|қайтар"
ACCOUNT_DIGITS, ACCOUNT_CURRENCY = r"(\d+)\s*\(", r"\(([A-Za-z]{3})\)"


def deal_number(attributes: Column, details: Column) -> Column:
    return F.coalesce(first_match(attributes, DEAL_ATTRIBUTE), first_match(details, DEAL_IN_DETAILS))


def clearing_contract(attributes: Column) -> Column:
    return first_match(attributes, CONTRACT_ATTRIBUTE)


def invoice_number(number: Column, details: Column) -> Column:
    return F.coalesce(number, first_match(details, INVOICE_IN_DETAILS))


def is_reversal(details: Column) -> Column:
    return F.coalesce(details, F.lit("")).rlike(REVERSAL)


def bank_account(text: Column) -> tuple[Column, Column]:
    """The digits and the currency of `<digits> (CUR)`."""
    return first_match(text, ACCOUNT_DIGITS), first_match(text, ACCOUNT_CURRENCY)
