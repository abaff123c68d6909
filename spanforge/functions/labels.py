"""Closed vocabularies and label expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, their canonical form, harm weights, categories.
CANONICAL = {
    "ADDRESS": "LOCATION", "PRIVATE_ADDRESS": "LOCATION", "PRIVATE_PERSON": "PERSON", "PRIVATE_EMAIL": "EMAIL", "PRIVATE_PHONE": "PHONE",
    "PRIVATE_URL": "URL", "PRIVATE_DATE": "DATE", "ACCOUNT_NUMBER": "ID", "SECRET": "ID",
}
PUBLISHABLE = ("PERSON", "LOCATION", "ORG", "PHONE", "EMAIL", "URL", "ID", "DATE", "MEDICATION", "AGE", "PROFESSION", "ADDRESS", "OTHER")
HARM = {"MEDICATION": 3, "PERSON": 3, "EMAIL": 1, "PHONE": 1, "URL": 1, "HANDLE": 1, "ID": 1, "SNILS": 1, "INN": 1, "PASSPORT": 1}
DEFAULT_HARM = 2
CATEGORY = {"PERSON": "A", "LOCATION": "B", "DATE": "C", "PHONE": "D", "FAX": "E", "EMAIL": "F", "URL": "N", "IP": "O", "ID": "G-M"}
NOT_APPLICABLE = ("AGE",)
SPECIAL = ("MEDICATION", "PROFESSION", "DIAGNOSIS")
QUASI = ("IP", "LOCATION", "DATE", "AGE", "PROFESSION", "ORG")

# Labels of models and datasets and what they stand for; null where a label is dropped, for philter OTHER where it is unknown.
MODEL_LABELS: dict[str, dict[str, str | None]] = {
    "natasha": {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORG"},
    "presidio": {
        "PERSON": "PERSON", "LOCATION": "LOCATION", "GPE": "LOCATION", "NRP": "LOCATION", "PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "URL": "URL", "DATE_TIME": "DATE",
        "US_SSN": "ID", "US_ITIN": "ID", "US_PASSPORT": "ID", "US_DRIVER_LICENSE": "ID", "US_BANK_NUMBER": "ID", "IBAN_CODE": "ID", "CREDIT_CARD": "ID", "CRYPTO": "ID", "IP_ADDRESS": "ID", "MEDICAL_LICENSE": "ID",
        "ORGANIZATION": "ORG", "ORG": "ORG", "AGE": "AGE",
    },
    "philter": {"DATE": "DATE", "Email": "EMAIL", "Name": "PERSON", "Age": "AGE", "Patient_Social_Security_Number": "ID", "Provider_Address_or_Location": "LOCATION", "OTHER": "OTHER"},
    "ai4": {
        "GIVENNAME1": "private_person", "GIVENNAME2": "private_person", "LASTNAME1": "private_person", "LASTNAME2": "private_person", "LASTNAME3": "private_person", "TITLE": None, "EMAIL": "private_email",
        "TEL": "private_phone", "DATE": "private_date", "BOD": "private_date", "TIME": None, "STREET": "private_address", "BUILDING": "private_address", "SECADDRESS": "private_address", "CITY": "private_address",
        "STATE": "private_address", "COUNTRY": "private_address", "POSTCODE": "private_address", "GEOCOORD": "private_address", "USERNAME": None, "IP": None, "DRIVERLICENSE": "account_number",
        "IDCARD": "account_number", "PASSPORT": "account_number", "SOCIALNUMBER": "account_number", "PASS": "secret", "SEX": None,
    },
}
# Population, share of it that has each attribute, and attributes that are part of another.
POPULATION = 146_000_000
PRIORS = {
    "a-kaluga": 330_000 / POPULATION, "b-kostroma": 270_000 / POPULATION, "b-ekaterinburg": 1_500_000 / POPULATION, "b-moscow": 13_000_000 / POPULATION, "b-zavolzhsky": 90_000 / POPULATION,
    "c-spb": 5_600_000 / POPULATION, "d-nsk": 1_600_000 / POPULATION, "e-ekb": 1_500_000 / POPULATION, "f-kazan": 1_300_000 / POPULATION,
    "a-profession": 0.006, "a-careerlevel": 1.0, "b-profession": 0.020, "b-role": 1.0, "c-profession": 0.004, "d-profession": 0.010, "e-profession": 0.012, "f-profession": 0.020,
    "a-age": 1 / 70, "b-age": 1 / 70, "c-age": 1 / 70, "d-age": 1 / 70, "e-age": 1 / 70, "f-age": 1 / 70,
    "a-sertraline": 0.004, "b-fluoxetine": 0.004, "c-escitalopram": 0.004, "d-bupropion": 0.003, "e-mirtazapine": 0.003, "f-atomoxetine": 0.002,
}
FOLDED = ("a-careerlevel", "b-role")


def _table(x: Column, table: dict, default: Column) -> Column:
    return reduce(lambda out, kv: F.when(x == kv[0], F.lit(kv[1])).otherwise(out), reversed(table.items()), default)


def canon(label: Column) -> Column:
    """Canonical type; labels out of the table pass in upper case."""
    up = F.upper(label)
    return _table(up, CANONICAL, up)


def of_model(model: Column, label: Column) -> Column:
    """The canonical type of a model's label; null where the label is dropped or the model does not name it."""
    rows = [(m, k, v) for m, t in MODEL_LABELS.items() for k, v in t.items() if v is not None]
    table = F.create_map(*[x for m, k, v in rows for x in (F.lit(f"{m}/{k}"), F.lit(v))])
    found = F.element_at(table, F.concat(model, F.lit("/"), label))
    return canon(F.coalesce(found, F.when(model == "philter", "OTHER")))


def safe(label: Column) -> Column:
    """A publishable label, else OTHER."""
    up = F.upper(label)
    return F.when(up.isin(*PUBLISHABLE), up).otherwise("OTHER")


def harm(label: Column) -> Column:
    """Weight of a type: high 3, medium 2 (also unknown types), low 1."""
    return _table(label, HARM, F.lit(DEFAULT_HARM)).cast("long")


def category(label: Column) -> Column:
    """Regulatory category: a letter, ``n/a``, ``special`` or ``unmapped``."""
    rest = F.when(label.isin(*NOT_APPLICABLE), "n/a").when(label.isin(*SPECIAL), "special").otherwise("unmapped")
    return _table(label, CATEGORY, rest)


def identifier_class(label: Column) -> Column:
    return F.when(label.isin(*QUASI), "quasi").otherwise("direct")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where undefined."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def f_beta(p: Column, r: Column, beta2: int) -> Column:
    """F measure with beta squared, 0 where undefined."""
    return F.when(beta2 * p + r == 0, F.lit(0.0)).otherwise((1 + beta2) * p * r / (beta2 * p + r))


def risk_class(top1: Column, top3: Column, survival: Column) -> Column:
    return F.when((top1 >= 2) | (survival >= 0.5), "HIGH").when((top3 >= 1) | (survival >= 0.25), "MEDIUM").otherwise("LOW")


def tier(direct: Column, special: Column, inference: Column, auc: Column) -> Column:
    """RED on direct residual, AMBER on special residual, inference above 0 or AUC above one half, else GREEN."""
    return F.when(direct > 0, "RED").when((special > 0) | (inference > 0) | (auc > 0.5), "AMBER").otherwise("GREEN")


def local_endpoint(url: Column) -> Column:
    host = F.lower(F.coalesce(F.call_function("parse_url", url, F.lit("HOST")), F.lit("")))
    return host.isin("", "localhost", "127.0.0.1", "::1", "[::1]")
