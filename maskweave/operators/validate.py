"""Format validators of values, as boolean Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import applied

# Mobile prefixes and landline area codes of the local phone plan.
MOBILE = ("70", "71", "72", "74", "75", "76", "77", "78")
LANDLINE = ("11", "21", "23", "24", "25", "26", "27", "31", "32", "33", "34", "35", "36", "37", "38", "41", "45", "47", "51", "52", "54", "55", "57", "63", "65", "66", "67", "81", "91")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


_CHARS = "size(array_distinct(filter(split({v}, ''), c -> c <> '')))"
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
_DAY = "(try_cast(substring({v}, {at}, 3) as int) BETWEEN 1 AND 366 OR try_cast(substring({v}, {at}, 3) as int) BETWEEN 501 AND 866)"
_BUCKET = "split_part(substring({v}, 6), '/', 1)"


def _chars(v: str = "{v}") -> str:
    return _CHARS.replace("{v}", v)


def _run(step: int) -> str:
    """All digits follow the first by +1 or -1 modulo ten."""
    return f"transform(array({_DIGITS}), d -> forall(sequence(1, length(d)), i -> try_cast(substring(d, i, 1) as int) = pmod(try_cast(substring(d, 1, 1) as int) + {step} * (i - 1), 10)))[0]"


#: Conditions on a value {v}, as SQL.
CONDITIONS = {
    "PAN": f"length({_DIGITS}) >= 13 AND luhn_check({_DIGITS})",
    "NIC_OLD": "{v} RLIKE '^[0-9]{9}[vVxX]$' AND " + _DAY.replace("{at}", "3"),
    "NIC_NEW": "{v} RLIKE '^[0-9]{12}$' AND try_cast(substring({v}, 1, 4) as int) BETWEEN 1900 AND 2010 AND " + _DAY.replace("{at}", "5"),
    "IBAN": "length({v}) BETWEEN 15 AND 34 AND {v} RLIKE '^[A-Z]{2}[0-9]{2}'",
    "TAX_ID": f"{_CHARS} > 1",
    "CVV": "{v} NOT IN ('000', '0000') AND " + f"{_CHARS} > 1",
    "BANK_ACCOUNT_NO": f"{_chars(_DIGITS)} > 1 AND NOT {_run(1)} AND NOT {_run(-1)}",
    "CARD_EXPIRY": "{v} RLIKE '^(?:0[1-9]|1[0-2])/(?:[0-9]{2}|20[0-9]{2})$'",
    "API_KEY_GENERIC": f"{_CHARS} >= greatest(8, length({{v}}) div 4)",
    "SWIFT_BIC": "length({v}) IN (8, 11) AND {v} RLIKE '^.{4}[A-Za-z]{2}(?!00)'",
    "PASSPORT": f"{_chars(_DIGITS)} > 1",
    "DRIVING_LICENSE": f"{_chars(_DIGITS)} > 1",
    "PHONE_LK": "substring(regexp_replace({v}, '^(?:\\\\+94|0)', ''), 1, 2) IN (" + ", ".join(f"'{p}'" for p in (*MOBILE, *LANDLINE)) + ")",
    "PHONE_INTL": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "AWS_ACCESS_KEY": f"{_chars('substring({v}, 5)')} > 4",
    "AWS_SECRET_KEY": _chars(r"element_at(split({v}, '[=:]\\s*'), -1)") + " >= 20",
    "INTERNAL_IP": "{v} RLIKE '^[0-9]+(?:\\\\.[0-9]+){3}$' AND forall(split({v}, '\\\\.'), o -> try_cast(o as int) BETWEEN 0 AND 255)",
    "S3_BUCKET_REF": f"length({_BUCKET}) BETWEEN 3 AND 63 AND {_BUCKET} RLIKE '^[a-z0-9.\\\\-]+\\\\z' AND NOT {_BUCKET} RLIKE '^-|-\\\\z|\\\\.\\\\.'",
}


def condition(kind: str, v: str) -> str:
    return CONDITIONS[kind].replace("{v}", v)


VALIDATORS: dict[str, Callable[[Column], Column]] = {k: (lambda value, k=k: applied(f"v -> ({condition(k, 'v')})", value)) for k in CONDITIONS}
