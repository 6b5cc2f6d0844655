"""The rule table: what is looked for, how it is scored and how it is masked.

A rule set is a value: ``RuleSet().with_rule(...)`` gives a new one. Everything here is compiled
to Column expressions on the driver; nothing of it runs on the executors as Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

# Sensitivity ranks, in rising order.
SENSITIVITY = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Rule:
    """One pattern; ``group`` 1 takes the captured value as span.

    What any match needs, so that other texts are not tried: ``shape``, a pattern that the text's
    numbers and runs of capitals hold; ``words``, of which one occurs whatever its case (between bars: no
    letter precedes or follows); ``guard``, a pattern on the text, tried after the others. All may be empty.
    """

    type: str
    pattern: str
    sensitivity: str
    category: str
    guard: str = ""
    shape: str = ""
    words: tuple[str, ...] = ()
    group: int = 0
    container: bool = False
    needs_keyword: bool = False
    suppressible: bool = False
    match_quality: str = "exact"


# Patterns that must equal the given ones, in Java's syntax: (?U) for Unicode classes,
# (?d) so that only a newline ends a line.
_U = "(?Ud)"
RULES = (
    Rule("NIC_OLD", _U + r"\b\d{9}[vVxX]\b", "HIGH", "1A", shape=r"\p{Nd}{9}", suppressible=True),
    Rule("NIC_NEW", _U + r"\b\d{12}\b", "HIGH", "1A", shape=r"\p{Nd}{12}", suppressible=True, match_quality="partial"),
    Rule("PASSPORT", _U + r"\b[A-Z]{1,2}\d{6,7}\b", "HIGH", "1A", shape=r"\p{Nd}{6}", match_quality="partial"),
    Rule("DRIVING_LICENSE", _U + r"\b[A-Z]\d{7}\b", "HIGH", "1A", shape=r"\p{Nd}{7}", match_quality="partial"),
    Rule("TAX_ID", _U + r"\b\d{9}\b", "HIGH", "1A", shape=r"\p{Nd}{9}", needs_keyword=True, suppressible=True, match_quality="partial"),
    Rule("PHONE_LK", _U + r"(?:\+94|\b0)[0-9]{9}\b", "MEDIUM", "1B", shape="[0-9]{9}", suppressible=True),
    Rule("PHONE_INTL", _U + r"\+(?!94)[1-9]\d{6,14}\b", "MEDIUM", "1B", shape=r"\p{Nd}{7}", words=("+",), suppressible=True),
    Rule("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "MEDIUM", "1B", words=("@",)),
    Rule("PAN", _U + r"\b\d(?:[ \-]?\d){12,18}\b", "CRITICAL", "2A", shape=r"\p{Nd}(?:[ \-]?\p{Nd}){12}", container=True, match_quality="partial"),
    Rule("CVV", _U + r"\b\d{3,4}\b", "CRITICAL", "2A", shape=r"\p{Nd}{3}", needs_keyword=True, match_quality="partial"),
    Rule("CARD_EXPIRY", _U + r"(?<!\d/)\b(0[1-9]|1[0-2])\/\d{2,4}\b", "HIGH", "2A", shape=r"[01][0-9]", words=("/",)),
    Rule("BANK_ACCOUNT_NO", _U + r"\b\d{10,16}\b", "HIGH", "2B", shape=r"\p{Nd}{10}", needs_keyword=True, match_quality="partial"),
    Rule("IBAN", _U + r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7,20}\b", "HIGH", "2B", shape=r"\p{Nd}{7}"),
    Rule("SWIFT_BIC", _U + r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?\b", "CRITICAL", "2B", shape="[A-Z]{6}", match_quality="partial"),
    Rule("SWIFT_MT103", _U + r"\bMT\s?103\b", "CRITICAL", "2C", shape="103", words=("mt",)),
    Rule("SWIFT_MT202", _U + r"\bMT\s?202\b", "CRITICAL", "2C", shape="202", words=("mt",)),
    Rule("API_KEY_OPENAI", _U + r"\bsk-[A-Za-z0-9]{20,}\b", "HIGH", "3A", words=("sk-",)),
    Rule("API_KEY_GENERIC", _U + r"\b[A-Za-z0-9_\-]{32,}\b", "HIGH", "3A", needs_keyword=True, match_quality="partial"),
    Rule("JWT_TOKEN", _U + r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b", "HIGH", "3A", words=("eyj",), container=True),
    Rule("PASSWORD", r"(?iUd)\b[\w]*(?:password|passwd|pwd|pass|secret)[\w]*\s*[=:]\s*['\"]?([^\s'\";,.)]+)", "HIGH", "3B", words=("pass", "pwd", "secret"), guard=r"(?iUd)(?:pass|pwd|secret)[\w]*\s*[=:]", group=1),
    Rule("PRIVATE_KEY", r"-----BEGIN (RSA |EC )?PRIVATE KEY-----", "CRITICAL", "3C", words=("private key",)),
    Rule("DB_CONNECTION_STRING", r"(?iUd)(?:(?:postgresql|mysql|mongodb|redis|mssql)://[^\s]+|(?:Server|Data Source)\s*=\s*[^;]+;(?:[^;]+;)*?(?:Password|Pwd)\s*=\s*[^;]+;?)", "HIGH", "4B", words=("postgresql://", "mysql://", "mongodb://", "redis://", "mssql://", "server", "data source"), guard=r"(?iUd)://|(?:server|data source)\s*="),
    Rule("INTERNAL_IP", _U + r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b", "MEDIUM", "4C", shape="10|172|192", words=("10.", "172.", "192.")),
    Rule("AWS_ACCESS_KEY", _U + r"\bAKIA[A-Z0-9]{16}\b", "HIGH", "7A", words=("akia",)),
    Rule("AWS_SECRET_KEY", r"(?iUd)aws.{0,25}secret.{0,20}[=:]\s*[A-Za-z0-9+/]{40}\b", "HIGH", "7A", words=("aws",)),
    Rule("S3_BUCKET_REF", r"s3://[a-zA-Z0-9.\-_/]+", "MEDIUM", "7B", words=("s3://",)),
    Rule("JWT_IN_LOG", r"(?iUd)Authorization:\s*Bearer\s+eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "HIGH", "7C", words=("authorization:",), container=True),
)

# Surnames of the name rule.
SURNAMES = (
    "Nadarajah", "Nagahawatta", "Nagahawatte", "Nagel", "Nagendra", "Nalliah", "Napier", "Nanayakkara", "Jayakody", "Jayaratne", "Jayasekera",
    "Ilangakoon", "Illesinghe", "Isbooldeniya", "Hamilton", "Gooneratne", "Goonesekera", "Goonetilleke", "Goonewardena", "Goonewardene",
    "Edirisinghe", "Ekanayake", "Fernand", "Fernandez", "Fernando", "Alvis", "Alwines", "Alwis", "Amarasuriya", "Amarasekera",
    "Amaratunga", "Ambrose", "Ameresekera", "Ameresekere", "Anandappa", "Anderson", "Andrews", "Dias", "Bandranayaka", "Baptist", "Barber",
    "Dharmaratne", "Dissanayake", "Dassenaike", "Jayasinghe", "Obeyesekera", "Obeysekere", "Paranagama", "Paranavitarne", "Ramanathan", "Ramalingam",
    "Ranasinghe", "Ranatunga", "Ranawake", "Ranaweerasinghe", "Salgado", "Salvador", "Samarakkody", "Samarakoon", "Samaranayake", "Samarasekera",
    "Samarasinghe", "Perera", "Silva", "Jayawardena", "Wickramasinghe", "Gunawardena", "Rajapaksa", "Bandara", "Senanayake", "Rajapaksha",
    "Wickremasinghe", "Mendis", "Karunaratne", "Weerasinghe",
)

# Patterns of names, dates of birth and addresses. All ignore case.
NAMED = (
    Rule("FULL_NAME", r"(?iUd)\b(Mr|Mrs|Ms|Dr|Rev)\.?\s+[A-Z][a-z]+ [A-Z][a-z]+", "LOW", "1C", words=("|mr|", "|mrs|", "|ms|", "|dr|", "|rev|"), match_quality="partial"),
    Rule("FULL_NAME", r"(?iUd)\b[A-Z][a-z]+ (?:" + "|".join(sorted(SURNAMES, key=len, reverse=True)) + r")\b", "LOW", "1C", words=tuple(f"|{s.lower()}|" for s in SURNAMES), match_quality="partial"),
    Rule("DATE_OF_BIRTH", r"(?iUd)\b(?:dob|date of birth|born(?:\s+on)?|birth date)\s*[:\-]?\s*(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4})\b", "MEDIUM", "1C", shape=r"\p{Nd}{4}", words=("dob", "birth", "born"), match_quality="partial"),
    Rule("DATE_OF_BIRTH", r"(?iUd)\b\d{4}-\d{2}-\d{2}\b", "MEDIUM", "1C", shape=r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}", words=("dob", "birth", "born"), match_quality="partial"),
    Rule("HOME_ADDRESS", r"(?iUd)\b\d+,?\s+[A-Za-z]+(?:\s[A-Za-z]+){0,3}\s(?:Road|Street|Lane|Avenue|Rd|St|Ave|Mawatha)\b(?:,\s*[A-Za-z]+(?:\s[A-Za-z]+){0,3})?", "MEDIUM", "1B", shape=r"\p{Nd}", words=tuple(f"|{w}|" for w in ("road", "street", "lane", "avenue", "rd", "st", "ave", "mawatha")), match_quality="partial"),
)
# Words of birth near a bare date, and the length from which a branded key is one.
DOB_WORDS = ("dob", "date of birth", "born", "birth date", "birthday")

# Words near a type's values that make it likelier.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "NIC_OLD": ("nic", "id", "identity", "national", "customer id"),
    "NIC_NEW": ("nic", "id", "identity", "national", "customer id", "customer reference"),
    "PASSPORT": ("passport", "travel document"),
    "DRIVING_LICENSE": ("license", "driving"),
    "TAX_ID": ("tin", "tax", "vat"),
    "CVV": ("cvv", "cvc", "security code", "card verification"),
    "PAN": ("card", "credit", "debit", "pan", "card number"),
    "BANK_ACCOUNT_NO": ("account", "account number", "acc", "bank account"),
    "SWIFT_BIC": ("swift", "bic", "bank code"),
    "API_KEY_GENERIC": ("api_key", "api key", "apikey", "token", "secret", "key"),
    "API_KEY_OPENAI": ("api_key", "api key", "apikey", "token", "secret", "key"),
    "PASSWORD": ("password", "passwd", "pwd", "pass", "credentials", "secret"),
    "AWS_ACCESS_KEY": ("aws", "access key", "iam"),
    "AWS_SECRET_KEY": ("aws", "secret", "credentials"),
    "S3_BUCKET_REF": ("s3", "bucket", "storage"),
    "INTERNAL_IP": ("server", "host", "ip", "internal", "network"),
    "PHONE_LK": ("phone", "call", "mobile", "contact", "sms", "otp", "dispatch"),
    "PHONE_INTL": ("phone", "call", "mobile", "contact", "international"),
    "CARD_EXPIRY": ("expiry", "expires", "exp", "valid thru", "valid until"),
}

# Phrases before a number that make it a business reference.
REFERENCE_PHRASES = (
    "transaction id", "transaction number", "transaction reference", "order reference", "order number", "order id",
    "invoice reference", "invoice number", "tracking reference", "tracking number", "tracking id", "serial number", "device serial",
    "batch number", "asset tag", "asset number", "ticket number", "ticket id", "case number", "case id",
    "shipment reference", "shipment number", "confirmation number", "correlation id", "session id", "request id",
)

# Types whose values can look alike; the higher score wins.
AMBIGUOUS = (("NIC_NEW", "BANK_ACCOUNT_NO"), ("TAX_ID", "NIC_OLD"), ("PASSPORT", "DRIVING_LICENSE"), ("PAN", "BANK_ACCOUNT_NO"), ("PASSWORD", "API_KEY_GENERIC"))
# Types that raise each other to CRITICAL.
DANGEROUS_PAIRS = (("FULL_NAME", "NIC_OLD"), ("FULL_NAME", "NIC_NEW"), ("FULL_NAME", "BANK_ACCOUNT_NO"), ("EMAIL", "PASSWORD"), ("BANK_ACCOUNT_NO", "PAN"), ("INTERNAL_IP", "DB_CONNECTION_STRING"), ("AWS_ACCESS_KEY", "AWS_SECRET_KEY"))
# Types told by their digits' shape alone.
DIGIT_SHAPED = ("NIC_NEW", "NIC_OLD", "TAX_ID", "BANK_ACCOUNT_NO", "PAN", "PHONE_LK", "PHONE_INTL")
# How types are masked.
TOKENIZED = ("API_KEY_OPENAI", "API_KEY_GENERIC", "JWT_TOKEN", "JWT_IN_LOG", "AWS_ACCESS_KEY", "AWS_SECRET_KEY", "PRIVATE_KEY", "BANK_ACCOUNT_NO", "IBAN", "S3_BUCKET_REF", "BASE64_ENCODED_SECRET", "HEX_ENCODED_SECRET", "DB_CONNECTION_STRING")
PARTIAL = ("PHONE_LK", "PHONE_INTL", "EMAIL", "PAN")
CONTEXTUAL = ("FULL_NAME", "GENDER", "RACE_ETHNICITY")
CRITICAL_TYPES = ("CVV", "PRIVATE_KEY", "SWIFT_MT103", "SWIFT_MT202", "PASSWORD", "JWT_TOKEN", "JWT_IN_LOG", "AWS_SECRET_KEY", "DB_CONNECTION_STRING")
MIN_BRANDED_KEY = 43


@dataclass(frozen=True)
class RuleSet:
    """Rules, and what may be swapped: keywords, validators (value Column to boolean Column) and safe variants.

    ``safe_splice`` drops an entity nested in another masked one instead of splicing both;
    ``safe_demotion`` demotes a short branded key alone, not those after it;
    ``keep_digits`` keeps runs of digits from being decoded as hexadecimal;
    ``as_written`` takes texts as they stand: nothing is decoded, no spacing is undone.
    """

    rules: tuple[Rule, ...] = RULES
    named: tuple[Rule, ...] = NAMED
    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(KEYWORDS))
    validators: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    safe_splice: bool = False
    safe_demotion: bool = False
    keep_digits: bool = False
    as_written: bool = False

    def with_rule(self, rule: Rule, keywords: tuple[str, ...] = (), validator: Callable[[Column], Column] | None = None) -> RuleSet:
        return replace(
            self,
            rules=(*self.rules, rule),
            keywords=self.keywords | ({rule.type: keywords} if keywords else {}),
            validators=self.validators | ({rule.type: validator} if validator else {}),
        )

    def ordered(self) -> list[Rule]:
        """Containers first, else in the table's order."""
        return sorted(self.rules, key=lambda r: not r.container)
