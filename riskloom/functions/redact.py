"""Redaction of personal data in strings, maps and JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker, the patterns in the order in which they apply, and the sensitive keys.
REDACTED = "«redacted»"
EMAIL = r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
ACCOUNT = r"(?i)\bacct[_-]?\d{6,}\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
SENSITIVE_KEYS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "access_key", "secret_key", "private_key", "session_token", "credential", "pan", "card_number",
    "cvv", "cvc", "ssn", "tax_id",
)

#: A short IPv6 form such as fe80::1, which the long pattern does not see.
IPV6_SHORT = r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?![\w:])"
#: Three groups of two digits are a clock time, not an address.
CLOCK = r"(?<![\w:])\d{1,2}:\d{2}:\d{2}(?![\w:])"

PATTERNS = {"email": EMAIL, "card": CARD, "iban": IBAN, "account": ACCOUNT, "ipv4": IPV4, "ipv6": IPV6}


def java(pattern: str) -> str:
    """As Java needs it for letters beyond ASCII."""
    return "(?U)" + pattern


def redact_cards(text: Column) -> Column:
    """Card numbers that pass the Luhn check become the marker and their last four digits. The text is put together
    again from the pieces between matches, so nothing but a match changes."""
    digits = lambda m: F.regexp_replace(m, "[ -]", "")
    marked = lambda m: F.when(F.call_function("luhn_check", digits(m)), F.concat(F.lit(f"{REDACTED}(card:…"), F.right(digits(m), F.lit(4)), F.lit(")"))).otherwise(m)
    pieces, found = F.split(text, java(CARD), -1), F.regexp_extract_all(text, F.lit(java(CARD)), F.lit(0))
    joined = F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(marked(m), F.lit("")))), "")
    # thirteen digits with a blank or a hyphen between are rare, and cheaper to look for
    return F.when(text.rlike(java(r"\d(?:[ -]?\d){12}")), joined).otherwise(text)


def _guarded(text: Column, needs: Column, pattern: str) -> Column:
    """The pattern replaced where a cheaper test says that it can match at all."""
    return F.when(needs, F.regexp_replace(text, java(pattern), REDACTED)).otherwise(text)


def redact(text: Column, clock_safe: bool = True) -> Column:
    """The six patterns one after the other. ``clock_safe`` keeps clock times, which the IPv6 pattern takes for
    addresses, and redacts short IPv6 forms, which it misses; without it the plain patterns apply. A pattern runs over a
    text only if the text has what each of its matches has."""
    colon = F.contains(text, F.lit(":"))
    out = _guarded(text, F.contains(text, F.lit("@")), EMAIL)
    out = redact_cards(out)
    out = _guarded(out, text.rlike(java(r"[A-Z]{2}\d{2}")), IBAN)
    out = _guarded(out, text.rlike("(?i)acct"), ACCOUNT)
    out = _guarded(out, text.rlike(java(r"\d\.\d")), IPV4)
    if not clock_safe:
        return _guarded(out, colon, IPV6)
    out = _guarded(out, colon, f"(?!{CLOCK}){IPV6}")
    return _guarded(out, F.contains(text, F.lit("::")), IPV6_SHORT)


def count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(java(PATTERNS[kind])))


def redact_map(values: Column) -> Column:
    """A map<string,string> with sensitive keys' values replaced whatever they hold, others redacted as text."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit(REDACTED)).otherwise(redact(v)))


_EMAIL, _CARD, _REST = re.compile(EMAIL), re.compile(CARD), [re.compile(p) for p in (IBAN, ACCOUNT, IPV4)]
_IPV6, _SHORT, _PLAIN6 = re.compile(f"(?!{CLOCK}){IPV6}"), re.compile(IPV6_SHORT), re.compile(IPV6)


def _luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def redact_text(text: str, clock_safe: bool = True) -> str:
    """The same as redact(), for nested values that only Python can walk."""
    out = _EMAIL.sub(REDACTED, text)
    digits = lambda m: re.sub("[ -]", "", m.group(0))
    out = _CARD.sub(lambda m: f"{REDACTED}(card:…{digits(m)[-4:]})" if 13 <= len(digits(m)) <= 19 and _luhn(digits(m)) else m.group(0), out)
    for pattern in (*_REST, *((_IPV6, _SHORT) if clock_safe else (_PLAIN6,))):
        out = pattern.sub(REDACTED, out)
    return out


def redact_value(root):
    """A nested value with every string redacted, at any depth: the walk keeps its own stack, so depth neither ends
    it nor lets anything through."""
    done = [root]
    work = [(done, 0)]
    while work:
        holder, key = work.pop()
        value = holder[key]
        if isinstance(value, str):
            holder[key] = redact_text(value)
        elif isinstance(value, dict):
            holder[key] = copy = dict(value)
            for k in copy:
                if isinstance(k, str) and k.lower() in SENSITIVE_KEYS:
                    copy[k] = REDACTED
                else:
                    work.append((copy, k))
        elif isinstance(value, (list, tuple, set)):
            holder[key] = copy = list(value)
            work.extend((copy, i) for i in range(len(copy)))
    return done[0]


def redact_json(text: Column) -> Column:
    """A JSON document with all its strings redacted; text that is not JSON is redacted as text."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            parsed = json.loads(value)
        except (ValueError, RecursionError):
            return redact_text(value)
        return json.dumps(redact_value(parsed), ensure_ascii=False)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run(text)
