"""What is done to a hook payload before it is kept: classification, redaction of secrets, stripping of content.

Nested payloads need recursion over arbitrary JSON, which Column expressions lack, so these run as Arrow-batched functions; top-level text has an
expression of its own.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Secrets inside texts, in the order in which they are replaced.
SECRETS = (
    r"(?i)bearer\s+[a-z0-9._\-]+",
    r"sk-[a-zA-Z0-9_\-]{16,}",
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[a-zA-Z0-9]{20,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
REDACTED = "[REDACTED]"
#: Members that hold content.
CONTENT_KEYS = frozenset("prompt text content tool_input tool_output output command edits result_json description summary agent_message task attachments".split())
#: Names of secrets, without dashes and underscores: whole ones, and endings.
SENSITIVE = r"^(auth|authorization|credentials?)$|(token|secret|password|passwd|apikey|privatekey|accesskey|sessionkey)$"

_patterns = [re.compile(p, re.ASCII) for p in SECRETS]
_sensitive = re.compile(SENSITIVE)


class _Number(str):
    """A number by its digits."""


def _refuse(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def one_value(text: str):
    """The one JSON value of a text; ValueError if there is none, or anything after it."""
    text = text.strip(" \t\r\n")
    value, end = _decoder.raw_decode(text)
    if end != len(text):
        raise ValueError("more than one value")
    return value


def dump(value) -> str:
    """Compact JSON, numbers as they stood."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def sensitive_key(key: str) -> bool:
    return bool(_sensitive.search(key.lower().replace("-", "").replace("_", "")))


def redact(value):
    if isinstance(value, dict):
        return {k: REDACTED if sensitive_key(k) else redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v) for v in value]
    if isinstance(value, str) and not isinstance(value, _Number):
        for p in _patterns:
            value = p.sub(REDACTED, value)
    return value


def strip(value):
    """Content members become the size of what they held."""
    if isinstance(value, dict):
        return {k: {"_stripped_bytes": _Number(len(dump(v).encode()))} if k.lower() in CONTENT_KEYS else strip(v) for k, v in value.items()}
    return [strip(v) for v in value] if isinstance(value, list) else value


def kept_payload(text: str | None, strict: bool) -> str | None:
    """The payload as it is kept: redacted, then stripped if strict. What isn't exactly one JSON value is kept as a JSON string, as it came; of one nested deeper than
    Python's parser goes (about a thousand levels) only its size is kept, since its secrets can't be found."""
    if text is None:
        return None
    try:
        value = redact(one_value(text))
        return dump(strip(value) if strict else value)
    except ValueError:
        return json.dumps(text, ensure_ascii=False)
    except RecursionError:
        return json.dumps({"_stripped_bytes": len(text.encode())})


@F.pandas_udf(StringType())
def kept_payloads(payload: pd.Series, strict: pd.Series) -> pd.Series:
    return pd.Series([kept_payload(p, bool(s)) for p, s in zip(payload, strict, strict=True)], dtype=object)


@F.pandas_udf(BooleanType())
def is_one_value(payload: pd.Series) -> pd.Series:
    """Exactly one JSON value and nothing behind it."""

    def check(text) -> bool:
        try:
            one_value(text)
        except (ValueError, AttributeError):
            return False
        except RecursionError:  # a value, though too deep to be taken apart
            return True
        return True

    return payload.map(check).astype(bool)


def redacted_text(text: Column) -> Column:
    """Secrets inside a text replaced, without Python."""
    for p in SECRETS:
        text = F.regexp_replace(text, p, REDACTED)
    return text


def is_sensitive(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[-_]", "").rlike(SENSITIVE)


def censusable(key: Column, value: Column, most: int = 64) -> Column:
    """A key that holds no content, with a short text."""
    return (F.octet_length(value) <= most) & ~F.lower(key).isin(*sorted(CONTENT_KEYS))
