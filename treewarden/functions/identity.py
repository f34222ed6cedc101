"""Identifiers of findings."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def payload(analyzer: str, version: str, subject: str, evidence: dict) -> str:
    """Fixed format, as ids must stay the same: the JSON of what a finding is about, not where it stands, by sorted keys."""
    return json.dumps({"a": analyzer, "v": version, "s": subject, "e": evidence}, sort_keys=True, ensure_ascii=False)


def finding_id(analyzer: str, version: str, subject: str, evidence: dict) -> str:
    """96 bits of blake2b over the payload."""
    return hashlib.blake2b(payload(analyzer, version, subject, evidence).encode(), digest_size=12).hexdigest()


def _payloads(analyzer: pd.Series, version: pd.Series, symbol: pd.Series, file: pd.Series, evidence: pd.Series) -> pd.Series:
    return pd.Series([payload(a, v, s or f, json.loads(e)) for a, v, s, f, e in zip(analyzer, version, symbol, file, evidence, strict=True)], dtype=object)


def _finding_ids(analyzer: pd.Series, version: pd.Series, symbol: pd.Series, file: pd.Series, evidence: pd.Series) -> pd.Series:
    return pd.Series([finding_id(a, v, s or f, json.loads(e)) for a, v, s, f, e in zip(analyzer, version, symbol, file, evidence, strict=True)], dtype=object)


def _short_hash(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=4).hexdigest())


def _content_hash(content: pd.Series) -> pd.Series:
    from ..operators.nodes import normalized_bytes

    return content.map(lambda c: hashlib.blake2b(normalized_bytes(bytes(c)), digest_size=16).hexdigest())


def finding_ids(*columns: str) -> Column:
    """Ids from analyzer, version, symbol, file and evidence (JSON); without a symbol the file is the subject."""
    return F.pandas_udf(_finding_ids, "string")(*columns)


def finding_payloads(*columns: str) -> Column:
    """What finding_ids digests, as text."""
    return F.pandas_udf(_payloads, "string")(*columns)


def short_hash(text) -> Column:
    """32 bits of blake2b, for window hashes."""
    return F.pandas_udf(_short_hash, "string")(text)


def content_hash(content) -> Column:
    """128 bits of blake2b over normalised bytes."""
    return F.pandas_udf(_content_hash, "string")(content)
