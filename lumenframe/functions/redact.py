"""Redaction of secrets as column expressions: counts and replacements fold over an ordered list of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types and patterns in firing order; each works on the output of the one before.
PATTERNS: list[tuple[str, str]] = [
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("connection_string", r"(?i)(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqp|mssql)://\S+"),
    ("bearer_token", r"[Bb]earer\s+[a-zA-Z0-9_\-./+=]{20,}"),
    ("aws_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    ("api_key", r"(?i)(?:api[_-]?key|apikey|api_secret|api_token|secret_key|access_token|auth_token)\s*[:=]\s*[\"']?([a-zA-Z0-9_\-/+=]{20,})[\"']?"),
    ("api_key", r"\b(?:sk|pk|rk|whsec)[_-][a-zA-Z0-9_\-]{20,}\b"),
    ("api_key", r"(?i)(?:token|secret|password|key|auth|credential)\s*[:=]\s*[\"']?([a-zA-Z0-9_\-/+=]{32,})[\"']?"),
    ("password_field", r"(?i)(?:password|passwd|pwd)\s*[:=]\s*\S+"),
    ("credit_card", r"\b(?:\d{4}[\s-]){3}\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
]


def active_patterns(extra: dict[str, list[str]] | None = None, disabled: list[str] | None = None) -> list[tuple[str, str]]:
    """Patterns in firing order. ``extra`` ignores case and joins an existing type, else comes last."""
    names = list(dict.fromkeys(name for name, _ in PATTERNS))
    by_name = {name: [p for n, p in PATTERNS if n == name] for name in names if name not in (disabled or [])}
    for name, patterns in (extra or {}).items():
        by_name.setdefault(name, []).extend("(?i)" + p for p in patterns or [])
    return [(name, pattern) for name, patterns in by_name.items() for pattern in patterns]


def _fold(text: Column, patterns: list[tuple[str, str]]):
    """Yields (type, number of matches, text before) for each pattern, then the final text as (None, None, text)."""
    current = F.coalesce(text, F.lit(""))
    for name, pattern in patterns:
        java = F.lit("(?U)" + pattern)  # classes cover Unicode
        yield name, F.regexp_count(current, java), current
        current = F.regexp_replace(current, java, F.lit(f"[REDACTED:{name}]"))
    yield None, None, current


def redact_text(text: Column, extra=None, disabled=None) -> Column:
    """``text`` with secrets replaced; null gives ''."""
    return list(_fold(text, active_patterns(extra, disabled)))[-1][2]


def redact(text: Column, extra=None, disabled=None) -> Column:
    """struct(text, redacted_count, redacted_types) with the types in firing order."""
    steps = list(_fold(text, active_patterns(extra, disabled)))
    counts = [(name, count) for name, count, _ in steps[:-1]]
    total = sum((c for _, c in counts), F.lit(0))
    types = F.array_distinct(F.array_compact(F.array(*[F.when(c > 0, F.lit(name)) for name, c in counts]))) if counts else F.array().cast("array<string>")
    return F.struct(steps[-1][2].alias("text"), total.cast("int").alias("redacted_count"), types.alias("redacted_types"))


def redact_columns(df, columns=("text", "window_title", "extra_context"), extra=None, disabled=None):
    """Redacts several columns, nulls staying null; the plan has one fold for each."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), redact_text(F.col(c), extra, disabled)) for c in columns})
