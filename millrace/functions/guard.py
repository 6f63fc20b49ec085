"""Guardrails on text columns: personal data, SQL risk, code snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Detectors of personal data in the order they are applied (name, pattern, risk, placeholder).
PII = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "medium", "[EMAIL_REDACTED]"),
    ("phone_number", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "medium", "[PHONE_REDACTED]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "critical", "[SSN_REDACTED]"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "critical", "[CC_REDACTED]"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "low", "[IP_REDACTED]"),
    ("potential_api_key", r"\b[A-Za-z0-9]{32,}\b", "high", "[KEY_REDACTED]"),
    ("aws_access_key", r"\bAKIA[A-Z0-9]{16}\b", "critical", "[AWS_KEY_REDACTED]"),
    ("private_key", r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----", "critical", "[PRIVATE_KEY_REDACTED]"),
]
#: Risky SQL (pattern, risk), with a description in own words.
SQL_RISKS = [
    (r"\bDROP\s+(TABLE|DATABASE|SCHEMA|VIEW)\b", "critical", "removes an object"),
    (r"\bTRUNCATE\s+TABLE\b", "critical", "empties a table"),
    (r"\bDELETE\s+FROM\b(?!\s+WHERE)", "high", "deletes every row"),
    (r"\bUPDATE\b(?!.*\bWHERE\b)", "high", "an UPDATE of every row"),
    (r"\bGRANT\s+ALL\b", "high", "hands out every right"),
    (r"\bALTER\s+USER\b", "high", "changes an account"),
    (r"\bCREATE\s+USER\b", "medium", "makes an account"),
    (r";\s*--", "high", "a comment follows the end of a statement"),
    (r"'\s*OR\s+'1'\s*=\s*'1", "critical", "a condition that is always true"),
    (r"'\s*OR\s+1\s*=\s*1", "critical", "a condition that is always true"),
    (r"\bUNION\s+SELECT\b", "medium", "a second select is appended"),
    (r"\bINTO\s+OUTFILE\b", "critical", "writes a file of the server"),
    (r"\bLOAD_FILE\b", "critical", "reads a file of the server"),
    (r"\bEXEC\s*\(", "critical", "runs a string as a statement"),
    (r"\bxp_cmdshell\b", "critical", "runs a command of the system"),
]
#: Statements that may run, and those that are refused by their first word.
SAFE_WORDS = ("SELECT", "SHOW", "DESCRIBE", "EXPLAIN", "WITH")
REFUSED_WORDS = ("DROP", "TRUNCATE", "DELETE", "UPDATE", "ALTER", "GRANT", "REVOKE")
#: What a Python snippet must not do.
SNIPPET_DENY = [r"os\.system", r"subprocess", r"__import__", r"open\s*\([^)]*['\"]w"]


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0))


def pii_findings(text: Column, detectors: list[tuple[str, str, str, str]] = PII) -> Column:
    """array(struct(rule, risk, matched)), one per match, in detector order; matched is its first 20 characters and '...'.

    `detectors` are PII, or PII and others of the same form (name, pattern, risk, placeholder).
    """

    def named(name: str, risk: str):
        return lambda m: F.struct(F.lit(name).alias("rule"), F.lit(risk).alias("risk"), F.concat(F.substring(m, 1, 20), F.lit("...")).alias("matched"))

    return F.concat(*[F.transform(_matches(text, p), named(name, risk)) for name, p, risk, _ in detectors])


def pii_counts(text: Column, detectors: list[tuple[str, str, str, str]] = PII) -> Column:
    """struct of one bigint per detector."""
    return F.struct(*[F.regexp_count(text, F.lit(f"(?i){p}")).cast("bigint").alias(name) for name, p, _, _ in detectors])


def pii_redact(text: Column, detectors: list[tuple[str, str, str, str]] = PII) -> Column:
    """Every match found in the original is replaced, literally, in the text so far redacted."""

    def replacing(tag: str):
        return lambda so_far, m: F.replace(so_far, m, F.lit(tag))

    out = text
    for _, pattern, _, tag in detectors:
        out = F.aggregate(_matches(text, pattern), out, replacing(tag))
    return out


def pii_pass(text: Column, block_on_critical: bool = True, detectors: list[tuple[str, str, str, str]] = PII) -> Column:
    """False if a critical detector matches (or, with block_on_critical off, always true). Null text passes."""
    if not block_on_critical:
        return F.lit(True)
    critical = None
    for _, pattern, risk, _ in detectors:
        if risk == "critical":
            hit = F.regexp_like(text, F.lit(f"(?i){pattern}"))
            critical = hit if critical is None else critical | hit
    return ~F.coalesce(critical, F.lit(False))


def sql_findings(sql: Column, allowed: tuple[str, ...] = SAFE_WORDS, extra: list[tuple[str, str, str]] | None = None) -> Column:
    """array(struct(rule, risk, description)): the first-word rule, then each pattern at most once."""
    from millrace.functions.text import first_keyword

    word = first_keyword(sql)
    entry = lambda rule, risk, text: F.struct(F.lit(rule).alias("rule"), F.lit(risk).alias("risk"), text.alias("description"))
    first = F.when(word.isin(*REFUSED_WORDS) & ~word.isin(*allowed), F.array(entry("operation", "high", F.concat(F.lit("Operation not allowed: "), word))))
    rules = [F.when(F.regexp_like(sql, F.lit(f"(?i){p}")), F.array(entry("pattern", risk, F.lit(text)))) for p, risk, text in SQL_RISKS + (extra or [])]
    none = F.array().cast("array<struct<rule:string,risk:string,description:string>>")
    return F.concat(*[F.coalesce(x, none) for x in (first, *rules)])


def sql_pass(findings: Column) -> Column:
    return ~F.exists(findings, lambda v: v["risk"].isin("high", "critical"))


def violation_rows(found: Column, limit: int = 100) -> Column:
    """Findings as rows of a log: (rule, risk, matched) with the matched text, or the description, cut to `limit` characters."""
    cut = lambda v: F.struct(v["rule"].alias("rule"), v["risk"].alias("risk"), F.substring(v.getItem("matched"), 1, limit).alias("matched"))
    return F.transform(found, cut)


def snippet_findings(code: Column) -> Column:
    """Patterns of SNIPPET_DENY found in a Python snippet. Snippets are scanned, never run."""
    return F.filter(F.array(*[F.when(F.regexp_like(code, F.lit(p)), F.lit(p)) for p in SNIPPET_DENY]), lambda x: x.isNotNull())


def combined_check(text: Column, admitted: Column, check_sql: bool = False, redact: bool = False) -> Column:
    """struct(passed, stopped_by, processed): rate, then personal data, then SQL; the first failure ends the checks.

    Without `redact` the processed text is the original.
    """
    pii, sql = pii_pass(text), sql_pass(sql_findings(text)) if check_sql else F.lit(True)
    stopped = F.when(~admitted, "rate_limit").when(~pii, "pii").when(~sql, "sql")
    processed = F.when(admitted & F.lit(redact), pii_redact(text)).otherwise(text)
    return F.struct(stopped.isNull().alias("passed"), stopped.alias("stopped_by"), processed.alias("processed"))


def response_pass(response: Column) -> Column:
    """Stricter than a prompt's check: any finding fails. Null passes."""
    return F.coalesce(F.size(pii_findings(response)) == 0, F.lit(True))


class Blocked(PermissionError):
    """A guarded call was refused."""


def protected(call, admit):
    """Driver-side wrapper: runs `call(prompt)` only if `admit(prompt)` is true."""

    def guarded(prompt: str, *args, **kwargs):
        if not admit(prompt):
            raise Blocked("blocked by guardrails")
        return call(prompt, *args, **kwargs)

    return guarded
