"""Scalar text functions as Column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest text kept in a usage log, and the marker behind a longer one.
LOG_CHARS, LOG_MARK = 10_000, "... [truncated]"
WITHHELD = "[not logged]"


def strip(text: Column) -> Column:
    """Trims all Unicode white space, as opposed to `trim`, which trims blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def full_prompt(prompt: Column, system: Column | None = None) -> Column:
    """The prompt as cached: a non-empty system instruction goes first, inside SYSTEM tags."""
    if system is None:
        return prompt
    tagged = F.concat(F.lit("[SYSTEM]"), system, F.lit("[/SYSTEM]"), prompt)
    return F.when(F.length(system) > 0, tagged).otherwise(prompt)


def cache_key(prompt: Column, model: Column, system: Column | None = None) -> Column:
    """SHA-256 of `model:prompt` in hex."""
    return F.sha2(F.concat(model, F.lit(":"), full_prompt(prompt, system)).cast("binary"), 256)


def audit_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt.cast("binary"), 256), 1, 16)


def document_id(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def truncate_for_log(text: Column, limit: int = LOG_CHARS, mark: str = LOG_MARK) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def withhold(text: Column, logged: bool) -> Column:
    return text if logged else F.lit(WITHHELD)


def first_keyword(sql: Column) -> Column:
    """First word in upper case; '' for a blank text."""
    return F.upper(F.regexp_extract(strip(sql), r"(?U)^\S+", 0))


def code_block(text: Column) -> Column:
    """Contents of the first fenced block, else the text itself."""
    found = F.regexp_extract(text, r"(?s)```(?:\w+)?\n(.*?)```", 1)
    return F.when(F.regexp_like(text, F.lit(r"(?s)```(?:\w+)?\n.*?```")), strip(found)).otherwise(text)


def json_array(text: Column) -> Column:
    """The widest [...] of a text, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def json_object(text: Column) -> Column:
    """The widest {...} of a text, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def recommendation_lines(text: Column, limit: int = 5) -> Column:
    """Up to `limit` lines that begin with a digit or a dash, without their numbering."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda x: F.regexp_like(x, F.lit("^[0-9-]")))
    return F.slice(F.transform(kept, lambda x: F.regexp_replace(x, r"^[0-9.\-) ]+", "")), 1, limit)


def react_step(text: Column) -> Column:
    """struct(thought, action, action_input) of a Thought / Action / Action Input transcript.

    The input is a JSON object, or the plain text wrapped as {"input": text}; it ends at the
    first blank line. A missing block is '' (thought) or null.
    """
    part = lambda pattern: F.when(F.regexp_like(text, F.lit(pattern)), strip(F.regexp_extract(text, pattern, 1)))
    given = part(r"(?s)Action Input:\s*(.+?)(?=\n\n|\z)")
    parsed = F.try_parse_json(given)
    wrapped = F.when(given.isNull(), F.lit(None)).when(parsed.isNotNull(), given).otherwise(F.to_json(F.struct(given.alias("input"))))
    return F.struct(
        F.coalesce(part(r"(?s)Thought:\s*(.+?)(?=\nAction:|\z)"), F.lit("")).alias("thought"),
        part(r"(?s)Action:\s*(.+?)(?=\nAction Input:|\z)").alias("action"),
        wrapped.alias("action_input"),
    )


def suite_name(table: Column) -> Column:
    return F.translate(table, ".", "_")


def resolve_name(name: Column, catalog: str, schema: str) -> Column:
    """A one-, two- or three-part table name as three parts; a longer one stays."""
    parts = F.size(F.split(name, r"\."))
    return F.when(parts == 1, F.concat(F.lit(f"{catalog}.{schema}."), name)).when(parts == 2, F.concat(F.lit(f"{catalog}."), name)).otherwise(name)


def render(template: str, variables: dict[str, Column], defaults: dict[str, str] | None = None) -> Column:
    """A brace template filled from columns: a null takes its default, or ''. Unknown names are an error."""
    import string

    defaults = defaults or {}
    parts = []
    for plain, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(plain))
        if name is not None:
            if name not in variables and name not in defaults:
                raise ValueError(f"no value for template variable {name}")
            value = variables.get(name, F.lit(None)).cast("string")
            parts.append(F.coalesce(value, F.lit(defaults.get(name, ""))))
    return F.concat(*parts)


def error_class(message: Column) -> Column:
    """Kind of a provider's error by its words; the first that fits."""
    low = F.lower(message)
    has = lambda *words: _all([low.contains(w) for w in words])
    return (
        F.when(message.isNull(), F.lit(None).cast("string"))
        .when(has("rate", "limit"), "rate_limit")
        .when(low.contains("token") & (low.contains("limit") | low.contains("exceed")), "token_limit")
        .when(low.contains("not found") | low.contains("invalid"), "model_not_available")
        .when(low.contains("auth") | low.contains("api key"), "authentication")
        .otherwise("other")
    )


def _all(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found & c
    return found
