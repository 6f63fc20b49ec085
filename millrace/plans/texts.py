"""Texts made from schemas and rules without a model: DDL, YAML of sources and tests, docstrings, Markdown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

from millrace.operators.quality import Expectation


def ddl(table: str, schema: T.StructType, comment: str | None = None) -> str:
    """CREATE TABLE of a schema, with its comments."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = [f"  `{f.name}` {f.dataType.simpleString().upper()}" + ("" if f.nullable else " NOT NULL") + (f" COMMENT {quote(f.metadata['comment'])}" if "comment" in (f.metadata or {}) else "") for f in schema.fields]
    return f"CREATE TABLE {table} (\n" + ",\n".join(columns) + "\n)" + (f"\nCOMMENT {quote(comment)}" if comment else "")


def source_definition(database: str, schema: str, tables: Iterable[str]) -> dict:
    return {"name": f"{database}_{schema}", "database": database, "schema": schema, "tables": [{"name": t} for t in tables]}


def model_entry(name: str, description: str, expectations: Iterable[Expectation] = ()) -> dict:
    """The entry of a model among its tests: columns with the tests that stand for expectations."""
    columns: dict[str, list] = {}
    for e in expectations:
        test = {"not_null": "not_null", "unique": "unique"}.get(e.kind)
        if e.kind == "in_set":
            test = {"accepted_values": {"values": list(e.parameters.get("values", []))}}
        elif e.kind == "referential":
            test = {"relationships": {"to": f"ref('{e.parameters.get('table')}')", "field": e.parameters.get("key")}}
        if test is not None:
            columns.setdefault(e.column, []).append(test)
    return {"name": name, "description": description} | ({"columns": [{"name": c, "tests": t} for c, t in columns.items()]} if columns else {})


def schema_yaml(models: Iterable[dict], sources: Iterable[dict] = ()) -> str:
    """The schema file of models and sources, version 2."""
    whole: dict = {"version": 2, "models": list(models)}
    if sources := list(sources):
        whole["sources"] = sources
    return "\n".join(_yaml(whole, 0)) + "\n"


def _yaml(value: object, depth: int) -> list[str]:
    pad, out = "  " * depth, []
    pairs = value.items() if isinstance(value, dict) else (("-", v) for v in value)
    for key, v in pairs:
        head = f"{pad}- " if key == "-" else f"{pad}{key}:"
        if isinstance(v, (dict, list)) and v:
            below = _yaml(v, depth + 1)
            out += [head + below[0].lstrip(), *below[1:]] if key == "-" else [head, *below]
        else:
            out.append(head + ("" if key == "-" else " ") + _scalar(v))
    return out


def _scalar(v: object) -> str:
    if isinstance(v, bool) or v is None:
        return {True: "true", False: "false", None: "null"}[v]
    if isinstance(v, (int, float)):
        return str(v)
    if v in ({}, []):
        return "{}" if v == {} else "[]"
    text = str(v)
    plain = text and text[0].isalpha() and all(c.isalnum() or c in " _./()" for c in text) and text.strip() == text and text.lower() not in ("true", "false", "null", "yes", "no", "on", "off")
    return text if plain else "'" + text.replace("'", "''") + "'"


def model_sql(name: str, description: str, sql: str, config: dict | None = None) -> str:
    """The file of a model: its name and description as comments, its settings, its statement."""
    settings = ", ".join(f"{k}={v!r}" for k, v in (config or {}).items())
    return f"-- {name}\n-- {description}\n\n" + (f"{{{{ config({settings}) }}}}\n\n" if settings else "") + sql.strip() + "\n"


def docstring(description: str, parameters: Iterable[tuple[str, str, str]] = (), returns: str | None = None, raises: Iterable[str] = (), style: str = "google") -> str:
    """A docstring of a function; parameters are (name, type, description). Unknown styles are google's."""
    parameters, raises, out = list(parameters), list(raises), [description]

    def section(title: str, lines: list[str]) -> None:
        if lines:
            out.extend(["", title, "-" * len(title), *lines] if style == "numpy" else ["", f"{title}:", *(f"    {x}" for x in lines)])

    if style == "numpy":
        section("Parameters", [x for name, kind, text in parameters for x in (f"{name} : {kind}", f"    {text}")])
    else:
        section("Args", [f"{name} ({kind}): {text}" if kind else f"{name}: {text}" for name, kind, text in parameters])
    section("Returns", [returns] if returns else [])
    section("Raises", raises)
    return '"""' + "\n".join(out) + ('\n"""' if len(out) > 1 else '"""')


def markdown(title: str, body: str, below: Iterable[tuple] = (), level: int = 1) -> str:
    """A section and the sections below it, each (title, body) or (title, body, below)."""
    return f"{'#' * level} {title}\n\n{body}\n\n" + "".join(markdown(*part[:2], part[2] if len(part) > 2 else (), level + 1) for part in below)


def table_markdown(name: str, schema: T.StructType) -> str:
    """A table card: a row per column."""
    rows = "\n".join(f"| {f.name} | {f.dataType.simpleString()} | {(f.metadata or {}).get('comment', '')} |" for f in schema.fields)
    return markdown(name, f"| column | type | comment |\n|-|-|-|\n{rows}")
