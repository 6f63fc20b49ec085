"""Named tools with declared parameters, for agents and notebooks: validation, results and schemas."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from millrace.operators.profile import profile
from millrace.sources import files, gateway

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str = "string"
    description: str = ""
    required: bool = True
    default: object = None
    choices: tuple = ()


@dataclass(frozen=True)
class Outcome:
    ok: bool
    output: object = None
    error: str | None = None

    def text(self) -> str:
        return json.dumps({"status": "success" if self.ok else "error", "output": self.output, "error": self.error}, default=str)


@dataclass
class Tool:
    name: str
    description: str
    run: Callable[..., object]
    parameters: list[Parameter] = field(default_factory=list)

    def problems(self, given: dict) -> list[str]:
        found = [f"missing parameter {p.name}" for p in self.parameters if p.required and given.get(p.name) is None]
        for p in self.parameters:
            value = given.get(p.name)
            if value is None:
                continue
            if not isinstance(value, KINDS[p.kind]) or (p.kind in ("integer", "number") and isinstance(value, bool)):
                found.append(f"{p.name} must be {p.kind}")
            elif p.choices and value not in p.choices:
                found.append(f"{p.name} must be one of {', '.join(map(str, p.choices))}")
        return found

    def __call__(self, **given) -> Outcome:
        """Validates, fills defaults and runs; an exception becomes an error outcome."""
        if wrong := self.problems(given):
            return Outcome(False, error="; ".join(wrong))
        known = {p.name: given.get(p.name, p.default) if given.get(p.name) is not None else p.default for p in self.parameters}
        try:
            return Outcome(True, self.run(**known))
        except Exception as e:  # noqa: BLE001
            return Outcome(False, error=str(e))

    def schema(self) -> dict:
        properties = {p.name: {"type": p.kind, "description": p.description} | ({"enum": list(p.choices)} if p.choices else {}) for p in self.parameters}
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": properties, "required": [p.name for p in self.parameters if p.required]}}


class Registry:
    def __init__(self, tools: list[Tool] | None = None):
        self.tools = {t.name: t for t in tools or []}

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def names(self) -> list[str]:
        return list(self.tools)

    def schemas(self) -> list[dict]:
        return [t.schema() for t in self.tools.values()]

    def run(self, name: str, **given) -> Outcome:
        tool = self.tools.get(name)
        return tool(**given) if tool else Outcome(False, error=f"unknown tool {name}")


def spark_tools(spark: SparkSession, max_rows: int = 100) -> Registry:
    """Query, table info, profile and file reading over a session."""

    def query(query: str) -> dict:
        r = gateway.run(spark, query, max_rows)
        return {"columns": r.columns, "rows": r.rows, "total_rows": r.total_rows}

    def profiled(table_name: str, columns: str) -> dict:
        found: dict = {}
        for r in profile(spark.table(table_name), columns).collect():
            found.setdefault(r.column_name, {})[r.metric] = r.value
        return found

    def read(path: str, format: str, max_lines: int) -> list[dict]:
        return [r.asDict() for r in files.read_file(spark, path, format, max_lines).collect()]

    table = Parameter("table_name", "string", "table to look at")
    return Registry([
        Tool("execute_sql", "runs a reading SQL statement", query, [Parameter("query", "string", "the statement")]),
        Tool("table_info", "columns, properties and a sample of a table", lambda table_name, include_sample: files.table_info(spark, table_name, include_sample), [table, Parameter("include_sample", "boolean", "with rows", False, True)]),
        Tool("profile_data", "statistics of a table's columns, over all rows", profiled, [table, Parameter("columns", "string", "all, or a comma list", False, "all")]),
        Tool("read_file", "first lines of a file", read, [Parameter("path"), Parameter("format", "string", "", False, "text", ("text", "json", "csv")), Parameter("max_lines", "integer", "", False, 100)]),
    ])
