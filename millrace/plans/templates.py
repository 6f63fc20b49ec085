"""Prompt templates with declared variables, examples and versions; rendered for a row on the driver or for a column in the JVM."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import render

#: Python types that a variable of a kind takes; kinds that aren't here take anything.
KINDS = {"string": str, "integer": int, "float": (int, float), "boolean": bool, "list": list, "dict": dict}


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str = "string"
    required: bool = True
    default: object = None
    description: str = ""

    def problem(self, value: object) -> str | None:
        if value is None:
            return f"missing variable {self.name}" if self.required else None
        wanted = KINDS.get(self.kind)
        wrong = wanted is not None and (not isinstance(value, wanted) or (isinstance(value, bool) and self.kind in ("integer", "float")))
        return f"variable {self.name} must be {self.kind}" if wrong else None


@dataclass(frozen=True)
class Example:
    inputs: dict
    output: str
    explanation: str | None = None


def example_block(examples: list[Example]) -> str:
    """The block of worked examples that precedes a prompt; '' without examples. Its wording is a fixed value."""
    if not examples:
        return ""
    lines = ["Here are some examples:", ""]
    for number, example in enumerate(examples, 1):
        lines.append(f"Example {number}:")
        lines += [f"  {name}: {value}" for name, value in example.inputs.items()]
        lines.append(f"  Output: {example.output}")
        lines += [f"  Explanation: {example.explanation}"] if example.explanation else []
        lines.append("")
    return "\n".join(lines)


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    variables: tuple[Variable, ...] = ()
    examples: tuple[Example, ...] = ()
    version: str = "1.0.0"
    tags: tuple[str, ...] = ()
    description: str = ""
    system: str | None = None

    def whole(self) -> str:
        """Examples and text. Braces in examples are filled like those of the text."""
        block = example_block(list(self.examples))
        return f"{block}\n\n{self.text}" if block else self.text

    def filled(self, **given: object) -> str:
        """The prompt for one set of values; a missing or mistyped one is a ValueError."""
        values = {v.name: given[v.name] if given.get(v.name) is not None else v.default for v in self.variables}
        problems = [p for v in self.variables if (p := v.problem(values[v.name]))]
        if problems:
            raise ValueError("; ".join(problems))
        return self.whole().format(**{k: "" if v is None else v for k, v in values.items()})

    def column(self, values: dict[str, Column]) -> Column:
        """The prompts for the rows of a table; null where a required variable is null and has no default."""
        known = {v.name: values.get(v.name, F.lit(None)) for v in self.variables}
        defaults = {v.name: str(v.default) for v in self.variables if v.default is not None}
        prompt = render(self.whole(), known, defaults)
        needed = [known[v.name].isNotNull() for v in self.variables if v.required and v.default is None]
        for one in needed:
            prompt = F.when(one, prompt)
        return prompt

    def exported(self) -> dict:
        variables = [{"name": v.name, "type": v.kind, "required": v.required, "default": v.default, "description": v.description} for v in self.variables]
        return {"name": self.name, "description": self.description, "template": self.text, "variables": variables, "system_instruction": self.system, "version": self.version, "tags": list(self.tags)}


@dataclass
class Library:
    """Templates by name and version; the version added last is the current one."""

    history: dict[str, dict[str, Template]] = field(default_factory=dict)

    def add(self, template: Template) -> None:
        versions = self.history.setdefault(template.name, {})
        versions.pop(template.version, None)
        versions[template.version] = template

    def get(self, name: str, version: str | None = None) -> Template | None:
        versions = self.history.get(name, {})
        return versions.get(version) if version else next(reversed(versions.values()), None)

    def filled(self, name: str, **given: object) -> str:
        found = self.get(name)
        if found is None:
            raise KeyError(f"no template {name}")
        return found.filled(**given)

    def names(self, tag: str | None = None) -> list[str]:
        return [n for n in self.history if tag is None or tag in self.get(n).tags]

    def versions(self, name: str) -> list[str]:
        return list(self.history.get(name, {}))

    def remove(self, name: str) -> bool:
        return self.history.pop(name, None) is not None

    def exported(self) -> dict[str, dict]:
        return {n: self.get(n).exported() for n in self.history}

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, version, added, current, tags, variables) of all versions, in the order they were added."""
        rows = [(n, v, at, t is self.get(n), list(t.tags), [x.name for x in t.variables]) for n, versions in self.history.items() for at, (v, t) in enumerate(versions.items())]
        return spark.createDataFrame(rows, "name string, version string, added int, current boolean, tags array<string>, variables array<string>")

    def search(self, spark: SparkSession, words: str) -> DataFrame:
        """Names of current templates whose name, description or text hold the words, whatever the case."""
        rows = [(n, f"{n}\n{t.description}\n{t.text}") for n in self.history for t in [self.get(n)]]
        found = spark.createDataFrame(rows, "name string, words string")
        return found.filter(F.contains(F.lower("words"), F.lit(words.lower()))).select("name")
