"""Tool calls in a model's answers: the marker, its parser, and a registry that checks arguments.

A call is <tool>name</tool>, and behind it the arguments as one JSON object, if any. An answer holds no call
or one; whatever else it holds that looks like a call is taken out of what is shown.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed value: how a call is written, in either case.
CALL = rf"(?i)<tool>{X.WS}*([a-z0-9_.-]+){X.WS}*</tool>{X.WS}*(\{{[^}}]*\}}|\[[^\]]*\])?"
#: What is said of answers whose call cannot be taken.
SEVERAL, NO_OBJECT, NO_JSON = "more than one tool call in one reply", "tool arguments must be an object", "tool arguments were not valid JSON"
#: What a model is told of its tools, by their names alone and by the registry.
BY_NAME = (
    'If the visitor asks you to do something these tools can do, reply with a single line <tool>name</tool>{{"argument":"value"}} and nothing else. '
    "Available: {0}. If a required detail is missing, ask for it — never invent an address or a name."
)
BY_REGISTRY = (
    "You can ask this page to do one thing for the visitor. When the request is clear, reply with exactly one line of the form "
    '<tool>name</tool>{{"argument":"value"}} and nothing else; the page runs it and reports back. If a required detail is missing, ask for it instead of inventing it. Available:\n{0}'
)
#: JSON types, by what a VARIANT calls them.
TYPES = {"string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "array": ("ARRAY",), "object": ("OBJECT",)}


def tool_call(answer: Column, allowed: list[str] | None = None) -> Column:
    """Struct (tool, args, error) of the call that an answer holds: args is JSON, {} where none are given.
    Without a call all are null; a call that cannot be taken leaves only its error. allowed: None takes any name."""
    t = X.text(answer)
    names, bodies = (F.regexp_extract_all(t, F.lit(CALL), F.lit(i)) for i in (1, 2))
    n, name, body = F.size(names), F.lower(F.get(names, F.lit(0))), F.get(bodies, F.lit(0))
    known = F.lit(True) if allowed is None else name.isin(allowed) if allowed else F.lit(False)
    # both give null for what is no JSON; a body begins with the bracket of one of the two
    bad_list = body.startswith("[") & F.json_array_length(body).isNull()
    bad_object = body.startswith("{") & F.json_object_keys(body).isNull()
    error = (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(n > 1, F.concat(F.lit(f"{SEVERAL} ("), n.cast("string"), F.lit(")")))
        .when(~known, F.concat(F.lit('tool "'), name, F.lit('" is not available')))
        .when(bad_list | bad_object, NO_JSON)
        .when(body.startswith("["), NO_OBJECT)
    )
    good = (n == 1) & error.isNull()
    return F.struct(F.when(good, name).alias("tool"), F.when(good, F.when(body == "", "{}").otherwise(body)).alias("args"), error.alias("error"))


def without_tools(answer: Column) -> Column:
    """An answer as it is shown: no calls, no more than one empty line, nothing around it."""
    return X.trim(F.regexp_replace(F.regexp_replace(X.text(answer), CALL, ""), "\n{3,}", "\n\n"))


def tool_instruction(names: list[str]) -> str:
    """How a model is told to call a tool; empty without tools."""
    return BY_NAME.format(", ".join(names)) if names else ""


@dataclass(frozen=True)
class Tool:
    """What a tool takes: parameters by name with their JSON type, and which of them it needs. ``strict``
    tools refuse parameters that they do not name."""

    parameters: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    description: str | None = None
    strict: bool = False

    def __post_init__(self):
        unknown = [*(t for t in self.parameters.values() if t not in TYPES), *(r for r in self.required if r not in self.parameters)]
        if unknown:
            raise ValueError(f"unknown types or parameters: {unknown}")

    def fault(self, args: Column) -> Column:
        """Why a VARIANT of arguments is refused; null if it is not."""
        checks = []
        for name in self.required:
            value = F.try_variant_get(args, f"$['{name}']", "variant")
            checks.append(F.when(value.isNull() | F.is_variant_null(value), f'arguments rejected: "{name}" is missing'))
        for name, kind in self.parameters.items():
            value = F.try_variant_get(args, f"$['{name}']", "variant")
            is_of = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(*TYPES[kind])
            checks.append(F.when(value.isNotNull() & ~F.is_variant_null(value) & ~is_of, f'arguments rejected: "{name}" must be of type {kind}'))
        if self.strict:
            more = F.array_except(F.json_object_keys(F.to_json(args)), F.array(*map(F.lit, self.parameters)).cast("array<string>"))
            checks.append(F.when(F.size(more) > 0, F.concat(F.lit("arguments rejected: unknown "), F.array_join(F.array_sort(more), ", "))))
        return F.coalesce(*checks, F.lit(None).cast("string"))


class ToolRegistry:
    """Tools by name, in lower case."""

    def __init__(self, tools: dict[str, Tool]):
        self.tools = {name.lower(): tool for name, tool in tools.items()}

    def instruction(self) -> str:
        lines = []
        for name, tool in self.tools.items():
            what = f" {json.dumps(tool.parameters, separators=(',', ':'))}" if tool.parameters else ""
            lines.append(f"  <tool>{name}</tool>{what}{f' — {tool.description}' if tool.description else ''}")
        return BY_REGISTRY.format("\n".join(lines)) if lines else ""

    def checked(self, answers: DataFrame, answer: str = "answer") -> DataFrame:
        """Adds shown, tool, args (VARIANT) and error. A row has a tool with arguments that it takes, or an
        error, or neither; a refused call keeps its tool's name."""
        call = answers.withColumn("__call", tool_call(F.col(answer)))
        name = F.col("__call.tool")
        args = F.try_parse_json("__call.args")
        fault = F.when(name.isNotNull() & args.isNull(), NO_JSON)  # such as a key given twice
        for known, tool in self.tools.items():
            fault = fault.when(name == known, tool.fault(args))
        fault = fault.when(name.isNotNull(), F.concat(F.lit('no tool named "'), name, F.lit('" is registered on this page')))
        error = F.coalesce("__call.error", fault)
        out = call.withColumns({"shown": without_tools(F.col(answer)), "tool": name, "error": error})
        return out.withColumn("args", F.when(F.col("error").isNull(), args)).drop("__call")
