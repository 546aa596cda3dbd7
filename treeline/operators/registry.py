"""Registry of named operators with parameter schemas taken from their signatures."""

from __future__ import annotations

import inspect
import json
import types
import typing
from collections.abc import Callable
from dataclasses import dataclass

# JSON-schema names of parameter types; anything else is a string.
TYPE_NAMES = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array", tuple: "array"}


def schema_type(annotation: object) -> str:
    """JSON-schema type of an annotation; an optional one counts as its inner type."""
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        inner = [a for a in typing.get_args(annotation) if a is not type(None)]
        return schema_type(inner[0]) if len(inner) == 1 else "string"
    return TYPE_NAMES.get(typing.get_origin(annotation) or annotation, "string")


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict
    handler: Callable[..., dict]


def describe(handler: Callable[..., dict]) -> Tool:
    """A tool from a function or method: parameters without a default are required."""
    hints = typing.get_type_hints(handler)
    arguments = inspect.signature(handler).parameters
    properties = {n: {"type": schema_type(hints.get(n, str))} for n in arguments}
    required = [n for n, p in arguments.items() if p.default is inspect.Parameter.empty]
    parameters = {"type": "object", "properties": properties, "required": required}
    return Tool(handler.__name__, inspect.getdoc(handler) or "", parameters, handler)


class Registry:
    """Tools by name; calls come in as a name and JSON arguments and never raise."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, *handlers: Callable[..., dict]) -> None:
        for handler in handlers:
            tool = describe(handler)
            self._tools[tool.name] = tool

    def names(self) -> list[str]:
        return list(self._tools)

    def payload(self) -> list[dict]:
        """Function descriptions in the form chat models take."""
        return [
            {"type": "function", "function": {
                "name": t.name, "description": t.description, "parameters": t.parameters}}
            for t in self._tools.values()
        ]

    def execute(self, name: str, arguments: str) -> dict:
        try:
            values = json.loads(arguments)
        except json.JSONDecodeError as problem:
            return {"ok": False, "error": f"arguments are not valid JSON: {problem}", "raw_arguments": arguments}
        tool = self._tools.get(name)
        if tool is None:
            return {"ok": False, "error": f"unknown tool: {name}", "arguments": values}
        try:
            return tool.handler(**values)
        except (TypeError, KeyError) as problem:
            return {"ok": False, "error": f"arguments do not fit: {problem}", "arguments": values}
