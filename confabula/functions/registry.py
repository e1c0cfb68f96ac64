"""User-defined functions registered by name, with checked parameter schemas (the tool registry of the domain)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class ToolError(Exception):
    """What a tool declares as its error: a result, not a failure of the job."""

    def __init__(self, reason: str, detail: str | None = None, retryable: bool = False):
        super().__init__(reason)
        self.reason, self.detail, self.retryable = reason, detail, retryable


@dataclass(frozen=True)
class Definition:
    """A function with its policy: whether it is seen by default, how long a call may take (None: any time), what the context
    must hold, and whether its output is stored. parameters: a JSON schema of type object whose required keys are among its properties."""

    name: str
    function: Callable
    returns: str
    parameters: dict = field(default_factory=lambda: {"type": "object", "properties": {}})
    visible: bool = True
    timeout_seconds: float | None = 5
    required_context: tuple[str, ...] = ()
    persist: bool = True

    def __post_init__(self) -> None:
        p = self.parameters
        if p.get("type") != "object" or not isinstance(p.get("properties"), dict):
            raise ValueError("parameters must be an object schema with properties")
        required = p.get("required", [])
        if not isinstance(required, list) or not set(required) <= set(p["properties"]):
            raise ValueError("required names must be properties")


class Registry:
    """The last registration of a name wins. Column functions are called on columns, others become Spark functions."""

    def __init__(self) -> None:
        self._own: dict[str, Definition] = {}

    def register(self, definition: Definition) -> None:
        self._own[definition.name] = definition

    def get(self, name: str) -> Definition | None:
        return self._own.get(name)

    def __len__(self) -> int:
        return len(self._own)

    def derive(self, expose: set[str] = frozenset(), allow: set[str] | None = None, deny: set[str] = frozenset(), extra: list[Definition] = ()) -> Registry:
        """The tools that a request sees. extra: found at run time; they replace those of the same name, and then all are
        filtered alike: a hidden one must be exposed; a visible one must be allowed, if there is a list, and not denied."""
        out = Registry()
        for name, d in (self._own | {d.name: d for d in extra}).items():
            if (name not in deny and (allow is None or name in allow)) if d.visible else name in expose:
                out.register(d)
        return out

    def install(self, spark: SparkSession) -> None:
        """Make every function callable from SQL; table functions are classes with an eval method."""
        for name, d in self._own.items():
            if isinstance(d.function, type):
                from pyspark.sql.functions import udtf

                spark.udtf.register(name, udtf(d.function, returnType=d.returns))
            else:
                spark.udf.register(name, d.function, d.returns)
