"""Running registered tools on the executors, each call under its tool's time limit.

A batch of calls is worked off by lanes, which are child processes of the Python worker: a call that takes longer than its tool
may is ended with its lane, and a new lane takes its place. What a tool declares as its error becomes a result; any other
exception aborts the job. Results are in the order of the calls. As with any task, a call may run again if its
executor is lost, so tools must bear that.
"""

from __future__ import annotations

import datetime as dt
import json
import multiprocessing
import time
from collections.abc import Iterator
from multiprocessing.connection import wait

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.registry import Definition, Registry, ToolError

RESULTS = "message_id long, index int, id string, name string, output string, error string, detail string, retryable boolean, placeholder string, started_at timestamp, finished_at timestamp"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
_NOT_KEPT = "[output not kept]"
#: Calls that are Python objects at once; lanes are forked while they are, and each keeps a copy of what it then saw.
AT_A_TIME = 1024


def broken_rule(arguments: object, schema: dict) -> str | None:
    """The first rule of a parameter schema that the arguments break. A boolean is no number; unknown type names pass."""
    if not isinstance(arguments, dict):
        return "NOT_AN_OBJECT"
    for name in schema.get("required", []):
        if name not in arguments:
            return f"MISSING:{name}"
    known = schema["properties"]
    if schema.get("additionalProperties") is False and set(arguments) - set(known):
        return "UNKNOWN_ARGUMENT"
    for name, value in arguments.items():
        wanted = known.get(name, {}).get("type")
        kind = _TYPES.get(wanted)
        if kind and (not isinstance(value, kind) or (isinstance(value, bool) and wanted in ("integer", "number"))):
            return f"TYPE:{name}"
    return None


def preflight(tool: Definition | None, name: str, arguments: object, context: dict[str, str]) -> ToolError | None:
    if tool is None:
        return ToolError("Tool unavailable", name)
    if rule := broken_rule(arguments, tool.parameters):
        return ToolError("Tool preflight failed", rule)
    if missing := [k for k in tool.required_context if k not in context]:
        return ToolError("Tool preflight failed", f"CONTEXT:{missing[0]}")
    return None


def _serve(pipe, scope: Registry) -> None:
    """A lane: takes (name, context, arguments) and answers ("output", text), ("error", …) or ("broken", …) until it is ended."""
    while True:
        try:
            name, context, arguments = pipe.recv()
        except EOFError:
            return
        try:
            output = scope.get(name).function(context, **arguments)
            pipe.send(("output", output if isinstance(output, str) else json.dumps(output, ensure_ascii=False)))
        except ToolError as e:
            pipe.send(("error", (e.reason, e.detail, e.retryable)))
        except Exception as e:  # told to the parent, which aborts
            pipe.send(("broken", f"{type(e).__name__}: {e}"))


class _Lane:
    def __init__(self, scope: Registry):
        own = multiprocessing.get_context("fork")
        self.pipe, theirs = own.Pipe()
        self.process = own.Process(target=_serve, args=(theirs, scope), daemon=True)
        self.process.start()
        theirs.close()
        self.call: int | None = None
        self.due: float | None = None

    def begin(self, call: int, message: tuple, seconds: float | None) -> None:
        self.call, self.due = call, None if seconds is None else time.monotonic() + seconds
        self.pipe.send(message)

    def end(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()


class Lanes:
    """At most so many calls at once."""

    def __init__(self, scope: Registry, at_once: int):
        self.scope, self.at_once = scope, at_once
        self.free: list[_Lane] = []

    def run(self, calls: list[tuple[str, dict, object]]) -> list[tuple]:
        """(output, error, started, finished) of each (name, context, arguments), in their order."""
        results: list[tuple] = [()] * len(calls)
        started: dict[int, dt.datetime] = {}
        waiting, busy = list(range(len(calls)))[::-1], {}
        now = lambda: dt.datetime.now(dt.timezone.utc)
        try:
            while waiting or busy:
                while waiting and len(busy) < self.at_once:
                    i = waiting.pop()
                    name, context, arguments = calls[i]
                    started[i], tool = now(), self.scope.get(name)
                    if error := preflight(tool, name, arguments, context):
                        results[i] = (None, error, started[i], now())
                        continue
                    lane = self.free.pop() if self.free else _Lane(self.scope)
                    lane.begin(i, (name, context, arguments), tool.timeout_seconds)
                    busy[lane.pipe] = lane
                if not busy:
                    continue
                dues = [x.due for x in busy.values() if x.due is not None]
                for pipe in wait(list(busy), max(0.0, min(dues) - time.monotonic()) if dues else None):
                    lane = busy.pop(pipe)
                    try:
                        kind, value = pipe.recv()
                    except EOFError:
                        kind, value = "broken", "its process ended"
                    if kind == "broken":
                        lane.end()
                        raise RuntimeError(f"tool {calls[lane.call][0]}: {value}")
                    results[lane.call] = (value if kind == "output" else None, None if kind == "output" else ToolError(*value), started[lane.call], now())
                    self.free.append(lane)
                for pipe, lane in list(busy.items()):
                    if lane.due is not None and time.monotonic() >= lane.due and not pipe.poll():
                        del busy[pipe]
                        lane.end()
                        results[lane.call] = (None, ToolError("Timeout", calls[lane.call][0]), started[lane.call], now())
        finally:
            for lane in busy.values():
                lane.end()
        return results

    def close(self) -> None:
        for lane in self.free:
            lane.end()
        self.free = []


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_A_TIME):
            yield batch.slice(at, AT_A_TIME)


def dispatch(calls: DataFrame, scope: Registry, at_once: int = 8) -> DataFrame:
    """RESULTS of calls (message_id, index, id, name, arguments: JSON, context: map of strings), in the calls' order within a partition.

    A tool whose output isn't kept has a placeholder, which is what a stored message shows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = Lanes(scope, at_once)
        try:
            for batch in slices(batches):
                rows = batch.to_pylist()
                found = lanes.run([(r["name"], dict(r["context"] or []), _parsed(r["arguments"])) for r in rows])
                out = []
                for r, (output, error, begun, done) in zip(rows, found, strict=True):
                    tool = scope.get(r["name"])
                    out.append({**{c: r[c] for c in ("message_id", "index", "id", "name")}, "output": output, "error": error and error.reason, "detail": error and error.detail, "retryable": error and error.retryable, "placeholder": None if tool is None or tool.persist else _NOT_KEPT, "started_at": begun, "finished_at": done})
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        finally:
            lanes.close()

    return calls.select("message_id", "index", "id", "name", "arguments", "context").mapInArrow(run, RESULTS)


_TIME = pa.timestamp("us", "UTC")
_SCHEMA = pa.schema([("message_id", pa.int64()), ("index", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("output", pa.string()), ("error", pa.string()), ("detail", pa.string()), ("retryable", pa.bool_()), ("placeholder", pa.string()), ("started_at", _TIME), ("finished_at", _TIME)])


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text or "")
    except ValueError:
        return None
