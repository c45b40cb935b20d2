"""What users plug in: models behind typed callables, with deterministic stand-ins.

A hook is a picklable factory: it's called once a partition and gives a function from one row (a dict) to a result. Errors of the
result are values, caught row by row, so that a retried task repeats no finished work of other partitions; programming
errors (TypeError, AttributeError, NameError, KeyError) always propagate.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PROGRAMMING = (TypeError, AttributeError, NameError, KeyError)


class ToolCallMissing(RuntimeError):
    """A model answered without the structured call it was asked for; may be tried again."""


def mapped(df: DataFrame, factory: Callable[[], Callable[[dict], object]], result: T.DataType, empties: int = 0, parallel: int | None = None, tries: int = 1) -> DataFrame:
    """df with result, error (type and text, null if none) and attempts.

    An empty result (None or []) is asked for again up to `empties` times. An exception is a row's error; only with `tries` over 1 are
    passing ones tried again so often, never ValueErrors, which the same question brings again. `parallel` caps the number of
    tasks, hence of simultaneous calls.
    """
    names = df.columns

    def asked(call, row):
        out, error, n, left = None, None, 0, tries
        while n <= empties + tries - left:
            n += 1
            try:
                out, error = call(row), None
            except PROGRAMMING:
                raise
            except Exception as e:  # noqa: BLE001 -- failures of a model become rows
                error = f"{type(e).__name__}: {e}"
                left -= 1
                if isinstance(e, ValueError) or not left:
                    break
                continue
            if out is not None and out != []:
                break
        return out, error, n

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for part in parts:
            got = [asked(call, row) for row in part.to_dict("records")]
            yield part.assign(result=[g[0] for g in got], error=[g[1] for g in got], attempts=pd.Series([g[2] for g in got], index=part.index, dtype="int32"))

    schema = T.StructType([*df.schema.fields, T.StructField("result", result), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    d = df.repartition(parallel) if parallel else df
    return d.mapInPandas(run, schema).select(*names, "result", "error", "attempts")


def ceiling(cores: int) -> int:
    """Most calls that wait at once in one process's pool of threads."""
    return min(32, cores + 4)


def counting(factory, calls):
    """The hook with its calls counted in a Spark accumulator. Calls of a task that is run again count again, as they were made."""

    def make():
        call = factory()

        def counted(row):
            calls.add(1)
            return call(row)

        return counted

    return make


def prompt(title: str, fields: dict[str, str], row: dict) -> str:
    """A question: the task, then the named fields of the row, a paragraph each; missing ones are left out, lists are bulleted."""
    out = [title]
    for name, label in fields.items():
        value = row.get(name)
        if value is None or isinstance(value, str) and not value.strip():
            continue
        listed = not isinstance(value, str) and hasattr(value, "__iter__")
        out.append(f"{label}:\n" + "\n".join(f"- {v}" for v in value) if listed else f"{label}: {value}")
    return "\n\n".join(out)


def structured(connect: Callable[[], Callable[[str, dict], dict | None]], ask: Callable[[dict], str], result: T.StructType) -> Callable[[], Callable[[dict], dict]]:
    """A hook over a model that answers by a forced call: connect gives, once a partition, a client (question, JSON Schema) -> arguments.

    Arguments are checked again here: none at all is a ToolCallMissing, unknown or missing keys and wrong types a ValueError.
    """
    from kgraph.schema import json_schema

    def make():
        client, shape = connect(), json_schema(result)

        def call(row):
            got = client(ask(row), shape)
            if got is None:
                raise ToolCallMissing("no structured answer")
            check(got, result, "answer")
            return got

        return call

    return make


_KINDS = {"string": str, "int": int, "bigint": int, "double": (int, float), "boolean": bool}


def check(value, kind: T.DataType, at: str) -> None:
    """ValueError unless a plain value has the declared type: every key of a struct and no other; null only for scalars."""
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict) or set(value) != {f.name for f in kind}:
            raise ValueError(f"{at}: not the declared keys")
        for f in kind:
            check(value[f.name], f.dataType, f"{at}.{f.name}")
    elif isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"{at}: not a list")
        for i, v in enumerate(value):
            check(v, kind.elementType, f"{at}[{i}]")
    elif value is not None and (not isinstance(value, _KINDS[kind.simpleString()]) or isinstance(value, bool) and kind.simpleString() != "boolean"):
        raise ValueError(f"{at}: not a {kind.simpleString()}")


def always(value) -> Callable[[], Callable[[dict], object]]:
    """A stand-in that gives the same answer for every row."""
    return lambda: lambda row: value


@dataclass
class Fault:
    """Fail the calls from number `start` (1 is the first), `times` of them."""

    start: int
    times: int = 1
    error: type[Exception] = RuntimeError

    def __post_init__(self):
        if self.start < 1 or self.times < 1:
            raise ValueError("start and times count from 1")


def with_fault(factory, fault: Fault):
    """The hook with a fault in each partition's calls; the count is kept by the partition's own function."""

    def make():
        call, lock, n = factory(), threading.Lock(), [0]

        def faulty(row):
            with lock:
                n[0] += 1
                k = n[0]
            if fault.start <= k < fault.start + fault.times:
                raise fault.error(f"injected at call {k}")
            return call(row)

        return faulty

    return make
