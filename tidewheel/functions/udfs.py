"""User functions: module:function references, arity and strict-JSON contracts, and their column forms."""

from __future__ import annotations

import importlib
import inspect
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import canonical_json

ARITY = {"map": 1, "key_selector": 1, "reduce": 2, "validator": 1}


class ContractError(ValueError):
    """A user function breaks its contract."""


def resolve(reference: str, kind: str) -> Callable:
    module, _, name = reference.partition(":")
    if not module or not name:
        raise ContractError(f"{reference!r} is not module:function")
    return checked(getattr(importlib.import_module(module), name), kind)


def checked(fn: Callable, kind: str) -> Callable:
    """fn, if it is a plain function that takes the kind's number of positional arguments."""
    if not callable(fn) or inspect.iscoroutinefunction(fn) or inspect.isasyncgenfunction(fn):
        raise ContractError(f"{kind} must be a synchronous function")
    try:
        inspect.signature(fn).bind(*[None] * ARITY[kind])
    except TypeError as e:
        raise ContractError(f"{kind} takes {ARITY[kind]} positional arguments: {e}") from e
    return fn


def strict(value) -> str:
    try:
        return canonical_json(value)
    except (TypeError, ValueError) as e:
        raise ContractError(f"result is not strict JSON: {e}") from e


def map_json(fn: Callable, payload: Column) -> Column:
    """Map JSON text to JSON text; None drops the record later. Called once per record, so it counts as nondeterministic."""
    fn = checked(fn, "map")

    def run(text):
        out = None if text is None else fn(json.loads(text))
        return None if out is None else strict(out)

    return F.udf(run, T.StringType(), useArrow=True).asNondeterministic()(payload)


def key_json(fn: Callable, payload: Column) -> Column:
    """Canonical key token; None is an error."""
    fn = checked(fn, "key_selector")

    def run(text):
        key = fn(json.loads(text))
        if key is None:
            raise ContractError("key selector returned None")
        return strict(key)

    return F.udf(run, T.StringType(), useArrow=True).asNondeterministic()(payload)


def fold_json(fn: Callable, payloads: list[str]) -> str:
    """First payload unchanged, then fn(acc, next) in order, on fresh values each time."""
    fn, acc = checked(fn, "reduce"), payloads[0]
    for p in payloads[1:]:
        acc = strict(fn(json.loads(acc), json.loads(p)))
    return acc
