"""Job documents: strict loading, field rules and graph rules, with every finding under its path."""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass, field

API_VERSION = "tidewheel/v1"
TYPES = ("source", "map", "key_by", "reduce", "sink")
PARTITIONINGS = ("forward", "rebalance", "hash")
UDF_TYPES = {"map": True, "key_by": True, "reduce": True, "source": False, "sink": False}
DEFAULT_WINDOW_MS = 300_000
MAX_PARALLELISM = 1024
_ID = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,62}")
_DURATION = re.compile(r"([1-9][0-9]*)(ms|s|m|h)")
_UDF = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*:[A-Za-z_]\w*")
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


class SpecError(ValueError):
    """All findings of a job document, as (path, message)."""

    def __init__(self, findings: list[tuple[str, str]]):
        self.findings = findings
        super().__init__("; ".join(f"{p}: {m}" if p else m for p, m in findings))


def duration_ms(text: str) -> int:
    m = _DURATION.fullmatch(text) if isinstance(text, str) else None
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * UNIT_MS[m[2]]


@dataclass(frozen=True)
class Operator:
    id: str
    type: str
    parallelism: int = 1
    udf: str | None = None
    window_ms: int | None = None
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    partitioning: str


@dataclass(frozen=True)
class Job:
    name: str
    operators: tuple[Operator, ...]
    edges: tuple[Edge, ...]
    order: tuple[str, ...]
    keyed: dict[str, bool]

    def __getitem__(self, op_id: str) -> Operator:
        return next(o for o in self.operators if o.id == op_id)

    def inputs(self, op_id: str) -> list[str]:
        return [e.source for e in self.edges if e.target == op_id]


def _unique(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise SpecError([("", f"duplicate key {k!r}")])
        out[k] = v
    return out


def load(text: str) -> Job:
    """A job from YAML (where a YAML library is installed) or JSON text; duplicate keys are errors."""
    try:
        import yaml
    except ImportError:
        try:
            return build(json.loads(text, object_pairs_hook=_unique))
        except json.JSONDecodeError as e:
            raise SpecError([("", f"line {e.lineno}, column {e.colno}: {e.msg}")]) from e

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        return _unique((loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value)

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        return build(yaml.load(text, Loader))  # noqa: S506  a SafeLoader
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise SpecError([("", f"line {mark.line + 1}, column {mark.column + 1}: {e.problem}" if mark else str(e))]) from e


def build(document) -> Job:
    """Validate a document and order its graph."""
    bad: list[tuple[str, str]] = []
    if not isinstance(document, dict):
        raise SpecError([("", "the document must be a mapping")])
    for k in document.keys() - {"api_version", "name", "operators", "edges"}:
        bad.append((str(k), "unknown field"))
    if document.get("api_version") != API_VERSION:
        bad.append(("api_version", f"must be {API_VERSION}"))
    if not _ID.fullmatch(str(document.get("name", ""))):
        bad.append(("name", "not a valid identifier"))
    ops = [_operator(o, f"operators[{i}]", bad) for i, o in enumerate(_listed(document, "operators", bad))]
    links = [_edge(e, f"edges[{i}]", bad) for i, e in enumerate(_listed(document, "edges", bad))]
    if bad:
        raise SpecError(bad)
    return _graph(document["name"], ops, links)


def _listed(document, key, bad) -> list:
    value = document.get(key)
    if not isinstance(value, list) or not value:
        bad.append((key, "must be a list with at least one entry"))
        return []
    return value


def _operator(raw, path, bad) -> Operator | None:
    if not isinstance(raw, dict):
        bad.append((path, "must be a mapping"))
        return None
    for k in raw.keys() - {"id", "type", "parallelism", "udf", "window", "config"}:
        bad.append((f"{path}.{k}", "unknown field"))
    kind, udf, window, n = raw.get("type"), raw.get("udf"), raw.get("window"), raw.get("parallelism", 1)
    if not isinstance(raw.get("id"), str) or not _ID.fullmatch(raw["id"]):
        bad.append((f"{path}.id", "not a valid identifier"))
    if kind not in TYPES:
        bad.append((f"{path}.type", f"must be one of {', '.join(TYPES)}"))
    if type(n) is not int or not 1 <= n <= MAX_PARALLELISM:
        bad.append((f"{path}.parallelism", f"must be an integer from 1 to {MAX_PARALLELISM}"))
    if kind in TYPES and UDF_TYPES[kind] != (udf is not None):
        bad.append((f"{path}.udf", "is required" if UDF_TYPES[kind] else f"is not allowed for {kind}"))
    elif udf is not None and not (isinstance(udf, str) and _UDF.fullmatch(udf)):
        bad.append((f"{path}.udf", "must be module:function"))
    size = None
    if kind == "reduce":
        if not isinstance(window, dict) or window.keys() - {"type", "size"} or window.get("type", "tumbling") != "tumbling":
            bad.append((f"{path}.window", "must be a tumbling window"))
        else:
            try:
                size = duration_ms(window["size"]) if "size" in window else DEFAULT_WINDOW_MS
            except ValueError as e:
                bad.append((f"{path}.window.size", str(e)))
    elif window is not None:
        bad.append((f"{path}.window", f"is not allowed for {kind}"))
    if kind in ("source", "sink") and not isinstance(raw.get("config"), dict):
        bad.append((f"{path}.config", "is required"))
    elif kind not in ("source", "sink") and raw.get("config"):
        bad.append((f"{path}.config", f"is not allowed for {kind}"))
    elif kind in ("source", "sink"):
        _config(kind, raw["config"], f"{path}.config", bad)
    return Operator(raw.get("id"), kind, n, udf, size, raw.get("config") or {})


_TEXT = lambda most: lambda v: isinstance(v, str) and 0 < len(v) <= most
#: Per connector the fields that it may have: whether a field is required, its test, and what the test asks for.
CONNECTORS = {
    "source": {
        "kafka": {"topic": (True, _TEXT(249), "1 to 249 characters"), "value_format": (False, lambda v: v == "json", "json"), "bootstrap_servers": (False, _TEXT(4096), "text"), "group_id": (False, _TEXT(255), "1 to 255 characters")},
        "table": {"topic": (True, _TEXT(249), "1 to 249 characters"), "path": (True, _TEXT(4096), "text")},
    },
    "sink": {"file": {"format": (False, lambda v: v == "csv", "csv"), "output_path": (False, _TEXT(4096), "text")}},
}
_OF_SOURCES = {"bad_record_policy": (False, lambda v: v in ("fail", "skip"), "fail or skip"), "validator": (False, lambda v: isinstance(v, str) and bool(_UDF.fullmatch(v)), "module:function")}
#: What a field is where a job leaves it out.
DEFAULTS = {"bootstrap_servers": "kafka:9092", "output_path": "/data/output"}


def _config(kind, config, path, bad) -> None:
    fields = CONNECTORS[kind].get(config.get("connector"))
    if fields is None:
        bad.append((f"{path}.connector", f"must be one of {', '.join(CONNECTORS[kind])}"))
        return
    fields = fields | (_OF_SOURCES if kind == "source" else {})
    for k in config.keys() - fields.keys() - {"connector"}:
        bad.append((f"{path}.{k}", "unknown field"))
    for k, (required, test, asked) in fields.items():
        if config.get(k) is None:
            if required:
                bad.append((f"{path}.{k}", "is required"))
        elif not test(config[k]):
            bad.append((f"{path}.{k}", f"must be {asked}"))


def _edge(raw, path, bad) -> tuple | None:
    if not isinstance(raw, dict) or not {"from", "to"} <= raw.keys() or raw.keys() - {"from", "to"}:
        bad.append((path, "must have from and to only"))
        return None
    return path, raw["from"], raw["to"]


def _graph(name, ops, links) -> Job:
    bad: list[tuple[str, str]] = []
    place = {}
    for i, o in enumerate(ops):
        if o.id in place:
            bad.append((f"operators[{i}].id", f"duplicate id {o.id}"))
        place.setdefault(o.id, i)
    seen = set()
    ins: dict[str, list[str]] = {o.id: [] for o in ops}
    outs: dict[str, list[str]] = {o.id: [] for o in ops}
    for path, a, b in links:
        unknown = [x for x in (a, b) if x not in place]
        for x in unknown:
            bad.append((path, f"unknown operator {x}"))
        if unknown:
            continue
        if a == b:
            bad.append((path, "an operator can't feed itself"))
        elif (a, b) in seen:
            bad.append((path, "duplicate edge"))
        else:
            outs[a].append(b)
            ins[b].append(a)
        seen.add((a, b))
    for o in ops:
        at = f"operators[{place[o.id]}]"
        if o.type == "source" and ins[o.id]:
            bad.append((at, "a source has no inputs"))
        if o.type == "sink" and outs[o.id]:
            bad.append((at, "a sink has no outputs"))
        if o.type != "source" and not ins[o.id]:
            bad.append((at, "needs an input"))
        if o.type != "sink" and not outs[o.id]:
            bad.append((at, "needs an output"))
    for kind in ("source", "sink"):
        if not any(o.type == kind for o in ops):
            bad.append(("operators", f"needs a {kind}"))
    if bad:
        raise SpecError(bad)
    waiting, ready, order = {o: len(v) for o, v in ins.items()}, [], []
    for o, n in waiting.items():
        if not n:
            heapq.heappush(ready, place[o])
    while ready:
        o = ops[heapq.heappop(ready)].id
        order.append(o)
        for t in outs[o]:
            waiting[t] -= 1
            if not waiting[t]:
                heapq.heappush(ready, place[t])
    if len(order) < len(ops):
        raise SpecError([("edges", "the graph has a cycle")])
    keyed = {}
    for o in order:
        op = ops[place[o]]
        keyed[o] = op.type == "key_by" or (op.type != "source" and all(keyed[i] for i in ins[o]))
        if op.type == "reduce" and not all(keyed[i] for i in ins[o]):
            raise SpecError([(f"operators[{place[o]}]", "reduce needs keyed input")])
    strategy = lambda a, b: "hash" if keyed[a] else "forward" if ops[place[a]].parallelism == ops[place[b]].parallelism else "rebalance"
    return Job(name, tuple(ops), tuple(Edge(a, b, strategy(a, b)) for _, a, b in links), tuple(order), keyed)
