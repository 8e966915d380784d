"""Canonical turns from records of many layouts, chosen by schema fingerprints.

A layout says declaratively where a record keeps its turns: in fields with a
role each, in a list of messages, in a list of alternating texts, or one turn
to a record. A record's fingerprint is the hash of the sorted nested field
paths it has, of those that any layout knows (``messages[].role``); a table
from fingerprints to layouts, with every allowed choice of optional paths,
gives its layout in one look-up. A typed frame has one fingerprint, its
schema's, and is mapped with column expressions; JSON records have one each.

Defined results: fields that no layout knows are ignored; an absent or null
optional field gives no turn, a null text within a list an empty one; a record
that isn't JSON or whose paths fit no layout keeps one row, with null layout,
turn, role and text; repeated records are mapped again; an empty frame gives
no rows; a frame that fits no layout is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import ready_for_python
from .shingles import tidy

#: Names that some layouts give to roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``fields``: (role, path) in order; or ``each``: path of a list, with ``role`` and ``texts`` (the first that is there) within; or ``row``: columns of one turn."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    texts: tuple[str, ...] = ()
    row: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        inner = [self.role, *self.texts] if self.role else []
        items = {f"{self.each}[].{p}" for p in inner} or ({f"{self.each}[]"} if self.each else set())
        return {p for _, p in self.fields} | items | set(self.row)

    def choices(self) -> Iterator[set[str]]:
        """Every set of paths that a record of this layout may have."""
        paths = self.paths()
        for k in range(len(self.optional) + 1):
            for left_out in combinations(self.optional, k):
                yield paths - set(left_out)


LAYOUTS = (
    Layout("turn rows", row=("conv_id", "turn", "role", "text")),
    Layout("messages", each="messages", role="role", texts=("content",), roles=ROLES),
    Layout("message parts", each="messages", role="role", texts=("content", "content[].text"), optional=("messages[].content",), roles=ROLES),
    Layout("from and value", fields=(("system", "system"),), each="conversations", role="from", texts=("value",), optional=("system",), roles=ROLES),
    Layout("nested messages", each="data.turns", role="author.role", texts=("body.text",), roles=ROLES),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("prompt and completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("preference", fields=(("user", "prompt"), ("assistant", "chosen"))),
    Layout("alternating", each="dialog"),
)
ALTERNATING = ("user", "assistant")


def fingerprint(paths: Iterable[str]) -> int:
    """Hash of a set of paths."""
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(set(paths))).encode(), digest_size=8).digest(), "little", signed=True)


@dataclass(frozen=True)
class Registry:
    """Layouts by fingerprint, and the paths that count."""

    layouts: dict[int, Layout]
    known: frozenset[str]

    @staticmethod
    def of(layouts: Iterable[Layout] = LAYOUTS) -> Registry:
        table: dict[int, Layout] = {}
        layouts = tuple(layouts)
        for layout in layouts:
            for paths in layout.choices():
                table.setdefault(fingerprint(paths), layout)
        return Registry(table, frozenset(p for x in layouts for p in x.paths()))

    def find(self, paths: Iterable[str]) -> Layout | None:
        return self.layouts.get(fingerprint(self.known & set(paths)))


def value_paths(value: object) -> set[str]:
    """Paths of all leaves and of lists' plain items."""
    found, left = set(), [("", value)]
    while left:
        path, v = left.pop()
        if isinstance(v, dict):
            left += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
        elif isinstance(v, list):
            left += [(f"{path}[]", x) for x in v]
        else:
            found.add(path)
    return found


def schema_paths(kind: T.DataType, path: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{path}.{f.name}" if path else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{path}[]")
    return {path}


def _at(value: object, path: str) -> object:
    """The value at a path; lists on the way give the list of what their items have."""
    for step in path.split(".") if path else []:
        name, many = step.removesuffix("[]"), step.endswith("[]")
        value = value.get(name) if isinstance(value, dict) else None
        if many:
            rest = path.partition(f"{step}.")[2]
            return [_at(x, rest) for x in value] if isinstance(value, list) else None
    return value


def _text(value: object) -> str:
    if isinstance(value, list):
        return "".join(_text(x) for x in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def turns_of(value: object, layout: Layout) -> list[tuple[str | None, str]]:
    """The (role, text) turns of one parsed record."""
    out = [(role, _text(v)) for role, path in layout.fields if (v := _at(value, path)) is not None]
    if layout.row:
        return [(_at(value, layout.row[2]), _text(_at(value, layout.row[3])))]
    items = _at(value, layout.each) if layout.each else []
    for i, x in enumerate(items if isinstance(items, list) else []):
        if layout.role:
            role = _text(_at(x, layout.role))
            text = next((v for p in layout.texts if (v := _at(x, p)) is not None and not (p == "content" and isinstance(v, list))), None)
            out.append((layout.roles.get(role, role), _text(text)))
        else:
            out.append((ALTERNATING[i % 2], _text(x)))
    return out


def turns_of_json(records: DataFrame, key: str, record: str, registry: Registry | None = None) -> DataFrame:
    """conv_id (``key``), turn, role, text, layout of all JSON ``record``s, a row for each turn."""
    ready_for_python(records.sparkSession)
    known = registry or Registry.of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    value = json.loads(raw or "")
                except (ValueError, RecursionError):
                    value = None
                layout = known.find(value_paths(value))
                if layout is None:
                    out.append((conv, None, None, None, None))
                    continue
                out += [(conv, i, role, text, layout.name) for i, (role, text) in enumerate(turns_of(value, layout))]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "role", "text", "layout"])

    rows = records.select(F.col(key).cast("bigint"), F.col(record).cast("string"))
    return rows.mapInArrow(tidy(run), "conv_id bigint, turn bigint, role string, text string, layout string")


def turns_of_frame(frame: DataFrame, key: str = "conv_id", registry: Registry | None = None) -> DataFrame:
    """conv_id, turn, role, text, layout of a typed frame, by column expressions."""
    layout = (registry or Registry.of()).find(schema_paths(frame.schema))
    if layout is None:
        raise ValueError(f"no layout has the fields of {frame.schema.simpleString()}")
    name, conv = F.lit(layout.name).alias("layout"), F.col(key).cast("bigint").alias("conv_id")
    if layout.row:
        _, turn, role, text = layout.row
        return frame.select(conv, F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), name)
    paths = schema_paths(frame.schema)
    fixed = F.filter(F.array(*(F.struct(F.lit(r).alias("role"), F.col(p).cast("string").alias("text")) for r, p in layout.fields if p in paths)), lambda t: t["text"].isNotNull()) if any(p in paths for _, p in layout.fields) else None
    listed = F.transform(F.col(layout.each), lambda x, i: _message(x, i, layout, paths)) if layout.each else None
    turns = F.concat(*(F.coalesce(t, F.array().cast("array<struct<role: string, text: string>>")) for t in (fixed, listed) if t is not None))
    return frame.select(conv, F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text", name)


def _message(x: Column, i: Column, layout: Layout, paths: set[str]) -> Column:
    def inner(path: str) -> Column:
        out = x
        for step in path.split("."):
            out = out[step.removesuffix("[]")] if not step.endswith("[]") else F.array_join(F.transform(out[step.removesuffix("[]")], lambda y: y[path.partition("[].")[2]]), "")
            if step.endswith("[]"):
                break
        return out

    if not layout.role:
        return F.struct(F.when(i % 2 == 0, ALTERNATING[0]).otherwise(ALTERNATING[1]).alias("role"), F.coalesce(x, F.lit("")).alias("text"))
    role = F.coalesce(inner(layout.role), F.lit(""))
    for given, own in layout.roles.items():
        role = F.when(role == given, own).otherwise(role)
    texts = [inner(p) for p in layout.texts if f"{layout.each}[].{p}" in paths]
    return F.struct(role.alias("role"), F.coalesce(*texts, F.lit("")).alias("text"))
