"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths and mapped to canonical turns. Native expressions only.

``MAPPINGS`` declares, for each known layout, the paths it needs and how they become turns. A typed table is recognised once, by its schema; a column of
JSON records is recognised row by row. The fingerprint is the hash of the sorted paths; fields beyond those a mapping needs do not prevent a match
(the mapping that explains most paths is taken).

The template writes ``<s>`` and, for every turn, ``<|role|>\\n``, the text and ``</s>\\n``. In texts and roles a ``~`` follows every ``<`` and ``[``
(in roles also every ``|``), so no control string, of this template or of other common ones, can be read from a text, and removing these
characters restores it exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """``kind`` "rows": one row for each turn, (order, role, text) paths. "list": (array, role, text). "fields": (path, role) in order, where a leading
    ``?`` marks an optional path that is left out when empty and joined to the turn before by a blank line if it has the same role."""

    name: str
    kind: str
    paths: tuple[str, ...]
    roles: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.needs)

    @property
    def needs(self) -> list[str]:
        if self.kind == "list":
            return [self.paths[0], *(f"{self.paths[0]}[].{p}" for p in self.paths[1:])]
        return list(self.paths)


MAPPINGS = (
    Mapping("turn rows", "rows", ("turn", "role", "text")),
    Mapping("messages", "list", ("messages", "role", "content")),
    Mapping("conversations", "list", ("conversations", "from", "value")),
    Mapping("turns", "list", ("turns", "speaker", "text")),
    Mapping("instruction and input", "fields", ("instruction", "input", "output"), ("user", "user", "assistant"), ("input",)),
    Mapping("instruction", "fields", ("instruction", "output"), ("user", "assistant")),
    Mapping("system prompt", "fields", ("system", "prompt", "response"), ("system", "user", "assistant"), ("system",)),
    Mapping("prompt and response", "fields", ("prompt", "response"), ("user", "assistant")),
    Mapping("prompt and completion", "fields", ("prompt", "completion"), ("user", "assistant")),
    Mapping("question and answer", "fields", ("question", "answer"), ("user", "assistant")),
)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """All nested field paths; ``[]`` steps into an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in ([f"{at}.{f.name}".lstrip("."), *field_paths(f.dataType, f"{at}.{f.name}".lstrip("."))])]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return []


def choose(paths: list[str], mappings=MAPPINGS) -> Mapping:
    """The mapping with this fingerprint, or else the one that needs most of these paths."""
    exact = {m.fingerprint: m for m in mappings}
    if found := exact.get(fingerprint(paths)):
        return found
    fit = [m for m in mappings if set(m.needs) <= set(paths)]
    if not fit:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return max(fit, key=lambda m: len(m.needs))


def _turns(m: Mapping, get) -> Column:
    """Turns of a record as array<struct<role, text>>; ``get`` returns a field of it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.kind == "list":
        known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        return F.transform(get(m.paths[0]), lambda x: F.struct(
            F.coalesce(known[x[m.paths[1]]], x[m.paths[1]]).alias("role"), text(x[m.paths[2]]).alias("text")))
    parts: list[tuple[str, list[tuple[Column, bool]]]] = []
    for path, role in zip(m.paths, m.roles, strict=True):
        piece = (text(get(path)), path in m.optional)
        if parts and parts[-1][0] == role:
            parts[-1][1].append(piece)
        else:
            parts.append((role, [piece]))
    out = []
    for role, pieces in parts:
        body = F.array_join(F.filter(F.array(*[F.when(c != "", c) if opt else c for c, opt in pieces]), lambda x: x.isNotNull()), "\n\n")
        turn = F.struct(F.lit(role).alias("role"), body.alias("text"))
        out.append(F.when(body != "", turn) if all(opt for _, opt in pieces) else turn)
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _exploded(df: DataFrame, turns: Column) -> DataFrame:
    out = df.select("id", F.posexplode(turns).alias("place", "t"))
    return out.select("id", F.col("place").cast("long").alias("place"), "t.role", "t.text")


def canonical_turns(df: DataFrame, id_col: str, mappings=MAPPINGS) -> DataFrame:
    """Turns ``(id, place, role, text)`` of a typed table in any known layout. Unknown layouts raise; a record without turns gives no rows."""
    m = choose([p for p in field_paths(df.schema) if p != id_col], mappings)
    if m.kind == "rows":
        return df.select(F.col(id_col).alias("id"), F.col(m.paths[0]).cast("long").alias("place"), F.col(m.paths[1]).alias("role"), F.col(m.paths[2]).cast("string").alias("text"))
    return _exploded(df.select(F.col(id_col).alias("id"), *[F.col(p) for p in m.paths if m.kind == "fields" or p == m.paths[0]]), _turns(m, F.col))


def json_paths(record: Column, mappings=MAPPINGS) -> Column:
    """Sorted paths of a JSON record: its keys, and those of all elements of the arrays that mappings know."""
    lists = sorted({m.paths[0] for m in mappings if m.kind == "list"})
    none = F.array().cast("array<string>")

    def keys(c):
        elements = F.from_json(F.get_json_object(record, f"$.{c}"), "array<string>")
        return F.coalesce(F.flatten(F.transform(elements, lambda e: F.coalesce(F.json_object_keys(e), none))), none)

    nested = [_prefixed(keys(c), c) for c in lists]
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(F.json_object_keys(record), none), *nested)))


def _prefixed(keys: Column, name: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k))


def canonical_json(df: DataFrame, id_col: str, json_col: str, mappings=MAPPINGS) -> DataFrame:
    """Turns of a column of JSON records whose layout may change from row to row: ``(id, place, role, text)``.

    Each row's paths are hashed; the fingerprint picks the mapping, or else the mapping with most of its paths present. Null, broken and
    unknown records give no rows; ``unmatched_json`` returns them.
    """
    rows, turns = _recognised(df, id_col, json_col, mappings)
    return _exploded(rows, turns)


def unmatched_json(df: DataFrame, id_col: str, json_col: str, mappings=MAPPINGS) -> DataFrame:
    """``(id, record)`` of the records that ``canonical_json`` has no mapping for: null, broken and unknown ones."""
    rows, turns = _recognised(df, id_col, json_col, mappings)
    return rows.filter(turns.isNull()).select("id", "record")


def _recognised(df: DataFrame, id_col: str, json_col: str, mappings) -> tuple[DataFrame, Column]:
    """Records with their paths, and their turns: NULL for a record that no mapping fits."""
    rows = df.select(F.col(id_col).alias("id"), F.col(json_col).alias("record"), json_paths(F.col(json_col), mappings).alias("paths"))
    rows = rows.withColumn("print", F.sha2(F.array_join("paths", "\n"), 256))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    usable = [m for m in mappings if m.kind != "rows"]
    built = {}
    for m in usable:
        if m.kind == "list":
            shape = f"{m.paths[0]} array<struct<`{m.paths[1]}`:string,`{m.paths[2]}`:string>>"
            parsed = F.from_json("record", shape)
            built[m.name] = _turns(m, lambda p, parsed=parsed: parsed[p])
        else:
            built[m.name] = _turns(m, lambda p: F.get_json_object("record", f"$.{p}"))
    for m in sorted(usable, key=lambda m: len(m.needs)):
        present = F.size(F.array_except(F.array(*map(F.lit, m.needs)), "paths")) == 0
        turns = F.when(present, built[m.name]).otherwise(turns)
    for m in usable:
        turns = F.when(F.col("print") == m.fingerprint, built[m.name]).otherwise(turns)
    return rows, turns


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])", "$1~")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~", "$1")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([<\[|])", "$1~")


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([<\[|])~", "$1")


def render(turns: DataFrame) -> DataFrame:
    """``(id, formatted, loss)``: one text for each id, and the spans (start, end in code points) of assistant texts in it.

    Turns are ordered by place, then role, then text; null places come last, null roles and texts are empty, repeated turns stay, a null id is an id.
    Offsets are running sums over the sorted turns, so a conversation costs one sort whatever its length.
    """
    t = turns.select("id", F.coalesce("place", F.lit((1 << 63) - 1)).alias("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit("<|"), _escape_role(F.col("role")), F.lit("|>\n"))
    t = t.select("id", "place", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + 5
    order = Window.partitionBy("id").orderBy("place", "role", "text")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 3
    t = t.select("id", F.row_number().over(order).alias("n"), F.concat("head", "body", F.lit("</s>\n")).alias("piece"),
                 F.when(F.col("role") == "assistant", F.struct((before + F.length("head")).alias("start"), (before + F.length("head") + F.length("body")).alias("end"))).alias("span"))
    got = t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "span"))).alias("p"))
    return got.select("id", F.concat(F.lit("<s>"), F.array_join("p.piece", "")).alias("formatted"), F.filter("p.span", lambda s: s.isNotNull()).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted text as array<struct<role, text>>."""
    parts = F.filter(F.split(F.substring(formatted, 4, (1 << 31) - 1), "</s>\n"), lambda p: p != "")

    def turn(p):
        role = F.substring_index(p, "|>\n", 1)
        return F.struct(_unescape_role(F.substring(role, 3, (1 << 31) - 1)).alias("role"), unescape(F.substring(p, F.length(role) + 4, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
