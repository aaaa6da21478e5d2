"""Operator 8: chat formatting by schema fingerprints, with DataFrame functions only.

The nested field paths that a row fills are hashed; the hash selects a declarative mapping that turns the layout
(one row per turn, an array of messages, prompt and response, instruction and output) into canonical turns. A table may hold
rows of several layouts.
Turns are then rendered by a template that escapes control strings reversibly, with a loss mask.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings, as an opener and what follows it. No rest holds an opener or a backslash, so matches
#: never overlap, and one backslash behind the opener makes each harmless.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[TEXT]", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_RESTS = "|".join("\\Q" + c[1:] + "\\E" for c in CONTROLS)
_RAW = rf"([<\[])(\\*)({_RESTS})"
_ESCAPED = rf"([<\[])\\(\\*)({_RESTS})"
BEGIN, TURN, TEXT, END = "<s>", "[TURN]", "[TEXT]", "</s>"


def field_paths(schema: T.StructType) -> list[str]:
    """Sorted paths of the leaves; an array adds ``[]``. Types don't count, so integer and string ids match alike."""

    def walk(kind: T.DataType, path: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{path}.{f.name.lower()}" if path else f.name.lower())]
        return walk(kind.elementType, f"{path}[]") if isinstance(kind, T.ArrayType) else [path]

    return sorted(walk(schema, ""))


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """paths: what the layout needs; turns: SQL for an array of (turn, role, text), or None if a row is a turn."""

    name: str
    paths: tuple[str, ...]
    key: str
    turns: str | None = None
    fields: tuple[str, str, str] = ("turn", "role", "text")


def _pair(*parts: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"struct(bigint({i}) AS turn, '{role}' AS role, string({sql}) AS text)" for i, (role, sql) in enumerate(parts)) + ")"


def _messages(field: str, role: str, text: str) -> str:
    return f"transform({field}, (m, i) -> struct(bigint(i) AS turn, string(m.{role}) AS role, string(m.{text}) AS text))"


LAYOUTS = [
    Layout("turn rows", ("conv_id", "role", "text", "turn"), "conv_id"),
    Layout("messages", ("id", "messages[].content", "messages[].role"), "id", _messages("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value", "id"), "id", _messages("conversations", "from", "value")),
    Layout("prompt and response", ("id", "prompt", "response"), "id", _pair(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", ("completion", "id", "prompt"), "id", _pair(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("id", "input", "instruction", "output"), "id", _pair(("user", "concat_ws('\n', instruction, nullif(input, ''))"), ("assistant", "output"))),
    Layout("system, instruction", ("id", "instruction", "output", "system"), "id", _pair(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("system, instruction, input", ("id", "input", "instruction", "output", "system"), "id", _pair(("system", "system"), ("user", "concat_ws('\n', instruction, nullif(input, ''))"), ("assistant", "output"))),
]
REGISTRY = {fingerprint(list(x.paths)): x for x in LAYOUTS}
#: Names that data sets give to the same roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def layout_of(schema: T.StructType, registry: dict[str, Layout] = REGISTRY) -> Layout:
    """The mapping whose fingerprint the schema has; extra columns are left out one layout at a time."""
    paths = field_paths(schema)
    if found := registry.get(fingerprint(paths)):
        return found
    fits = [x for x in registry.values() if set(x.paths) <= set(paths)]
    if not fits:
        raise ValueError(f"no mapping for the field paths {paths}")
    return max(fits, key=lambda x: (len(x.paths), x.name))


def routed(df: DataFrame, registry: dict[str, Layout] = REGISTRY) -> DataFrame:
    """df with _fingerprint (of the field paths that a row fills), _layout (the name of its mapping) and _status.

    Only paths that some mapping knows count, keys aside; an array counts as filled unless it is null. The mapping whose
    fingerprint a row has is its own; else the largest one that it fills; else the one that it fills most of. Status
    "mapped"; "several" if the row fills fields that its mapping leaves out; "unknown" (and no layout) if it fills
    none, but another column. A row that fills nothing has the layout of its table. Rows of turns are always turns,
    unless they fill another layout and no turn.
    """
    schema = set(field_paths(df.schema))
    frame = layout_of(df.schema, registry)
    fits = [x for x in registry.values() if set(x.paths) <= schema]
    keys = {x.key for x in fits}
    content = sorted({p for x in fits for p in x.paths} - keys)
    filled = {p: F.col(p.split("[]")[0]).isNotNull() for p in content}
    present = F.filter(F.array(*[F.when(filled[p], F.lit(p)) for p in content]), lambda p: p.isNotNull())
    own = {fingerprint([p for p in x.paths if p != x.key]): x for x in fits}
    others = [f"`{c}`" for c in df.columns if c.lower() not in {p.split("[]")[0].split(".")[0] for p in content} | keys]
    rank = []
    for x in fits:
        mine = [p for p in x.paths if p != x.key]
        n = sum((filled[p].cast("int") for p in mine), F.lit(0))
        whole = (n == len(mine)).cast("int")
        rank.append(F.when(n > 0, F.struct(whole.alias("whole"), n.alias("n"), F.when(whole == 1, len(mine)).otherwise(-len(mine)).alias("size"), F.lit(x.name).alias("name"))))
    best = F.array_max(F.array(*rank))["name"]
    exact = F.create_map(*[F.lit(x) for print_, layout in own.items() for x in (print_, layout.name)])
    unknown = F.exists(F.array(F.lit(False), *[F.col(c).isNotNull() for c in others]), lambda x: x)
    rest = F.lit(frame.name) if frame.turns is None else F.when(~unknown, frame.name)
    out = df.withColumn("_filled", present).withColumn("_fingerprint", F.substring(F.sha2(F.array_join("_filled", "\n").cast("binary"), 256), 1, 16))
    out = out.withColumn("_layout", F.coalesce(F.try_element_at(exact, F.col("_fingerprint")), best, rest))
    known = F.create_map(*[y for x in fits for y in (F.lit(x.name), F.array(*[F.lit(p) for p in x.paths]))])
    more = F.size(F.array_except("_filled", F.try_element_at(known, F.col("_layout")))) > 0
    return out.withColumn("_status", F.when(F.col("_layout").isNull(), "unknown").when(more, "several").otherwise("mapped")).drop("_filled")


def unmapped(df: DataFrame, registry: dict[str, Layout] = REGISTRY) -> DataFrame:
    """_fingerprint and row (JSON) of the rows that no mapping reads: ``canonical_turns`` has no turns of them."""
    return routed(df, registry).where("_status = 'unknown'").select("_fingerprint", F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))


def canonical_turns(df: DataFrame, registry: dict[str, Layout] = REGISTRY) -> DataFrame:
    """conv_id, turn, role, text of rows of any known layouts; null role and text become empty, known aliases one role name.

    Each row goes by its own layout (``routed``); rows of none are left to ``unmapped``; a table that no mapping fits is an
    error. Turns of one conv_id are one conversation, whatever rows they come from: ties in turn are ordered by role and
    text. An empty array has no turns. Keys of two types become text. No rows give no rows.
    """
    fits = [x for x in registry.values() if set(x.paths) <= set(field_paths(df.schema))]
    frame = layout_of(df.schema, registry)
    if len(fits) == 1 and frame.turns is None:  # rows of turns and nothing else: no choice to make
        rows, named = _turns(df, frame), F.lit(False)
    else:
        layouts = sorted({x.name: x for x in fits}.values(), key=lambda x: x.name)
        kinds = {df.schema[x.key].dataType.simpleString() for x in layouts}
        key = lambda x: F.col(x.key) if len(kinds) == 1 else F.col(x.key).cast("string")
        turns = "array<struct<turn:bigint,role:string,text:string>>"
        own = lambda x: F.expr(x.turns) if x.turns else F.array(F.struct(*[F.col(c) for c in x.fields]))
        cases = [(F.col("_layout") == x.name, x) for x in layouts]
        pick = lambda of: F.coalesce(*[F.when(is_, of(x)) for is_, x in cases])
        each = routed(df, registry).where("_layout IS NOT NULL").select(pick(key).alias("conv_id"), F.col("_layout").isin(*[x.name for x in layouts if x.turns is None]).alias("_own"), F.explode(pick(lambda x: own(x).cast(turns))).alias("_t"))
        rows, named = each.select("conv_id", "_t.*", "_own"), ~F.col("_own")
    role = F.coalesce("role", F.lit(""))
    alias = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = F.when(named, F.coalesce(F.try_element_at(alias, role), role)).otherwise(role)  # rows of turns name their roles themselves
    return rows.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _turns(df: DataFrame, layout: Layout) -> DataFrame:
    turn, role, text = layout.fields
    return df.select(F.col(layout.key).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(df: DataFrame, trained: tuple[str, ...] = ("assistant",), registry: dict[str, Layout] = REGISTRY) -> DataFrame:
    """conv_id, segments, formatted: one row per conversation, turns ordered by turn, role, text (null turns first).

    segments is an array of (text, loss); joined they are ``formatted``, and those with loss are the mask. Repeated
    rows are turns of their own. No rows give no rows; a null conv_id is a conversation like another. A conversation is
    one output string, so its size is what one row must hold; rows of it are gathered per task before the shuffle.
    """
    turns = canonical_turns(df, registry)
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))
        loss = t["role"].isin(*trained)
        return F.array(_segment(head, F.lit(False)), _segment(escaped(t["text"]), loss), _segment(F.lit(END), F.lit(False)))

    body = F.flatten(F.transform("_turns", parts))
    segments = F.concat(F.array(_segment(F.lit(BEGIN), F.lit(False))), body)
    out = talks.select("conv_id", segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def loss_spans(chats: DataFrame) -> DataFrame:
    """conv_id, segment, start, length: the mask as code point spans of ``formatted``, a row for each."""
    from pyspark.sql.window import Window

    rows = chats.select("conv_id", F.posexplode("segments").alias("segment", "s"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("length", F.length("s.text").cast("long"))
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0))).where("s.loss").select("conv_id", "segment", "start", "length")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns, loss_text, formatted: turns parsed from the formatted string, and the text under the mask, unescaped."""
    body = F.substring("formatted", F.lit(len(BEGIN) + 1), F.length("formatted"))
    pieces = F.split(body, "\\Q" + END + "\\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        halves = F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), "\\Q" + TEXT + "\\E", 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")
