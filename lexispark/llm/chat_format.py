"""Chat formatting by schema fingerprint (operator 13, DataFrame functions only).

Records of any layout are VARIANT values: parsed JSON, or the columns of a table. A record's nested field
paths (``messages[].role``) are read off its own schema, those that no layout knows are left out, and
the rest are sorted and hashed. The hash selects one of the declared layouts; a layout says where keys,
roles and texts are, and nothing else, so another layout is a line in a list. All layouts end in the
same canonical turns (role, text), which one template formats.

The template is ``<|turn|>role<|text|>text<|end|>`` per turn. Control strings inside roles and texts, those of the template
and of other public templates, get a backslash behind their first character, and backslashes are
doubled before, so no text can open or close a turn and all of it can be read back. The loss
mask lies on the assistant's texts: ``mask`` has, per turn, the turn's length and the span inside it
(start, length) that is learned, all in code points. ``read_back`` cuts the formatted text at its markers
and takes what the mask marks, without what it was made from.

Edge cases: null texts and roles are empty ones; texts may hold anything, also the template itself;
turns of one place (repeated rows) are all kept, by role, then text; null places come first; rows with a
null key are one conversation; a record of no known layout has ``layout`` null and no turns
(``unknown_layouts`` counts their paths), as have null records and text that is no JSON; an empty table gives no rows;
very long texts are formatted whole, and a conversation, being one row of the result, is as
long as a row can be; columns of a table of turns other than the four named, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The markers above and control strings of public chat templates.
CONTROL = (
    TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<start_of_turn>", "<end_of_turn>",
)
LEARNED = "assistant"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``pairs``: (role, paths) for each turn, whose texts, if not empty, are joined by an empty line; a
    turn none of whose paths the record has is left out. ``listed``: (array, role field, text
    field). ``row``: (place, role, text), a record that is a single turn of the conversation ``key``.
    ``optional`` paths may be missing. ``names`` renames roles.
    """

    name: str
    pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    listed: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None
    key: str = "conv_id"
    optional: tuple[str, ...] = ()
    names: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        """All field paths that the layout reads; the key may always be missing."""
        if self.listed:
            array, role, text = self.listed
            return {f"{array}[].{role}", f"{array}[].{text}"}
        return set(self.row or ()) | {p for _, paths in self.pairs for p in paths}

    def shapes(self) -> list[str]:
        """The sorted, joined paths of every record that has this layout."""
        own = [self.paths() - set(some) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]
        if self.listed:
            own.append({f"{self.listed[0]}[]"})  # an empty list
        return ["\n".join(sorted(paths)) for paths in own]


OTHER_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn rows", row=("turn", "role", "text")),
    Layout("messages", listed=("messages", "role", "content")),
    Layout("conversations", listed=("conversations", "from", "value"), names=OTHER_NAMES),
    Layout("dialogue", listed=("dialogue", "speaker", "text"), names=OTHER_NAMES),
    Layout("instruction", pairs=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt and completion", pairs=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt and response", pairs=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question and answer", pairs=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)

#: Tokens of a variant's schema: a field's name, the openings and closing of nested types, a type.
_TOKEN = r"`(?:[^`]|``)+`: |\w+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([^)]*\))?"


def field_paths(record: Column) -> Column:
    """The paths of a VARIANT's scalar fields and empty lists, as an array of text.

    The schema is read from left to right with a stack of the paths that are open; a type ends the
    innermost one.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKEN), 0)
    start = F.struct(F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        top = F.element_at(state.open, -1)
        named = F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", "")
        below = F.slice(state.open, 1, F.size(state.open) - 1)
        opened = F.when(F.endswith(token, F.lit(": ")), F.array_append(state.open, F.when(top == "", named).otherwise(F.concat(top, F.lit("."), named))))
        opened = opened.when(token == "ARRAY<", F.array_append(state.open, F.concat(top, F.lit("[]")))).when(token == "OBJECT<", state.open).otherwise(below)
        leaf = ~(F.endswith(token, F.lit(": ")) | token.isin("ARRAY<", "OBJECT<", ">"))
        return F.struct(opened.alias("open"), F.when(leaf & (top != ""), F.array_append(state.found, top)).otherwise(state.found).alias("found"))

    return F.aggregate(tokens, start, step, lambda state: state.found)


def fingerprint(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those of ``paths`` that some layout knows."""
    known = sorted({p for layout in layouts for shape in layout.shapes() for p in shape.split("\n")})
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, known)))), "\n"))


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


_TURNS = "array<struct<place:bigint,role:string,text:string>>"


def _turns(record: Column, paths: Column, layout: Layout) -> Column:
    """The turns of a record of a layout, as structs of place, role and text."""
    named = lambda role: F.coalesce(*[F.when(role == a, F.lit(b)) for a, b in layout.names.items()], role, F.lit(""))
    turn = lambda place, role, text: F.struct(place.cast("bigint").alias("place"), named(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.row:
        place, role, text = layout.row
        return F.array(turn(F.try_variant_get(record, f"$.{place}", "bigint"), _text(record, role), _text(record, text)))
    if layout.listed:
        array, role, text = layout.listed
        items = F.try_variant_get(record, f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(items, lambda item, i: turn(i, item[role], item[text]))
    found = []
    for i, (role, among) in enumerate(layout.pairs):
        texts = F.filter(F.array(*[_text(record, p) for p in among]), lambda t: t != "")
        there = F.arrays_overlap(paths, F.array(*map(F.lit, among)))
        found.append(F.when(there, turn(F.lit(i), F.lit(role), F.array_join(texts, "\n\n"))))
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def canonical(records: DataFrame, *, record: str = "record", key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key bigint, layout, paths, turns) of each record, in canonical turns.

    ``record`` is a VARIANT column, or JSON as text. The key is what the record has at its
    layout's ``key``.
    """
    value = F.col(record) if records.schema[record].dataType.typeName() == "variant" else F.try_parse_json(F.col(record))
    read = records.select(value.alias("record")).withColumn("paths", field_paths(F.col("record"))).withColumn("print", fingerprint(F.col("paths"), layouts))
    which, turns, keys = F, F, F
    for layout in layouts:
        here = F.col("print").isin(*[F.xxhash64(F.lit(shape)) for shape in layout.shapes()])
        which = which.when(F.col("paths").isNotNull() & here, F.lit(layout.name))
        at = F.col("layout") == layout.name
        turns = turns.when(at, _turns(F.col("record"), F.col("paths"), layout))
        keys = keys.when(at, F.try_variant_get(F.col("record"), f"$.{layout.key}", "bigint"))
    found = read.withColumn("layout", which)
    nothing = F.array().cast(_TURNS)
    return found.select(keys.alias(key), "layout", "paths", F.coalesce(turns.cast(_TURNS), nothing).alias("turns"))


def conversations(found: DataFrame, *, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, turns): records that are single turns are gathered by key, others stay where they are."""
    single = F.coalesce(F.col("layout").isin(*[layout.name for layout in layouts if layout.row]), F.lit(False))
    gathered = found.where(single).groupBy(key).agg(F.first("layout").alias("layout"), F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"))
    return gathered.unionByName(found.where(~single).select(key, "layout", "turns"))


def _escape_pattern(control: tuple[str, ...]) -> str:
    """The first character of a control string, where one begins."""
    return "|".join(f"{re.escape(first)}(?={'|'.join(re.escape(c[1:]) for c in control if c[0] == first)})" for first in sorted({c[0] for c in control}))


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """``text`` without any control string in it; ``unescape`` gives it back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_escape_pattern(control)})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def template(chats: DataFrame, *, learned: str = LEARNED, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """``chats`` with ``formatted`` and ``mask`` in place of ``turns``."""
    pieces = F.transform("turns", lambda t: F.struct(escape(t.role, control).alias("role"), escape(t.text, control).alias("text"), (t.role == learned).alias("learned")))
    whole = F.transform("pieces", lambda p: F.concat(F.lit(TURN), p.role, F.lit(TEXT), p.text, F.lit(END)))
    marks = len(TURN) + len(TEXT)
    span = F.transform(
        "pieces",
        lambda p: F.struct(
            (F.length(p.role) + F.length(p.text) + marks + len(END)).cast("bigint").alias("chars"),
            (F.length(p.role) + marks).cast("bigint").alias("start"),
            F.when(p.learned, F.length(p.text)).otherwise(0).cast("bigint").alias("length"),
        ),
    )
    return chats.withColumn("pieces", pieces).withColumns({"formatted": F.array_join(whole, ""), "mask": span}).drop("turns", "pieces")


def format_chats(records: DataFrame, *, record: str = "record", key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, formatted, mask) of each conversation in ``records``."""
    return template(conversations(canonical(records, record=record, key=key, layouts=layouts), key=key, layouts=layouts))


def unknown_layouts(records: DataFrame, *, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(paths, n): field paths of the records that no layout fits, and how many have them."""
    return canonical(records, record=record, layouts=layouts).where("layout is null").groupBy(F.array_sort("paths").alias("paths")).agg(F.count(F.lit(1)).alias("n"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, an array of (role, text), and ``learned``, the texts under the mask: both are
    taken from ``formatted`` and ``mask`` alone."""
    cut = F.split("formatted", re.escape(END), -1)
    segments = F.slice(cut, 1, F.size(cut) - 1)
    inner = lambda s: F.substring(s, F.lit(len(TURN) + 1), F.length(s))
    turns = F.transform("segments", lambda s: F.struct(unescape(F.substring_index(inner(s), TEXT, 1)).alias("role"), unescape(F.substring_index(s, TEXT, -1)).alias("text")))
    marked = F.filter(F.zip_with("segments", "mask", lambda s, m: F.when(m.length > 0, unescape(F.substring(s, (m.start + 1).cast("int"), m.length.cast("int"))))), lambda t: t.isNotNull())
    return formatted.withColumn("segments", segments).withColumns({"turns": turns, "learned": marked}).drop("segments")


def turn_records(table: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of one row per turn as records of the layout ``turn rows``."""
    named = F.struct(F.col(key).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return table.select(F.to_variant_object(named).alias("record"))


def digests(chats: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """Per conversation: what is read back from its formatted text, counted and hashed."""
    read = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        key,
        F.size("turns").cast("bigint").alias("n_turns"),
        sha(said).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
