"""Chat formatting with schema fingerprints; DataFrame functions only.

A layout (one row per turn, a ``messages`` array, a prompt and response pair,
an instruction with input and output, ...) is recognised by a hash of its
nested field paths.  The hash selects a declarative :class:`Mapping`, which
says by SQL expressions how the layout becomes canonical turns
``(conv_id, turn, role, text)``.  A template then renders each conversation
as one string and marks, in code points, what a loss is taken on.

Template of a turn: ``### Role: text</turn>`` and a line feed.  Inside roles
and texts the backslash becomes ``\\b``, ``### `` becomes ``\\h``, ``</turn>``
becomes ``\\t``, and in roles a colon becomes ``\\c``.  Every backslash of
an escaped string thus starts one two-letter escape, so undoing the escapes
with the backslash last gives the string back exactly.

Defined cases: a null role or text is empty, and its turn stays; a
conversation whose array of turns is null or empty has no turns and so no row
(``json_turns`` returns its record whole); turns of equal number are
ordered by role, then text; repeated rows are repeated turns; rows without
``conv_id`` form one conversation with a null id; an empty table gives an
empty result; columns outside the mapping are never read.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ESCAPE, HEAD, END = "\\", "### ", "</turn>"
#: Control strings and their escapes in the order of escaping; undone in reverse.
ESCAPES = ((ESCAPE, "\\b"), (HEAD, "\\h"), (END, "\\t"))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with the kind of each leaf, arrays as ``[]``."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower()))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    family = "number" if isinstance(kind, T.NumericType) else "string" if isinstance(kind, T.StringType) else kind.typeName()
    return [f"{at}:{family}"]


def fingerprint(kind: T.DataType) -> str:
    """SHA-256 of the sorted nested field paths."""
    return hashlib.sha256("\n".join(sorted(field_paths(kind))).encode()).hexdigest()


def record_kinds(kind: T.DataType, top: bool = True) -> list[str]:
    """The kinds, as ``schema_of_variant`` writes them, that a record of the layout ``kind`` can have: any leaf can be null."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        each = itertools.product(*[record_kinds(f.dataType, False) for f in fields])
        return ["OBJECT<" + ", ".join(f"{f.name}: {k}" for f, k in zip(fields, ks)) + ">" for ks in each]
    if isinstance(kind, T.ArrayType):
        return [f"ARRAY<{k}>" for k in record_kinds(kind.elementType, False)]
    return [kind.simpleString().upper()] + ([] if top else ["VOID"])


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``layout`` is the DDL of the columns it needs.  A row-per-turn layout has
    ``turn``, ``role`` and ``text`` expressions; any other has ``turns``, an
    expression for an array of ``(role, text)`` structs.
    """

    name: str
    layout: str
    conv_id: str
    turns: str | None = None
    turn: str | None = None
    role: str | None = None
    text: str | None = None

    @property
    def print(self) -> str:
        return fingerprint(T._parse_datatype_string(self.layout))


_PAIR = "array({0})"
MAPPINGS = (
    Mapping("rows", "conv_id bigint, turn bigint, role string, text string", "conv_id", turn="turn", role="role", text="text"),
    Mapping("messages", "id bigint, messages array<struct<role: string, content: string>>", "id",
            turns="transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Mapping("conversations", "id bigint, conversations array<struct<from: string, value: string>>", "id",
            turns="transform(conversations, m -> named_struct('role', case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end, 'text', m.value))"),
    Mapping("prompt", "id bigint, prompt string, response string", "id",
            turns=_PAIR.format("named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', response)")),
    Mapping("instruction", "id bigint, instruction string, input string, output string", "id",
            turns=_PAIR.format("named_struct('role', 'user', 'text', if(coalesce(input, '') = '', instruction, concat(coalesce(instruction, ''), '\\n\\n', input))), named_struct('role', 'assistant', 'text', output)")),
)


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint the table has.

    If the whole schema has none of them, each mapping is tried on just the
    columns it names, so that extra columns don't hide a layout; the mapping
    with most columns wins.
    """
    by_print = {m.print: m for m in mappings}
    if (own := fingerprint(schema)) in by_print:
        return by_print[own]
    have = {f.name.lower(): f for f in schema.fields}
    fits = []
    for m in mappings:
        names = [f.name.lower() for f in T._parse_datatype_string(m.layout).fields]
        if all(n in have for n in names) and fingerprint(T.StructType([have[n] for n in names])) == m.print:
            fits.append((len(names), m.name, m))
    if not fits:
        raise ValueError(f"no mapping for the layout {own}: {', '.join(field_paths(schema))}")
    return max(fits)[2]


def canonical_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns ``(conv_id, turn, role, text)`` of a table in any known layout."""
    m = select_mapping(df.schema, mappings)
    if m.turns is None:
        out = df.selectExpr(f"{m.conv_id} conv_id", f"cast({m.turn} as bigint) turn", f"{m.role} role", f"{m.text} text")
    else:
        out = df.selectExpr(f"{m.conv_id} conv_id", f"posexplode({m.turns}) as (turn, one)").selectExpr("conv_id", "cast(turn as bigint) turn", "one.role role", "one.text text")
    return out.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def json_turns(df: DataFrame, column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of records given as JSON strings of mixed layouts.

    Each record's own layout is read natively as a variant, its nested paths
    and kinds are hashed, and the hash picks the mapping; records of no known
    layout, those with a null or empty list of turns among them, come back
    with the turn null and the whole record as text, so that none is lost.
    """
    raw = df.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{column}`").alias("_json"))
    raw = raw.withColumn("_print", F.sha2(F.schema_of_variant(F.try_parse_json("_json")), 256))
    parts, known = [], []
    for m in mappings:
        layout = T._parse_datatype_string(m.layout)
        digests = [hashlib.sha256(k.encode()).hexdigest() for k in record_kinds(layout)]
        known += digests
        rows = raw.filter(F.col("_print").isin(digests)).select(F.from_json("_json", layout).alias("r")).select("r.*")
        parts.append(canonical_turns(rows, (m,)))
    rest = raw.filter(F.col("_print").isNull() | ~F.col("_print").isin(known))
    parts.append(rest.select(F.lit(None).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.coalesce("_json", F.lit("")).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    for old, new in ESCAPES + (((":", "\\c"),) if role else ()):
        c = _swap(c, old, new)
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for old, new in reversed(ESCAPES + (((":", "\\c"),) if role else ())):
        c = _swap(c, new, old)
    return c


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` holds ``(start, length)`` in code points of ``formatted``,
    one span for each text of ``loss_role``, in order.  Turns of one
    conversation meet in one task, as they make one string; a running sum
    over them places the spans, so nothing is quadratic in their number.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(": "))
    body = escape(F.col("text"))
    one = turns.select("conv_id", "turn", "role", "text", head.alias("_head"), body.alias("_body"))
    one = one.withColumn("_size", F.length("_head") + F.length("_body") + F.lit(len(END) + 1))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    one = one.withColumn("_n", F.row_number().over(order))
    before = F.sum("_size").over(Window.partitionBy("conv_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = one.withColumn("_start", before - F.col("_size") + F.length("_head"))
    part = F.struct(F.col("_n").alias("n"), F.concat("_head", "_body", F.lit(END + "\n")).alias("s"),
                    F.when(F.col("role") == loss_role, F.struct(F.col("_start").cast("long").alias("start"), F.length("_body").cast("long").alias("length"))).alias("span"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("_parts")).select(
        "conv_id",
        F.array_join(F.transform("_parts", lambda p: p["s"]), "").alias("formatted"),
        F.filter(F.transform("_parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse_chats(chats: DataFrame) -> DataFrame:
    """The turns read back from ``formatted``, and the unescaped text of each loss span.

    Returns ``conv_id, formatted, turns array<struct<role, text>>, losses array<string>``.
    """
    pieces = F.filter(F.split(F.col("formatted"), END + "\n", -1), lambda p: p != "")
    def turn(p: Column) -> Column:
        cut = F.instr(p, ": ")
        role = F.substring(p, F.lit(len(HEAD) + 1), cut - F.lit(len(HEAD) + 1))
        return F.struct(unescape(role, role=True).alias("role"), unescape(F.substring(p, cut + 2, F.length(p))).alias("text"))
    return chats.select(
        "conv_id", "formatted", F.transform(pieces, turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("losses"),
    )
