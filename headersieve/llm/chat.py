"""Chat formatting of records in many layouts, chosen by schema fingerprints.

A layout is known by the hash of its sorted nested field paths (``messages[].role`` ...). Each
fingerprint selects a declarative mapping, which says where the turns are and what their roles are
called; it turns a record into canonical turns (turn, role, text). Tables are fingerprinted by their
schema, JSON records one by one; a record of an unknown layout keeps its row, with null turns.

Formatted chats mark a turn as ``[TURN role]text[END]``. In roles and texts a backslash is doubled
and each bracket becomes a backslash and another sign, so no text can hold a mark, neither this
template's nor one made of square or angle brackets, and reading back gives the exact texts. The loss mask lists the
stretches (code points of the formatted chat) of assistant texts.

Null roles and texts count as empty. Turns go by number, null first; rows with the same number go by
role and text and all stay. A conversation is one row of the result, so it is also one group of the
shuffle; nothing else is gathered. Rows with a null id form one conversation. Empty tables give empty
results; further columns of a table are ignored.

Only the fingerprints of JSON records are taken in Python. Chats are formatted and read back by DataFrame
functions, since batches of chats in Python workers outgrow an executor.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
#: Names of roles in records; tables with a row per turn keep theirs.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
LEARNT_ROLE = "assistant"

#: Signs that would be read as marks, in the order in which they are replaced.
_ESCAPES = (("\\", "\\\\"), ("[", "\\("), ("]", "\\)"), ("<", "\\{"), (">", "\\}"))
#: The way back. Escaped text has no square bracket, so one with a digit can stand for a sign that a later step would misread.
_BACK = (
    ("\\\\", "[0"), ("\\(", "[1"), ("\\)", "[2"), ("\\{", "<"), ("\\}", ">"), ("[2", "]"), ("[0", "\\"), ("[1", "["),
)
_TURN = r"\[TURN ([^\[\]]*)\]([^\[\]]*)\[END\]"
_END = "[END]"


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: a list of messages, or fields that are one turn each."""

    name: str
    schema: str
    each: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()

    def turns(self, record: Column) -> Column:
        if self.each is not None:
            return F.transform(record[self.each], lambda m, k: _turn(k, _named(m[self.role]), m[self.text]))
        given = [_turn(F.lit(k), F.lit(role), record[field]) for k, (field, role) in enumerate(self.fields)]
        # An optional field that is missing or empty is no turn.
        return F.filter(F.array(*given), lambda t: (t["role"] != "context") | (F.length(t["text"]) > 0))

    @property
    def fingerprint(self) -> str:
        return fingerprint(paths_of_type(DataType.fromDDL(self.schema)))


def _named(role: Column) -> Column:
    """A role of a record under the name that it has here."""
    known = F.create_map(*[F.lit(x) for item in ROLES.items() for x in item])
    return F.coalesce(F.try_element_at(known, F.coalesce(role, F.lit(""))), role)


def _turn(number: Column, role: Column, text: Column) -> Column:
    return F.struct(
        number.cast("bigint").alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )


#: The layouts known at present. The first is of a table with a row per turn.
ROWS = Mapping("rows", "conv_id bigint, turn bigint, role string, text string")
MAPPINGS = (
    Mapping("messages", "messages array<struct<role:string,content:string>>", "messages", "role", "content"),
    Mapping("from_value", "conversations array<struct<from:string,value:string>>", "conversations", "from", "value"),
    Mapping("prompt_response", "prompt string, response string", fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping(
        "prompt_completion", "prompt string, completion string", fields=(("prompt", "user"), ("completion", "assistant"))
    ),
    Mapping(
        "instruction",
        "instruction string, input string, output string",
        fields=(("instruction", "user"), ("input", "context"), ("output", "assistant")),
    ),
)


def paths_of_type(kind: DataType, prefix: str = "") -> set[str]:
    if isinstance(kind, StructType):
        found = (paths_of_type(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields)
        return set().union(*found)
    if isinstance(kind, ArrayType):
        return paths_of_type(kind.elementType, f"{prefix}[]")
    return {prefix}


def paths_of_record(record: object, prefix: str = "") -> set[str]:
    if isinstance(record, dict):
        found = (paths_of_record(value, f"{prefix}.{name}" if prefix else name) for name, value in record.items())
        return set().union(*found)
    if isinstance(record, list):
        return set().union(*(paths_of_record(item, f"{prefix}[]") for item in record)) or {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def record_fingerprints(records: pd.Series) -> pd.Series:
    """The fingerprint of each JSON record; null for null or text that is no JSON."""

    def one(record: str | None) -> str | None:
        try:
            return None if record is None else fingerprint(paths_of_record(json.loads(record)))
        except ValueError:
            return None

    return records.map(one, na_action=None).astype(object)


def turns_of_records(records: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """``conv_id, layout, turns`` of JSON records; both null for an unknown layout."""
    printed = records.select(F.col(conv_id).alias("conv_id"), record, F.pandas_udf(record_fingerprints, "string")(record).alias("_print"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mapping in MAPPINGS:
        hit = F.col("_print") == mapping.fingerprint
        layout = F.when(hit, F.lit(mapping.name)).otherwise(layout)
        turns = F.when(hit, mapping.turns(F.from_json(record, mapping.schema)).cast(TURNS)).otherwise(turns)
    return printed.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def turns_of_table(table: DataFrame) -> DataFrame:
    """``conv_id, layout, turns`` of a table with a row per turn, known by the fingerprint of its schema."""
    wanted = DataType.fromDDL(ROWS.schema).fieldNames()
    kept = StructType([f for f in table.schema.fields if f.name in wanted])
    if fingerprint(paths_of_type(kept)) != ROWS.fingerprint:
        raise ValueError(f"no mapping for a table with the columns {table.columns}")
    return (
        table.select("conv_id", _turn(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).cast(TURNS).alias("turns"))
        .select("conv_id", F.lit(ROWS.name).alias("layout"), "turns")
    )


def _replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    return _replaced(text, _ESCAPES)


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given; ``text`` is a column or a variable, since it is used more than once."""
    return F.when(F.contains(text, F.lit("\\")), _replaced(text, _BACK)).otherwise(text)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where it is used inside a function of an array."""
    return F.transform(F.array(value), use)[0]


def running_sums(sizes: Column) -> Column:
    """The sums of the numbers up to each place, in log2(n) steps: each adds the sums that end 1, 2, 4 ... places before."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda step: step < F.size(sizes))

    def added(sums: Column, step: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(0), step), F.slice(sums, 1, F.size(sums) - step))
        return F.zip_with(sums, before, lambda a, b: a + b)

    return F.aggregate(steps, sizes, added)


def _learnt(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    # Places are found at once in bytes of one width: those of ASCII, or else four a sign. The sign put first
    # keeps a byte order mark in a text from being taken for one of the encoding.
    plain = F.octet_length(formatted) == F.length(formatted)
    chat = F.struct(
        plain.alias("plain"), F.when(plain, formatted.cast("binary")).otherwise(F.encode(formatted, "UTF-32")).alias("signs")
    )

    def stretch(chat: Column, begin: Column, length: Column) -> Column:
        first = F.lit(b"\0\0\0\n")
        wide = F.decode(F.concat(first, F.substring(chat["signs"], 4 * begin + 1, 4 * length)), "UTF-32")
        narrow = F.substring(chat["signs"], begin + 1, length).cast("string")
        return F.when(chat["plain"], narrow).otherwise(F.substring(wide, F.lit(2), length))

    mask = F.coalesce(loss, F.array().cast("array<struct<start:int,end:int>>"))
    stretches = _bound(chat, lambda c: F.transform(mask, lambda m: stretch(c, m["start"], m["end"] - m["start"])))
    return F.array_join(F.transform(stretches, unescaped), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """``turns`` with ``formatted`` and ``loss`` (array of start and end)."""
    parts = F.transform(
        F.coalesce("turns", F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit("[TURN "), escaped(F.coalesce(t["role"], F.lit(""))), F.lit("]")).alias("mark"),
            escaped(F.coalesce(t["text"], F.lit(""))).alias("text"),
            (F.coalesce(t["role"], F.lit("")) == LEARNT_ROLE).alias("learnt"),
        ),
    )
    sizes = F.transform("_parts", lambda p: F.length(p["mark"]) + F.length(p["text"]) + len(_END))

    def stretch(part: Column, after: Column) -> Column:
        end = after - len(_END)
        return F.struct(part["learnt"].alias("learnt"), (end - F.length(part["text"])).alias("start"), end.alias("end"))

    stretches = F.filter(F.zip_with("_parts", "_ends", stretch), lambda s: s["learnt"])
    return (
        turns.withColumn("_parts", parts)
        .withColumn("_ends", _bound(sizes, running_sums))
        .select(
            *turns.columns,
            F.array_join(F.transform("_parts", lambda p: F.concat(p["mark"], p["text"], F.lit(_END))), "").alias("formatted"),
            F.transform(stretches, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"),
        )
    )


def digest_chats(chats: DataFrame) -> DataFrame:
    """What formatted chats say when read back: counts and digests of their turns and loss."""
    roles, texts = (F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(group)) for group in (1, 2))
    back = F.zip_with(roles, texts, lambda role, text: F.struct(role.alias("role"), text.alias("text")))
    lines = F.transform(
        "_turns", lambda t: F.concat(unescaped(t["role"]), F.lit("\n"), unescaped(t["text"]), F.lit("\n"))
    )
    return (
        chats.withColumns({"_turns": back, "_learnt": _learnt(F.col("formatted"), F.col("loss"))})
        .select(
            "conv_id",
            F.size("_turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.length("_learnt").cast("bigint").alias("loss_chars"),
            F.sha2("_learnt", 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )
