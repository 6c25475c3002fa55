"""Column functions over header logs, request bodies and header tables.

The working form of a header table is ``array<struct<k:string,v:string,pos:int>>``
in arrival order, one entry per header name. Maps are only made for storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.functions.fixed_values import (
    ORDER_HEADERS,
    USER_AGENT_HEADERS,
    VALUE_HEADERS,
)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is worked out once per row.

    A filter on a projected column is pushed below the projection, which works
    the column out a second time; it is not pushed below a generator. The value
    itself stays in a projection, where it is compiled.
    """
    held = df.withColumn("__once", value)
    return held.withColumn(name, F.explode(F.array("__once"))).drop("__once")


def both_spellings(headers: tuple[str, ...]) -> list[str]:
    """The canonical and the all-lowercase spelling of each header."""
    return [spelling for h in headers for spelling in (h, h.lower())]


ORDER_SPELLINGS = both_spellings(ORDER_HEADERS)
VALUE_SPELLINGS = both_spellings(VALUE_HEADERS)


def clean_header_json(headers: Column) -> Column:
    r"""Turn every ``\/`` into ``/`` and drop one quote at each end."""
    return F.regexp_replace(F.replace(headers, F.lit("\\/"), F.lit("/")), r"\A'|'\z", "")


def json_map(json: Column) -> Column:
    """The JSON object as a map in document order, repeated keys included.

    Null if the text is not a JSON object.
    """
    # The parser stops at the closing brace; text behind it makes the whole malformed.
    return F.when(F.rtrim(json).endswith("}"), F.from_json(json, "map<string,string>"))


def json_entries(headers: Column) -> Column:
    """Header entries of a JSON object's map, in document order.

    A header without a value (JSON null) keeps the text ``null``.
    """
    return F.transform(
        F.map_entries(headers),
        lambda e, i: F.struct(
            e["key"].alias("k"),
            F.coalesce(e["value"], F.lit("null")).alias("v"),
            i.cast("int").alias("pos"),
        ),
    )


def _plain(headers: Column, json: Column) -> Column:
    """Whether a JSON object's map needs no repair: no repeated header, no null."""
    names = F.map_keys(headers)
    return (F.size(F.array_distinct(names)) == F.size(names)) & ~json.contains("null")


def json_values(headers: Column, json: Column) -> Column:
    """Header values of a JSON object's map; it is the map itself in the usual case."""
    repaired = value_map(last_entry_per_header(json_entries(headers)))
    return F.when(_plain(headers, json), headers).otherwise(repaired)


def json_positions(headers: Column, json: Column) -> Column:
    """Header positions of a JSON object's map."""
    size = F.size(headers)
    places = F.slice(F.sequence(F.lit(0), size), F.lit(1), size)
    repaired = order_map(last_entry_per_header(json_entries(headers)))
    plain = F.map_from_arrays(F.map_keys(headers), places)
    return F.when(_plain(headers, json), plain).otherwise(repaired)


def body_entries(body: Column, trim: bool = True) -> Column:
    """Header entries of a ``Name: value`` body; the position is the line number.

    Lines without a colon are skipped but still take a position.
    """

    def side(text: Column) -> Column:
        return F.btrim(text, F.lit(" \t\r")) if trim else text

    lines = F.transform(
        F.split(body, "\n"),
        lambda line, i: F.struct(
            F.locate(":", line).alias("at"), line.alias("line"), i.cast("int").alias("pos")
        ),
    )
    return F.transform(
        F.filter(lines, lambda e: e["at"] > 0),
        lambda e: F.struct(
            side(F.substr(e["line"], F.lit(1), e["at"] - 1)).alias("k"),
            side(F.substr(e["line"], e["at"] + 1)).alias("v"),
            e["pos"].alias("pos"),
        ),
    )


def last_entry_per_header(entries: Column) -> Column:
    """Keep the last entry of a repeated header, with its own position."""
    size = F.size(entries)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, size), lambda later: later["k"] == e["k"]),
    )
    return F.when(F.size(F.array_distinct(entries["k"])) == size, entries).otherwise(last)


def value_map(entries: Column) -> Column:
    return F.map_from_arrays(entries["k"], entries["v"])


def order_map(entries: Column) -> Column:
    return F.map_from_arrays(entries["k"], entries["pos"])


def sorted_order(value_data: Column) -> Column:
    """Positions as if the headers had arrived in alphabetical order."""
    names = F.sort_array(F.map_keys(value_data))
    return F.map_from_arrays(names, F.transform(names, lambda _, i: i.cast("int")))


def trim_order(order_data: Column) -> Column:
    """Positions of the headers whose order is a feature, in either spelling."""
    return F.map_filter(order_data, lambda k, v: k.isin(ORDER_SPELLINGS))


def trim_values(value_data: Column) -> Column:
    """Values of the headers whose value is a feature, in either spelling."""
    return F.map_filter(value_data, lambda k, v: k.isin(VALUE_SPELLINGS))


def pick_user_agent(value_data: Column, mode: str = "online") -> Column:
    """The user agent among its possible header names, ``""`` if there is none.

    ``online``: the first non-empty of the names in order of preference.
    ``legacy``: the canonical name must be non-empty; a lowercase one, if
    present, then replaces it.
    ``evaluation``: the canonical name only.
    """
    canonical, *others = (value_data[name] for name in USER_AGENT_HEADERS)
    if mode == "online":
        found = [F.nullif(v, F.lit("")) for v in (canonical, *others)]
        return F.coalesce(*found, F.lit(""))
    picked = F.coalesce(canonical, F.lit(""))
    if mode == "legacy":
        for other in others:
            picked = F.when((picked != "") & other.isNotNull(), other).otherwise(picked)
        return picked
    if mode == "evaluation":
        return picked
    raise ValueError(f"unknown user agent mode {mode!r}")


def has_user_agent_key(value_data: Column) -> Column:
    first, *rest = (value_data[name].isNotNull() for name in USER_AGENT_HEADERS)
    for other in rest:
        first = first | other
    return first
