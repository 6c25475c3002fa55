"""Header-order features: which of two headers came first.

Each ordered pair of the eight order headers has a slot, but for seven pairs.
Slots are numbered by the alphabetical rank of the text ``"<earlier> < <later>"``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.functions.fixed_values import ORDER_HEADERS, PAIRS_WITHOUT_SLOT
from headersieve.functions.headers import ORDER_SPELLINGS

ORDER_SLOTS: dict[str, int] = {
    pair: slot
    for slot, pair in enumerate(
        sorted(
            f"{a} < {b}" for a, b in permutations(ORDER_HEADERS, 2) if (a, b) not in PAIRS_WITHOUT_SLOT
        )
    )
}
ORDER_WIDTH = len(ORDER_SLOTS)



def _pair_cases(
    position: dict[str, Column], mark: Callable[[str], int | str | None]
) -> list[Column]:
    """One column per two headers: the mark of the pair in the order it comes in.

    Positions are compared by header name, so a row's pairs need no loop over the
    row and no self-join. Headers at the same position go by name. Null if the row
    lacks one of the two.
    """
    cases = []
    for a, b in combinations(sorted(position), 2):
        at, bt = position[a], position[b]
        cases.append(
            F.when(at <= bt, F.lit(mark(f"{a} < {b}"))).when(bt < at, F.lit(mark(f"{b} < {a}")))
        )
    return cases


def _distinct_present(values: list[Column]) -> Column:
    """The distinct values that are not null, as an array."""
    return F.array_except(F.array(*values), F.array(F.lit(None)))


def header_pairs(order_data: Column) -> Column:
    """All pairs of a row's order headers as ``"<earlier> < <later>"``.

    Only the headers whose order counts are looked up, in either spelling.
    """
    position = {name: order_data[name] for name in ORDER_SPELLINGS}
    return _distinct_present(_pair_cases(position, str))


def order_slots(order_data: Column, unknown: str = "slot0") -> Column:
    """Sorted distinct slots of a row's header pairs.

    A pair without a slot sets slot 0, or nothing with ``unknown="drop"``. No pair
    with a lowercase header has a slot, so those are not told apart.
    """
    other = 0 if unknown == "slot0" else None
    position = {name: order_data[name] for name in ORDER_HEADERS}
    slots = _pair_cases(position, lambda pair: ORDER_SLOTS.get(pair, other))
    if unknown == "slot0":
        lower = F.coalesce(*(order_data[name.lower()] for name in ORDER_HEADERS))
        present = sum(order_data[name].isNotNull().cast("int") for name in ORDER_SPELLINGS)
        slots.append(F.when(lower.isNotNull() & (present >= 2), F.lit(0)))
    return F.sort_array(_distinct_present(slots).cast("array<int>"))


def order_vocabulary(spark: SparkSession) -> DataFrame:
    """The fixed pair slots as a table ``(pair, slot)``."""
    return spark.createDataFrame(list(ORDER_SLOTS.items()), "pair string, slot int")
