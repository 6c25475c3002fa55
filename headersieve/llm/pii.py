"""Personal data in whole texts by weak supervision, with DataFrame functions only.

*Base* spans are e-mail addresses, IP addresses, card numbers and phone numbers, found leftmost
without overlap by one pattern per kind and then checked (parts of an address, Luhn, digits).
*Wide* patterns propose further spans: numbers inside longer runs of digits, written-out addresses,
keys and secrets. Labelers (patterns, a gazetteer of cue words, the context) vote yes, no or
abstain on every proposal; expectation-maximisation over the counts of vote patterns estimates
their reliability; a Bayes classifier (features independent given the kind) over the shape and context of a span is trained on the
resulting probabilities and decides, so that it also decides where no labeler votes. Base spans
stay whatever it says.

Both tables behind the model have a fixed largest size (3^7 vote patterns, some hundred feature
values); they become literals of the expression that labels a text, so nothing is joined back.

Offsets are code points, end exclusive. Null and empty texts have no spans. Rows are independent:
repeats get equal spans, empty tables an empty result. Matches are kept in arrays of the row, so the
memory for a text grows with its length. Columns of a result's name are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.llm.weak_supervision import VoteModel, fit_votes
from headersieve.session import materialize

#: The kinds of spans, in the order of results. The first four have base spans.
KINDS = ("email", "ip", "card", "phone", "key", "secret")
BASE_KINDS = KINDS[:4]
#: The wide patterns and the kind of span that each proposes.
WIDE = {
    "email_spelled": "email",
    "ip_inside": "ip",
    "card_inside": "card",
    "phone_inside": "phone",
    "key_id": "key",
    "secret": "secret",
}

# A look-behind (or the end of the last match) makes each search start once per run of characters, so
# that long runs take linear time; possessive quantifiers keep the matcher from recursing. Both leave
# the matches as they are: a start inside a run sees the same rest as the start of the run.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "card_inside": r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone_inside": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    "ip_inside": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "email_spelled": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?"
        r"[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,4}"
    ),
    "key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9+/_-]{20,128}+(?![A-Za-z0-9+/_-])",
}
#: Texts without this sign hold no match, and are not searched.
_SIGN = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "card_inside": r"[0-9]{4}",
    "phone_inside": r"\+[0-9]",
    "ip_inside": r"[0-9]\.[0-9]",
    "email_spelled": r"[\[(\x20]dot[\])\x20]",
    "key_id": r"AKIA|ASIA",
    "secret": r"[0-9]",
}
CUES = (
    "account address api apikey auth authorization bearer call card contact credential cvv email host "
    "ip key login mail mobile passwd password phone pwd secret tel token user visa"
).split()
CONTEXT = 24

LABELERS = ("checked", "shape", "cue", "assigned", "quoted", "digits", "length")
_BLOCK = 256
_CHUNK = 1024
_SPAN = "struct<kind:string,start:int,end:int>"


@dataclass(frozen=True)
class SpanModel:
    """Reliability of the labelers, and what each feature of a span adds to its log-odds."""

    votes: VoteModel
    prior: float
    features: dict[str, float]

    def log_odds(self, proposal: Column) -> Column:
        if not self.features:
            return self.votes.log_odds(span_votes(proposal))
        pairs = [F.lit(x) for item in sorted(self.features.items()) for x in item]
        weights = F.create_map(*pairs)
        return F.aggregate(
            span_features(proposal),
            F.lit(self.prior),
            lambda total, name: total + F.coalesce(F.try_element_at(weights, name), F.lit(0.0)),
        )


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(pattern: str, hit: Column) -> Column:
    """Whether a match stands up to the check of its kind."""
    if pattern in ("ip", "ip_inside"):
        parts = F.transform(F.split(hit, r"\."), lambda part: F.regexp_replace(part, "^0+", ""))
        return F.forall(parts, lambda part: (F.length(part) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(0)) <= 255))
    if pattern in ("card", "card_inside"):
        return F.length(_digits(hit)).between(16, 19) & F.call_function("luhn_check", _digits(hit))
    if pattern in ("phone", "phone_inside"):
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _split(text: Column, pattern: str) -> tuple[Column, Column]:
    """The stretches between the matches, one more than matches, and the matches."""
    return F.split(text, _PATTERNS[pattern], -1), F.regexp_extract_all(text, F.lit(_PATTERNS[pattern]), F.lit(0))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _add(a: Column, b: Column) -> Column:
    return a + b


def _sums(numbers: Column, add=_add) -> Column:
    """0 and the running sums. Appending copies, so this is for short arrays."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, add(F.element_at(acc, -1), x)))


def _ends(lengths: Column, add=_add) -> Column:
    """The running sums (or what ``add`` makes) of an array of any length, by blocks."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
        lambda k: F.slice(lengths, k * _BLOCK + 1, F.lit(_BLOCK)),
    )
    sums = F.transform(blocks, lambda block: _sums(block, add))

    def joined(sums: Column, offsets: Column) -> Column:
        return F.transform(sums, lambda s, k: F.transform(F.slice(s, 2, _BLOCK), lambda x: add(F.get(offsets, k), x)))

    def offset(sums: Column) -> Column:
        return _sums(F.transform(sums, lambda s: F.element_at(s, -1)), add)

    return F.flatten(_once(sums, lambda held: _once(offset(held), lambda offsets: joined(held, offsets))))


def _add_matches(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """``docs`` with the column ``_<pattern>``: kind, start, end, hit, before and after of each match."""
    whole, into = F.col(text), f"_{pattern}"
    gaps, hits = _split(whole, pattern)
    there = whole.rlike(_SIGN[pattern])
    step = docs.withColumns({"_gaps": F.when(there, gaps), "_hits": F.when(there, hits)})
    step = step.withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")))
    lengths = F.zip_with("_hits", "_gaps", lambda hit, gap: F.length(gap) + F.coalesce(F.length(hit), F.lit(0)))
    step = step.withColumn("_ends", F.when(F.col("_hits").isNotNull(), _ends(lengths)))
    kind = F.lit(WIDE.get(pattern, pattern))
    found = F.transform(
        "_hits",
        lambda hit, k: F.struct(
            kind.alias("kind"),
            (F.get("_ends", k) - F.length(hit)).alias("start"),
            F.get("_ends", k).alias("end"),
            F.lit(pattern).alias("pattern"),
            hit.alias("hit"),
            F.substring(F.get("_gaps", k), -CONTEXT, CONTEXT).alias("before"),
            F.substring(F.get("_gaps", k + 1), 1, 1).alias("after"),
        ),
    )
    return step.withColumn(into, found).drop("_gaps", "_hits", "_ends")


def _bare(spans: Column) -> Column:
    return F.transform(
        spans, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))
    )


def _held(pattern: str) -> Column:
    return F.filter(f"_{pattern}", lambda m: _valid(pattern, m["hit"]))


def _count_kind(kind: str) -> Column:
    return F.size(F.filter("_base", lambda b: b["kind"] == kind)).cast("bigint")


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (kind, start, end) and ``_proposed`` (with text and context) spans."""
    whole = docs.withColumn("_whole", F.coalesce(F.col(text), F.lit("")))
    base, wide = [], []
    for pattern in BASE_KINDS:
        whole = _add_matches(whole, "_whole", pattern)
        base.append(F.coalesce(_bare(_held(pattern)), F.array().cast(f"array<{_SPAN}>")))
    whole = whole.withColumn("_base", F.concat(*base)).drop(*[f"_{p}" for p in BASE_KINDS])
    empty = F.array().cast(
        "array<struct<kind:string,start:int,end:int,pattern:string,hit:string,before:string,after:string>>"
    )
    for pattern in WIDE:
        whole = _add_matches(whole, "_whole", pattern)
        wide.append(F.coalesce(F.col(f"_{pattern}"), empty))
    free = F.filter(
        F.concat(*wide),
        lambda p: ~F.exists("_base", lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"])),
    )
    return whole.withColumn("_proposed", free).drop("_whole", *[f"_{p}" for p in WIDE])


def _passed(span: Column) -> Column:
    """Whether a proposal stands up to the check of its pattern; null if it has none."""
    pattern, hit = span["pattern"], span["hit"]
    return (
        F.when(pattern == "ip_inside", _valid("ip", hit))
        .when(pattern == "card_inside", _valid("card", hit))
        .when(pattern == "phone_inside", _valid("phone", hit))
    )


def span_votes(span: Column) -> list[Column]:
    """What each of ``LABELERS`` says of a proposal: 1 personal, -1 not, 0 nothing."""
    kind, hit, before, after = span["kind"], span["hit"], span["before"], span["after"]
    n, digits, secret = F.length(hit), F.length(_digits(hit)), kind == "secret"

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")

    passed = _passed(span)
    hexadecimal = hit.rlike("^(?:[0-9a-f]{20,}|[0-9A-F]{20,})$")
    cue = before.rlike(rf"(?i)(?<![a-z])(?:{'|'.join(CUES)})(?![a-z])")
    return [
        vote(F.coalesce(passed, F.lit(False)), F.coalesce(~passed, F.lit(False))),
        vote(kind.isin("key", "email", "phone") | (secret & hexadecimal & (digits > 0)), secret & (digits == 0)),
        vote(cue, F.lit(False)),
        vote(before.rlike(r"[=:][\x20]?[\x22\x27]?$"), F.lit(False)),
        vote(before.rlike(r"[\x22\x27]$") & after.rlike(r"[\x22\x27]"), F.lit(False)),
        vote(secret & (digits * 5 >= n) & (digits * 5 <= n * 4), secret & (digits * 12 < n)),
        vote(secret & n.isin(32, 40, 64), secret & hit.rlike("[-_/].*[-_/]")),
    ]


def span_features(span: Column) -> Column:
    """Shape and context of a proposal as names of features, of which there are a few hundred."""
    kind, hit, before, after = span["kind"], span["hit"], span["before"], span["after"]
    n = F.length(hit)

    def share(pattern: str) -> Column:
        return F.floor(F.length(F.regexp_replace(hit, pattern, "")) * 8 / n).cast("string")

    def sort_of(char: Column) -> Column:
        return (
            F.when(char == "", F.lit("none"))
            .when(char.rlike("[0-9]"), F.lit("digit"))
            .when(char.rlike(r"\p{L}"), F.lit("letter"))
            .when(char.rlike(r"[\x20\x09-\x0D]"), F.lit("space"))
            .when(char.rlike(r"[\x22\x27]"), F.lit("quote"))
            .when(char.rlike("[=:]"), F.lit("sign"))
            .otherwise(F.lit("other"))
        )

    values = {
        "kind": kind,
        "checked": F.concat(kind, F.lit(":"), F.coalesce(_passed(span).cast("string"), F.lit("none"))),
        "length": F.concat(kind, F.lit(":"), F.least(F.floor(n / 8), F.lit(16)).cast("string")),
        "digits": F.concat(kind, F.lit(":"), share("[^0-9]+")),
        "capitals": F.concat(kind, F.lit(":"), share("[^A-Z]+")),
        "left": sort_of(F.substring(before, -1, 1)),
        "right": sort_of(F.coalesce(after, F.lit(""))),
        "cue": before.rlike(rf"(?i)(?<![a-z])(?:{'|'.join(CUES)})(?![a-z])").cast("string"),
    }
    return F.array(*[F.concat(F.lit(f"{name}="), value) for name, value in values.items()])


def fit_spans(found: DataFrame) -> SpanModel:
    """The model of the proposals of all rows of ``found`` (see ``find_spans``)."""
    each = found.select(F.explode("_proposed").alias("p"))
    votes = dict(zip(LABELERS, span_votes(F.col("p")), strict=True))
    # Proposals with the same votes and features count once: at most 3^7 votes times some hundreds.
    kinds = materialize(
        each.select(*[v.alias(k) for k, v in votes.items()], span_features(F.col("p")).alias("features"))
        .groupBy(*LABELERS, "features")
        .agg(F.count("*").alias("n")),
        "spans",
    )
    patterns = materialize(kinds.groupBy(*LABELERS).agg(F.sum("n").alias("n")), "votes").coalesce(1)
    model = fit_votes(patterns, LABELERS, prior=0.5, right_yes=0.95, right_no=0.9)
    yes = F.col("n") * model.posterior([F.col(k) for k in LABELERS])
    rows = (
        kinds.select(F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature"), yes.alias("yes"), "n")
        .groupBy("feature")
        .agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
        .collect()
    )
    seen = {row["feature"]: (row["yes"] + 0.5, row["n"] - row["yes"] + 0.5) for row in rows}
    if "" not in seen:
        return SpanModel(model, 0.0, {})
    every_yes, every_no = seen.pop("")

    def whole(feature: str) -> tuple[float, float]:
        # A value that is told by kind ("length=card:2") weighs against its kind, or kinds would count again.
        kind = feature.partition("=")[2].partition(":")
        return seen.get(f"kind={kind[0]}", (every_yes, every_no)) if kind[1] else (every_yes, every_no)

    weights = {}
    for feature, (yes_there, no_there) in seen.items():
        yes_all, no_all = whole(feature)
        weights[feature] = round(math.log(yes_there / yes_all) - math.log(no_there / no_all), 6)
    return SpanModel(model, round(math.log(every_yes / every_no), 6), weights)


def _decided(model: SpanModel) -> Column:
    """The spans of a row of ``find_spans``: the base and what the model takes of the proposals."""
    chosen = F.filter("_proposed", lambda p: model.log_odds(p) >= 0)
    # The same stretch may be proposed by two patterns.
    return F.concat("_base", F.array_distinct(_bare(chosen)))


def label_spans(found: DataFrame, model: SpanModel) -> DataFrame:
    """``found`` with ``n_<kind>`` of the base, ``base_sha256`` and ``spans``."""
    order = {kind: k for k, kind in enumerate(KINDS)}
    every = _decided(model)

    def joined(spans: Column) -> Column:
        place = F.create_map(*[F.lit(x) for item in order.items() for x in item])
        keyed = F.transform(
            spans, lambda p: F.struct(F.element_at(place, p["kind"]).alias("k"), p["start"], p["end"], p["kind"])
        )
        return F.array_join(
            F.transform(F.sort_array(keyed), lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ","
        )

    counts = {f"n_{kind}": _count_kind(kind) for kind in BASE_KINDS}
    return found.withColumns(
        counts | {"base_sha256": F.sha2(joined(F.col("_base")), 256), "spans": joined(every)}
    ).drop("_base", "_proposed")


def label_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    found = materialize(find_spans(docs, text).drop(text), "pii")
    return label_spans(found, fit_spans(found))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text in chunks of ``_CHUNK``."""
    first, last = F.floor(start / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(start < end, F.substring(part, start - first * _CHUNK + 1, end - start)).otherwise("")


def _masked(whole: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds; spans that overlap become the kind of the first."""
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    keyed = F.sort_array(
        F.transform(
            spans, lambda p: F.struct(p["start"], (-p["end"]).alias("far"), F.element_at(order, p["kind"]).alias("k"), p["end"], p["kind"])
        )
    )

    def replaced(found: Column, reach: Column, chunks: Column) -> Column:
        # A stretch begins where no earlier span reaches; what lies before it ends at that reach.
        heads = F.filter(
            F.sequence(F.lit(0), F.size(found) - 1), lambda k: F.get(found, k)["start"] >= F.coalesce(F.get(reach, k - 1), F.lit(0))
        )
        pieces = F.transform(
            heads,
            lambda k: F.concat(
                _cut(chunks, F.coalesce(F.get(reach, k - 1), F.lit(0)), F.get(found, k)["start"]),
                F.lit("["),
                F.upper(F.get(found, k)["kind"]),
                F.lit("]"),
            ),
        )
        return F.concat(F.array_join(pieces, ""), _cut(chunks, F.element_at(reach, -1), F.length(whole)))

    chunks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return _once(
        keyed,
        lambda found: F.when(F.size(found) == 0, whole).otherwise(
            _once(
                _once(F.transform(found, lambda p: p["end"]), lambda ends: _ends(ends, F.greatest)),
                lambda reach: _once(chunks, lambda parts: replaced(found, reach, parts)),
            )
        ),
    )


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``label_personal_data`` replaced by their kinds in brackets; columns unchanged."""
    # Columns of the names used on the way stay safe inside the row. Written before any filter: a filter
    # pushed below the steps would repeat them many times over.
    packed = docs.select(F.struct(F.col("*")).alias("_row"), F.col(text).alias("_text"))
    found = materialize(find_spans(packed, "_text").drop("_text"), "pii")
    spans = found.select("_row", F.col("_row").getField(text).alias("_text"), _decided(fit_spans(found)).alias("_spans"))
    masked = spans.withColumn("_text", F.when(F.col("_text").isNotNull(), _masked(F.col("_text"), F.col("_spans"))))
    return masked.select(
        *[F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
