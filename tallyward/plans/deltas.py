"""All fault mixes over one set of rows.

A scenario differs from the original rows only where a fault hits. So rows are not copied once per scenario: each original
row, each copy, and each changed form of either is one row for all scenarios that hold it, named by the bits of a mask.
Hashes and checks are evaluated once per form. Totals come from a histogram of masks and outcomes, a few hundred rows, which
alone is spread over the scenarios; ids and customers are compared by the union of masks, one number each; only swapped
rows, and ranks where rows may have been lost or swapped, belong to a single scenario.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions import digests, parsing, scalars
from tallyward.model import (
    CORRUPTION,
    DUPLICATION,
    INCONSISTENCY,
    INVALID_SCHEMA,
    LOSS,
    MALFORMED,
    NULLS,
    REJECT_REASONS,
    SCHEMA_DRIFT,
    TRANSFORMATION_FAILURES,
    TYPE_MISMATCHES,
)
from tallyward.operators import faults
from tallyward.operators.checks import STORED, annotate, payload_word
from tallyward.operators.ordering import dense_positions
from tallyward.plans import baseline
from tallyward.plans.combine import combine
from tallyward.plans.scenarios import FaultMix

MOST_MIXES = 60  # bits of a mask

def _bits(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _has(mask: str, bit: str | int) -> Column:
    return F.expr(f"`{mask}` & {bit} != 0")


def _without(mask: Column, other: Column) -> Column:
    return mask.bitwiseAND(F.bitwise_not(other))


def sample_mask(hashed: Column, rates: Sequence[float]) -> Column:
    """Bits of the scenarios whose sample holds a row; samples of one fault are nested, so one hash serves all."""
    out = _bits(0)
    for rate in sorted({r for r in rates if r > 0}, reverse=True):
        bits = sum(1 << i for i, r in enumerate(rates) if r >= rate)
        out = F.when(hashed < F.lit(int(rate * digests.DRAWS)), _bits(bits)).otherwise(out)
    return out


def _rates(mixes: Mapping[str, FaultMix], fault: str) -> list[float]:
    return [getattr(m, fault) for m in mixes.values()]


def _labelled(category: str) -> Column:
    return F.coalesce(F.array_contains("faults", category), F.lit(False))


def formed(events: DataFrame, mixes: Mapping[str, FaultMix]) -> DataFrame:
    """Every form of every row with the scenarios that hold it: the columns of ``events`` and those named below.

    ``slot`` is the arrival number before swaps, ``swapped`` the scenarios that sample it for one. ``origin`` marks one
    form of each original row, which is there even if every scenario drops it; its ``lost`` holds those that do.
    ``source_amount`` is the amount before faults. Rows without an arrival number are hit by no fault.
    """
    if len(mixes) > MOST_MIXES:
        raise ValueError(f"at most {MOST_MIXES} fault mixes at a time")
    everyone = (1 << len(mixes)) - 1
    rates = {f: _rates(mixes, f) for f in ("missing", "duplicates", "corruption", "schema_drift", "out_of_order")}
    if max(rates["out_of_order"], default=0) > 0.5:
        raise ValueError("at most half of the rows can lead a swap: the rate must not exceed 0.5")

    def hashed(salt: str, fault: str, key: str) -> Column:
        return digests.hash60(salt, F.col(key)) if any(rates[fault]) else F.lit(None).cast("bigint")

    rows = (
        events.withColumns({"_drop": hashed("drop", "missing", "seq"), "_dup": hashed("dup", "duplicates", "seq")})
        .withColumn("_present", _without(_bits(everyone), sample_mask(F.col("_drop"), rates["missing"])))
        .withColumn("_copied", F.col("_present").bitwiseAND(sample_mask(F.col("_dup"), rates["duplicates"])))
    )
    original = F.struct(F.col("seq").alias("slot"), F.lit(False).alias("copy"), F.col("_present").alias("_held"))
    placed = F.array(original)
    if any(rates["duplicates"]):
        copy = F.struct(
            (F.col("seq") + faults.next_seq(events)).alias("slot"), F.lit(True).alias("copy"), F.col("_copied").alias("_held")
        )
        placed = F.when(F.col("_copied") != 0, F.array(original, copy)).otherwise(F.array(original))
    slots = rows.select(*events.columns, "_present", F.inline(placed))
    slots = slots.withColumns(
        {
            "_corrupt": hashed("corrupt", "corruption", "slot"),
            "_drift": hashed("drift", "schema_drift", "slot"),
            "_ooo": hashed("ooo", "out_of_order", "slot"),
        }
    ).withColumns(
        {
            "_corrupt": F.col("_held").bitwiseAND(sample_mask(F.col("_corrupt"), rates["corruption"])),
            "_drift": F.col("_held").bitwiseAND(sample_mask(F.col("_drift"), rates["schema_drift"])),
            "swapped": sample_mask(F.col("_ooo"), [2 * r for r in rates["out_of_order"]]),
        }
    )
    both = F.col("_corrupt").bitwiseAND(F.col("_drift"))
    hit = F.col("_corrupt").bitwiseOR(F.col("_drift"))
    forms = [
        (_without(F.col("_held"), hit), False, False),
        (_without(F.col("_corrupt"), both), True, False),
        (_without(F.col("_drift"), both), False, True),
        (both, True, True),
    ]
    wanted = [True, any(rates["corruption"]), any(rates["schema_drift"])]
    wanted.append(any(c > 0 < d for c, d in zip(rates["corruption"], rates["schema_drift"])))
    entries = [
        F.when(
            (mask != 0) if k else (mask != 0) | ~F.col("copy"),
            F.struct(
                mask.alias("mask"),
                F.lit(corrupted).alias("corrupted"),
                F.lit(drifted).alias("drifted"),
                (F.lit(k == 0) & ~F.col("copy")).alias("origin"),
            ),
        )
        for k, (mask, corrupted, drifted) in enumerate(forms)
        if wanted[k]
    ]
    forms_of = slots.select(*events.columns, "_present", "slot", "copy", "swapped", F.inline(F.array_compact(F.array(*entries))))
    return forms_of.withColumn("source_amount", F.col("amount")).withColumns(
        {
            "lost": F.when(F.col("origin"), _without(_bits(everyone), F.col("_present"))).otherwise(_bits(0)),
            "amount": F.when(F.col("drifted"), F.lit(faults.DRIFTED))
            .when(F.col("corrupted"), faults.inflated(F.col("amount")))
            .otherwise(F.col("amount")),
            "checksum": F.when(F.col("corrupted"), F.lit(faults.BROKEN_CHECKSUM)).otherwise(F.col("checksum")),
        }
    )


def stored_by_minimal(events: DataFrame, mixes: Mapping[str, FaultMix], by: Sequence[str] = ()) -> DataFrame:
    """Records the minimal flow stores per scenario and group, from one run of it over all forms."""
    stored = baseline.transform(formed(events, mixes).where(F.col("mask") != 0), *by, "mask")
    per_mask = baseline.metrics(stored, [*by, "mask"])
    count = F.sum(F.when(_has("mask", "bit"), F.col("record_count")))
    return _spread(per_mask, mixes).groupBy("scenario", *by).agg(F.coalesce(count, F.lit(0)).alias("record_count"))


def contents(events: DataFrame, mixes: Mapping[str, FaultMix], as_of: str, by: Sequence[str] = ()) -> DataFrame:
    """:func:`formed` rows, checked: what totals, ids and positions need of them."""
    source_tax = scalars.tax(parsing.to_decimal(F.col("source_amount")))
    stored = F.col("outcome") == STORED
    return annotate(formed(events, mixes), as_of).select(
        *by,
        "event_id",
        "event_time",
        "customer_id",
        "seq",
        "slot",
        "mask",
        "swapped",
        "origin",
        "lost",
        "outcome",
        "stale",
        (stored & ~F.col("checksum_ok")).alias("mismatch"),
        (stored & F.col("corrupted") & ~F.col("total_tax").eqNullSafe(source_tax)).alias("wrong_tax"),
        payload_word().alias("word"),
        (F.col("copy") | _labelled(DUPLICATION)).alias("is_copy"),
        (F.col("corrupted") | _labelled(CORRUPTION)).alias("is_corrupt"),
        (F.col("drifted") | _labelled(SCHEMA_DRIFT)).alias("is_drifted"),
        _labelled(INCONSISTENCY).alias("is_moved"),
        _labelled(LOSS).alias("is_lost"),
    )


def arrivals(rows: DataFrame, events: DataFrame, mixes: Mapping[str, FaultMix]) -> DataFrame:
    """:func:`contents` with swaps carried out: sampled rows leave their masks and become rows of one scenario each."""
    swapping = [i for i, m in enumerate(mixes.values()) if m.out_of_order > 0]
    if not swapping:
        return rows
    taken = F.col("mask").bitwiseAND(F.col("swapped"))
    groups = F.greatest(F.lit(1), F.ceil(faults.next_seq(events) / F.lit(faults.SWAP_GROUP_ROWS))).cast("bigint")
    bits = F.array(*[_bits(1 << i) for i in swapping])
    picked = rows.where(taken != 0).withColumn("_bit", F.explode(F.filter(bits, lambda b: taken.bitwiseAND(b) != 0)))
    w = Window.partitionBy("_bit", "_group").orderBy(digests.hash32("ooo", F.col("slot")), "slot")
    partner = F.when(F.row_number().over(w) % 2 == 1, F.lead("slot").over(w)).otherwise(F.lag("slot").over(w))
    moved = (
        picked.withColumn("_group", digests.hash32("oooG", F.col("slot")) % groups)
        .withColumn("_partner", partner)
        .withColumns(
            {
                "is_moved": F.col("is_moved") | F.col("_partner").isNotNull(),
                "slot": F.coalesce("_partner", "slot"),
                "mask": F.col("_bit"),
                "origin": F.lit(False),
                "lost": _bits(0),
            }
        )
    )
    return rows.withColumn("mask", _without(F.col("mask"), taken)).unionByName(moved.select(*rows.columns))


def _spread(small: DataFrame, mixes: Mapping[str, FaultMix]) -> DataFrame:
    """Each row of a small frame once per scenario, with its name and bit."""
    each = [F.struct(F.lit(n).alias("scenario"), _bits(1 << i).alias("bit")) for i, n in enumerate(mixes)]
    return small.select("*", F.inline(F.array(*each)))


def totals(rows: DataFrame, mixes: Mapping[str, FaultMix], by: Sequence[str] = (), prints: bool = False) -> DataFrame:
    """Row counts per scenario and group: what arrives, what the checks say, what was injected.

    ``prints`` adds the sums of the content fingerprints of the source and of what is stored.
    """
    facts = ["outcome", "stale", "mismatch", "wrong_tax"] if prints else ["outcome", "stale", "mismatch"]
    labels = ["is_copy", "is_corrupt", "is_drifted", "is_moved", "is_lost"]
    ordered = F.col("slot").isNotNull().alias("ordered")
    word = [F.sum(F.col("word").cast("decimal(20,0)")).alias("words")] if prints else []
    histogram = (
        rows.select(*by, "mask", "lost", "origin", *facts, *labels, ordered, *(["word"] if prints else []))
        .groupBy(*by, "mask", "lost", "origin", *facts, *labels, "ordered")
        .agg(F.count("*").alias("n"), *word)
    )
    held, stored = _has("mask", "bit"), F.col("outcome") == STORED
    failed = F.col("outcome") == TRANSFORMATION_FAILURES
    drift = F.col("outcome").isin(INVALID_SCHEMA, NULLS, MALFORMED, TYPE_MISMATCHES)

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    wanted = {
        "source_rows": F.col("origin"),
        "received": held,
        "placed": held & F.col("ordered"),
        "kept": held & stored,
        "freshness_issues": held & F.col("stale"),
        "checksum_mismatch_rows": held & F.col("mismatch"),
        **{reason: held & (F.col("outcome") == reason) for reason in REJECT_REASONS},
        "dropped": _has("lost", "bit") & F.col("ordered"),
        "copies": held & F.col("is_copy") & F.col("ordered"),
        "moved": held & F.col("is_moved"),
        "moved_failed": held & F.col("is_moved") & failed,
        "labelled_lost": held & F.col("is_lost"),
        **{
            f"{name}_{kind}": held & condition
            for name, found, label in (("corrupt", F.col("mismatch"), F.col("is_corrupt")), ("drift", drift, F.col("is_drifted")))
            for kind, condition in (("tp", found & label), ("fp", found & ~label), ("fn", ~found & label))
        },
    }
    if prints:
        wanted["wrong_tax"] = held & F.col("wrong_tax")
    sums = [rows_where(c).alias(n) for n, c in wanted.items()]
    if prints:
        for name, condition in (("stored_print", held & stored), ("source_print", F.col("origin"))):
            sums.append(F.sum(F.when(condition, F.col("words"))).cast("string").alias(name))
    return _spread(histogram, mixes).groupBy("scenario", *by).agg(*sums)


def ids(rows: DataFrame, mixes: Mapping[str, FaultMix], by: Sequence[str] = (), key: str = "event_id") -> DataFrame:
    """Distinct keys per scenario and group: in the source, received, stored, received but not stored.

    Masks of a key are united before they are shuffled: two numbers a key, however many scenarios there are.
    """
    kept = F.when(F.col("outcome") == STORED, F.col("mask")).otherwise(_bits(0))
    per_key = rows.groupBy(*by, key).agg(
        F.bool_or("origin").alias("origin"), F.bit_or("mask").alias("mask"), F.bit_or(kept).alias("kept")
    )
    pairs = per_key.groupBy(*by, "origin", "mask", "kept").agg(F.count("*").alias("n"))
    got, left = _has("mask", "bit"), _has("kept", "bit")

    def keys_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return _spread(pairs, mixes).groupBy("scenario", *by).agg(
        keys_where(got).alias("received_keys"),
        keys_where(left).alias("kept_keys"),
        keys_where(got & ~left).alias("rejected_keys"),
        keys_where(F.col("origin") & ~left).alias("missing_keys"),
        keys_where(~F.col("origin") & left).alias("unexpected_keys"),
    )


def first_arrivals(
    rows: DataFrame, mixes: Mapping[str, FaultMix], by: Sequence[str] = (), stored_only: bool = False
) -> DataFrame:
    """Per id, over all scenarios: ``source`` (first arrival in the source) and ``first_<i>``, the first arrival in
    scenario i, times 8, plus 4 for a copy, 2 for a moved row, 1 for a failed one. Arrival numbers stay below 2^59."""
    failed = f"IF(outcome = '{TRANSFORMATION_FAILURES}', 1, 0)"
    place = f"slot * 8 + IF(is_copy, 4, 0) + IF(is_moved, 2, 0) + {failed}"
    stored = f" AND outcome = '{STORED}'" if stored_only else ""
    return rows.select("*", F.expr(f"{place} AS _place")).groupBy(*by, "event_id").agg(
        F.expr("min(IF(origin, seq, NULL)) AS source"),
        *[F.expr(f"min(IF(mask & {1 << i} != 0{stored}, _place, NULL)) AS first_{i}") for i in range(len(mixes))],
    )


def displaced(
    firsts: DataFrame, mixes: Mapping[str, FaultMix], by: Sequence[str] = (), stored_only: bool = False
) -> DataFrame:
    """Ids per scenario and group: arrived, arrived first as a copy, lost, and displaced: of another rank than in the
    source among the ids both have. Displaced ids are also told by whether their first row was moved, and failed.

    Only scenarios that lose or swap rows can displace an id (``stored_only``: all, as rejected rows are lost as well).
    There an id has one row at its place in the source, which
    counts for all scenarios where it arrives at that place, and one for each scenario where it arrives elsewhere; both
    ranks come from one pass over the places. An id at its place is judged there; only the two ranks of an id that
    arrives elsewhere are brought together.
    """
    watched = [i for i, m in enumerate(mixes.values()) if stored_only or m.missing > 0 or m.out_of_order > 0]

    def mask(condition: str, among: Sequence[int] = range(len(mixes))) -> str:
        return " | ".join(["0L", *[f"IF({condition.format(i=i, bit=1 << i)}, {1 << i}L, 0L)" for i in among]])

    labels = {
        "got": mask("first_{i} IS NOT NULL"),
        "copied": mask("first_{i} & 4 != 0"),
        "gone": mask("source IS NOT NULL AND first_{i} IS NULL"),
        "moved": mask("first_{i} & 3 = 2"),
        "unmoved": mask("first_{i} & 3 = 0"),
    }
    fields = "named_struct('home', {home}, 'place', {place}, 'here', {here}, 'arrived', {arrived})"
    # Masks of all scenarios, so that all that is made of the first arrivals needs the same columns of them.
    home = fields.format(
        home="true",
        place="source",
        here=mask("source IS NOT NULL AND first_{i} IS NOT NULL"),
        arrived=mask("source IS NOT NULL AND shiftright(first_{i}, 3) <=> source"),
    )
    away = [
        f"IF(source IS NOT NULL AND shiftright(first_{i}, 3) != source, "
        + fields.format(home="false", place=f"shiftright(first_{i}, 3)", here="0L", arrived=f"{1 << i}L")
        + ", NULL)"
        for i in watched
    ]
    entries = firsts.select(
        *by,
        "event_id",
        *[F.expr(f"{e} AS {n}") for n, e in labels.items()],
        F.expr(f"inline(array_compact(array({', '.join([home, *away])})))"),
    )
    places = {f"s_{i}": f"here & {1 << i} != 0" for i in watched}
    places |= {f"r_{i}": f"arrived & {1 << i} != 0" for i in watched}
    ranked = dense_positions(entries, places, "place", by) if watched else entries
    judged = ranked.withColumn("off", F.expr(mask("s_{i} != r_{i}", watched)))
    met = "named_struct('_id', {id}, '_i', {i}, '_rank', {rank}, {masks})"
    masks = ["got", "copied", "gone", "moved", "unmoved", "off"]
    outcomes = [
        f"IF(home, {met.format(id='string(NULL)', i=-1, rank='bigint(NULL)', masks=_fields(masks, lambda n: n))}, NULL)",
        *[
            f"IF((s_{i} IS NULL) != (r_{i} IS NULL), "
            + met.format(id="event_id", i=i, rank=f"coalesce(s_{i}, r_{i})", masks=_fields(masks, _label_of_pair(i)))
            + ", NULL)"
            for i in watched
        ],
    ]
    pairs = (
        judged.select(*by, F.expr(f"inline(array_compact(array({', '.join(outcomes)})))"))
        .groupBy(*by, "_id", "_i", *masks)
        .agg(F.count("*").alias("n"), F.min("_rank").alias("_low"), F.max("_rank").alias("_high"))
        .withColumns({"off": F.expr("IF(_i < 0, off, IF(_low != _high, shiftleft(1L, _i), 0L))"), "n": F.expr("IF(_i < 0, n, 1L)")})
    )
    histogram = pairs.groupBy(*by, *masks).agg(F.sum("n").alias("n"))
    counts = {
        "arrived_ids": "got & {bit} != 0",
        "first_copies": "copied & {bit} != 0",
        "lost_ids": "gone & {bit} != 0",
        "displaced_ids": "off & {bit} != 0",
        "displaced_moved": "off & moved & {bit} != 0",
        "displaced_unmoved": "off & unmoved & {bit} != 0",
    }
    sums, each = [], []
    for i, name in enumerate(mixes):
        sums += [
            F.expr(f"coalesce(sum(IF({c.format(bit=1 << i)}, n, 0L)), 0L) AS c_{i}_{k}") for k, c in enumerate(counts.values())
        ]
        each.append(f"named_struct('scenario', {name!r}, " + ", ".join(f"'{n}', c_{i}_{k}" for k, n in enumerate(counts)) + ")")
    return histogram.groupBy(*by).agg(*sums).select(*by, F.expr(f"inline(array({', '.join(each)}))"))


def _fields(names: Sequence[str], value: Callable[[str], str]) -> str:
    return ", ".join(f"'{n}', {value(n)}" for n in names)


def _label_of_pair(i: int) -> Callable[[str], str]:
    """Both ranks of an id carry whether it was moved in scenario ``i``, and count for nothing else."""
    return lambda name: f"{name} & {1 << i}" if name in ("moved", "unmoved") else "0L"


def order_mismatches(rows: DataFrame, mixes: Mapping[str, FaultMix], by: Sequence[str] = ()) -> DataFrame:
    """Stored rows per scenario and group whose time is not that of the arriving row at the same position.

    Positions of all scenarios come from one pass over the arrival numbers. A stored row with nothing rejected before it
    is its own counterpart; only the others are looked up.
    """
    every = range(len(mixes))
    sides = {f"a_{i}": f"mask & {1 << i} != 0" for i in every}
    sides |= {f"k_{i}": f"mask & {1 << i} != 0 AND outcome = '{STORED}'" for i in every}
    narrow = rows.where(F.col("mask") != 0).select(*by, "slot", "event_time", "mask", "outcome")
    placed = dense_positions(narrow, sides, "slot", by)
    fields = "named_struct('_i', {i}, '_pos', {side}_{i}, '_source', {source}, '_kept', {kept}, '_at_source', {n}, '_at_kept', {m})"
    entries = [
        f"IF({side}_{i} IS NOT NULL AND NOT a_{i} <=> k_{i}, {fields.format(side=side, i=i, source=s, kept=k, n=n, m=m)}, NULL)"
        for i in every
        for side, s, k, n, m in (("a", "event_time", "string(NULL)", 1, 0), ("k", "string(NULL)", "event_time", 0, 1))
    ]
    met = (
        placed.select(*by, F.expr(f"inline(array_compact(array({', '.join(entries)})))"))
        .groupBy(*by, "_i", "_pos")
        .agg(*[F.expr(f"max({c}) AS {c}") for c in ("_source", "_kept", "_at_source", "_at_kept")])
    )
    name = F.expr(f"element_at(array({', '.join(repr(n) for n in mixes)}), _i + 1)")
    differ = met.where("_at_source > 0 AND _at_kept > 0 AND NOT _kept <=> _source")
    return differ.groupBy(name.alias("scenario"), *by).agg(F.count("*").alias("order_mismatches"))
