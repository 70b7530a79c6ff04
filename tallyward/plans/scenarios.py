"""Named fault scenarios over order events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators import faults
from tallyward.operators.reconcile import side_counts

Injector = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FaultMix:
    """Rates of the faults of a scenario; they are applied in this order."""

    missing: float = 0.0
    duplicates: float = 0.0
    corruption: float = 0.0
    schema_drift: float = 0.0
    out_of_order: float = 0.0


@dataclass(frozen=True)
class CustomScenario:
    """``inject`` gives the faulted rows; ``lost`` the rows it took away, if it can tell."""

    inject: Injector
    lost: Injector | None = None


SCENARIOS: dict[str, FaultMix | CustomScenario] = {
    "clean": FaultMix(),
    "duplicated": FaultMix(duplicates=0.2),
    "dropped": FaultMix(missing=0.2),
    "corrupted": FaultMix(corruption=0.2),
    "schema_drift": FaultMix(schema_drift=0.2),
    "out_of_order": FaultMix(out_of_order=0.2),
    "mixed": FaultMix(missing=0.1, duplicates=0.1, corruption=0.1, out_of_order=0.1),
}


def register_scenario(name: str, inject: Injector | FaultMix, lost: Injector | None = None) -> None:
    SCENARIOS[name] = inject if isinstance(inject, FaultMix) else CustomScenario(inject, lost)


def scenario(name: str) -> FaultMix | CustomScenario:
    if name == "real_world":
        # Data used as it is: nothing is injected, so whatever is found is natural.
        return FaultMix()
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario {name!r}; known: {', '.join([*SCENARIOS, 'real_world'])}")
    return SCENARIOS[name]


def inject(events: DataFrame, name: str) -> DataFrame:
    """The faulted rows of one scenario."""
    one = scenario(name)
    if isinstance(one, CustomScenario):
        return one.inject(events)
    rates = {f.name: getattr(one, f.name) for f in fields(one)}
    return _apply(events, {n: r for n, r in rates.items() if r > 0}, events)


def _apply(df: DataFrame, rates: dict[str, faults.Rate], original: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    # Arrival numbers of copies and the number of swap groups go by the original rows.
    if "missing" in rates:
        df = faults.inject_missing(df, rates["missing"])
    if "duplicates" in rates:
        df = faults.inject_duplicates(df, rates["duplicates"], faults.next_seq(original))
    if "corruption" in rates:
        df = faults.inject_corruption(df, rates["corruption"])
    if "schema_drift" in rates:
        df = faults.inject_schema_drift(df, rates["schema_drift"])
    if "out_of_order" in rates:
        df = faults.inject_out_of_order(df, rates["out_of_order"], faults.next_seq(original), by)
    return df


def _rate_column(mixes: dict[str, FaultMix], fault: str) -> Column:
    rate = F.lit(0.0)
    for name, mix in mixes.items():
        if getattr(mix, fault) > 0:
            rate = F.when(F.col("scenario") == name, getattr(mix, fault)).otherwise(rate)
    return rate


def split(names: Sequence[str]) -> tuple[dict[str, FaultMix], dict[str, CustomScenario]]:
    """The fault mixes and the other scenarios among the named ones."""
    chosen = {n: scenario(n) for n in names}
    return (
        {n: s for n, s in chosen.items() if isinstance(s, FaultMix)},
        {n: s for n, s in chosen.items() if isinstance(s, CustomScenario)},
    )


def injected(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """The faulted rows of several scenarios in one frame, told apart by ``scenario``.

    All fault mixes share one plan: each row is fanned out to the scenarios and the
    rates are columns. So seven scenarios cost the scans of one, not of seven.
    """
    mixes, custom = split(names)
    parts = []
    if mixes:
        rates = {
            f.name: _rate_column(mixes, f.name)
            for f in fields(FaultMix)
            if any(getattr(m, f.name) > 0 for m in mixes.values())
        }
        parts.append(_apply(source_per_scenario(events, list(mixes)), rates, events, ["scenario"]))
    for name, one in custom.items():
        parts.append(_tagged(name, one.inject(events)))
    return _union(parts)


def lost_rows(events: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(scenario, by, event_id, seq) of the rows each scenario took away."""
    mixes, custom = split(names)
    keys = [*by, "event_id", "seq"]
    parts = []
    if mixes:
        rows = source_per_scenario(events.select(*keys), list(mixes))
        parts.append(faults.missing_rows(rows, _rate_column(mixes, "missing")))
    for name, one in custom.items():
        if one.lost is not None:
            gone = one.lost(events)
        else:
            counts = side_counts(events.select(*keys), one.inject(events).select(*keys), ["event_id", "seq"], by)
            gone = counts.filter((F.col("source_rows") > 0) & (F.col("target_rows") == 0))
        parts.append(_tagged(name, gone.select(*keys)))
    return _union(parts)


def source_per_scenario(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """The original rows once per scenario."""
    return events.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("scenario"), *events.columns)


def _tagged(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("scenario"), *df.columns)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
