"""Automatic features of a catalog: counts, recency, ratios, shares and statistics of related tables, one join a path."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.operators import features as fs
from tidemark.operators.features import Feature, Path, Predicate
from tidemark.operators.profile import kind_of, top_values

COUNT_DAYS, VALUE_DAYS, MOST = (7, 30, 90, 365), (30, 90, 365), 300


@dataclass(frozen=True)
class Table:
    """A table of the catalog; foreign maps its columns to parent tables; static tables have no time and are confirmed so."""

    df: DataFrame
    key: str | None = None
    time: str | None = None
    foreign: dict[str, str] = field(default_factory=dict)
    static: bool = False


def paths(catalog: dict[str, Table], entity: str) -> tuple[dict[str, Path], list[str]]:
    """Children of the entity, and their children (joined with the timed parent beforehand); and the tables skipped, with why."""
    found, skipped = {}, []
    for name, t in catalog.items():
        for c, parent in t.foreign.items():
            if parent == entity:
                if t.time is None:
                    skipped.append(f"{name}: no event time")
                    continue
                found[name] = Path(t.df, c, t.time, tie=t.key)
                for grand, g in catalog.items():
                    for gc, gp in g.foreign.items():
                        if gp == name and t.key is not None:
                            keep = [x for x in t.df.columns if x in (t.key, c, t.time)]
                            joined = g.df.join(t.df.select(*keep), g.df[gc] == t.df[t.key])
                            time = g.time or t.time
                            found[f"{name}_{grand}"] = Path(joined, c, time, also=(t.time,) if g.time else ())
    return found, skipped


def short(name: str) -> str:
    """At most 63 characters: longer names end in a hash."""
    return name if len(name) <= 63 else f"{name[:54]}_{hashlib.sha256(name.encode()).hexdigest()[:8]}"


def generate(path_name: str, path: Path, columns: list[str], top: dict[str, list[str]] | None = None) -> tuple[list[Feature], list[tuple[str, str, str]]]:
    """Features of a path and ratios (name, over, under), in order of priority, then name."""
    out = [Feature(short(f"{path_name}_count_{d}d"), "count", days=d) for d in COUNT_DAYS] + [Feature(short(f"{path_name}_count_all"), "count"), Feature(short(f"{path_name}_days_since_last"), "days_since_last")]
    ratios = [(short(f"{path_name}_count_{a}_over_{b}"), short(f"{path_name}_count_{a}d"), short(f"{path_name}_count_{b}d")) for a, b in ((7, 30), (30, 90))]
    kinds = dict(path.table.dtypes)
    for c in columns:
        kind = kind_of(kinds[c])
        if kind in ("integer", "float"):
            out += [Feature(short(f"{path_name}_{c}_{a}_{d}d"), a, c, d) for a in ("sum", "mean", "min", "max", "std") for d in VALUE_DAYS]
        elif kind == "boolean":
            out += [Feature(short(f"{path_name}_{c}_share_{d or 'all'}"), "share", c, d, (Predicate(c, "=", True),)) for d in (30, 90, None)]
        elif kind == "text":
            for v in (top or {}).get(c, []):
                out += [Feature(short(f"{path_name}_{c}_{v}_count_{d}d"), "count", None, d, (Predicate(c, "=", v),)) for d in VALUE_DAYS]
    return out[:MOST], ratios


def feature_table(spine: DataFrame, catalog: dict[str, Table], entity: str, columns: dict[str, list[str]], attributes: list[str] | None = None, most_levels: int = 50) -> DataFrame:
    """The spine with all generated features: a join and an aggregation for each path."""
    frames = []
    for name, path in paths(catalog, entity)[0].items():
        cols = columns.get(name, [])
        text = [c for c in cols if kind_of(dict(path.table.dtypes)[c]) == "text"]
        top: dict[str, list[str]] = {}
        if text:
            for r in top_values(path.table, text, 5, most_levels).orderBy("column_name", "position").collect():
                top.setdefault(r["column_name"], []).append(r["value"])
        made, ratios = generate(name, path, cols, top)
        frame = fs.compute(spine, path, made)
        for n, a, b in ratios:
            frame = fs.ratio(frame, n, a, b)
        frames.append(frame)
    t = catalog[entity]
    if attributes:
        frames.append(fs.entity_values(spine, t.df, t.key, attributes, t.time))
    return fs.wide(spine, frames)
