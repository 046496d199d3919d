"""Merging reports of one node or edge, in the order they arrived.

Folded in arrival order, a report replaces the survivor only if its confidence is strictly higher, and fills the survivor's gaps
otherwise. So what stands is told by few things: the first report of each confidence, which took over if none of its confidence or
a higher one came before it; then, for each gap that these leave, the first report that fills it. All of these are minima over
the arrival order, which tasks take of their own rows before anything is sent: an id reported a million times is neither
sorted nor gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import confidence_rank

RANKS = (2, 1, 0)


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name) == 0, F.lit(True))


def _merged(reports: DataFrame, key: list[str], order: list[str], tops: list[str], filled: dict[str, Column], annotations: bool) -> DataFrame:
    """One row for each ``key``: columns ``tops`` as the survivor has them, ``filled`` (column: whether it is a gap), and props."""
    arrival = F.struct(*order)
    rank = confidence_rank(F.col("confidence"))
    own = F.struct(*tops, *(F.when(~gap, F.col(c)).alias(c) for c, gap in filled.items()), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))
    rows = reports.select(*key, arrival.alias("_at"), rank.alias("_rank"), own.alias("_own"), *([F.col("annotations").alias("_notes")] if annotations else []))
    at = lambda r: F.when(F.col("_rank") == r, F.col("_at"))
    firsts = rows.groupBy(*key).agg(*(F.min_by("_own", at(r)).alias(f"own{r}") for r in RANKS), *(F.min(at(r)).alias(f"at{r}") for r in RANKS), *(F.min_by(f"_own.{c}", F.when(F.col(f"_own.{c}").isNotNull(), F.col("_at"))).alias(f"first_{c}") for c in filled))
    # A first report of a rank took over unless one of a higher rank was there before it.
    stands = {r: F.col(f"at{r}").isNotNull() & ~F.coalesce(F.lit(False) if r == 2 else F.greatest(*(F.coalesce(F.col(f"at{h}") < F.col(f"at{r}"), F.lit(False)) for h in RANKS if h > r), F.lit(False)), F.lit(False)) for r in RANKS}
    taken = firsts.select(*key, *(F.when(stands[r], F.col(f"own{r}")).alias(f"own{r}") for r in RANKS), *(f"first_{c}" for c in filled))
    top = lambda c: F.when(F.col("own2").isNotNull(), F.col(f"own2.{c}")).when(F.col("own1").isNotNull(), F.col(f"own1.{c}")).otherwise(F.col(f"own0.{c}"))
    none = F.create_map().cast("map<string,string>")
    said = lambda r: F.coalesce(F.col(f"own{r}.props"), none)
    rest = lambda m, over: F.map_filter(m, lambda k, _: ~F.map_contains_key(over, k))
    one = F.map_concat(said(2), rest(said(1), said(2)))
    two = F.map_concat(one, rest(said(0), one))
    entries = rows.select(*key, "_at", F.explode("_own.props").alias("k", "v")).groupBy(*key, "k").agg(F.min_by("v", "_at").alias("v"))
    others = entries.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_others"))  # an entry for each name
    out = taken.select(*key, *(top(c).alias(c) for c in tops), *(F.coalesce(*(F.col(f"own{r}.{c}") for r in RANKS), F.col(f"first_{c}")).alias(c) for c in filled), two.alias("_said")).join(others, key, "left")
    out = out.withColumn("props", F.map_concat("_said", rest(F.coalesce("_others", none), F.col("_said")))).drop("_said", "_others")
    if annotations:
        notes = rows.select(*key, F.explode("_notes").alias("n")).groupBy(*key).agg(F.sort_array(F.collect_set("n")).alias("annotations"))
        out = out.join(notes, key, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast("array<string>")))
    return out


def merge_nodes(reports: DataFrame, order: list[str]) -> DataFrame:
    """One row for each id. ``order``: columns that give the arrival order."""
    gaps = {c: _blank(c) for c in ("fqn", "file_path", "module", "source")} | {c: _zero(c) for c in ("line_start", "line_end")} | {"layer": F.coalesce(F.col("layer").isin("", "unknown"), F.lit(True))}
    out = _merged(reports, ["id"], order, ["kind", "label", "confidence"], gaps, True).withColumn("layer", F.coalesce("layer", F.lit("unknown")))
    return out.select("id", "kind", "label", "fqn", "file_path", "line_start", "line_end", "module", "layer", "confidence", "source", "annotations", "props")


def merge_edges(reports: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (src, dst, kind); the id is the survivor's."""
    out = _merged(reports, ["src", "dst", "kind"], order, ["id", "confidence"], {"source": _blank("source")}, False)
    return out.select("id", "kind", "src", "dst", "confidence", "source", "props")
