"""Beam search through the model lattice.

Models are generated on the driver; the margins of all candidates of a level are
computed together (one GROUPING SETS job per batch of new margins), so a level
costs one job however many models it has.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..algebra import Model, bits, reference_model, size
from ..errors import SearchError
from ..operators.analyzer import Analyzer
from ..progress import Event, LevelProfile, RuntimeEstimator, SearchProfile, driver_peak, stage_figures, tagged
from ..schema import Schema
from .neighbours import all_chains, rule

#: Models with loops whose relations have more variables than this are left out.
MAX_LOOP_VARIABLES = 15


@dataclass(frozen=True)
class Candidate:
    model: Model
    value: float
    level: int

    @property
    def name(self) -> str:
        return self.model.name


@dataclass
class LevelStats:
    level: int
    generated: int
    evaluated: int
    kept: int
    with_loops: int
    seconds: float
    left_out: int = 0  # models with loops whose relations are too large


@dataclass
class SearchResult:
    candidates: list[Candidate]
    levels: list[LevelStats] = field(default_factory=list)
    seconds: float = 0.0

    @property
    def best(self) -> Candidate:
        return self.candidates[0]

    def frame(self, analyzer: Analyzer) -> DataFrame:
        rows = [(k + 1, c.name, float(c.value), c.level, c.model.has_loops) for k, c in enumerate(self.candidates)]
        return analyzer.spark.createDataFrame(rows, "rank int, model string, statistic double, level int, has_loops boolean")


def sort_key(statistic: str):
    """DDF, DF and H: largest first; the rest: smallest first; ties by name."""
    sign = -1 if statistic in ("ddf", "df", "h") else 1
    return lambda c: (sign * c.value, c.name)


def usable(m: Model) -> bool:
    return not m.has_loops or all(size(r) <= MAX_LOOP_VARIABLES for r in m.relations)


def search(analyzer: Analyzer, filter="loopless", direction="up", statistic: str = "ddf", width: int = 3, levels: int = 7, start: Model | str | None = None,
           progress=None, tag: str | None = None) -> SearchResult:
    """Start model and the best ``width`` models of each level, sorted by the statistic.

    filter: a neighbour rule's name, "chain" (all chains), or a callable Model -> models.  progress: gets all events, those
    of the analyzer's fits too; what it raises ends the search.  tag: the job tag of the search; jobs of level k carry
    ``level_tag(tag, k)`` as well.
    """
    before, analyzer.tell = analyzer.tell, progress or analyzer.tell
    try:
        with tagged(analyzer.spark, *([tag] if tag else [])):
            return _search(analyzer, filter, direction, statistic, width, levels, start, progress, tag)
    finally:
        analyzer.tell = before


def level_tag(tag: str, level: int) -> str:
    return f"{tag}-level-{level}"


def profiled(analyzer: Analyzer, *args, name: str = "search", **how) -> tuple[SearchResult, SearchProfile]:
    """``search`` and its profile: shuffled bytes, spill, memory and task time by level, from the jobs' tags."""
    tag = how.pop("tag", None) or f"kontingent-{uuid.uuid4().hex}"
    peaks: dict[int, int] = {}
    inner = how.pop("progress", None)

    def tell(event: Event) -> None:
        if event.kind == "level_complete":
            peaks[event.data["level"]] = driver_peak()
        if inner:
            inner(event)

    was, analyzer.profile.enabled = analyzer.profile.enabled, True
    try:
        found = search(analyzer, *args, progress=tell, tag=tag, **how)
    finally:
        analyzer.profile.enabled = was
    levels = [LevelProfile(x.level, x.generated, x.evaluated, x.with_loops, x.seconds, peaks.get(x.level, 0), stage_figures(analyzer.spark, level_tag(tag, x.level))) for x in found.levels]
    cache = {"hits": analyzer.cache.hits, "misses": analyzer.cache.misses, "hit_rate": analyzer.cache.hit_rate}
    return found, SearchProfile(name, found.seconds, sum(x.evaluated for x in found.levels), levels, analyzer.profile.to_dict(), cache)


def _search(analyzer: Analyzer, filter, direction, statistic, width: int, levels: int, start, progress, tag: str | None) -> SearchResult:
    if width < 1 or levels < 0:
        raise SearchError("width must be positive and levels not negative")
    statistic, direction = getattr(statistic, "value", statistic), getattr(direction, "value", direction)
    began, tell = time.perf_counter(), progress or (lambda e: None)
    if getattr(filter, "value", filter) == "chain":
        models = all_chains(analyzer.schema)
        analyzer.prefetch(models)
        found = sorted((Candidate(m, analyzer.statistic(m, statistic), 1) for m in models), key=sort_key(statistic))
        return SearchResult(found, [], time.perf_counter() - began)
    step = rule(filter, direction)
    default = "top" if direction == "down" else "bottom"
    first = start if isinstance(start, Model) else reference_model(analyzer.schema, start or default)
    kept: dict[Model, Candidate] = {first: Candidate(first, analyzer.statistic(first, statistic), 0)}
    beam, stats = [first], []
    tell(Event("search_started", {"start": first.name, "levels": levels, "width": width, "statistic": statistic}))
    clock, so_far = RuntimeEstimator(levels), 0
    for level in range(1, levels + 1):
        t = time.perf_counter()
        tell(Event("level_started", {"level": level, "seeds": len(beam)}))
        generated = [x for m in beam for x in step(m)]
        distinct = list(dict.fromkeys(generated))
        fresh = [m for m in distinct if usable(m)]
        if not fresh:
            break
        with tagged(analyzer.spark, *([level_tag(tag, level)] if tag else [])):
            analyzer.prefetch(fresh)
            scored = sorted((Candidate(m, analyzer.statistic(m, statistic), level) for m in fresh), key=sort_key(statistic))
        best = scored[:width]
        for c in best:
            kept.setdefault(c.model, c)
        beam = [c.model for c in best]
        stats.append(LevelStats(level, len(generated), len(fresh), len(best), sum(m.has_loops for m in fresh), time.perf_counter() - t, len(distinct) - len(fresh)))
        so_far += len(fresh)
        clock.step(stats[-1].seconds)
        tell(Event("level_complete", {"level": level, "evaluated": len(fresh), "total_evaluated": so_far, "with_loops": stats[-1].with_loops, "left_out": stats[-1].left_out,
                                      "best": best[0].name, "value": best[0].value, "seconds": stats[-1].seconds, "percent": clock.percent, "seconds_left": clock.remaining}))
    out = SearchResult(sorted(kept.values(), key=sort_key(statistic)), stats, time.perf_counter() - began)
    tell(Event("search_complete", {"models": len(out.candidates), "evaluated": so_far, "best": out.best.name, "value": out.best.value, "seconds": out.seconds}))
    return out


# Estimate of a search's cost ------------------------------------------------------

# Fixed values of the cost model: pull of a statistic towards loops, cap of the chance of a loop, milliseconds per model
# (likely, high) without loops, with loops, and with loops downwards among many variables; share of the likely time in the
# low estimate; use of further cores; upper seconds of the classes of cost.
PULL, PULL_ELSE, MOST_LOOPS = {"ddf": 0.5, "aic": 5.0}, 10.0, 0.95
LOOPLESS_MS, LOOP_MS, LOOP_DOWN_MS, MANY_VARIABLES = (5.0, 20.0), (500.0, 2000.0), (2000.0, 10000.0), 12
LOW_LOOPLESS, LOW_LOOP, CORE_USE = 0.5, 0.3, 0.7
CLASSES = (("fast", 5), ("moderate", 30), ("slow", 300), ("very_slow", 3600))


def expected_triangles(n: int, links: int) -> float:
    """Expected triangles among n variables joined by so many random links."""
    return 4.0 * links**3 * (n - 2) / (3.0 * n**2 * (n - 1) ** 2) if n > 2 and links > 2 else 0.0


def loop_probability(n: int, links: int, statistic: str) -> float:
    """Chance that a model of so many links has a loop, by the statistic that picks the models; a loop takes three links."""
    return min(MOST_LOOPS, 1 - math.exp(-PULL.get(statistic, PULL_ELSE) * expected_triangles(n, links)))


def models_at_level(n: int, level: int, width: int, down: bool = False) -> int:
    """Models to evaluate at a level: the start's neighbours, then those of each seed kept, which get fewer from level to level."""
    pairs = n * (n - 1) // 2
    if level == 1:
        return n if down else pairs
    return width * max(n, pairs - level * width if down else pairs - level)


def estimate(schema: Schema, filter: str = "loopless", statistic: str = "bic", width: int = 3, levels: int = 7, rows: int = 0, direction: str = "up",
             cores: int = 1) -> dict:
    """Models and seconds (likely, low, high) of a search, a class of cost, warnings and advice.

    rows: rows of the frequency table; cores: how many models are evaluated side by side.
    """
    n, cells, down, full = len(schema), schema.cells(), direction == "down", filter == "full"
    scale = (1.0 + rows / 1000.0 + n / 10.0) / (1.0 + (cores - 1) * CORE_USE) / 1000.0
    loop_ms = LOOP_DOWN_MS if down and n > MANY_VARIABLES else LOOP_MS
    per_level, models, loops, seconds = [], 0, 0.0, [0.0, 0.0, 0.0]
    for level in range(1, levels + 1):
        count = models_at_level(n, level, width, down)
        p = loop_probability(n, level, statistic) if full else 0.0
        plain, looped = count * (1 - p), count * p
        likely = (plain * LOOPLESS_MS[0] + looped * loop_ms[0]) * scale
        low = (plain * LOOPLESS_MS[0] * LOW_LOOPLESS + looped * loop_ms[0] * LOW_LOOP) * scale
        high = (plain * LOOPLESS_MS[1] + looped * loop_ms[1]) * scale
        per_level.append({"level": level, "models": count, "loop_probability": p, "seconds": likely})
        models, loops = models + count, loops + looped
        seconds = [x + y for x, y in zip(seconds, (likely, low, high))]
    cost = next((name for name, top in CLASSES if seconds[0] < top), "infeasible")
    warnings, advice = [], []
    if n > 20:
        warnings.append(f"{n} variables make many candidate models")
    if full and cells > 1e9:
        warnings.append(f"{cells} states: fits of models with loops may run out of memory")
        advice.append("take the loopless filter")
        cost = "infeasible"
    elif full and cells > 1e6:
        warnings.append(f"{cells} states: a full search will be slow")
        advice.append("take the loopless filter")
    if full and down and n > 15:
        warnings += ["going down, models with loops have large relations", f"models with loops and relations of over {MAX_LOOP_VARIABLES} variables are left out"]
        advice += ["take the loopless filter", "search upwards"]
    if full and down and n > 10:
        advice.append("choose 10 to 12 variables")
    if cost in ("very_slow", "infeasible"):
        advice += [f"reduce the width to {max(width - 1, 2)}", f"reduce the levels to {max(levels - 2, 3)}"]
    if down and filter in ("loopless", "disjoint"):
        warnings.append("a downward search ends early where no simpler loopless model exists")
    return {"models": models, "loop_models": loops, "neighbours": n if down else n * (n - 1) // 2, "states": cells, "seconds": seconds[0], "seconds_low": seconds[1],
            "seconds_high": seconds[2], "complexity": cost, "levels": per_level, "warnings": warnings, "advice": list(dict.fromkeys(advice))}


# Trees ------------------------------------------------------------------------------

def chow_liu(analyzer: Analyzer) -> list[tuple[int, int, float]]:
    """Edges (i, j, bits) of the tree of greatest mutual information; ties by place."""
    part = list(range(len(analyzer.schema)))
    out = []
    for i, j, mi in analyzer.all_mutual_information():
        if part[i] != part[j]:
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
            out.append((i, j, mi))
    return out


def tree_model(schema: Schema, edges) -> Model:
    """The pairwise model of a tree's edges, with single relations for variables that no edge touches."""
    used = 0
    for i, j, *_ in edges:
        used |= 1 << i | 1 << j
    return Model(schema, [*(1 << i | 1 << j for i, j, *_ in edges), *(1 << k for k in bits(schema.full & ~used))])
