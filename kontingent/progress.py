"""Progress events, timing helpers and run-time estimates."""

from __future__ import annotations

import json
import platform
import statistics
import time
from collections import deque
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field


@dataclass
class Event:
    """kind: search_started, level_started, model_batch, ipf_sweep, ipf, level_complete, search_complete, search_cancelled, error.

    level_complete tells models evaluated in the level and so far, those with loops, the best one, seconds, and the percentage
    and seconds left by the mean of the levels before.
    """

    kind: str
    data: dict = field(default_factory=dict)
    at: float = field(default_factory=time.time)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


class Progress:
    """Collects events, and passes them on unless quiet."""

    def __init__(self, sink=None, quiet: bool = False):
        self.sink, self.quiet, self.events = sink, quiet, []

    def __call__(self, event: Event) -> None:
        self.events.append(event)
        if self.sink and not self.quiet:
            self.sink(event)


def format_duration(seconds: float) -> str:
    if seconds < 1e-3:
        return f"{seconds * 1e6:.0f}us"
    if seconds < 1:
        return f"{seconds * 1e3:.1f}ms"
    if seconds < 60:
        return f"{seconds:.2f}s"
    minutes, rest = divmod(int(round(seconds)), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes}m {rest}s" if hours else f"{minutes}m {rest}s"


def upper_median(x) -> float:
    return sorted(x)[len(x) // 2] if x else 0.0


def sample_stdev(x) -> float:
    return statistics.stdev(x) if len(x) > 1 else 0.0


class RuntimeEstimator:
    """Remaining time from the mean of the last ``window`` steps."""

    def __init__(self, total: int, window: int = 50):
        self.total, self.done, self.times = total, 0, deque(maxlen=window)

    def step(self, seconds: float) -> None:
        self.times.append(seconds)
        self.done += 1

    @property
    def percent(self) -> float:
        return 100.0 * self.done / self.total if self.total else 100.0

    @property
    def remaining(self) -> float:
        return (self.total - self.done) * sum(self.times) / len(self.times) if self.times else float("nan")


@contextmanager
def timed(into: dict, name: str):
    began = time.perf_counter()
    try:
        yield
    finally:
        into.setdefault(name, []).append(time.perf_counter() - began)


def benchmark_record(name: str, times) -> dict:
    return {"name": name, "runs": len(times), "median": upper_median(times), "mean": sum(times) / max(1, len(times)), "stdev": sample_stdev(times),
            "least": min(times, default=0.0), "most": max(times, default=0.0)}


def save_records(path: str, records: list[dict]) -> None:
    with open(path, "w") as f:
        json.dump({"system": {"python": platform.python_version(), "machine": platform.machine()}, "records": records}, f, indent=1)


def load_records(path: str) -> list[dict]:
    with open(path) as f:
        return json.load(f)["records"]


# What Spark did, by tag -------------------------------------------------------------------

# The figures of a stage that a profile adds up, and those of which it keeps the largest.
STAGE_SUMS = {"shuffle_write_bytes": "shuffleWriteBytes", "shuffle_write_rows": "shuffleWriteRecords", "shuffle_read_rows": "shuffleReadRecords", "input_rows": "inputRecords",
              "spilled_bytes": "diskBytesSpilled", "task_ms": "executorRunTime", "tasks": "numTasks"}
STAGE_PEAKS = {"peak_memory_bytes": "peakExecutionMemory"}


@contextmanager
def tagged(spark, *tags: str):
    """Jobs that this thread starts meanwhile carry the tags."""
    sc = spark.sparkContext
    own = [t for t in tags if t and t not in sc.getJobTags()]
    for t in own:
        sc.addJobTag(t)
    try:
        yield
    finally:
        for t in own:
            sc.removeJobTag(t)


def stage_figures(spark, tag: str) -> dict:
    """Sums and peaks over the finished stages of all jobs with the tag, from Spark's own status store.

    The store keeps the last ``spark.ui.retainedStages`` stages, so read it while they are fresh.
    """
    sc = spark.sparkContext
    jsc, jvm = sc._jsc.sc(), sc._jvm
    jsc.listenerBus().waitUntilEmpty()
    store = jsc.statusStore()
    jobs = store.jobsList(None)
    stages, n_jobs = set(), 0
    for k in range(jobs.size()):
        job = jobs.apply(k)
        if job.jobTags().contains(tag):
            n_jobs += 1
            stages |= {job.stageIds().apply(i) for i in range(job.stageIds().size())}
    out = {"jobs": n_jobs, "stages": 0} | dict.fromkeys([*STAGE_SUMS, *STAGE_PEAKS], 0)
    found = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    for k in range(found.size()):
        stage = found.apply(k)
        if stage.stageId() in stages and stage.status().toString() in ("COMPLETE", "FAILED"):
            out["stages"] += 1
            for name, getter in STAGE_SUMS.items():
                out[name] += getattr(stage, getter)()
            for name, getter in STAGE_PEAKS.items():
                out[name] = max(out[name], getattr(stage, getter)())
    return out


@dataclass
class LevelProfile:
    """One level of a search: its models, the time it took, what Spark did for it, and the driver's largest memory so far."""

    level: int
    generated: int = 0
    evaluated: int = 0
    with_loops: int = 0
    seconds: float = 0.0
    driver_peak_bytes: int = 0
    spark: dict = field(default_factory=dict)


@dataclass
class SearchProfile:
    """What a search took, level by level, and by operation."""

    name: str
    seconds: float = 0.0
    models: int = 0
    levels: list[LevelProfile] = field(default_factory=list)
    operations: dict = field(default_factory=dict)
    cache: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str) -> None:
        """A JSON file that ``load_records`` reads as one record, and ``load_profile`` as a profile."""
        save_records(path, [self.to_dict()])


def load_profile(path: str) -> SearchProfile:
    record = load_records(path)[0]
    return SearchProfile(**record | {"levels": [LevelProfile(**x) for x in record["levels"]]})


def driver_peak() -> int:
    """Bytes of the Python driver's largest resident set."""
    import resource

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
