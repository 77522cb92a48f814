"""Steps in order, failing closed: the first failure ends the run; a step may also end it without an error."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from datetime import time as clock
from zoneinfo import ZoneInfo


class StepError(RuntimeError):
    """A failure that the step expected."""


@dataclass
class Context:
    as_of: object
    data: dict = field(default_factory=dict)
    stopped: str | None = None

    def stop(self, why: str) -> None:
        self.stopped = why


@dataclass(frozen=True)
class StepResult:
    name: str
    status: str
    seconds: float
    message: str = ""


@dataclass
class Pipeline:
    steps: list[tuple[str, Callable[[Context], None]]]

    def run(self, context: Context) -> list[StepResult]:
        out = []
        for name, step in self.steps:
            began = time.perf_counter()
            try:
                step(context)
                status, message = ("stopped", context.stopped) if context.stopped else ("ok", "")
            except NotImplementedError as e:
                status, message = "not_implemented", str(e)
            except StepError as e:
                status, message = "failed", str(e)
            except Exception as e:  # noqa: BLE001
                status, message = "crashed", f"{type(e).__name__}: {e}"
            out.append(StepResult(name, status, time.perf_counter() - began, message))
            if status != "ok":
                break
        return out


def ok(results: list[StepResult]) -> bool:
    return bool(results) and all(r.status in ("ok", "stopped") for r in results)


def next_runs(regions: dict[str, tuple[clock, str]], now: datetime) -> list[tuple[datetime, str]]:
    """The next run of every region (local time of day, time zone), soonest first."""
    out = []
    for region, (at, zone) in regions.items():
        local = now.astimezone(ZoneInfo(zone))
        run = datetime.combine(local.date(), at, ZoneInfo(zone))
        out.append((run if run > local else datetime.combine(local.date() + timedelta(days=1), at, ZoneInfo(zone)), region))
    return sorted(out)


def serve(regions: dict[str, tuple[clock, str]], run: Callable[[str], None], *, now: Callable[[], datetime], sleep: Callable[[float], None], grace: timedelta = timedelta(hours=1), runs: int | None = None) -> int:
    """Waits for and starts the regions' runs; one that is later than the grace period is left out. How many it started."""
    started = 0
    while runs is None or started < runs:
        at, region = next_runs(regions, now())[0]
        while now() < at:
            sleep(min(60.0, (at - now()).total_seconds()))
        if now() - at <= grace:
            run(region)
        started += 1
    return started
