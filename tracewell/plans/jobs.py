"""A graph of actions on the driver, retries, and a registry of named jobs."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field


def retry(action: Callable[[], object], retries: int = 3, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The action's result; after a failure again, `retries` times at most, after waits that double."""
    for n in range(retries + 1):
        try:
            return action()
        except Exception:
            if n == retries:
                raise
            sleep(first_wait * 2**n)


@dataclass
class Job:
    name: str
    action: Callable[[], object]
    after: tuple[str, ...] = ()


@dataclass
class JobGraph:
    """Runs jobs after those they depend on, several at a time. A job after a failed one isn't run and counts as failed."""

    jobs: dict[str, Job] = field(default_factory=dict)
    state: dict[str, str] = field(default_factory=dict)
    results: dict[str, object] = field(default_factory=dict)

    def add(self, name: str, action: Callable[[], object], *after: str) -> None:
        self.jobs[name], self.state[name] = Job(name, action, after), "waiting"

    def named(self, state: str) -> list[str]:
        return sorted(n for n, s in self.state.items() if s == state)

    def run(self, at_once: int = 4) -> dict[str, str]:
        running: dict[Future, str] = {}
        with ThreadPoolExecutor(at_once) as pool:
            while True:
                changed = True
                while changed:
                    changed = False
                    for name in self.named("waiting"):
                        before = [self.state.get(a, "failed") for a in self.jobs[name].after]
                        if "failed" in before:
                            self.state[name], changed = "failed", True
                        elif all(s == "successful" for s in before):
                            self.state[name] = "running"
                            running[pool.submit(self.jobs[name].action)] = name
                if not running:
                    break
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    name = running.pop(f)
                    self.state[name] = "failed" if f.exception() else "successful"
                    self.results[name] = f.exception() or f.result()
            for name in self.named("waiting"):  # a cycle
                self.state[name] = "failed"
        return self.state


#: Settings for a cluster: speculation runs a second attempt of a task only while it has one. A corrupt file is an error: its rows would be lost unseen.
SETTINGS = {
    "spark.speculation": "true",
    "spark.task.maxFailures": "4",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
