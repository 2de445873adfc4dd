"""Deletions that reach other places: accepted once, tried until they are done, without needing the deleted text again.

A job is a table of ids for one destination and a row in the journal's state: sent or not, attempts, last error, when it is
due. It is told once (send), then its lines are scrubbed, and only then does it leave. A failure puts it off by a minute that
doubles up to an hour, and never stops other jobs. Accepting the same ids for a destination again makes no second job.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.generations import Generations

#: Fixed values, seconds: the first pause and the longest.
FIRST, LONGEST = 60.0, 3600.0


class Journal:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.store, self.clock = spark, Generations(spark, path), clock

    def jobs(self) -> dict[str, dict]:
        return self.store.state().get("jobs", {})

    def accept(self, ids: DataFrame, destination: str) -> str:
        """Keep ids(kind, id) as a job for the destination; the job's name."""
        rows = ids.select("kind", F.col("id").cast("string").alias("id")).distinct()
        # a name of the whole set: hashes of ids add up to it in any order
        total = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("kind", "id").cast("decimal(38,0)")), F.sum(F.xxhash64("id", "kind").cast("decimal(38,0)"))).first()
        job = hashlib.sha256(f"{destination}\0{tuple(map(str, total))}".encode()).hexdigest()
        state = self.store.state()
        if job in state.get("jobs", {}):
            return job
        name = self.store.segment()
        self.store.write(rows, name, "ids")
        entry = {"destination": destination, "segment": name, "sent": False, "attempts": 0, "due": 0.0, "error": None}
        self.store.commit(state, jobs=state.get("jobs", {}) | {job: entry}, segments=[*state["segments"], name])
        return job

    def ids(self, job: str) -> DataFrame:
        return self.store.read([self.jobs()[job]["segment"]], "ids", "kind string, id string")

    def _set(self, job: str, **changes) -> None:
        state = self.store.state()
        jobs = state["jobs"] | {job: state["jobs"][job] | changes}
        self.store.commit(state, jobs=jobs)

    def retry(self, send: Callable[[str, DataFrame], None], scrub: Callable[[str, DataFrame], int], *, wait: bool = False, destination: str | None = None) -> dict:
        """Try all jobs (with wait, those that are due); lines scrubbed and jobs left. send must have delivered when it returns."""
        scrubbed = 0
        for job, entry in self.jobs().items():
            if (destination is not None and entry["destination"] != destination) or (wait and entry["due"] > self.clock()):
                continue
            try:
                ids = self.ids(job)
                if not entry["sent"]:
                    send(entry["destination"], ids)
                    self._set(job, sent=True)  # told once, however often the scrubbing fails
                scrubbed += scrub(entry["destination"], ids)
            except Exception as error:  # noqa: BLE001  a destination that is away must not stop the others
                self._set(job, attempts=entry["attempts"] + 1, error=type(error).__name__, due=self.clock() + min(LONGEST, FIRST * 2 ** min(entry["attempts"], 6)))
            else:
                state = self.store.state()
                left = {k: v for k, v in state["jobs"].items() if k != job}
                self.store.commit(state, jobs=left, segments=[v["segment"] for v in left.values()])
        pending = [e for e in self.jobs().values() if destination in (None, e["destination"])]
        return {"scrubbed": scrubbed, "pending": len(pending)}


def scrub_lines(lines: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """Log lines(kind, id, ...) without those of ids(kind, id), but for lines that tell of deletions; and how many went."""
    doomed = lines.filter("kind <> 'forget'").join(ids.select("id").distinct(), "id", "left_semi")
    kept = lines.join(ids.select("id").distinct(), "id", "left_anti").unionByName(lines.filter("kind = 'forget'").join(ids.select("id").distinct(), "id", "left_semi"))
    return kept, doomed.count()
