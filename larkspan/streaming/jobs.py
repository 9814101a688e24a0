"""Jobs as a stream: life cycle, progress, stalls and removal, each job's state in a processor with timers.

Messages (job, ts, kind, ok, n, total). kinds: start (only a pending job starts); done, failed, cancel (the first one ends the job);
set, add, total (progress); item (a worker's report on one row: ok or not) and poll (n: rows done by the counter that loses
nothing; what it counts beyond the reports was lost and counts as failed). A job that has reports or polls is done when
they reach its total. A running job stalls where `stall` minutes pass without anything that moves it, and an ended one is
forgotten `keep` minutes after its end; a message that comes later begins the job anew.

Both are decided by the times of messages, whether a timer or the next message finds it first, so results don't depend on how a log is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspan.streaming.runs import last_of

MINUTE = 60_000_000
FINAL = {"done": "done", "failed": "failed", "cancel": "cancelled"}
ENDED = (*FINAL.values(), "stalled")
STATE = "status string, last_at bigint, ended_at bigint, version bigint, progress bigint, total bigint, updated bigint, failed bigint, lost bigint, top bigint"
UPDATE = "job bigint, status string, progress bigint, total bigint, updated bigint, failed bigint, lost bigint, current bigint, last_at bigint, ended_at bigint, version bigint"


@dataclass
class Job:
    status: str = "pending"
    last_at: int | None = None
    ended_at: int | None = None
    version: int = 0
    progress: int = 0
    total: int = 0
    updated: int = 0
    failed: int = 0
    lost: int = 0
    top: int = 0

    @property
    def current(self) -> int:
        return self.updated + self.failed + self.lost

    def take(self, at: int, kind: str, ok: bool | None, n: int | None, total: int | None, stall: int | None, keep: int | None) -> Job:
        """The job after one message; a new one if this one is over and forgotten by then."""
        job = self
        if job.overdue(at, stall):
            job.stalled(stall)
        if job.ended_at is not None:
            if keep is None or at <= job.ended_at + keep:
                return job
            job = Job(version=job.version)
        if total is not None:
            job.total = total
        if kind in FINAL:
            job.status, job.ended_at = FINAL[kind], at
            return job
        if kind == "poll" and n <= job.top:
            return job
        job.last_at = at
        if kind == "start" and job.status == "pending":
            job.status = "running"
        elif kind == "set":
            job.progress = n
        elif kind == "add":
            job.progress += n
        elif kind == "total":
            job.total = n
        elif kind == "item":
            job.updated, job.failed = job.updated + bool(ok), job.failed + (not ok)
        elif kind == "poll":
            job.top = n
            job.lost = max(job.lost, n - job.updated - job.failed)
        if kind in ("item", "poll"):
            if job.status == "pending":
                job.status = "running"
            if job.total and job.current >= job.total:
                job.status, job.ended_at = "done", at
        return job

    def overdue(self, at: int, stall: int | None) -> bool:
        return stall is not None and self.ended_at is None and self.last_at is not None and at > self.last_at + stall

    def stalled(self, stall: int) -> None:
        self.status, self.ended_at = "stalled", self.last_at + stall

    def timer(self, stall: int | None, keep: int | None) -> int | None:
        """The first millisecond in which time alone changes the job."""
        if self.ended_at is not None:
            due = None if keep is None else self.ended_at + keep
        else:
            due = None if stall is None or self.last_at is None else self.last_at + stall
        return None if due is None else due // 1000 + 1


class JobMachine(StatefulProcessor):
    """Folds each job's messages into its state; emits the job after every batch that has some, when it stalls and when it goes.

    Jobs are many and their messages few: messages come as rows, not as a frame for each job, and a job's state is one value.
    """

    def __init__(self, stall: int | None, keep: int | None, order: list[str]) -> None:
        self.stall, self.keep, self.order = stall, keep, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _load(self) -> Job | None:
        found = self.state.get()
        return None if found is None else Job(*found)

    def _save(self, key: tuple, job: Job, timer: int | None) -> Row:
        job.version += 1
        due = job.timer(self.stall, self.keep)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((job.status, job.last_at, job.ended_at, job.version, job.progress, job.total, job.updated, job.failed, job.lost, job.top))
        return self._row(key, job, job.status)

    def _row(self, key: tuple, job: Job, status: str) -> Row:
        return Row(job=key[0], status=status, progress=job.progress, total=job.total, updated=job.updated, failed=job.failed, lost=job.lost, current=job.current, last_at=job.last_at, ended_at=job.ended_at, version=job.version)

    def _place(self, message: Row) -> tuple:
        """By what a message is put in order: nulls after all others."""
        return tuple((x is None, x) for x in (message[c] for c in self.order))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        job = self._load() or Job()
        timer = job.timer(self.stall, self.keep)
        for m in sorted(rows, key=self._place):
            job = job.take(m["at"], m["kind"], m["ok"], m["n"], m["total"], self.stall, self.keep)
        yield self._save(key, job, timer)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        job = self._load()
        if job is None:
            return
        if job.ended_at is None:
            job.stalled(self.stall)
            due = job.timer(self.stall, self.keep)
            if due is None or due > timerValues.getCurrentWatermarkInMs():
                yield self._save(key, job, None)  # the timer that fired is gone
                return
        self.state.clear()
        job.version += 1
        yield self._row(key, job, "removed")

    def close(self) -> None:
        pass


def job_updates(messages: DataFrame, stall_minutes: int | None = 10, keep_minutes: int | None = 30, order: tuple[str, ...] = ("at", "n"), late: str = "0 seconds") -> DataFrame:
    """Jobs as a stream of messages changes them: job, status (pending, running, done, failed, cancelled, stalled, removed), progress, total, updated, failed, lost, current, last_at, ended_at (microseconds), version.

    `order` puts a job's messages of one batch in order (at is the time in microseconds); messages may be `late` by so much.
    """
    names = {c.lower() for c in messages.columns}
    missing = {"ok": "boolean", "n": "bigint", "total": "bigint"}
    rows = messages.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in names})
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    extra = [c for c in order if c not in ("at", "kind", "n")]
    rows = rows.select(F.col("job").cast("bigint").alias("job"), "ts", F.unix_micros("ts").alias("at"), "kind", "ok", F.col("n").cast("bigint").alias("n"), F.col("total").cast("bigint").alias("total"), *extra)
    minutes = lambda m: None if m is None else m * MINUTE
    return rows.groupBy("job").transformWithState(JobMachine(minutes(stall_minutes), minutes(keep_minutes), list(order)), UPDATE, "update", "eventTime")


def job_board(updates: DataFrame) -> DataFrame:
    """Each job that isn't forgotten, as its last update has it; updates: those of job_updates with their batch."""
    return last_of(updates, "job", within="version").where("status <> 'removed'").drop("version")
