"""The coordinator's lock: taken by one of several that ask, taken over when its run has ended or its lease has run out.

Takings are numbered files, each created once; the newest one is the lock. Whoever takes it creates the number behind the one that was
looked at, so of those that saw the same lock one succeeds. The number is also a fencing token: an owner that was taken over sees it."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import lock_takeover
from .shared import content_of, create_once, names_in


class Held(RuntimeError):
    """Another owner has the lock."""


@dataclass(frozen=True)
class Lock:
    root: str
    number: int
    owner: str
    acquired: str


def _text(moment: dt.datetime) -> str:
    return moment.astimezone(dt.timezone.utc).isoformat(timespec="microseconds")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def current(spark: SparkSession, root: str) -> Lock | None:
    """The newest taking, released or not."""
    taken = names_in(spark, f"{root}/takings")
    if not taken:
        return None
    own = json.loads(content_of(spark, f"{root}/takings/{taken[-1]}"))
    return Lock(root, int(taken[-1]), own["owner"], own["acquired"])


def released(spark: SparkSession, lock: Lock) -> bool:
    return content_of(spark, f"{lock.root}/released/{lock.number:012d}") is not None


def last_sign(spark: SparkSession, lock: Lock) -> str:
    """Time of the lock's last heartbeat, or of its taking."""
    beats = names_in(spark, f"{lock.root}/beats/{lock.number:012d}")
    return max(lock.acquired, beats[-1].replace("_", ":")) if beats else lock.acquired


def acquire(spark: SparkSession, root: str, owner: str, run_status: str = "running", now: dt.datetime | None = None, ttl: int = 7200, grace: int = 600, lease: int = 900) -> Lock:
    """Takes the lock, or raises Held. A lock that isn't released may be taken where lock_takeover allows it: by the status of its
    run, and by the age of its last sign."""
    now = now or _now()
    before = current(spark, root)
    if before and not released(spark, before):
        free = lock_takeover(F.lit(run_status), F.lit(last_sign(spark, before)), F.lit(_text(now)).cast("timestamp"), F.lit(ttl), F.lit(grace), F.lit(lease))
        if not spark.range(1).select(free.alias("free")).first()["free"]:
            raise Held(before.owner)
    number, moment = (before.number if before else 0) + 1, _text(now)
    if not create_once(spark, f"{root}/takings/{number:012d}", json.dumps({"owner": owner, "acquired": moment})):
        raise Held(current(spark, root).owner)
    return Lock(root, number, owner, moment)


def holds(spark: SparkSession, lock: Lock) -> bool:
    """Whether lock is still the newest taking and isn't released."""
    return current(spark, lock.root).number == lock.number and not released(spark, lock)


def heartbeat(spark: SparkSession, lock: Lock, now: dt.datetime | None = None) -> None:
    """Says that the owner is there; Held where it has been taken over or was released."""
    if not holds(spark, lock):
        raise Held(current(spark, lock.root).owner)
    create_once(spark, f"{lock.root}/beats/{lock.number:012d}/{_text(now or _now()).replace(':', '_')}", lock.owner)


def release(spark: SparkSession, lock: Lock) -> bool:
    """Gives the lock back; False if it was given back before. What was taken over since stays taken."""
    return create_once(spark, f"{lock.root}/released/{lock.number:012d}", lock.owner)
