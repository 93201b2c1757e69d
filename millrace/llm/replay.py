"""Replay of conversations: quarantine, repair, retry and cascading release.

Every turn is a vertex; its edge leads from an earlier turn of the conversation,
its parent, which has to be delivered first. A vertex program runs over
co-partitioned RDDs: a vertex that was delivered sends its time to its children,
a dead or blocked one sends a block; a vertex acts once its parent has spoken.
Vertices lie in blocks of neighbouring places, one record each, and a superstep
carries a block as far as the messages that it has allow; only edges between
blocks cross partitions. A conversation of any length is thereby many records,
and supersteps are as many as the longest chain has blocks. They go on until no
vertex is active. Finished blocks are written as they finish; waiting ones are
checkpointed in the shared folder, so lost executors cost one superstep.

Places before the replay and release numbers after it are ranks within
conversations of any size (``ranks``).

Defined results: turns of one number are ordered by the CRC-32 of their text;
repeated rows each are turns of their own. Null ids read as empty strings in the
hash; rows without a conversation form one, and a null turn comes first. A null
text is empty. Other columns are not read. An empty table gives no rows. state
is of 64 bits and wraps around, which takes some 90,000 delivered turns in one
conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.rdd import RDD, portable_hash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, shared_dir, written
from millrace.llm.ranks import ranked

#: Places of one block; a parent is at most REACH places before its child.
BLOCK, REACH = 64, 4
#: Seconds between arrivals, failures that make a turn dead, and the first wait.
GAP, MOST, WAIT = 7, 6, 20

#: A conversation: whether it has no id, and the id.
GROUP = ["nameless", "conv"]
DELIVERED, DEAD, BLOCKED = "delivered", "dead", "blocked"
_RESULT = "nameless long, conv long, turn long, p long, crc long, status string, attempts int, first_at long, last_at long"


def vertices(turns: DataFrame) -> DataFrame:
    """Turns with their rank (from 1, written) and the outcome of their hashes.

    distance: places to the parent. repair: seconds from arrival to repair, -1
    where the turn isn't faulty. fails: bit a - 1 says that attempt a fails
    though the turn is repaired.
    """

    def h(k: int):
        return F.crc32(F.concat(F.lit(f"{k}:"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(""))).cast("binary"))

    rows = turns.select("conv_id", "turn", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"))
    rows = rows.select(
        F.col("conv_id").isNull().cast("long").alias("nameless"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        "crc",
        (h(0) % 5).cast("int").alias("distance"),
        F.when(h(1) % 101 < 50, h(2) % 101).otherwise(-1).cast("int").alias("repair"),
        sum((F.when(h(a + 2) % 3 == 0, 1 << (a - 1)).otherwise(0) for a in range(1, MOST + 1)), F.lit(0)).cast("int").alias("fails"),
    )
    return ranked(rows, GROUP, ["turn", "crc"])


def attempt(start: int, arrival: int, repair: int, fails: int) -> tuple[str, int, int, int]:
    """status, attempts, first_at and last_at of a turn whose first attempt comes at ``start``."""
    at = start
    for a in range(1, MOST + 1):
        if repair < 0 or (at >= arrival + repair and not fails >> (a - 1) & 1):
            return DELIVERED, a, start, at
        if a < MOST:
            at += WAIT << (a - 1)
    return DEAD, MOST, start, at


class Block:
    """Neighbouring turns of a conversation: those that are settled, and those that wait for a message."""

    def __init__(self, turns: list[tuple], size: int):
        self.size = size
        #: (p, turn, crc, distance, repair, fails) by p
        self.turns = sorted(turns)
        #: p to (status, attempts, first_at, last_at), of this block's turns and of parents before it
        self.told: dict[int, tuple] = {}
        self.active = True

    def advance(self, messages: list[tuple[int, tuple]]) -> Iterator[tuple[int, int, tuple]]:
        """Acts on the messages (parent's place, outcome); gives (block, place, outcome) for children beyond it."""
        told = self.told
        told.update(messages)
        self.active = False
        for p, _, _, distance, repair, fails in self.turns:
            if p in told:
                continue
            parent = p - distance if 0 < distance <= p else None
            if parent is not None and parent not in told:
                self.active = True
                continue
            arrival, above = GAP * p, told[parent] if parent is not None else None
            if above is not None and above[0] != DELIVERED:
                told[p] = (BLOCKED, 0, None, None)
            else:
                told[p] = attempt(max(arrival, above[3]) if above else arrival, arrival, repair, fails)
            # Children in the next block can't be seen from here: it takes what its own edges lead to.
            if (p + REACH) // self.size > p // self.size:
                yield p // self.size + 1, p, told[p]

    def rows(self) -> Iterator[tuple]:
        for p, turn, crc, *_ in self.turns:
            yield turn, p, crc, *self.told[p]


def _is_block(record: tuple) -> bool:
    return isinstance(record[1], Block)


def _superstep(records: Iterator[tuple]) -> Iterator[tuple]:
    # A partition's messages come before its blocks.
    inbox: dict[tuple, list] = {}
    for key, value in records:
        if isinstance(value, Block):
            own = inbox.pop(key, [])
            sent = list(value.advance(own)) if own or not value.told else []
            yield key, value
            yield from (((*key[:2], block), (p, outcome)) for block, p, outcome in sent)
        else:
            inbox.setdefault(key, []).append(value)


def _results(record: tuple) -> Iterator[tuple]:
    (nameless, conv, _), block = record
    yield from ((nameless, conv, *row) for row in block.rows())


def outcomes(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """status, attempts, first_at and last_at of every vertex, by supersteps over blocks of ``size`` places (REACH at least)."""
    spark = rows.sparkSession
    shared_dir(spark)
    p = F.col("rank") - 1
    turn = F.struct(p.alias("p"), "turn", "crc", "distance", "repair", "fails")
    blocks = rows.groupBy(*GROUP, F.floor(p / size).alias("block")).agg(F.collect_list(turn).alias("turns"))  # size turns at most
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vertices_ = blocks.rdd.map(lambda r: ((r.nameless, r.conv, r.block), Block([tuple(t) for t in r.turns], size))).partitionBy(parts, portable_hash)
    messages: RDD | None = None
    finished: list[DataFrame] = []
    held: list[RDD] = []
    while True:
        # Blocks stay in their partitions; only messages are dealt out, by the same keys.
        inputs = vertices_ if messages is None else messages.partitionBy(parts, portable_hash).union(vertices_)
        step = inputs.mapPartitions(_superstep, preservesPartitioning=True).persist(StorageLevel.DISK_ONLY)
        done = step.filter(lambda r: _is_block(r) and not r[1].active).flatMap(_results)
        finished.append(written(spark.createDataFrame(done, _RESULT, verifySchema=False), "finished"))
        rest = step.filter(lambda r: not _is_block(r) or r[1].active)
        rest.checkpoint()
        # Two numbers: waiting blocks, and messages under way.
        kinds = rest.map(_is_block).countByValue()
        for old in held:
            old.unpersist()
        held = [step]
        if not kinds[True]:
            step.unpersist()
            break
        if not kinds[False]:
            raise RuntimeError("blocks wait for messages that nobody sends")
        # Messages have keys of other partitions: flatMap gives up the partitioning that filter would keep.
        vertices_, messages = rest.filter(_is_block), rest.flatMap(lambda r: [] if _is_block(r) else [r])
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def replay(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no and state of every turn."""
    placed = vertices(turns)
    outcome = outcomes(placed, size)
    dropped(placed)
    numbered = ranked(outcome.where(F.col("status") == DELIVERED), GROUP, ["last_at", "turn", "p"], weight="crc")
    rest = outcome.where(F.col("status") != DELIVERED).withColumns({"rank": F.lit(None).cast("long"), "total": F.lit(None).cast("long")})
    conv = F.when(F.col("nameless") == 0, F.col("conv")).alias("conv_id")
    return numbered.unionByName(rest).select(conv, "turn", "status", "attempts", "first_at", "last_at", F.col("rank").alias("release_no"), F.col("total").alias("state"))
