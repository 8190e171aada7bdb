"""An index on disk that grows by the videos it lacks and is switched from one state to the next in one step.

Each growth is a generation: its tables below a folder of its own, in directories by shard (a hash of video_key). The file
CURRENT names the generations that make up the index; it is replaced by a rename when all tables of a new one are written, so
a build that stops leaves the index as it was. Retrieval joins questions by shard too: with few questions, whose size is
measured, the index is neither shuffled nor read but for the shards they ask for, which dynamic pruning finds at run time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.config import RetrievalConfig
from chronoreel.operators.retrieve import evidence_frames, low_candidates, top_segments
from chronoreel.plans.pipeline import VideoIndex
from chronoreel.plans.store import written_once
from chronoreel.sources.files import _children, store_of

TABLES = ("videos", "signals", "high", "low")
SHARDS = 64
#: Questions and evidence of up to so many bytes, measured, are broadcast.
SMALL = 16 << 20


def _small(df: DataFrame) -> DataFrame:
    """``df`` written once, and broadcast if it is small."""
    kept = written_once(df)
    width = [F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.coalesce(F.array_size(c), F.lit(0)) * 8 if kind.startswith("array") else F.lit(8) for c, kind in kept.dtypes]
    size = kept.agg(F.sum(sum(width, F.lit(16)))).first()[0] or 0
    return F.broadcast(kept) if size <= SMALL else kept


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, shards: int = SHARDS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        known = self._current()
        self.shards = known["shards"] if known else shards

    def _current(self) -> dict | None:
        fs, base = store_of(self.root)
        if "CURRENT" not in (_children(fs, base) or {}):
            return None
        with fs.open_input_file(f"{base}/CURRENT") as file:
            return json.loads(file.read())

    def _switch(self, generations: list[str]) -> None:
        """Name the generations; a reader sees the old list or the new one."""
        fs, base = store_of(self.root)
        fs.create_dir(base, recursive=True)
        made = f"{base}/_CURRENT-{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as file:
            file.write(json.dumps({"shards": self.shards, "generations": generations}).encode())
        fs.move(made, f"{base}/CURRENT")

    def shard(self, key: str = "video_key") -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.shards)).cast("int")

    def generations(self) -> list[str]:
        known = self._current()
        return known["generations"] if known else []

    def table(self, name: str) -> DataFrame:
        """One table of the index in its present state, with shard."""
        paths = [f"{self.root}/{g}/{name}" for g in self.generations()]
        if not paths:
            raise FileNotFoundError(f"{self.root} has no index yet")
        out = None
        # A path each, as generations are partitioned alike below roots of their own.
        for path in paths:
            rows = self.spark.read.parquet(path)
            out = rows if out is None else out.unionByName(rows)
        return out

    def index(self) -> VideoIndex:
        return VideoIndex(*(self.table(n) for n in TABLES[1:]))

    def grow(self, frames: DataFrame, build: Callable[[DataFrame], VideoIndex]) -> int:
        """Index the videos of ``frames`` that are not in the index yet; how many there were."""
        lacking = frames if not self.generations() else frames.join(self.table("videos").select("video_key"), "video_key", "left_anti")
        videos = written_once(lacking.select("video_key").distinct())
        n = videos.count()
        if n:
            self._write(videos, build(lacking), self.generations())
        return n

    def _write(self, videos: DataFrame, index: VideoIndex, before: list[str]) -> None:
        name = f"g-{uuid.uuid4().hex}"
        for table, rows in zip(TABLES, (videos, index.signals, index.high, index.low), strict=True):
            dealt = rows.drop("shard").withColumn("shard", self.shard()).repartition("shard", F.pmod(F.xxhash64("video_key", F.lit(1)), F.lit(8)))
            dealt.sortWithinPartitions("shard", "video_key").write.partitionBy("shard").parquet(f"{self.root}/{name}/{table}")
        self._switch([*before, name])

    def compact(self) -> None:
        """All generations as one; the old ones stay until ``vacuum``."""
        self._write(self.table("videos"), self.index(), [])

    def vacuum(self) -> list[str]:
        """Delete the generations that the index does not name: those of stopped builds and from before ``compact``. No build or reader may be at work."""
        fs, base = store_of(self.root)
        named = set(self.generations())
        gone = [x for x in (_children(fs, base) or {}) if x.startswith(("g-", "_CURRENT-")) and x not in named]
        for x in gone:
            fs.delete_dir(f"{base}/{x}") if x.startswith("g-") else fs.delete_file(f"{base}/{x}")
        return sorted(gone)

    def retrieve(self, questions: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> dict[str, DataFrame]:
        """high_hits, low_hits and evidence for questions (video_key, question_id, query); see ``pipeline.retrieve``."""
        asked = _small(questions.select("video_key", "question_id", "query").withColumn("shard", self.shard()))
        index = self.index()
        high = written_once(top_segments(index.high, asked, config.top_high))
        low = written_once(low_candidates(high, index.low, asked, config.top_low))
        return {"high_hits": high, "low_hits": low, "evidence": evidence_frames(low, index.signals, config.max_evidence_frames, lambda rows: _small(rows.withColumn("shard", self.shard())))}
