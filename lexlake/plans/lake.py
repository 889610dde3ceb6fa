"""All tables and services of one vocabulary, and the runs over them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions.columns import timestamp_lit, to_micros
from lexlake.operators.enrichment import Definer, Translator, UsageFinder
from lexlake.operators.retries import RetryPolicy
from lexlake.plans import jobs
from lexlake.sources.append_tables import AppendTable
from lexlake.sources.keyed_tables import KeyedTable
from lexlake.sources.sheet_store import SheetStore
from lexlake.spec import BRONZE, GOLDEN, RETRIES, SILVER, STAGE, VOCABULARY_SHEET, WORKLIST_SHEET


@dataclass
class Lake:
    stage: AppendTable
    bronze: KeyedTable
    silver: KeyedTable
    golden: KeyedTable
    vocabulary: SheetStore
    worklist: SheetStore
    define: Definer
    translate: Translator
    find_usage: UsageFinder
    fill_missing: bool = False
    worklist_match: str = "substring"
    # with a schedule, undefined tokens are asked for again when they are due, else in every run that retries
    retries: KeyedTable | None = None
    retry_policy: RetryPolicy = RetryPolicy()

    @classmethod
    def at(
        cls,
        spark: SparkSession,
        path: str,
        define: Definer,
        translate: Translator,
        find_usage: UsageFinder,
        buckets: int | None = None,
        stage_format: str = "csv",
        retry_policy: RetryPolicy | None = None,
        **settings,
    ) -> Lake:
        """Open the lake below ``path``, creating what is missing; ``retry_policy`` makes it keep a schedule of retries."""
        if retry_policy is not None:
            retries = KeyedTable(spark, RETRIES, f"{path}/retries", buckets)
            settings = {**settings, "retries": retries, "retry_policy": retry_policy}
        return cls(
            stage=AppendTable(spark, STAGE, f"{path}/stage", file_format=stage_format),
            bronze=KeyedTable(spark, BRONZE, f"{path}/bronze", buckets),
            silver=KeyedTable(spark, SILVER, f"{path}/silver", buckets),
            golden=KeyedTable(spark, GOLDEN, f"{path}/golden", buckets),
            vocabulary=SheetStore(spark, VOCABULARY_SHEET, f"{path}/vocabulary", keep=5),
            worklist=SheetStore(spark, WORKLIST_SHEET, f"{path}/worklist", keep=0),
            define=define,
            translate=translate,
            find_usage=find_usage,
            **settings,
        )

    def update_internal(
        self, marks: DataFrame, now: datetime, in_order: bool = True, retry: bool = True
    ) -> DataFrame:
        """marks -> stage -> bronze -> silver -> golden; returns golden.

        ``in_order`` tells whether marks come by rising ids (see `update_stage`), ``retry`` whether tokens that stayed
        undefined are asked for again. Every run needs a later ``now`` than the one before, as updates are found by
        their stamps.
        """
        self.check_clock(now)
        staged = jobs.update_stage(marks, self.stage, now, in_order)
        jobs.update_bronze(staged, self.bronze, now)
        jobs.update_silver(
            self.bronze, self.silver, self.define, now, self.fill_missing, retry, self.retries, self.retry_policy
        )
        return jobs.update_golden(self.silver, self.golden, self.translate, self.find_usage, now)

    def retry_due(self, now: datetime) -> bool:
        """Whether a token with a schedule is due."""
        return self.retries is not None and not self.retries.snapshot().where(F.col("dueAt") <= timestamp_lit(now)).isEmpty()

    def check_clock(self, now: datetime) -> None:
        """Refuse a run that is not later than every stored stamp: its updates would be missed downstream."""
        stamps = [t.newest_stamp() for t in (self.stage, self.bronze, self.silver, self.golden)]
        newest = max((s for s in stamps if s is not None), default=None)
        if newest is not None and to_micros(now) <= newest:
            raise ValueError(f"{now} is not later than the last run")

    def update_all(self, marks: DataFrame, now: datetime) -> DataFrame:
        """Update the tables, publish the vocabulary and rewrite the worklist; returns the worklist."""
        golden = self.update_internal(marks, now)
        published = jobs.update_vocabulary(golden, self.vocabulary, align=self.golden.aligned)
        return jobs.update_worklist(self.silver.snapshot(), published, self.worklist, self.worklist_match)
