"""Ask an external service once per distinct request and keep its answers in a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions import fixed_values as fixed
from lexlake.functions.columns import definition_request, usage_request
from lexlake.operators.responses import flatten_definitions, flatten_translations, flatten_usage
from lexlake.operators.translations import attach_translations
from lexlake.operators.usage import USAGE_KEYS, attach_usage, request_keys
from lexlake.session import written
from lexlake.sources.append_tables import check_location, ensure_database
from lexlake.sources.files import bucket_folder, qualify
from lexlake.spec import UPDATED_AT

# status recorded when the TLS handshake with the service fails, and when a call ends in any other error
TLS_FAILURE = -1
CALL_FAILURE = -2
# seconds a round sends before its answers are stored
ROUND_SECONDS = 600.0

# one request -> (status, body); built once per task from the request rate the task may use
Fetch = Callable[[str], tuple[int, str | None]]
Connect = Callable[[float | None], Fetch]
# adds a `response` column to rows that carry a `request`
Lookup = Callable[[DataFrame], DataFrame]
# the three pluggable services
Definer = Callable[[DataFrame], DataFrame]
Translator = Callable[[DataFrame], DataFrame]
UsageFinder = Callable[[DataFrame], DataFrame]


class EnrichmentError(RuntimeError):
    """A service answered in a way that must stop the run."""


@dataclass(frozen=True)
class ResponsePolicy:
    """What to do with an answer: a struct column (outcome, value, reason) over status, body and attempt.

    ``limits`` are the statuses after which a task stops sending until the pause is over.
    """

    name: str
    pause_seconds: int
    decide: Callable[[Column, Column, Column], Column]
    limits: tuple[int, ...] = (429,)


def _outcome(outcome: str, value: Column | None = None, reason: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(outcome).alias("outcome"),
        (text if value is None else value).alias("value"),
        (text if reason is None else reason).alias("reason"),
    )


def _unexpected(status: Column, body: Column) -> Column:
    return _outcome("fail", reason=F.format_string("unexpected status `%s`, body `%s`", status, body))


def _decide_definition(status: Column, body: Column, attempt: Column) -> Column:
    tls_retries = 3
    return (
        F.when(status == 200, _outcome("value", body))
        .when(status == 429, _outcome("retry"))
        .when(status == 404, _outcome("value", F.lit("")))
        .when((status == TLS_FAILURE) & (attempt < tls_retries), _outcome("retry"))
        .when(
            status == TLS_FAILURE,
            _outcome("fail", reason=F.lit(f"TLS handshake failed in `{tls_retries}` attempts")),
        )
        .otherwise(_unexpected(status, body))
    )


def _decide_translation(status: Column, body: Column, attempt: Column) -> Column:
    retries = 3
    error = F.from_json(body, "error struct<code: bigint, message: string>")["error"]
    temporary = error["code"].isin(500000, 503000)
    return (
        F.when(status == 200, _outcome("value", body))
        .when(
            F.trim(F.coalesce(body, F.lit(""))) == "",
            _outcome("fail", reason=F.format_string("status `%s` and empty body", status)),
        )
        .when(
            error["code"].isNull(),
            _outcome("fail", reason=F.format_string("status `%s` and unknown body structure `%s`", status, body)),
        )
        .when(temporary & (attempt <= retries), _outcome("retry"))
        .otherwise(
            _outcome(
                "fail",
                reason=F.format_string(
                    "status `%s`, service error `%s`, `%s`, after `%s` retries",
                    status,
                    error["code"],
                    error["message"],
                    attempt - 1,
                ),
            )
        )
    )


def _decide_usage(status: Column, body: Column, attempt: Column) -> Column:
    return (
        F.when(status == 200, _outcome("value", body))
        .when(status == 429, _outcome("retry"))
        .otherwise(_unexpected(status, body))
    )


DEFINITION_POLICY = ResponsePolicy("definition", 5 * 60, _decide_definition)
TRANSLATION_POLICY = ResponsePolicy("translation", 60, _decide_translation, limits=(429, 500, 503))
USAGE_POLICY = ResponsePolicy("usage", 60, _decide_usage)


def classify_responses(attempts: DataFrame, policy: ResponsePolicy) -> DataFrame:
    """Add outcome (``value`` / ``retry`` / ``fail`` / ``unsent``), value and reason to rows of (attempt, status, body).

    A request without a status was not sent.
    """
    decision = policy.decide(F.col("status"), F.col("body"), F.col("attempt"))
    decided = attempts.withColumn("_d", F.when(F.col("status").isNull(), _outcome("unsent")).otherwise(decision))
    return decided.select(*attempts.columns, "_d.outcome", "_d.value", "_d.reason")


def accepted_values(classified: DataFrame) -> DataFrame:
    """Only the answered requests, as (request, response); reading a failed one raises."""
    failed = F.raise_error(F.concat_ws(": ", F.lit("enrichment failed"), "request", "reason"))
    return classified.where(F.col("outcome").isin("value", "fail")).select(
        "request", F.when(F.col("outcome") == "fail", failed.cast("string")).otherwise(F.col("value")).alias("response")
    )


def task_rate(total_rps: float | None, partitions: int, default_parallelism: int) -> float | None:
    """Share of the job's request rate one task may use."""
    return None if total_rps is None else total_rps / max(partitions, default_parallelism)


def send(
    requests: DataFrame,
    connect: Connect,
    total_rps: float | None = None,
    partitions: int | None = None,
    limits: tuple[int, ...] = (),
    seconds: float | None = None,
) -> DataFrame:
    """Send each request once: (request) -> (request, status, body). The only step that leaves the JVM.

    A task stops sending after an answer with a status in ``limits``, after a call that raises, which counts as the
    answer `CALL_FAILURE`, and after ``seconds``; what it has not sent comes back without a status.
    """
    parallelism = requests.sparkSession.sparkContext.defaultParallelism
    tasks = partitions or parallelism
    rate = task_rate(total_rps, tasks, parallelism)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = connect(rate)
        due = time.monotonic()
        end = None if seconds is None else due + seconds
        stopped = False
        for batch in batches:
            answers = []
            for request in batch["request"]:
                stopped = stopped or (end is not None and time.monotonic() > end)
                if stopped:
                    answers.append((request, None, None))
                    continue
                if rate is not None:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + 1.0 / rate
                try:
                    status, body = fetch(request)
                except Exception as error:  # noqa: BLE001  whatever a client raises is an answer the policy fails on
                    status, body = CALL_FAILURE, f"{type(error).__name__}: {error}"
                stopped = status in limits or status == CALL_FAILURE
                answers.append((request, status, body))
            out = pd.DataFrame(answers, columns=["request", "status", "body"])
            yield out.astype({"status": "Int32"})

    return requests.select("request").repartition(tasks).mapInPandas(call, "request string, status int, body string")


class ResponseTable:
    """Answers a service has given, one row per request, kept for later runs.

    A Parquet table hash-bucketed on the request: looking requests up moves the requests and not the stored answers.
    One run at a time may add to it; a run adds only what the table lacks, so requests stay unique.
    """

    SCHEMA = "request string, response string"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        self.path = path
        _, self.full_name = ensure_database(spark, path)
        folder, self.buckets = bucket_folder(spark, path, buckets)
        check_location(spark, self.full_name, folder)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.full_name} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (request) SORTED BY (request) INTO {self.buckets} BUCKETS LOCATION '{qualify(spark, folder)}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.full_name)

    def aligned(self, df: DataFrame) -> DataFrame:
        """Rows that carry a request, partitioned like the stored buckets."""
        return df.repartition(self.buckets, "request")

    def append(self, answers: DataFrame) -> None:
        (
            self.aligned(answers.select("request", "response"))
            .write.format("parquet")
            .bucketBy(self.buckets, "request")
            .sortBy("request")
            .mode("append")
            .saveAsTable(self.full_name)
        )
        self.spark.catalog.refreshTable(self.full_name)


def table_lookup(responses: DataFrame) -> Lookup:
    """Look requests up in a table of (request, response), unique by request; an unknown one has an empty response."""

    def lookup(df: DataFrame) -> DataFrame:
        joined = df.join(responses.select("request", "response"), "request", "left")
        return joined.select(*df.columns, F.coalesce("response", F.lit("")).alias("response"))

    return lookup


def remote_lookup(
    table: ResponseTable,
    connect: Connect,
    policy: ResponsePolicy,
    total_rps: float | None = None,
    partitions: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    round_seconds: float = ROUND_SECONDS,
) -> Lookup:
    """Look requests up in the response table, asking the service for those it lacks.

    Each round sends open requests, stores the answers, stops the run on a failure and, where the service asked for it,
    pauses before the next. A task ends its round at the first answer that says stop, and after ``round_seconds``; the
    requests it has left stay open and that was no attempt. Answers are stored before the run can stop, so that at
    most one round is lost with a task, and the next run resumes. Empty answers are not stored: the service may know
    the text next time.
    """

    def lookup(df: DataFrame) -> DataFrame:
        wanted = written(table.aligned(request_keys(df, ["request"])), f"{policy.name}-requests")
        open_requests = (
            table.aligned(wanted)
            .join(table.read().select("request"), "request", "left_anti")
            .withColumn("attempt", F.lit(1))
        )
        while True:
            open_requests = written(open_requests, f"{policy.name}-open")
            sent = send(open_requests, connect, total_rps, partitions, policy.limits, round_seconds)
            # what a service is asked must not be asked again, so the answers are written before anything reads them
            sent = written(sent, f"{policy.name}-attempt").join(open_requests, "request")
            outcomes = classify_responses(sent, policy)
            answered = outcomes.where((F.col("outcome") == "value") & (F.col("value") != ""))
            table.append(answered.select("request", F.col("value").alias("response")))
            failure = outcomes.where(F.col("outcome") == "fail").select("request", "reason").first()
            if failure is not None:
                raise EnrichmentError(f"{policy.name} request `{failure['request']}`: {failure['reason']}")
            again = F.col("outcome") == "retry"
            open_requests = outcomes.where(again | (F.col("outcome") == "unsent")).select(
                "request", (F.col("attempt") + again.cast("int")).alias("attempt")
            )
            if open_requests.isEmpty():
                # the stored answers meet the distinct requests, and only these meet the rows, where a hot one may be split
                found = table.aligned(wanted).join(table.read(), "request")
                return table_lookup(found)(df)
            if not outcomes.where(again).isEmpty():
                sleep(policy.pause_seconds)

    return lookup


def definer(lookup: Lookup) -> Definer:
    """Tokens -> one row per definition, without the source's stamp."""

    def define(tokens: DataFrame) -> DataFrame:
        asked = tokens.drop(UPDATED_AT).withColumn("request", definition_request(F.col("text")))
        return flatten_definitions(lookup(asked)).drop("request")

    return define


def translator(lookup: Lookup, match: str = "contains") -> Translator:
    """Records -> records with translations; one request per text."""

    def translate(records: DataFrame) -> DataFrame:
        asked = request_keys(records, ["normalizedText"]).withColumn("request", F.col("normalizedText"))
        return attach_translations(records, flatten_translations(lookup(asked)), match)

    return translate


def usage_finder(lookup: Lookup, corpus: str = fixed.USAGE_CORPUS) -> UsageFinder:
    """Records -> records with their usage frequency; one request per text and part of speech."""

    def find(records: DataFrame) -> DataFrame:
        asked = request_keys(records, USAGE_KEYS).withColumn(
            "request", usage_request(F.col("normalizedText"), F.col("partOfSpeech"), corpus)
        )
        return attach_usage(records, flatten_usage(lookup(asked), USAGE_KEYS), USAGE_KEYS)

    return find
