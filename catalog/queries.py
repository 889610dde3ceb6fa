"""Every operator and job of the lake as a query over the driver's tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as i
from lexlake.functions import fixed_values as fixed
from lexlake.functions.columns import (
    definition_request,
    is_defined,
    split_cell,
    timestamp_lit,
    usage_query,
    usage_request,
)
from lexlake.operators import definitions, highlights, publish, responses, retries, translations, usage, vocabulary, worklist
from lexlake.operators.enrichment import (
    DEFINITION_POLICY,
    TRANSLATION_POLICY,
    USAGE_POLICY,
    ResponsePolicy,
    ResponseTable,
    classify_responses,
    definer,
    remote_lookup,
    table_lookup,
    translator,
    usage_finder,
)
from lexlake.operators.ids import assign_ids
from lexlake.operators.incremental import max_value, new_by_max_key, new_by_watermark
from lexlake.operators.merges import merge_accumulate, merge_partial, merge_replace, unique_by_key
from lexlake.operators.retries import RetryPolicy
from lexlake.operators.sheets import read_sheet
from lexlake.plans import jobs
from lexlake.plans.lake import Lake
from lexlake.session import new_work_path, written
from lexlake.sources.append_tables import CSV_OPTIONS, AppendTable, SnapshotTable
from lexlake.sources.marks import read_marks, read_marks_csv
from lexlake.sources.sheet_store import SheetStore
from lexlake.spec import (
    GOLDEN,
    LONG,
    SILVER,
    STAGE,
    TEXT,
    TIME,
    UPDATED_AT,
    VOCABULARY_CSV,
    VOCABULARY_SHEET,
    WORKLIST_SHEET,
    TableSpec,
    schema,
)

flat = i.flat

# ---- sources and incremental loads --------------------------------------------------------------------------------


def marks_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines are tags on orders, orders lie under customers, customers are the books."""
    lines, orders = i.table(spark, sf_dir, "lineitem"), i.table(spark, sf_dir, "orders")
    customers = i.table(spark, sf_dir, "customer")
    book_id = F.col("c_custkey") + F.lit(10**12)
    tags = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("OID"),
        F.col("l_orderkey").alias("ItemID"),
        (F.col("l_linenumber") + 100).alias("TagID"),
        F.concat_ws("/", "l_returnflag", "l_linestatus", "l_partkey").alias("Val"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("TimeEdt"),
    )
    items = orders.select(
        F.col("o_orderkey").alias("OID"), (F.col("o_custkey") + F.lit(10**12)).alias("ParentID")
    ).union(customers.select(book_id, F.lit(None).cast("bigint")))
    books = customers.select(
        book_id.alias("OID"), F.col("c_name").alias("Title"), F.col("c_mktsegment").alias("Authors")
    )
    return read_marks(tags, items, books)


def stage_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlights.parse_highlights(i.document_marks(spark, sf_dir))


def _with_text(marks: DataFrame) -> DataFrame:
    """Marks with the text their JSON holds in place of the JSON, whose layout differs between engines."""
    return marks.withColumn("text", F.get_json_object("val", "$.text")).drop("val")


def stage_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = i.document_marks(spark, sf_dir)
    stored = marks.where(F.col("oid") <= i.half(marks, "oid"))
    return _with_text(new_by_max_key(marks, stored, "oid"))


def first_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_text(highlights.first_marks(i.document_marks(spark, sf_dir), 100))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = i.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return events.groupBy("event_type").agg(
        F.count("p.k").alias("n"), F.sum("p.k").alias("sum_k"), F.max("p.k").alias("max_k")
    )


def watermark_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = i.table(spark, sf_dir, "events").withColumn(UPDATED_AT, F.col("ts").cast("timestamp"))
    seen = events.where(F.col("event_id") <= i.half(events, "event_id"))
    return new_by_watermark(events, seen).select("event_id", "user_id", "event_type")


def marks_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_work_path(spark, "marks-csv")
    i.document_marks(spark, sf_dir).write.options(**CSV_OPTIONS).csv(path)
    return highlights.parse_highlights(read_marks_csv(spark, path))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.document_highlights(spark, sf_dir)
    cut = i.half(rows, "oid")
    path = new_work_path(spark, "csv_roundtrip") + "/stage"
    stage = AppendTable(spark, STAGE, path, output_files=2)
    stage.append(rows.where(F.col("oid") <= cut), i.DAY_1)
    stage.append(rows.where(F.col("oid") > cut), i.DAY_2)
    spark.sql(f"DROP TABLE {stage.full_name}")
    return flat(AppendTable(spark, STAGE, path).read())


SNAPSHOTS = TableSpec("snapshots", schema(orderkey=LONG, status=TEXT, updatedAt=TIME), pk=("orderkey",))


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = i.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status")
    )
    states = SnapshotTable(spark, SNAPSHOTS, new_work_path(spark, "snapshot_latest") + "/states")
    states.write(orders.where("status = 'O'"), i.DAY_1)
    return flat(states.write(orders.where("status <> 'O'"), i.DAY_2))


def publish_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five publishes, two backups kept: the third to the fifth remain."""
    orders = i.table(spark, sf_dir, "orders")
    store = SheetStore(spark, WORKLIST_SHEET, new_work_path(spark, "publish_retention"), keep=2)
    for n in range(1, 6):
        store.publish(
            orders.where(F.substring("o_orderpriority", 1, 1) == str(n)).select(
                F.concat(F.lit("order "), "o_orderkey").alias("text"),
                F.col("o_orderpriority").alias("books"),
                F.lit(n).alias("occurrences"),
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("firstOccurrence"),
                F.lit(None).cast("string").alias("latestOccurrence"),
            )
        )
    kept = [store.read(v).withColumn("version", F.lit(v).cast("bigint")) for v in store.versions()]
    return flat(reduce(DataFrame.unionByName, kept))


def sheet_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three or four cells in a sheet of five columns."""
    parts = i.table(spark, sf_dir, "part")
    cells = F.array("p_name", F.when(F.col("p_size") > 10, F.col("p_brand")), F.col("p_size").cast("string"))
    longer = F.when(F.col("p_type") == "PROMO", F.array_append(cells, F.col("p_type"))).otherwise(cells)
    return flat(read_sheet(parts.select(longer.alias("cells")), list(WORKLIST_SHEET.attributes), WORKLIST_SHEET))


# ---- tokens -------------------------------------------------------------------------------------------------------


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(highlights.tokens_by_text(i.document_highlights(spark, sf_dir)))


def token_stats_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(highlights.tokens_by_text(i.document_highlights(spark, sf_dir), strict=True))


def bronze_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.document_highlights(spark, sf_dir)
    cut = i.half(rows, "oid")

    def batch(part: DataFrame, now) -> DataFrame:
        return highlights.tokens_by_text(part).withColumn(UPDATED_AT, timestamp_lit(now))

    return flat(
        merge_accumulate(batch(rows.where(F.col("oid") <= cut), i.DAY_1), batch(rows.where(F.col("oid") > cut), i.DAY_2))
    )


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = highlights.tokens_by_text(i.document_highlights(spark, sf_dir))
    return flat(highlights.top_tokens(stats, 100)).select("text", "occurrences")


# ---- definitions --------------------------------------------------------------------------------------------------


def _silver_and_updates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Silver knows the tokens dated before 1999; the updates are those dated 1998 or later, counted anew."""
    tokens, silver = i.order_tokens(spark, sf_dir), i.order_silver(spark, sf_dir)
    updates = tokens.where(F.col(UPDATED_AT) >= "1998-01-01").withColumns(
        {"occurrences": F.col("occurrences") + 1000, "books": F.array_append("books", F.lit("again"))}
    )
    return silver.where(F.col(UPDATED_AT) < "1999-01-01"), updates


def silver_request_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver, updates = _silver_and_updates(spark, sf_dir)
    return flat(definitions.undefined_requests(updates, silver))


def define_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(i.order_definitions(spark, sf_dir))


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(definitions.fill_enrichment_defaults(i.order_definitions(spark, sf_dir), SILVER))


def defined_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.order_definitions(spark, sf_dir)
    return rows.groupBy(is_defined().alias("defined")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts")
    )


def silver_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver, updates = _silver_and_updates(spark, sf_dir)
    return flat(definitions.refresh_defined(updates, silver))


def silver_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh what is defined; the texts without a definition are asked again and half of them get one now."""
    silver, updates = _silver_and_updates(spark, sf_dir)
    asked = definitions.undefined_requests(updates, silver).drop(UPDATED_AT)
    found = F.col("occurrences") % 2 == 0
    none, words = F.lit(None).cast("string"), F.array().cast("array<string>")
    answers = asked.select(
        *asked.columns,
        F.when(found, F.col("text")).alias("normalizedText"),
        F.when(found, "found late").alias("definition"),
        none.alias("phonetic"),
        F.when(found, "noun").alias("partOfSpeech"),
        *[F.when(found, words).alias(c) for c in ("examples", "synonyms", "antonyms")],
    )
    changes = definitions.refresh_defined(updates, silver).unionByName(answers)
    stamped = unique_by_key(changes, SILVER.pk).withColumn(UPDATED_AT, timestamp_lit(i.DAY_2))
    return flat(merge_replace(silver, written(stamped, "silver-merge")))


def retry_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next dates after a run that asks for what is due: tokens with an even count get a definition.

    Undefined tokens seen before 1998 have been asked for up to four times, the last time when they were last seen.
    """
    undefined = definitions.undefined_rows(i.order_silver(spark, sf_dir))
    attempts = (F.col("occurrences") % 4 + 1).cast("int")
    asked = undefined.where(F.col("firstOccurrence") < "1998-01-01").select("text", "latestOccurrence", attempts.alias("attempts"))
    policy = RetryPolicy(timedelta(days=90), timedelta(days=300))
    due = F.col("latestOccurrence") + F.make_dt_interval(secs=policy.wait(F.col("attempts")))
    schedule = asked.select("text", "attempts", due.alias("dueAt"), timestamp_lit(i.DAY_1).alias(UPDATED_AT))
    now = datetime(1998, 9, 1, tzinfo=timezone.utc)
    tried = retries.due_tokens(undefined, schedule, now).withColumn(
        "normalizedText", F.when(F.col("occurrences") % 2 == 0, F.col("text"))
    )
    changed = retries.rescheduled(tried, schedule, now, policy)
    return flat(retries.merge_schedule(schedule, changed).drop(UPDATED_AT))


# ---- records ------------------------------------------------------------------------------------------------------


def sibling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = definitions.defined_rows(i.order_silver(spark, sf_dir))
    updated = silver.where(F.col(UPDATED_AT) >= "2001-01-01")
    return flat(vocabulary.sibling_forms(silver, updated).select("text", "normalizedText", "definition"))


def golden_survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(i.records_of(i.order_silver(spark, sf_dir)))


def _stored_golden(records: DataFrame) -> DataFrame:
    """Golden as it was: the records first seen before 1998, with other statistics and their enrichment."""
    return (
        records.where(F.col("firstOccurrence") < "1998-01-01")
        .withColumns(
            {
                "occurrences": F.lit(0),
                "phonetic": F.lit("old"),
                "translations": F.array(F.concat(F.lit("stored "), "definition")),
                "usage": F.lit(0.25),
                UPDATED_AT: timestamp_lit(i.DAY_1),
            }
        )
        .select(*GOLDEN.attributes)
    )


def golden_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = i.order_records(spark, sf_dir)
    classified = vocabulary.classify(records, _stored_golden(records))
    return flat(classified.select(*GOLDEN.pk, "occurrences", *GOLDEN.enriched, "isStored"))


def golden_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records seen in 1998 or later are updates, new or to a stored record; the others stay as stored."""
    records = i.order_records(spark, sf_dir)
    stored = _stored_golden(records)
    updated = records.where(F.col("latestOccurrence") >= "1998-01-01")
    new, existing = vocabulary.split_new_existing(vocabulary.classify(updated, stored))
    enriched = new.withColumns({"translations": F.array(F.lit("new")), "usage": F.lit(0.5)})
    return flat(merge_partial(stored, vocabulary.record_updates(existing, enriched, i.DAY_2)))


# ---- translations and usage ---------------------------------------------------------------------------------------


def _parsed_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = i.translation_responses(spark, sf_dir).withColumnRenamed("request", "normalizedText")
    return responses.flatten_translations(asked)


def translation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translations.map_tags(_parsed_translations(spark, sf_dir))


def translation_attach_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = i.order_records(spark, sf_dir).select(*GOLDEN.pk, "partOfSpeech", "forms")
    return flat(translator(table_lookup(i.translation_responses(spark, sf_dir)), "contains")(records))


def translation_attach_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = i.order_records(spark, sf_dir).select(*GOLDEN.pk, "partOfSpeech", "forms")
    return flat(translator(table_lookup(i.translation_responses(spark, sf_dir)), "exact")(records))


def usage_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(responses.flatten_usage(i.usage_responses(spark, sf_dir), usage.USAGE_KEYS))


def usage_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several records share a text and part of speech; each gets the pair's mean."""
    records = i.order_records(spark, sf_dir).select(*GOLDEN.pk, "partOfSpeech")
    return flat(usage_finder(table_lookup(i.usage_responses(spark, sf_dir).select("request", "response")))(records))


def usage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query keys for part names, each under the part of speech its type and size stand for."""
    position = (F.col("p_size") % (len(fixed.PARTS_OF_SPEECH) + 2) + 1).cast("int")
    words = F.array(*[F.lit(p) for p in (*fixed.PARTS_OF_SPEECH, "abbreviation")], F.lit(None).cast("string"))
    parts = i.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("normalizedText"), F.element_at(words, position).alias("partOfSpeech")
    )
    keys = usage.request_keys(parts, usage.USAGE_KEYS)
    return keys.select(*keys.columns, usage_query(F.col("normalizedText"), F.col("partOfSpeech")).alias("query"))


def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = i.table(spark, sf_dir, "part").select(F.concat_ws(" & ", "p_name", "p_brand").alias("text"))
    return usage.request_keys(parts, ["text"]).select(
        "text",
        definition_request(F.col("text")).alias("definition_url"),
        usage_request(F.col("text"), F.lit("noun")).alias("usage_url"),
    )


# ---- enrichment ---------------------------------------------------------------------------------------------------


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: the type gives the status, the user the attempt."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", 200).when(kind == "click", 429).when(kind == "signup", 404).when(kind == "error", -1)
    ).otherwise(500)
    code = F.element_at(F.array(F.lit(500000), F.lit(503000), F.lit(403001)), (F.col("event_id") % 3 + 1).cast("int"))
    error = F.to_json(F.struct(F.struct(code.alias("code"), F.lit("busy").alias("message")).alias("error")))
    body = (
        F.when(status == 200, F.col("props"))
        .when(F.col("event_id") % 7 == 0, "")
        .when(F.col("event_id") % 7 == 1, "moved")
        .otherwise(error)
    )
    return i.table(spark, sf_dir, "events").select(
        F.col("event_id"),
        (F.col("user_id") % 5 + 1).cast("int").alias("attempt"),
        status.cast("int").alias("status"),
        body.alias("body"),
    )


def _policy(spark: SparkSession, sf_dir: str, policy: ResponsePolicy) -> DataFrame:
    decided = classify_responses(_attempts(spark, sf_dir), policy)
    return decided.select("event_id", "outcome", "value", "reason")


def response_policy_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, DEFINITION_POLICY)


def response_policy_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, TRANSLATION_POLICY)


def response_policy_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, USAGE_POLICY)


def enrich_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask for their customer's name; customers of one market are in the response table already.

    A third of the orders ask for one and the same name. The service is offline: it knows a name backwards, but no name
    that ends in 7; each task may send at its share of the rate.
    """

    def connect(rate: float | None):
        return lambda request: (404, None) if request.endswith("7") else (200, request[::-1])

    customers, orders = i.table(spark, sf_dir, "customer"), i.table(spark, sf_dir, "orders")
    known = ResponseTable(spark, new_work_path(spark, "enrich_cached"))
    known.append(
        customers.where("c_mktsegment = 'BUILDING'").select(
            F.col("c_name").alias("request"), F.concat(F.lit("cached "), "c_custkey").alias("response")
        )
    )
    lookup = remote_lookup(known, connect, DEFINITION_POLICY, total_rps=100_000.0)
    asked = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("o_orderkey") % 3 == 0, "everyone").otherwise(F.col("c_name"))
    return lookup(asked.select("o_orderkey", name.alias("request")))


# ---- publishing ---------------------------------------------------------------------------------------------------


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = i.order_records(spark, sf_dir)
    translated = translator(table_lookup(i.translation_responses(spark, sf_dir)))(records)
    found = usage_finder(table_lookup(i.usage_responses(spark, sf_dir).select("request", "response")))(translated)
    return found.withColumn(UPDATED_AT, timestamp_lit(i.DAY_1)).select(*GOLDEN.attributes)


def _cells_sorted(sheet: DataFrame, separator: str = fixed.CELL_SEPARATOR) -> DataFrame:
    cells = {c: F.array_join(F.array_sort(split_cell(F.col(c), separator)), "|") for c in publish.ARRAY_CELLS}
    return flat(sheet.withColumns(cells))


def publish_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = written(_golden(spark, sf_dir), "publish-golden")
    published = written(i.published_rows(golden, fixed.CELL_SEPARATOR), "publish-sheet")
    return _cells_sorted(publish.reconcile(published, golden))


def publish_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a publish into a sheet that users have worked on did, counted by the job that wrote it."""
    golden = written(_golden(spark, sf_dir), "publish-golden")
    store = SheetStore(spark, VOCABULARY_SHEET, new_work_path(spark, "publish_grown"))
    before = store.publish(i.published_rows(golden, fixed.CELL_SEPARATOR))
    counts = Observation()
    after = jobs.update_vocabulary(golden, store, counts=counts)
    states = (publish.INSERTED, publish.CHANGED, publish.KEPT)
    row = tuple(counts.get[s] for s in states)
    found = spark.createDataFrame([row], ", ".join(f"{s} long" for s in states))
    return found.withColumn("grown", F.lit(publish.grown_rows(before, after)).cast("long"))


def publish_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First publish as CSV snapshots; the second publish changes nothing but the stamp."""
    golden = written(_golden(spark, sf_dir), "publish-golden")
    path = new_work_path(spark, "publish_csv") + "/published"
    published = SnapshotTable(spark, VOCABULARY_CSV, path, compression="gzip")
    jobs.publish_csv(golden, published, i.DAY_1)
    return _cells_sorted(jobs.publish_csv(golden, published, i.DAY_2), fixed.CSV_CELL_SEPARATOR)


def publish_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = i.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    offset = max_value(i.table(spark, sf_dir, "customer"), "c_custkey") or 0
    numbered = assign_ids(orders, [F.col("o_orderdate"), F.col("o_orderkey")], offset)
    return flat(numbered.select("id", "o_orderkey"))


def _worklist(spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    silver = i.order_silver(spark, sf_dir)
    records = i.records_of(silver)
    by_hand = definitions.undefined_rows(silver).where(F.col("firstOccurrence") < "1998-01-01")
    cells = records.select("forms").union(by_hand.select(F.array(F.lit("by hand"), "text")))
    published = cells.select(F.array_join("forms", fixed.CELL_SEPARATOR).alias("forms"))
    return flat(worklist.unpublished(worklist.render_worklist(silver), published, match))


def worklist_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worklist(spark, sf_dir, "substring")


def worklist_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worklist(spark, sf_dir, "form")


# ---- whole runs ---------------------------------------------------------------------------------------------------


def _conversation_lake(spark: SparkSession, sf_dir: str, **settings) -> tuple[Lake, DataFrame, DataFrame]:
    """An empty lake, the first half of the marks, and all marks."""
    marks = i.conversation_marks(spark, sf_dir)
    tokens = written(highlights.tokens(highlights.parse_highlights(marks)).select("text").distinct(), "lake-tokens")
    lake = Lake.at(
        spark,
        new_work_path(spark, "lake"),
        definer(table_lookup(written(i.conversation_definitions(tokens), "lake-definitions"))),
        translator(table_lookup(written(i.conversation_translations(tokens), "lake-translations"))),
        usage_finder(table_lookup(written(i.conversation_usage(tokens), "lake-usage"))),
        **settings,
    )
    return lake, marks.where(F.col("oid") <= i.half(marks, "oid")), marks


def update_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, first, marks = _conversation_lake(spark, sf_dir)
    lake.update_internal(first, i.DAY_1)
    return flat(lake.update_internal(marks, i.DAY_2))


def update_internal_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table of two runs that store "not found" values instead of NULL."""
    lake, first, marks = _conversation_lake(spark, sf_dir, fill_missing=True, stage_format="parquet")
    lake.update_internal(first, i.DAY_1)
    lake.update_internal(marks, i.DAY_2)
    return flat(lake.silver.snapshot())


def update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published vocabulary after two runs."""
    lake, first, marks = _conversation_lake(spark, sf_dir)
    lake.update_all(first, i.DAY_1)
    lake.update_all(marks, i.DAY_2)
    return _cells_sorted(lake.vocabulary.read())


def update_all_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worklist after two runs."""
    lake, first, marks = _conversation_lake(spark, sf_dir)
    lake.update_all(first, i.DAY_1)
    rows = lake.update_all(marks, i.DAY_2)
    books = F.array_join(F.array_sort(F.split("books", fixed.WORKLIST_SEPARATOR)), "|")
    return flat(rows.withColumn("books", books))


QUERIES = {
    f.__name__: f
    for f in (
        marks_join,
        stage_highlights,
        stage_incremental,
        first_marks,
        event_json,
        watermark_updates,
        marks_csv,
        csv_roundtrip,
        snapshot_latest,
        publish_retention,
        sheet_read,
        token_stats,
        token_stats_strict,
        bronze_merge,
        top_tokens,
        silver_request_set,
        define_flatten,
        fill_defaults,
        defined_split,
        silver_refresh,
        silver_merge,
        retry_due,
        sibling_forms,
        golden_survivorship,
        golden_classify,
        golden_merge,
        translation_flatten,
        translation_attach_contains,
        translation_attach_exact,
        usage_mean,
        usage_attach,
        usage_keys,
        request_urls,
        response_policy_definition,
        response_policy_translation,
        response_policy_usage,
        enrich_cached,
        publish_merge,
        publish_grown,
        publish_csv,
        publish_ids,
        worklist_substring,
        worklist_form,
        update_internal,
        update_internal_filled,
        update_all,
        update_all_worklist,
    )
}
