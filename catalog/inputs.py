"""The driver's tables as inputs of the lake.

Documents and conversations play the highlights. Orders play the tokens: their definitions, translations and usage
come as JSON built from orders and lineitems, so parsing is checked against the plain tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions.columns import definition_request, usage_request
from lexlake.operators.definitions import defined_rows
from lexlake.operators.enrichment import definer, table_lookup
from lexlake.operators.merges import unique_by_key
from lexlake.operators.vocabulary import group_definitions
from lexlake.session import written
from lexlake.spec import GOLDEN, SILVER

DAY_1 = datetime(2024, 1, 1)
DAY_2 = datetime(2024, 1, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Input = Callable[[SparkSession, str], DataFrame]
_PREPARED: dict[tuple[str, str, str], DataFrame] = {}
_INPUTS: list[Input] = []


def prepared(build: Input) -> Input:
    """An input that several queries start from: written once per session and folder of tables, then read again."""

    @wraps(build)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _PREPARED:
            _PREPARED[key] = written(build(spark, sf_dir), build.__name__.replace("_", "-"))
        return _PREPARED[key]

    _INPUTS.append(once)
    return once


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write all shared inputs, so that a clock started afterwards times the operators."""
    for build in _INPUTS:
        build(spark, sf_dir)


def half(df: DataFrame, column: str) -> int:
    """Half of the largest value: where the first batch ends."""
    return (df.agg(F.max(column).alias("m")).first()["m"] or 0) // 2


def flat(df: DataFrame) -> DataFrame:
    """Columns as values that compare the same everywhere: lists sorted and joined, times as text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out.append(F.array_join(F.array_sort(f.name), "|").alias(f.name))
        elif kind in ("timestamp", "timestamp_ntz"):
            out.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif kind == "int":
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif kind == "double":
            out.append(F.round(f.name, 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---- highlights ---------------------------------------------------------------------------------------------------


def document_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mark per document; German ones lack a beginning and so play the bookmarks."""
    begin = F.when(F.col("lang") != "de", F.concat(F.lit("page="), F.col("doc_id")))
    mark = F.struct(begin.alias("begin"), F.lit("page=0").alias("end"), F.col("text").alias("text"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("oid"),
        F.to_json(mark).alias("val"),
        F.col("source").alias("title"),
        F.col("lang").alias("authors"),
        (F.col("doc_id") * 60).alias("timeEdt"),
    )


def document_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("oid"),
        "text",
        F.col("source").alias("title"),
        F.col("lang").alias("authors"),
        (F.col("doc_id") * 60).alias("timeEdt"),
    )


def conversation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mark per turn; a system turn plays a bookmark."""
    begin = F.when(F.col("role") != "system", F.lit("page=1"))
    mark = F.struct(begin.alias("begin"), F.lit("page=1").alias("end"), F.col("text").alias("text"))
    oid = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        oid.alias("oid"),
        F.to_json(mark).alias("val"),
        F.col("role").alias("title"),
        F.concat(F.lit("turn "), F.col("turn")).alias("authors"),
        (oid * 60).alias("timeEdt"),
    )


# ---- tokens, definitions, translations and usage from orders ------------------------------------------------------


def _text() -> Column:
    return F.concat(F.lit("order "), F.col("o_orderkey"))


def _word() -> Column:
    return F.concat(F.lit("customer "), F.col("o_custkey"))


def _part_of_speech() -> Column:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        F.when(flag == "A", "noun")
        .when((flag == "N") & (status == "O"), "verb")
        .when((flag == "N") & (status == "F"), "adverb")
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@prepared
def order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows: one token per order."""
    return (
        order_lines(spark, sf_dir)
        .groupBy("o_orderkey", "o_orderdate")
        .agg(
            F.array_sort(F.collect_set(F.concat(F.lit("flag "), F.col("l_returnflag")))).alias("books"),
            F.count(F.lit(1)).alias("occurrences"),
            F.min("l_shipdate").cast("timestamp").alias("firstOccurrence"),
            F.max("l_shipdate").cast("timestamp").alias("latestOccurrence"),
        )
        .select(
            _text().alias("text"),
            "books",
            "occurrences",
            "firstOccurrence",
            "latestOccurrence",
            F.col("o_orderdate").cast("timestamp").alias("updatedAt"),
        )
    )


@prepared
def definition_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per order: a meaning per kind of line, a definition per line.

    Orders of low priority have no definition; some others are known without any meaning.
    """
    sense = F.struct(
        F.concat(F.lit("part "), F.col("l_partkey") % 40).alias("definition"),
        F.when(F.col("l_linenumber") % 2 == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("example"),
        F.array("l_linestatus").alias("synonyms"),
        F.array().cast("array<string>").alias("antonyms"),
    )
    order = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"]
    meanings = (
        order_lines(spark, sf_dir)
        .groupBy(*order, "l_returnflag", "l_linestatus")
        .agg(F.collect_list(sense).alias("definitions"))
        .groupBy(*order)
        .agg(F.collect_list(F.struct(_part_of_speech().alias("partOfSpeech"), "definitions")).alias("meanings"))
    )
    phonetic = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("/"), F.col("o_orderpriority"), F.lit("/")))
    unknown = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P")
    known = F.when(~unknown, F.col("meanings"))
    body = F.to_json(F.array(F.struct(_word().alias("word"), phonetic.alias("phonetic"), known.alias("meanings"))))
    return meanings.select(
        definition_request(_text()).alias("request"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(body).alias("response"),
    )


def order_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order tokens with their definitions, flattened from the responses."""
    return definer(table_lookup(definition_responses(spark, sf_dir)))(order_tokens(spark, sf_dir))


@prepared
def order_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored silver table: the definitions, one per key, stamped with the order's date."""
    stamped = order_tokens(spark, sf_dir).withColumn("stamp", F.col("updatedAt"))
    defined = definer(table_lookup(definition_responses(spark, sf_dir)))(stamped)
    rows = unique_by_key(defined.withColumnRenamed("stamp", "updatedAt"), SILVER.pk)
    return rows.select(*SILVER.attributes)


@prepared
def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored golden records before enrichment."""
    return records_of(order_silver(spark, sf_dir))


def records_of(silver: DataFrame) -> DataFrame:
    return group_definitions(defined_rows(silver).dropna(subset=list(GOLDEN.pk)))


@prepared
def translation_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per customer, a translation per order; customers in debt have none, idle ones are unknown."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    tag = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "NOUN")
        .when(F.col("o_orderpriority") == "2-HIGH", "ADV")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "VERB")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "XYZ")
    )
    prefix = F.when(F.col("o_orderstatus") == "F", "the").when(F.col("o_orderstatus") == "O", "")
    translation = F.struct(
        F.concat(F.lit("target "), F.col("o_orderkey") % 97).alias("displayTarget"),
        tag.alias("posTag"),
        F.lit(0.5).alias("confidence"),
        prefix.alias("prefixWord"),
    )
    found = orders.groupBy("o_custkey").agg(F.collect_list(translation).alias("translations"))
    joined = customers.join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    in_debt = F.when(F.col("c_acctbal") < 0, F.filter("translations", lambda t: F.lit(False)))
    lookup = F.struct(
        F.col("c_name").alias("displaySource"),
        F.coalesce(in_debt, F.col("translations")).alias("translations"),
    )
    word = F.concat(F.lit("customer "), F.col("c_custkey"))
    return joined.select(
        word.alias("request"),
        F.when(F.col("translations").isNull(), "[]").otherwise(F.to_json(F.array(lookup))).alias("response"),
    )


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(normalizedText, partOfSpeech, l_linestatus, l_quantity) per line."""
    return order_lines(spark, sf_dir).select(
        _word().alias("normalizedText"), _part_of_speech().alias("partOfSpeech"), "l_linestatus", "l_quantity"
    )


@prepared
def usage_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response per customer and part of speech, a series per line status; some have no series."""
    series = (
        usage_lines(spark, sf_dir)
        .groupBy("normalizedText", "partOfSpeech", "l_linestatus")
        .agg(F.collect_list("l_quantity").alias("timeseries"))
    )
    bodies = series.groupBy("normalizedText", "partOfSpeech").agg(
        F.collect_list(F.struct(F.col("l_linestatus").alias("ngram"), "timeseries")).alias("series"),
        F.sum(F.size("timeseries")).alias("points"),
    )
    return bodies.select(
        "normalizedText",
        "partOfSpeech",
        usage_request(F.col("normalizedText"), F.col("partOfSpeech")).alias("request"),
        F.when(F.col("points") % 5 == 0, "[]").otherwise(F.to_json("series")).alias("response"),
    )


# ---- services for conversation tokens -----------------------------------------------------------------------------


def _json_or(condition: Column, otherwise: str, body: Column) -> Column:
    return F.when(condition, otherwise).otherwise(F.to_json(body))


def conversation_definitions(tokens: DataFrame) -> DataFrame:
    """(request, response) per token: it is filed under its first word, with one or two senses."""
    n = F.length("text")
    head = F.split("text", " ")[0]
    example = F.when(n % 4 != 1, F.concat(F.lit("as in "), F.col("text")))
    no_words = F.array().cast("array<string>")

    def meaning(part_of_speech: Column, definition: Column) -> Column:
        sense = F.struct(
            definition.alias("definition"),
            example.alias("example"),
            no_words.alias("synonyms"),
            F.array(F.upper(head)).alias("antonyms"),
        )
        return F.struct(part_of_speech.alias("partOfSpeech"), F.array(sense).alias("definitions"))

    own = meaning(
        F.when(n % 3 == 0, "noun").when(n % 3 == 1, "verb"), F.concat(F.lit("sense "), (n % 3).cast("string"))
    )
    common = meaning(F.lit("adverb"), F.lit("common sense"))
    entry = F.struct(
        head.alias("word"),
        F.when(n % 7 != 0, F.concat(F.lit("/"), head, F.lit("/"))).alias("phonetic"),
        F.when(n % 2 == 0, F.array(own, common)).otherwise(F.array(own)).alias("meanings"),
    )
    return tokens.select("text").distinct().select(
        definition_request(F.col("text")).alias("request"),
        _json_or(n % 5 == 0, "", F.array(entry)).alias("response"),
    )


def _heads(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.split("text", " ")[0].alias("word")).distinct()


def conversation_translations(tokens: DataFrame) -> DataFrame:
    """(request, response) per first word."""

    def translation(tag: str, prefix: Column) -> Column:
        target = F.concat(F.col("word"), F.lit("-" + tag.lower()))
        return F.struct(target.alias("displayTarget"), F.lit(tag).alias("posTag"), prefix.alias("prefixWord"))

    lookup = F.struct(
        F.concat(F.col("word"), F.lit(".")).alias("displaySource"),
        F.array(
            translation("NOUN", F.lit("the")),
            translation("ADV", F.lit("")),
            translation("XYZ", F.lit(None).cast("string")),
        ).alias("translations"),
    )
    return _heads(tokens).select(
        F.col("word").alias("request"),
        _json_or(F.length("word") % 4 == 0, "[]", F.array(lookup)).alias("response"),
    )


def conversation_usage(tokens: DataFrame) -> DataFrame:
    """(request, response) per first word and part of speech."""
    parts = F.array(F.lit("noun"), F.lit("verb"), F.lit("adverb"), F.lit(None).cast("string"))
    n = F.length("word")
    series = F.struct(F.col("word").alias("ngram"), F.array(n / 100, (n + 2) / 100).alias("timeseries"))
    return (
        _heads(tokens)
        .select("word", F.explode(parts).alias("part"))
        .select(
            usage_request(F.col("word"), F.col("part")).alias("request"),
            _json_or(n % 3 == 0, "[]", F.array(series)).alias("response"),
        )
    )


# ---- published states ---------------------------------------------------------------------------------------------


def published_rows(records: DataFrame, separator: str) -> DataFrame:
    """A sheet users have worked on: the records first seen before 1998, and rows golden no longer has."""
    part = F.substring_index("definition", " ", -1).cast("int")
    customer = F.substring_index("normalizedText", " ", -1).cast("int")
    row_id = (customer * 100 + part + 1).cast("int")
    edited = records.where(F.col("firstOccurrence") < "1998-01-01").withColumn("id", row_id)
    none = F.lit(None).cast("string")
    kept = edited.select(
        "id",
        F.when(F.col("id") % 3 == 0, "learned").otherwise("in progress").alias("status"),
        "normalizedText",
        F.when(F.col("id") % 3 == 0, "edited").alias("partOfSpeech"),
        F.when(F.col("id") % 4 == 0, "").alias("phonetic"),
        F.concat_ws(separator, F.lit("manual form"), F.element_at("forms", 1)).alias("forms"),
        F.lit("").alias("sources"),
        F.lit(1).alias("occurrences"),
        F.lit("long ago").alias("firstOccurrence"),
        none.alias("latestOccurrence"),
        "definition",
        none.alias("examples"),
        F.lit(".").alias("synonyms"),
        F.lit("").alias("antonyms"),
        F.lit("manual translation").alias("translations"),
        F.when(F.col("id") % 5 == 0, "50.000000%").alias("usage"),
        F.concat(F.lit("tag "), F.col("id")).alias("tags"),
        none.alias("notes"),
    )
    gone = kept.where(F.col("status") == "learned").withColumns({"id": F.col("id") + 50, "definition": F.lit("gone")})
    return kept.unionByName(gone)
