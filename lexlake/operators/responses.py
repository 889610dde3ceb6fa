"""Flatten the nested JSON of enrichment responses into rows; unknown JSON fields are ignored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.functions.columns import empty_strings
from lexlake.spec import DEFINITION_RESPONSE, TRANSLATION_RESPONSE, USAGE_RESPONSE


def _others(df: DataFrame, raw: str) -> list[str]:
    return [c for c in df.columns if c != raw]


def _or_none(values: Column, kind: T.ArrayType) -> Column:
    """The array, or one NULL in place of an empty or missing one."""
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast(kind.elementType)))


def flatten_definitions(df: DataFrame, raw: str = "response") -> DataFrame:
    """One row per definition: response -> origins -> meanings -> definitions.

    Each level is outer, so a text without a definition stays as one row of NULLs. The service gives at most one
    example; it becomes a list, empty where the definition has none and NULL where there is no definition.

    The levels are flattened inside the row, so that the token's other columns, its books above all, are copied once per
    definition and not once per level.
    """
    keep = _others(df, raw)
    of_meanings = DEFINITION_RESPONSE.elementType["meanings"].dataType
    of_senses = of_meanings.elementType["definitions"].dataType

    def senses_of(origin: Column, meaning: Column) -> Column:
        def sense(d: Column) -> Column:
            has_definition = d["definition"].isNotNull()
            examples = F.when(has_definition & d["example"].isNotNull(), F.array(d["example"])).when(
                has_definition, empty_strings()
            )
            return F.struct(
                origin["word"].alias("normalizedText"),
                origin["phonetic"].alias("phonetic"),
                meaning["partOfSpeech"].alias("partOfSpeech"),
                d["definition"].alias("definition"),
                examples.alias("examples"),
                d["synonyms"].alias("synonyms"),
                d["antonyms"].alias("antonyms"),
            )

        return F.transform(_or_none(meaning["definitions"], of_senses), sense)

    def meanings_of(origin: Column) -> Column:
        meanings = _or_none(origin["meanings"], of_meanings)
        return F.flatten(F.transform(meanings, lambda meaning: senses_of(origin, meaning)))

    parsed = df.select(*keep, F.from_json(raw, DEFINITION_RESPONSE).alias("_origins"))
    senses = F.flatten(F.transform(_or_none(F.col("_origins"), DEFINITION_RESPONSE), meanings_of))
    return parsed.select(*keep, F.explode(senses).alias("_sense")).select(*keep, "_sense.*")


def flatten_translations(df: DataFrame, raw: str = "response") -> DataFrame:
    """One row per translation: (displaySource, displayTarget, posTag, prefixWord); outer at each level."""
    keep = _others(df, raw)
    lookups = df.select(*keep, F.explode_outer(F.from_json(raw, TRANSLATION_RESPONSE)).alias("l"))
    found = lookups.select(*keep, "l.displaySource", F.explode_outer("l.translations").alias("t"))
    return found.select(*keep, "displaySource", "t.displayTarget", "t.posTag", "t.prefixWord")


def flatten_usage(df: DataFrame, keys: Sequence[str], raw: str = "response") -> DataFrame:
    """Mean of all points of all series a key matched; NULL when nothing matched."""
    series = df.select(*keys, F.explode_outer(F.from_json(raw, USAGE_RESPONSE)).alias("n"))
    points = series.select(*keys, F.explode_outer("n.timeseries").alias("point"))
    return points.groupBy(*keys).agg(F.avg("point").alias("usage"))
