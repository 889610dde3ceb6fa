"""Table specs: the schema of every table plus the role each column plays in merges."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPDATED_AT = "updatedAt"


def qualified(alias: str) -> Callable[[str], Column]:
    """Column function for one side of a join: ``qualified("t")("c")`` is column ``t.c``."""
    return lambda name: F.col(f"{alias}.{name}")


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    pk: tuple[str, ...]
    natural_pk: tuple[str, ...] = ()
    copied: tuple[str, ...] = ()
    transformed: tuple[str, ...] = ()
    enriched: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    # columns the table is hash-bucketed on; the joins on these need no shuffle of the stored side
    bucketed_by: tuple[str, ...] = ()

    @property
    def attributes(self) -> tuple[str, ...]:
        return tuple(self.schema.names)

    def fields(self, names: Iterable[str]) -> list[T.StructField]:
        return [self.schema[n] for n in names]

    def cols(self, names: Iterable[str] | None = None, of: Callable[[str], Column] = F.col) -> list[Column]:
        """Project ``names`` (all attributes by default) through the column function ``of``."""
        return [of(n) for n in (self.attributes if names is None else names)]

    def key_matches(self, left: str, right: str, null_safe: bool = False) -> Column:
        """Join condition: every primary-key column of alias ``left`` equals that of alias ``right``."""
        lhs, rhs = qualified(left), qualified(right)
        parts = [lhs(c).eqNullSafe(rhs(c)) if null_safe else lhs(c) == rhs(c) for c in self.pk]
        return reduce(lambda a, b: a & b, parts)

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)


LONG, INT, DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
TEXT, TIME = T.StringType(), T.TimestampType()
TEXTS = T.ArrayType(TEXT)


def schema(**columns: T.DataType) -> T.StructType:
    """A schema from column names and types; unlike a DDL text it needs no running session."""
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_SEEN = {"books": TEXTS, "occurrences": LONG, "firstOccurrence": TIME, "latestOccurrence": TIME}
_SENSE_ARRAYS = {"examples": TEXTS, "synonyms": TEXTS, "antonyms": TEXTS}

MARKS = TableSpec(
    name="marks",
    schema=schema(oid=LONG, val=TEXT, title=TEXT, authors=TEXT, timeEdt=LONG),
    pk=("oid",),
)

# the JSON document held in `marks.val`
MARK_JSON = schema(begin=TEXT, end=TEXT, text=TEXT, updated=TIME)

STAGE = TableSpec(
    name="stage",
    schema=schema(oid=LONG, text=TEXT, title=TEXT, authors=TEXT, timeEdt=LONG, updatedAt=TIME),
    pk=("oid",),
    copied=("oid", "title", "authors", "timeEdt"),
    transformed=("text",),
    metadata=(UPDATED_AT,),
)

BRONZE = TableSpec(
    name="bronze",
    schema=schema(text=TEXT, **_SEEN, updatedAt=TIME),
    pk=("text",),
    transformed=("text", *_SEEN, UPDATED_AT),
    metadata=(UPDATED_AT,),
    bucketed_by=("text",),
)

SILVER = TableSpec(
    name="silver",
    schema=schema(
        text=TEXT,
        **_SEEN,
        updatedAt=TIME,
        normalizedText=TEXT,
        phonetic=TEXT,
        partOfSpeech=TEXT,
        definition=TEXT,
        **_SENSE_ARRAYS,
    ),
    pk=("text", "normalizedText", "definition"),
    copied=("text", *_SEEN),
    enriched=("normalizedText", "definition", "phonetic", "partOfSpeech", *_SENSE_ARRAYS),
    metadata=(UPDATED_AT,),
    # joined with bronze on text; a text's definitions come from one response, so a text stays small
    bucketed_by=("text",),
)

# when tokens without a definition are to be asked for again
RETRIES = TableSpec(
    name="retries",
    schema=schema(text=TEXT, attempts=INT, dueAt=TIME, updatedAt=TIME),
    pk=("text",),
    transformed=("attempts", "dueAt", UPDATED_AT),
    metadata=(UPDATED_AT,),
    bucketed_by=("text",),
)

GOLDEN = TableSpec(
    name="golden",
    schema=schema(
        normalizedText=TEXT,
        partOfSpeech=TEXT,
        phonetic=TEXT,
        forms=TEXTS,
        **_SEEN,
        definition=TEXT,
        **_SENSE_ARRAYS,
        translations=TEXTS,
        usage=DOUBLE,
        updatedAt=TIME,
    ),
    pk=("normalizedText", "definition"),
    copied=("normalizedText", "definition"),
    transformed=("forms", *_SEEN, "phonetic", "partOfSpeech", *_SENSE_ARRAYS),
    enriched=("translations", "usage"),
    metadata=(UPDATED_AT,),
    bucketed_by=("normalizedText", "definition"),
)

VOCABULARY_SHEET = TableSpec(
    name="vocabulary",
    schema=schema(
        id=LONG,
        status=TEXT,
        normalizedText=TEXT,
        partOfSpeech=TEXT,
        phonetic=TEXT,
        forms=TEXT,
        sources=TEXT,
        occurrences=LONG,
        firstOccurrence=TEXT,
        latestOccurrence=TEXT,
        definition=TEXT,
        examples=TEXT,
        synonyms=TEXT,
        antonyms=TEXT,
        translations=TEXT,
        usage=TEXT,
        tags=TEXT,
        notes=TEXT,
    ),
    pk=("id",),
    natural_pk=("normalizedText", "definition"),
)

# the vocabulary published as CSV snapshots: no user columns, and a stamp
VOCABULARY_CSV = TableSpec(
    name="vocabulary_csv",
    schema=schema(
        **{f.name: f.dataType for f in VOCABULARY_SHEET.schema.fields if f.name not in ("tags", "notes")},
        updatedAt=TIME,
    ),
    pk=("id",),
    natural_pk=VOCABULARY_SHEET.natural_pk,
    metadata=(UPDATED_AT,),
)

WORKLIST_SHEET = TableSpec(
    name="worklist",
    schema=schema(text=TEXT, books=TEXT, occurrences=LONG, firstOccurrence=TEXT, latestOccurrence=TEXT),
    pk=("text",),
)

DEFINITION_RESPONSE = T.ArrayType(
    schema(
        word=TEXT,
        phonetic=TEXT,
        meanings=T.ArrayType(
            schema(
                partOfSpeech=TEXT,
                definitions=T.ArrayType(schema(definition=TEXT, example=TEXT, synonyms=TEXTS, antonyms=TEXTS)),
            )
        ),
    )
)

_BACK_TRANSLATION = schema(normalizedText=TEXT, displayText=TEXT, numExamples=INT, frequencyCount=INT)

TRANSLATION_RESPONSE = T.ArrayType(
    schema(
        normalizedSource=TEXT,
        displaySource=TEXT,
        translations=T.ArrayType(
            schema(
                normalizedTarget=TEXT,
                displayTarget=TEXT,
                posTag=TEXT,
                confidence=DOUBLE,
                prefixWord=TEXT,
                backTranslations=T.ArrayType(_BACK_TRANSLATION),
            )
        ),
    )
)

USAGE_RESPONSE = T.ArrayType(schema(ngram=TEXT, parent=TEXT, type=TEXT, timeseries=T.ArrayType(DOUBLE)))
