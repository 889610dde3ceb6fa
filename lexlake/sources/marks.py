"""Marks from a reader's database or from a CSV export of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions import fixed_values as fixed
from lexlake.spec import MARKS


def read_marks(tags: DataFrame, items: DataFrame, books: DataFrame, tag_id: int = fixed.MARK_TAG_ID) -> DataFrame:
    """Marks with the book they were left in: tag -> its item -> the item's parent -> the parent's book."""
    item, parent = items.alias("item"), items.alias("parent")
    joined = (
        tags.where(F.col("TagID") == tag_id)
        .alias("tag")
        .join(item, F.col("tag.ItemID") == F.col("item.OID"))
        .join(parent, F.col("item.ParentID") == F.col("parent.OID"))
        .join(books.alias("book"), F.col("parent.OID") == F.col("book.OID"))
    )
    return joined.select(
        F.col("tag.OID").alias("oid"),
        F.col("tag.Val").alias("val"),
        F.col("book.Title").alias("title"),
        F.col("book.Authors").alias("authors"),
        F.col("tag.TimeEdt").alias("timeEdt"),
    )


def marks_query(tag_id: int = fixed.MARK_TAG_ID) -> str:
    """The same join as SQL for the database to run."""
    return f"""
        SELECT tag.OID AS oid, tag.Val AS val, book.Title AS title, book.Authors AS authors, tag.TimeEdt AS "timeEdt"
        FROM Tags tag, Items item, Items parent, Books book
        WHERE tag.TagID = {tag_id} AND item.OID = tag.ItemID AND parent.OID = item.ParentID AND book.OID = parent.OID
    """


def read_marks_jdbc(
    spark: SparkSession, url: str, driver: str, tag_id: int = fixed.MARK_TAG_ID, **options: str
) -> DataFrame:
    """Marks from a database that joins and filters itself; a filter on ``oid`` is pushed down as well.

    Needs the driver's jar. ``partitionColumn="oid"`` with its bounds among the options splits a large read.
    """
    source = {"url": url, "driver": driver, "dbtable": f"({marks_query(tag_id)}) marks", **options}
    return spark.read.format("jdbc").options(**source).load()


def read_marks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Marks from CSV with a header, ordered by id; a header or a row that does not fit raises."""
    reader = spark.read.schema(MARKS.schema).options(
        header=True,
        multiLine=True,
        mode="FAILFAST",
        enforceSchema=False,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return reader.csv(path).orderBy("oid")
