"""Citations for tests, from short rows."""

from pyspark.sql import functions as F

from quirework.schema import CITATION_COLUMNS, CITATION_DDL


def person(family=None, given=None, literal=None):
    return (family, given, literal, None)


def citations(spark, rows):
    """rows: dicts of citation columns; year makes issued, and bibliography_id, pos and id have defaults."""
    table = []
    for k, row in enumerate(rows):
        row = {"bibliography_id": 1, "pos": k, "id": f"c{k}", "type": "book", "author": [], "editor": [], "ISBN": [], "ISSN": []} | row
        if "year" in row:
            row["issued"] = ([[row.pop("year")]], None, None)
        table.append(tuple(row.get(c) for c in CITATION_COLUMNS))
    return spark.createDataFrame(table, CITATION_DDL)


def value(spark, column):
    """A column's value on one row."""
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, texts, make):
    """make(column) over texts, in order."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", make(F.col("t")).alias("v"))
    return [r["v"] for r in sorted(rows.collect(), key=lambda r: r["k"])]
