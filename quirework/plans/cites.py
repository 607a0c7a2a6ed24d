"""Citations derived from the TPC-H-like tables: the same SQL runs on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.schema import CITATION_COLUMNS, DATE, NAME, NAMES

#: One row per order line; flat columns, from which names and dates are made.
CITES = """
    SELECT l_orderkey AS bibliography_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
            l_shipdate, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS pos,
        CASE p_size % 6 WHEN 0 THEN 'book' WHEN 1 THEN 'article-journal' WHEN 2 THEN 'chapter' WHEN 3 THEN 'thesis'
            WHEN 4 THEN 'webpage' ELSE 'report' END AS type,
        CASE p_partkey % 3 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN 'A ' || p_name ELSE p_name END AS title,
        CASE WHEN p_partkey % 11 = 0 OR l_linenumber % 5 = 0 THEN NULL ELSE s_name END AS family,
        CASE WHEN p_partkey % 11 = 0 OR l_linenumber % 5 = 0 THEN NULL ELSE p_brand END AS given,
        CASE WHEN p_partkey % 11 <> 0 AND l_linenumber % 5 = 0 THEN s_name END AS literal,
        CASE WHEN p_partkey % 11 <> 0 AND l_linenumber % 3 = 0 THEN 'Coauthor ' || p_type END AS family2,
        CASE WHEN p_partkey % 11 <> 0 AND l_linenumber % 3 = 0 THEN 'Jo Ann' END AS given2,
        CASE WHEN p_partkey % 11 = 0 AND p_partkey % 2 = 0 THEN 'Editor' END AS family_e,
        CASE WHEN p_partkey % 11 = 0 AND p_partkey % 2 = 0 THEN p_brand END AS given_e,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year,
        CASE WHEN l_linenumber % 2 = 0 THEN CAST(month(o_orderdate) AS INT) END AS month,
        p_type AS container_title, p_brand AS publisher,
        '' || CAST(l_quantity AS INT) AS volume, '' || (p_size % 4) AS issue,
        '' || (l_linenumber * 10) || CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE '–' || (l_linenumber * 10 + p_size) END AS page,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '10.' || (1000 + l_suppkey) || '/' || p_partkey || '(x)' END AS DOI,
        CASE WHEN p_size % 6 = 4 THEN 'https://example.org/p/' || p_partkey END AS URL,
        CASE WHEN p_size % 6 = 0 THEN '978-' || p_partkey END AS isbn1,
        CASE WHEN p_size % 6 = 1 THEN '1234-' || p_size END AS issn1
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey
"""
TABLES = ("lineitem", "orders", "part", "supplier")


#: The join that shares its key with the window of places, and the joins before which CITES names it.
_ORDERS = "    JOIN orders ON l_orderkey = o_orderkey\n"
_OTHERS = "    JOIN part ON l_partkey = p_partkey\n    JOIN supplier ON l_suppkey = s_suppkey\n"


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CITES on the tables of a folder. Orders are joined last: the rows are then dealt by order once, for this join, the places and what follows."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = CITES.replace(_ORDERS + _OTHERS, _OTHERS + _ORDERS)
    for t in TABLES:
        text = text.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"JOIN {t} ON", f"JOIN {{{t}}} ON")
    return spark.sql(text, **frames)


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CITES as citations of the data model."""
    none = F.lit(None).cast("string")

    def person(family: str, given: str, literal=none):
        return F.struct(F.col(family).alias("family"), F.col(given).alias("given"), literal.alias("literal"), none.alias("ORCID")).cast(NAME)

    def some(*people):
        return F.filter(F.array(*people), lambda n: n["family"].isNotNull() | n["literal"].isNotNull()).cast(NAMES)

    parts = F.array_compact(F.array("year", F.when(F.col("year").isNotNull(), F.col("month"))))
    issued = F.when(F.col("year").isNotNull(), F.struct(F.array(parts).alias("date_parts"), none.alias("literal"), none.alias("raw"))).cast(DATE)
    made = {
        "id": F.concat_ws("-", F.lit("c"), "bibliography_id", "pos"),
        "author": some(person("family", "given", F.col("literal")), person("family2", "given2")),
        "editor": some(person("family_e", "given_e")),
        "issued": issued,
        "ISBN": F.array_compact(F.array("isbn1")),
        "ISSN": F.array_compact(F.array("issn1")),
    }
    rows = flat(spark, sf_dir)
    picked = []
    for name, kind in CITATION_COLUMNS.items():
        if name in made:
            picked.append(made[name].cast(kind).alias(name))
        elif name in rows.columns:
            picked.append(F.col(name))
        else:
            picked.append(F.lit(None).cast(kind).alias(name))
    return rows.select(*picked)
