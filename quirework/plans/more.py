"""More registered queries: all free-text rules, edits, permissions, bounded and script-safe text."""

from __future__ import annotations

from html import unescape as unescape_html

from pyspark.sql import functions as F

from quirework.functions import text as TX
from quirework.functions.detect import detect
from quirework.functions.freetext import FIELDS, parse
from quirework.functions.render import display_text, from_formatter, link_parts
from quirework.functions.reviews import review_warnings
from quirework.functions.validate import clean_date, errors, raw_link_text, readable
from quirework.operators import sets as S
from quirework.operators.api import import_paste
from quirework.operators.ordering import sorted_citations
from quirework.plans import oracle as Q
from quirework.plans.cites import cites
from quirework.plans.library import query, read
from quirework.schema import CITATION_COLUMNS, CSL_COLUMNS, DATE, FIELD_BYTES, NAMES
from quirework.schema import NAME as PERSON
from quirework.sources.pasted import paste_items, remaining_input
from quirework.sources.resolve import resolve_pmids
from quirework.storage import durable

#: One text for each rule, in order; {n} is a name, {y} a year.
RULES = (
    ("chapter", "low", "Jane Doe, “{n},” in The Whole, ed. Max Roe (Press, {y}), 5-9."),
    ("chapter", "low", "Doe, Jane. “{n}.” In The Whole, edited by Max Roe. Press, {y}, 5-9."),
    ("review-book", "medium", "Jane Doe. “{n}.” Review of The Book, by Max Roe. The Whole, March 3, {y}."),
    ("article-journal", "medium", "Doe, Jane. “{n}.” The Whole 12, no. 3 ({y}): 5-9. https://doi.org/10.1000/x."),
    ("article-journal", "medium", "Jane Doe, “{n},” The Whole 12 ({y}): 5-9."),
    ("article-journal", "low", "Jane Doe, “{n},” The Whole, Spring {y}, 5-9."),
    ("article-journal", "low", "Doe, J. ({y}). {n}. The Whole, 12(3), 5-9. doi:10.1000/x"),
    ("article-journal", "low", "Jane Doe ({y}). {n} (Vol. 2, pp. 5-9)."),
    ("book", "low", "Doe, J. ({y}). {n}. Press."),
    ("webpage", "low", "Doe, Jane. “{n}.” The Whole. Last modified March 3, {y}. https://example.org/a."),
    ("collection", "medium", "Jane Doe and Max Roe, eds. {n}. 2nd ed. Press, {y}. Kindle."),
    ("book", "medium", "Jane Doe. {n}. London, {y}. https://example.org/b."),
    ("thesis", "medium", "Jane Doe. “{n}.” PhD diss., Some University, {y}. Online."),
    ("book", "medium", "Jane Doe. {n}. 3rd ed. Press, {y}, 5-9."),
    ("book", "medium", "Jane Doe, {n} (Press, {y}), 5-9."),
)
NAME, YEAR = "'A ' || p_name", "(1990 + p_size % 30)"


def _sample(text: str) -> str:
    return "'" + text.replace("{n}", f"' || {NAME} || '").replace("{y}", f"' || {YEAR} || '") + "'"


def _cases(values) -> str:
    return "CASE p_partkey % 15 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


WITH_CONTAINER = [k for k, (_, _, t) in enumerate(RULES) if "The Whole" in t]


@query(
    f"""SELECT p_partkey, {_cases(f"'{k}'" for k, _, _ in RULES)} AS type, {_cases(f"'{c}'" for _, c, _ in RULES)} AS confidence,
    {NAME} AS title, {YEAR} AS year, CASE WHEN p_partkey % 15 IN ({', '.join(map(str, WITH_CONTAINER))}) THEN 'The Whole' END AS container_title,
    'Doe' AS family FROM part"""
)
def freetext_rules(spark, d):
    rows = read(spark, d, "part").select("p_partkey", parse(F.expr(_cases(_sample(t) for _, _, t in RULES))).alias("r"))
    first = F.coalesce(F.get(F.col("r.author"), 0), F.get(F.col("r.editor"), 0))
    return rows.select(
        "p_partkey", "r.type", "r.confidence", "r.title", TX.year_of(F.col("r.issued")).alias("year"), "r.container_title", first["family"].alias("family")
    )


@query(
    Q.with_cites(
        """SELECT bibliography_id, pos, CASE WHEN type = 'article-journal' AND pos % 2 = 0 AND pos % 3 = 0 THEN 'review-metadata-incomplete' ELSE '' END AS warnings FROM c"""
    )
)
def review_warning(spark, d):
    kind = F.when(F.col("pos") % 2 == 0, "doi").otherwise("pmid")
    page = F.when(F.col("pos") % 3 > 0, F.col("page"))
    found = review_warnings(kind, F.col("type"), F.col("container_title"), F.upper("title"), F.col("title"), page)
    return cites(spark, d).select("bibliography_id", "pos", F.array_join(found, ",").alias("warnings"))


#: Bytes are cut as hexadecimal digits; a character that the cut breaks goes.
_HEX = "left(hex(encode(text)), 131072)"
_CUT = f"""decode(unhex(left({_HEX}, 131064) || regexp_replace(right({_HEX}, 8), '^((?:..)*?)(?:F.(?:[89AB].){{0,2}}|E.(?:[89AB].)?|[CD].)$', '\\1')))"""
_TRIM = r"'^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g'"


@query(
    f"""WITH b AS (SELECT doc_id, CASE WHEN strlen(text) > 65536 THEN {_CUT} ELSE text END AS t FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<script[^>]*?>.*?</script>', '', 'gis'),
        '<style[^>]*?>.*?</style>', '', 'gis'), '<[^>]*>', '', 'g'), {_TRIM}) AS head FROM b"""
)
def bounded_text(spark, d):
    return read(spark, d, "documents").select("doc_id", TX.bounded(F.col("text")).alias("head"))


#: Inputs that no rule reads; {n} is a name.
REJECTED = (
    "Poe and Moe, {n}, 40–41.",
    "Lena Weaver, “{n},” The Harbour Evening Post, June 9, 2011, continued inside.",
    "Omar T. Field, \"{n},\" Annals of Weaving 4, no. 1 (2009): 3-8. Read this one before the exam.",
    "Press office notes, https://example.org/api.",
    "{n}",
    "“{n}.” Journal 12 (2001): 5-9.",
    "Jane Doe (n.d.). {n}. Press.",
    "Jane Doe, {n} (Press, forthcoming), 5.",
)


@query("SELECT p_partkey, NULL::VARCHAR AS type FROM part")
def freetext_rejects(spark, d):
    cases = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {_sample(t)}" for k, t in enumerate(REJECTED)) + " END"
    return read(spark, d, "part").select("p_partkey", parse(F.expr(cases))["type"].alias("type"))


#: References by name and number, and what they stand for.
REFERENCES = (
    "&eacute;&Eacute;&ccedil;&szlig;&oslash;&aring;&ntilde;&uuml;&Ouml;&aelig;&thorn;&eth;&Scaron;&zcaron;&sect;&para;&frac12;&frac34;&sup2;&deg;&plusmn;"
    "&times;&divide;&micro;&middot;&laquo;&raquo;&iquest;&iexcl;&euro;&pound;&yen;&cent;&alpha;&Omega;&le;&ge;&ne;&infin;&sum;&hearts;&trade;&copy;"
    "&#233;&#x1F600;&#1114109;&#0065;&#x00041;&NotEqualTilde;&fjlig;&amp;amp;"
)
KEPT = "&nosuchname;&#xD800;&#1114112;&#65535;&#128;&#99999999999999999999;&#x;&;& amp;"


@query(f"SELECT p_partkey, p_name || '{unescape_html(REFERENCES)}' || '{KEPT}' AS text FROM part")
def html_references(spark, d):
    return read(spark, d, "part").select("p_partkey", TX.unescape(F.concat("p_name", F.lit(REFERENCES + KEPT))).alias("text"))


@query(
    """SELECT page_id, 0 AS n, url AS text, url AS href FROM pages UNION ALL SELECT page_id, 1, ').).).:).);!?.', NULL FROM pages
    UNION ALL SELECT page_id, 2, ' and ', NULL FROM pages UNION ALL SELECT page_id, 3, url || '((a).b)', url || '((a).b)' FROM pages
    UNION ALL SELECT page_id, 4, '.,;', NULL FROM pages"""
)
def link_tails(spark, d):
    text = F.concat("url", F.lit(").).).:).);!?. and "), "url", F.lit("((a).b).,;"))
    rows = read(spark, d, "pages").select("page_id", F.posexplode(link_parts(text)).alias("n", "p"))
    return rows.select("page_id", "n", "p.text", "p.href")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN '{"title":"' || p_name || '"}' END AS csl_json FROM part"""
)
def pmid_items(spark, d):
    part = read(spark, d, "part")
    label = F.when(F.col("p_partkey") % 3 > 0, "PMID: ").otherwise("10.1000/")
    found = part.select("p_partkey", detect(F.concat(label, "p_partkey")).alias("i")).select("p_partkey", "i.format", "i.value")
    known = part.where("p_partkey % 2 = 0").select(
        F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit('{"title":"'), "p_name", F.lit('"}')).alias("csl_json")
    )
    return resolve_pmids(found, known).select("p_partkey", "csl_json")


@query(Q.with_cites(f"SELECT bibliography_id, title, {Q.position('author-date')} AS pos FROM c"))
def resorted(spark, d):
    return S.resorted(cites(spark, d), "harvard").select("bibliography_id", "title", F.col("pos").cast("long").alias("pos"))


@query(Q.with_cites("SELECT bibliography_id, pos, CASE WHEN pos % 2 = 0 THEN 'mine' END AS display_override FROM c"))
def reset_override(spark, d):
    rows = cites(spark, d).withColumn("display_override", F.lit("mine"))
    return S.reset_override(rows, rows.where("pos % 2 = 1").select("id")).select("bibliography_id", "pos", "display_override")


@query(
    Q.with_cites(
        """SELECT bibliography_id, count(*) + CASE WHEN bibliography_id % 2 = 1 OR any_value(DOI) FILTER (pos = 0) IS NULL THEN 1 ELSE 0 END AS entries
        FROM c GROUP BY bibliography_id"""
    )
)
def manual_additions(spark, d):
    """A form row is added unless it has the DOI of a stored citation."""
    rows = durable(cites(spark, d))  # read five times
    doi = F.when(F.col("bibliography_id") % 2 == 0, F.col("DOI"))
    new = rows.where("pos = 0").withColumn("DOI", doi).withColumn("title", F.concat(F.lit("Zz "), "id")).withColumn("id", F.concat(F.lit("new-"), "id"))
    return S.add_manual(rows, new, "apa-7").groupBy("bibliography_id").agg(F.count(F.lit(1)).alias("entries"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'issued_invalid' WHEN 1 THEN 'author_invalid' WHEN 2 THEN 'field_too_large' WHEN 3 THEN '' WHEN 4 THEN
    'type_unknown,issued_invalid' ELSE '' END AS errors, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE '1999' END AS year FROM part"""
)
def strict_validation(spark, d):
    """Dates without parts, names without parts, fields over the bound of bytes (not of characters)."""
    k, none = F.col("p_partkey") % 6, F.lit(None).cast("string")
    parts = F.when(k.isin(0, 4), F.expr("array(cast(array() as array<int>))")).when(k != 3, F.expr("array(array(1999, cast(null as int)))"))
    date = F.struct(parts.alias("date_parts"), F.when(k == 3, "in the spring").alias("literal"), none.alias("raw")).cast(DATE)
    person = F.struct(F.when(k != 1, F.lit("Doe")).alias("family"), none.alias("given"), none.alias("literal"), none.alias("ORCID")).cast(PERSON)
    fields = {name: F.lit(None).cast(kind) for name, kind in CSL_COLUMNS.items()}
    fields |= {"type": F.when(k == 4, "scroll").otherwise("book"), "issued": date, "author": F.array(person).cast(NAMES)}
    fields["title"] = F.when(k == 2, F.repeat(F.lit("é"), FIELD_BYTES // 2 + 1)).when(k == 5, F.repeat(F.lit("é"), FIELD_BYTES // 2)).otherwise(F.col("p_name"))
    rows = read(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in fields.items()])
    found = errors({n: F.col(n) for n in fields}, "strict")
    return rows.select("p_partkey", F.array_join(found, ",").alias("errors"), TX.iso_date(clean_date(F.col("issued"))).alias("year"))


@query(
    """SELECT p_partkey AS bibliography_id, unnest(CASE WHEN p_partkey % 2 = 0 THEN [0, 1, 2, 3] ELSE [0, 1] END)::BIGINT AS pos,
    unnest(CASE WHEN p_partkey % 2 = 0 THEN ['added', 'duplicate', 'error', 'added'] ELSE ['duplicate', 'added'] END) AS outcome FROM part"""
)
def imported(spark, d):
    """A paste of references of which some repeat, some are stored and some can't be read."""
    part = read(spark, d, "part")
    book = "'Jane Doe, A ' || p_name || ' (Press, 2001).'"
    fresh = f"{book} || '\n\n' || {book} || '\n\nnothing to read\n\nDoe, J. (1999). B ' || p_name || '. Press.'"
    stored = f"{book} || '\n\nRoe, M. (1999). C ' || p_name || '. Press.'"
    pastes = part.select(F.col("p_partkey").alias("paste_id"), F.expr(f"CASE WHEN p_partkey % 2 = 0 THEN {fresh} ELSE {stored} END").alias("text"))
    made = part.where("p_partkey % 2 = 1").select("p_partkey", F.explode(F.array(parse(F.expr(book)))).alias("r"))
    none = {k: F.lit(None).cast(t).alias(k) for k, t in CITATION_COLUMNS.items()}
    none |= {k: F.col(f"r.{k}") for k in CITATION_COLUMNS if k in FIELDS}
    none |= {"bibliography_id": F.col("p_partkey").alias("bibliography_id"), "pos": F.lit(0).cast(CITATION_COLUMNS.get("pos", "long")).alias("pos"), "id": F.concat(F.lit("s-"), "p_partkey").alias("id")}
    existing = durable(made.select(*none.values()))
    empty = spark.createDataFrame([], "key string, csl_json string")
    _, outcomes = import_paste(existing, pastes, "apa-7", empty, empty)
    # A position counts chunks in its upper half.
    return outcomes.select("bibliography_id", F.shiftright(F.col("pos").cast("long"), 31).alias("pos"), "outcome")


@query("SELECT page_id, replace(html, '<', chr(92) || 'u003c') AS json, " + Q.encoded("url") + " AS encoded FROM pages")
def script_json(spark, d):
    return read(spark, d, "pages").select("page_id", TX.script_safe(F.col("html")).alias("json"), TX.percent_encoded(F.col("url")).alias("encoded"))


@query("SELECT p_partkey, p_name || ' and more ' || p_brand AS text FROM part")
def formatter_entry(spark, d):
    raw = F.concat(F.lit(" [3] <div class='e'>"), "p_name", F.lit(" &amp;\n"), F.lit("more</div> "), "p_brand")
    text = from_formatter(raw, F.lit("ieee"), F.lit("numeric"))
    return read(spark, d, "part").select("p_partkey", F.replace(text, F.lit("&"), F.lit("and")).alias("text"))


@query(
    """SELECT source AS paste_id, 'c' || chr(10) || chr(10) || 'd' || chr(10) || chr(10) || 'a' AS remaining_input FROM documents GROUP BY source"""
)
def remaining(spark, d):
    pastes = read(spark, d, "documents").select(F.col("source").alias("paste_id")).distinct().withColumn("text", F.lit("a\n\nb\n\nc\n\nd"))
    found = paste_items(pastes, 2)
    return remaining_input(found, found.where("raw = 'a'"))


@query(
    """SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 OR o_orderkey % 7 = 0 AS readable FROM orders"""
)
def read_permission(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 2 == 0, "publish").otherwise("draft")
    password = F.when(k % 3 == 0, "pw")
    return read(spark, d, "orders").select("o_orderkey", readable(status, password, k % 5 > 0, k % 7 == 0).alias("readable"))


@query(Q.with_cites("SELECT bibliography_id, pos, CASE pos % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'stored' ELSE title END AS text FROM c"))
def shown_text(spark, d):
    own = F.when(F.col("pos") % 3 == 0, "own").otherwise("")
    stored = F.when(F.col("pos") % 3 < 2, "stored")
    return cites(spark, d).select("bibliography_id", "pos", display_text(own, stored, F.col("title")).alias("text"))


@query(
    Q.with_cites(
        """SELECT bibliography_id, pos, CASE WHEN pos = 1 THEN 'New' ELSE title END AS title, CASE WHEN pos = 1 THEN NULL ELSE publisher END AS publisher,
        CASE WHEN pos = 1 THEN 1999 ELSE year END AS year, CASE WHEN pos = 1 THEN 'Poe' ELSE coalesce(family, literal) END AS family FROM c"""
    )
)
def edit_fields(spark, d):
    rows = cites(spark, d)
    blank = F.lit("")
    forms = rows.where("pos = 1").select(
        "id", F.lit("Poe, Al").alias("authors"), F.lit(" New ").alias("title"), blank.alias("containerTitle"), blank.alias("publisher"),
        F.lit("1999").alias("year"), blank.alias("page"), blank.alias("doi"), blank.alias("url"),
    )
    first = F.get("author", 0)
    return S.edit_fields(rows, forms).select(
        "bibliography_id", "pos", "title", "publisher", TX.year_of(F.col("issued")).alias("year"), F.coalesce(first["family"], first["literal"]).alias("family")
    )


@query(
    Q.with_cites("SELECT bibliography_id, pos, CASE WHEN pos = 0 THEN 'Mine' WHEN pos = 1 THEN NULL ELSE 'old' END AS display_override FROM c")
)
def override_text(spark, d):
    rows = cites(spark, d).withColumn("display_override", F.lit("old"))
    texts = rows.where("pos < 2").select("id", F.when(F.col("pos") == 0, "Mine").otherwise(F.col("title")).alias("text"))
    return S.override_text(rows, texts).select("bibliography_id", "pos", "display_override")


@query(
    """SELECT o_orderkey AS bibliography_id, CASE WHEN o_orderkey % 3 = 1 THEN 'Mine' ELSE 'Works Cited' END AS heading_text, 'mla-9' AS citation_style FROM orders"""
)
def change_heading(spark, d):
    old = F.element_at(F.array(F.lit("References"), F.lit("Mine"), F.lit(" ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    heads = read(spark, d, "orders").select(F.col("o_orderkey").alias("bibliography_id"), old.alias("heading_text"))
    return S.change_heading(heads, "apa-7", "mla-9")


@query(Q.with_cites("SELECT bibliography_id, pos, pos % 2 = 0 AND (DOI IS NOT NULL OR URL IS NOT NULL) AS raw FROM c"))
def raw_links(spark, d):
    bare = F.when(F.col("pos") % 4 == 0, "https://x.org/a").when(F.col("pos") % 4 == 2, "10.1000/x").otherwise(F.col("title"))
    return cites(spark, d).select("bibliography_id", "pos", raw_link_text(bare, F.col("URL"), F.col("DOI")).alias("raw"))


@query(
    f"""WITH c AS (SELECT * REPLACE (CASE WHEN pos % 2 = 0 THEN translate(family, 'Supie', 'ŠüṗïÉ') ELSE family END AS family) FROM ({Q.CITES}))
    SELECT bibliography_id, pos, (row_number() OVER (PARTITION BY bibliography_id
        ORDER BY strip_accents({Q.A1}), {Q.TS}, year NULLS LAST, pos) - 1)::BIGINT AS position FROM c"""
)
def sort_accents(spark, d):
    """Names of which every second one has accents and capitals sort as those without."""
    rows = cites(spark, d)
    accented = F.transform("author", lambda n: n.withField("family", F.translate(n["family"], "Supie", "ŠüṗïÉ")))
    first = F.concat(F.slice(accented, 1, 1), F.slice("author", 2, 9))
    rows = rows.withColumn("author", F.when(F.col("pos") % 2 == 0, first).otherwise(F.col("author")))
    return sorted_citations(rows, "chicago-notes-bibliography").select("bibliography_id", "pos", "position")
