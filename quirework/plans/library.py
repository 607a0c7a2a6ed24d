"""The queries of the library's operators and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import exports as X
from quirework.functions import names as N
from quirework.functions import text as TX
from quirework.functions.detect import detect, embedded
from quirework.functions.freetext import parse
from quirework.functions.render import link_parts, render, segments
from quirework.functions.reviews import review_title
from quirework.functions.validate import errors, linkable
from quirework.operators import aggregate as A
from quirework.operators import dedupe as D
from quirework.operators import documents as DOC
from quirework.operators import ordering as O
from quirework.operators import sets as S
from quirework.plans import oracle as Q
from quirework.plans.cites import cites
from quirework.schema import STYLES, with_styles
from quirework.sources import blocks as B
from quirework.sources.bibtex import read_bibtex
from quirework.sources.manual import manual_citations
from quirework.sources.pasted import paste_errors, paste_items, without_known_dois
from quirework.sources.resolve import csl_type, pmid_status, resolve_dois
from quirework.storage import durable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, and its oracle if it has one."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Ordering.
def _sorted(style: str):
    return lambda spark, d: O.sorted_citations(cites(spark, d), style).select("bibliography_id", "pos", "position")


for _name, _style, _family in (
    ("sort_notes", "chicago-notes-bibliography", "notes"),
    ("sort_author_date", "apa-7", "author-date"),
    ("sort_abnt", "abnt", "author-date"),
    ("sort_numeric", "ieee", "numeric"),
):
    query(Q.with_cites(f"SELECT bibliography_id, pos, {Q.position(_family)} AS position FROM c"), _name)(_sorted(_style))


@query(
    Q.with_cites(
        f"""SELECT bibliography_id, string_agg('c-' || bibliography_id || '-' || pos, ',' ORDER BY {Q.ORDER['author-date']}) AS ids
        FROM c GROUP BY bibliography_id"""
    )
)
def sort_exact(spark, d):
    rows = O.exact_order(cites(spark, d), "apa-7")
    return rows.select("bibliography_id", F.array_join("ids", ",").alias("ids"))


# Rendering.
def _rendered(style: str):
    return lambda spark, d: cites(spark, d).select("bibliography_id", "pos", render(style, S.csl()).alias("text"))


for _name, _style, _template in (
    ("format_notes", "mla-9", "notes"),
    ("format_author_date", "harvard", "author-date"),
    ("format_numeric", "vancouver", "numeric"),
):
    query(Q.with_cites(f"SELECT bibliography_id, pos, {Q.rendered(_template)} AS text FROM c"), _name)(_rendered(_style))


_STYLE_ROWS = ", ".join("('" + "', '".join(r) + "')" for r in STYLES)


@query(
    f"""SELECT o_orderkey AS bibliography_id, label, template, list_type, family, locale, heading
    FROM orders JOIN (SELECT *, row_number() OVER () - 1 AS n FROM (VALUES {_STYLE_ROWS}) AS t(style, label, template, list_type, family, locale, heading)) AS s
    ON n = CASE WHEN o_orderkey % 11 > 8 THEN 0 ELSE o_orderkey % 11 END"""
)
def style_dimension(spark, d):
    """Each bibliography with its style's row; an unknown style has the default's."""
    keys = F.array(*[F.lit(r[0]) for r in STYLES], F.lit("unknown"), F.lit(""))
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("bibliography_id"), F.get(keys, (F.col("o_orderkey") % 11).cast("int")).alias("key"))
    return with_styles(rows, "key").drop("key", "style")


@query(
    Q.with_cites(
        f"""SELECT bibliography_id, pos, CASE WHEN type IN ('book', 'thesis', 'webpage', 'report') THEN title ELSE container_title END AS italic_text
        FROM c"""
    )
)
def italic_segments(spark, d):
    rows = cites(spark, d)
    text = render("mla-9", S.csl())
    none = F.lit(None).cast("string")
    parts = segments(text, none, F.col("type"), F.col("title"), F.col("container_title"))
    return rows.select("bibliography_id", "pos", F.get(F.filter(parts, lambda s: s["italic"]), 0)["text"].alias("italic_text"))


@query(
    Q.with_cites(
        f"""SELECT bibliography_id, string_agg({Q.rendered('notes')}, chr(10) ORDER BY {Q.ORDER['notes']}) || chr(10) AS content
        FROM c GROUP BY bibliography_id"""
    )
)
def export_plain(spark, d):
    style = "chicago-notes-bibliography"
    return DOC.plain_text(S.formatted_in(cites(spark, d), style), style)


@query(Q.with_cites("SELECT bibliography_id, string_agg(title, chr(10) ORDER BY pos) AS content FROM c GROUP BY bibliography_id"))
def read_text(spark, d):
    return DOC.stored_text(cites(spark, d))


# Duplicates.
@query(
    Q.with_cites(
        """SELECT bibliography_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY bibliography_id, type ORDER BY pos) AS n
        FROM c WHERE DOI IS NOT NULL) WHERE n > 1"""
    )
)
def dedupe_doi(spark, d):
    """DOIs that repeat by type, written in several ways."""
    doi = F.concat(F.lit("10.1000/"), "type")
    written = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("https://doi.org/"), doi)).when(F.col("pos") % 3 == 1, F.upper(doi)).otherwise(F.concat(F.lit(" http://dx.doi.org/"), doi, F.lit(").")))
    rows = cites(spark, d).withColumn("DOI", F.when(F.col("DOI").isNotNull(), written))
    return D.repeats_of_key(rows, [TX.doi_dedupe(F.col("DOI"))]).select("bibliography_id", "pos")


@query(
    Q.with_cites(
        f"""SELECT bibliography_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY bibliography_id, {Q.TITLE_MATCH}, year ORDER BY pos) AS n
        FROM c WHERE year IS NOT NULL) WHERE n > 1"""
    )
)
def dedupe_title_year(spark, d):
    rows = cites(spark, d)
    return D.repeats_of_key(rows, [TX.match_text(F.col("title")), TX.year_of(F.col("issued"))]).select("bibliography_id", "pos")


PAIRS = f"""
    k AS (SELECT bibliography_id, pos, {Q.DOI_MATCH} AS d, {Q.TITLE_MATCH} AS t, year AS y,
        {Q.AUTHOR_MATCH} AS a FROM c),
    pairs AS (SELECT x.bibliography_id, x.pos AS a_pos, z.pos AS b_pos FROM k x JOIN k z
        ON x.bibliography_id = z.bibliography_id AND x.pos < z.pos
        AND (x.d = z.d OR (x.t = z.t AND (coalesce(x.y = z.y, false) OR coalesce(x.a = z.a, false)
            OR (x.y IS NULL AND z.y IS NULL AND x.a IS NULL AND z.a IS NULL)))))
"""


@query(Q.with_cites("SELECT bibliography_id, a_pos, b_pos FROM pairs", PAIRS))
def dedupe_pairs(spark, d):
    keyed = D.match_keys(cites(spark, d))
    return D.matching_pairs(keyed, keyed, ["bibliography_id"], F.col("a.pos") < F.col("b.pos"))


@query(
    Q.with_cites(
        "SELECT bibliography_id, min(a_pos) AS duplicate_of, b_pos AS pos FROM pairs GROUP BY bibliography_id, b_pos",
        PAIRS.replace("x.pos < z.pos", "true"),
    )
)
def dedupe_first(spark, d):
    """Every row against every stored row of its bibliography, itself among them."""
    rows = cites(spark, d)
    return D.first_duplicates(rows, rows)


@query(
    f"""WITH RECURSIVE c AS ({Q.CITES}), {PAIRS},
    before AS (SELECT bibliography_id, b_pos, list(a_pos) AS l FROM pairs GROUP BY ALL),
    last AS (SELECT bibliography_id, max(pos) AS m FROM c GROUP BY bibliography_id),
    g(bibliography_id, step, rejected) AS (
        SELECT bibliography_id, 0::BIGINT, []::BIGINT[] FROM last
        UNION ALL
        SELECT g.bibliography_id, g.step + 1, CASE WHEN b.l IS NOT NULL AND len(list_filter(b.l, lambda p: NOT list_contains(g.rejected, p))) > 0
            THEN list_append(g.rejected, g.step) ELSE g.rejected END
        FROM g JOIN last USING (bibliography_id) LEFT JOIN before b ON b.bibliography_id = g.bibliography_id AND b.b_pos = g.step
        WHERE g.step <= last.m)
    SELECT c.bibliography_id, c.pos, list_contains(g.rejected, c.pos) AS duplicate
    FROM c JOIN last USING (bibliography_id) JOIN g ON g.bibliography_id = c.bibliography_id AND g.step = last.m + 1"""
)
def dedupe_partition(spark, d):
    # What the match rule reads, written once: citations are read before the rounds and after them.
    rows = durable(cites(spark, d).select("bibliography_id", "pos", "DOI", "title", "issued", "author"))
    return D.partition_duplicates(rows).select("bibliography_id", "pos", "duplicate")


@query(
    Q.with_cites(
        "SELECT o.bibliography_id, o.pos FROM c o WHERE NOT EXISTS (SELECT 1 FROM c e WHERE e.pos % 2 = 0 "
        "AND e.bibliography_id = o.bibliography_id AND lower(e.DOI) = lower(o.DOI))"
    )
)
def existing_doi_anti(spark, d):
    """All rows as items, those without a DOI as free text; stored are all rows, of which odd ones got another DOI."""
    rows = cites(spark, d).withColumnRenamed("bibliography_id", "paste_id")
    found = rows.select("paste_id", "pos", F.when(F.col("DOI").isNull(), "freetext").otherwise("doi").alias("format"), F.coalesce("DOI", "title").alias("value"))
    known = rows.select("paste_id", F.when(F.col("pos") % 2 == 0, F.upper("DOI")).otherwise(F.concat("DOI", F.lit("/other"))).alias("DOI"))
    new, _ = without_known_dois(found, known)
    return new.select(F.col("paste_id").alias("bibliography_id"), "pos")


# Normalisers.
@query(
    Q.with_cites(
        rf"""SELECT bibliography_id, pos, regexp_replace('https://doi.org/' || DOI || '.', '[).,;:\s]+$', '') AS input,
        lower(regexp_replace(DOI, '[).,;:\s]+$', '')) AS lookup, {Q.DOI_MATCH} AS dedupe FROM c"""
    )
)
def doi_forms(spark, d):
    rows = cites(spark, d)
    written = F.concat(F.lit(" https://doi.org/"), "DOI", F.lit(". "))
    return rows.select(
        "bibliography_id", "pos", TX.doi_input(written).alias("input"), TX.doi_lookup(F.concat(F.lit("DOI:"), "DOI")).alias("lookup"),
        TX.doi_dedupe(F.col("DOI")).alias("dedupe"),
    )


MINOR = "['" + "', '".join(N.MINOR_WORDS) + "']"


@query(
    f"""WITH w AS (SELECT p_partkey, string_split(lower('on the ' || p_name || ' of ' || p_type || ': a ' || p_name || ' to'), ' ') AS l FROM part)
    SELECT p_partkey, array_to_string(list_transform(l, lambda x, i: CASE WHEN list_contains({MINOR}, x) AND i > 1 AND i < len(l)
        AND NOT ends_with(l[i - 1], ':') THEN x ELSE upper(x[1]) || x[2:] END), ' ') AS title FROM w"""
)
def title_case(spark, d):
    title = F.upper(F.concat(F.lit("on the "), "p_name", F.lit(" of "), "p_type", F.lit(": a "), "p_name", F.lit(" to")))
    return read(spark, d, "part").select("p_partkey", N.title_case(title).alias("title"))


@query("SELECT c_custkey, 'van der ' || c_name AS family, 'J. D.' AS given, 'Mary-Ann' AS given2 FROM customer")
def name_case(spark, d):
    family = N.name_token_case(F.upper(F.concat(F.lit("van der "), "c_name")), False)
    given = [N.name_token_case(F.lit(v), True) for v in ("J. D.", "MARY-ANN")]
    return read(spark, d, "customer").select("c_custkey", family.alias("family"), given[0].alias("given"), given[1].alias("given2"))


@query("SELECT page_id, " + "regexp_replace(" * 4 + "html" + ", '<[^>]*>', '', 'g')" * 4 + " AS text FROM pages")
def strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", TX.strip_tags(F.col("html")).alias("text"))


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*?>.*?</script>', '', 'gis'),
        '<style[^>]*?>.*?</style>', '', 'gis'), '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages"""
)
def strip_markup(spark, d):
    return read(spark, d, "pages").select("page_id", TX.strip_markup(F.col("html")).alias("text"))


@query(
    r"""WITH n AS (SELECT doc_id, regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^\p{L}\p{N}\s]', '', 'g') AS t FROM documents)
    SELECT md5(t) AS key, count(*) AS copies, min(doc_id) AS first FROM n GROUP BY t HAVING count(*) > 1"""
)
def norm_text_dups(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.md5(TX.match_text(F.col("text"))).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query(Q.with_cites(f"SELECT bibliography_id, pos, {Q.FIRST_PAGE} AS first, {Q.LAST_PAGE} AS last FROM c"))
def page_bounds(spark, d):
    bounds = TX.page_bounds(F.col("page"))
    return cites(spark, d).select("bibliography_id", "pos", bounds["first"].alias("first"), bounds["last"].alias("last"))


@query(Q.with_cites(f"SELECT bibliography_id, pos, {Q.ISO} AS date FROM c"))
def partial_date(spark, d):
    return cites(spark, d).select("bibliography_id", "pos", TX.iso_date(F.col("issued")).alias("date"))


@query(
    Q.with_cites(
        "SELECT bibliography_id, pos, coalesce(family, literal, 'Unknown') || coalesce(' ' || year, '') AS label FROM c"
    )
)
def entry_label(spark, d):
    return cites(spark, d).select("bibliography_id", "pos", N.entry_label(F.col("author"), F.col("issued")).alias("label"))


@query(
    Q.with_cites(
        """SELECT bibliography_id, pos, nullif(concat_ws('; ', coalesce(family || ', ' || given, literal), family2 || ', ' || given2), '') AS printed,
        len(list_filter([coalesce(family, literal), family2], lambda x: x IS NOT NULL))::INT AS n FROM c"""
    )
)
def names_field(spark, d):
    printed = TX.blank_to_null(N.printed_names(F.col("author")))
    return cites(spark, d).select("bibliography_id", "pos", printed.alias("printed"), F.size(N.names_from_field(printed)).alias("n"))


@query(
    Q.with_cites(
        """SELECT bibliography_id, pos, CASE WHEN coalesce(family, literal) IS NOT NULL OR year IS NOT NULL
        THEN replace(concat_ws('-', replace(coalesce(family, literal), '#', ''), year), ' ', '-') ELSE replace(title, ' ', '-') END AS base FROM c"""
    )
)
def file_names(spark, d):
    first = F.get("author", 0)
    who = F.coalesce(first["family"], first["literal"])
    base = TX.slug(F.lit(None).cast("string"), who, TX.year_of(F.col("issued")), F.col("title"))
    return cites(spark, d).select("bibliography_id", "pos", base.alias("base"))


@query(
    """SELECT p_partkey, 'Tom & "Jerry" <' || p_name || '> – ©A' AS text, p_name || ' v. 12, n. 3, p. 4' AS abnt, p_name || '.' AS numeric FROM part"""
)
def formatter_text(spark, d):
    raw = F.concat(F.lit("  Tom &amp; &quot;Jerry&quot;  &lt;"), "p_name", F.lit("&gt; &ndash; &#169;&#x41; "))
    # Decoded brackets would be markup: spaces keep them text.
    raw = F.replace(raw, F.lit("&lt;"), F.lit("&amp;lt;"))
    decoded = F.replace(TX.collapse(TX.unescape(raw)), F.lit("&lt;"), F.lit("<"))
    abnt = F.concat("p_name", F.lit(" v. vol. 12, n. no. 3, p. pp. 4"))
    numeric = F.concat(F.lit("[12] "), "p_name", F.lit("."))
    return read(spark, d, "part").select(
        "p_partkey",
        decoded.alias("text"),
        TX.style_fixes(abnt, F.lit("abnt"), F.lit("author-date")).alias("abnt"),
        TX.style_fixes(numeric, F.lit("ieee"), F.lit("numeric")).alias("numeric"),
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Ann B. Reviewed. A ' || p_name ELSE p_name END AS title FROM part"""
)
def review_titles(spark, d):
    long = F.concat(F.lit("Ann B. Reviewed. A "), "p_name", F.lit(". New York, 1999. 123 pp. $45."))
    title = F.when(F.col("p_partkey") % 2 == 0, long).otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", review_title(F.lit("article-journal"), title, F.lit("J")).alias("title"))


# Detection.
CHUNK = """CASE p_partkey % 5 WHEN 0 THEN p_name || '. https://doi.org/10.1234/x' || p_partkey || '.' WHEN 1 THEN p_name || ', PMID: ' || p_partkey
    WHEN 2 THEN 'as DOI:10.5555/' || p_partkey || ');' WHEN 3 THEN 'see abc10.1234/x' ELSE p_name END"""


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2) THEN 'doi' WHEN p_partkey % 5 = 1 THEN 'pmid' END AS format,
    CASE p_partkey % 5 WHEN 0 THEN 'https://doi.org/10.1234/x' || p_partkey WHEN 1 THEN 'PMID:' || p_partkey WHEN 2 THEN '10.5555/' || p_partkey END AS value
    FROM part"""
)
def embedded_identifier(spark, d):
    found = embedded(F.expr(CHUNK))
    return read(spark, d, "part").select("p_partkey", found["format"].alias("format"), found["value"].alias("value"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pmid' WHEN 1 THEN 'doi' WHEN 2 THEN 'bibtex' WHEN 3 THEN 'doi' ELSE 'freetext' END AS format,
    p_partkey % 5 = 3 AS has_fallback FROM part"""
)
def detect_format(spark, d):
    chunk = F.expr(
        """CASE p_partkey % 5 WHEN 0 THEN 'pmid: ' || p_partkey WHEN 1 THEN 'doi:10.1000/' || p_partkey
        WHEN 2 THEN '@book{k' || p_partkey || ', title={x}}' WHEN 3 THEN 'In 10.1000/' || p_partkey || ' we see' ELSE p_name END"""
    )
    found = detect(chunk)
    return read(spark, d, "part").select("p_partkey", found["format"].alias("format"), found["fallback"].isNotNull().alias("has_fallback"))


def _pastes(spark, d):
    text = F.concat(
        F.lit("PMID: 1\n doi:10.1000/"), "p_partkey", F.lit("\n\n@book{a"), "p_partkey", F.lit(", title={T}}@misc{b, title={U}}\n \n"),
        "p_name", F.lit(". 2001.\nAnother line (here)\n\nplain\n"), "p_name",
    )
    return read(spark, d, "part").select(F.col("p_partkey").alias("paste_id"), text.alias("text"))


@query(
    """SELECT p_partkey AS paste_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS n,
    unnest(['pmid', 'doi', 'bibtex', 'bibtex', 'freetext', 'freetext', 'freetext']) AS format,
    unnest(['PMID: 1', 'doi:10.1000/' || p_partkey, '@book{a' || p_partkey || ', title={T}}', '@misc{b, title={U}}',
        p_name || '. 2001.', 'Another line (here)', 'plain ' || p_name]) AS value FROM part"""
)
def split_items(spark, d):
    from pyspark.sql import Window

    found = paste_items(_pastes(spark, d))
    n = F.row_number().over(Window.partitionBy("paste_id").orderBy("pos")) - 1
    return found.select("paste_id", n.alias("n"), "format", "value")


@query(
    """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) > 50 AS overflow FROM documents"""
)
def paste_cap(spark, d):
    return A.first_per_group(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query(
    r"""SELECT p_partkey AS paste_id, CASE p_partkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'latex_document' END AS error FROM part WHERE p_partkey % 3 < 2"""
)
def paste_guards(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, " \n ").when(F.col("p_partkey") % 3 == 1, r"see \parencite{a}").otherwise(F.col("p_name"))
    return paste_errors(read(spark, d, "part").select(F.col("p_partkey").alias("paste_id"), text.alias("text")))


# Free text.
def _free(spark, d, text):
    rows = read(spark, d, "part").select("p_partkey", parse(F.expr(text)).alias("r"))
    first = F.get(F.col("r.author"), 0)
    return rows.select(
        "p_partkey", "r.type", "r.title", "r.container_title", "r.publisher", "r.page", "r.volume", "r.issue", "r.DOI",
        TX.year_of(F.col("r.issued")).alias("year"), first["family"].alias("family"), first["given"].alias("given"),
        F.size("r.author").alias("authors"), "r.confidence",
    )


def _expected(**values) -> str:
    fields = ("type", "title", "container_title", "publisher", "page", "volume", "issue", "DOI")
    picked = ", ".join(f"{values.get(k, 'NULL::VARCHAR')} AS {k}" for k in fields)
    return f"""SELECT p_partkey, {picked}, 1990 + p_size % 30 AS year, 'Doe' AS family, {values['given']} AS given,
        {values['authors']} AS authors, {values['confidence']} AS confidence FROM part"""


@query(
    _expected(type="'book'", title="p_name || ' at ' || p_type", publisher="p_brand", page="'' || p_size", given="'Jane'", authors="2", confidence="'medium'")
)
def freetext_book(spark, d):
    return _free(spark, d, "'Jane Doe and John Roe, ' || p_name || ' at ' || p_type || ' (' || p_brand || ', ' || (1990 + p_size % 30) || '), ' || p_size || '.'")


@query(
    _expected(
        type="'article-journal'", title="p_name", container_title="'Journal of ' || p_type", page="p_size || '-' || (p_size + 9)", volume="'' || p_size",
        issue="'4'", DOI="'10.1000/' || p_partkey", given="'Jane'", authors="1", confidence="'medium'",
    )
)
def freetext_journal(spark, d):
    return _free(
        spark,
        d,
        """'Jane Doe, “' || p_name || ',” Journal of ' || p_type || ' ' || p_size || ', no. 4 (' || (1990 + p_size % 30) || '): ' || p_size || '-'
        || (p_size + 9) || '. https://doi.org/10.1000/' || p_partkey || '.'""",
    )


@query(_expected(type="'book'", title="p_name", publisher="p_brand", given="'J.'", authors="2", confidence="'low'"))
def freetext_apa_book(spark, d):
    return _free(spark, d, "'Doe, J., & Roe, R. (' || (1990 + p_size % 30) || '). ' || p_name || '. ' || p_brand || '.'")


@query(
    _expected(
        type="'chapter'", title="p_name", container_title="'The ' || p_type", publisher="p_brand", page="'5-9'", given="'Jane'", authors="1", confidence="'low'"
    )
)
def freetext_chapter(spark, d):
    return _free(
        spark,
        d,
        """'Jane Doe. “' || p_name || '.” In The ' || p_type || ', edited by Max Roe. ' || p_brand || ', ' || (1990 + p_size % 30) || ', 5-9.'""",
    )


# Validation.
@query(
    Q.with_cites(
        """SELECT bibliography_id, pos, CASE WHEN pos % 4 = 0 THEN 'type_unknown' WHEN pos % 4 = 1 THEN 'type_missing' ELSE '' END AS errors FROM c"""
    )
)
def validate_records(spark, d):
    wrong = F.when(F.col("pos") % 4 == 0, "scroll").when(F.col("pos") % 4 == 1, "").otherwise(F.col("type"))
    found = errors(S.csl() | {"type": wrong}, "strict")
    return cites(spark, d).select("bibliography_id", "pos", F.array_join(found, ",").alias("errors"))


@query("SELECT page_id, regexp_matches(url, '^https?://') AS linkable, false AS script FROM pages")
def link_schemes(spark, d):
    return read(spark, d, "pages").select("page_id", linkable(F.col("url")).alias("linkable"), linkable(F.concat(F.lit("javascript:"), "url")).alias("script"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'type_required' WHEN 1 THEN 'title_required' WHEN 2 THEN 'doi_invalid' WHEN 3 THEN 'url_invalid' END AS error,
    CASE p_partkey % 5 WHEN 4 THEN '10.1000/' || p_partkey END AS DOI, CASE p_partkey % 5 WHEN 4 THEN 1999 END AS year,
    'Doe' AS family FROM part"""
)
def manual_entry(spark, d):
    k = F.col("p_partkey") % 5
    rows = read(spark, d, "part").select(
        "p_partkey",
        F.when(k == 0, " ").otherwise("book").alias("type"),
        F.lit("Doe, Jane; Acme Corp").alias("authors"),
        F.when(k == 1, "").otherwise(F.col("p_name")).alias("title"),
        F.lit("").alias("containerTitle"),
        F.col("p_brand").alias("publisher"),
        F.when(k == 4, "1999").otherwise("c. 1999").alias("year"),
        F.lit("").alias("page"),
        F.when(k == 2, "https://doi.org/10.1/x").when(k == 4, F.concat(F.lit("doi:10.1000/"), "p_partkey")).alias("doi"),
        F.when(k == 3, "ftp://x.org").alias("url"),
    )
    made = manual_citations(rows)
    return made.select("p_partkey", "error", "DOI", TX.year_of(F.col("issued")).alias("year"), F.get("author", 0)["family"].alias("family"))


# Links.
@query(
    """SELECT page_id, unnest([0, 1, 2, 3, 4, 5]) AS n, unnest(['See ', url, ',', ' and (', url, ').']) AS text,
    unnest([NULL, url, NULL, NULL, url, NULL]) AS href, unnest([false, true, false, false, true, false]) AS link FROM pages"""
)
def link_parts_of_text(spark, d):
    text = F.concat(F.lit("See "), "url", F.lit(", and ("), "url", F.lit(")."))
    rows = read(spark, d, "pages").select("page_id", F.posexplode(link_parts(text)).alias("n", "p"))
    return rows.select("page_id", "n", "p.text", "p.href", "p.link")


# Exports.
RIS_TYPE = "CASE type WHEN 'article-journal' THEN 'JOUR' WHEN 'book' THEN 'BOOK' WHEN 'chapter' THEN 'CHAP' WHEN 'thesis' THEN 'THES' WHEN 'webpage' THEN 'ELEC' ELSE 'RPRT' END"


@query(
    Q.with_cites(
        f"""SELECT bibliography_id, pos, concat_ws(chr(10), 'TY  - ' || {RIS_TYPE}, 'AU  - ' || coalesce(literal, family || ', ' || given),
        'AU  - ' || family2 || ', ' || given2, 'A2  - ' || family_e || ', ' || given_e, 'TI  - ' || title,
        CASE WHEN type = 'book' THEN 'BT' ELSE 'T2' END || '  - ' || container_title, 'PB  - ' || publisher, 'PY  - ' || year, 'DA  - ' || year,
        'VL  - ' || volume, 'IS  - ' || issue, 'SP  - ' || {Q.FIRST_PAGE}, 'EP  - ' || {Q.LAST_PAGE}, 'DO  - ' || DOI, 'UR  - ' || URL,
        'SN  - ' || coalesce(isbn1, issn1), 'ER  - ') AS ris FROM c"""
    )
)
def export_ris(spark, d):
    return cites(spark, d).select("bibliography_id", "pos", X.ris(S.csl()).alias("ris"))


def _pair(key: str, value: str) -> str:
    return f"'{key}=' || {Q.encoded(value)}"


BOOK_TAIL = f"{_pair('rft.pub', 'publisher')}, {_pair('rft.isbn', 'isbn1')}"


def _kind(name: str) -> str:
    return _pair("rft_val_fmt", f"'info:ofi/fmt:kev:mtx:{name}'")


COINS = f"""concat_ws('&', 'ctx_ver=Z39.88-2004', CASE type
        WHEN 'book' THEN concat_ws('&', {_kind('book')}, {_pair('rft.btitle', 'title')}, {BOOK_TAIL})
        WHEN 'chapter' THEN concat_ws('&', {_kind('book')}, {_pair('rft.btitle', 'container_title')}, {_pair('rft.atitle', 'title')}, {BOOK_TAIL})
        WHEN 'thesis' THEN concat_ws('&', {_kind('dissertation')}, {_pair('rft.title', 'title')}, {_pair('rft.inst', 'publisher')})
        ELSE concat_ws('&', {_kind('journal')}, {_pair('rft.atitle', 'title')}, {_pair('rft.jtitle', 'container_title')}, {_pair('rft.volume', 'volume')},
            {_pair('rft.issue', 'issue')}, {_pair('rft.spage', Q.FIRST_PAGE)}, {_pair('rft.epage', Q.LAST_PAGE)}) END,
        {_pair('rft.aulast', 'coalesce(family, literal)')}, {_pair('rft.aufirst', 'given')}, {_pair('rft.date', Q.ISO)},
        {_pair('rft_id', "'info:doi/' || DOI")})"""


@query(Q.with_cites(f"SELECT bibliography_id, pos, {COINS} AS coins FROM c"))
def export_coins(spark, d):
    return cites(spark, d).select("bibliography_id", "pos", X.coins(S.csl()).alias("coins"))


def _object(*pairs: tuple[str, str]) -> str:
    return "'{' || concat_ws(',', " + ", ".join(f"'\"{k}\":' || {v}" for k, v in pairs) + ") || '}'"


J = Q.json_text
PERSON = _object(("@type", "'\"Person\"'"), ("name", J("given || ' ' || family")), ("familyName", J("family")), ("givenName", J("given")))
PERSON2 = _object(("@type", "'\"Person\"'"), ("name", J("given2 || ' ' || family2")), ("familyName", J("family2")), ("givenName", J("given2")))
BODY = _object(("@type", "'\"Organization\"'"), ("name", J("literal")))
AUTHORS_JSON = (
    f"CASE WHEN coalesce(family, literal) IS NOT NULL THEN '[' || concat_ws(',', CASE WHEN family IS NOT NULL THEN {PERSON} ELSE {BODY} END, "
    f"CASE WHEN family2 IS NOT NULL THEN {PERSON2} END) || ']' END"
)
LD_TYPE = "CASE type WHEN 'article-journal' THEN 'ScholarlyArticle' WHEN 'book' THEN 'Book' WHEN 'chapter' THEN 'Chapter' WHEN 'thesis' THEN 'Thesis' WHEN 'webpage' THEN 'WebPage' ELSE 'Report' END"
PART_OF = (
    "CASE type WHEN 'article-journal' THEN "
    + _object(("@type", "'\"Periodical\"'"), ("name", J("container_title")), ("issn", J("issn1")))
    + " WHEN 'chapter' THEN "
    + _object(("@type", "'\"Book\"'"), ("name", J("container_title")))
    + " END"
)


LD_ONE = _object(
    ("@context", "'\"https://schema.org\"'"), ("@type", J(LD_TYPE)), ("name", J("title")), ("author", AUTHORS_JSON), ("datePublished", J(Q.ISO)),
    ("isPartOf", PART_OF), ("publisher", _object(("@type", "'\"Organization\"'"), ("name", J("publisher")))),
    ("identifier", "CASE WHEN DOI IS NOT NULL THEN " + _object(("@type", "'\"PropertyValue\"'"), ("propertyID", "'\"DOI\"'"), ("value", J("DOI"))) + " END"),
    ("url", J("'https://doi.org/' || " + Q.encoded("DOI"))), ("isbn", J("isbn1")), ("url", f"CASE WHEN DOI IS NULL THEN {J('URL')} END"),
)


@query(Q.with_cites(f"SELECT bibliography_id, pos, {LD_ONE} AS json FROM c"))
def export_jsonld(spark, d):
    return cites(spark, d).select("bibliography_id", "pos", X.json_ld(S.csl()).alias("json"))


CSL_ONE = _object(
    ("type", J("type")), ("title", J("title")), ("container-title", J("container_title")), ("publisher", J("publisher")), ("page", J("page")),
    ("volume", J("volume")), ("issue", J("issue")), ("DOI", J("DOI")), ("URL", J("URL")), ("ISBN", J("isbn1")), ("ISSN", J("issn1")),
    ("author", "CASE WHEN coalesce(family, literal) IS NOT NULL THEN '[' || concat_ws(',', CASE WHEN family IS NOT NULL THEN "
        + _object(("family", J("family")), ("given", J("given"))) + " ELSE " + _object(("literal", J("literal"))) + " END, CASE WHEN family2 IS NOT NULL THEN "
        + _object(("family", J("family2")), ("given", J("given2"))) + " END) || ']' END"),
    ("editor", "CASE WHEN family_e IS NOT NULL THEN '[' || " + _object(("family", J("family_e")), ("given", J("given_e"))) + " || ']' END"),
    ("issued", "CASE WHEN year IS NOT NULL THEN '{\"date-parts\":[[' || concat_ws(',', year, month) || ']]}' END"),
)


@query(Q.with_cites(f"SELECT bibliography_id, '[' || string_agg({CSL_ONE}, ',' ORDER BY pos) || ']' AS content FROM c GROUP BY bibliography_id"))
def export_csl_json(spark, d):
    return DOC.csl_json_file(cites(spark, d).drop("id"), None)


TEX_NAME = "coalesce('{' || replace(literal, '#', '\\#') || '}', replace(family || ', ' || given, '#', '\\#'))"
TEX_KEY = (
    "lower(regexp_replace(coalesce(family, literal, 'anon') || coalesce(year::VARCHAR, 'nd') || "
    "coalesce(list_filter(string_split(title, ' '), lambda w: len(w) > 3)[1], ''), '[^A-Za-z0-9]', '', 'g'))"
)


def _tex(kind: str, fields: list[tuple[str, str]]) -> str:
    lines = ", ".join(f"'  {k} = {{' || {v} || '}}'" for k, v in fields)
    return f"'@' || {kind} || '{{' || {TEX_KEY} || ',' || chr(10) || concat_ws(',' || chr(10), {lines}) || chr(10) || '}}'"


BIB_KIND = "CASE type WHEN 'article-journal' THEN 'article' WHEN 'book' THEN 'book' WHEN 'chapter' THEN 'incollection' WHEN 'thesis' THEN 'phdthesis' WHEN 'webpage' THEN 'misc' ELSE 'techreport' END"
PUBLISHER = "replace(publisher, '#', '\\#')"
TEX_SHARED = [
    ("author", f"nullif(concat_ws(' and ', {TEX_NAME}, family2 || ', ' || given2), '')"),
    ("editor", "replace(family_e || ', ' || given_e, '#', '\\#')"),
    ("title", "title"),
]
TEX_END = [("doi", "DOI"), ("url", "URL"), ("isbn", "isbn1"), ("issn", "issn1")]
PAGES = "replace(page, '–', '--')"


@query(
    Q.with_cites(
        "SELECT bibliography_id, pos, "
        + _tex(
            BIB_KIND,
            [
                *TEX_SHARED, ("journal", "CASE WHEN type = 'article-journal' THEN container_title END"), ("booktitle", "CASE WHEN type = 'chapter' THEN container_title END"),
                ("publisher", f"CASE WHEN type NOT IN ('thesis', 'report') THEN {PUBLISHER} END"), ("school", f"CASE WHEN type = 'thesis' THEN {PUBLISHER} END"),
                ("institution", f"CASE WHEN type = 'report' THEN {PUBLISHER} END"), ("volume", "volume"), ("number", "issue"), ("pages", PAGES),
                ("year", "year"), *TEX_END,
            ],
        )
        + " AS entry FROM c"
    )
)
def export_bibtex(spark, d):
    return cites(spark, d).select("bibliography_id", "pos", X.bibtex(S.csl()).alias("entry"))


LATEX_KIND = BIB_KIND.replace("'phdthesis'", "'thesis'").replace("'misc'", "'online'").replace("'techreport'", "'report'")


@query(
    Q.with_cites(
        "SELECT bibliography_id, pos, "
        + _tex(
            LATEX_KIND,
            [
                *TEX_SHARED, ("journaltitle", "CASE WHEN type = 'article-journal' THEN container_title END"),
                ("booktitle", "CASE WHEN type = 'chapter' THEN container_title END"),
                ("publisher", f"CASE WHEN type NOT IN ('thesis', 'report') THEN {PUBLISHER} END"),
                ("institution", f"CASE WHEN type IN ('thesis', 'report') THEN {PUBLISHER} END"), ("volume", "volume"), ("number", "issue"), ("pages", PAGES),
                ("date", Q.ISO), *TEX_END,
            ],
        )
        + " AS entry FROM c"
    )
)
def export_biblatex(spark, d):
    return cites(spark, d).select("bibliography_id", "pos", X.biblatex(S.csl()).alias("entry"))


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _json_script(mime: str, one: str) -> str:
    listed = f"string_agg({one}, ',' ORDER BY {Q.ORDER['author-date']})"
    return f"""'<script type="{mime}">[' || replace(replace(replace({listed}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || ']</script>'"""


#: Italics stand where the title or container occurs last; the address stands at the end, before a full stop.
ENTRIES = f"""shown AS (SELECT *, {Q.rendered('author-date')} AS t, CASE WHEN type IN ('article-journal', 'chapter') THEN container_title ELSE title END AS v,
        coalesce('https://doi.org/' || DOI, URL) AS a FROM c),
    cut AS (SELECT *, length(t) - strpos(reverse(t), reverse(v)) - length(v) + 1 AS before,
        CASE WHEN a IS NULL THEN length(t) ELSE length(t) - length(a) - 1 END AS until FROM shown),
    entries AS (SELECT *, {_escaped('left(t, before)')} || '<i>' || {_escaped('v')} || '</i>'
        || {_escaped('substr(t, before + length(v) + 1, until - before - length(v))')}
        || coalesce('<a href="' || {_escaped('a')} || '">' || {_escaped('a')} || '</a>.', '') AS entry FROM cut)"""
MARKUP = f"""'<section role="doc-bibliography" aria-label="References"><p class="bibliography-heading">References</p><ul class="bibliography-list">'
    || string_agg('<li id="ref-c-' || bibliography_id || '-' || pos || '"><cite>' || entry || '</cite><span class="Z3988" aria-hidden="true" title="'
        || {_escaped(COINS)} || '"></span></li>', '' ORDER BY {Q.ORDER['author-date']}) || '</ul>'
    || {_json_script('application/ld+json', LD_ONE)} || {_json_script('application/vnd.citationstyles.csl+json', CSL_ONE)} || '</section>'"""


@query(Q.with_cites(f"SELECT bibliography_id, {MARKUP} AS html FROM entries GROUP BY bibliography_id", ENTRIES))
def export_html(spark, d):
    rows = S.formatted_in(cites(spark, d), "apa-7")
    heads = read(spark, d, "orders").select(F.col("o_orderkey").alias("bibliography_id")).distinct().select(
        "bibliography_id", F.lit("References").alias("heading_text"), F.lit(True).alias("output_json_ld"), F.lit(True).alias("output_coins"),
        F.lit(True).alias("output_csl_json"), F.lit(False).alias("output_cite_export"),
    )
    return DOC.html(heads, rows, "apa-7")


# Aggregates and checks.
@query(Q.with_cites("SELECT bibliography_id, count(*) AS entry_count, count(*) > 100 AS over_soft_cap, count(*) > 200 AS over_hard_cap FROM c GROUP BY bibliography_id"))
def entry_count(spark, d):
    return A.entry_counts(cites(spark, d))


@query(
    Q.with_cites(
        """SELECT bibliography_id, count(*) FILTER (pos % 3 = 0) AS added, count(*) FILTER (pos % 3 = 1) AS duplicates, count(*) FILTER (pos % 3 = 2) AS errors,
        count(*) FILTER (pos % 3 = 0 AND year IS NULL) AS review_warnings, bool_or(pos > 3) AS truncated FROM c GROUP BY bibliography_id"""
    )
)
def import_counters(spark, d):
    outcome = F.element_at(F.array(F.lit("added"), F.lit("duplicate"), F.lit("error")), (F.col("pos") % 3 + 1).cast("int"))
    empty = F.expr("cast(array() as array<string>)")
    warnings = F.when(F.col("issued").isNull(), F.array(F.lit("review-metadata-incomplete"))).otherwise(empty)
    return A.import_counters(cites(spark, d).select("bibliography_id", outcome.alias("outcome"), warnings.alias("warnings"), (F.col("pos") > 3).alias("overflow")))


@query(
    """SELECT event_type, count(value) AS runs, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, median(value) AS median,
    quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(sum(value), 4) AS total FROM events GROUP BY event_type"""
)
def latency_summary(spark, d):
    out = A.latency_summary(read(spark, d, "events"), "event_type", "value")
    return out.withColumn("avg", F.round("avg", 6)).withColumn("total", F.round("total", 4))


@query(
    Q.with_cites(
        """SELECT bibliography_id, count(*) > 0 AS empty_bibliography, bibliography_id % 3 <> 0 AS heading_missing,
        NOT bool_or(type = 'webpage' AND year IS NULL) AS raw_url_link_text, bibliography_id % 2 = 0 AS all_metadata_disabled FROM c GROUP BY bibliography_id"""
    )
)
def content_checks(spark, d):
    bare = (F.col("type") == "webpage") & F.col("issued").isNull()
    rows = cites(spark, d).withColumn("title", F.when(bare, F.col("URL")).otherwise(F.col("title")))
    on = F.col("bibliography_id") % 2 == 0
    heads = rows.select("bibliography_id").distinct().select(
        "bibliography_id", F.when(F.col("bibliography_id") % 3 == 0, " ").otherwise("Works").alias("heading_text"), on.alias("output_json_ld"),
        F.lit(False).alias("output_coins"), F.lit(None).cast("boolean").alias("output_csl_json"),
    )
    return A.content_checks(heads, rows)


# Mutations.
@query(
    Q.with_cites(
        """SELECT bibliography_id, 'c-' || bibliography_id || '-' || pos AS id, CASE WHEN m < 1 THEN pos WHEN pos = 0 THEN 1 WHEN pos = 1 THEN 0 ELSE pos END AS pos
        FROM (SELECT *, max(pos) OVER (PARTITION BY bibliography_id) AS m FROM c)"""
    )
)
def reorder_swap(spark, d):
    rows = cites(spark, d).select("bibliography_id", "id", "pos")
    moves = rows.select("bibliography_id").distinct().select("bibliography_id", F.lit(0).cast("long").alias("pos"), F.lit(1).alias("step"))
    return S.move(rows, moves)


@query(
    Q.with_cites(
        """SELECT bibliography_id, 'c-' || bibliography_id || '-' || pos AS id, CASE WHEN pos % 5 = 2 THEN 'Patched' ELSE title END AS title,
        (row_number() OVER (PARTITION BY bibliography_id ORDER BY pos) - 1)::BIGINT AS pos FROM c WHERE pos % 3 <> 1
        UNION ALL SELECT bibliography_id, 'new-' || bibliography_id, 'New', count(*) FILTER (pos % 3 <> 1) FROM c GROUP BY bibliography_id"""
    )
)
def delete_update_append(spark, d):
    rows = cites(spark, d).select("bibliography_id", "id", "title", "pos")
    left = S.delete(rows, rows.where("pos % 3 = 1"))
    patched = S.update(left, rows.where("pos % 5 = 2").select("id", F.lit("Patched").alias("title")))
    new = rows.select("bibliography_id").distinct().select(
        "bibliography_id", F.concat(F.lit("new-"), "bibliography_id").alias("id"), F.lit("New").alias("title"), F.lit(0).cast("long").alias("pos")
    )
    return S.append(patched, new)


@query(
    Q.with_cites(
        """SELECT bibliography_id, id, focus FROM (SELECT bibliography_id, pos, 'c-' || bibliography_id || '-' || pos AS id,
        coalesce(lead('c-' || bibliography_id || '-' || pos) OVER w, lag('c-' || bibliography_id || '-' || pos) OVER w) AS focus
        FROM c WINDOW w AS (PARTITION BY bibliography_id ORDER BY pos)) WHERE pos % 2 = 1"""
    )
)
def next_focus(spark, d):
    rows = cites(spark, d).select("bibliography_id", "id", "pos")
    return S.next_focus(rows, rows.where("pos % 2 = 1"))


# Posts.
POST = (
    """'<!-- wp:group --><!-- wp:BLOCK {"citationStyle":"ieee","headingText":"H' || o_orderkey || '","outputCoins":true,"citations":["""
    """{"id":"a","csl":{"type":"book","title":"T' || o_orderkey || '","ISBN":["","978"],"issued":{"date-parts":[[2001,2]]}},"formattedText":"F"},"""
    """{"id":"b","csl":{"type":"webpage","title":"U","author":[{"family":"Doe"}]}}]} --><section></section><!-- /wp:BLOCK -->"""
    """<!-- /wp:group --><!-- wp:BLOCK {"citations":"none"} /-->'"""
).replace("BLOCK", "records/bibliography")


def _posts(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), F.expr(POST).alias("content"))


@query(
    """SELECT o_orderkey AS post_id, unnest([0, 1])::BIGINT AS "index", unnest(['ieee', 'chicago-notes-bibliography']) AS citation_style,
    unnest(['H' || o_orderkey, '']) AS heading_text, true AS output_json_ld, unnest([true, false]) AS output_coins, unnest([2, 0])::BIGINT AS entry_count FROM orders"""
)
def block_scan(spark, d):
    return B.bibliographies(_posts(spark, d)).select(
        "post_id", "index", "citation_style", "heading_text", "output_json_ld", "output_coins", "entry_count"
    )


@query(
    """SELECT o_orderkey AS post_id, unnest([0, 1])::BIGINT AS pos, unnest(['a', 'b']) AS id, unnest(['book', 'webpage']) AS type,
    unnest(['T' || o_orderkey, 'U']) AS title, unnest(['978', NULL]) AS isbn, unnest(['2001-02', NULL]) AS date, unnest([NULL, 'Doe']) AS family,
    unnest(['F', NULL]) AS formatted_text FROM orders"""
)
def block_citations(spark, d):
    rows = B.citations(B.bibliographies(_posts(spark, d)))
    return rows.select(
        "post_id", "pos", "id", "type", "title", TX.primary(F.col("ISBN")).alias("isbn"), TX.iso_date(F.col("issued")).alias("date"),
        F.get("author", 0)["family"].alias("family"), "formatted_text",
    )


# BibTeX and lookups.
@query(
    """SELECT p_partkey, 'k' || p_partkey AS citation_key, 'article-journal' AS type, 'The ' || p_name || ' é' AS title, p_type AS container_title, '3-9' AS page,
    1990 + p_size % 30 AS year, 3 AS month, 2 AS authors, 'von Roe' AS family2 FROM part"""
)
def bibtex_read(spark, d):
    text = F.expr(
        r"""'@comment{x} @Artikel{k' || p_partkey || ', title = {The {' || p_name || "} \\'{e}}, author = \"Doe, Jane and Max von Roe\", journal={"
        || p_type || '}, pages = {3--9}, year = ' || (1990 + p_size % 30) || ', month = mar}'"""
    )
    rows = read_bibtex(read(spark, d, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")
    parts = F.get(F.col("issued.date_parts"), 0)
    return rows.select(
        "p_partkey", "citation_key", "type", "title", "container_title", "page", F.get(parts, 0).alias("year"), F.get(parts, 1).alias("month"),
        F.size("author").alias("authors"), F.get("author", 1)["family"].alias("family2"),
    )


@query(
    Q.with_cites(
        """SELECT bibliography_id, pos, CASE WHEN DOI IS NOT NULL AND s % 2 = 0 THEN '{"n":' || s || '}' END AS csl_json
        FROM (SELECT *, CAST(regexp_extract(DOI, '^10\\.([0-9]+)/', 1) AS BIGINT) AS s FROM c WHERE DOI IS NOT NULL)
        UNION ALL SELECT bibliography_id, pos, NULL FROM c WHERE DOI IS NULL""".replace("\\\\", "\\")
    )
)
def resolve_doi(spark, d):
    rows = cites(spark, d).select("bibliography_id", "pos", F.lit("doi").alias("format"), F.concat(F.lit("DOI:"), "DOI").alias("value"))
    number = F.regexp_extract("DOI", r"^10\.([0-9]+)/", 1).cast("long")
    table = cites(spark, d).where(F.col("DOI").isNotNull() & (number % 2 == 0)).select(
        TX.doi_lookup(F.col("DOI")).alias("key"), F.concat(F.lit('{"n":'), number, F.lit("}")).alias("csl_json")
    )
    return resolve_dois(rows, table).select("bibliography_id", "pos", "csl_json")


@query(
    """SELECT p_partkey::VARCHAR AS pmid, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found' ELSE 'upstream_error' END AS status FROM part WHERE p_partkey % 7 > 0
    UNION ALL SELECT 'x' || p_partkey, 'invalid_id' FROM part WHERE p_partkey % 7 = 0"""
)
def pmid_lookup(spark, d):
    part = read(spark, d, "part")
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    # One row that holds, one that holds less long, and one that held once, in turn.
    table = part.where("p_partkey % 4 < 3").select(
        F.col("p_partkey").cast("string").alias("key"),
        F.element_at(F.array(F.lit("ok"), F.lit("not_found"), F.lit("ok")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("status"),
        F.lit("{}").alias("csl_json"),
        F.expr("timestamp'2026-01-02 00:00:00' - CASE p_partkey % 4 WHEN 0 THEN interval 2 hours WHEN 1 THEN interval 10 minutes ELSE interval 3 days END").alias("fetched_at"),
    )
    asked = part.select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("x"), "p_partkey")).otherwise(F.col("p_partkey").cast("string")).alias("pmid"))
    return pmid_status(asked, table, now).select("pmid", "status")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'article-journal' WHEN 1 THEN 'book' WHEN 2 THEN 'document' ELSE 'report' END AS type FROM part"""
)
def registry_types(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("journal-article", "monograph", "grant", "report"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", csl_type(name).alias("type"))
