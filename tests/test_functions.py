"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from quirework.functions import exports as X
from quirework.functions import names as N
from quirework.functions import text as T
from quirework.functions.detect import chunks, detect, embedded, items, paste_error
from quirework.functions.freetext import parse
from quirework.functions.render import link_parts, render, segments
from quirework.functions.reviews import review_title, review_warnings
from quirework.operators.sets import csl
from tests.helpers import citations, person, value, values


def test_doi_forms(spark):
    texts = [" doi:10.1000/X). ", "https://doi.org/10.1000/X.", "HTTP://dx.doi.org/10.1000/X", "10.1000/X"]
    assert values(spark, texts, T.doi_input) == ["10.1000/X", "https://doi.org/10.1000/X", "HTTP://dx.doi.org/10.1000/X", "10.1000/X"]
    assert values(spark, texts, T.doi_lookup) == ["10.1000/x"] * 4
    assert values(spark, texts, T.doi_dedupe) == ["doi:10.1000/x", "10.1000/x", "10.1000/x", "10.1000/x"]
    assert values(spark, ["", None, " 10.1000/a b", "https://doi.org/10.1000/x", "doi:10.1000/x."], T.manual_doi) == ["", "", None, None, "10.1000/x"]
    assert values(spark, [" ", "http://a.b/c", "ftp://a.b", "https://"], T.manual_url) == ["", "http://a.b/c", None, None]


def test_match_text(spark):
    assert values(spark, ["  A—B  c! ", "Ünï\u00a0x", ""], T.match_text) == ["ab c", "ünï x", ""]


def test_title_case(spark):
    texts = [
        "THE ART OF WAR: A STUDY IN THE FIELD OF", "Mixed Case", "1984", "I.—COMPUTING MACHINERY AND INTELLIGENCE", "WOMEN'S WORK", "A  B\u00a0OF C", " OF",
        "中文", "ÉTUDES DE CAS", "X-RAY OF AN X",
    ]
    assert values(spark, texts, N.title_case) == [
        "The Art of War: A Study in the Field Of", "Mixed Case", "1984", "I.—Computing Machinery and Intelligence", "Women's Work", "A  B\u00a0of C", " Of",
        "中文", "Études De Cas", "X-Ray of an X",
    ]


def test_name_case(spark):
    families = ["SMITH-JONES", "O'BRIEN", "VAN DER BERG", "Smith", "A. M.", "DE LA CRUZ", "ÅNGSTRÖM"]
    assert values(spark, families, lambda c: N.name_token_case(c, False)) == [
        "Smith-Jones", "O'Brien", "van der Berg", "Smith", "A. M.", "de la Cruz", "Ångström",
    ]
    assert values(spark, ["JD", "MARY", "FHC", "J. D.", "ANNE-MARIE"], lambda c: N.name_token_case(c, True)) == ["JD", "Mary", "FHC", "J. D.", "Anne-Marie"]


def test_tags(spark):
    assert values(spark, ["<b>x</b>", "<<b>script>y", "a < b", "<i"], T.strip_tags) == ["x", "script>y", "a < b", "<i"]
    assert values(spark, [" <script>x</script>a<style>b</style> "], T.strip_markup) == ["a"]


@pytest.mark.parametrize("sign", ["a", "é", "漢", "😀"])
def test_bounded_cuts_between_characters(spark, sign):
    text = "x" + sign * 10
    for most in range(1, len(text.encode()) + 2):
        expected = text.encode()[:most].decode("utf-8", "ignore")
        assert value(spark, T.bounded(F.lit(text), most)) == expected


def test_formatter_text(spark):
    text = "&lt;b&gt;Tom&lt;/b&gt; &amp;amp; &#233;&#x1F600; <i>x</i>\n y"
    assert value(spark, T.formatted(F.lit(text))) == "Tom &amp; é😀 x y"
    fix = lambda t, style, family: value(spark, T.style_fixes(F.lit(t), F.lit(style), F.lit(family)))
    assert fix("[12] A and et al. B", "ieee", "numeric") == "A et al. B"
    assert fix("3. A", "vancouver", "numeric") == "A"
    assert fix("v. vol. 3, n. no. 4, p. pp. 5", "abnt", "author-date") == "v. 3, n. 4, p. 5"


def test_pages_dates_slugs(spark):
    assert [tuple(v) for v in values(spark, ["1-5", "1 – 5", "7", "a—b-c", ""], T.page_bounds)] == [("1", "5"), ("1", "5"), ("7", None), ("a", "b"), (None, None)]
    slug = lambda *a: value(spark, T.slug(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in a]))
    assert slug("Kuhn_1962", "x", None, "t") == "Kuhn-1962"
    assert slug(None, "Ångström", "1962", "t") == "Angstrom-1962"
    assert slug(None, None, None, "The Art -- of War and") == "The-Art-of"
    assert slug("!", None, None, "漢字") == "citation"


def test_percent_encoding(spark):
    assert values(spark, ["10.1/a b(c)~!*'é"], T.percent_encoded) == ["10.1%2Fa%20b(c)~!*'%C3%A9"]
    assert value(spark, T.script_safe(F.lit("</script>\u2028"))) == "\\u003c/script>\\u2028"


# Detection.
def test_detection(spark):
    texts = ["PMID: 123", "pmid:123456789", "doi:10.1000/x", "https://doi.org/10.1000/x y", "@book{a}", "see PMID 77 there", "x10.1000/y", "plain"]
    formats = [r["format"] for r in values(spark, texts, detect)]
    assert formats == ["pmid", "freetext", "doi", "doi", "bibtex", "pmid", "freetext", "freetext"]
    found = values(spark, ["A. https://doi.org/10.1000/x). PMID: 7", "PMID: 77.", "none"], embedded)
    assert [tuple(f) if f else None for f in found] == [("doi", "https://doi.org/10.1000/x"), ("pmid", "PMID:77"), None]


def test_chunks_and_items(spark):
    assert values(spark, ["a\n\n b \n \t\n\n", "", "a\nb"], chunks) == [["a", "b"], [], ["a\nb"]]
    kinds = lambda t, **k: [(i["format"], i["value"], i["fallback"]) for i in values(spark, [t], lambda c: items(c, **k))[0]]
    assert kinds("x @book{a, t={1}} @misc{b}") == [("bibtex", "x", None), ("bibtex", "@book{a, t={1}}", None), ("bibtex", "@misc{b}", None)]
    assert kinds("One line.\nTwo line!") == [("freetext", "One line.", None), ("freetext", "Two line!", None)]
    assert kinds("One line\nTwo line!") == [("freetext", "One line Two line!", None)]
    both = "See 10.1000/a here\n10.1000/b"
    assert kinds(both) == [("doi", "10.1000/a", "See 10.1000/a here"), ("doi", "10.1000/b", None)]
    assert kinds(both, whole_line_identifiers=True) == [("doi", "See 10.1000/a here", None), ("doi", "10.1000/b", None)]


def test_paste_guards(spark):
    assert values(spark, ["x", "\\documentclass{a}", "\\textcite{b}", "\\citex"], lambda c: paste_error(c, 1000)) == [None, "latex_document", "latex_document", None]
    assert values(spark, ["😀😀", "aaa"], lambda c: paste_error(c, 3)) == ["too_large", None]


# Names.
def test_people(spark):
    def made(text, f=N.people):
        return [(n["family"], n["given"], n["literal"]) for n in values(spark, [text], f)[0]]

    assert made("Jane Q. Doe and John Roe") == [("Doe", "Jane Q.", None), ("Roe", "John", None)]
    assert made("Doe, Jane; Acme") == [("Doe", "Jane", None), (None, None, "Acme")]
    assert made("Doe, Jane, John Roe, Max Poe") == [("Doe", "Jane", None), ("Roe", "John", None), ("Poe", "Max", None)]
    assert made("Doe, Jane, John Roe, and Max Poe") == [("Doe", "Jane", None), ("Roe", "John", None), ("Poe", "Max", None)]
    assert made("Sandy Anders & Andy Orlando") == [("Anders", "Sandy", None), ("Orlando", "Andy", None)]
    assert made("Jane Doe et al.") == [("Doe", "Jane", None), (None, None, "et al.")]
    assert made("") == []
    assert made("Doe, J., & Roe, R. S.", N.people_by_initials) == [("Doe", "J.", None), ("Roe", "R. S", None)]
    assert made("World Health Organization", N.people_by_initials) == [(None, None, "World Health Organization")]
    assert made("Doe, Jane; Acme Corp; Body, ", N.names_from_field) == [("Doe", "Jane", None), ("Corp", "Acme", None), (None, None, "Body,")]


# Free text: one sample for each rule, in the order of the rules.
FREE = [
    ("Jane Doe, “A Title,” in The Whole, ed. Max Roe (Press, 2001), 5-9.", "chapter", {"title": "A Title", "container_title": "The Whole", "page": "5-9", "publisher": "Press"}),
    ('Doe, Jane. "A Title." In The Whole, edited by Max Roe. Press, 2001, 5-9.', "chapter", {"title": "A Title", "container_title": "The Whole"}),
    ('Jane Doe. "A Review." Review of The Book, by Max Roe. The Paper, March 3, 2001.', "review-book", {"reviewed_title": "The Book", "container_title": "The Paper"}),
    ('Doe, Jane. "A Title." The Journal 12, no. 3 (2001): 5-9. https://doi.org/10.1000/x.', "article-journal", {"volume": "12", "issue": "3", "DOI": "10.1000/x"}),
    ('Jane Doe, "A Title," The Journal 12 (2001): 5-9.', "article-journal", {"volume": "12", "issue": None, "page": "5-9"}),
    ('Jane Doe, "A Title," The Journal, Spring 2001, 5-9.', "article-journal", {"container_title": "The Journal", "page": "5-9"}),
    ("Doe, J. (2001). A title. The Journal, 12(3), 5-9. doi:10.1000/x", "article-journal", {"title": "A title", "volume": "12", "issue": "3", "page": "5-9", "DOI": "10.1000/x"}),
    ("Jane Doe (2001). A title (Vol. 2, pp. 5-9).", "article-journal", {"volume": "2", "page": "5-9", "title": "A title"}),
    ("Doe, J. (2001). A title. Press.", "book", {"title": "A title", "publisher": "Press"}),
    ('Doe, Jane. "A Title." The Site. Last modified March 3, 2001. https://example.org/a.', "webpage", {"URL": "https://example.org/a", "container_title": "The Site"}),
    ("Jane Doe and Max Roe, eds. The Whole. 2nd ed. Press, 2001. Kindle.", "collection", {"edition": "2", "medium": "Kindle", "publisher": "Press"}),
    ("Jane Doe. The Book. London, 2001. https://example.org/b.", "book", {"publisher_place": "London", "URL": "https://example.org/b"}),
    ('Jane Doe. "A Title." PhD diss., Some University, 2001. Online.', "thesis", {"genre": "PhD diss", "publisher": "Some University", "medium": "Online"}),
    ("Jane Doe. The Book. 3rd ed. Press, 2001, 5-9.", "book", {"edition": "3", "publisher": "Press", "page": "5-9"}),
    ("Jane Doe, The Book (Press, 2001), 5-9.", "book", {"title": "The Book", "publisher": "Press", "page": "5-9"}),
]


def test_free_text(spark):
    records = values(spark, [t for t, _, _ in FREE], parse)
    for (text, kind, fields), record in zip(FREE, records, strict=True):
        assert record is not None, text
        assert record["type"] == kind, (text, record)
        assert {k: record[k] for k in fields} == fields, (text, record)
        assert record["issued"]["date_parts"][0][0] == 2001, text
        people = record["editor"] if kind == "collection" else record["author"]
        assert people[0]["family"] == "Doe", text


def test_free_text_dates_and_rejects(spark):
    page, review, access = values(
        spark,
        [
            'Acme. "T." Effective March 3, 2001. https://x.org', 'J. Doe. "R." Review of B, by M. Roe. P, Smarch 3, 2001.',
            'Acme. "T." Accessed May 1, 2002. https://x.org',
        ],
        parse,
    )
    assert page["issued"]["date_parts"] == [[2001, 3, 3]] and page["author"][0]["literal"] == "Acme"
    assert review["issued"] is None
    assert access["accessed"]["date_parts"] == [[2002, 5, 1]] and access["issued"] is None
    assert values(spark, ["", "   ", "no structure here", "Title only, 2001"], parse) == [None] * 4


def test_free_text_of_odd_shapes(spark):
    book, three, page, place, edition, marked, sub = values(
        spark,
        [
            "Ann B. Cole and Dan E. Frost, The Open Field: How It Was Won (and Lost) Today (University of Somewhere Press, 2022), 117–18.",
            'Ann Cole; Dan Frost; Max Roe, "The Title," Journal of Things 12, no. 3 (2024): 117-134.',
            "Acme, “Responses API,” https://example.org/docs/a.",
            "Jane Doe. The Book. London, 2001. https://example.org/b).",
            "Jane Doe, ed. The Whole. Revised ed. Press, 2001.",
            "Jane Doe, A\u0001B (Press, 2001).",
            "Doe, J., Roe, M., & Poe, A. (1999). One. Two. The Journal, 12, 3-4.",
        ],
        parse,
    )
    assert (book["title"], book["publisher"], book["page"]) == ("The Open Field: How It Was Won (and Lost) Today", "University of Somewhere Press", "117–18")
    assert [a["family"] for a in three["author"]] == ["Cole", "Frost", "Roe"] and three["confidence"] == "low" and three["issue"] == "3"
    assert (page["type"], page["URL"], page["author"][0]["literal"]) == ("webpage", "https://example.org/docs/a", "Acme")
    assert (place["publisher_place"], place["publisher"], place["URL"]) == ("London", None, "https://example.org/b")
    assert (edition["type"], edition["edition"], edition["publisher"]) == ("collection", "Revised", "Press")
    assert marked["title"] == "A B" and (sub["title"], sub["volume"], len(sub["author"])) == ("One. Two", "12", 3)


# Reviews.
def test_review_titles(spark):
    make = lambda t, kind="article-journal", box="J": value(spark, review_title(F.lit(kind), F.lit(t), F.lit(box)))
    assert make("Jane Doe. The Book. New York, 1999. 123 pp. $45.") == "Jane Doe. The Book"
    assert make("Plain title") == "Plain title"
    assert make("Jane Doe. The Book. 123 pp. $45.", "book") == "Jane Doe. The Book. 123 pp. $45."
    assert make("Jane Doe. The Long Road to Rome and Back DoeThe Long Road. 90 pp. $3") == "Jane Doe. The Long Road to Rome and Back"
    assert make("Jane Doe. The Book of Two Rivers The Book of Two Rivers Again. 90 pp. $3") == "Jane Doe. The Book of Two Rivers"
    assert make("A Plain Title costs $5 here") == "A Plain Title costs $5 here"
    assert make("J. B. Doe and Ann Roe. Rivers of the North. 210 pp. $19.95") == "J. B. Doe and Ann Roe. Rivers of the North"
    assert make("Doe. A \\E Sign of (the) Times A \\E Sign of (the) Times Again McDoe") == "Doe. A \\E Sign of (the) Times"
    assert make("Doe. A \\E Sign of (the) Times A \\E Sign of (the) Times Again") == "Doe. A \\E Sign of (the) Times A \\E Sign of (the) Times Again"
    assert make("Doe. A \\E Sign of (the) Times McRoe x A \\E Sign of (the) Times RoePoe") == "Doe. A \\E Sign of (the) Times"
    assert make("12 pp. $3") == "12 pp. $3" and make("") == "" and make(None) is None
    warn = lambda before, after, page: value(spark, review_warnings(F.lit("doi"), F.lit("article-journal"), F.lit("J"), F.lit(before), F.lit(after), F.lit(page)))
    assert warn("A", "B", None) == ["review-metadata-incomplete"] and warn("A", "A", None) == [] and warn("A", "B", "3") == []


# Rendering.
def test_rendering(spark):
    rows = citations(
        spark,
        [
            {"author": [person("Doe", "Jane Mary"), person(literal="Acme")], "title": "The Book", "publisher": "Press", "year": 2001, "DOI": "10.1/x"},
            {"type": "article-journal", "editor": [person("Roe", "Max"), person("Poe", "Al")], "title": "Why?", "container_title": "J", "URL": "https://x.org"},
            {"title": "Alone", "year": 0},
        ],
    )
    text = lambda style: [r["t"] for r in sorted(rows.select("pos", render(style, csl()).alias("t")).collect())]
    assert text("apa-7") == [
        "Doe, J. M., Acme. 2001. The Book. Press. https://doi.org/10.1/x.",
        "Roe, M., Poe, A., eds. n.d. “Why?” J. https://x.org.",
        "Alone. n.d.",
    ]
    assert text("mla-9")[0] == "Doe, J. M., Acme. The Book. Press, 2001. https://doi.org/10.1/x."
    assert text("ieee")[1] == "M. Roe, A. Poe, eds. “Why?” J. n.d. https://x.org."
    assert text("unknown style") == text("chicago-notes-bibliography")


def test_segments_and_links(spark):
    made = lambda text, title, override=None: [
        (s["text"], s["italic"])
        for s in value(spark, segments(F.lit(text), F.lit(override).cast("string"), F.lit("book"), F.lit(title), F.lit("box")))
    ]
    assert made("A. War. War.", "War") == [("A. War. ", False), ("War", True), (".", False)]
    assert made('War "War" x', "War") == [("War", True), (' "War" x', False)]
    assert made("A. War.", "Peace") == [("A. War.", False)] and made("A. War.", "War", "o") == [("A. War.", False)]
    parts = lambda t: [(p["text"], p["link"]) for p in value(spark, link_parts(F.lit(t)))]
    assert parts("see https://a.b/(c)), or javascript:x") == [("see ", False), ("https://a.b/(c)", True), ("),", False), (" or javascript:x", False)]
    assert parts("") == [("", False)]


# Exports.
def test_exports(spark):
    row = citations(
        spark,
        [{
            "type": "chapter", "author": [person("Doe", "Jane"), person(literal="A & B")], "editor": [person("Roe", "Max")], "title": "On 5% <x>",
            "container_title": "The Whole", "page": "3–9", "year": 2001, "DOI": "10.1/a(b)", "ISBN": ["", "978"], "publisher": "Press",
        }],
    )
    out = row.select(
        X.ris(csl()).alias("ris"), X.coins(csl()).alias("coins"), X.json_ld(csl()).alias("ld"), X.bibtex(csl()).alias("bib"), X.biblatex(csl()).alias("latex")
    ).first()
    assert out["ris"].split("\n") == [
        "TY  - CHAP", "AU  - Doe, Jane", "AU  - A & B", "A2  - Roe, Max", "TI  - On 5% <x>", "T2  - The Whole", "PB  - Press", "PY  - 2001", "DA  - 2001",
        "SP  - 3", "EP  - 9", "DO  - 10.1/a(b)", "SN  - 978", "ER  - ",
    ]
    assert "rft.btitle=The%20Whole&rft.atitle=On%205%25%20%3Cx%3E" in out["coins"] and out["coins"].endswith("rft_id=info%3Adoi%2F10.1%2Fa(b)")
    assert '"@type":"Chapter"' in out["ld"] and '"url":"https://doi.org/10.1%2Fa(b)"' in out["ld"] and '"@type":"Organization","name":"A & B"' in out["ld"]
    assert out["bib"].startswith("@incollection{doe2001on") is False and out["bib"].startswith("@incollection{doe2001")
    assert "title = {On 5\\% <x>}" in out["bib"] and "pages = {3--9}" in out["bib"] and "date = {2001}" in out["latex"]
