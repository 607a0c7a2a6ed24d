"""Readers, lookups, the interface, and the stream."""

from pyspark.sql import functions as F

from quirework.operators import api
from quirework.sources import bibtex as BIB
from quirework.sources.blocks import bibliographies, citations as block_citations
from quirework.sources.manual import manual_citations
from quirework.sources.pasted import paste_errors, paste_items, remaining_input
from quirework.sources.resolve import pmid_status
from quirework.streaming.imports import first_dois, stream_items, write_items
from tests.helpers import citations, person

BLOCK = "records/bibliography"
ONE = '{"citationStyle":"apa-7","headingText":"Works","citations":[{"id":"a","csl":{"type":"book","title":"T -- x","custom":{"k":1}},"displayOverride":"Shown"}]}'
POSTS = [
    (1, f"<!-- wp:{BLOCK} {ONE} --><section/><!-- /wp:{BLOCK} -->"
        f"<!-- wp:{BLOCK} /-->", "publish", "", True, False),
    (2, f"<!-- wp:{BLOCK} {ONE} /-->", "draft", "", True, False),
    (3, "no blocks", "publish", "", True, False),
    (4, f"<!-- wp:{BLOCK} {ONE} /-->", "publish", "pw", True, True),
]


def posts(spark):
    return spark.createDataFrame(POSTS, "post_id long, content string, status string, password string, type_viewable boolean, may_edit boolean")


def test_blocks(spark):
    rows = bibliographies(posts(spark)).orderBy("post_id", "index").collect()
    assert [(r["post_id"], r["index"], r["entry_count"], r["citation_style"]) for r in rows] == [
        (1, 0, 1, "apa-7"), (1, 1, 0, "chicago-notes-bibliography"), (2, 0, 1, "apa-7"), (4, 0, 1, "apa-7"),
    ]
    one = block_citations(bibliographies(posts(spark))).where("post_id = 1").first()
    assert one["title"] == "T -- x" and one["display_override"] == "Shown" and '"custom":{"k":1}' in one["csl_json"]


def test_read_interface(spark):
    assert {(r["post_id"], r["index"]) for r in api.list_bibliographies(posts(spark)).collect()} == {(1, 0), (1, 1), (4, 0)}
    assert api.get_bibliography(posts(spark), 1, 0, "text").first()["content"] == "Shown"
    assert '"custom"' in api.get_bibliography(posts(spark), 1, 0, "csl-json").first()["content"]
    assert api.get_bibliography(posts(spark), 1, 9).count() == 0 and api.get_bibliography(posts(spark), 2, 0).count() == 0


def test_bibtex_entries():
    text = """@string{p = "The Press"} junk @comment{no}
    @Book{k1, title = "A {B}raced " # {Title}, author = {van Gogh, Vincent and {Acme, Inc.} and others and Max Roe}, publisher = p # {, Ltd},
      year = 1999, isbn = {978}, pages = "1--9"}
    @inproceedings{k2, title={\\'{E}tudes \\& caf\\'e \\c{c}a \\ss{} --- x}, booktitle={P}, date={2001-02-03}, editor={de la Cruz, Jr, Ana}}
    @misc{open, title = {never closed"""
    a, b = [BIB.record(*e) for e in BIB.entries(text)]
    assert (a["title"], a["publisher"], a["page"], a["ISBN"], a["citation_key"]) == ("A Braced Title", "The Press, Ltd", "1-9", ["978"], "k1")
    assert [n["family"] or n["literal"] for n in a["author"]] == ["van Gogh", "Acme, Inc.", "et al.", "Roe"]
    assert b["title"] == "Études & café ça ß — x" and b["issued"]["date_parts"] == [[2001, 2, 3]] and b["type"] == "paper-conference"
    assert b["editor"][0]["family"] == "de la Cruz Jr" and b["editor"][0]["given"] == "Ana"


def test_manual_rows(spark):
    form = "id string, " + ", ".join(f"{k} string" for k in ("type", "authors", "title", "containerTitle", "publisher", "year", "page", "doi", "url"))
    rows = [
        ("a", "collection", "Doe, Jane", " T ", "", "P", " 1999 ", "", "10.1000/x", "https://x.org"),
        ("b", "", "", "T", "", "", "", "", "", ""),
        ("c", "book", None, "", "", "", "", "", "", ""),
    ]
    a, b, c = manual_citations(spark.createDataFrame(rows, form)).orderBy("id").collect()
    assert a["error"] is None and a["author"] is None and a["editor"][0]["family"] == "Doe" and a["title"] == "T" and a["issued"]["date_parts"] == [[1999]]
    assert (b["error"], c["error"]) == ("type_required", "title_required")


def test_pmid_status(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    table = spark.createDataFrame(
        [("1", "ok", "{}", "2026-01-01 12:00:00"), ("2", "ok", "{}", "2025-12-30 00:00:00"), ("3", "not_found", None, "2026-01-01 23:30:00")],
        "key string, status string, csl_json string, fetched_at string",
    ).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("PMID: 1",), ("x",), ("123456789",)], "pmid string")
    got = {r["pmid"]: r["status"] for r in pmid_status(asked, table, now).collect()}
    assert got == {"1": "ok", "2": "upstream_error", "3": "not_found", "PMID: 1": "ok", "x": "invalid_id", "123456789": "invalid_id"}


PASTE = "\n\n".join(
    [
        "10.1000/known", "10.1000/new", "Jane Doe, The Book (Press, 2001), 5-9.", "See Jane Doe, The Other (Press, 2002). 10.1000/missing",
        "@book{k, title = {From Bib}, author = {Roe, Max}, year = 1999}", "JANE DOE, THE BOOK (Press, 2001).", "what is this", "PMID: 7",
    ]
)


def test_import_paste(spark):
    existing = citations(spark, [{"id": "old", "title": "Zed", "author": [person("Zim", "A")], "DOI": "10.1000/KNOWN", "year": 1990}])
    lookup = "key string, csl_json string"
    dois = spark.createDataFrame(
        [
            ("10.1000/known", '{"type":"book","title":"Known","DOI":"10.1000/known"}'),
            ("10.1000/new", '{"type":"article-journal","title":"THE NEW THING","container-title":"J","author":[{"family":"ABEL","given":"ANN"}],"issued":{"date-parts":[[2003]]}}'),
        ],
        lookup,
    )
    pmids = spark.createDataFrame([("7", '{"type":"book","title":"Seven","ISBN":"978"}')], lookup)
    after, outcomes = api.import_paste(existing, spark.createDataFrame([(1, PASTE)], "paste_id long, text string"), "apa-7", dois, pmids)
    rows = after.orderBy("pos").collect()
    assert sorted(r["title"] for r in rows) == ["From Bib", "Seven", "The Book", "The New Thing", "Zed"]
    new = next(r for r in rows if r["title"] == "The New Thing")
    assert new["author"][0]["family"] == "Abel" and new["input_format"] == "doi" and new["formatted_text"].startswith("Abel, A. 2003.")
    told = {k: n for k, n in outcomes.groupBy("outcome").count().collect()}
    assert told["duplicate"] == 2 and told["error"] == 2 and told["added"] == 4
    assert len({r["id"] for r in rows}) == len(rows) == 5


def test_paste_cap_and_rest(spark):
    text = "\n\n".join(f"item {k}" for k in range(53))
    found = paste_items(spark.createDataFrame([(1, text), (2, " "), (3, "\\cite{x}")], "paste_id long, text string"))
    assert found.where("overflow").count() == 3
    rest = remaining_input(found, found.where("raw = 'item 4'")).first()["remaining_input"]
    assert rest == "item 50\n\nitem 51\n\nitem 52\n\nitem 4"
    errors = paste_errors(spark.createDataFrame([(1, text), (2, " "), (3, "\\cite{x}")], "paste_id long, text string"))
    assert {r["paste_id"]: r["error"] for r in errors.collect()} == {2: "empty", 3: "latex_document"}


def test_stream(spark, tmp_path):
    rows = [(1, "10.1000/a\n\n10.1000/A\n\nplain text", "2026-01-01 00:00:00"), (1, "doi:10.1000/a", "2026-01-01 00:00:10"), (2, "10.1000/a", "2026-01-01 00:00:20")]
    frame = spark.createDataFrame(rows, "paste_id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    write_items(first_dois(stream_items(stream)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["paste_id"], r["format"]) for r in got) == [(1, "doi"), (1, "freetext"), (2, "doi")]


def test_imported_rows_are_not_broadcast(spark):
    """What is stored, read or a duplicate grows with the pastes: none of it goes through the driver."""
    existing = citations(spark, [{"id": "old", "title": "Zed", "author": [person("Zim", "A")], "year": 1990}])
    none = spark.createDataFrame([], "key string, csl_json string")
    pastes = spark.createDataFrame([(1, "Jane Doe, Light (Press, 2001).\n\nJane Doe, Light (Press, 2001).\n\nnothing to read")], "paste_id long, text string")
    _, outcomes = api.import_paste(existing, pastes, "apa-7", none, none)
    assert "BroadcastExchange" not in outcomes._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["outcome"] for r in outcomes.collect()) == ["added", "duplicate", "error"]
