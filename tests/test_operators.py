"""Operators over small bibliographies."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.operators import aggregate as A
from quirework.operators import dedupe as D
from quirework.operators import documents as DOC
from quirework.operators import ordering as O
from quirework.operators import sets as S
from quirework.schema import CITATION_DDL, DATE, NAMES, STYLES
from tests.helpers import citations, person


def order(rows, style, by="id"):
    placed = O.sorted_citations(rows, style).collect()
    return [r[by] for r in sorted(placed, key=lambda r: (r["bibliography_id"], r["position"]))]


WORKS = [
    {"id": "zim", "author": [person("Zimmer", "A")], "title": "A Book", "year": 2000},
    {"id": "ang", "author": [person("ångström", "B")], "title": "Light", "year": 1868},
    {"id": "adams", "author": [person("Adams", "C")], "title": "The Guide", "year": 1979},
    {"id": "adams-two", "author": [person("Adams", "C"), person("Carwardine", "M")], "title": "Last Chance", "year": 1970},
    {"id": "adams-new", "author": [person("Adams", "C")], "title": "Alpha", "year": 1990},
    {"id": "adams-old", "author": [person("Adams", "C")], "title": "Zeta", "year": 1975},
    {"id": "none", "title": None},
    {"id": "title", "title": "The Beagle", "year": 1839},
    {"id": "editor", "editor": [person("Baker", "E")], "title": "Edited", "year": 1950},
    {"id": "body", "author": [person(literal="acme corp")], "title": "Report", "year": 2010},
    {"id": "un-z", "author": [person("Undated", "U")], "title": "Zed"},
    {"id": "un-a", "author": [person("Undated", "U")], "title": "Able"},
]


def test_notes_order(spark):
    got = order(citations(spark, WORKS), "chicago-notes-bibliography")
    assert got == ["body", "adams-new", "adams", "adams-two", "adams-old", "ang", "editor", "title", "un-a", "un-z", "zim", "none"]


def test_author_date_order(spark):
    got = order(citations(spark, WORKS), "apa-7")
    assert got == ["body", "adams-old", "adams", "adams-new", "adams-two", "ang", "editor", "title", "un-z", "un-a", "zim", "none"]


def test_numeric_order_is_stored_order(spark):
    assert order(citations(spark, WORKS), "ieee") == [w["id"] for w in WORKS]


def test_exact_order(spark):
    rows = citations(spark, WORKS)
    assert O.exact_order(rows, "apa-7").first()["ids"] == order(rows, "apa-7")
    assert O.exact_order(rows, "vancouver").first()["ids"] == [w["id"] for w in WORKS]


@pytest.mark.parametrize("style", [s[0] for s in STYLES])
def test_every_order_is_a_permutation(spark, style):
    rows = citations(spark, [{**w, "bibliography_id": k % 2} for k, w in enumerate(WORKS)])
    placed = O.sorted_citations(rows, style)
    assert sorted(r["id"] for r in placed.collect()) == sorted(w["id"] for w in WORKS)
    assert sorted((r["bibliography_id"], r["position"]) for r in placed.collect()) == [(b, k) for b in (0, 1) for k in range(6)]


def test_orders_by_own_style(spark):
    rows = citations(spark, [{**w, "bibliography_id": b} for b in (1, 2) for w in WORKS]).withColumn(
        "style", F.when(F.col("bibliography_id") == 1, "apa-7").otherwise("ieee")
    )
    got = O.sorted_by_own_style(rows, ["apa-7", "ieee"])
    assert got.count() == 2 * len(WORKS)
    assert [r["id"] for r in got.where("bibliography_id = 2").orderBy("pos").collect()] == [
        r["id"] for r in got.where("bibliography_id = 2").orderBy("position").collect()
    ]


# Duplicates.
def by_hand(rows):
    """The greedy rule in plain Python over (doi, title, year, author)."""

    def match(a, b):
        if a[0] and a[0] == b[0]:
            return True
        if not a[1] or a[1] != b[1]:
            return False
        years, authors = a[2] and b[2] and a[2] == b[2], a[3] and b[3] and a[3] == b[3]
        return bool(years or authors or not (a[2] or b[2] or a[3] or b[3]))

    kept, out = [], []
    for r in rows:
        dup = any(match(r, k) for k in kept)
        out.append(dup)
        if not dup:
            kept.append(r)
    return out


def as_rows(table):
    return [
        {"DOI": d, "title": t, "author": [person(a, "X")] if a else [], "year": y or 0, "pos": k} for k, (d, t, y, a) in enumerate(table)
    ]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from([None, "10.1/a", "10.1/b"]), st.sampled_from([None, "t", "u"]), st.sampled_from([None, 1, 2]), st.sampled_from([None, "p", "q"])),
        min_size=1,
        max_size=14,
    )
)
def test_greedy_partition(spark, table):
    rows = D.partition_duplicates(citations(spark, as_rows(table))).collect()
    assert [r["duplicate"] for r in sorted(rows, key=lambda r: r["pos"])] == by_hand(table)


def test_partition_of_a_large_bibliography(spark):
    """100,000 rows of one bibliography, a third of them copies of one record, and chains of rows that wait for each other."""
    rng = random.Random(11)
    table = []
    for k in range(100_000):
        if k % 3 == 0:
            table.append(("10.1/same", "One title", 1999, "Doe"))
        else:
            title = f"t{rng.randrange(4000)}"
            table.append((rng.choice([None, f"10.1/{rng.randrange(30_000)}"]), title, rng.choice([0, 2001, 2002]), rng.choice([None, "A", "B", "C"])))
    table[50_000:50_012] = [("", "chain", 1900 + (k + 1) // 2, f"P{k // 2}") for k in range(12)]
    claimed, expected = set(), []
    for doi, title, year, author in table:
        keys = {("d", doi)} if doi else set()
        keys |= {("y", title.lower(), year)} if year else set()
        keys |= {("a", title.lower(), author)} if author else set()
        keys |= {("t", title.lower())} if not year and not author else set()
        expected.append(bool(keys & claimed))
        if not expected[-1]:
            claimed |= keys
    rows = [(1, k, d, t, [(a, "X", None, None)] if a else [], ([[y]], None, None)) for k, (d, t, y, a) in enumerate(table)]
    df = spark.createDataFrame(rows, f"bibliography_id long, pos long, DOI string, title string, author {NAMES}, issued {DATE}").repartition(8)
    got = D.partition_duplicates(df).select("pos", "duplicate").collect()
    assert [r["duplicate"] for r in sorted(got, key=lambda r: r["pos"])] == expected
    assert expected[50_000:50_012] == [False, True] * 6 and 30_000 < sum(expected) < 99_000


def test_partition_keeps_rows_without_keys(spark):
    none = spark.createDataFrame([], CITATION_DDL)
    assert D.partition_duplicates(none).count() == 0
    rows = citations(spark, [{"title": None}, {"title": " "}, {"title": None}, {"title": "x", "bibliography_id": None}, {"title": "x", "bibliography_id": None}])
    assert [r["duplicate"] for r in D.partition_duplicates(rows).collect()] == [False] * 5


def test_partition_is_not_transitive(spark):
    table = [("10.1/a", "t", 1, "p"), ("10.1/b", "t", 1, "q"), ("10.1/b", "u", 2, "q")]
    rows = D.partition_duplicates(citations(spark, as_rows(table))).collect()
    assert [r["duplicate"] for r in sorted(rows, key=lambda r: r["pos"])] == [False, True, False]


def test_first_duplicates(spark):
    have = citations(spark, as_rows([("10.1/a", "t", 1, None), (None, "t", 1, None)]))
    new = citations(spark, as_rows([("https://doi.org/10.1/A.", "z", 5, None), (None, "T!", 1, None), (None, "new", 1, None)]))
    got = {r["pos"]: r["duplicate_of"] for r in D.first_duplicates(new, have).collect()}
    assert got == {0: 0, 1: 0}


# Sets and mutations.
def ids(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_append_delete_move(spark):
    rows = citations(spark, [{"id": x} for x in "abcd"])
    some = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    left = S.delete(rows, some("b", "z"))
    assert ids(left) == ["a", "c", "d"] and [r["pos"] for r in left.orderBy("pos").collect()] == [0, 1, 2]
    assert ids(S.append(left, citations(spark, [{"id": "n"}, {"id": "m"}]))) == ["a", "c", "d", "n", "m"]
    moves = lambda pos, step: spark.createDataFrame([(1, pos, step)], "bibliography_id long, pos long, step int")
    assert ids(S.move(rows, moves(1, 1))) == ["a", "c", "b", "d"]
    assert ids(S.move(rows, moves(0, -1))) == list("abcd") == ids(S.move(rows, moves(3, 1)))
    focus = {r["id"]: r["focus"] for r in S.next_focus(rows, some("a", "d")).collect()}
    assert focus == {"a": "b", "d": "c"}


def test_edits(spark):
    rows = citations(
        spark,
        [
            {"id": "a", "title": "Old", "publisher": "P", "display_override": "o", "parse_warnings": ["w"], "year": 2000, "author": [person("Doe", "J")]},
            {"id": "b", "type": "collection", "title": "B", "editor": [person("Roe", "M")]},
            {"id": "c", "title": "C", "formatted_text": "auto"},
        ],
    )
    form = "id string, authors string, title string, containerTitle string, publisher string, year string, page string, doi string, url string"
    edited = S.edit_fields(rows, spark.createDataFrame([("a", "Poe, Al; Acme", " New ", "", " ", "x", "3", "", "")], form)).orderBy("pos").collect()
    a, b = edited[0], edited[1]
    assert (a["title"], a["publisher"], a["page"], a["display_override"], a["parse_warnings"], a["issued"]) == ("New", None, "3", None, [], None)
    assert [n["family"] or n["literal"] for n in a["author"]] == ["Poe", "Acme"] and b["title"] == "B" and b["editor"][0]["family"] == "Roe"
    texts = spark.createDataFrame([("c", " auto "), ("b", "Mine")], "id string, text string")
    assert [r["display_override"] for r in S.override_text(rows, texts).orderBy("pos").collect()] == ["o", "Mine", None]
    assert [r["display_override"] for r in S.reset_override(rows, spark.createDataFrame([("a",)], "id string")).orderBy("pos").collect()] == [None] * 3
    patched = S.update(rows, spark.createDataFrame([("b", "X", None)], "id string, title string, publisher string")).orderBy("pos").collect()
    assert [r["title"] for r in patched] == ["Old", "X", "C"] and patched[0]["publisher"] == "P"


def test_styles_and_manual_rows(spark):
    rows = S.formatted_in(citations(spark, [{"id": "a", "title": "Zed", "year": 2001}]), "apa-7")
    heads = spark.createDataFrame([(1, "References"), (2, "Mine"), (3, " ")], "bibliography_id long, heading_text string")
    changed = S.change_heading(heads, "apa-7", "abnt").orderBy("bibliography_id").collect()
    assert [r["heading_text"] for r in changed] == ["Referências", "Mine", "Referências"]
    new = citations(spark, [{"id": "n", "title": "Alpha", "year": 2001}, {"id": "dup", "title": "zed", "year": 2001}])
    got = S.add_manual(rows, new, "apa-7")
    assert ids(got) == ["n", "a"] and got.where("formatted_text IS NULL").count() == 0


# Aggregates.
def test_caps_and_counts(spark):
    rows = citations(spark, [{"bibliography_id": b} for b, n in ((1, 3), (2, 101)) for _ in range(n)])
    got = {r["bibliography_id"]: (r["entry_count"], r["over_soft_cap"], r["over_hard_cap"]) for r in A.entry_counts(rows).collect()}
    assert got == {1: (3, False, False), 2: (101, True, False)}


def test_latency_summary(spark):
    samples = spark.createDataFrame([("a", float(v)) for v in (5, 1, 4, 2)], "op string, ms double")
    r = A.latency_summary(samples, "op", "ms").first()
    assert (r["min"], r["max"], r["avg"], r["median"], r["p50"], r["p95"], r["runs"]) == (1, 5, 3, 3, 2, 5, 4)


# Documents.
def test_documents(spark):
    rows = S.formatted_in(
        citations(
            spark,
            [
                {"id": "b", "title": "Zed <i>", "author": [person("Zim", "A")], "year": 2001, "URL": "https://x.org/?a=1&b=2"},
                {"id": "a", "title": "War", "author": [person("Abel", "B")], "year": 2000},
            ],
        ),
        "apa-7",
    )
    assert DOC.plain_text(rows, "apa-7").first()["content"].startswith("Abel, B. 2000. War.\nZim")
    assert DOC.ris_file(rows, "apa-7").first()["content"].count("ER  - ") == 2
    heads = spark.createDataFrame(
        [(1, "Works", True, True, True, True)],
        "bibliography_id long, heading_text string, output_json_ld boolean, output_coins boolean, output_csl_json boolean, output_cite_export boolean",
    )
    page = DOC.html(heads, DOC.with_exports(rows), "apa-7").first()["html"]
    assert page.index("ref-a") < page.index("ref-b") and "<i>War</i>" in page and "\\u003ci>" in page
    assert 'href="https://x.org/?a=1&amp;b=2."' not in page and 'href="https://x.org/?a=1&amp;b=2"' in page
    assert "application/ld+json" in page and "Z3988" in page and "data:text/x-bibtex" in page
    for version in range(1, len(DOC.VERSIONS)):
        old = DOC.html(heads, rows, "apa-7", version).first()["html"]
        assert "details" not in old and (old.index("ref-a") < old.index("ref-b")) == DOC.VERSIONS[version]["sort"]
    assert DOC.html(heads, rows.where("1 = 0"), "apa-7").count() == 0
    items = rows.withColumn("index", F.col("pos"))
    assert [r["index"] for r in DOC.format_request(items, "ieee").orderBy("index").collect()] == [0, 1]


def test_rejected_rows_are_not_broadcast(spark):
    """Their files are far smaller than their rows, so sizes of files must not decide on it."""
    rows = citations(spark, [{"title": "Alpha", "year": 1990 + k % 2, "pos": k} for k in range(6)])
    marked = D.partition_duplicates(rows)
    assert "BroadcastExchange" not in marked._jdf.queryExecution().executedPlan().toString()
    assert {r["pos"]: r["duplicate"] for r in marked.collect()} == {k: k > 1 for k in range(6)}


def test_first_duplicates_of_odd_rows(spark):
    """A null bibliography matches none; an incoming row without a place is told of the first stored one."""
    have = citations(spark, [{"title": "Alpha", "year": 1990, "pos": k, "bibliography_id": b} for k, b in ((4, 1), (2, 1), (0, None))])
    new = citations(spark, [{"title": "Alpha", "year": 1990, "pos": k, "bibliography_id": b} for k, b in ((7, 1), (None, 1), (5, None), (6, 2))])
    assert {(r["bibliography_id"], r["pos"], r["duplicate_of"]) for r in D.first_duplicates(new, have).collect()} == {(1, 7, 2), (1, None, 2)}
    assert {(r["bibliography_id"], r["pos"], r["duplicate_of"]) for r in D.first_duplicates(have, have).collect()} == {(1, 4, 2), (1, 2, 2)}
