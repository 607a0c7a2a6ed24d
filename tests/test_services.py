"""Request guards, the operation log, lookups, rendering of what changed, pretty JSON and batch checks."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.functions.exports import pretty_json
from quirework.functions.validate import errors
from quirework import plans
from quirework.operators import documents
from quirework.operators.aggregate import first_bad
from quirework.operators.documents import csl_json_file, pretty_csl_json
from quirework.operators.incremental import STORE, rendered
from quirework.operators.log import LOG, Chain, replay
from quirework.operators.requests import guarded
from quirework.operators.sets import csl
from quirework.sources import lookups as L
from tests.helpers import citations, person, value

MEGABYTE = 1_048_576


# Request guards.
@pytest.mark.parametrize(("most", "seconds"), [(3, 60), (1, 1), (40, 3600)])
def test_guards(spark, most, seconds):
    rng = random.Random(seconds)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(900):
        at = start + dt.timedelta(milliseconds=rng.randrange(3_000_000) // 250 * 250)
        client = "busy" if k % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((k, client, at if k % 50 else None, rng.choice([0, 5000, MEGABYTE, MEGABYTE + 1]), rng.choice([0, 1, 50, 51])))
    df = spark.createDataFrame(rows, "request_id long, client string, at timestamp, body_bytes long, items int").repartition(5)
    got = {r["request_id"]: (r["recent"], r["status"]) for r in guarded(df, most, seconds).collect()}
    for k, client, at, size, items in rows:
        recent = None if at is None else sum(c == client and t is not None and at - dt.timedelta(seconds=seconds) < t <= at for _, c, t, _, _ in rows)
        status = 413 if size > MEGABYTE else 400 if items > 50 else 429 if recent and recent > most else 200
        assert got[k] == (recent, status), rows[k]
    assert {s for _, s in got.values()} == {200, 400, 413, 429} and len(got) == 900


# The operation log.
def one_by_one(rows, log):
    """Records by bibliography after each operation in turn; a record is [id, fields]."""
    state = {}
    for r in rows:
        state.setdefault(r["bibliography_id"], []).append([r["id"], {"title": r["title"], "publisher": r["publisher"]}])
    for b, _, op, i, fields, step in sorted((o for o in log if None not in o[:2] and o[3] is not None), key=lambda o: (o[0], o[1], o[2])):
        own = state.setdefault(b, [])
        at = next((k for k, r in enumerate(own) if r[0] == i), None)
        if op == "add" and at is None:
            own.append([i, {"title": None, "publisher": None} | (fields or {})])
        elif op == "edit" and at is not None:
            own[at][1].update(fields or {})
        elif op == "delete" and at is not None:
            del own[at]
        elif op == "move" and at is not None and step in (-1, 1) and 0 <= at + step < len(own):
            own[at], own[at + step] = own[at + step], own[at]
    return {(b, i, k): (f["title"], f["publisher"]) for b, own in state.items() for k, (i, f) in enumerate(own)}


@pytest.mark.parametrize("seed", range(4))
def test_replay(spark, seed):
    rng = random.Random(seed)
    rows = [{"bibliography_id": b, "pos": k, "id": f"{b}-{k}", "title": f"t{k}", "publisher": "p"} for b in range(8) for k in range(rng.randint(0, 6))]
    log = []
    for s in range(260):
        b = rng.randrange(9)
        ops = ["add", "edit", "delete", "move", "move"] if b % 2 else ["add", "edit", "edit", "delete"]
        op = rng.choice(ops)
        fields = {rng.choice(["title", "publisher"]): rng.choice([f"v{s}", None])} if op in ("add", "edit") and rng.random() < 0.9 else None
        log.append((b, s, op, rng.choice([f"{b}-{rng.randrange(8)}", f"{b}-{rng.randrange(8)}", f"{b}-{rng.randrange(8)}", None]), fields, rng.choice([-1, 1, 1, 2, 0, None])))
    log += [(None, 1, "add", "x", None, 0), (1, None, "add", "x", None, 0), (1, 999, "sing", "1-0", None, 0)]
    got = replay(citations(spark, rows), spark.createDataFrame(log, LOG).repartition(4)).collect()
    told = {(r["bibliography_id"], r["id"], r["pos"]): (r["title"], r["publisher"]) for r in got}
    assert len(told) == len(got) and told == one_by_one(rows, [o for o in log if o[2] != "sing"])


def test_replay_with_merge_joins(spark):
    """Large tables are not broadcast; how their joins are run must not part a bibliography or change its order."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        rows = plans.QUERIES["replayed"](spark, "/root/testdata/sf0.1")
        new = F.max(F.when(F.col("id").startswith("new-"), F.col("pos")))
        of = rows.groupBy("bibliography_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("places"), F.max("pos").alias("last"), new.alias("new"))
        at = F.expr("CASE WHEN bibliography_id % 2 = 1 OR n = 1 THEN n - 1 ELSE n - 2 END")
        assert of.where((F.col("places") != F.col("n")) | (F.col("last") != F.col("n") - 1) | (F.col("new") != at)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_replay_of_nothing(spark):
    rows = citations(spark, [{"id": "a", "title": "x"}, {"id": "b", "title": "y"}])
    empty = spark.createDataFrame([], LOG)
    assert [(r["id"], r["pos"], r["title"]) for r in replay(rows, empty).orderBy("pos").collect()] == [("a", 0, "x"), ("b", 1, "y")]
    assert replay(rows.limit(0), empty).count() == 0


def test_chain_is_quick():
    chain = Chain(range(200_000))
    for k in range(199_999):
        chain.move(0, 1)
        chain.remove(k + 1) if k % 2 else None
    assert list(chain)[-1] == 0 and len(list(chain)) == 100_001


# Lookups.
def test_only_lapsed_keys_are_looked_up_again(spark, tmp_path):
    path, asked = f"{tmp_path}/log", []
    outcomes = {"good": "ok", "gone": "not_found", "down": "upstream_error"}

    def resolve(keys):
        asked.append(sorted(r["key"] for r in keys.collect()))
        told = [(k, s, '{"a":1}' if s == "ok" else None) for k, s in outcomes.items()]
        return spark.createDataFrame(told, "key string, status string, csl_json string")

    keys = spark.createDataFrame([("good",), ("gone",), ("down",), ("good",), ("odd",), (None,)], "key string")
    at = lambda t: F.timestamp_seconds(F.lit(1_700_000_000 + t))
    first = {r["key"]: r["status"] for r in L.look_up(keys, path, resolve, at(0)).collect()}
    assert first == outcomes | {"odd": "not_found"}
    L.look_up(keys, path, resolve, at(599))
    outcomes["down"] = "ok"
    second = {r["key"]: (r["status"], r["csl_json"]) for r in L.look_up(keys, path, resolve, at(601)).collect()}
    assert second["down"] == ("ok", '{"a":1}')
    L.look_up(keys, path, resolve, at(3_700))
    L.look_up(keys, path, resolve, at(90_000))
    assert asked == [["down", "gone", "good", "odd"], [], ["down"], ["gone", "odd"], ["down", "gone", "good", "odd"]]
    assert L.read(spark, path).count() == 4 + 1 + 2 + 4
    table = L.compact(spark, path, f"{tmp_path}/table")
    assert sorted(r["key"] for r in table.collect()) == ["down", "gone", "good", "odd"]
    assert L.compact(spark, path, f"{tmp_path}/held", at(95_000)).count() == 2


# Rendering of what changed.
def test_only_changed_records_are_rendered(spark):
    works = [{"id": f"c{k}", "title": f"Title {k}", "author": [person("Doe", "J")], "year": 2000 + k} for k in range(100)]
    texts, store = rendered(citations(spark, works), "apa-7", spark.createDataFrame([], STORE))
    assert texts.where("from_store").count() == 0
    store = spark.createDataFrame(store.collect(), STORE)
    works[7]["title"], works[9]["year"] = "Another", 1900
    again, kept = rendered(citations(spark, works[:99]), "apa-7", store.unionByName(store))
    assert sorted(r["id"] for r in again.where("NOT from_store").collect()) == ["c7", "c9"]
    whole, _ = rendered(citations(spark, works[:99]), "apa-7", spark.createDataFrame([], STORE))
    assert Counter((r["id"], r["text"]) for r in again.collect()) == Counter((r["id"], r["text"]) for r in whole.collect())
    assert kept.count() == 99
    other, _ = rendered(citations(spark, works[:99]), "ieee", store)
    assert other.where("from_store").count() == 0


# Pretty JSON.
def test_pretty_json(spark):
    for made in ({"a": [], "b": {}, "c": [1, [2, []], {"d": None}], "e\"{": "x,[y]:{\\z\" ", "f": True, "g": -1.5e3}, [], {}, [{}], "s", 1, [[[]]], {"a": {"b": {"c": "d"}}}):
        text = json.dumps(made, separators=(",", ":"), ensure_ascii=False)
        assert value(spark, pretty_json(F.lit(text))) == json.dumps(made, indent=2, ensure_ascii=False)
    rows = citations(spark, [{"title": "B \"q\"", "author": [person("Doe", "J")], "ISBN": ["1", "2"], "year": 2001}, {"title": "A", "type": "chapter"}])
    content = pretty_csl_json(rows, "chicago-notes-bibliography").first()["content"]
    assert content == json.dumps(json.loads(content), indent=2, ensure_ascii=False) + "\n"
    assert [r["title"] for r in json.loads(content)] == ["A", 'B "q"']


# Older markup.
def test_older_markup_is_brought_up_to_date(spark, monkeypatch):
    monkeypatch.setattr(documents, "VERSIONS", (documents.VERSIONS[0], documents.VERSIONS[3]))
    works = [{"bibliography_id": b, "pos": k, "id": f"{b}{k}", "title": f"Work {b}{k}", "DOI": f"10.1/{b}{k}", "formatted_text": f"Work {b}{k}. https://doi.org/10.1/{b}{k}"} for b in (1, 2, 3) for k in (0, 1)]
    rows = citations(spark, works).cache()
    heads = spark.createDataFrame([(b, "References", True, True, False, False) for b in (1, 2, 3)], "bibliography_id long, heading_text string, output_json_ld boolean, output_coins boolean, output_csl_json boolean, output_cite_export boolean")
    newest, older = ({r["bibliography_id"]: r["html"] for r in documents.html(heads, rows, "apa-7", v).collect()} for v in (0, 1))
    assert "<h2" in older[1] and "<h2" not in newest[1]
    stored = spark.createDataFrame([(1, newest[1]), (2, older[2]), (3, older[3] + "<!-- by hand -->")], "bibliography_id long, html string")
    told = {r["bibliography_id"]: (r["html"], r["version"]) for r in documents.migrated(stored, heads, rows, "apa-7").collect()}
    assert told == {1: (newest[1], 0), 2: (newest[2], 1), 3: (older[3] + "<!-- by hand -->", None)}


# Batch checks.
def test_first_bad_row(spark):
    long = "x" * 65_537
    rows = [
        {"bibliography_id": 1, "pos": 0, "title": "fine"}, {"bibliography_id": 1, "pos": 1, "author": [person(given=long)]}, {"bibliography_id": 1, "pos": 2, "type": "nonsense"},
        {"bibliography_id": 2, "pos": 0, "title": "fine"}, {"bibliography_id": 3, "pos": 4, "ISSN": ["1", long]}, {"bibliography_id": 3, "pos": 3, "author": [person()]},
        {"bibliography_id": 4, "pos": 0, "issued": (None, long, None)}, {"bibliography_id": 5, "pos": 0, "issued": ([[]], None, None)}, {"bibliography_id": 6, "pos": 0, "title": "é" * 32_768},
        {"bibliography_id": 7, "pos": 0, "title": "é" * 32_769},
    ]
    told = {r["bibliography_id"]: (r["rows"], r["bad"], r["pos"], r["error"]) for r in first_bad(citations(spark, rows), errors(csl(), "strict")).collect()}
    assert told == {
        1: (3, 2, 1, "field_too_large"), 2: (1, 0, None, None), 3: (2, 2, 3, "author_invalid"), 4: (1, 1, 0, "field_too_large"),
        5: (1, 1, 0, "issued_invalid"), 6: (1, 0, None, None), 7: (1, 1, 0, "field_too_large"),
    }


def test_pretty_file_of_odd_records(spark):
    """Signs that JSON escapes, what is empty, and nulls in lists: the file is that of a plain writer over the short file."""
    odd = 'a"b\\c\x01\x02\n\x7f{}[],:é漢😀'
    rows = [
        {"title": odd, "ISBN": [odd, None, ""], "author": [person(odd), person()], "issued": ([[2001, 2], [], None, [None]], odd, None)},
        {"title": "", "ISBN": ["1"], "issued": ([], None, ""), "accessed": (None, None, None)},
        {"type": None, "id": None, "title": None},
    ]
    table = citations(spark, rows)
    for style in (None, "apa-7"):
        short = json.loads(csl_json_file(table, style).first()["content"])
        assert len(short) == 3 and {} in short
        assert pretty_csl_json(table, style).first()["content"] == json.dumps(short, indent=2, ensure_ascii=False) + "\n"
