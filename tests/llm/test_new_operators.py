"""Page text, the Merkle manifest and the alignment of tokenizers against brute-force versions."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quirework.llm import alignment, html_extraction, merkle, queries
from quirework.llm.html_blocks import FRAME, MAIN, OPEN, blocks_of
from quirework.llm.ranks import ranked

SF = "/root/testdata/sf0.001"
PATHS = tuple(public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# Places in an order.
def test_ranked(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(20)]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "s string, n int, k int").repartition(7)
    got = {(r["s"], r["n"], r["k"]): r["rank"] for r in ranked(df, "s", "n", "k").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    assert got == {row: place for place, row in enumerate(order)}
    assert ranked(df.limit(0), "s", "n", "k").count() == 0


# 11: page text.
class Article(HTMLParser):
    """Text of the article element, block by block, by the library's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.text = 0, [], []

    def ended(self):
        text = " ".join("".join(self.text).split())
        self.blocks += [text] if text else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "p", "h1"):
            self.ended()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.ended()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.text.append(data)


def test_text_of_the_tables_pages(spark):
    pages = [r for name in ("sf0.001", "sf0.01") for r in duckdb.sql(f"SELECT page_id, url, html FROM '/root/testdata/{name}/pages.parquet'").fetchall()]
    expected = Counter()
    for page_id, url, page in pages:
        reader = Article()
        reader.feed(page)
        reader.close()
        text = "\n".join(reader.blocks)
        expected[page_id, url, text, len(text)] += 1
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert counted(html_extraction.extract_text(df), "page_id", "url", "text", "n_chars") == expected


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>a &amp;amp; b&nbsp;c<br>d  \n e</p>f &lt;b&gt; &#8212; &eacute &bogus;</article>", "a &amp; b c d e\nf <b> — é &bogus;"),
        ("<nav>n</nav><main><h1>T</h1><p>One<p>Two <b>bo</b>ld<ul><li>x<li>y</ul></main><footer>f</footer>", "T\nOne\nTwo bold\nx\ny"),
        ("<article><header><h1>T</h1></header><p>p</p><aside>s</aside><form>f<input></form><footer>g</footer></article>", "T\np"),
        ("<article><p>p</p><section id=comments><article class='comment-body'><p>nice</p></article></section></article>", "p"),
        ("<article><p>p</p><div class='ad-slot'>buy</div><div class=newsletter>mail us</div><p>q</p><script>if (a < b) '</p>'</script></article>", "p\nq"),
        ("<form><div class='cookieNotice'>c</div><article>in a form</article></form>", "in a form"),
        ("<aside><article>card</article></aside><article>own", "own"),
        ("<body class='no-sidebar has-comments'><div class='post-content'><p>x</p><div role=navigation>m</div></div><div>other</div>", "x"),
        ("<article><table><tr><td>1<td>2</table><pre>a\n  b</pre><figure><img alt=q><figcaption>c</figcaption></figure></article>", "1\n2\na b\nc"),
        ("<article><p class='ad'>buy<p>kept</article>", "kept"),
        ("<article><p>1 < 2 <3 <!-- c > --> x<style>p{}</style></article><!-- never ends", "1 < 2 <3 x"),
        ("<ul><li><a href=/>Home</a><li><a href=/b>B</a></ul><p>Text with a <a href=/>link</a>.", "Text with a link."),
        ("<div hidden>h</div><dialog>d</dialog><p>seen</p><noscript>n</noscript><textarea><p>t</p></textarea>", "seen"),
    ],
)
def test_marks_of_a_page(page, text):
    blocks = blocks_of(page)
    own = [t for t, part in blocks if part == MAIN] or [t for t, part in blocks if part == OPEN]
    assert "\n".join(own) == text
    assert not any(part == FRAME and t in own for t, part in blocks)


def test_pages_are_read_in_linear_time():
    for piece in ('<p class="', "<b>", "</i>", "<!--", '<div class="ad>', "<div>", "<script>", "&amp", "<a <a", "<p>" * 3 + "</div>"):
        blocks_of(piece * 60_000)


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("held", [2**28, 4])
def test_common_subsequence(held, monkeypatch):
    monkeypatch.setattr(html_extraction, "HELD", held)
    rng = random.Random(1)
    for _ in range(600):
        k = rng.choice([2, 4, 9])
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = html_extraction.common_subsequence(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def unmarked_site(n=700):
    """Pages of a host that mark nothing: two lines of menu, one at the end, one in a third of them, and copies among them."""
    rows = []
    for k in range(n):
        body = f"<p>{f'words of page {k} and no other. ' * 12}</p><p>{f'more of {k}. ' * 9}</p>"
        if k in (40, 41, 42):
            body = f"<p>{'the same article three times. ' * 30}</p>"
        menu, foot = "<div>The daily paper</div><div>Weather and sport</div>", "<div>Printed by the press</div>"
        rows.append((k, f"https://Paper.example.org/a/{k:04d}?s=1", f"<body>{menu}<h1>Title {k}</h1>{body}{foot}"))
    return rows


def expected_text(page, near):
    """By hand: blocks that no neighbour shares, but for neighbours that are copies."""
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:div|p|h1|body)>", page)]
    blocks = [b for b in blocks if b]
    kept = blocks
    for other in near:
        theirs = [" ".join(re.sub("<[^>]*>", "", b).split()) for b in re.split(r"</?(?:div|p|h1|body)>", other)]
        theirs = [b for b in theirs if b]
        shared = [b for b in blocks if b in theirs]
        if sum(map(len, shared)) < 0.8 * min(sum(map(len, blocks)), sum(map(len, theirs))):
            kept = [b for b in kept if b not in theirs]
    return "\n".join(kept)


def test_differences_of_unmarked_pages(spark):
    rows = unmarked_site()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_text(df).collect()}
    for k, (page_id, _, page) in enumerate(rows):
        near = [rows[j][2] for j in (k - 1, k + 1) if 0 <= j < len(rows)]
        assert got[page_id] == expected_text(page, near), page_id
    assert got[7].startswith("Title 7\nwords of page 7") and got[7].endswith("more of 7.")
    assert "the same article" in got[41]


def test_marked_pages_are_differenced_too(spark):
    """Marked pages share their menus, and the check restores a line of an article that a neighbour's article shares."""
    menu = "<nav>Home</nav><div>The daily paper of the town</div>"
    page = lambda k, tag: f"{menu}<{tag}><p>{f'own words of {k}. ' * 9}</p><p>Both say this.</p></{tag}>"
    rows = [(k, f"http://h.example/{k}", page(k, tag)) for k, tag in enumerate(["article", "article", "div", "article"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extraction.extract_text(df).collect()}
    own = {k: f"own words of {k}. " * 9 for k in range(4)}
    assert {k: r["text"] for k, r in got.items()} == {k: own[k].strip() + "\nBoth say this." for k in range(4)}
    assert {k: r["marked"] for k, r in got.items()} == {0: True, 1: True, 2: False, 3: True}
    # Pages 1 and 3 share the line with an unmarked page, so it is deleted there, and restored; articles delete none of each other's.
    assert {k: r["n_shared"] for k, r in got.items()} == {0: 2, 1: 3, 2: 2, 3: 3}


def test_odd_pages(spark):
    rows = [
        (None, None, None), (1, None, ""), (2, "no address", "<p>alone</p>"), (2, "no address", "<p>alone</p>"), (3, "http://h.example/a", None),
        (4, "http://h.example/b", "<p>one</p>"), (4, "http://h.example/b", "<p>other text</p>"), (2**53 + 1, "http://h.example", "<article>x</article>"),
        (5, "http://long.example/", "<article>" + "<p>line of a long page</p>" * 20_000), (None, "http://h.example/c", "<p>no id</p>"),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, rank int")
    got = counted(html_extraction.extract_text(df), "page_id", "url", "text")
    texts = ["", "", "alone", "alone", "", "one", "other text", "x", "\n".join(["line of a long page"] * 20_000), "no id"]
    assert got == Counter((i, u, t) for (i, u, _), t in zip(rows, texts, strict=True))
    assert html_extraction.extract_text(df.limit(0)).count() == 0


# 12: Merkle manifest.
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, at):
    steps = []
    for level in levels[:-1]:
        first = at // 3 * 3
        steps.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return steps


def manifest_by_hand(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf = lambda t: H(told(doc_id), told(source), told(lang), told(n), told(t))  # noqa: B023, E731
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        changed = text.replace("\n", "") if even and text is not None else text
        sources[source].append((doc_id, leaf(text), leaf(changed)))
    for own in sources.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([r[1] for r in sources[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order]) if order else [[]]
    out = Counter()
    for k, s in enumerate(order):
        for at, (doc_id, leaf, folded) in enumerate(sources[s]):
            steps = path_of(trees[s], at) + path_of(top, k)
            for left, right in steps:
                folded = H(left, folded, right)
            root = top[-1][0]
            out[doc_id, leaf, trees[s][-1][0], root, H(*[a + b for a, b in steps]), folded, folded == root] += 1
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [1, 1], [9, 10, 1, 28, 3], [0, 800, 5, 2200]])
def test_manifest(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = []
    for k, n in enumerate(sizes):
        source = [None, "b", "", "é", "z", "a"][k]
        rows += [(rng.randrange(10**6), f"t{j}\n{'x' * (j % 5)}\n", "en" if j % 3 else None, source, j if j % 4 else None) for j in range(n)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, level int, tree string")
    assert counted(merkle.manifest(df.repartition(3)), *MANIFEST) == manifest_by_hand(rows)


def test_manifest_of_odd_rows(spark, docs, rows, empty):
    told = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    assert len(told) == len(rows)
    assert counted(merkle.manifest(docs), *MANIFEST) == manifest_by_hand(told)
    assert merkle.manifest(empty).count() == 0


# 13: alignment.
def alignment_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    byte_of = alignment._byte_of()
    texts, held = [], Counter()
    for doc_id, text in rows:
        whole = " " + (text or "")
        ids = a.encode(whole, add_special_tokens=False).ids if text else []
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]
        right = []
        for i in b.encode(text) if text else []:
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or any(b"".join(x for _, x in side) != whole.encode() for side in (left, right)):
            texts.append((doc_id, 0, 0, []))
            continue
        groups, at, ends = [], 0, []
        for side in (left, right):
            total, own = 0, set()
            for _, x in side:
                total += len(x)
                own.add(total)
            ends.append(own)
        for cut in sorted(ends[0] & ends[1]):
            group = []
            for side in (left, right):
                start, inside = 0, []
                for i, x in side:
                    if at <= start and start + len(x) <= cut:
                        inside.append(i)
                    start += len(x)
                group.append(inside)
            groups.append(group)
            at = cut
        texts.append((doc_id, len(left), len(right), groups))
        held.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = Counter()
    for doc_id, n_a, n_b, groups in texts:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out[doc_id, n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), digest] += 1
    return out


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD_TEXTS = [
    None, "", " ", "  two   spaces \n\n x\t y z  ", "<|endoftext|> <s> </s> <unk> <0x0A>", "a\0b", "▁x ▁", "漢字 😀😀 ﬁ é́", "x" * 3000, " " * 500,
    "\x1c a \x85 b　 c", "'s it's  'll", "'s it's  'll", "tab\tand\r\nlines end", "a    b", "1 234 56,7",
]


@pytest.mark.parametrize("most", [alignment.COMMON, 60, 0])
def test_alignment(spark, most):
    """With all pairs broadcast, some, and none."""
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY length(text) LIMIT 40").fetchall()]
    rows = [(k * 5 if k % 9 else None, t) for k, t in enumerate(ODD_TEXTS + texts)] + [(2**53 + 1, texts[5])]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, row int, pairs string").repartition(3)
    assert counted(alignment.align_tokenizers(df, *PATHS, most=most), *ALIGNED) == alignment_by_hand(rows)


def test_alignment_of_no_rows(empty):
    assert alignment.align_tokenizers(empty, *PATHS).count() == 0


def test_links_in_parts(monkeypatch):
    """Links made a few at a time are those made at once."""
    encoders = alignment.Encoders(*PATHS)
    ids = [encoders(t) for t in ("alpha", "Donaudampfschiff", "βeta", "zzzqqx", "naïve")]
    flat = [x for side in (0, 1) for x in (np.array([i for pair in ids for i in pair[side]]), np.array([len(pair[side]) for pair in ids]))]
    whole = alignment.Aligned(*flat, encoders)
    first = [x.tolist() for x in whole.pairs()]
    monkeypatch.setattr(alignment, "LINKS", 3)
    assert [x.tolist() for x in whole.pairs()] == first
    assert sum(first[2]) == whole.numbers()[:, 3].sum()


@pytest.mark.parametrize("known", [alignment.KNOWN, 20])
def test_parts_have_the_tokens_of_the_whole(known, monkeypatch):
    """Also when parts are forgotten now and then."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(alignment, "KNOWN", known)
    a, b = Tokenizer.from_file(PATHS[0]), alignment.encoder_b(PATHS[1])[0]
    a.encode_special_tokens = True
    encoders, rng = alignment.Encoders(*PATHS), random.Random(5)
    signs = ["a", "Ab", "é", "漢", "1", "23", ".", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\u00a0", "\u3000", "\u2009", "▁", "😀", "-", "_"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    parts, some = alignment.Parts(encoders), 0
    for k in range(0, 600, 50):
        numbers, digests, *_ = parts.texts(texts[k : k + 50])
        for text, told, digest in zip(texts[k : k + 50], numbers.tolist(), digests, strict=True):
            ids = a.encode(" " + text, add_special_tokens=False).ids, b(text)
            if encoders(text) is None:
                assert told == [0, 0, 0, 0] and digest == ""
            else:
                assert told[:2] == [len(x) for x in ids] and encoders(text) == ids, repr(text)
                some += 1
    assert some > 300


@pytest.mark.parametrize("name", ["op11_html_extraction", "op12_merkle_manifest"])
def test_sql_of_new_operators(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    told = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in told.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert counted(df, *columns) == Counter(told.fetchall())
    assert df.where(F.lit(False)).count() == 0
