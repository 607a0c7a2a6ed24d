"""Operator 8: secrets, by patterns and a battery of randomness tests, in DataFrame functions only.

Base kinds are assign, access and hex as the contract defines them. The method adds ``random``: a long run
of encoding characters whose encoding (hex, base32 or base64) is inferred from the characters it has and
which passes for random. Four tests ask whether its symbols could be drawn evenly and independently:
chi-squared uniformity over classes of the alphabet, as many as the length bears; the number of runs above
and below the middle, and that of runs of capitals, small letters and digits, as words have few of those; the serial
correlation of neighbours. Their p-values are combined by Fisher's method.
Two rules over all candidates of the corpus, separately by length (in octaves), as short runs have less power,
say which of them are reported. Benjamini and Hochberg's at ``FALSE_DISCOVERY`` names those that are not random. The
rest may still hold runs that the tests are too weak to reject; as p-values of random runs are even, those above one
half tell how many random ones there are, and only a p-value is reported beyond which the others are estimated to be at most
``FALSE_REPORTS`` of what is reported. Ranks come from a histogram of p-values, at most 500 numbers for each octave.

Defined results: a null text counts as empty; empty texts have no spans; rows that repeat are each
reported (and each count in the rules); an empty table gives an empty table. Extra columns are ignored. Work grows
with a text's length, and with the power 1.5 of the number of its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import compact, let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Stands in the text for base spans of the first kind. It is no character of any pattern.
TAKEN = "\uFFFF"
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{20,}}+={{0,2}}+(?!{TAKEN})"
KINDS = ("assign", "access", "hex", "random")
FALSE_DISCOVERY = 0.05
FALSE_REPORTS = 0.05
#: Steps of the histogram of p-values: twenty for each power of ten, 500 in all.
STEPS, MOST = 20, 500
#: The steps below this one hold the p-values above one half.
HALF = 6
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


SPANS = "array<struct<start:bigint,end:bigint,match:string,k:bigint>>"


def _sums(sizes: Column) -> Column:
    """The running sums of an array of numbers, each with all before it: within blocks of its root's length, then of the blocks."""
    zero, none = F.lit(0).cast("long"), F.expr("cast(array() as array<bigint>)")

    def run(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("seen"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).alias("at"), F.concat(acc["seen"], F.array(acc["at"] + x)).alias("seen"))

        return F.aggregate(xs, start, step)["seen"]

    def of(width: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(sizes), width), lambda i: F.slice(sizes, i, width)), joined)

    def joined(blocks: Column) -> Column:
        before = let(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)), run)
        added = F.zip_with(F.transform(blocks, run), F.concat(F.array(zero), before), lambda xs, base: F.transform(xs, lambda x: x + base))
        return F.flatten(F.slice(added, 1, F.size(blocks)))

    return F.when(F.size(sizes) > 0, let(F.ceil(F.sqrt(F.size(sizes))).cast("int"), of)).otherwise(none)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, k>> of the leftmost non-overlapping matches, in code points.

    What lies between the matches comes from split(), so that lengths add up to positions.
    """

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: (F.length(g) + F.length(m)).cast("long"))
        spans = lambda ends: F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).cast("long").alias("start"), e.alias("end"), m.alias("match")))
        numbered = lambda xs: F.transform(xs, lambda x, k: F.struct(x["start"], x["end"], x["match"], k.cast("long").alias("k")))
        return numbered(let(let(pairs, _sums), spans))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(hits, placed).cast(SPANS)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _erfc(x: Column) -> Column:
    """The complementary error function for x >= 0 to about 1e-7 (a published rational approximation)."""
    t = 1 / (1 + x * 0.3275911)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), series * F.exp(-x * x)))


def _two_sided(z: Column) -> Column:
    return _erfc(F.abs(z) / 2**0.5)


def _upper(z: Column) -> Column:
    tail = _erfc(F.abs(z) / 2**0.5) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(run: Column) -> Column:
    body = F.regexp_replace(run, "=+$", "")
    digit, upper, lower = run.rlike("[0-9]"), run.rlike("[A-Z]"), run.rlike("[a-z]")
    return (
        F.when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & digit & (upper | lower), F.lit("hex"))
        .when(body.rlike("^[A-Z2-7]+$") & digit & upper, F.lit("base32"))
        .when(body.rlike("^[A-Za-z0-9+/_-]+$") & digit & upper & lower, F.lit("base64"))
    )


def symbols(run: Column, code: Column) -> Column:
    """The run's symbols as numbers from 0."""
    plain = F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")
    plain = F.when(code == "hex", F.lower(plain)).otherwise(plain)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), code)
    return F.transform(F.regexp_extract_all(plain, F.lit("."), F.lit(0)), lambda c: F.instr(alphabet, c) - 1)


def randomness(values: Column, k: Column) -> Column:
    """Fisher's combined p-value of the four tests, for symbols 0 to k - 1. values has 20 or more."""
    zero = F.lit(0.0)

    def total(array: Column, term) -> Column:
        return F.aggregate(array, zero, lambda acc, x: acc + term(x))

    def of(v: Column) -> Column:
        n = F.size(v).cast("double")
        # As many classes as bear five symbols each: 4, 8, 16, 32 or 64 of them, not more than k.
        classes = F.least(F.greatest(F.lit(4.0), F.pow(F.lit(2.0), F.floor(F.log2(n / 5)))), k)
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def uniform_p(most: Column) -> Column:
            def by_class(binned: Column) -> Column:
                count = lambda b: F.size(F.filter(binned, lambda y: y == b)).cast("double")
                chi = total(F.sequence(F.lit(0), F.lit(63)), lambda b: F.pow(count(b), 2)) * most / n - n
                df = most - 1
                return let((F.pow(F.greatest(chi, zero) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), _upper)

            return let(F.transform(v, lambda x: F.floor(x * most / k)), by_class)

        def runs_p(mu: Column) -> Column:
            runs = 1 + total(pairs, lambda p: ((p["a"] * 2 >= k) != (p["b"] * 2 >= k)).cast("double"))
            var = let((mu - 1) * (mu - 2) / (n - 1), lambda x: F.when(x > 1e-9, x))
            return F.coalesce(let((runs - mu) / F.sqrt(var), _two_sided), F.lit(1e-12))

        def same_as(kind: int):
            return lambda y: y == kind

        def kinds_p(kinds: Column) -> Column:
            """Of words and numbers put together each keeps to its kind for longer than chance would."""
            sizes = F.array(*[F.size(F.filter(kinds, same_as(kind))).cast("double") for kind in range(3)])
            changes = F.zip_with(F.slice(kinds, 1, F.size(kinds) - 1), F.slice(kinds, 2, F.size(kinds)), lambda a, b: a != b)
            runs = 1 + total(changes, lambda c: c.cast("double"))

            def told(m: Column) -> Column:
                two, three = total(m, lambda x: x * x), total(m, lambda x: x * x * x)
                var = (two * (two + n * (n + 1)) - 2 * n * three - n * n * n) / (n * n * (n - 1))
                return let((runs - (n * (n + 1) - two) / n) / F.sqrt(F.when(var > 1e-9, var)), _two_sided)

            return F.coalesce(let(sizes, told), F.lit(1.0))

        def serial_p(mean: Column) -> Column:
            spread = let(total(v, lambda x: F.pow(x - mean, 2)), lambda x: F.when(x > 1e-9, x))
            lagged = total(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))
            return F.coalesce(let((lagged / spread + 1 / n) * F.sqrt(n), _two_sided), F.lit(1e-12))

        expected = let(total(v, lambda x: (x * 2 >= k).cast("double")), lambda high: 2 * high * (n - high) / n + 1)
        # Capitals, small letters and the rest; letters and digits where there is one case.
        kind = lambda x: F.when(k == 16, (x >= 10).cast("int")).otherwise((x >= 26).cast("int") + (x >= 52).cast("int"))
        four = (
            let(classes, uniform_p), let(expected, runs_p), let(total(v, lambda x: x.cast("double")) / n, serial_p),
            let(F.transform(v, kind), kinds_p),
        )
        half = -sum((F.log(F.greatest(p, F.lit(1e-300))) for p in four), F.lit(0.0))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6))

    return let(values, of)


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _without(text: Column, values: Column) -> Column:
    """The text with TAKEN in place of each character of the base spans of kind assign, whose values are given."""
    hits, gaps = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), F.split(text, ASSIGN, -1)
    masked = F.zip_with(hits, values, lambda h, v: F.when(F.length(v) >= 6, F.repeat(F.lit(TAKEN), F.length(h))).otherwise(h))
    joined = F.array_join(F.zip_with(gaps, masked, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(F.size(values) > 0, joined).otherwise(text)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates): base spans in order; candidates with octave and p-value. No texts."""
    text = F.coalesce(docs["text"], F.lit(""))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = let(values, lambda v: F.filter(matches(text, ASSIGN), lambda m: F.length(F.get(v, m["k"].cast("int"))) >= 6))
    rows = docs.select("doc_id", text.alias("_text"), values.alias("_values"), assign.alias("_found"))
    # A candidate that meets a base span is none. One that meets hex or access holds it whole, as its characters include theirs.
    free = let(_without(F.translate("_text", TAKEN, " "), F.col("_values")), lambda t: matches(t, CANDIDATE))
    alone = lambda m: encoding(m["match"]).isNotNull() & ~m["match"].rlike(HEX) & ~m["match"].rlike(ACCESS)
    base = F.concat(_spans(F.col("_found"), 0), _spans(matches(F.col("_text"), ACCESS), 1), _spans(matches(F.col("_text"), HEX), 2))

    def tested(m: Column) -> Column:
        code = encoding(m["match"])
        k = F.element_at(F.create_map(*[x for name, a in ALPHABETS.items() for x in (F.lit(name), F.lit(float(len(a))))]), code)
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.floor(F.log2((m["end"] - m["start"]).cast("double"))).cast("int").alias("octave"),
            F.greatest(randomness(symbols(m["match"], code), k), F.lit(1e-24)).alias("p"),
        )

    return rows.select("doc_id", F.array_sort(base).alias("base"), F.transform(F.filter(free, alone), tested).alias("candidates"))


def least_reported(steps: dict[int, int]) -> float:
    """The p-value above which candidates of one octave are reported; steps: how many have -log10(p) * STEPS in each step."""
    everything, below, rejected = sum(steps.values()), 0, 0.0
    for s in sorted(steps, reverse=True):
        below += steps[s]
        edge = 10 ** (-s / STEPS)  # no p-value of this step is larger
        if edge <= FALSE_DISCOVERY * below / everything:
            rejected = edge
    # Two standard errors are allowed, so that what is random among few candidates is not thrown out by chance.
    high = sum(n for s, n in steps.items() if s < HALF)
    random = 2 * (high + 2 * (high + 1) ** 0.5)
    clean = 1.0
    for s in sorted(steps):
        above = sum(n for t, n in steps.items() if t <= s)
        edge = 10 ** (-(s + 1) / STEPS)  # all p-values of this and lower steps are larger
        if above - random * (1 - edge) <= FALSE_REPORTS * above:
            clean = edge
    return max(rejected, clean)


def thresholds(rows: DataFrame) -> dict[int, float]:
    """For each octave of length, the p-value above which candidates are reported."""
    step = F.least(F.floor(-F.log10("c.p") * STEPS), F.lit(MOST)).cast("int")
    counts = rows.select(F.explode("candidates").alias("c")).groupBy(F.col("c.octave").alias("octave"), step.alias("step")).count()
    by: dict[int, dict[int, int]] = {}
    for r in counts.collect():  # at most MOST + 1 numbers for each of some twenty octaves
        by.setdefault(r["octave"], {})[r["step"]] = r["count"]
    return {octave: least_reported(steps) for octave, steps in by.items()}


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256, spans."""
    rows = compact(scanned(docs))
    limits = thresholds(rows)

    def passes(c: Column) -> Column:
        value = F.lit(0.0)
        for octave, most in limits.items():
            value = F.when(c["octave"] == octave, F.lit(most)).otherwise(value)
        return c["p"] > value

    random = F.transform(F.filter("candidates", passes), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    base = F.col("base")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text_of(base), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat(base, random))).alias("spans"),
    )
