"""Styles of the Citation Style Language 1.0, compiled to Columns.

A style is read on the driver, once; its bibliography layout becomes one expression over a record's columns, so a style
renders any number of records without Python. What is compiled: macros, text, numbers with ordinals, labels, dates with ranges of
years, names (order, initials, ``and``, et al., labels, substitutes), groups that vanish with their variables, conditions, affixes,
quotation marks, text case and the formats of page ranges. Text is plain: font styles are ignored.

Rules of the language that show in the text: a variable that stands in for missing names is not given again; a full
stop is not doubled; and where the locale says so, stops and commas go inside closing quotation marks. Only
punctuation that the style adds is moved or dropped, never that of a record. Signs U+E000 to U+E003 mark it meanwhile.

An unknown element raises ValueError, so that no style is rendered in part. A null or blank variable is empty.
"""

from __future__ import annotations

import functools
import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.csl_terms import LOCALES, ORDINALS, Terms
from quirework.functions.names import title_case
from quirework.functions.text import S, blank_to_null, let, trim, year_of
from quirework.schema import DATE_FIELDS, NAME_FIELDS, column_name

FOLDER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "styles")

#: A stop and a comma that the style adds, and its quotation marks, until the whole text is known.
STOP, COMMA, OPEN, CLOSE = "\ue000", "\ue001", "\ue002", "\ue003"
#: Options of names that a style may set further out.
NAME_OPTIONS = {
    "form": "name-form", "delimiter": "name-delimiter", "and": "and", "delimiter-precedes-last": "delimiter-precedes-last",
    "delimiter-precedes-et-al": "delimiter-precedes-et-al", "et-al-min": "et-al-min", "et-al-use-first": "et-al-use-first",
    "et-al-use-last": "et-al-use-last", "initialize-with": "initialize-with", "name-as-sort-order": "name-as-sort-order",
    "sort-separator": "sort-separator",
}
#: Tests that depend on a citation in running text; none holds in a bibliography.
ELSEWHERE = ("position", "locator", "is-uncertain-date", "disambiguate")
Truth = Column | bool


def _or(*tests: Truth) -> Truth:
    open_ = [t for t in tests if t is not False]
    if any(t is True for t in open_):
        return True
    return functools.reduce(lambda a, b: a | b, open_) if open_ else False


def _and(*tests: Truth) -> Truth:
    open_ = [t for t in tests if t is not True]
    if any(t is False for t in open_):
        return False
    return functools.reduce(lambda a, b: a & b, open_) if open_ else True


def _not(test: Truth) -> Truth:
    return (not test) if isinstance(test, bool) else ~test


def _column(test: Truth) -> Column:
    return F.lit(test) if isinstance(test, bool) else test


def _either(test: Column, a: Truth, b: Truth) -> Truth:
    """a where the test holds, else b."""
    if isinstance(a, bool) and isinstance(b, bool):
        return a if a is b else test if a else ~test
    if isinstance(a, bool):
        return _or(test, b) if a else _and(~test, b)
    if isinstance(b, bool):
        return _or(~test, a) if b else _and(test, a)
    return F.when(test, a).otherwise(b)


def NOTHING() -> Column:
    return F.lit(None).cast("string")


def soft(text: str | None) -> str:
    """An affix or delimiter whose leading stop or comma may be moved or dropped."""
    text = text or ""
    return {".": STOP, ",": COMMA}.get(text[:1], text[:1]) + text[1:]


@dataclass
class Piece:
    """What an element gives: its text, null where it gives none; whether it calls variables; whether one of them is not empty;
    and whether it gives text. The tests are of the record's columns only, so that no text is computed twice."""

    text: Column
    calls: Truth = False
    found: Truth = False
    there: Truth = False

    def framed(self, element: ET.Element) -> Piece:
        """With the element's case, quotation marks and affixes."""
        text, get = self.text, element.get
        if get("strip-periods") == "true":
            text = F.replace(text, F.lit("."), F.lit(""))
        if get("text-case"):
            text = cased(text, get("text-case"))
        if get("quotes") == "true":
            text = F.concat(F.lit(OPEN), text, F.lit(CLOSE))
        if get("prefix") or get("suffix"):
            text = F.concat(F.lit(soft(get("prefix"))), text, F.lit(soft(get("suffix"))))
        return Piece(text, self.calls, self.found, self.there)


def cased(text: Column, case: str) -> Column:
    first = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))
    if case == "lowercase":
        return F.lower(text)
    if case == "uppercase":
        return F.upper(text)
    if case == "capitalize-first":
        return first(text)
    if case == "capitalize-all":
        return F.array_join(F.transform(F.split(text, " "), first), " ")
    if case == "sentence":
        shout = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
        return first(F.when(shout, F.lower(text)).otherwise(text))
    if case == "title":
        return title_case(F.upper(text))
    raise ValueError(f"text-case {case!r} is not known")


def initials(given: Column, sign: str) -> Column:
    """'Mary Jo-Ann' with the sign '. ' becomes 'M. J.-A.', with '' it becomes 'MJ-A'."""
    near, gap = sign.rstrip(), " " if sign.endswith(" ") else ""
    parts = lambda text, by: F.filter(F.split(text, by), lambda p: p != "")
    letter = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit(near))
    word = lambda w: F.array_join(F.transform(parts(w, "-"), letter), "-")
    return F.array_join(F.transform(parts(given, rf"{S}+"), word), gap)


def page_range(pages: Column, how: str | None) -> Column:
    """A range of pages in one of the language's formats; what is no plain range has its hyphens made dashes."""
    dashed = F.regexp_replace(pages, rf"(?<=[0-9]){S}*[-–—]{S}*(?=[0-9])", "–")
    if not how:
        return dashed
    shape = r"^([0-9]+)–([0-9]+)$"

    def whole(text: Column) -> Column:
        first, last = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
        short = F.length(last) < F.length(first)
        full = F.when(short, F.concat(F.substring(first, F.lit(1), F.length(first) - F.length(last)), last)).otherwise(last)
        last = full
        if how != "expanded":
            # The longest beginning that both share, leaving so many digits at least.
            least = {"minimal": 1, "minimal-two": 2, "chicago": 2}[how]
            both = F.concat(first, F.lit("|"), full)
            same = rf"^([0-9]*)[0-9]{{{least},}}\|\1([0-9]{{{least},}})$"
            cut = F.when(F.length(first) == F.length(full), blank_to_null(F.regexp_extract(both, same, 2)))
            last = F.coalesce(cut, full)
            if how == "chicago":
                # Up to 100 and from its multiples all digits are given; from 101 to 109 and the like those that changed.
                low, tens = first.cast("long"), F.regexp_replace(last, "^0+", "")
                last = F.when((low < 100) | (low % 100 == 0), full).when((low % 100 < 10) & (F.length(last) == 2), tens).otherwise(last)
        return F.when(text.rlike(shape), F.concat(first, F.lit("–"), last)).otherwise(text)

    return let(dashed, whole)


@dataclass
class Context:
    """What compiling one layout knows: the record's columns, name options, and variables already given in place of names."""

    columns: dict[str, Column]
    options: dict[str, str]
    number: Column | None = None
    year_suffix: Column | None = None
    #: For variables that stood in for names: when they did.
    given: dict[str, Truth] = field(default_factory=dict)
    #: When the element that is compiled is reached.
    when: Truth = True
    sorting: bool = False
    #: Variables reached so far by what stands in for names, and when.
    reached: list[tuple[str, Truth]] = field(default_factory=list)
    #: How many names are shown at least, where a bibliography's records would else look alike.
    shown: Column | None = None


class Style:
    """A style that is compiled on demand; ``bibliography`` and ``sort_keys`` take a record's columns by their CSL column names."""

    def __init__(self, xml: str, locale: str | None = None):
        root = ET.fromstring(xml)
        for element in root.iter():
            element.tag = element.tag.rsplit("}", 1)[-1]
        self.root = root
        self.macros = {m.get("name"): m for m in root.iter("macro")}
        self.locale = locale or root.get("default-locale", "en-US")
        self.terms = Terms(LOCALES.get(self.locale) or LOCALES["en-US"])
        for own in root.findall("locale"):
            lang = own.get("{http://www.w3.org/XML/1998/namespace}lang")
            if lang in (None, self.locale, self.locale.split("-")[0]):
                self.terms.override(own)
        self.layout = root.find("bibliography")
        if self.layout is None or self.layout.find("layout") is None:
            raise ValueError("the style has no bibliography layout")
        self.options = {k: v for element in (root, self.layout) for k, v in element.attrib.items()}

    def bibliography(self, columns: dict[str, Column], number: Column | None = None, year_suffix: Column | None = None, shown: Column | None = None) -> Column:
        """The text of a record. number: its place in the bibliography from 1; year_suffix: what follows its year; shown: least names."""
        layout = self.layout.find("layout")
        context = Context(columns, self.options, number, year_suffix, shown=shown)
        piece = self.together(list(layout), context, layout.get("delimiter", "")).framed(layout)
        return self.finished(piece.text)

    def sort_keys(self, columns: dict[str, Column]) -> list[Column]:
        """The style's own order: a Column for each key, ascending or descending as the style says; nulls last."""
        keys = []
        for key in self.layout.iterfind("sort/key"):
            options = self.options | {"name-as-sort-order": "all"} | {o: v for o, v in key.attrib.items() if o.startswith("names-")}
            for wide, narrow in (("names-min", "et-al-min"), ("names-use-first", "et-al-use-first"), ("names-use-last", "et-al-use-last")):
                if wide in options:
                    options[narrow] = options[wide]
            context = Context(columns, options, sorting=True)
            if key.get("macro"):
                value = F.lower(self.plain(self.together(list(self.macros[key.get("macro")]), context, "").text))
            else:
                variable = key.get("variable")
                value = columns.get(column_name(variable))
                if value is None:
                    continue
                if variable in DATE_FIELDS:
                    value = year_of(value)
                elif variable in NAME_FIELDS:
                    value = F.lower(self.plain(self.names_text(value, ET.Element("name"), context, {})))
                else:
                    value = F.lower(blank_to_null(value))
            keys.append(value.desc_nulls_last() if key.get("sort") == "descending" else value.asc_nulls_last())
        return keys

    def plain(self, text: Column) -> Column:
        return F.translate(text, STOP + COMMA + OPEN + CLOSE, ".,")

    def finished(self, text: Column) -> Column:
        """The text with the style's own stops, commas and quotation marks in their places."""
        text = F.regexp_replace(text, f"([.!?…]{CLOSE}?){STOP}+", "$1")
        if self.terms.inside_quotes:
            text = F.regexp_replace(text, f"{CLOSE}{STOP}+", f".{CLOSE}")
            text = F.regexp_replace(text, f"{CLOSE}{COMMA}", f",{CLOSE}")
        text = F.regexp_replace(text, f"{STOP}+", ".")
        signs = "," + self.terms.term("open-quote")[0] + self.terms.term("close-quote")[0]
        return F.translate(text, COMMA + OPEN + CLOSE, signs)

    # Elements.
    def piece(self, element: ET.Element, context: Context) -> Piece:
        make = getattr(self, "_" + element.tag.replace("-", "_"), None)
        if make is None or element.tag not in ("text", "number", "label", "date", "names", "group", "choose"):
            raise ValueError(f"element {element.tag!r} is not known")
        return make(element, context)

    def together(self, elements: list[ET.Element], context: Context, delimiter: str) -> Piece:
        pieces = [self.piece(e, context) for e in elements]
        pieces = [p for p in pieces if p.there is not False or p.calls is not False]
        calls, found, there = (_or(*[getattr(p, k) for p in pieces]) for k in ("calls", "found", "there"))
        shown = [p.text for p in pieces if p.there is not False]
        if not shown:
            return Piece(NOTHING(), calls, False, False)
        if len(shown) == 1:
            return Piece(shown[0], calls, found, there)
        joined = F.concat_ws(soft(delimiter), *shown)
        return Piece(joined if there is True else F.when(there, joined), calls, found, there)

    def variable(self, name: str, context: Context) -> Piece:
        """A variable's text; null where it is empty or was given in place of names."""
        some = self.filled(name, context)
        context.reached.append((name, context.when))
        if some is False:
            return Piece(NOTHING(), True)
        special = {"citation-number": context.number, "year-suffix": context.year_suffix}
        value = special[name] if name in special else context.columns[column_name(name)]
        value = value.cast("string")
        return Piece(value if some is True else F.when(some, value), True, some, some)

    def filled(self, name: str, context: Context) -> Truth:
        """Whether a variable has a value that was not given in place of names."""
        column = context.columns.get(column_name(name))
        if name == "citation-number":
            return context.number is not None
        if name == "year-suffix":
            return False if context.year_suffix is None else F.coalesce(context.year_suffix != "", F.lit(False))
        if column is None:
            return False
        if name in NAME_FIELDS:
            some = F.exists(column, lambda n: (n["family"] != "") | (n["given"] != "") | (n["literal"] != ""))
        elif name in DATE_FIELDS:
            some = year_of(column).isNotNull() | (column["literal"] != "")
        else:
            some = column != ""
        return _and(F.coalesce(some, F.lit(False)), _not(context.given.get(name, False)))

    def _text(self, element: ET.Element, context: Context) -> Piece:
        get = element.get
        if get("macro"):
            if get("macro") not in self.macros:
                raise ValueError(f"macro {get('macro')!r} is not defined")
            return self.together(list(self.macros[get("macro")]), context, "").framed(element)
        if get("term"):
            single, multiple = self.terms.term(get("term"), get("form", "long"))
            text = multiple if get("plural") == "true" else single
            return Piece(F.lit(text), there=text != "").framed(element)
        if get("value") is not None:
            return Piece(F.lit(get("value")), there=get("value") != "").framed(element)
        piece = self.variable(get("variable"), context)
        if get("variable") == "page":
            piece.text = page_range(piece.text, self.options.get("page-range-format"))
        return piece.framed(element)

    def _number(self, element: ET.Element, context: Context) -> Piece:
        piece = self.variable(element.get("variable"), context)
        value = piece.text
        if element.get("form", "numeric") in ("ordinal", "long-ordinal"):
            digits = value.rlike("^[0-9]{1,9}$")
            n = F.when(digits, value).cast("int")
            suffix = F.lit(self.terms.term("ordinal")[0])
            for modulus in (10, 100):
                for end, sign in ORDINALS.get(self.locale.split("-")[0], {}).get(modulus, {}).items():
                    suffix = F.when(n % modulus == end, sign).otherwise(suffix)
            piece.text = F.when(digits, F.concat(value, suffix)).otherwise(value)
        return piece.framed(element)

    def _label(self, element: ET.Element, context: Context) -> Piece:
        """A term for a number's variable, where that has a value: plural where it holds several numbers."""
        name = element.get("variable")
        some = self.filled(name, context)
        single, multiple = self.terms.term(name, element.get("form", "long"))
        if some is False or not single:
            return Piece(NOTHING())
        value = context.columns[column_name(name)]
        many = {"always": True, "never": False}.get(element.get("plural", "contextual"), value.rlike(r"[0-9]\s*[-–—,&]\s*[0-9]"))
        return Piece(F.when(_column(_and(some, many)), multiple).when(_column(some), single), there=some).framed(element)

    def _date(self, element: ET.Element, context: Context) -> Piece:
        name = element.get("variable")
        date = context.columns.get(column_name(name))
        some = self.filled(name, context)
        context.reached.append((name, context.when))
        if date is None:
            return Piece(NOTHING(), True)
        parts = list(element.iterfind("date-part"))
        if element.get("form"):
            wanted = element.get("date-parts", "year-month-day").split("-")
            parts = [p for p in self.terms.date_parts(element.get("form")) if p.get("name") in wanted]
        texts = []
        for part in parts:
            which = {"year": 0, "month": 1, "day": 2}[part.get("name")]
            number = F.get(F.get(date["date_parts"], 0), which)
            if which == 0:
                until = F.get(F.get(date["date_parts"], 1), 0)
                span = F.when((until != 0) & (until != number), F.concat(F.lit("–"), until.cast("string")))
                text = F.concat(F.when(number != 0, number).cast("string"), F.coalesce(span, F.lit("")))
                if context.year_suffix is not None and name == "issued":
                    text = F.concat(text, F.coalesce(context.year_suffix, F.lit("")))
            elif which == 1 and part.get("form", "long") in ("long", "short"):
                months = [self.terms.term(f"month-{m:02d}", part.get("form", "long"))[0] for m in range(1, 13)]
                text = F.get(F.array(*map(F.lit, months)), number - 1)
            else:
                text = number.cast("string")
                if part.get("form") == "numeric-leading-zeros":
                    text = F.lpad(text, 2, "0")
            texts.append(Piece(text).framed(part).text)
        shown = F.concat_ws(soft(element.get("delimiter")), *texts)
        dated = _and(some, year_of(date).isNotNull())
        return Piece(F.when(dated, shown).when(_column(some), date["literal"]), True, some, some).framed(element)

    def _group(self, element: ET.Element, context: Context) -> Piece:
        inner = self.together(list(element), context, element.get("delimiter", ""))
        kept = _or(_not(inner.calls), inner.found)
        if kept is False:
            return Piece(NOTHING(), inner.calls)
        # A group that calls variables only gives text if one is found: a test of its text is one of the group.
        text = inner.text if kept is True or kept is inner.there else F.when(kept, inner.text)
        return Piece(text, inner.calls, inner.found, _and(inner.there, kept) if kept is not inner.there else kept).framed(element)

    def _choose(self, element: ET.Element, context: Context) -> Piece:
        branches, before = [], context.when
        for branch in element:
            test = True if branch.tag == "else" else self.test(branch, context)
            context.when = _and(before, test, *[_not(t) for t, _ in branches])
            branches.append((test, self.together(list(branch), context, "")))
        context.when = before
        out = Piece(NOTHING())
        for test, piece in reversed(branches):
            if test is True:
                out = piece
            elif test is not False:
                told = [_either(test, getattr(piece, k), getattr(out, k)) for k in ("calls", "found", "there")]
                out = Piece(F.when(test, piece.text).otherwise(out.text) if told[2] is not False else NOTHING(), *told)
        return out

    def test(self, branch: ET.Element, context: Context) -> Truth:
        tests: list[Truth] = []
        for key, value in branch.attrib.items():
            if key == "type":
                kinds = value.split()
                if branch.get("match", "all") != "all":
                    tests.append(F.coalesce(context.columns["type"].isin(*kinds), F.lit(False)))
                else:
                    tests += [F.coalesce(context.columns["type"] == kind, F.lit(False)) for kind in kinds]
            elif key == "variable":
                tests += [self.filled(name, context) for name in value.split()]
            elif key == "is-numeric":
                tests += [F.coalesce(self.variable(name, context).text.rlike(r"^[A-Za-z]*[0-9]+[A-Za-z]*(\s*[-–—,&]\s*[A-Za-z]*[0-9]+[A-Za-z]*)*$"), F.lit(False)) for name in value.split()]
            elif key in ELSEWHERE:
                tests += [False] * len(value.split())
            elif key != "match":
                raise ValueError(f"test {key!r} is not known")
        match = branch.get("match", "all")
        return _and(*tests) if match == "all" else _or(*tests) if match == "any" else _not(_or(*tests))

    # Names.
    def _names(self, element: ET.Element, context: Context, outer: ET.Element | None = None) -> Piece:
        shape = element if element.find("name") is not None or outer is None else outer
        texts, found = [], []
        for variable in element.get("variable", "").split():
            names = context.columns.get(column_name(variable))
            if names is None:
                continue
            some = self.filled(variable, context)
            context.reached.append((variable, context.when))
            label = self.label_of(shape, variable, names)
            text = self.names_text(names, shape.find("name") if shape.find("name") is not None else ET.Element("name"), context, dict(label=label))
            et_al = shape.find("et-al")
            if et_al is not None and et_al.get("term"):
                text = F.replace(text, F.lit(self.terms.term("et-al")[0]), F.lit(self.terms.term(et_al.get("term"))[0]))
            texts.append(F.when(_column(some), text))
            found.append(some)
        some = _or(*found)
        if not texts:
            own = Piece(NOTHING(), True)
        else:
            between = soft(element.get("delimiter", context.options.get("names-delimiter", "")))
            joined = texts[0] if len(texts) == 1 else F.when(_column(some), F.concat_ws(between, *texts))
            own = Piece(joined, True, some, some).framed(element)
        substitute = element.find("substitute")
        if substitute is None:
            return own
        choices, missing, started = [own], _not(own.found), context.when
        for other in substitute:
            context.when, before = _and(started, missing), len(context.reached)
            piece = self._names(other, context, element) if other.tag == "names" else self.piece(other, context)
            if not context.sorting:
                for variable in {v: None for v, _ in context.reached[before:]}:
                    when = _or(*[w for v, w in context.reached[before:] if v == variable])
                    context.given[variable] = _or(context.given.get(variable, False), _and(when, piece.found))
            choices.append(piece)
            missing = _and(missing, _not(piece.found))
        context.when = started
        return Piece(F.coalesce(*[c.text for c in choices]), True, _or(*[c.found for c in choices]), _or(*[c.there for c in choices]))

    def label_of(self, shape: ET.Element, variable: str, names: Column) -> tuple[bool, Column] | None:
        """(whether it stands before the names, text)."""
        label = shape.find("label")
        if label is None:
            return None
        single, multiple = self.terms.term(variable, label.get("form", "long"))
        many = {"always": F.lit(True), "never": F.lit(False)}.get(label.get("plural", "contextual"), F.size(names) > 1)
        if not single:
            return None
        order = [e.tag for e in shape]
        first = "name" in order and order.index("label") < order.index("name")
        return first, Piece(F.when(many, multiple).otherwise(single)).framed(label).text

    def names_text(self, names: Column, element: ET.Element, context: Context, more: dict) -> Column:
        """A list of names as one text; null if none has a name."""
        option = lambda key, default=None: element.get(key, context.options.get(NAME_OPTIONS[key], default))
        delimiter, order = soft(option("delimiter", ", ")), option("name-as-sort-order")
        joiner = {"text": self.terms.term("and")[0], "symbol": "&"}.get(option("and") or "")
        least, first = int(option("et-al-min") or 0), int(option("et-al-use-first") or 1)
        parts = {p.get("name"): p for p in element.iterfind("name-part")}
        shaped = lambda text, part: Piece(text).framed(parts[part]).text if part in parts else text
        sign = option("initialize-with")

        def one(n: Column, i: Column) -> Column:
            family = shaped(blank_to_null(trim(n["family"])), "family")
            given = trim(n["given"])
            given = shaped(blank_to_null(given if sign is None or element.get("initialize") == "false" else initials(given, sign)), "given")
            if option("form") == "short":
                personal = F.coalesce(family, given)
            else:
                inverted = F.concat_ws(soft(option("sort-separator", ", ")), family, given)
                straight = F.concat_ws(" ", given, family)
                personal = inverted if order == "all" else F.when(i == 0, inverted).otherwise(straight) if order == "first" else straight
            return F.coalesce(blank_to_null(trim(n["literal"])), personal)

        def precedes(how: str, count_rule: Column | bool, inverted: Column | bool) -> Truth:
            return {"always": True, "never": False, "contextual": count_rule, "after-inverted-name": inverted}[how]

        def whole(shown: Column) -> Column:
            n, last = F.size(shown), F.element_at(shown, -1)
            text = F.array_join(shown, delimiter)
            if joiner is not None:
                inverted = True if order == "all" else n == 2 if order == "first" else False
                cut = precedes(option("delimiter-precedes-last", "contextual"), n > 2, inverted)
                link = F.when(_column(cut), F.lit(delimiter.rstrip() + " ")).otherwise(F.lit(" "))
                ahead = F.array_join(F.slice(shown, F.lit(1), n - 1), delimiter)
                text = F.when(n > 1, F.concat(ahead, link, F.lit(joiner + " "), last)).otherwise(text)
            if least:
                many = F.lit(first) if context.shown is None else F.greatest(F.lit(first), context.shown)
                ahead = F.array_join(F.slice(shown, F.lit(1), many), delimiter)
                inverted = True if order == "all" else many == 1 if order == "first" else False
                cut = precedes(option("delimiter-precedes-et-al", "contextual"), many > 1, inverted)
                link = F.when(_column(cut), F.lit(delimiter.rstrip() + " ")).otherwise(F.lit(" "))
                if option("et-al-use-last") == "true":
                    short = F.concat(ahead, F.lit(delimiter + "… "), last)
                else:
                    short = F.concat(ahead, link, F.lit(self.terms.term("et-al")[0]))
                text = F.when((n >= least) & (many < n), short).otherwise(text)
            text = F.when(n > 0, text)
            label = more.get("label")
            if label is not None:
                text = F.concat(label[1], text) if label[0] else F.concat(text, label[1])
            return text

        shown = F.filter(F.transform(names, one), lambda x: x.isNotNull() & (x != ""))
        return let(shown, whole)


@functools.lru_cache(maxsize=64)
def full_style(key: str) -> Style:
    """One of the nine styles in full, with its locale."""
    from quirework.schema import style as style_row

    row = style_row(key)
    with open(os.path.join(FOLDER, f"{row['style']}.csl"), encoding="utf-8") as file:
        return Style(file.read(), row["locale"])
