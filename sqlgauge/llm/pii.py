"""Personal data: base patterns, and spans that boosted trees add to them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import text_key, texts

KINDS = ("email", "ip", "card", "phone")

# The base patterns. A look-behind or the end of the match before keeps the
# search from starting again inside a run that has failed already, and possessive counts
# keep it from trying shorter runs; neither changes what is found.
_LOCAL = r"A-Za-z0-9._%+\-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
# What a text must hold for a pattern to be worth a try.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Fixed value: a credential's name, a sign and the credential. These are counted, not masked.
SECRET = (
    r"(?i)(?:token|secret|passw(?:or)?d|(?:api|access|private)[_\-\x20]?key)[\x22']?\s?[:=]\s?"
    r"[\x22']?[A-Za-z0-9+/_\-]{16,}"
)

_SPANS = "array<struct<start:int,end:int>>"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int")
    )
    doubled = F.transform(
        values,
        lambda v, i: F.when(i % 2 == 0, v).when(v < 5, v * 2).otherwise(v * 2 - 9),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, v: total + v) % 10 == 0


def _ip_ok(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda part: part.cast("double") <= 255)


def _card_ok(match: Column) -> Column:
    digits = digits_of(match)
    return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)


def _phone_ok(match: Column) -> Column:
    return F.length(digits_of(match)).between(8, 15)


_CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda match: F.lit(True),
    "ip": _ip_ok,
    "card": _card_ok,
    "phone": _phone_ok,
}


_RADIX_BITS = 6
_RADIX = 1 << _RADIX_BITS


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column) -> Column:
    """Sums of all earlier values, for each of a list of integers.

    Each is the sum of whole stretches of ``_RADIX`` values and of a few more, so the work
    stays about in proportion to the list up to some hundred thousand values.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, v: a + v)

    def places(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def block(k: Column) -> Column:
        return F.shiftright(k, _RADIX_BITS)

    def stretches(of: Column) -> Column:
        return F.transform(
            places(block(F.size(of) + _RADIX - 1)),
            lambda k: total(F.slice(of, k * _RADIX + 1, F.lit(_RADIX))),
        )

    def before(of: Column) -> Column:
        return F.transform(places(F.size(of)), lambda k: total(F.slice(of, F.lit(1), k)))

    def sums(of: Column, earlier: Column) -> Column:
        return F.transform(
            of,
            lambda _, k: F.get(earlier, block(k))
            + total(F.slice(of, block(k) * _RADIX + 1, k % _RADIX)),
        )

    return _let(
        values,
        lambda v: _let(stretches(v), lambda s: _let(before(s), lambda e: sums(v, e))),
    )


def _placed(text: Column, pattern: str, span: Callable[[Column, Column, Column], Column]) -> Column:
    """``span(row, match, number)`` for the matches of ``pattern``, without the nulls.

    ``row`` has the matches ``f``, the text ``g`` between them and where each starts, ``at``.
    What lies between the matches gives their places, so a text is walked through once,
    however many it has.
    """
    gaps = F.split(text, F.lit(pattern), F.lit(-1))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def with_starts(pair: Column) -> Column:
        sizes = F.zip_with(
            F.slice(pair["g"], F.lit(1), F.size(pair["f"])),
            pair["f"],
            lambda g, f: F.length(g) + F.length(f),
        )
        return F.struct(
            pair["f"].alias("f"), pair["g"].alias("g"), running_sums(sizes).alias("at")
        )

    def walked(row: Column) -> Column:
        found_ = F.transform(row["f"], lambda match, i: span(row, match, i))
        return F.filter(found_, lambda one: one.isNotNull())

    return _let(
        F.struct(gaps.alias("g"), found.alias("f")),
        lambda pair: F.when(F.size(pair["f"]) > 0, _let(with_starts(pair), walked)),
    )


def spans(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Start and end, in code points, of the matches of ``pattern`` that ``keep`` accepts."""

    def span(row: Column, match: Column, i: Column) -> Column:
        start = row["at"][i] + F.length(row["g"][i])
        found = F.struct(start.alias("start"), (start + F.length(match)).alias("end"))
        return F.when(keep(match), found)

    return F.coalesce(_placed(text, pattern, span).cast(_SPANS), F.array().cast(_SPANS))


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of one kind; an empty list for texts that cannot hold any."""
    hint = _HINTS[kind]
    possible = text.rlike("[0-9]") if hint is None else text.contains(hint)
    return F.when(possible, spans(text, BASE[kind], _CHECKS[kind])).otherwise(
        F.array().cast(_SPANS)
    )


# --- candidates -------------------------------------------------------------------

# Letters and digits of names, and spelt-out signs of addresses.
_NAME = r"\p{L}\p{N}"
_AT = r"\s?[\[({]\s?(?:at|@)\s?[\])}]\s?"
_DOT = r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?"
# Bare words, which prose has as well.
_AT_WORD, _DOT_WORD = r"\x20at\x20", r"\x20dot\x20"

# High-recall generators. They overlap on purpose: the trees choose among their spans.
GENERATORS = {
    "email": rf"(?i)[{_NAME}._%+\-]{{1,64}}+(?:(?:@|{_AT})[{_NAME}\-]{{1,63}}+(?:(?:\.|{_DOT}|{_DOT_WORD})[{_NAME}\-]{{1,63}}+){{0,8}}"
    rf"|{_AT_WORD}[{_NAME}\-]{{1,63}}+(?:(?:\.|{_DOT}|{_DOT_WORD})[{_NAME}\-]{{1,63}}+){{1,8}})",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:[.][0-9]{1,4}+){2,5}",
    "card": r"(?<![\p{L}0-9])(?:[0-9]{4}(?:(?:[./_]|[\x20\-]{2,3})[0-9]{3,6}){2,4}(?![0-9])|[0-9](?:[\x20\-]?[0-9]){11,22}+)",
    "phone": r"(?:[+(]|(?<![\p{L}0-9+(]))[0-9](?:[\x20().\-]{0,2}+[0-9]){6,16}+",
}
_CONTEXT = 24
_WORDS = {
    "phone_word": r"(?i)(?:phone|tel|call|mobile|cell|fax)[^0-9+(]{0,12}$",
    "mail_word": r"(?i)(?:mail|contact|write)",
    "card_word": r"(?i)(?:card|visa|credit|account|iban)",
    "ip_word": r"(?i)(?:\bip\b|host|address|server)",
    "id_word": r"(?i)(?:\bv|version|release|build|isbn|serial|order|invoice|date|\bid|\bno)[.:#\x20]{0,3}$",
}
FEATURES = (
    "length",
    "digits",
    "letters",
    "dots",
    "dashes",
    "blanks",
    "parens",
    "ats",
    "plus_first",
    "groups",
    "longest_group",
    "shortest_group",
    "first_group",
    "last_group",
    "year",
    "spelt",
    "luhn",
    "small_parts",
    "domain",
    "letter_before",
    "digit_before",
    "letter_after",
    "digit_after",
    *_WORDS,
    *[f"as_{kind}" for kind in KINDS],
)


def _number_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _plain_address(match: Column) -> Column:
    """An address with its spelt-out signs replaced."""
    signed = F.regexp_replace(match, f"(?i){_AT}|{_AT_WORD}", "@")
    return F.regexp_replace(signed, f"(?i){_DOT}|{_DOT_WORD}", ".")


# What the rules below hold for personal data and for other numbers.
_ADDRESS = rf"^[{_NAME}][{_NAME}._%+\-]*@(?:[{_NAME}](?:[{_NAME}\-]*[{_NAME}])?\.)+\p{{L}}{{2,24}}$"
# Prefixes and lengths of card brands.
_BRANDS = (
    "^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}"
    "|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:6[0245]|35)[0-9]{14,17})$"
)
_DATE = r"^(?:[0-9]{4}([\x20./\-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([\x20./\-])[0-9]{1,2}\2[0-9]{4})(?![0-9])"
_DOTTED = r"^(?![0-9]{3}\.[0-9]{3}\.[0-9]{4}$)[0-9]+(?:\.[0-9]+)+$"
_YEAR = "^(?:19|20)[0-9]{2}$"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def rule_label(kind: Column, match: Column, before: Column, after: Column) -> Column:
    """Whether a candidate is personal data by rules that do not look at base spans.

    E-mail addresses have a valid domain, however their signs are written. Cards pass the
    Luhn check and have the prefix and length of a brand. Telephone numbers follow a
    telephone word or begin with a plus sign. Cards, versions, dates, long ids and pieces of
    longer runs are no telephone numbers. NULL where no rule decides. The rules teach the
    trees what the texts hold; they are not consulted when spans are chosen.
    """
    digits = digits_of(match)
    glued = before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]")
    numbered = before.rlike(_WORDS["id_word"])
    address = _plain_address(match)
    email = address.rlike(_ADDRESS) & ~address.contains("..")
    ip = match.rlike(_OCTETS) & ~numbered & ~after.rlike(r"^\.?[0-9]")
    checked = F.length(digits).between(12, 19) & luhn(digits)
    card = F.when(~checked | glued, False).when(digits.rlike(_BRANDS), True)
    word = before.rlike(_WORDS["phone_word"])
    wrong = (
        ~F.length(digits).between(7, 15)
        | glued
        | numbered
        | (digits.rlike(_BRANDS) & luhn(digits))
        | match.rlike(_DATE)
        | match.rlike(_OCTETS)
        | (match.rlike(_DOTTED) & ~word)
        | (match.rlike("^[0-9]+$") & ~word)
    )
    phone = F.when(wrong, False).when(
        word | (match.startswith("+") & (F.length(digits) >= 8)), True
    )
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
    )


def _variant(match: str, label: bool, before: str = "CAST(NULL AS STRING)") -> str:
    return f"named_struct('match', {match}, 'label', {str(label).lower()}, 'lead', {before})"


# How the base spans of the corpus might be written otherwise, and what looks like them but
# is something else: ``d`` are the digits, ``a b c`` the last ten of them in groups.
_WRITTEN_AS = {
    "phone": [
        _variant("m", True),
        _variant("'(' || a || ') ' || b || '-' || c", True),
        _variant("a || '-' || b || '-' || c", True),
        _variant("a || '.' || b || '.' || c", True),
        _variant("'+' || left(d, 2) || ' ' || a || ' ' || b || c", True),
        _variant("'0' || left(a, 2) || ' ' || b || ' ' || c", True),
        _variant("a || b || c", True, "'call '"),
        _variant("b || '-' || c", True, "'tel. '"),
        _variant("a || b || c", False),
        _variant("a || b || c || '7'", False, "'id '"),
        _variant("a || b || c || d", False),
        _variant("'20' || left(a, 2) || '-0' || '4' || '-1' || left(b, 1)", False),
        _variant("'1' || left(a, 1) || '.0' || '3' || '.19' || left(c, 2)", False),
        _variant("'19' || left(c, 2) || ' 1' || '1' || ' 2' || left(a, 1)", False),
        _variant("left(a, 1) || '.' || left(b, 2) || '.' || c || '.' || left(d, 3)", False),
        _variant("left(a, 2) || '.' || b || '.' || c", False, "'version '"),
        _variant("'978-' || left(a, 1) || '-' || left(b, 2) || '-' || a || b || '-' || right(c, 1)", False),
        _variant("c || '-' || c || '-' || c", False, "'order '"),
        _variant("a || '-' || b || '-' || c", False, "'invoice no. '"),
    ],
    "email": [
        _variant("m", True),
        _variant("l || ' [at] ' || h || '.' || t", True),
        _variant("l || '(at)' || h || '(dot)' || t", True),
        _variant("l || ' at ' || replace(h, '.', ' dot ') || ' dot ' || t", True),
        _variant("l || ' AT ' || h || ' DOT ' || t", True),
        _variant("l || '@' || h || ' [dot] ' || t", True),
        _variant("l || '@' || split_part(h, '.', 1)", False),
        _variant("l || '@' || h || '.' || length(l)", False),
        _variant("l || ' at ' || split_part(h, '.', 1) || '.' || length(h)", False),
        _variant("left(t, 2) || ' at ' || length(h) || '.' || length(l)", False),
        _variant("l || ' (at) ' || split_part(h, '.', 1)", False),
    ],
    "card": [
        _variant("m", True),
        _variant("regexp_replace(left(d, 16), '(....)(?!$)', '$1.')", True),
        _variant("regexp_replace(left(d, 16), '(....)(?!$)', '$1  ')", True),
        _variant("left(x, 4) || ' ' || substr(x, 5, 6) || ' ' || substr(x, 11)", True),
        _variant("left(x, 4) || '-' || substr(x, 5, 6) || '-' || substr(x, 11)", True),
        _variant("x", True),
        _variant("left(d, 15) || wrong", False),
        _variant("regexp_replace(left(d, 15) || wrong, '(....)(?!$)', '$1 ')", False),
        _variant("regexp_replace(left(d, 15) || wrong, '(....)(?!$)', '$1.')", False),
        _variant("left(x, 4) || ' ' || substr(x, 5, 6) || ' ' || left(d, 4) || wrong", False),
        _variant("d || left(d, 5)", False),
    ],
    "ip": [
        _variant("m", True),
        _variant("m || '.' || split_part(m, '.', 1)", False),
        _variant("split_part(m, '.', 1) || '.' || split_part(m, '.', 2) || '.' || split_part(m, '.', 3)", False),
        _variant("split_part(m, '.', 1) || '.' || split_part(m, '.', 2) || '.' || split_part(m, '.', 3) || '.' || (300 + length(m))", False),
        _variant("m", False, "'version '"),
    ],
}
# Written spans per kind that training starts from, and as many again for calibration.
_EXAMPLES = 400


def written_examples(found: DataFrame, examples: int = _EXAMPLES) -> DataFrame:
    """Labelled candidates made from base spans: the spans as they are and in other
    writings, and numbers and names of other meaning made from the same characters.

    Each keeps the surroundings of its span, except where a word before it belongs to it.
    At most ``examples`` spans of each kind are drawn by a hash from the texts for the
    fit, and from those held out. Labels follow from how an example is made.
    """
    rows = found.select("doc_id", "_key", F.inline("_candidates")).where("base")
    sides = rows.withColumn("_side", _held_out())
    lot = F.xxhash64(F.lit("written"), "_key", "start")
    over = Window.partitionBy("kind", "_side").orderBy(lot, "_key", "start", "doc_id")
    drawn = sides.withColumn("_place", F.row_number().over(over)).where(
        F.col("_place") <= examples
    )
    digits = digits_of(F.col("match"))
    ten = F.lpad(F.right(digits, F.lit(10)), 10, "5")
    body = F.substring(digits, 2, 14)
    check = F.aggregate(
        F.sequence(F.lit(0), F.lit(9)),
        F.lit(""),
        lambda found_, v: F.when(
            luhn(F.concat(body, v.cast("string"))), F.concat(body, v.cast("string"))
        ).otherwise(found_),
    )
    address = F.split(F.col("match"), "@")
    domain = F.element_at(address, -1)
    named = drawn.select(
        "doc_id", "_key", "kind", "start", "before", "after",
        F.col("match").alias("m"),
        digits.alias("d"),
        F.left(ten, F.lit(3)).alias("a"),
        F.substring(ten, 4, 3).alias("b"),
        F.right(ten, F.lit(4)).alias("c"),
        F.when(F.col("kind") == "card", check).otherwise("").alias("x"),
        F.pmod(F.substring(digits, 16, 1).try_cast("int") + 1, F.lit(10)).cast("string").alias("wrong"),
        address[0].alias("l"),
        F.regexp_replace(domain, r"\.[^.]*$", "").alias("h"),
        F.element_at(F.split(domain, r"\."), -1).alias("t"),
    )
    lists = F.expr(
        "CASE kind "
        + " ".join(f"WHEN '{k}' THEN array({', '.join(v)})" for k, v in _WRITTEN_AS.items())
        + " END"
    )
    made = named.select(
        "doc_id", "_key", "kind", "before", "after", "start",
        F.posexplode(lists).alias("_no", "v"),
    )
    return made.where("v.match IS NOT NULL AND v.match <> ''").select(
        "doc_id",
        "_key",
        "kind",
        (F.col("start") * 100 + F.col("_no")).cast("int").alias("start"),
        F.lit(0).alias("end"),
        F.col("v.match").alias("match"),
        F.coalesce("v.lead", "before").alias("before"),
        "after",
        (F.col("_no") == 0).alias("base"),
        F.col("v.label").alias("label"),
    )


def with_features(candidates: DataFrame) -> DataFrame:
    """Format and context features of ``kind, match, before, after``, and the rules' label."""
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    digits = digits_of(match)
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    luhn_like = F.length(digits).between(12, 23)
    values = {
        "length": F.length(match),
        "digits": F.length(digits),
        "letters": _number_of(match, r"\p{L}"),
        "dots": _number_of(match, r"[.]"),
        "dashes": _number_of(match, "-"),
        "blanks": _number_of(match, r"\s"),
        "parens": _number_of(match, "[()]"),
        "ats": _number_of(match, "@"),
        "plus_first": match.startswith("+"),
        "groups": F.size(groups),
        "longest_group": F.array_max(F.transform(groups, F.length)),
        "shortest_group": F.array_min(F.transform(groups, F.length)),
        "first_group": F.length(F.get(groups, F.lit(0))),
        "last_group": F.length(F.try_element_at(groups, F.lit(-1))),
        "year": F.exists(groups, lambda g: g.rlike(_YEAR)),
        "spelt": _number_of(match, f"(?i){_AT}|{_AT_WORD}|{_DOT}|{_DOT_WORD}"),
        "luhn": F.when(luhn_like, luhn(digits)).otherwise(False),
        "small_parts": F.forall(groups, lambda g: g.cast("double") <= 255),
        "domain": _plain_address(match).rlike(rf"@[{_NAME}\-]+(?:\.[{_NAME}\-]+)*\.\p{{L}}{{2,}}$"),
        "letter_before": before.rlike(r"\p{L}$"),
        "digit_before": before.rlike("[0-9]$"),
        "letter_after": after.rlike(r"^\p{L}"),
        "digit_after": after.rlike("^[0-9]"),
    }
    values |= {name: before.rlike(pattern) for name, pattern in _WORDS.items()}
    values |= {f"as_{kind}": F.col("kind") == kind for kind in KINDS}
    return candidates.withColumns(
        {name: F.coalesce(values[name].cast("double"), F.lit(0.0)) for name in FEATURES}
    ).withColumn("label", rule_label(F.col("kind"), match, before, after))


_CANDIDATES = (
    "array<struct<kind:string,start:int,end:int,match:string,before:string,after:string,"
    "base:boolean>>"
)


# Steps of a search in a rising list of up to twice as many numbers as the first.
_STEPS = [1 << k for k in range(22, -1, -1)]


def _among(value: Column, rising: Column) -> Column:
    """Whether a number is in a rising list: by looking at all of a short one, by halving a
    long one."""

    def step(at: Column, size: Column) -> Column:
        below = F.get(rising, at + size - 1) < value
        return F.when(below, at + size).otherwise(at)

    steps = F.array(*[F.lit(size) for size in _STEPS])
    at = F.aggregate(steps, F.lit(0), step)
    halved = F.coalesce(F.get(rising, at) == value, F.lit(False))
    return F.when(F.size(rising) <= 16, F.exists(rising, lambda v: v == value)).otherwise(halved)


def _candidate_list(text: Column, kind: str, base: Column) -> Column:
    """Candidates of one generator, with their surroundings and whether a base span is
    exactly there.

    The surroundings reach back to the match before the last, at most, and as far ahead.
    """
    hint = {"email": rf"(?i)@|{_AT}|{_AT_WORD}"}.get(kind, "[0-9][^\\p{L}]{5}")

    def near(values: Column, i: Column) -> Column:
        return F.coalesce(F.when(i >= 0, F.get(values, i)), F.lit(""))

    def span(row: Column, match: Column, i: Column) -> Column:
        start = row["at"][i] + F.length(row["g"][i])
        before = F.concat(near(row["g"], i - 1), near(row["f"], i - 1), row["g"][i])
        after = F.concat(near(row["g"], i + 1), near(row["f"], i + 1), near(row["g"], i + 2))
        return F.struct(
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            match.alias("match"),
            F.right(before, F.lit(_CONTEXT)).alias("before"),
            F.left(after, F.lit(_CONTEXT)).alias("after"),
        )

    def number(span_: Column) -> Column:
        return F.shiftleft(span_["start"].cast("long"), 31) + span_["end"]

    def described(found: Column, is_base: Column) -> Column:
        return F.transform(
            found,
            lambda c: F.struct(
                F.lit(kind).alias("kind"),
                c["start"].alias("start"),
                c["end"].alias("end"),
                c["match"].alias("match"),
                c["before"].alias("before"),
                c["after"].alias("after"),
                is_base(c).alias("base"),
            ),
        )

    def flagged(found: Column) -> Column:
        return _let(
            F.struct(found.alias("c"), F.transform(base, number).alias("k")),
            lambda row: described(row["c"], lambda c: _among(number(c), row["k"])),
        )

    found = F.when(text.rlike(hint), _placed(text, GENERATORS[kind], span))
    listed = F.when(found.isNotNull(), _let(found, flagged))
    return F.coalesce(listed.cast(_CANDIDATES), F.array().cast(_CANDIDATES))


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, _key``, the base spans and the candidates.

    The only pass over the texts. Stored, because training and scoring both read it.
    """
    filled = docs.select(
        "doc_id",
        text_key(F.col("text")).alias("_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    based = filled.withColumns({f"_{kind}": base_spans(F.col("text"), kind) for kind in KINDS})
    lists = [_candidate_list(F.col("text"), kind, F.col(f"_{kind}")) for kind in KINDS]
    return materialise(
        based.select(
            "doc_id",
            "_key",
            *[f"_{kind}" for kind in KINDS],
            F.concat(*lists).alias("_candidates"),
            F.regexp_count("text", F.lit(SECRET)).cast("long").alias("secrets"),
        ),
        "spans",
    )


# --- model ------------------------------------------------------------------------


def _held_out() -> Column:
    """A quarter of the texts, which the fit does not see. Equal texts stay together."""
    return F.pmod(F.xxhash64(F.lit("held out"), "_key"), F.lit(4)) == 0


def _shares(counts: list[int], total: int) -> list[float]:
    """The share to draw of each group, so that small groups are kept and large ones equal."""
    shares, left = [1.0] * len(counts), total
    for done, i in enumerate(sorted(range(len(counts)), key=counts.__getitem__)):
        taken = min(counts[i], left / (len(counts) - done))
        shares[i], left = taken / counts[i], left - taken
    return shares


def fit_model(
    candidates: DataFrame, sample_rows: int = 20_000, trees: int = 16, depth: int = 5, seed: int = 7
) -> GBTClassificationModel | None:
    """Boosted trees on at most ``sample_rows`` rows of labelled candidates, drawn by a hash
    outside the held-out texts; each candidate gives two rows.

    Kinds, labels, and base spans and others are drawn alike as far as there are enough.
    None when the sample lacks one of the two labels, in which case nothing is added.
    """
    labelled = candidates.where(F.col("label").isNotNull() & ~_held_out())
    group = ["kind", "label", "base"]
    counts = labelled.groupBy(*group).count().collect()  # 16 rows at most
    if len({row["label"] for row in counts}) < 2:
        return None
    place = ("_key", "start", "end", "kind")
    share = F.lit(0.0)
    for row, part in zip(counts, _shares([row["count"] for row in counts], sample_rows // 2)):
        same = [F.col(name) == F.lit(row[name]) for name in group]
        share = F.when(same[0] & same[1] & same[2], part).otherwise(share)
    lot = F.pmod(F.xxhash64(F.lit("lot"), *place), F.lit(1_000_000)) / 1_000_000
    drawn = materialise(
        labelled.where(lot < share)
        .orderBy(F.xxhash64(F.lit(seed), *place))
        .limit(sample_rows // 2)
        .withColumn("label", F.col("label").cast("double")),
        "sample",
    )
    if drawn.select("label").distinct().count() < 2:
        return None
    rows = _assembled(drawn)
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32).fit(rows)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def calibrated_thresholds(scored: DataFrame, precision: float) -> dict[str, float]:
    """Per kind the lowest score, to a hundredth, from which on ``precision`` of the labelled
    rows are personal data, and ``precision`` of those that are no base spans as well.

    A kind that never gets there is left out.
    """
    new = ~F.col("base")
    bins = (
        scored.groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.count_if("label").alias("good"),
            F.count_if(new).alias("n_new"),
            F.count_if(new & F.col("label")).alias("good_new"),
        )
        .orderBy(F.desc("bin"))
        .collect()  # 404 rows at most
    )
    thresholds = {}
    for kind in KINDS:
        n = good = n_new = good_new = 0
        for row in (row for row in bins if row["kind"] == kind):
            n, good = n + row["n"], good + row["good"]
            n_new, good_new = n_new + row["n_new"], good_new + row["good_new"]
            if good >= precision * n and good_new >= precision * n_new:
                thresholds[kind] = row["bin"] / 100
    return thresholds


def added_spans(
    found: DataFrame, precision: float = 0.99, sample_rows: int = 20_000
) -> DataFrame | None:
    """``doc_id, _key, added``: the spans that the trees choose beside the base ones."""
    place = ["doc_id", "_key", "kind", "start", "end", "base"]
    given = with_features(found.select("doc_id", "_key", F.inline("_candidates")))
    rows = materialise(given.select(*place, "label", *FEATURES), "candidates")
    examples = written_examples(found).withColumnRenamed("label", "_made")
    written = with_features(examples).withColumn("label", F.col("_made"))
    labelled = materialise(
        written.select(*place, "label", *FEATURES).unionByName(rows.where("label IS NOT NULL")),
        "labelled",
    )
    model = fit_model(labelled, sample_rows)
    if model is None:
        return None

    def scored(candidates: DataFrame, *columns: str) -> DataFrame:
        return model.transform(_assembled(candidates)).select(
            *place, *columns, vector_to_array("probability")[1].alias("score")
        )

    thresholds = calibrated_thresholds(scored(labelled.where(_held_out()), "label"), precision)
    enough = F.lit(False)
    for kind, threshold in thresholds.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("score") >= threshold))
    chosen = scored(rows.where(~F.col("base"))).where(enough)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return chosen.groupBy("doc_id", "_key").agg(
        F.collect_set(F.struct(order.alias("rank"), "start", "end")).alias("added")
    )


def _written(spans_: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans_),
            lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"]), s["start"], s["end"]),
        ),
        ",",
    )


def _ranked(spans_: str, rank: int) -> Column:
    return F.transform(
        spans_,
        lambda s: F.struct(
            F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end")
        ),
    )


def _count_of(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def find_pii(
    docs: DataFrame,
    precision: float = 0.99,
    sample_rows: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Spans of e-mail addresses, IP addresses, card and phone numbers in every text.

    Base spans are the leftmost non-overlapping matches of each pattern that pass their
    check. Generators with looser patterns propose more spans, overlapping ones too. Boosted
    trees learn, by the form of a span and the characters around it, to tell personal data
    from other numbers and handles. They are taught by examples made from the base spans, in
    other writings and turned into something else (``written_examples``), and by candidates
    of the texts that rules are sure of (``rule_label``). ``sample_rows`` bounds the training rows. A threshold per
    kind is calibrated on a quarter of the texts that the fit does not see: the lowest one
    that keeps the share ``precision`` of the labelled candidates above it right, and of
    those beside the base spans too. Every candidate above it is added; base spans stay.

    Returns ``doc_id, _key, base, all, secrets``: ``_key`` a hash of the text, two lists of
    ``rank, start, end`` (rank in ``KINDS`` from 1, code points, end exclusive), and the number
    of credentials given by name, such as ``token = "..."``. A null text
    is an empty one and holds nothing. Rows equal in id and text are answered alike. Without
    examples of both labels nothing is added. No rows in, no rows out.
    """
    found = find_spans(texts(docs, id_column, text_column))
    added = added_spans(found, precision, sample_rows)
    ranked = F.concat(*[_ranked(f"_{kind}", rank) for rank, kind in enumerate(KINDS, 1)])
    base = found.select("doc_id", "_key", "secrets", ranked.alias("base"))
    if added is None:
        return base.select("doc_id", "_key", "base", F.col("base").alias("all"), "secrets")
    added = added.withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    return base.join(added, hit, "left").select(
        "doc_id",
        "_key",
        "base",
        F.when(F.col("added").isNull(), F.col("base"))
        .otherwise(F.array_union("base", "added"))
        .alias("all"),
        "secrets",
    )


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts, checksum and text form of ``find_pii`` rows."""
    counts = [_count_of(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS, 1)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("all")).alias("spans"),
        "secrets",
        (F.size("all") + F.col("secrets")).alias("n_found"),
    )


def redact(docs: DataFrame, found: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span of ``found`` replaced, one row per row given.

    Rows are joined by id and text. Overlapping spans are masked as one, named after the
    first of them.
    """
    names = F.array(*[F.lit(mask.format(k.upper())) for k in KINDS])
    by_start = F.array_sort(
        F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))
    )
    state = "struct<at:int,out:string>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.element_at(names, s["rank"])))
            .otherwise(acc["out"])
            .alias("out"),
        ).cast(state)

    masked = F.aggregate(
        by_start,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state),
        step,
        lambda acc: F.concat(
            acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))
        ),
    )
    spans_ = found.dropDuplicates(["doc_id", "_key"]).select(
        F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "all"
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_k"))
    return docs.join(spans_, same, "left").withColumn(
        "text", F.when(F.size("all") > 0, masked).otherwise(F.col("text"))
    ).drop("_id", "_k", "all")
