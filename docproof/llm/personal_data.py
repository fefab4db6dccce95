r"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Fixed patterns give the base spans (email, ip, card, phone), which stay whatever the method says. A broad scan gives
candidates: whatever has a digit, groups of digits, and addresses spelt with "at" and "dot". Labelers (formats, check
digits, gazetteers, words around) each vote for, against, or not at all. Only the counts of vote patterns matter for
expectation-maximisation: one row for each kind and pattern, at most 3**8 for each kind at any input size, on which
it runs as one aggregate expression. It estimates for each labeler how often it votes so on personal data and on other
candidates. Its posteriors are soft labels for the final classifier, a naive Bayes model over hashed features of
spans (shape, length, words around): sums by feature over all candidates, ``FEATURES`` rows at any input size. The
classifier adds the spans that it holds for personal data and that meet no base span.

Everything is DataFrame functions. Places come from the lengths of what lies between matches. Patterns are written
so that a text is passed once: they begin where a run of their characters begins and never give back characters.

Defined cases: null and empty texts have no spans; texts of any length are whole, places count code points; equal
rows give equal rows and each counts in the model; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.llm.common import stored
from docproof.llm.quality import _let

#: Fixed values of the contract. The email pattern is written to begin where its run of characters begins, or where the match before ended.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Kinds that the method adds, in the order of spans that begin together; candidates of the kind other are never spans.
MORE = ("secret", "account", "id")
ALL = (*KINDS, *MORE, "other")
_TOKEN = "A-Za-z0-9_+/.@%-"
#: Addresses in words.
SPELT = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\bat\b)\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\bdot\b)\x20?[A-Za-z0-9-]++)++"
#: Gazetteers: endings of domains, first digits of cards, calling codes, beginnings of keys.
DOMAINS = r"(?i)(?:\.|dot\)?\]?\x20?)(?:com|org|net|edu|gov|io|co|info|biz|de|fr|es|it|uk|us|eu|ch|at|nl|be|pl|ru|cn|jp|br|in|ca|au|mx)\.?\z"
ISSUERS, CALLING = r"\A(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)", r"\A\+(?:1|7|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_KEYS = "AKIA|ASIA|gh[po]_|github_pat_|glpat-|sk[-_]|pk_|xox[abp]-|AIza|ya29|eyJ"
KEYS = rf"\A(?:{_KEYS})"
#: Beginnings of keys with what follows, groups of digits, else a run of characters with a digit; and what is assigned to a secret's name without any.
NUMBERS = rf"(?<![{_TOKEN}])(?:{_KEYS})[A-Za-z0-9_-]{{12,}}+|(?<![A-Za-z0-9_.@])[+(]{{0,2}}[0-9]++(?:[\x20().-]{{1,2}}[0-9]++)++(?![A-Za-z_@])|(?<![{_TOKEN}])[A-Za-z_+/.@%-]*+[0-9][{_TOKEN}]*+"
_NAMED = r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?"
ASSIGNED = rf"{_NAMED}(?![^\s\"']*[0-9])[{_TOKEN}]{{8,}}+"
#: Words before a span that speak for its kind, and for none; the latter may follow it too.
WORDS = {
    "email": "e-?mails?|mail|contact|write|reach", "ip": "ip|host|server|address|gateway", "card": "card|visa|mastercard|amex|credit|debit|payment|pan", "phone": "phones?|tel|telephone|call|fax|mobile|cell|whatsapp|dial",
    "secret": "tokens?|passwords?|passwd|pwd|secret|api[_ -]?key|access[_ -]?key|key|credentials?|auth|bearer", "account": "iban|account|acct|konto|compte|cuenta", "id": "ssn|social security|passport|national id|tax id",
}
OTHERWISE = r"(?i)(?:\b(?:version|v|section|chapter|page|figure|table|isbn|issn|doi|vol|release|article|rfc|iso|copyright|license|in|of|since|until|year)\.?|[§$€£#©])\s*\z"
UNITS = r"(?i)\A\s*(?:%|€|\$|kg|g|cm|mm|km|m|mb|gb|kb|years?|percent|times|pages)\b"
LABELERS = ("format", "check", "gazetteer", "words_for", "words_against", "borders", "variety", "assigned")
#: Rounds of expectation-maximisation; pseudo-counts of votes in agreement with the class, and of others, which keep the classes from trading places.
ROUNDS, AGREE, OTHER = 40, 12.0, 2.0
#: Hashed features, and the least probability of an added span.
FEATURES, LEAST = 4096, 0.9
#: Values that one step of a running sum goes through.
STEP = 256


def _running(values: Column, op: Callable[[Column, Column], Column], start: int) -> Column:
    """Running results of ``op``, each including its own value; in steps, so that arrays are copied sqrt-wise and not for each value."""

    def scanned(part: Column) -> Column:
        begin = F.struct(F.lit(start).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        done = F.aggregate(part, begin, lambda z, v: F.struct(op(z.s, v).alias("s"), F.array_append(z.a, op(z.s, v)).alias("a")))
        return done.a

    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(STEP)), lambda i: scanned(F.slice(values, i, STEP)))

    def joined(p: Column) -> Column:
        lasts = scanned(F.transform(p, lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(start).cast("bigint"))))
        return F.flatten(F.transform(p, lambda a, i: F.when(i == 0, a).otherwise(F.transform(a, lambda v: op(F.get(lasts, i - 1), v)))))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_let(parts, joined))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, value, left, right), the text between it and its neighbours last."""

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            wide = F.transform(found, lambda v, i: (F.length(F.get(gaps, i)) + F.length(v)).cast("bigint"))
            ends = _running(wide, lambda s, v: s + v, 0)
            return _let(ends, lambda e: F.transform(found, lambda v, i: F.struct((F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value"), F.get(gaps, i).alias("left"), F.get(gaps, i + 1).alias("right"))))

        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), with_gaps))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""

    def weight(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    places = F.transform(F.split(F.reverse(digits), ""), weight)
    return F.aggregate(places, F.lit(0), lambda s, n: s + F.coalesce(n, F.lit(0))) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    return value.rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|\z)){4}(?<!\.)\z")


def _is_card(value: Column) -> Column:
    return F.when(F.length(_digits(value)).between(14, 19), luhn(_digits(value))).otherwise(False)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


_VALID = {"email": lambda v: F.lit(True), "ip": _octets, "card": _is_card, "phone": _is_phone}
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def base_spans(text: Column) -> Column:
    """The base spans of a text, in order, as (start, kind's place in ``ALL``, end)."""

    def of(kind: str) -> Column:
        found = F.filter(matches(text, BASE[kind]), lambda m: _VALID[kind](m.value))
        spans = F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(ALL.index(kind)).alias("kind"), m.end.alias("end"))).cast(_SPAN)
        tried = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        return F.coalesce(F.when(tried, spans), F.array().cast(_SPAN))

    with_digits = F.when(text.rlike("[0-9]"), F.concat(of("ip"), of("card"), of("phone"))).otherwise(F.array().cast(_SPAN))
    return F.array_sort(F.concat(of("email"), with_digits))


def _remainder(value: Column) -> Column:
    """Whether an account number, its first four characters last and letters as 10 to 35, leaves 1 when divided by 97."""
    places = F.split(F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4)), "")

    def step(s: Column, c: Column) -> Column:
        digit = c.try_cast("int")
        return F.when(c == "", s).when(digit.isNotNull(), (s * 10 + digit) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(places, F.lit(0), step) == 1


def _kind(value: Column, left: Column) -> Column:
    """A number that fails the check of a kind (card, account, address) is none of that kind."""
    digits = F.length(_digits(value))
    number = value.rlike(r"\A[+(]*[0-9][0-9\x20().-]*\z")
    assigned = left.rlike(r"[=:]\s*[\"']?\z")
    mixed = value.rlike("[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|" + KEYS)
    name = (
        F.when(value.rlike(r"(?i)\A[a-z0-9._%+-]+(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[a-z0-9-]+"), "email")
        .when(_octets(value), "ip")
        .when(value.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "id")
        .when(number & ~value.startswith("+") & _is_card(value), "card")
        .when(number & ~value.rlike(r"\A[0-9]+\.[0-9.]*\z") & digits.between(10, 15), "phone")
        .when(value.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & _remainder(value), "account")
        .when(value.rlike(rf"\A[{_TOKEN}]+\z") & ((mixed & (F.length(value) >= 16)) | (assigned & (F.length(value) >= 8))), "secret")
        .otherwise("other")
    )
    return F.array_position(F.array(*map(F.lit, ALL)), name).cast("int") - 1


def _votes(m: Column, kind: Column) -> Column:
    """0 against, 1 no vote, 2 for: one for each labeler."""
    value, digits = m.value, _digits(m.value)

    def by_kind(cases: dict[str, Column], otherwise: Column) -> Column:
        return reduce(lambda c, k: c.when(kind == ALL.index(k), cases[k]), [k for k in list(cases)[1:]], F.when(kind == ALL.index(next(iter(cases))), cases[next(iter(cases))])).otherwise(otherwise)

    def vote(yes: Column, no: Column | None = None) -> Column:
        return F.when(F.coalesce(yes, F.lit(False)), 2).when(F.lit(True) if no is None else F.coalesce(no, F.lit(False)), 0).otherwise(1)

    never, no_vote = F.lit(False), F.lit(1)
    form = by_kind({
        "email": vote(value.rlike(r"\A[^@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\z"), never), "ip": vote(F.lit(True)), "card": vote(value.rlike(r"\A[0-9]{14,19}\z|\A[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-]?[0-9]{1,3})?\z")),
        "phone": vote(value.rlike(r"\A\+[0-9]{1,3}[\x20.(-]|\A\(?[0-9]{3}\)?[\x20.-]+[0-9]{3}[\x20.-][0-9]{4}\z")), "secret": vote(value.rlike(r"\A(?:AKIA|ASIA)[0-9A-Z]{16}\z|\A(?:[0-9a-f]{2}){8,}\z|\A[A-Za-z0-9_+/-]{20,}\z"), value.rlike(r"[./].*[./]|[a-z]{12}")),
        "account": vote(F.lit(True)), "id": vote(~value.rlike(r"\A(?:000|666|9)|-00-|-0000\z")),
    }, vote(never))
    check = by_kind({"card": vote(F.lit(True)), "account": vote(F.lit(True)), "phone": vote(_is_phone(value)), "secret": vote(value.rlike(KEYS) | ((F.length(digits) >= 4) & (F.length(value) - F.length(digits) >= 4)), never), "other": vote(never, F.length(value) < 8)}, no_vote)
    known = by_kind({"email": vote(value.rlike(DOMAINS), never), "card": vote(value.rlike(ISSUERS)), "phone": vote(value.rlike(CALLING), ~value.startswith("+") & ~value.rlike(r"\A\(?[2-9]")), "secret": vote(value.rlike(KEYS), never)}, no_vote)
    near = by_kind({k: vote(m.left.rlike(rf"(?i)\b(?:{w})\b[^.!?\n]{{0,24}}\z"), never) for k, w in WORDS.items()}, no_vote)
    strange = vote(never, m.left.rlike(OTHERWISE) | m.right.rlike(UNITS))
    borders = vote(never, m.left.rlike(r"[\p{L}_]\z") | m.right.rlike(r"\A[\p{L}_]"))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    variety = vote(distinct >= 8, distinct <= 4)
    assigned = vote(m.left.rlike(r"[=:]\s*[\"']?\z"), never)
    return F.array(form, check, known, near, strange, borders, variety, assigned)


def _shape(value: Column) -> Column:
    short = F.substring(value, 1, 64)
    for pattern, to in (("[0-9]+", "9"), (r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), ("(?:9a|a9){2,}[9a]?", "x"), ("(?:9A|A9){2,}[9A]?", "X")):
        short = F.regexp_replace(short, pattern, to)
    return short


def _features(m: Column, kind: Column) -> Column:
    """Places of a candidate's features in the classifier's table."""
    before = F.lower(F.regexp_extract(m.left, r"(\p{L}*)[^\p{L}]{0,4}\z", 1))
    behind = F.lower(F.regexp_extract(m.right, r"\A[^\p{L}]{0,4}(\p{L}*)", 1))
    size = F.floor(F.log2(F.length(m.value) + 1) * 2).cast("string")
    told = {"kind": F.lit(""), "shape": _shape(m.value), "size": size, "before": F.when(F.length(before) > 1, before), "behind": F.when(F.length(behind) > 1, behind), "edge": F.concat(F.substring(m.left, -2, 2), F.lit("|"), F.substring(m.right, 1, 1)), "digits": F.floor(10 * F.length(_digits(m.value)) / F.length(m.value)).cast("string")}
    each = F.array_compact(F.array(*(F.when(v.isNotNull(), F.pmod(F.xxhash64(F.lit(n), kind, v), F.lit(FEATURES)).cast("int")) for n, v in told.items())))
    return F.array_distinct(each)


_CANDIDATE = "array<struct<start:bigint,kind:int,end:bigint,votes:array<int>,features:array<int>>>"


def candidates(text: Column) -> Column:
    """Candidates of a text, in order within each scan: (start, kind, end, votes, features)."""

    def judged(found: Column) -> Column:
        near = F.transform(found, lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), m.value.alias("value"), F.substring(m.left, -40, 40).alias("left"), F.substring(m.right, 1, 16).alias("right")))
        kinds = F.transform(near, lambda m: F.struct(m.alias("m"), _kind(m.value, m.left).alias("kind")))
        return F.transform(kinds, lambda c: F.struct(c.m.start.alias("start"), c.kind.alias("kind"), c.m.end.alias("end"), _votes(c.m, c.kind).alias("votes"), _features(c.m, c.kind).alias("features"))).cast(_CANDIDATE)

    none = F.array().cast(_CANDIDATE)
    def behind_name(m: Column) -> Column:
        value = F.regexp_replace(m.value, _NAMED, "")
        return F.struct((m.end - F.length(value)).alias("start"), m.end.alias("end"), value.alias("value"), F.regexp_extract(m.value, _NAMED, 0).alias("left"), m.right.alias("right"))

    numbers = F.when(text.rlike(f"[0-9]|{_KEYS}"), judged(matches(text, NUMBERS)))
    spelt = F.when(text.rlike(r"(?i)\bdot\b"), judged(matches(text, SPELT)))
    named = F.when(text.rlike(_NAMED), judged(F.transform(matches(text, ASSIGNED), behind_name)))
    return F.concat(*(F.coalesce(c, none) for c in (numbers, spelt, named)))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, candidates) of every document, stored: texts are read once."""
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    return stored(source.select(id_col, base_spans(F.col("_t")).alias("base"), candidates(F.col("_t")).alias("candidates")), "personal")


def vote_patterns(found: DataFrame) -> DataFrame:
    """(kind, votes, n): how many candidates of a kind got which votes."""
    return found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").cast("double").alias("n"))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """One row: patterns(kind, votes, n, p) with the posterior p of personal data; agree and disagree, each labeler's shares of votes (0, 1, 2) on either class."""
    size = len(LABELERS)
    pattern = F.struct("kind", "votes", "n")
    rows = patterns.agg(F.array_sort(F.collect_list(pattern)).alias("ps"))
    #: The votes alone decide at the start.
    balance = lambda p: F.aggregate(p.votes, F.lit(0.0), lambda s, v: s + v.cast("double") - 1)
    begin = F.transform("ps", lambda p: 1 / (1 + F.exp(-2 * balance(p))))

    def pseudo(labeler: int, vote: int, own: bool) -> float:
        return AGREE if vote == (2 if own else 0) else OTHER

    def shares(z: Column, own: bool) -> Column:
        """Per labeler and vote the share of a class; z has n and r."""
        weight = (lambda p: p.n * p.r) if own else (lambda p: p.n * (1 - p.r))
        total = F.aggregate(z, F.lit(0.0), lambda s, p: s + weight(p))

        def cell(k: int, v: int) -> Column:
            return F.aggregate(z, F.lit(pseudo(k, v, own)), lambda s, p: s + F.when(F.get(p.votes, F.lit(k)) == v, weight(p)).otherwise(0.0))

        cells = F.array(*(F.array(*(cell(k, v) for v in range(3))) for k in range(size)))
        return F.transform(cells, lambda row: F.transform(row, lambda c: c / (total + AGREE + 2 * OTHER)))

    def priors(z: Column) -> Column:
        def of(k: int) -> Column:
            own = lambda value: F.aggregate(z, F.lit(0.0), lambda s, p: s + F.when(p.kind == k, value(p)).otherwise(0.0))
            return (own(lambda p: p.n * p.r) + 1) / (own(lambda p: p.n) + 2)

        return F.array(*(of(k) for k in range(len(ALL))))

    def model(r: Column) -> Column:
        z = F.zip_with("ps", r, lambda p, x: F.struct(p.kind.alias("kind"), p.votes.alias("votes"), p.n.alias("n"), x.alias("r")))
        return _let(z, lambda y: F.struct(shares(y, True).alias("agree"), shares(y, False).alias("disagree"), priors(y).alias("priors")))

    def posterior(m: Column) -> Column:
        def odds(p: Column) -> Column:
            prior = F.get(m.priors, p.kind)
            said = F.transform(p.votes, lambda v, k: F.log(F.get(F.get(m.agree, k), v) / F.get(F.get(m.disagree, k), v)))
            return F.aggregate(said, F.log(prior / (1 - prior)), lambda s, v: s + v)

        return F.transform("ps", lambda p: 1 / (1 + F.exp(-odds(p))))

    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, lambda r, _: _let(model(r), posterior))
    fitted = rows.select("ps", rounds.alias("r")).select("ps", "r", model(F.col("r")).alias("m"))
    judged = F.zip_with("ps", "r", lambda p, x: F.struct(p.kind.alias("kind"), p.votes.alias("votes"), p.n.alias("n"), x.alias("p")))
    return fitted.select(judged.alias("patterns"), "m.agree", "m.disagree", "m.priors")


def classifier(found: DataFrame, model: DataFrame) -> DataFrame:
    """One row: bias, and weights, the log odds of each feature, from all candidates under the posteriors of ``reliabilities``."""
    posteriors = model.select(F.explode("patterns").alias("q")).select("q.kind", "q.votes", "q.p")  # at most len(ALL) * 3**len(LABELERS) rows
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    counted = each.select("kind", "votes", F.explode("features").alias("f")).groupBy("kind", "votes", "f").count()
    soft = counted.join(F.broadcast(posteriors), ["kind", "votes"])
    sums = soft.groupBy("f").agg(F.sum(F.col("count") * F.col("p")).alias("yes"), F.sum(F.col("count") * (1 - F.col("p"))).alias("no"))
    table = sums.agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("yes", "no")))).alias("t"))  # FEATURES entries at most
    totals = model.select(F.aggregate("patterns", F.lit(1.0), lambda s, q: s + q.n * q.p), F.aggregate("patterns", F.lit(1.0), lambda s, q: s + q.n * (1 - q.p)))
    yes, no = totals.first()

    def weight(f: Column) -> Column:
        s = F.try_element_at("t", f)
        return F.coalesce(F.log(((s.yes + 1) / (yes + 2)) / ((s.no + 1) / (no + 2))), F.lit(0.0))

    return table.select(F.lit(math.log(yes / no)).alias("bias"), F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), weight).alias("weights"))


def _free_of(spans: Column, base: Column) -> Column:
    """The spans that meet no base span; both are arrays of (start, kind, end). A running maximum over both in order of their starts."""
    both = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b.start.alias("start"), F.lit(-1).alias("kind"), b.end.alias("end"))), spans))

    def kept(all_: Column) -> Column:
        reach = _running(F.transform(all_, lambda s: F.when(s.kind < 0, s.end).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        #: The first start of a base span from here on, as a maximum of negatives from the end.
        ahead = F.reverse(_running(F.reverse(F.transform(all_, lambda s: F.when(s.kind < 0, -s.start).otherwise(-(1 << 62)))), lambda a, b: F.greatest(a, b), -(1 << 62)))
        return _let(F.struct(reach.alias("r"), ahead.alias("a")), lambda w: F.array_compact(F.transform(all_, lambda s, i: F.when((s.kind >= 0) & (F.get(w.r, i) <= s.start) & (-F.get(w.a, i) >= s.end), s))))

    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(_let(both, kept))


def added_spans(trained: DataFrame) -> Column:
    """From columns base and candidates: the spans that the classifier, one row of ``FEATURES`` numbers, adds."""
    bias, known = trained.select("bias", "weights").first()
    weights = F.split(F.lit(",".join(map(repr, known))), ",").cast("array<double>")

    def chosen(w: Column) -> Column:
        likely = F.filter("candidates", lambda c: (c.kind != ALL.index("other")) & (F.aggregate(c.features, F.lit(bias), lambda s, f: s + F.get(w, f)) >= math.log(LEAST / (1 - LEAST))))
        return F.transform(likely, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"))).cast(_SPAN)

    return _let(weights, lambda w: _let(chosen(w), lambda spans: _free_of(spans, F.col("base"))))


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, base and added, arrays of (start, kind, end); kinds are places in ``ALL``."""
    found = scanned(docs, id_col, text_col)
    model = stored(reliabilities(vote_patterns(found)), "reliabilities")
    trained = stored(classifier(found, model), "classifier")
    return found.select(id_col, "base", added_spans(trained).alias("added"))


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    done = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == ALL.index(kind))).cast("bigint").alias(f"n_{kind}")

    return done.select("doc_id", *map(counted, KINDS), F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"), _said(F.array_sort(F.concat("base", "added"))).alias("spans"))
