"""Personal data in texts by weak supervision, in DataFrame functions only.

Strict patterns give base spans. Looser patterns give further candidates. Labelers vote for,
against or abstain on every span: its own pattern's strictness, gazetteers (top-level domains,
dialling codes, issuer digits, secret names), the words before it, its neighbours, and the
variety of its characters. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is, and a logistic span classifier over votes and traits of the spans is
trained on the posteriors.
Candidates that it accepts and that overlap no base span are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import materialise, text_of, under_plain_names, with_row_key

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
N_BASE = 4

# The contract's patterns, with possessive quantifiers and look-behinds that leave
# the matches as they are but never try one run of characters twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Looser patterns: (kind, pattern, what a text must contain to be searched). Names, labels and secrets may be of any
# length; a domain has at most the 127 labels that the domain system allows, an IBAN the 34 characters of its standard.
LOOSE = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]++){1,126}", r"(?i)[\[(]\x20?at\x20?[\])]"),
    ("phone", r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("secret", r"(?i)(?<![a-z0-9_])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20?[=:]\x20?\x22[^\x22\s]{8,}+\x22", r"[=:]\x20?\x22"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
)

# Gazetteers and context words.
TOP_DOMAINS = "com|org|net|edu|gov|int|io|info|de|fr|es|uk|it|nl|eu|ch|at|be|ca|us|au|jp|br|in"
DIALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|52|54|55|61|62|64|65|81|82|86|90|91"
IBAN_COUNTRIES = "AT|BE|CH|DE|DK|ES|FI|FR|GB|GR|IE|IT|LU|NL|NO|PL|PT|SE"
NEARBY = {
    "email": "mail|contact|write|reach|courriel|correo|kontakt",
    "ip": r"\bip\b|address|host|server|login|adresse",
    "card": "card|visa|credit|debit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|anruf|llam",
    "secret": "config|login|auth|credential|export|key",
    "ssn": "ssn|social|security",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
ELSEWHERE = "version|release|isbn|issn|order|invoice|serial|build|figure|section|chapter"

LABELERS = ("strict", "gazetteer", "context", "neighbours", "variety")
#: What the span classifier sees beside the votes, and how many values each has.
TRAITS = {"size": 5, "figures": 4, "lead": 3}
WINDOW = 40

FIELDS = ("kind", "start", "end", *LABELERS, *TRAITS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, first: Column, add: Callable[[Column, Column], Column], size: int = 128) -> Column:
    """For each value the combination of ``first`` and all values before it; ``add`` must be associative.

    Runs of ``size`` values are combined first and then the runs, so the work is linear in the
    number of values up to many millions.
    """

    def within(run: Column) -> Column:
        return F.aggregate(run, F.struct(first.alias("all"), F.slice(F.array(first), 1, 0).alias("before")), lambda a, x: F.struct(add(a["all"], x).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before")))

    def joined(runs: Column) -> Column:
        starts = within(F.transform(runs, lambda r: r["all"]))["before"]
        return F.flatten(F.zip_with(runs, starts, lambda r, s: F.transform(r["before"], lambda x: add(s, x))))

    n = F.size(values)
    places = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    some = _let(values, lambda v: _let(F.transform(places, lambda i: within(F.slice(v, i * size + 1, F.lit(size)))), joined))
    return F.when(n > 0, some).otherwise(F.slice(F.array(first), 1, 0))


def _placed(steps: Column) -> Column:
    """Places, in code points, end exclusive, of matches given as (gap before, length, value); the last step has no value."""
    before = _running(F.transform(steps, lambda x: x["gap"] + F.coalesce(x["length"], F.lit(0))), F.lit(0), lambda a, x: a + x)
    return F.zip_with(steps, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["length"]).alias("end"), x["value"].alias("value")))


def _matches(text: Column, pattern: str, needs: Column) -> Column:
    """Steps of ``_placed``: the parts between matches and the matches are cut by the same search, so sums of their lengths are places."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, found, lambda gap, value: F.struct(gap.alias("gap"), F.length(value).alias("length"), value.alias("value")))
    return F.when(needs, steps).otherwise(F.array().cast("array<struct<gap:int,length:int,value:string>>"))


#: Code points of the pieces that texts with spans are cut into, so a place is reached without counting from the start.
PIECE = 256


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text between two places."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((end - 1) / PIECE).cast("int")
    return F.when(end > start, F.substring(F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(pieces, i)), ""), start - first * PIECE + 1, end - start)).otherwise("")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def all_spans(text: Column) -> Column:
    """Spans (kind, start, end, value, loose): the contract's of the base kinds, loose 0, and the looser candidates, loose 1."""
    digit = text.rlike("[0-9]")
    base = (
        (EMAIL, F.contains(text, F.lit("@"))),
        (IP, text.rlike(r"[0-9]\.[0-9]")),
        (CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
        (PHONE, digit & F.contains(text, F.lit("+"))),
    )
    steps = [_matches(text, *b) for b in base] + [_matches(text, pattern, text.rlike(needs)) for _, pattern, needs in LOOSE]
    kinds = F.array(*(F.lit(k) for k in (*range(N_BASE), *(KINDS.index(kind) for kind, *_ in LOOSE))))

    def of_pattern(steps: Column, i: Column) -> Column:
        named = lambda s: F.struct(kinds[i].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), (i >= N_BASE).cast("int").alias("loose"))
        found = F.transform(F.filter(_placed(steps), lambda s: s["value"].isNotNull()), named)
        return F.when(F.size(steps) > 1, found).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,value:string,loose:int>>"))

    def holds(s: Column) -> Column:
        digits = _digits(s["value"])
        n = F.length(digits)
        rule = F.when(s["kind"] == 1, s["value"].rlike(IP_PARTS)).when(s["kind"] == 2, n.between(16, 19) & luhn(digits)).when(s["kind"] == 3, n.between(8, 15)).otherwise(True)
        return (s["loose"] == 1) | rule

    return F.filter(F.flatten(F.transform(F.array(*steps), of_pattern)), holds)


def apart(spans: Column) -> Column:
    """The spans without looser ones that overlap a base span or a looser one that begins before them (or there, of an earlier kind).

    In order of starts, a span overlaps one before it if that ends beyond its start, and one after
    it if that begins before its end; running extremes tell both.
    """
    order = ("start", "loose", "kind", "end", "value")
    far = 2**31 - 1

    def judged(s: Column) -> Column:
        ended = _running(F.transform(s, lambda x: F.when(x["loose"] == 0, x["end"]).otherwise(0)), F.lit(0), F.greatest)
        ahead = F.reverse(_running(F.reverse(F.transform(s, lambda x: F.when(x["loose"] == 0, x["start"]).otherwise(far))), F.lit(far), F.least))
        free = F.zip_with(F.zip_with(s, ended, lambda x, e: F.struct(x.alias("s"), e.alias("e"))), ahead, lambda x, a: F.struct(x["s"].alias("s"), ((x["s"]["loose"] == 0) | (x["e"] <= x["s"]["start"]) & (a >= x["s"]["end"])).alias("free")))
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["s"])

    def first(s: Column) -> Column:
        ended = _running(F.transform(s, lambda x: F.when(x["loose"] == 1, x["end"]).otherwise(0)), F.lit(0), F.greatest)
        kept = F.zip_with(s, ended, lambda x, e: F.struct(x.alias("s"), ((x["loose"] == 0) | (e <= x["start"])).alias("kept")))
        return F.transform(F.filter(kept, lambda x: x["kept"]), lambda x: x["s"])

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in order))))
    some = _let(_let(ordered, judged), first)
    as_it_is = F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in order)))
    return F.when(F.exists(spans, lambda s: s["loose"] == 1), some).otherwise(as_it_is)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _by_kind(kind: Column, values: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in values.items():
        out = F.when(kind == KINDS.index(name), value).otherwise(out)
    return out


def with_votes(text: Column, spans: Column) -> Column:
    """The spans with a vote of each labeler and the classifier's traits, without their values."""

    def vote(s: Column, pieces: Column) -> Column:
        near = _cut(pieces, F.greatest(s["start"] - WINDOW, F.lit(0)), s["start"])
        around = lambda near: F.concat(F.right(near, F.lit(1)), F.lit(" "), _cut(pieces, s["end"], s["end"] + 1))
        seen = _let(near, lambda near: F.struct(near.alias("near"), F.lower(near).alias("before"), around(near).alias("around"), _digits(s["value"]).alias("digits")))
        return _let(seen, lambda seen: voted(s, seen))

    def voted(s: Column, seen: Column) -> Column:
        kind, value = s["kind"], s["value"]
        near, before, around, digits = (seen[c] for c in ("near", "before", "around", "digits"))
        gazetteer = _by_kind(
            kind,
            {
                "email": _vote(value.rlike(rf"(?i)(?:\.|\W)(?:{TOP_DOMAINS})$"), value.rlike(r"(?i)\.(?:png|jpg|gif|html|js)$")),
                "ip": _vote(~value.rlike(r"^(?:0|127|255)\."), value.rlike(r"^(?:0|255)\.")),
                "card": _vote(digits.rlike("^[3-6]"), digits.rlike("^0")),
                "phone": _vote(value.rlike(rf"^\+(?:{DIALLING})"), digits.rlike("^(?:000|123)")),
                "secret": _vote(value.rlike(r"\x22[A-Za-z0-9+/_=-]{20,}\x22$"), value.rlike(r"(?i)(?:example|changeme|xxxx|your)")),
                "ssn": _vote(value.rlike("^(?!000|666|9)"), value.rlike("^(?:000|666|9)")),
                "iban": _vote(value.rlike(rf"^(?:{IBAN_COUNTRIES})"), ~value.rlike(rf"^(?:{IBAN_COUNTRIES})")),
            },
            F.lit(0),
        )
        strict = F.when(s["loose"] == 0, 1).otherwise(_by_kind(kind, {"secret": F.lit(1), "email": F.lit(1)}, F.lit(0)))
        context = _vote(_by_kind(kind, {k: before.rlike(v) for k, v in NEARBY.items()}, F.lit(False)), before.rlike(ELSEWHERE))
        neighbours = _vote(near.rlike(r"[:=(<\x22']\s?$"), around.rlike(r"^[A-Za-z0-9_/]|[A-Za-z0-9_/]$"))
        kinds_of_chars = F.size(F.array_distinct(F.split(value, "")))
        variety = _vote(F.lit(False), kinds_of_chars <= 3)
        votes = dict(zip(LABELERS, (strict, gazetteer, context, neighbours, variety)))
        length = F.length(value)
        traits = {
            "size": F.when(length < 8, 0).when(length < 12, 1).when(length < 16, 2).when(length < 24, 3).otherwise(4),
            "figures": F.floor(F.length(digits) * 3 / length),
            "lead": F.when(near.rlike(r"[:=]\s*$"), 2).when(near.rlike(r"\w\s*$"), 1).otherwise(0),
        }
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *(v.cast("int").alias(k) for k, v in (votes | traits).items()), s["loose"].alias("loose"))

    all_ = _let(_pieces(text), lambda p: F.transform(spans, lambda s: vote(s, p)))
    return F.when(F.size(spans) > 0, all_).otherwise(F.array().cast(f"array<struct<{','.join(f'{c}:int' for c in (*FIELDS, 'loose'))}>>"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns base and added: voted base spans, and looser ones that overlap none of them or of each other.

    Input columns must not be called base or added, nor begin with two underscores.
    """
    found = docs.select("*", text_of(text).alias("__text"))
    found = found.select("*", apart(all_spans(F.col("__text"))).alias("__spans"))
    found = found.select(*docs.columns, with_votes(F.col("__text"), F.col("__spans")).alias("__voted"))
    of = lambda loose: F.transform(F.filter("__voted", lambda s: s["loose"] == loose), lambda s: F.struct(*(s[c].alias(c) for c in FIELDS)))
    return found.select(*docs.columns, of(0).alias("base"), of(1).alias("added"))


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier: by kind, and by the value of each vote and trait."""

    kinds: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    reliability: dict[str, float]

    def accepts(self, span: Column) -> Column:
        score = F.element_at(F.array(*(F.lit(w) for w in self.kinds)), span["kind"] + 1)
        for name, weights in self.weights.items():
            score = score + F.element_at(F.array(*(F.lit(w) for w in weights)), span[name] + (2 if name in LABELERS else 1))
        return score >= 0


def vote_patterns(found: DataFrame) -> DataFrame:
    """How often each kind has each pattern of votes and traits: at most 7 kinds x 3**5 x 60 patterns."""
    return found.select(F.inline(F.concat("base", "added"))).groupBy("kind", *LABELERS, *TRAITS).count()


#: What labelers that vote are taken to do before any span is seen: chances of a vote against and one for it.
FAIR, FALSE = (0.125, 0.875), (0.7, 0.3)


def train(patterns: list[tuple], rounds: int = 40, steps: int = 400, rate: float = 0.5) -> Model:
    """Expectation-maximisation over rows (kind, votes, traits, count), then a logistic classifier on the posteriors.

    An abstention is no evidence: whether a labeler has a say at all depends on the kind.
    """
    rows = np.array(sorted(patterns), np.int64).reshape(len(patterns), 2 + len(LABELERS) + len(TRAITS))
    kind, votes, traits, n = rows[:, 0], rows[:, 1 : 1 + len(LABELERS)] + 1, rows[:, 1 + len(LABELERS) : -1], rows[:, -1].astype(float)
    given = {y: np.tile(p, (len(LABELERS), 1)) for y, p in ((1, FAIR), (0, FALSE))}
    prior = np.full(len(KINDS), 0.7)

    def posterior() -> np.ndarray:
        each = np.insert(np.log(given[1] / given[0]), 1, 0, axis=1)
        odds = np.log(prior / (1 - prior))[kind] + sum((each[j][votes[:, j]] for j in range(len(LABELERS))), np.zeros(len(rows)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    for _ in range(rounds):
        p = posterior()
        # pseudo-counts keep every probability inside (0, 1) and the sides as they started
        prior = (np.bincount(kind, n * p, len(KINDS)) + 2.8) / (np.bincount(kind, n, len(KINDS)) + 4)
        for y, share, start in ((1, n * p, FAIR), (0, n * (1 - p), FALSE)):
            counts = np.array([np.bincount(votes[:, j], share, 3)[[0, 2]] + 4 * np.array(start) for j in range(len(LABELERS))])
            given[y] = counts / counts.sum(axis=1, keepdims=True)
    p = posterior()

    values = [kind, *votes.T, *traits.T]
    widths = [len(KINDS), *[3] * len(LABELERS), *TRAITS.values()]
    weights = [np.zeros(w) for w in widths]
    for _ in range(steps if len(rows) else 0):
        z = sum(w[v] for w, v in zip(weights, values))
        wrong = n / n.sum() * (p - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        weights = [w + rate * (np.bincount(v, wrong, len(w)) - 1e-4 * w) for w, v in zip(weights, values)]
    right = {name: float(prior[0] * given[1][j][1] + (1 - prior[0]) * given[0][j][0]) for j, name in enumerate(LABELERS)}
    kinds, *rest = (tuple(w.tolist()) for w in weights)
    return Model(kinds, dict(zip((*LABELERS, *TRAITS), rest)), right)


def _text_of_spans(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def accepted(found: DataFrame, model: Model) -> DataFrame:
    """Adds spans: base spans and accepted candidates, (kind, start, end, votes)."""
    return found.withColumn("spans", F.concat("base", F.filter("added", model.accepts)))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, a digest of them, and all spans as text.

    Spans are kind:start:end in code points, end exclusive, by kind and start. Null and empty
    texts have none. Repeated rows give repeated results. An empty table gives no rows; it
    trains on nothing.
    """
    found = materialise(candidates(docs.select("doc_id", F.col("text").alias("c0")), "c0").select("doc_id", "base", "added"), "spans")
    model = train([tuple(r) for r in vote_patterns(found).collect()])
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return accepted(found, model).select(
        "doc_id",
        *(of_kind(k).alias(f"n_{KINDS[k]}") for k in range(N_BASE)),
        F.sha2(_text_of_spans(F.col("base")), 256).alias("base_sha256"),
        _text_of_spans(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    Columns and rows stay, whatever the columns are called; null texts stay null. Of spans that
    overlap, the one that begins first is replaced whole and the rest of the others goes with it.
    The texts are searched once. Only the places of spans are stored, with a key of their row;
    the texts meet them in a shuffle, so no copy of the table is written.
    """
    held, names = under_plain_names(docs)
    keyed = with_row_key(held, "row")
    found = materialise(candidates(keyed.select("row", names["text"]), names["text"]).select("row", "base", "added"), "spans")
    model = train([tuple(r) for r in vote_patterns(found).collect()])
    text = text_of(names["text"])
    labels = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def replaced(spans: Column, pieces: Column) -> Column:
        done = _running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)  # where the spans before have ended
        parts = F.zip_with(spans, done, lambda s, at: F.when(s["start"] >= at, F.concat(_cut(pieces, at, s["start"]), F.element_at(labels, s["kind"] + 1))).otherwise(""))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), _cut(pieces, end, F.length(text)))

    made = _let(ordered, lambda spans: _let(_pieces(text), lambda pieces: replaced(spans, pieces)))
    new = F.when(F.size("spans") > 0, made).otherwise(F.col(names["text"]).cast("string"))
    some = found.where((F.size("base") > 0) | (F.size("added") > 0)).dropDuplicates(["row"])  # equal rows have equal spans
    marked = keyed.join(accepted(some, model).select("row", "spans"), "row", "left")
    return marked.select(*((new if c == "text" else F.col(c_plain)).alias(c) for c, c_plain in names.items()))
