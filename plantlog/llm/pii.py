"""Personal data by weak supervision, with DataFrame expressions only.

Candidates come from one pattern per kind. Labelers vote on each (1 personal, -1 not, 0 abstain): the
kind's own rule (checksum, ranges, digit counts), a gazetteer of endings, prefixes and reserved ranges,
words in the context, the span's shape, and its borders. Expectation-maximisation over the counts of
vote patterns estimates every labeler's reliability, and the resulting soft labels train a logistic
span classifier on length, border and context features. Candidates of the four base kinds that pass
their rule are always spans; the classifier adds spans of the other kinds.

Cost: two scans of the texts and one aggregation into at most ``kinds x 3^5 x 4 x 3 x 3`` counters, the
only thing the driver sees; it does not grow with the input. Patterns run only on texts whose cheap
test succeeds. Every pattern is possessive or bounded, so that no text makes it backtrack.

Defined results: a null text counts as empty; repeated rows are treated one by one; an empty table
gives an empty table; other columns pass through.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plantlog.llm.common import free_name

_LOCAL = "A-Za-z0-9._%+-"
_DIGIT = "(?<![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this cheap test has no span of the kind.
    hint: str
    base: bool = True


#: A local part, and the first number of an address, starts where a run of its characters starts (or where
#: the last match ended): from any later character of the run the pattern would end, or fail, at the same place.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    Kind("secret", r"(?<![A-Za-z0-9+/_])[A-Za-z0-9+/_]{24,}+(?![A-Za-z0-9+/_])",
         "[A-Za-z0-9+/_]{24}", False),
    Kind("tel", r"(?<![0-9+)] ?)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
         r"[0-9]{3}[ .-][0-9]{4}", False),
    Kind("account", rf"{_DIGIT}[0-9](?:[ -]?[0-9]){{11,18}}+(?![0-9])", r"[0-9](?:[ -]?[0-9]){11}",
         False),
    Kind("handle", r"(?<![A-Za-z0-9._%+-])@[A-Za-z][A-Za-z0-9_]{2,}+(?![A-Za-z0-9_.@])", "@", False),
)
NAMES = [k.name for k in KINDS]
BASE = [i for i, k in enumerate(KINDS) if k.base]
#: Gazetteers: endings of mail domains, words near personal data and words near other numbers.
ENDINGS = ("com", "net", "org", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "nl", "uk",
           "us", "ch", "at", "be", "ca", "br", "mx", "in", "jp", "cn", "au", "pl", "se")
PERSONAL = ("mail", "contact", "call", "tel", "phone", "mobile", "fax", "card", "visa", "account",
            "iban", "token", "key", "secret", "password", "login", "user", "host", "address", "write")
OTHER = ("version", "isbn", "issn", "page", "order", "item", "article", "section", "figure", "table",
         "commit", "build", "revision", "checksum", "digest")
CONTEXT, BLOCK = 24, 128
LABELERS = 5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Every second digit from the right doubled, its digits added: the sum ends in 0."""
    d = F.reverse(_digits(match))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 1, d.substr(i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                     d.substr(i, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


def _small_parts(match: Column) -> Column:
    def ok(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(match, r"\."), ok)


def _count(match: Column, lo: int, hi: int) -> Column:
    return F.length(_digits(match)).between(lo, hi)


def _rule(kind: int, match: Column) -> Column:
    """The kind's own rule."""
    return {
        "email": F.lit(True),
        "ip": _small_parts(match),
        "card": F.when(_count(match, 16, 19), _luhn(match)).otherwise(False),
        "phone": _count(match, 8, 15),
        "secret": match.rlike("[0-9]") & match.rlike("[A-Za-z]"),
        "tel": F.lit(True),
        "account": ~F.when(_count(match, 16, 19), _luhn(match)).otherwise(False),
        "handle": F.lit(True),
    }[NAMES[kind]]


_SPAN = "struct<kind:int,start:int,end:int,match:string,ok:boolean,before:string,after:string>"


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _spans(text: Column, kind: int) -> Column:
    """Matches of one kind: kind, start, end (code points, end exclusive), match, ok, and the characters
    around. The text is split at its matches, and places are summed up ``BLOCK`` matches at a time, so that
    the cost stays in proportion to the text however many matches it has."""
    pattern = KINDS[kind].pattern
    empty = F.array().cast(f"array<{_SPAN}>")

    def steps(hits: Column, gaps: Column) -> Column:
        nexts = F.zip_with(F.slice(gaps, F.lit(2), F.size(hits)), F.slice(hits, F.lit(2), F.size(hits)), lambda g, h: F.substring(
            F.concat(g, F.coalesce(h, F.lit(""))), 1, 1))
        return F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(
            g.alias("gap"), h.alias("match"))), nexts, lambda s, n: F.struct(
            s["gap"].alias("gap"), s["match"].alias("match"), n.alias("after")))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["gap"])
        before = F.right(F.concat(acc["tail"], s["gap"]), F.lit(CONTEXT))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(s["match"])).alias("end"), s[
            "match"].alias("match"), F.coalesce(_rule(kind, s["match"]), F.lit(False)).alias("ok"), before.alias("before"),
            s["after"].alias("after"))
        return F.struct((start + F.length(s["match"])).alias("at"), F.right(F.concat(before, s["match"]), F.lit(CONTEXT)).alias(
            "tail"), F.concat(acc["spans"], F.array(span).cast(f"array<{_SPAN}>")).alias("spans"))

    def placed(all_: Column) -> Column:
        begins = F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK))
        size = lambda b: F.aggregate(F.slice(all_, b + 1, F.lit(BLOCK)), F.lit(0), lambda n, s: n + F.length(
            s["gap"]) + F.length(s["match"]))
        starts = F.aggregate(F.transform(begins, size), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(
            F.element_at(acc, -1) + n)))
        # Each match has a character at least, so that many before a block hold its context.
        tail = lambda b: F.right(F.array_join(F.transform(F.slice(
            all_, F.greatest(b - CONTEXT, F.lit(0)) + 1, F.least(b, F.lit(CONTEXT))), lambda s: F.concat(
            s["gap"], s["match"])), ""), F.lit(CONTEXT))
        return _bound(starts, lambda at: F.flatten(F.transform(begins, lambda b, k: F.aggregate(
            F.slice(all_, b + 1, F.lit(BLOCK)), F.struct(F.element_at(at, k + 1).alias("at"), tail(b).alias("tail"), empty.alias(
                "spans")), add, lambda acc: acc["spans"]))))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _bound(hits, lambda h: F.when(F.size(h) > 0, _bound(steps(h, F.split(text, pattern, -1)), placed)).otherwise(empty))
    return F.when(text.rlike(KINDS[kind].hint), found).otherwise(empty)


def _candidates(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` with the array column ``into``: base spans that pass, and all other candidates that
    touch none of them."""
    t = F.coalesce(F.col(text), F.lit(""))
    hold = free_name(docs, "_found")
    found = docs.withColumn(hold, F.struct(
        F.concat(*[_spans(t, i) for i in BASE]).alias("base"),
        F.concat(*[_spans(t, i) for i in range(len(KINDS)) if i not in BASE]).alias("more")))
    kept = F.filter(F.col(hold)["base"], lambda s: s["ok"])
    # The spans that pass are bound once: the others are compared with these few alone.
    more = F.flatten(F.transform(F.array(kept), lambda base: F.filter(F.col(hold)["more"], lambda s: s["ok"] & ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))))
    return found.withColumn(into, F.struct(
        kept.alias("base"), more.alias("more"),
        F.filter(F.col(hold)["base"], lambda s: ~s["ok"]).alias("failed"))).drop(hold)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _evidence(s: Column) -> Column:
    """Votes ``v0..v4`` and features of a span: ``kind``, length class, border classes."""
    kind, match, after = s["kind"], s["match"], s["after"]
    before, prev = F.lower(s["before"]), F.right(s["before"], F.lit(1))
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), kind + 1)
    length = F.length(match)
    gazetteer = F.when(name == "email", _vote(
        F.lower(F.regexp_extract(match, r"\.([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS), F.lit(True))
    ).when(name == "ip", _vote(~match.rlike(r"^0*(?:0|10|127|255)\.|^192\.168\."), F.lit(True))
    ).when(name.isin("card", "account"), _vote(
        _digits(match).rlike("^(?:4|5[1-5]|3[47]|35|6011|65|2[2-7])"), F.lit(False))
    ).when(name == "secret", _vote(match.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), match.rlike("^[A-Za-z_/]+$"))
    ).otherwise(0)
    shape = F.when(name == "secret", _vote(length.isin(32, 40, 64), length < 28)
    ).when(name.isin("card", "account"), _vote(_count(match, 15, 19), _count(match, 1, 13))
    ).when(name.isin("phone", "tel"), _vote(_count(match, 10, 13), _count(match, 1, 8))
    ).otherwise(_vote(length.between(6, 40), length > 80))
    glued = "[A-Za-z0-9]"
    border = lambda c: F.when(c.isin("", " ", "\n", "\t"), 0).when(c.rlike(glued), 1).otherwise(2)
    return F.struct(
        kind.alias("kind"), F.when(s["ok"], 1).otherwise(-1).alias("v0"), gazetteer.alias("v1"),
        _vote(before.rlike("|".join(PERSONAL)), before.rlike("|".join(OTHER))).alias("v2"),
        shape.alias("v3"), _vote(~prev.rlike(glued) & ~after.rlike(glued), F.lit(True)).alias("v4"),
        F.when(length < 12, 0).when(length < 20, 1).when(length < 36, 2).otherwise(3).alias("size"),
        border(prev).alias("prev"), border(after).alias("next"))


_PATTERN = ["kind", *[f"v{j}" for j in range(LABELERS)], "size", "prev", "next"]


def _features(row) -> list[tuple[str, int]]:
    return [("kind", row["kind"]), ("size", row["size"]), ("prev", row["prev"]),
            ("next", row["next"]), ("context", row["v2"])]


FEATURES = ([("kind", i) for i in range(len(KINDS))] + [("size", i) for i in range(4)]
            + [(n, i) for n in ("prev", "next") for i in range(3)] + [("context", i) for i in (-1, 0, 1)])


@dataclass(frozen=True)
class Model:
    #: P(vote | personal), P(vote | not) per labeler, votes -1, 0, 1.
    reliability: tuple
    weights: tuple
    bias: float


def estimate(patterns: list[dict], rounds: int = 40) -> tuple[list, list[float]]:
    """Expectation-maximisation over counted vote patterns: labeler reliabilities and, for each
    pattern, the probability that it is personal data. Starts from the share of positive votes."""
    post = []
    for p in patterns:
        votes = [p[f"v{j}"] for j in range(LABELERS)]
        cast = sum(v != 0 for v in votes)
        post.append((sum(v == 1 for v in votes) + 1) / (cast + 2))
    tables: list = []
    for _ in range(rounds):
        tables, prior = [], {}
        for j in range(LABELERS):
            seen = {(y, v): 0.5 for y in (0, 1) for v in (-1, 0, 1)}
            for p, q in zip(patterns, post):
                seen[1, p[f"v{j}"]] += p["count"] * q
                seen[0, p[f"v{j}"]] += p["count"] * (1 - q)
            tables.append({(y, v): seen[y, v] / sum(seen[y, x] for x in (-1, 0, 1))
                           for y in (0, 1) for v in (-1, 0, 1)})
        for p, q in zip(patterns, post):
            a, b = prior.get(p["kind"], (1.0, 1.0))
            prior[p["kind"]] = (a + p["count"] * q, b + p["count"] * (1 - q))
        post = []
        for p in patterns:
            a, b = prior[p["kind"]]
            odds = math.log(a / b) + sum(math.log(tables[j][1, p[f"v{j}"]] / tables[j][0, p[f"v{j}"]])
                                         for j in range(LABELERS))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return tables, post


def fit(patterns: list[dict], steps: int = 300) -> Model:
    """Logistic regression on the soft labels of all candidates, as counted patterns."""
    patterns = sorted(patterns, key=lambda p: tuple(p[n] for n in _PATTERN))
    tables, post = estimate(patterns)
    place = {f: i for i, f in enumerate(FEATURES)}
    rows = [[place[f] for f in _features(p)] for p in patterns]
    total = sum(p["count"] for p in patterns) or 1
    w, bias = [0.0] * len(FEATURES), 0.0
    for _ in range(steps):
        grad, g0 = [1e-4 * x for x in w], 0.0
        for p, q, f in zip(patterns, post, rows):
            z = bias + sum(w[i] for i in f)
            d = p["count"] / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q)
            g0 += d
            for i in f:
                grad[i] += d
        w = [x - 2.0 * g for x, g in zip(w, grad)]
        bias -= 2.0 * g0
    return Model(tuple(tuple(sorted(t.items())) for t in tables),
                 tuple(round(x, 9) for x in w), round(bias, 9))


def train(docs: DataFrame, text: str = "text") -> Model:
    t = F.coalesce(F.col(text), F.lit(""))
    found = _candidates(docs.select(t.alias("text")), "text", "found")
    each = found.select(F.explode(F.concat(
        "found.base", "found.more", "found.failed")).alias("s")).select(
        _evidence(F.col("s")).alias("e")).select("e.*")
    return fit([r.asDict() for r in each.groupBy(*_PATTERN).count().collect()])


def _probable(model: Model, e: Column) -> Column:
    names = {"kind": e["kind"], "size": e["size"], "prev": e["prev"], "next": e["next"],
             "context": e["v2"]}
    z = F.lit(model.bias)
    for name, group in itertools.groupby(FEATURES, key=lambda f: f[0]):
        group = list(group)
        low = min(v for _, v in group)
        values = F.array(*[F.lit(model.weights[FEATURES.index(f)]) for f in group])
        z = z + F.element_at(values, names[name] - low + 1)
    return z >= 0


def find(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` and a struct column ``pii``: ``base`` and ``spans``, arrays of (kind, start, end);
    ``spans`` holds the base spans and those that the classifier adds, by kind, then start. A column
    of ``docs`` named ``pii`` is replaced."""
    model = model or train(docs, text)
    found = _candidates(docs, text, into := free_name(docs, "_spans"))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                               s["end"].alias("end"))
    added = F.filter(F.col(into)["more"], lambda s: _probable(model, _evidence(s)))
    base = F.transform(F.col(into)["base"], plain)
    return found.withColumn("pii", F.struct(base.alias("base"), F.concat(
        base, F.transform(added, plain)).alias("spans"))).drop(into)


def label(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in NAMES]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    mark = F.array(*[F.lit(f"[{n.upper()}]") for n in NAMES])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(
            text.substr(acc["at"] + 1, s["start"] - acc["at"]),
            F.element_at(mark, s["kind"] + 1))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.concat(acc["parts"], F.array(piece)).alias("parts"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<string>").alias("parts")), step, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
