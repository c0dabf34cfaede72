"""Personal data: base patterns, and further spans from candidates scored by boosted trees.

Generators with high recall propose spans that may overlap: numbers in any grouping as phone or card, spelled-out
addresses, dotted or coloned groups. Boosted trees over format and context features score them; a threshold of each
kind, calibrated on candidates that trees of other candidates score, selects what is added to the base spans.

Everything done to documents is DataFrame expressions, compiled trees included. The trees are fitted over all
candidates of all documents: base matches, written in other ways, against proposals that no base pattern confirms.
Candidates are counted by their features, and the driver fits on the distinct features with their counts.

A text may have any number of spans: arrays are built in pieces of CHUNK, never by appending to a whole one, and what
touches what is found by sorting, so the work grows little faster than the number of spans.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised

KINDS = ("email", "ip", "card", "phone")
#: What the candidates of a kind and label weigh together at most: where there are more, each weighs less.
CLASS_WEIGHT = 1_500
TREES, DEPTH, RATE = 40, 3, 0.3
#: Rewritings of each kind at least, if it has any base match: few matches are rewritten several times.
REWRITTEN = 600
#: Of unconfirmed proposals, scored by trees of the other folds, at most so large a share may pass a threshold.
FALSE_SHARE, FOLDS = 0.005, 3
CONTEXT, N_FEATURES = 24, 20
#: Items of an array that are gone through at a time.
CHUNK = 256

# A match can't begin inside a run of signs it could have begun with, except right after the match before it (\G):
# the lookbehinds change no result, but keep the search linear. Groups that end a pattern are possessive, which is
# the same there, and doesn't recurse.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Only texts with such a sign are searched.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: The generators: kind, pattern, and the number of digits that a proposal has.
GENERATORS = (
    ("phone", r"(?<![0-9])\+?\(?[0-9](?:[\x20()./ -]{0,2}[0-9])++", 7, 15),
    ("card", r"(?<![0-9])[0-9](?:[\x20./_ -]{0,2}[0-9])++", 12, 19),
    ("ip", r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}\x20?[.]\x20?){3}[0-9]{1,3}(?![0-9])|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}", 1, 39),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]\x20?|\x20@\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[(\[{]\x20?(?:dot|DOT|[.])\x20?[)\]}]\x20?|\x20dot\x20|[.])[A-Za-z0-9-]{1,63}+)++", 0, 64),
)
GENERATOR_NEEDS = {"phone": "[0-9]", "card": "[0-9]", "ip": r"[0-9][\x20:.]", "email": r"\x20@|[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]|\x20at\x20"}
#: Words before a number that is something else, and what an address ends with.
OTHER = r"page|version|isbn|order|total|year|date|invoice|chapter|number|\bno\b|\bid\b|seite|p\u00e1gina"
SUFFIX = r"(?i)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|at|ch|it|nl|example|test)$"
WORDS = {"phone": "phone|tel|call|fax|mobil|contact", "card": "card|visa|master|credit|pay|karte|carte|tarjeta", "ip": r"\bip\b|addr|host|server|login", "email": "mail|contact|write|reach"}


def let(value: Column, body) -> Column:
    """body(value), with value computed once: what a lambda takes from outside is computed anew for each of its items."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(items: Column) -> Column:
    """The array in slices of CHUNK items."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda i: F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))
    return let(items, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.slice(F.array(v), 1, 0)))


def running(values: Column, op) -> Column:
    """Of an array of ints >= 0: op (a sum or maximum) of all values up to each."""

    def up_to(items, start, before):
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"] if before else op(a["at"], x))).alias("out"))
        return F.aggregate(items, first, step)["out"]

    def whole(parts):
        totals = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), op))
        return F.flatten(F.zip_with(parts, up_to(totals, F.lit(0), True), lambda c, at: up_to(c, at, False)))

    return let(chunks(values), whole)


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def ends_of(parts: Column) -> Column:
    """Where the pieces end in the text."""
    return running(F.transform(parts, lambda x: F.length(x["g"])), lambda a, b: a + b)


def matches(text: Column, pattern: str, needs: str) -> Column:
    """The leftmost non-overlapping matches as array<struct<b, e, m>>, in code points.

    Each element that the search returns is a match with all that stands before it since the last; anchored at \\G, it
    reads the text once.
    """
    place = lambda x, e: F.struct((e - F.length(x["m"])).alias("b"), e.alias("e"), x["m"].alias("m"))
    return let(pieces(text, pattern, needs), lambda p: F.zip_with(p, ends_of(p), place))


def pieces(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<g, m>>: each match m, and g, that with all that stands before it since the last."""
    whole = F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0)))
    return F.transform(F.coalesce(whole, F.array().cast("array<string>")), lambda g: F.struct(g.alias("g"), F.regexp_extract(g, rf"(?s)^.*?({pattern})$", 1).alias("m")))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right Luhn sum."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    value = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind array<struct<b, e, m>> of the valid base matches."""
    return {k: F.filter(matches(text, BASE[k], NEEDS[k]), lambda x: valid(k, x["m"])) for k in KINDS}


def with_proposals(rows: DataFrame, text: str, base: str) -> DataFrame:
    """Adds more, the generators' spans that share no code point with one of base: array<struct<b, e, k, m, before,
    after>>. In several steps, as the analyzer goes one lambda deeper each time; a column that a later step's lambdas
    use is bound first."""
    t = F.col(text)
    found = [proposals(t, *g).alias(f"more{i}") for i, g in enumerate(GENERATORS)]
    rows = rows.select("*", *found)
    rows = rows.withColumn("more", F.concat(*[f"more{i}" for i in range(len(GENERATORS))])).drop(*[f"more{i}" for i in range(len(GENERATORS))])
    return rows.withColumn("more", let(F.col("more"), lambda f: F.when(F.size(f) > 0, let(F.col(base), lambda b: apart(f, b))).otherwise(f)))


def proposals(text: Column, kind: str, pattern: str, low: int, high: int) -> Column:
    return let(pieces(text, pattern, GENERATOR_NEEDS[kind]), lambda p: located(text, p, kind, lambda m: F.length(digits(m)).between(low, high)))


def confirmed(text: Column, kind: str) -> Column:
    """The valid base matches of a kind, as proposals are returned."""
    return let(pieces(text, BASE[kind], NEEDS[kind]), lambda p: located(text, p, kind, lambda m: valid(kind, m)))


def located(text: Column, parts: Column, kind: str, keep: Callable[[Column], Column]) -> Column:
    """The matches to keep of a kind from their pieces, each with CONTEXT code points around, as far as its neighbours'
    pieces have them."""
    tail = lambda c: F.when(F.length(c) > CONTEXT, F.substring(c, F.length(c) - CONTEXT + 1, F.lit(CONTEXT))).otherwise(c)
    head = lambda c: F.substring(c, 1, CONTEXT)

    def placed(ends, rest):
        g = lambda i: F.when((i >= 0) & (i < F.size(parts)), F.get(parts, i)["g"]).when(i == F.size(parts), rest).otherwise("")

        def one(x, i):
            e, own = F.get(ends, i), F.substring(x["g"], F.lit(1), F.length(x["g"]) - F.length(x["m"]))
            return F.struct(
                (e - F.length(x["m"])).alias("b"), e.alias("e"), F.lit(KINDS.index(kind)).alias("k"), x["m"].alias("m"),
                tail(F.concat(tail(g(i - 1)), tail(own))).alias("before"), head(F.concat(head(g(i + 1)), head(g(i + 2)))).alias("after"),
            )

        return F.filter(F.transform(parts, one), lambda x: keep(x["m"]))

    rest = lambda ends: F.when(F.size(ends) > 0, F.substring(text, F.get(ends, F.size(ends) - 1) + 1, F.lit(CONTEXT))).otherwise("")
    return let(ends_of(parts), lambda ends: let(rest(ends), lambda r: placed(ends, r)))


def apart(found: Column, taken: Column) -> Column:
    """Those of found (b, e, ...) that share no code point with one of taken (b, e, ...): all are put in order of their
    beginnings; a span before reaches into one if the furthest end so far does, one after if the next begins within."""
    mark = lambda kind: lambda x, i: F.struct(x["b"].alias("b"), F.lit(kind).alias("kind"), x["e"].alias("e"), i.alias("i"))
    far = F.lit((1 << 31) - 1)

    def chosen(line):
        reach = running(F.transform(line, lambda x: F.when(x["kind"] == 0, x["e"]).otherwise(0)), larger)
        # the nearest beginning after: a maximum too, counted from far away
        ahead = F.reverse(running(F.transform(F.reverse(line), lambda x: F.when(x["kind"] == 0, far - x["b"]).otherwise(0)), larger))
        both = F.zip_with(F.zip_with(line, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), ahead, lambda z, a: F.struct(z["x"].alias("x"), z["r"].alias("r"), a.alias("a")))
        free = F.filter(both, lambda z: (z["x"]["kind"] == 1) & (z["r"] <= z["x"]["b"]) & (far - z["a"] >= z["x"]["e"]))
        return F.transform(F.array_sort(F.transform(free, lambda z: z["x"]["i"])), lambda i: F.get(found, i))

    return F.when(F.size(taken) == 0, found).otherwise(let(F.array_sort(F.concat(F.transform(taken, mark(0)), F.transform(found, mark(1)))), chosen))


def best_apart(sure: Column) -> Column:
    """Of scored spans (s, b, k, e) those that no better one touches, as (b, k, e): runs of spans that touch each other
    are cut out, and the best is taken first in each."""
    touches = lambda x, spans: F.exists(spans, lambda s: (s["b"] < x["e"]) & (x["b"] < s["e"]))
    none = F.array().cast("array<struct<b:int,k:int,e:int>>")

    def greedy(run):
        order = F.array_sort(F.transform(run, lambda x: F.struct((-x["s"]).alias("s"), x["b"].alias("b"), x["k"].alias("k"), x["e"].alias("e"))))
        return F.aggregate(order, none, lambda a, x: F.when(touches(x, a), a).otherwise(F.concat(a, F.array(F.struct(x["b"].alias("b"), x["k"].alias("k"), x["e"].alias("e"))))))

    def runs(line, reach):
        begins = F.filter(F.sequence(F.lit(0), F.size(line) - 1), lambda i: (i == 0) | (F.get(reach, i - 1) <= F.get(line, i)["b"]))
        return let(begins, lambda b: F.transform(b, lambda v, i: F.slice(line, v + 1, F.coalesce(F.get(b, i + 1), F.size(line)) - v)))

    chosen = lambda line: let(running(F.transform(line, lambda x: x["e"]), larger), lambda reach: F.flatten(F.transform(runs(line, reach), greedy)))
    line = F.array_sort(F.transform(sure, lambda x: F.struct(x["b"].alias("b"), x["e"].alias("e"), x["k"].alias("k"), x["s"].alias("s"))))
    return let(line, lambda x: F.when(F.size(x) > 0, chosen(x)).otherwise(none))


def features(x: Column) -> list[Column]:
    """Format and context features of a proposal, as doubles."""
    m, d = x["m"], digits(x["m"])
    n = F.when(x["k"] == 0, 0).otherwise(F.length(d))  # an address may have any digits
    number = lambda c: F.when(c, 1.0).otherwise(0.0)
    around = F.lower(F.concat(x["before"], F.lit(" "), x["after"]))
    # the groups of digits, whatever stands between them
    shape = F.regexp_replace(F.regexp_replace(m, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+", "-")
    words = F.when(F.lit(False), F.lit(0.0))
    for i, k in enumerate(KINDS):
        words = words.when(x["k"] == i, number(around.rlike(WORDS[k])))
    return [
        x["k"].cast("double"),
        n.cast("double"),
        F.length(m).cast("double"),
        F.length(F.regexp_replace(m, r"[^\x20./() :_-]", "")).cast("double"),
        number(F.when(n.between(12, 19), luhn(d)).otherwise(False)),
        number(m.rlike(r"^\+|^00[1-9]")),
        number(m.rlike(r"\([0-9]{2,4}\)")),
        number(shape.rlike(r"(?:^|-)[0-9]{3}-[0-9]{3}-[0-9]{4}$")),
        number(shape.rlike(r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}$")),
        number(m.rlike(r"^(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|^[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}")),
        number(m.rlike(r"(?:^|[^0-9])(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})(?![0-9])")),
        number(m.rlike(r"[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]")),
        number(shape.rlike(r"(?:^|-)(?:19|20)[0-9]{2}$")),
        number(F.lower(x["before"]).rlike(OTHER)),
        number(m.rlike(SUFFIX)),
        F.when(x["k"] == 0, 0.0).otherwise(F.length(F.regexp_replace(shape, "[0-9]", "")).cast("double")),
        number(x["before"].rlike(r"[\p{L}\p{N}=_\"']$")),
        number(x["after"].rlike(r"^[\p{L}\p{N}=_\"']")),
        F.coalesce(words, F.lit(0.0)),
        F.when(x["k"] == 0, 0.0).otherwise(number(F.size(F.array_distinct(F.split(d, ""))) < 4)),
    ]


# ---- boosted trees ----


@dataclass
class Trees:
    """Nodes are (feature, at most, left, right) or a value; thresholds by kind are for the summed log-odds."""

    base: float = -6.0
    trees: list = field(default_factory=list)
    thresholds: tuple[float, ...] = (float("inf"),) * len(KINDS)

    def score(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows):
            if not isinstance(node, tuple):
                return np.full(len(rows), node)
            out, left = np.empty(len(rows)), rows[:, node[0]] <= node[1]
            out[left], out[~left] = walk(node[2], rows[left]), walk(node[3], rows[~left])
            return out

        return self.base + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def expression(self, values: list[Column]) -> Column:
        """The same score as a DataFrame expression over the features."""

        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(values[node[0]] <= float(node[1]), walk(node[2])).otherwise(walk(node[3]))

        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + walk(t)
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaves; rows have weights."""
    p = min(max(float(np.average(y, weights=w)), 0.01), 0.99)
    out = Trees(float(np.log(p / (1 - p))))
    f = np.full(len(y), out.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        total, weight = g[rows].sum(), h[rows].sum()
        leaf = RATE * float(total / (weight + 1.0))
        best, cut = 1e-3, None
        if depth and w[rows].sum() > 10:
            for j in range(x.shape[1]):
                order = rows[np.argsort(x[rows, j], kind="stable")]
                v = x[order, j]
                at = np.flatnonzero(v[1:] > v[:-1])
                if len(at):
                    a, b = np.cumsum(g[order])[at], np.cumsum(h[order])[at]
                    gain = a**2 / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total**2 / (weight + 1)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, cut = gain[i], (j, float((v[at[i]] + v[at[i] + 1]) / 2))
        if cut is None:
            return leaf
        left = x[rows, cut[0]] <= cut[1]
        return (*cut, grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        out.trees.append(grow(np.arange(len(y)), w * (y - p), w * p * (1 - p), DEPTH))
        f = out.score(x)
    return out


#: Words around made candidates that say nothing.
BEFORE, AFTER = ("on ", "in ", "and then ", "we met ", "look ", "he was ", "this was ", ""), (" and more", ".", "", ", then", " we said", " in all")


def rewritten(k: Column, m: Column, draw: Callable[[int, int], Column]) -> Column:
    """A base match written in other ways, which the base patterns miss: an array. draw(i, n) is the i-th random number
    below n."""
    one = lambda i, *choices: F.element_at(F.array(*map(F.lit, choices)), draw(i, len(choices)) + 1)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    local = F.substring_index(m, "@", 1)
    at, dot = one(0, " at ", "[at]", " (at) ", "(at)", " @ "), one(0, " dot ", "[dot]", " (dot) ", ".", ".")
    email = [text(local, at, F.replace(F.substring(m, F.length(local) + 2, F.length(m)), F.lit("."), dot))]
    ip = [F.replace(m, F.lit("."), one(1, " . ", ". ")), F.concat_ws(":", *[F.lower(F.hex(draw(10 + i, 65536))) for i in range(8)])]
    d = digits(m)
    four = lambda i: F.substring(d, 4 * i + 1, 4)
    groups = lambda s: text(four(0), *[F.when(F.length(d) > 4 * i, text(s(i), four(i))).otherwise("") for i in range(1, 5)])
    card = [groups(lambda i: one(2, ".", "/", "_", " ")), groups(lambda i: one(20 + i, "/", " ", ". "))]
    # other numbers of the same length: those of one corpus may have digits in common
    digit = lambda i: (draw(30 + i, 8) + 2 if i in (0, 3) else draw(30 + i, 10)).cast("string")
    area, middle, last = text(*map(digit, range(3))), text(*map(digit, range(3, 6))), text(*map(digit, range(6, 10)))
    s, country = one(3, " ", ".", "-"), F.substring(d, F.lit(1), F.length(d) - 10)
    phone = [text("(", area, ")", one(4, " ", ""), middle, s, last), text("00", country, s, area, s, middle, s, last), text(area, s, middle, s, last)]
    out = F.when(k == 0, F.array(*email)).when(k == 1, F.array(*ip)).when(k == 2, F.array(*card))
    return out.when(F.length(d) < 10, F.array(text("00", d))).otherwise(F.array(*phone))


def harmless(rng: random.Random) -> dict:
    """A number that is no personal data, as the generators would propose it."""
    n = rng.randrange
    y, mo, d, h, mi = n(1900, 2100), n(1, 13), n(1, 29), n(24), n(60)
    s = rng.choice("-./")
    forms = [
        f"{y}{s}{mo:02}{s}{d:02} {h:02}.{mi:02}", f"{d:02}{s}{mo:02}{s}{y} {h:02}{mi:02}", f"{y} {y + 1} {y + 2}", f"{y}-{y + n(9)} {n(999)}",
        f"{n(100, 1000)}{s}{n(100, 1000)} {y}", f"{n(100, 1000)} {n(100, 1000)} {y}", " ".join(f"{n(1000):03}" for _ in range(n(3, 6))), str(n(10**8, 10**15)), f"{n(10**6)}.{n(10**9)}", ".".join(str(n(30)) for _ in range(n(6, 9))),
        f"978-{n(9)}-{n(10, 99)}-{n(10**5, 10**6)}-{n(9)}", " ".join(str(n(100)) for _ in range(n(5, 8))), str(n(10**11, 10**18)), "/".join(str(n(10**3, 10**4)) for _ in range(3)),
    ]
    m = rng.choice(forms)
    kind = rng.choice(["ip", "email", "email", *["phone", "card"] * 4])
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n(2, 9)))
    if kind == "email":
        m = f"{word()} at {word()}{rng.choice([' dot ', '.'])}{word()}{rng.choice(['', ' dot ' + word()])}"
        return {"k": 0, "m": m, "before": rng.choice(BEFORE), "after": rng.choice(AFTER), "y": 0}
    if kind == "ip":
        m = rng.choice([f"{h}:{mi:02}:{n(60):02}:{n(60):02}", f"{n(256, 999)}.{n(999)}.{n(999)}.{n(256, 999)}", ":".join(str(n(10)) for _ in range(4))])
    return {"k": KINDS.index(kind), "m": m, "before": rng.choice([*BEFORE, "total of ", "no. ", "page ", "id "]), "after": rng.choice(AFTER), "y": 0}


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """(y, k, m, before, after): all distinct candidates of all documents, base matches with y = 1."""
    t = F.col("t")
    rows = docs.select(F.col(text).cast("string").alias("t")).filter(t.rlike("[0-9@]|\\x20at\\x20|[(\\[{]\\x20?(?:at|AT)"))
    rows = rows.select("t", *[confirmed(t, k).alias(f"base_{k}") for k in KINDS])
    rows = with_proposals(rows.select("t", F.concat(*[f"base_{k}" for k in KINDS]).alias("base")), "t", "base")
    labelled = F.array(F.struct(F.lit(1).alias("y"), F.col("base").alias("c")), F.struct(F.lit(0).alias("y"), F.col("more").alias("c")))
    return rows.select(F.explode(labelled).alias("s")).select("s.y", F.inline("s.c")).drop("b", "e").distinct()


def fit(docs: DataFrame, text: str = "text", bound: int = CLASS_WEIGHT) -> Trees:
    """Fits trees and thresholds on all candidates of all documents. The candidates of a kind and label weigh ``bound``
    together where there are more, so that none drowns the others. The driver gets a row for each distinct vector of
    features, with its count. Without base matches nothing is ever added to the base spans."""
    spark = docs.sparkSession
    both = materialised(candidates(docs, text))
    n = {(r.y, r.k): r["count"] for r in both.groupBy("y", "k").count().collect()}
    if not any(y for y, _ in n):
        return Trees()
    draw = lambda i, below: F.pmod(F.xxhash64("m", "before", "after", "copy", F.lit(i)), F.lit(below)).cast("int")
    times = F.array(*[F.lit(-(-REWRITTEN // n.get((1, k), REWRITTEN))) for k in range(len(KINDS))])
    true = both.filter("y = 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.element_at(times, F.col("k") + 1))))
    true = true.select("y", "k", "m", "before", "after", "copy", F.posexplode(rewritten(F.col("k"), F.col("m"), draw)).alias("way", "made"))
    # half of the rewritings stand elsewhere, so that the words around aren't all that is learned
    place = lambda i, choices: F.get(F.array(*map(F.lit, choices)), F.pmod(F.xxhash64("m", "before", "after", "copy", "way", F.lit(i)), F.lit(len(choices))).cast("int"))
    moved = lambda i, choices, own: F.when(place(50, (False, True)), place(i, choices)).otherwise(F.col(own)).alias(own)
    true = true.select("y", "k", F.col("made").alias("m"), moved(51, BEFORE, "before"), moved(52, AFTER, "after"), F.concat_ws(":", "copy", "way").alias("which"), F.lit(True).alias("found"))
    false = both.filter("y = 0").select("y", "k", "m", "before", "after", F.lit("").alias("which"), F.lit(True).alias("found"))
    rng = random.Random(7)
    rows = [{"which": str(i), **harmless(rng)} for i in range(3_000)]
    kind = "array<struct<which:string,k:int,m:string,before:string,after:string,y:int>>"
    other = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind))).withColumn("found", F.lit(False))
    fold = F.pmod(F.xxhash64("m", "before", "after", "which"), F.lit(FOLDS)).cast("int").alias("fold")
    every = true.unionByName(false).unionByName(other).select("y", "found", fold, F.array(*features(F.struct("k", "m", "before", "after"))).alias("f"))
    table = sorted((r.f, r.y, r.found, r.fold, r["count"]) for r in every.groupBy("y", "found", "fold", "f").count().collect())
    a, y, folds = np.array([r[0] for r in table]), np.array([r[1] for r in table], float), np.array([r[3] for r in table])
    w = np.array([c * (min(1.0, bound / n[label, int(f[0])]) if found else 1.0) for f, label, found, _, c in table])
    out = boost(a, y, w)
    # for the thresholds each fold is scored by trees of the others
    s, kinds = np.zeros(len(y)), a[:, 0]
    for i in np.unique(folds):
        s[folds == i] = boost(a[folds != i], y[folds != i], w[folds != i]).score(a[folds == i])
    limits = []
    for k in range(len(KINDS)):
        false = (y == 0) & (kinds == k)
        order = np.argsort(-s[false], kind="stable")
        most = np.cumsum(w[false][order])  # weight of what scores as high
        first = int(np.searchsorted(most, FALSE_SHARE * w[false].sum(), side="right"))
        limits.append(max(float(np.log(9)), float(s[false][order][first]) + 1e-9 if first < len(most) else 0.0))  # at least 0.9 sure
    out.thresholds = tuple(limits)
    return out


def find(docs: DataFrame, trees: Trees, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds base and spans to the columns of ``carry`` (default: all): array<struct<b, k, e>>, ordered by begin and
    kind (a number in KINDS); spans has the base ones and those the trees add, which touch no other span.

    Begin and end count code points, the end is exclusive. Null and empty texts have no spans. Carried columns named
    base or spans are returned as base_in and spans_in.
    """
    carry = docs.columns if carry is None else carry
    t = F.col("t")
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    plain = lambda i: lambda x: F.struct(x["b"].alias("b"), F.lit(i).alias("k"), x["e"].alias("e"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[F.transform(s, plain(i)) for i, s in enumerate(base_spans(t).values())])))
    out = [F.col(f"c{i}").alias(f"{c}_in" if c in ("base", "spans") else c) for i, c in enumerate(carry)]
    if not trees.trees:
        return rows.select(*out, "base", F.col("base").alias("spans"))
    rows = with_proposals(rows, "t", "base")
    # the features once for each proposal, then the trees over them
    score = lambda x: let(F.array(*features(x)), lambda f: trees.expression([F.get(f, F.lit(i)) for i in range(N_FEATURES)]))
    limits = F.array(*[F.lit(float(v)) for v in trees.thresholds])
    scored = F.transform("more", lambda x: F.struct(score(x).alias("s"), x["b"].alias("b"), x["k"].alias("k"), x["e"].alias("e")))
    rows = rows.withColumn("sure", F.filter(scored, lambda x: x["s"] >= F.element_at(limits, x["k"] + 1)))
    spans = let(F.col("sure"), lambda sure: F.when(F.size(sure) > 0, F.array_sort(F.concat("base", best_apart(sure)))).otherwise(F.col("base")))
    return rows.select(*out, "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:begin:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["b"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced together. The text is
    cut at every CHUNK spans, so that no span is counted off from the text's beginning."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def part(c, first, last):
        def filled(own):
            def step(a, x):
                before = F.substring(own, a["at"] - first + 1, x["b"] - a["at"])
                return F.struct(F.when(x["b"] >= a["at"], F.concat(a["out"], before, F.element_at(names, x["k"] + 1))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["e"]).alias("at"))

            return F.aggregate(c, F.struct(F.lit("").alias("out"), first.alias("at")), step)["out"]

        return let(F.substring(text, first + 1, last - first), filled)

    def whole(parts, reach):
        every = F.transform(parts, lambda c, i: part(c, F.coalesce(F.get(reach, i - 1), F.lit(0)), F.get(reach, i)))
        return F.concat(F.array_join(every, ""), F.substring(text, F.get(reach, F.size(reach) - 1) + 1, F.length(text)))

    # up to where each chunk of spans reaches, all before included
    reach = lambda parts: running(F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda a, x: F.greatest(a, x["e"]))), larger)
    return F.when(F.size(spans) > 0, let(chunks(spans), lambda p: let(reach(p), lambda r: whole(p, r)))).otherwise(text)


def digest(rows: DataFrame) -> DataFrame:
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(find(docs, fit(docs), carry=["doc_id"]))
