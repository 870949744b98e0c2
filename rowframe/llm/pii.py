"""Personal data: base patterns, and candidates selected by boosted trees; DataFrame expressions only.

*Base.*  Four fixed patterns, leftmost and non-overlapping per kind, each with its check. *Candidates.*  Generators of
high recall, several of a kind, propose further spans, which may overlap. Features of a candidate's format and context go
to gradient-boosted trees (fitted on the driver from a bounded, generated sample, compiled to CASE expressions) whose
calibrated probability has to reach its kind's threshold, set on held-out texts of another generator. A candidate that
overlaps a base span, or a better candidate, is left out; base spans stay.

Positions are code points, end exclusive. Matches and the pieces between them come from one pattern each; prefix sums of
their lengths are the positions. Texts that no pattern can match are passed over by one scan.
"""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowframe.llm.boosting import BoostedTrees
from rowframe.llm.rows import brought_back, set_aside

#: Kinds, in the order of ties.
KINDS = ("email", "ip", "card", "phone")
#: Share of right candidates that a kind's threshold has to give, and generated texts to fit and to set thresholds by.
PRECISION, TRAINING_TEXTS, HELD_OUT_TEXTS = 0.98, 900, 600
#: A threshold that no probability reaches.
NEVER = 2.0

# The base patterns, made linear for long inputs: a match starts at the start of its run, runs are possessive, and a
# first pass turns dots (or separators) that cannot belong to a match into another character of the same length.
_EMAIL_DOTS = r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\."
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.)[A-Za-z0-9.-]++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD_GAPS = r"(?<![0-9])[ -]|[ -](?![0-9])"
_CARD = r"[0-9][0-9 -]{13,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# Generators beyond the base: kind and pattern. Spans of different generators overlap, also of one kind.
_LOCAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+"
_WIDE = (
    ("email", _LOCAL + r" ?(?:[(\[{] ?at ?[)\]}]|@) ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]++){1,126}"),
    ("email", _LOCAL + r" at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++){1,126}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"),
    ("card", r"[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}"),
    ("card", r"(?<![0-9])[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}(?![0-9])"),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    ("phone", r"(?<![0-9.-])\(?0[0-9]{1,4}\)?[ /.-][0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"),
)
#: What a text must hold for a generator to run, in the order of _WIDE.
_NEEDS = (
    r"@|[(\[{] ?at ?[)\]}]",
    r" at [A-Za-z0-9-]++ dot ",
    r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    r"[0-9A-Fa-f]::[0-9A-Fa-f]",
    r"[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}",
    r"[0-9]{4}[ .-][0-9]{6}[ .-]",
    r"[0-9]{3}[ .-][0-9]{4}",
    r"0[0-9]{1,4}\)?[ /.-][0-9]{2}",
)
_WORDS_NEAR = r"(?i)(?:tel|phone|call|ring|mobile|fax|cell|card|visa|credit|debit|amex|mail|contact|reach|ip|host|server|addr\w*)[^\w]{0,3}(?:\w{1,6}[^\w]{1,2})?$"

_SPAN = "struct<start: int, rank: int, end: int, text: string>"
#: Code points of a block of a text, and entries of a block of a running sum: work in a long text stays near its length.
_BLOCK, _STEP = 1024, 128


def blocks_of(text: Column) -> Column:
    """The text in blocks, in which positions are found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive; both inside the text)."""
    first, last = F.floor(start / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")
    at, piece = start - first * _BLOCK, lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    whole = F.when(last - first <= 1, F.lit("")).otherwise(F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""))
    across = F.concat(F.substring(piece(first), at + 1, F.lit(_BLOCK)), whole, F.substring(piece(last), F.lit(1), end - last * _BLOCK))
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(piece(first), at + 1, end - start)).otherwise(across)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once, however often the body (and its lambdas) name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op, zero: int) -> Column:
    """op over the values up to each place (array<int>), in blocks: one array is not copied for every entry."""
    top = lambda a, default: F.coalesce(F.get(a, F.size(a) - 1), default)
    none = F.array().cast("array<int>")

    def of(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / _STEP).cast("int"))
        return let(F.transform(places, lambda b: F.aggregate(F.slice(values, b * _STEP + 1, F.lit(_STEP)), none, lambda acc, x: F.concat(acc, F.array(op(top(acc, F.lit(zero)), x))))), joined)

    def joined(inner: Column) -> Column:
        outer = F.aggregate(inner, F.array(F.lit(zero)), lambda acc, part: F.concat(acc, F.array(op(top(acc, F.lit(zero)), top(part, F.lit(zero))))))
        return F.flatten(F.zip_with(inner, F.slice(outer, 1, F.size(inner)), lambda part, base: F.transform(part, lambda x: op(base, x))))

    return let(values, of)


def _matches(blocks: Column, source: Column, pattern: str, rank: int) -> Column:
    """array of _SPAN: all matches in ``source`` (as long as the text of ``blocks``, character by character)."""
    found = F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    between = F.transform(F.split(source, pattern, -1), lambda b: F.length(b))

    def spans(sizes: Column) -> Column:
        # the piece after the last match has no match and is left out
        ends = running(F.zip_with(sizes, F.slice(between, 1, F.size(sizes)), lambda m, b: m + b), lambda a, x: a + x, 0)
        return F.zip_with(ends, sizes, lambda e, n: F.struct((e - n).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), cut(blocks, e - n, e).alias("text")))

    return let(found, spans)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits (at most a few dozen) pass the Luhn check."""

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(k % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid_ip(t: Column) -> Column:
    def part(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare).between(1, 3), bare.cast("int")).otherwise(0) <= 255)

    return F.forall(F.split(t, r"\."), part)


def _valid_card(t: Column) -> Column:
    d = _digits(t)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def _valid_phone(t: Column) -> Column:
    return F.length(_digits(t)).between(10, 15)


def _base_kinds(text: Column, blocks: Column) -> list[Column]:
    """arrays of _SPAN: the base spans of each kind."""
    none = F.array().cast(f"array<{_SPAN}>")

    def of(needs: Column, spans: Column) -> Column:
        return F.when(needs, spans).otherwise(none)

    return [
        of(text.contains("@"), _matches(blocks, F.regexp_replace(text, _EMAIL_DOTS, "_"), _EMAIL, 0)),
        of(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), F.filter(_matches(blocks, text, _IP, 1), lambda s: _valid_ip(s["text"]))),
        of(text.rlike(_CARD), F.filter(_matches(blocks, F.regexp_replace(text, _CARD_GAPS, "_"), _CARD, 2), lambda s: _valid_card(s["text"]))),
        of(text.contains("+"), F.filter(_matches(blocks, text, _PHONE, 3), lambda s: _valid_phone(s["text"]))),
    ]


# -------------------------------------------------------------------------------------------------------- candidates


def _generated(text: Column, blocks: Column) -> list[Column]:
    """arrays of _SPAN: what each generator proposes; spans of different generators may overlap."""
    none = F.array().cast(f"array<{_SPAN}>")
    return [F.when(text.rlike(need), _matches(blocks, text, pattern, KINDS.index(kind))).otherwise(none) for (kind, pattern), need in zip(_WIDE, _NEEDS, strict=True)]


def features(blocks: Column, span: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    own, digits = span["text"], _digits(span["text"])
    before = cut(blocks, F.greatest(span["start"] - 24, F.lit(0)), span["start"])
    after = F.coalesce(cut(blocks, span["end"], span["end"] + 2), F.lit(""))
    number = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        span["rank"].cast("double"),
        F.length(digits).cast("double"),
        F.length(own).cast("double"),
        F.length(F.regexp_replace(own, "[A-Za-z0-9]", "")).cast("double"),
        F.size(F.split(own, r"[^0-9]+", -1)).cast("double"),
        number(own.startswith("+")),
        number(own.contains("(")),
        F.when((span["rank"] == 2) & F.length(digits).between(13, 19), number(luhn(digits))).otherwise(-1.0),
        number(own.contains("@")),
        number(own.rlike(r"(?i)[(\[{] ?at ?[)\]}]")),
        number(before.rlike(r"[\w=\"'@./:+-]$")),
        number(after.rlike(r"^[\w=\"'@/:-]|^[.][0-9]")),
        number(before.rlike(_WORDS_NEAR)),
        number(own.rlike(r"@ | @|\. | \.")),
        number(own.rlike(r" at .* dot (?:com|org|net|edu|gov|io|info|[a-z]{2})$")),
        number(own.rlike(r"^\(?0")),
    ]


def _training_texts(n: int, seed: int = 23) -> list[tuple[str, list[str]]]:
    """Generated texts and the true spans' strings in each."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("er", "an", "th", "on", "re", "la", "in", "que", "sch", "os")) for _ in range(rng.randint(1, 4)))
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        body = rng.choice("3456") + d(14)
        for check in "0123456789":
            total = sum((v if k % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v)) for k, v in enumerate(map(int, reversed(body + check))))
            if (total % 10 == 0) == good:
                body += check
                break
        return body if rng.random() < 0.5 else rng.choice(" -.").join(body[k : k + 4] for k in range(0, 16, 4))

    def amex() -> str:
        while True:
            c = rng.choice(("34", "37")) + d(13)
            if sum((v if k % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v)) for k, v in enumerate(map(int, reversed(c)))) % 10 == 0:
                return rng.choice(" -.").join((c[:4], c[4:10], c[10:]))

    def local() -> str:
        return rng.choice((f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"(0{d(3)}) {d(3)} {d(4)}", f"0{d(3)}/{d(3)} {d(3)}", f"0{d(1)}-{d(4)}-{d(4)}"))

    def phone() -> str:
        a, b, c = rng.choice("23456789") + d(2), d(3), d(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}"))

    def hidden_mail() -> str:
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")))
        return f"{word()}{rng.choice(('', '.' + d(2), d(1)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net'))}"

    yes = (
        lambda: ("", phone(), ""),
        lambda: (rng.choice(("tel ", "phone: ", "call ")), phone(), ""),
        lambda: ("", phone(), " " + card(True)),
        lambda: ("", hidden_mail(), ""),
        lambda: (rng.choice(("mail ", "contact: ")), hidden_mail(), ""),
        lambda: ("", card(True), ""),
        lambda: (rng.choice(("card ", "visa: ")), card(True), ""),
        lambda: ("", ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), ""),
        lambda: ("", "::".join(":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(rng.randint(1, 3))) for _ in range(2)), ""),
        lambda: (rng.choice(("", "mail ", "write to ")), f"{word()}.{word()} at {word()} dot {rng.choice(('com', 'org', 'net', 'de'))}", ""),
        lambda: (rng.choice(("", "mail ")), f"{word()} at {word()} dot {rng.choice(('com', 'org', 'info', 'net'))}", ""),
        lambda: ("", amex(), ""),
        lambda: (rng.choice(("", "tel ", "phone: ")), local(), ""),
    )
    no = (
        lambda: f"{d(3)}-{d(3)}-{d(4)}-{d(4)}",
        lambda: f"id={d(3)}.{d(3)}.{d(4)}",
        lambda: f"{d(6)}{d(3)}-{d(3)}-{d(4)}{d(2)}",
        lambda: f"/{d(3)}-{d(3)}-{d(4)}",
        lambda: card(False),
        lambda: f"{d(12)}{d(9)}",
        lambda: f'"{d(16)}{word()}"',
        lambda: f"no.{d(13)}",
        lambda: f"{word()} @ {word()}. {word().title()}",
        lambda: f"@{word()}. {word()}",
        lambda: f"{word()}@{word()}. {word().title()}",
        lambda: f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}",
        lambda: f"{d(2)}.{d(3)} {d(3)} {d(4)}",
        lambda: f"{word()} at {word()} dot {word()}",
        lambda: f"std::{word()}::{word()} {d(2)}::{d(2)}::{d(2)}",
        lambda: f"{d(4)}-{d(6)}-{d(5)}-{d(3)}",
        lambda: f"0{d(1)}.{d(2)}.{rng.randint(1900, 2030)}",
        lambda: f"0{d(2)}/{d(3)}",
        lambda: f"0.{d(3)} 0.{d(3)} 0.{d(4)}",
    )
    out = []
    for k in range(n):
        left, right = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(5))
        if k % 2:
            lead, span, tail = rng.choice(yes)()
            out.append((f"{left} {lead}{span}{tail} {right}", [span, tail.strip()]))
        else:
            out.append((f"{left} {rng.choice(no)()} {right}", []))
    return out


def held_out_texts(n: int, seed: int = 71) -> list[tuple[str, list[str]]]:
    """Labelled texts of another make than the training's: other words around, other forms, several spans in a text."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    names = "anna ben carla dieter elena felix greta hugo ines jan karl lena".split()
    fill = "please see the notes below und dann weiter para la reunion du mois en order number ref invoice total on page".split()

    def with_check(body: str) -> str:
        return next(body + c for c in "0123456789" if sum((v if k % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v)) for k, v in enumerate(map(int, reversed(body + c)))) % 10 == 0)

    def parted(number: str, sign: str, at: tuple[int, ...]) -> str:
        return sign.join(number[a:b] for a, b in zip((0, *at), (*at, len(number)), strict=True))

    card = with_check("5" + d(14))
    yes = (
        lambda: f"{rng.choice(names)}_{rng.choice(names)}[at]{rng.choice(names)}shop[dot]{rng.choice(('net', 'info'))}",
        lambda: f"{rng.choice(names)}{d(2)} (at) mail (dot) {rng.choice(names)} (dot) org",
        lambda: f"{rng.choice(names)} at {rng.choice(names)}mail dot com",
        lambda: f"1-{rng.choice('23456789')}{d(2)}-{d(3)}-{d(4)}"[2:],
        lambda: f"({rng.choice('23456789')}{d(2)}) {d(3)}-{d(4)}",
        lambda: f"0{rng.choice('123456789')}{d(2)} {d(3)} {d(3)}",
        lambda: parted(with_check("4" + d(14)), ".", (4, 8, 12)),
        lambda: parted(with_check("37" + d(12)), "-", (4, 10)),
        lambda: f"2001:db8::{rng.randrange(4096, 65536):x}:{rng.randrange(4096, 65536):x}",
    )
    no = (
        lambda: f"SKU-{d(4)}-{d(4)}-{d(4)}-{d(4)}",
        lambda: f"{rng.randint(10, 31)}.{rng.randint(10, 12)}.{rng.randint(1990, 2030)} {d(2)}:{d(2)}",
        lambda: f"v{d(1)}.{d(1)}.{d(3)}-{d(3)}-{d(4)}",
        lambda: f"{rng.choice(names)} was at home dot",
        lambda: f"{d(1)}.{d(3)}.{d(3)},{d(2)}",
        lambda: f"#{d(3)}-{d(3)}-{d(4)}-{d(2)}",
        lambda: f"sha1={''.join(rng.choice('0123456789abcdef') for _ in range(40))}",
        lambda: f"see @{rng.choice(names)}. {rng.choice(names).title()} said",
        lambda: f"std::vector::at({d(2)})",
        lambda: f"{d(9)}{card}{d(3)}",
    )
    out = []
    for _ in range(n):
        parts, truth = [], []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choices(fill, k=rng.randint(2, 7))
            if rng.random() < 0.5:
                truth.append(rng.choice(yes)())
                parts.append(truth[-1] + rng.choice(("", "", ",", ".")))
            else:
                parts.append(rng.choice(no)())
        out.append((" ".join([*parts, *rng.choices(fill, k=2)]), truth))
    return out


def _labelled(texts: list[tuple[str, list[str]]]) -> list[tuple[list[float], int]]:
    """Features and truth of all candidates, by the same expressions as in use, in a fixed order."""
    spark = SparkSession.active()
    sample = [{"text": t, "truth": s} for t, s in texts]
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(sample)), "array<struct<text: string, truth: array<string>>>")).alias("r")).select("r.*", blocks_of(F.col("r.text")).alias("blocks"))
    found = rows.select("truth", "blocks", F.explode(F.concat(*_generated(F.col("text"), F.col("blocks")))).alias("c"))
    got = found.select(F.array(*features(F.col("blocks"), F.col("c"))).alias("x"), F.array_contains("truth", F.col("c.text")).cast("int").alias("y")).collect()
    return sorted((list(r["x"]), r["y"]) for r in got)


@lru_cache(maxsize=1)
def _fitted() -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and each kind's threshold, fitted once a driver process.

    A kind's threshold is the least probability from which held-out candidates of another make are right in PRECISION
    of all cases, 0.5 at least; a kind that does not get there has no candidates selected.
    """
    rows = _labelled(_training_texts(TRAINING_TEXTS))
    random.Random(4).shuffle(rows)
    trees = BoostedTrees([r[0] for r in rows], [r[1] for r in rows])
    held = [(int(x[0]), trees.probability(x), y) for x, y in _labelled(held_out_texts(HELD_OUT_TEXTS))]
    thresholds = []
    for kind in range(len(KINDS)):
        own = sorted(((p, y) for k, p, y in held if k == kind), reverse=True)
        least, right = NEVER, 0
        for n, (p, y) in enumerate(own, 1):
            right += y
            if p >= 0.5 and right >= PRECISION * n and (n == len(own) or own[n][0] < p):
                least = min(least, p)
        thresholds.append(least)
    return trees, tuple(thresholds)


def _first_place(spans: Column, inside) -> Column:
    """The first place (from 0) whose span is not ``inside``, which holds up to some place and then no more."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        more = F.coalesce(inside(F.get(spans, middle)), F.lit(False)) & (acc["lo"] < acc["hi"])
        return F.struct(F.when(more, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(more, acc["hi"]).otherwise(F.least(middle, acc["hi"])).alias("hi"))

    return F.aggregate(steps, start, step, lambda acc: acc["lo"])


def _meets(spans: Column, c: Column) -> Column:
    """Whether one of the spans, in order and apart from each other, overlaps c."""
    return F.coalesce(F.get(spans, _first_place(spans, lambda s: s["end"] <= c["start"]))["start"] < c["end"], F.lit(False))


def _better(a: Column, b: Column) -> Column:
    return (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["by"] < b["by"]))))


def _beaten(others: Column, c: Column) -> Column:
    """Whether a better candidate of one generator overlaps c."""
    lo = _first_place(others, lambda s: s["end"] <= c["start"])
    hi = _first_place(others, lambda s: s["start"] < c["end"])
    return F.exists(F.slice(others, lo + 1, F.greatest(hi - lo, F.lit(0))), lambda o: _better(o, c))


def find_pii(docs: DataFrame, text_column: str = "text", thresholds: Sequence[float] | None = None) -> DataFrame:
    """``docs`` plus base_spans and spans (arrays of struct<start, rank, end, text>, sorted; rank: place in KINDS).

    A candidate counts if its probability reaches its kind's threshold (``thresholds``; fitted ones by default) and it
    overlaps no base span and no better candidate. Null and empty texts have no spans; a text is read whole, in time
    that grows about as its length does; rows that repeat are read each by itself; an empty table stays empty. Clashing
    columns of ``docs`` give way.
    """
    trees, fitted = _fitted()
    least = F.array(*[F.lit(float(t)) for t in (thresholds or fitted)])
    hidden = ["__text", "__blocks", "__candidates", "__good", *[f"__base{k}" for k in range(len(KINDS))]]
    text, blocks = F.col("__text"), F.col("__blocks")
    none = F.array().cast(f"array<{_SPAN}>")
    suspect = text.rlike("[0-9@:]|[(\\[{] ?at ?[)\\]}]| at ")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base_spans", "spans", *hidden)], F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("__text"))
    out = own.withColumn("__blocks", F.when(suspect, blocks_of(text)))
    out = out.withColumns({f"__base{k}": F.when(suspect, c).otherwise(none) for k, c in enumerate(_base_kinds(text, blocks))})
    bases = [F.col(f"__base{k}") for k in range(len(KINDS))]
    struct = lambda k: lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(k).alias("by"), c.alias("span"))
    proposed = F.concat(*[F.transform(spans, struct(k)) for k, spans in enumerate(_generated(text, blocks))])
    apart = F.filter(proposed, lambda c: ~reduce(lambda a, b: a | b, [_meets(b, c) for b in bases]))
    out = out.withColumn("__candidates", F.when(suspect, apart))
    scored = F.transform("__candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["by"].alias("by"), c["span"].alias("span"), trees.column(features(blocks, c["span"])).alias("p")))
    out = out.withColumn("__good", F.filter(scored, lambda c: c["p"] >= F.get(least, c["span"]["rank"])))
    parts = [F.filter("__good", lambda c, k=k: c["by"] == k) for k in range(len(_WIDE))]
    kept = F.filter("__good", lambda c: ~reduce(lambda a, b: a | b, [_beaten(part, c) for part in parts]))
    added = F.coalesce(F.when(F.size("__good") > 0, F.transform(kept, lambda c: c["span"])), none)
    out = out.withColumn("base_spans", F.sort_array(F.concat(*bases)))
    return out.withColumn("spans", F.sort_array(F.concat("base_spans", added))).drop(*hidden)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first span, as in [EMAIL]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def of(both: Column) -> Column:
        blocks, until = both["blocks"], both["until"]
        before = lambda k: F.coalesce(F.get(until, k - 1), F.lit(0))
        opens = F.filter(F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), before(k).alias("from"), ((k == 0) | (s["start"] >= before(k))).alias("first"))), lambda r: r["first"])
        pieces = F.transform(opens, lambda r: F.concat(cut(blocks, r["from"], r["start"]), F.get(names, r["rank"])))
        return F.concat(F.array_join(pieces, ""), cut(blocks, F.get(until, F.size(until) - 1), F.length(text)))

    until = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), 0)
    return F.when(F.size(spans) > 0, let(F.struct(blocks_of(text).alias("blocks"), until.alias("until")), of)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with their personal data replaced, with the columns they came with; n_chars follows the text.

    Null and empty texts, rows that repeat, an empty table and columns of any name pass as they are.
    """
    found = find_pii(set_aside(docs, "text"))
    changed = F.size("spans") > 0
    out = found.withColumn("text", F.when(changed, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__own.n_chars"))
    return brought_back(out, docs.columns, **new)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's counts and digests of find_pii() for all documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
