"""Personal data in texts: certain spans by pattern, further ones by boosted trees.

Base spans are those of four patterns whose matches pass a check. Further generators,
wide on purpose, propose spans that may overlap: spelled-out addresses, colon-joined
hexadecimal groups, digit groups of cards and phones in other dress. Gradient-boosted
trees score each by its format and its context; a kind's threshold is the lowest score
from which on the proposals of a held-out half are right. What passes and overlaps no
base span is added, of overlapping ones the best.

Only built-in functions work on texts. A position is the running sum of the lengths of
what lies between matches, which ``split`` gives, and of the matches before.

No table has labelled spans, so the trees learn from sentences made by rule, with their
spans known (:func:`examples`); ``train`` takes others.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]"
_AT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20(?:at|AT)\x20|\x20?@\x20?)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)"
_HEX = "[0-9A-Fa-f]{1,4}"

#: The base patterns, written so that no run of characters is gone over twice: a match
#: starts where a run does, or where the last match ended, and loops give nothing back.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: What proposes further spans, and of which kind.
PROPOSALS = {
    "spelled": ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+{_AT}{_LABEL}{{1,63}}+(?:{_DOT}{_LABEL}{{1,63}}+)++"),
    "groups": ("ip", rf"(?<![0-9A-Za-z:.])(?:{_HEX}:){{1,7}}:?{_HEX}(?::{_HEX}){{0,6}}(?![0-9A-Za-z:])"),
    "number": ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20./-][0-9]{4}){3}|[0-9]{4}[\x20./-][0-9]{6}[\x20./-][0-9]{5})(?![0-9])"),
    "national": ("phone", r"(?<![0-9A-Za-z])(?:\+?1[\x20.-]?)?(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "dialled": ("phone", r"(?<![0-9A-Za-z])(?:\+\x20?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}(?![0-9A-Za-z])"),
}

#: A text without a match of its guard has none of the pattern, which is dearer.
_GUARDS = {"email": "@", "spelled": r"@|\b(?:at|AT)\b", "groups": "[0-9A-Fa-f]:"}

#: Characters of a proposal's surroundings that the trees look at.
CONTEXT = 24

#: Parts of a text's matches whose positions are added up together.
RUN = 256


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether up to 19 digits pass Luhn's check; any others are false."""
    padded = F.lpad(number, 19, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    # From the right, every second digit counts double.
    places = [F.substring(doubled if (19 - i) % 2 else padded, i, 1).cast("int") for i in range(1, 20)]
    total = places[0]
    for p in places[1:]:
        total = total + p
    return F.when(F.length(number).between(1, 19), total % 10 == 0).otherwise(False)


def passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(digits(match))).otherwise(False)


# --- spans ----------------------------------------------------------------------


def running_sums(numbers: Column) -> Column:
    """The sum of an array up to each of its elements, run by run.

    An array that grows by an element at a time is copied each time; in runs that is
    little even for a text with very many matches.
    """
    nothing = F.array().cast("array<long>")
    start = F.struct(F.lit(0).cast("long").alias("sum"), nothing.alias("sums"))

    def add(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        return F.struct(total.alias("sum"), F.concat(acc["sums"], F.array(total)).alias("sums"))

    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN).cast("int")),
        lambda i: F.aggregate(F.slice(numbers, i * RUN + 1, RUN), start, add),
    )
    before = F.aggregate(runs, start, lambda acc, run: add(acc, run["sum"]))["sums"]
    summed = F.zip_with(runs, before, lambda run, upto: F.transform(run["sums"], lambda x: x + upto - run["sum"]))
    return F.when(F.size(numbers) > 0, F.flatten(summed)).otherwise(nothing)


def _proposed(docs: DataFrame, text: str) -> DataFrame:
    """A row per match of every generator, one with nulls for a text without any.

    The text goes; of its columns the others stay.
    """
    patterns = {k: (k, p) for k, p in BASE.items()} | PROPOSALS
    rest = [c for c in docs.columns if c != text]
    found = docs.withColumns(
        {
            f"found_{name}": F.when(
                F.col(text).rlike(_GUARDS.get(name, "[0-9]")), F.regexp_extract_all(text, F.lit(p), F.lit(0))
            ).otherwise(F.array().cast("array<string>"))
            for name, (_, p) in patterns.items()
        }
    )
    # Of what lies between the matches, only its length and its ends are kept.
    piece = "array<struct<n:long,head:string,tail:string>>"
    shaped = found.select(
        *rest,
        *[f"found_{name}" for name in patterns],
        *[
            F.when(
                F.size(f"found_{name}") > 0,
                F.transform(
                    F.split(text, p, -1),
                    lambda x: F.struct(
                        F.length(x).cast("long").alias("n"), F.left(x, F.lit(CONTEXT)).alias("head"), F.right(x, F.lit(CONTEXT)).alias("tail")
                    ),
                ),
            )
            .otherwise(F.array().cast(piece))
            .alias(f"between_{name}")
            for name, (_, p) in patterns.items()
        ],
    )

    def step(name: str) -> Column:
        matches, between = F.col(f"found_{name}"), F.col(f"between_{name}")
        return F.transform(
            matches, lambda _, i: F.get(between, i)["n"] + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0).cast("long")
        )

    placed = shaped.withColumns({f"start_{name}": running_sums(step(name)) for name in patterns})

    def spans(name: str, kind: str) -> Column:
        starts, between = F.col(f"start_{name}"), F.col(f"between_{name}")
        return F.transform(
            f"found_{name}",
            lambda m, i: F.struct(
                F.lit(name).alias("generator"),
                F.lit(kind).alias("kind"),
                F.get(starts, i).alias("start"),
                (F.get(starts, i) + F.length(m)).alias("end"),
                m.alias("match"),
                F.get(between, i)["tail"].alias("before"),
                F.get(between, i + 1)["head"].alias("after"),
            ),
        )

    every = F.concat(*[spans(name, kind) for name, (kind, _) in patterns.items()])
    return placed.select(*rest, F.explode_outer(every).alias("span")).select(*rest, "span.*")


# --- features -------------------------------------------------------------------

# Words before a number that say what it is.
CONTEXT_WORDS = (
    ("phone", "tel|telefon|phone|call|fax|mobile|cell|whatsapp|sms"),
    ("card", "card|visa|mastercard|amex|credit|debit|cc"),
    ("mail", "mail|e-mail|email|contact|write|correo|courriel"),
    ("host", "ip|ipv6|host|server|address"),
    ("other", "order|invoice|no|nr|id|page|pages|version|isbn|date|chapter|line|lines|figure|ref|batch|serial|part"),
)
COMMON_ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu"


def _among(flags: Sequence[Column]) -> Column:
    """The place, from 1, of the first that holds, else 0."""
    out = F.lit(0)
    for i, flag in reversed(list(enumerate(flags, 1))):
        out = F.when(flag, i).otherwise(out)
    return out


def features() -> dict[str, Column]:
    """Small whole numbers of a proposal's format and context."""
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    number = digits(match)
    groups = F.regexp_replace(F.regexp_replace(match, "[0-9]+", "9"), "[^9]", "")
    return {
        "generator_no": _among([F.col("generator") == g for g in PROPOSALS]),
        "n_digits": F.least(F.length(number), F.lit(20)),
        "n_letters": F.least(F.length(F.regexp_replace(match, "[^A-Za-z]", "")), F.lit(12)),
        "n_groups": F.least(F.length(groups), F.lit(9)),
        "first_group": F.least(F.length(F.regexp_extract(match, "[0-9]+", 0)), F.lit(9)),
        "last_group": F.least(F.length(F.regexp_extract(match, "[0-9]+$", 0)), F.lit(9)),
        "n_colons": F.least(F.length(F.regexp_replace(match, "[^:]", "")), F.lit(8)),
        "separator": _among(
            [match.rlike(p) for p in (r"[\[{]|\((?:at|AT)", " (?:dot|DOT) ", "@", "/", r"\(", "-", " ", r"\.")]
        ),
        "plus": match.startswith("+").cast("int"),
        "zero": match.startswith("0").cast("int"),
        "checked": luhn(number).cast("int"),
        "year": match.rlike("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])").cast("int"),
        "ending": match.rlike(rf"(?i)[^A-Za-z](?:{COMMON_ENDINGS})$").cast("int"),
        "context": _among([before.rlike(rf"(?i)\b(?:{words})\b[^\p{{L}}0-9]*$") for _, words in CONTEXT_WORDS]),
        "next_to": _among([before.rlike(p) for p in ("[0-9]$", r"[\p{L}]$", r"[$€£#§=/_.,:-]$")]),
        "followed_by": _among([after.rlike(p) for p in (r"^[\p{L}0-9]", "^ ?[%€$£°]", "^[/_=:-]", r"^\.[0-9]")]),
    }


FEATURES = tuple(
    "generator_no n_digits n_letters n_groups first_group last_group n_colons separator plus zero checked year "
    "ending context next_to followed_by".split()
)


# --- boosted trees --------------------------------------------------------------


@dataclass(frozen=True)
class Split:
    """Below: values of ``feature`` up to ``upto``. A leaf is a number."""

    feature: int
    upto: int
    below: Split | float
    above: Split | float


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple
    #: Lowest accepted score by kind; infinite where none is good enough.
    thresholds: dict[str, float]

    def score(self) -> Column:
        """The log-odds, as an expression over :data:`FEATURES`."""

        def value(node) -> Column:
            if not isinstance(node, Split):
                return F.lit(float(node))
            return F.when(F.col(FEATURES[node.feature]) <= node.upto, value(node.below)).otherwise(value(node.above))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + value(tree)
        return total

    def score_of(self, row: Sequence[int]) -> float:
        total = self.bias
        for node in self.trees:
            while isinstance(node, Split):
                node = node.below if row[node.feature] <= node.upto else node.above
            total += node
        return total


def boost(cells: list[tuple], rounds: int = 60, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> tuple[float, tuple]:
    """Newton boosting of the logistic loss on (features, label, weight) cells.

    Histograms of gradients: features are small whole numbers, so each value is a bin.
    """
    rows = [c[0] for c in cells]
    labels, weights = [c[1] for c in cells], [c[2] for c in cells]
    share = (sum(y * w for y, w in zip(labels, weights)) + 1) / (sum(weights) + 2)
    bias = math.log(share / (1 - share))
    scores, trees = [bias] * len(rows), []

    def grow(members: list[int], gradient: list[float], curve: list[float], levels: int):
        g, h = sum(gradient[i] for i in members), sum(curve[i] for i in members)
        leaf = -rate * g / (h + penalty)
        if not levels:
            return leaf
        best = (1e-6, None, None)
        for f in range(len(FEATURES)):
            bins: dict[int, list[float]] = {}
            for i in members:
                held = bins.setdefault(rows[i][f], [0.0, 0.0])
                held[0] += gradient[i]
                held[1] += curve[i]
            left_g = left_h = 0.0
            for value in sorted(bins)[:-1]:
                left_g, left_h = left_g + bins[value][0], left_h + bins[value][1]
                right_g, right_h = g - left_g, h - left_h
                gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - g**2 / (h + penalty)
                if gain > best[0]:
                    best = (gain, f, value)
        _, f, value = best
        if f is None:
            return leaf
        low = [i for i in members if rows[i][f] <= value]
        high = [i for i in members if rows[i][f] > value]
        return Split(f, value, grow(low, gradient, curve, levels - 1), grow(high, gradient, curve, levels - 1))

    for _ in range(rounds):
        chances = [1 / (1 + math.exp(-s)) for s in scores]
        gradient = [w * (p - y) for p, y, w in zip(chances, labels, weights)]
        curve = [w * p * (1 - p) for p, w in zip(chances, weights)]
        tree = grow(list(range(len(rows))), gradient, curve, depth)
        trees.append(tree)
        one = Model(0.0, (tree,), {})
        scores = [s + one.score_of(r) for s, r in zip(scores, rows)]
    return bias, tuple(trees)


def calibrate(scored: list[tuple[float, int, int]], precision: float) -> float:
    """The lowest score from which on at least ``precision`` of (score, label, weight) are right.

    Never one that speaks against a span, however few there are of those.
    """
    threshold, right, all_ = math.inf, 0, 0
    by_score: dict[float, list[int]] = {}
    for score, label, weight in scored:
        held = by_score.setdefault(score, [0, 0])
        held[0] += label * weight
        held[1] += weight
    for score in sorted(by_score, reverse=True):
        right, all_ = right + by_score[score][0], all_ + by_score[score][1]
        if right < precision * all_:
            break
        threshold = max(score, 0.0)
    return threshold


#: Proposals of so many labelled texts are learned from, half of them for the thresholds.
TRAINING_TEXTS = 6_000
PRECISION = 0.99


def train(labelled: DataFrame, texts: int = TRAINING_TEXTS, precision: float = PRECISION) -> Model:
    """Trees and thresholds from rows (example, text, kind, start, end), at most ``texts`` of them.

    ``kind`` null: the text has no span. Its other spans are not. Rows beyond the bound
    are left out by a hash of their number. Equal proposals are counted together, so
    what the driver learns from is bounded by ``texts`` as well.
    """
    n = labelled.count()
    if n > texts:
        kept = F.pmod(F.xxhash64("example"), F.lit(n)) < texts
        labelled = labelled.filter(kept).limit(texts)
    given = labelled.select(
        (F.pmod(F.xxhash64("example"), F.lit(2)) == 1).alias("held_out"),
        "text",
        *[F.col(c).alias(f"true_{c}") for c in ("kind", "start", "end")],
    )
    proposed = _proposed(given, "text").filter(F.col("generator").isin(*PROPOSALS))
    same = [F.col(c) == F.col(f"true_{c}") for c in ("kind", "start", "end")]
    right = F.coalesce(same[0] & same[1] & same[2], F.lit(False)).cast("int")
    cells = (
        proposed.select("held_out", "kind", right.alias("right"), *[c.alias(n) for n, c in features().items()])
        .groupBy("held_out", "kind", "right", *FEATURES)
        .count()
        .collect()
    )
    cells = sorted((c.held_out, c.kind, tuple(c[f] for f in FEATURES), c.right, c["count"]) for c in cells)
    bias, trees = boost([c[2:] for c in cells if not c[0]])
    raw = Model(bias, trees, {})
    thresholds = {
        kind: calibrate([(raw.score_of(c[2]), *c[3:]) for c in cells if c[0] and c[1] == kind], precision) for kind in KINDS
    }
    return Model(bias, trees, thresholds)


# --- labelled examples ----------------------------------------------------------

# Neutral words, and names of hosts.
NEUTRAL = "and the of to in on with for at from by it was is so then der die und la le les el los que des".split()
HOSTS = "mail example post shop office uni home data web corp".split()


def with_check_digit(number: str) -> str:
    """``number`` and the digit that makes it pass Luhn's check."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(number)))
    return number + str(-total % 10)


def _fill(rnd: random.Random, shape: str) -> str:
    """Each ``#`` a digit, ``~`` a digit from 2, ``x`` a hexadecimal one."""
    return "".join(
        rnd.choice("0123456789") if c == "#" else rnd.choice("23456789") if c == "~" else rnd.choice("0123456789abcdef") if c == "x" else c
        for c in shape
    )


def _personal(rnd: random.Random) -> tuple[str, str]:
    """Kind and text of a span, in a form that the base patterns miss or may miss."""
    kind = rnd.choice(KINDS)
    if kind == "phone":
        shapes = (
            "+1 (~##) ###-####", "(~##) ###-####", "~##-###-####", "~##.###.####", "1-~##-###-####",
            "+49 30 ########", "+33 1 ## ## ## ##", "+34 ### ### ###", "0## ### ####", "0###/######", "01 ## ## ## ##",
        )
        return kind, _fill(rnd, rnd.choice(shapes))
    if kind == "card":
        number = with_check_digit(rnd.choice("3456") + _fill(rnd, "#" * rnd.choice((12, 14, 14, 14, 17))))
        if len(number) == 16 and rnd.random() < 0.6:
            number = rnd.choice(" .-/").join(number[i : i + 4] for i in range(0, 16, 4))
        return kind, number
    if kind == "ip":
        if rnd.random() < 0.5:
            return kind, ":".join(_fill(rnd, "xxxx") for _ in range(8))
        return kind, "2001:" + ":".join(_fill(rnd, "x" * rnd.randrange(1, 5)) for _ in range(rnd.randrange(2, 5))) + "::" + _fill(rnd, "xxx")
    name = "".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randrange(3, 9))) + rnd.choice(("", ".", "_")) + _fill(rnd, rnd.choice(("", "##")))
    name = name.rstrip("._") or "ab"
    at, dot = rnd.choice(((" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), (" @ ", "."), ("[at]", "."), (" (at) ", " (dot) ")))
    return kind, name + at + rnd.choice(HOSTS) + dot + rnd.choice(("com", "org", "net", "de", "fr"))


def _harmless(rnd: random.Random) -> str:
    """A number or a phrase that some generator may propose."""
    shapes = (
        "20##-0~-1#", "1#.0~.20##", "0~/1#/19##", "1#:3#:4#", "1#:##", "1.~.#.#.#", "1##-2##", "12 ### ###", "3 ### ### ###",
        "10 20 3# 4#", "#####-####", "978-3-##-######-#", "xx:xx:xx:xx:xx:xx", "~#.####-1#.####", "pp. ##-##", "19##-20##", "~#,### - ~#,###",
        "##/##", "# 5## 000", "20## 20## 20##", "1#.5-1#.8", "##-##-##",
    )
    if rnd.random() < 0.2:
        number = _fill(rnd, rnd.choice("123456789") + "#" * rnd.randrange(12, 18))
        good = with_check_digit(number)
        number = good[:-1] + str((int(good[-1]) + rnd.randrange(1, 10)) % 10)
        if len(number) == 16 and rnd.random() < 0.3:
            number = rnd.choice(" -").join(number[i : i + 4] for i in range(0, 16, 4))
        return number
    if rnd.random() < 0.25:
        return rnd.choice(
            ("look at example.com", "stay at home.Then", "seen at noon.It", "are at www.shop.org", "meet at office dot", "one at post.de", "is at 10.30", "sat at it.And")
        )
    return _fill(rnd, rnd.choice(shapes))


def examples(seed: int = 12, n: int = TRAINING_TEXTS) -> list[tuple]:
    """Rows (example, text, kind, start, end): neutral words around a span or a harmless number."""
    rnd = random.Random(seed)
    # Words that announce a number, by kind.
    said = {
        "phone": ("tel.", "phone:", "call", "Telefon", "fax"), "card": ("card", "visa", "credit card:"), "ip": ("host", "ip", "server"),
        "email": ("mail:", "contact", "write to"), None: ("order", "page", "no.", "version", "date", "isbn", "ref", "invoice"),
    }
    out = []
    for i in range(n):
        kind, span = _personal(rnd) if rnd.random() < 0.5 else (None, _harmless(rnd))
        lead = " ".join(rnd.choice(NEUTRAL) for _ in range(rnd.randrange(0, 6)))
        if rnd.random() < 0.4:
            lead = f"{lead} {rnd.choice(said[kind])}".strip()
        lead = f"{lead} " if lead else ""
        tail = rnd.choice((" ", ". ", ", ")) + " ".join(rnd.choice(NEUTRAL) for _ in range(rnd.randrange(0, 6)))
        if rnd.random() < 0.15:
            tail = " " + with_check_digit(_fill(rnd, "4" + "#" * 14)) + tail
        out.append((i, lead + span + tail, kind, len(lead) if kind else None, len(lead) + len(span) if kind else None))
    return out


def trained(spark: SparkSession, seed: int = 12, texts: int = TRAINING_TEXTS) -> Model:
    """The model learned from :func:`examples`."""
    rows = spark.createDataFrame(examples(seed, texts), "example long, text string, kind string, start long, end long")
    return train(rows, texts)


# --- documents ------------------------------------------------------------------


def find(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: its id, and its ``spans``, an array by kind, then start.

    A span has ``kind``, ``start`` and ``end`` in code points (end exclusive), whether
    it is ``base``, and its ``score`` (null for base). Base spans of different kinds may
    overlap; an added one overlaps no other span. Null and empty texts have no spans.
    Rows of one id, or without, are each a row. Other columns are not read.
    """
    given = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    proposed = _proposed(given, "text")
    base = F.lit(False)
    for kind in KINDS:
        base = F.when(F.col("generator") == kind, passes(kind, F.col("match"))).otherwise(base)
    further = F.col("generator").isin(*PROPOSALS)
    judged = proposed.withColumns({"base": base} | {n: F.when(further, c) for n, c in features().items()})
    enough = F.lit(False)
    for kind, least in model.thresholds.items():
        if least < math.inf:
            enough = enough | ((F.col("kind") == kind) & (F.col("score") >= least))
    scored = judged.select(
        "id", "row", "kind", "start", "end", "base", F.when(further, model.score()).alias("score")
    ).withColumn("keep", F.col("base") | (F.col("score").isNotNull() & enough))
    # One row per text stays, spans or not.
    scored = scored.select(
        "id", "row", *[F.when(F.col("keep"), F.col(c)).alias(c) for c in ("kind", "start", "end", "base", "score")]
    )
    by_start = Window.partitionBy("row").orderBy("start")
    upto = by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    held = scored.withColumn(
        "covered",
        ~F.col("base")
        & (
            F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(upto) > F.col("start"), F.lit(False))
            | F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after) < F.col("end"), F.lit(False))
        ),
    )
    # Overlapping additions form a chain, and its best stays.
    added = ~F.col("base") & ~F.col("covered")
    earlier = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("reach", F.max(F.when(added, F.col("end"))).over(earlier))
    opens = added & (F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    chain = F.sum(F.when(opens, 1).otherwise(0)).over(
        Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    best = Window.partitionBy("row", "added", "chain").orderBy(F.col("score").desc(), (F.col("end") - F.col("start")).desc(), "start", "kind")
    held = held.withColumns({"chain": chain, "added": added}).withColumn("place", F.row_number().over(best))
    kept = F.col("base") | (F.col("added") & (F.col("place") == 1))
    span = F.struct(_among([F.col("kind") == k for k in KINDS]).alias("no"), "start", "end", "kind", "base", "score")
    return (
        held.groupBy("row")
        .agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(kept, span))).alias("spans"))
        .select(
            F.col("id").alias(doc_id),
            F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base", "score")])).alias("spans"),
        )
    )


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans of :func:`find`, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        doc_id,
        *[F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(text: Column, spans: Column, mark: str = "*") -> Column:
    """``text`` with every character of its spans replaced by ``mark``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def cover(so_far: Column, s: Column) -> Column:
        n = (s["end"] - s["start"]).cast("int")
        return F.overlay(so_far, F.lpad(F.lit(""), n, mark), (s["start"] + 1).cast("int"), n)

    return F.aggregate(ordered, text, cover)
