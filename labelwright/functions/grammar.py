"""What article codes look like: patterns, examples made from them, and a profile learnt from known codes."""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass, field
from functools import cached_property
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import char_class, normalize_code, plausible_token

#: Shapes of codes.
PATTERNS = (
    r"^[A-Z]{2}\d{6}$",
    r"^[A-Z]{2}\d{6}[A-Z]{1,2}\d{1,3}$",
    r"^[A-Z]{2}\d{6}[A-Z]{1,2}\d{1,3}-[A-Z]\d{1,2}$",
    r"^[A-Z]{1,3}\d{5,8}$",
)
MOST_EXAMPLES = 64
SMOOTHING = 0.5
LETTER, DIGIT, OTHER = range(3)
SHAPES = "LD-"
#: A bar between alternatives; the empty group before it keeps them from becoming one class of characters.
ALTERNATIVE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\|", re.S)


class Unsupported(ValueError):
    pass


def _one_of(items: list) -> str:
    if items and items[0][0] is sre.NEGATE:
        return "A"
    ranges = [(chr(v[0]).upper(), chr(v[1]).upper()) for op, v in items if op is sre.RANGE]
    single = [chr(v) for op, v in items if op is sre.LITERAL]
    digits = ("0", "9") in ranges
    letters = any(op is sre.CATEGORY for op, _ in items) or any(c.isalpha() for c in single) or any(a.isalpha() or b.isalpha() for a, b in ranges)
    if ("A", "Z") in ranges or (letters and not digits):
        return "A"
    if digits or any(c.isdecimal() for c in single) or any(a.isdecimal() for a, _ in ranges):
        return "0"
    return single[0] if single else ranges[0][0]


def _examples(tree) -> list[str]:  # noqa: ANN001
    made = [""]
    for op, value in tree:
        if op is sre.LITERAL:
            options = [chr(value)]
        elif op is sre.ANY:
            options = ["A"]
        elif op is sre.IN:
            known = {sre.CATEGORY_DIGIT: "0", sre.CATEGORY_WORD: "A", sre.CATEGORY_SPACE: " "}
            options = [known[value[0][1]]] if len(value) == 1 and value[0][0] is sre.CATEGORY and value[0][1] in known else [_one_of(value)]
        elif op is sre.BRANCH:
            options = [x for branch in value[1] for x in _examples(branch)]
        elif op is sre.SUBPATTERN and not value[1] and not value[2]:
            options = _examples(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            most = (2 if least == 0 else least + 1) if most is sre.MAXREPEAT else most
            unit = _examples(inner)
            options = [x for n in dict.fromkeys((least, most)) for x in ("".join(p) for p in itertools.islice(itertools.product(unit, repeat=n), MOST_EXAMPLES))]
        else:
            raise Unsupported(str(op))
        options = list(dict.fromkeys(options))
        made = [a + b for a, b in itertools.islice(itertools.product(made, options), MOST_EXAMPLES)]
    return made


def examples(pattern: str) -> list[str]:
    """Representative strings of a simple regular expression; none for one that has other constructs."""
    try:
        tree = list(sre_parse.parse(ALTERNATIVE.sub(lambda m: "()|" if m[0] == "|" else m[0], pattern.strip())))
        if tree and tree[0] == (sre.AT, sre.AT_BEGINNING):
            tree = tree[1:]
        if tree and tree[-1] == (sre.AT, sre.AT_END):
            tree = tree[:-1]
        if "?P<" in pattern or "?<" in pattern:
            raise Unsupported("named group")
        return [x for x in dict.fromkeys(_examples(tree)) if x][:MOST_EXAMPLES]
    except (Unsupported, re.error, OverflowError):
        return []


def class_of(char: str) -> int:
    return LETTER if char.isalpha() else DIGIT if char.isdecimal() else OTHER


@dataclass
class Grammar:
    """Patterns, the range of lengths, P(class | position) and P(class | class before). Small, hence sent to tasks whole."""

    patterns: tuple[str, ...] = PATTERNS
    least: int = 0
    most: int = 0
    profile: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def __post_init__(self) -> None:
        self.patterns = tuple(p.strip() for p in self.patterns if p and p.strip()) or PATTERNS
        if not len(self.profile):
            self._fill(*count_shapes([]), [])

    @property
    def examples(self) -> list[str]:
        return list(dict.fromkeys(x for p in self.patterns for x in examples(p)))

    def _fill(self, places: np.ndarray, moves: np.ndarray, lengths: list[int]) -> None:
        own_places, own_moves = count_shapes(self.examples)
        known = lengths or [len(x) for x in self.examples]
        self.least = max(3, min(known, default=6))
        self.most = max(self.least, max(known, default=16))
        depth = max(self.most, len(places), len(own_places))
        counts = np.full((depth, 3), SMOOTHING)
        counts[: len(places)] += places
        counts[: len(own_places)] += own_places
        steps = SMOOTHING + moves + own_moves
        self.profile = counts / counts.sum(1, keepdims=True)
        self.transition = steps / steps.sum(1, keepdims=True)

    @classmethod
    def learn(cls, codes: DataFrame, patterns: tuple[str, ...] = PATTERNS, column: str = "code") -> Grammar:
        """From a table of codes: two small aggregations, whatever its size."""
        own = cls(patterns)
        shaped = codes.select(normalize_code(F.col(column)).alias("code")).filter("code <> ''").select(F.length("code").alias("n"), classes(F.col("code")).alias("classes"))
        sizes = shaped.agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
        if sizes["a"] is None:
            return own
        places, moves = np.zeros((sizes["b"], 3)), np.zeros((3, 3))
        for r in shaped.select(F.posexplode("classes").alias("at", "cls")).groupBy("at", "cls").count().collect():
            places[r["at"], r["cls"]] = r["count"]
        for r in shaped.select(F.explode(pairs_of(F.col("classes"))).alias("p")).groupBy("p.before", "p.cls").count().collect():
            moves[r["before"], r["cls"]] = r["count"]
        own._fill(places, moves, [sizes["a"], sizes["b"]])
        return own

    @cached_property
    def _compiled(self) -> list[re.Pattern]:
        return [re.compile(p) for p in self.patterns]

    def valid(self, code: str) -> bool:
        for p in self._compiled if code else ():
            if p.search(code):
                return True
        return False

    def valid_column(self, code: Column) -> Column:
        hit = F.lit(False)
        for p in self.patterns:
            hit = hit | code.rlike(p)
        return F.coalesce((code != "") & hit, F.lit(False))

    def plausible_column(self, token: Column) -> Column:
        return plausible_token(token, self.least, self.most)

    def prior(self, position: int, cls: int) -> float:
        return float(self.profile[min(position, len(self.profile) - 1), cls])

    def shape(self) -> str:
        return "".join(SHAPES[int(np.argmax(row))] for row in self.profile)

    def log_likelihood(self, code: str) -> float:
        kinds = [class_of(c) for c in code]
        if not kinds:
            return -math.inf
        return sum(math.log(self.prior(i, k)) for i, k in enumerate(kinds)) + sum(math.log(self.transition[a, b]) for a, b in zip(kinds, kinds[1:]))

    def log_likelihood_column(self, code: Column) -> Column:
        """The same as an expression over literal tables."""
        table = lambda rows: F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])
        profile, transition = table(np.log(self.profile)), table(np.log(self.transition))
        kinds = classes(code)
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        at = F.transform(kinds, lambda k, i: F.get(F.get(profile, F.least(i, F.lit(len(self.profile) - 1))), k))
        step = F.transform(pairs_of(kinds), lambda p: F.get(F.get(transition, p["before"]), p["cls"]))
        return F.when(F.length(code) > 0, total(at) + total(step)).otherwise(F.lit(-math.inf))


def classes(code: Column) -> Column:
    """Classes of a code's characters in order."""
    return F.when(F.length(code) > 0, F.transform(F.split(code, ""), char_class)).otherwise(F.array().cast("array<int>"))


def pairs_of(kinds: Column) -> Column:
    """Each class but the first with the one before it."""
    count = F.size(kinds)
    made = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: F.struct(F.get(kinds, i - 1).alias("before"), F.get(kinds, i).alias("cls")))
    return F.when(count > 1, made).otherwise(F.array().cast("array<struct<before:int,cls:int>>"))


def count_shapes(codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    places, moves = np.zeros((max(map(len, codes), default=0), 3)), np.zeros((3, 3))
    for code in codes:
        kinds = [class_of(c) for c in code]
        np.add.at(places, (np.arange(len(kinds)), kinds), 1)
        np.add.at(moves, (kinds[:-1], kinds[1:]), 1)
    return places, moves
