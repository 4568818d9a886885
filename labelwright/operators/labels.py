"""Label text to fields. Only the match of key words runs in Arrow batches; values and merges are expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.confusion import Confusion
from ..functions.metrics import distances
from .guess import SYMBOLS

WORDS = f"array<struct<pos:int,text:string,conf:double,line:int,symbols:{SYMBOLS}>>"
#: Keys and what they are written as, in the order they are tried.
KEYS = {
    "Quality": ("QUALITY", "QUALITV"), "Color": ("COLOR", "COLOUR"), "Customer": ("CUSTOMER",), "Batch": ("BATCH",), "Roll": ("ROLL",), "Width": ("WIDTH",),
    "Quantity": ("QTY", "QUANTITY"), "Gross": ("GROSS",), "Net": ("NET",), "Weight": ("WEIGHT",), "Free": ("FREE",), "PoNo": ("PONO", "PONUMBER"),
    "BpOrderNo": ("BPORDERNO", "ORDERNO"), "Article": ("ARTICLE", "ARTICLENO", "ART"), "Remark": ("REMARK", "REMARKS"), "Date": ("DATE",),
}
ALIASES = tuple(alias for own in KEYS.values() for alias in own)
TOLERANCE = 0.30
#: Ends what stands for a word that is mostly a number, which is no key unless it is spelt like one.
NUMERIC = "#"
READ_AS = str.maketrans("1058", "IOSB")
A_DATE = re.compile(r"20[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}")
#: Confidence of the words of plain text.
PLAIN = 0.6
#: Columns that hold codes, and columns that hold text, with their keys.
CODES = {"quality": "Quality", "customer": "Customer", "batch": "Batch", "roll": "Roll", "po_no": "PoNo", "bp_order_no": "BpOrderNo", "article": "Article"}
TEXTS = {"width": "Width", "quantity": "Quantity", "gross": "Gross", "net": "Net", "weight": "Weight", "free": "Free", "remark": "Remark"}
STRINGS = ("quality", "color_code", "customer", "batch", "roll", "barcode", "width", "quantity", "gross", "net", "weight", "free", "po_no", "bp_order_no", "article", "color_name", "remark", "date")
NUMBERS = ("width_cm", "quantity_m", "gross_kg", "net_kg", "gsm", "weight_consistency")


def words_of_text(text: Column, confidence: float = PLAIN) -> Column:
    """Words of plain text; blank lines count as lines."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), "\n")
    word = lambda w, line: F.struct(F.lit(0).alias("pos"), w.alias("text"), F.lit(confidence).alias("conf"), line.alias("line"), F.lit(None).cast(SYMBOLS).alias("symbols"))
    made = F.flatten(F.transform(lines, lambda s, line: F.transform(F.filter(F.split(s, "[ \t]+"), lambda w: w != ""), lambda w: word(w, line))))
    return F.transform(made, lambda w, i: w.withField("pos", i)).cast(WORDS)


class KeyMatcher:
    """Finds keys in a line of key letters; each word is compared with the aliases once."""

    def __init__(self, model: Confusion | None = None, tolerance: float = TOLERANCE):
        self.model, self.tolerance = model or Confusion(), tolerance
        self.known: dict[str, str | None] = {"": None, "PONO": "PoNo"}
        self.prices: dict[tuple[str, str], float] = {}
        self.lettered: dict[str, str] = {}

    def letters(self, word: str | None) -> str:
        """The letters of a word as T.letters_key has them. One of more digits than letters that ends in three, such as a batch number, is a value
        however near a key it comes, unless it is spelt like a key: its first letter stands for it, and NUMERIC."""
        known = self.lettered.get(word)
        if known is not None:
            return known
        kept = [c for c in word or "" if c.isalpha() or c.isdecimal()]
        out = "".join(kept).upper().translate(READ_AS)
        if 2 * sum(c.isdecimal() for c in kept) > len(kept) > 2 and all(c.isdecimal() for c in kept[-3:]) and out not in ALIASES:
            return out[0] + NUMERIC
        if len(self.lettered) > 200_000:
            self.lettered.clear()
        self.lettered[word] = out
        return out

    def close(self, words: list[str], aliases: list[str]) -> list[list[bool]]:
        """For each word, which aliases it stands for; all that need a distance are measured together."""
        near = [(w, a) for a, own in zip(aliases, self.in_reach(words, aliases)) for w in own]
        reach = dict(zip(near, distances([w for w, _ in near], [a for _, a in near], self.model)))
        return [[a == w or reach.get((w, a), 99.0) / max(len(a), len(w)) <= self.tolerance for a in aliases] for w in words]

    def least(self, char: str, alias: str) -> float:
        """The least that a character costs against any of an alias; a swap costs two characters."""
        if (char, alias) not in self.prices:
            self.prices[char, alias] = min([self.model.transpose_cost / 2, self.model.drop(char), *(self.model.substitution(char, x) for x in alias)])
        return self.prices[char, alias]

    def in_reach(self, words: list[str], aliases: list[str]) -> list[list[str]]:
        """For each alias of more than three characters the other words, of about its length, whose characters' least costs don't exceed the tolerance."""
        out: list[list[str]] = [[] for _ in aliases]
        long = [len(a) for a in aliases if len(a) > 3]
        words = [w for w in words if w and long and min(long) - 2 <= len(w) <= max(long) + 2]
        if not words:
            return out
        place = {c: i + 1 for i, c in enumerate(dict.fromkeys("".join(words)))}
        size = np.array([len(w) for w in words])
        letters = np.zeros((len(words), size.max()), np.int64)
        letters[np.arange(size.max()) < size[:, None]] = [place[c] for w in words for c in w]
        for found, alias in zip(out, aliases):
            if len(alias) > 3:
                least = np.array([0.0, *(self.least(c, alias) for c in place)])
                near = (np.abs(size - len(alias)) <= 2) & (least[letters].sum(1) <= self.tolerance * np.maximum(size, len(alias)) + 1e-9)
                found += [words[i] for i in np.flatnonzero(near).tolist() if words[i] != alias]
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Finds the keys of words not met before: the first whose alias a word is, or is near enough."""
        if len(self.known) > 500_000:
            self.known = {"": None, "PONO": "PoNo"}
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        names = [name for name, own in KEYS.items() for _ in own]
        for begin in range(0, len(new), 20_000):
            part = [w for w in new[begin : begin + 20_000] if not w.endswith(NUMERIC)]
            near = [(w, i) for i, own in enumerate(self.in_reach(part, list(ALIASES))) for w in own]
            far = distances([w for w, _ in near], [ALIASES[i] for _, i in near], self.model)
            hits = [(i, w) for (w, i), d in zip(near, far) if d / max(len(ALIASES[i]), len(w)) <= self.tolerance]
            listed = set(ALIASES) & set(part)
            self.known.update(dict.fromkeys(new[begin : begin + 20_000]))
            for i, word in sorted(hits + [(i, a) for i, a in enumerate(ALIASES) if a in listed], reverse=True):
                self.known[word] = names[i]

    def key(self, word: str) -> str | None:
        if word not in self.known:
            self.learn([word])
        return self.known[word]

    def match(self, line: list[str], at: int) -> tuple[str | None, int]:
        """The key that begins at a word, and its words."""
        here, second, third = (line[i] if i < len(line) else "" for i in (at, at + 1, at + 2))
        if here in ("PO", "PQ") and second in ("NO", "NQ"):
            return "PoNo", 2
        if here == "BP" and self.close([second], ["ORDER"])[0][0]:
            return "BpOrderNo", 3 if third.startswith("N") else 2
        return self.key(here), 1

    def spans(self, lines: list[int], words: list[str]) -> list[dict]:
        """Fields as line, key, first word (from 0) and number of words."""
        out: list[dict] = []
        at, now, own = 0, None, None
        while at < len(words):
            line, word, taken = lines[at], words[at], 1
            if line != now:
                now, own = line, None
            if word in ("PO", "PQ", "BP"):
                key, taken = self.match([words[i] for i in range(at, min(at + 3, len(words))) if lines[i] == line], 0)
            else:
                key = self.key(word)
            at += taken
            if key:
                own = {"line": line, "key": key, "start": at, "size": 0}
                out.append(own)
            elif own:
                own["size"] += 1
        return out


def key_words(words: DataFrame, word: str = "word", model: Confusion | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds `key`: the key that a word alone stands for, or null."""

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = KeyMatcher(model, tolerance)
        for letters in batches:
            own.learn(w for w in letters if w is not None)
            yield letters.map(lambda w: None if w is None else own.key(w))

    return words.withColumn("key", udf.asNondeterministic()(T.letters_key(F.col(word))))


def field_spans(lines: Column, words: Column, model: Confusion | None = None, tolerance: float = TOLERANCE) -> Column:
    """An array of line, key, start and size for words as they were read."""

    @F.pandas_udf("array<struct<line:int,key:string,start:int,size:int>>")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = KeyMatcher(model, tolerance)
        for numbers, texts in batches:
            read = [[own.letters(w) for w in t] if t is not None else [] for t in texts]
            own.learn(chain.from_iterable(read))
            yield pd.Series([own.spans(a.tolist(), b) if b else [] for a, b in zip(numbers, read)])

    return udf.asNondeterministic()(lines, words)


def text_fields(text: Column, model: Confusion | None = None, tolerance: float = TOLERANCE) -> Column:
    """`fields` of plain text, as with_fields has them for words_of_text."""
    names = list(KEYS)

    @F.pandas_udf("numbers array<int>, vals array<string>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, place = KeyMatcher(model, tolerance), {name: i for i, name in enumerate(names)}
        for texts in batches:
            split = [[(n, w) for n, line in enumerate((t or "").replace("\r", "").split("\n")) for w in line.replace("\t", " ").split(" ") if w] for t in texts]
            read = [[own.letters(w) for _, w in words] for words in split]
            own.learn(chain.from_iterable(read))
            numbers, values = [], []
            for words, letters in zip(split, read):
                spans = own.spans([n for n, _ in words], letters)
                numbers.append(np.array([x for s in spans for x in (s["line"], place[s["key"]], s["size"])], np.int32))
                values.append([field_text([w for _, w in words[s["start"] : s["start"] + s["size"]]]) for s in spans])
            yield pd.DataFrame({"numbers": numbers, "vals": values})

    found = udf.asNondeterministic()(text)
    key = F.array(*map(F.lit, names))
    total = lambda n: F.aggregate(F.array_repeat(F.lit(PLAIN), n), F.lit(0.0), lambda a, c: a + c)

    def made(x: Column, v: Column, i: Column) -> Column:
        n = F.get(x["numbers"], i * 3 + 2)
        return F.struct(F.get(x["numbers"], i * 3).alias("line"), F.get(key, F.get(x["numbers"], i * 3 + 1)).alias("key"), v.alias("value"), F.when(n > 0, total(n) / n).otherwise(0.0).alias("conf"), F.array().cast(SYMBOLS).alias("symbols"))

    # The result is bound by an array of one, so that Python runs once.
    return F.flatten(F.transform(F.array(found), lambda x: F.transform(x["vals"], lambda v, i: made(x, v, i))))


def field_text(words: list[str]) -> str:
    """T.field_value of one field."""
    return A_DATE.sub("", " ".join(words)).strip(" ").lstrip(T.LEADING).strip(" ")


def with_fields(rows: DataFrame, words: str = "words", model: Confusion | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds `fields`: line, key, value, conf and symbols of each field in order. Words are read by line, in order within it."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["line"].alias("line"), w["pos"].alias("pos"), w["text"].alias("text"), w["conf"].alias("conf"), w["symbols"].alias("symbols"))))
    spans = field_spans(F.transform("_words", lambda w: w["line"]), F.transform("_words", lambda w: w["text"]), model, tolerance)

    def made(s: Column) -> Column:
        own = F.slice(F.col("_words"), s["start"] + 1, s["size"])
        total = F.aggregate(own, F.lit(0.0), lambda a, w: a + w["conf"])
        symbols = F.flatten(F.filter(F.transform(own, lambda w: w["symbols"]), lambda x: x.isNotNull()))
        return F.struct(s["line"].alias("line"), s["key"].alias("key"), T.field_value(F.transform(own, lambda w: w["text"])).alias("value"), F.when(s["size"] > 0, total / s["size"]).otherwise(0.0).alias("conf"), symbols.alias("symbols"))

    return rows.withColumn("_words", ordered).withColumn("_spans", spans).withColumn("fields", F.transform("_spans", made)).drop("_spans", "_words")


def label_fields(rows: DataFrame, fields: str = "fields", words: str = "words", everything: Column | None = None) -> DataFrame:
    """Adds the fixed columns of a label, and raw_pairs. everything: the text, or else that of all words."""
    values = lambda key: F.filter(F.transform(F.filter(fields, lambda f: f["key"] == key), lambda f: F.trim(f["value"])), lambda v: v != "")
    first = lambda array: F.get(array, F.lit(0))
    clean = lambda key: first(F.filter(F.transform(values(key), T.clean_code), lambda v: v.isNotNull()))
    everything = F.concat_ws(" ", F.transform(words, lambda w: w["text"])) if everything is None else everything
    color = first(values("Color"))
    split = F.split(color, " +", 2)
    coded = first(split).rlike(r"\p{Nd}")
    name = F.when(coded, F.trim(F.get(split, F.lit(1)))).otherwise(color)
    rows = rows.withColumns(
        {column: clean(key) for column, key in CODES.items()}
        | {column: first(values(key)) for column, key in TEXTS.items()}
        | {
            "color_code": F.when(coded, T.clean_code(first(split))),
            "color_name": F.coalesce(name, F.get(values("Color"), F.lit(1))),
            "barcode": T.barcode(everything),
            "date": F.coalesce(first(values("Date")), T.iso_date(everything)),
            "raw_pairs": F.transform(fields, lambda f: F.struct(f["key"].alias("k"), f["value"].alias("v"))),
        }
    )
    rows = rows.withColumns({"width_cm": T.first_number(F.col("width")), "quantity_m": T.metres(F.col("quantity")), "gross_kg": T.first_number(F.col("gross")), "net_kg": T.first_number(F.col("net")), "gsm": T.first_number(F.col("weight"))})
    return rows.withColumn("weight_consistency", T.weight_consistency(F.col("gsm"), F.col("width_cm"), F.col("quantity_m"), F.col("net_kg")))


def parse_labels(texts: DataFrame, key: str = "req_id", model: Confusion | None = None) -> DataFrame:
    """key, `fields` and the columns of a label for each text."""
    rows = texts.select(key, "text").withColumn("fields", text_fields(F.col("text"), model)).withColumn("words", words_of_text(F.col("text")))
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))
    return label_fields(rows, everything=plain).select(key, "words", "fields", *STRINGS, *NUMBERS, "raw_pairs")


def fields_map(rows: DataFrame, name: str = "fields_map") -> DataFrame:
    """The text columns that aren't blank as a map."""
    every = F.create_map(*[x for c in STRINGS for x in (F.lit(c), F.col(c))])
    return rows.withColumn(name, F.map_filter(every, lambda _, v: v.isNotNull() & (F.trim(v) != "")))
