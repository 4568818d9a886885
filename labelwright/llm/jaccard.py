"""N-gram Jaccard join: links between documents whose word 5-gram sets have a Jaccard similarity of 0.8 or more.

Candidates come from prefixes under several global orders of the tokens (word 5-grams, as 64-bit hashes). An order sorts
tokens by how common they are, then by a hash of its own. If sets of n and m tokens are linked, they share at least
ceil(0.8 n) tokens, so their first n - ceil(0.8 n) + k tokens of any one order share at least k. With k = 1 + n / 20:

1. tokens that are common are counted over all texts (counts only order tokens; any counts give the same links);
2. the prefixes under the first order are dealt by token and streamed in order: all sets with a token meet its least set,
   the pivot, and no list of sets is ever held. Sets that share too few prefix tokens with others are out, and the
   others meet again without them; then the set that shares most of its prefix is the pivot, as the middle of its group;
3. those left are read again; pairs (set, pivot) must share k prefix tokens under a second and a third order, then are
   verified on whole sets;
4. components of these links are found. What remains are pairs of one pivot in different components; the distances
   to the pivot (a metric) and the places of tokens in their prefixes exclude most, the rest pass the filters of step 3 and are verified. So no pair within a large
   group of near copies is made, and no link between components is lost.

Equal sets are one class from the start; its name is a 64-bit hash of the set, as are the tokens. A document with fewer
than five words has its whole sequence as one token. Null and empty texts have no tokens, and a component of their own:
their doc_id. Rows with equal doc_id are treated each; a null doc_id names no component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import SEED, STEP, Words, mixed

WORDS, PERCENT = 5, 80
#: Tokens that are counted as common, and in how many texts of a stretch of STRETCH tokens one must be to be counted.
COMMON, LOCAL, STRETCH = 1 << 18, 3, 4_000_000

def token_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text in ascending order, end to end, and where each text's begin (one more than texts)."""
    n = len(offsets) - 1
    found = Words(data, offsets)
    word, begin, counts = found.keys(), found.begin, found.counts
    del found
    owners, tokens = [], []
    for size in range(1, words + 1):
        at = np.arange(len(word) - words + 1) if size == words else begin[:-1][counts == size]
        at = at[: max(0, len(at))]
        if not len(at):
            continue
        owner = np.searchsorted(begin, at, "right") - 1
        if size == words:
            inside = at + words <= begin[owner + 1]
            at, owner = at[inside], owner[inside]
        token = np.full(len(at), np.uint64(size * int(SEED) % 2**64))
        for k in range(size):
            token = mixed(token + word[at + k]) * STEP
        owners.append(owner)
        tokens.append(token)
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    owner, token = np.concatenate(owners), np.concatenate(tokens)
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    owner, token = owner[new], token[new]
    return token, np.searchsorted(owner, np.arange(n + 1))


def least_shared(n: int) -> int:
    return -(-PERCENT * n // 100)


def shared_prefix(n: int) -> int:
    """k of the module's text for a set of n tokens."""
    return 1 + n // 20


def prefix_length(n: int) -> int:
    return min(n, n - least_shared(n) + shared_prefix(n))


class Orders:
    """Global orders: tokens that are not known to be common first, then rarer before more common; hashes decide the rest."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.level = tokens[order], np.minimum(127, 1 + np.log2(np.maximum(counts[order], 1)) * 4).astype(np.uint64)

    def ranks(self, tokens: np.ndarray, which: int) -> np.ndarray:
        out = tokens if which == 1 else mixed(tokens * np.uint64(2 * which + 1) + np.uint64(which * int(SEED) % 2**64))
        out = out >> np.uint64(1)
        if len(self.tokens):
            near = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            hit = self.tokens[near] == tokens
            out[hit] = (np.uint64(1) << np.uint64(63)) | (self.level[near[hit]] << np.uint64(56)) | (out[hit] >> np.uint64(7))
        return out

    def prefix(self, tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The prefix of one set (ascending tokens), in its order."""
        return tokens[np.argsort(ranks, kind="stable")[: prefix_length(len(tokens))]]


def common_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON tokens found in most texts, with counts over all texts of stretches where they are not rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts >= LOCAL], counts[counts >= LOCAL]
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "n"])

        for whole in batches:
            for batch in common.slices(whole):
                held.append(token_sets(*common.text_bytes(batch.column("text")))[0])
                if sum(map(len, held)) >= STRETCH:
                    yield counted()
                    held = []
        if held:
            yield counted()
            held = []
        common.released()

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "token long, n long")
    top = found.groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    return top.column("token").to_numpy().view(np.uint64).copy(), top.column("n").to_numpy().copy()


def prefixes(docs: DataFrame, orders: Orders, row: str | None = None) -> DataFrame:
    """doc_id, row (that column if named), key, n, cls, the first order's prefix, its length and its last rank; the prefix only for the first of equal sets that a task sees."""
    sent = docs.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in common.slices(whole):
                tokens, begin = token_sets(*common.text_bytes(batch.column("text")))
                ranks = sent.value.ranks(tokens, 1)
                n, names, kept, last = np.diff(begin), [], [], []
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                    name = xxhash.xxh3_64_intdigest(tokens[a:b].tobytes()) - 2**63 if b > a else None
                    names.append(name)
                    last.append(int(np.partition(ranks[a:b], prefix_length(b - a) - 1)[prefix_length(b - a) - 1]) >> 1 if b > a else None)
                    if name is None or name in seen:
                        kept.append(None)
                    else:
                        seen.add(name)
                        kept.append(sent.value.prefix(tokens[a:b], ranks[a:b]).tobytes())
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("key"), pa.array(n.astype(np.int64)), pa.array(names, pa.int64()), pa.array(kept, pa.binary()), pa.array([prefix_length(x) for x in n.tolist()], pa.int64()), pa.array(last, pa.int64())], ["doc_id", "row", "key", "n", "cls", "prefix", "p", "last"])
        common.released()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), common.text_key().alias("key"), (F.col(row) if row else F.lit(0).cast("long")).alias("row")).mapInArrow(run, "doc_id long, row long, key long, n long, cls long, prefix binary, p long, last long")


def meetings(prefixed: DataFrame) -> DataFrame:
    """cls, pivot, shared: in how many prefix tokens' lists a set met that pivot; a pivot of a list of two sets or more also meets itself.
    first: the first place (from 0) that such a token has in the set's prefix.

    The pivot of a list is its first set by the column `place`, if there is one, then by name.
    """
    placed = "place" in prefixed.columns

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "prefix"):
                data, offsets = common.text_bytes(batch.column("prefix"))
                tokens = data.view(np.int64) if len(data) else np.zeros(0, np.int64)
                size = np.diff(offsets) // 8
                position = np.arange(len(tokens)) - np.repeat(offsets[:-1] // 8, size)
                names = ["token", "position", "cls", "place"] if placed else ["token", "position", "cls"]
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(position.astype(np.int32)), *(pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in names[2:])], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = pivot = last = None  # of the list that the batch before ended in
        pivot_at = 0  # the place of its token in its pivot
        met = False  # whether its pivot has met itself
        for batch in batches:
            if not batch.num_rows:
                continue
            t, c, position = (batch.column(name).to_numpy() for name in ("token", "cls", "position"))
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            new[0] = t[0] != token
            at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            pivots = np.where(at >= 0, c[np.maximum(at, 0)], pivot if pivot is not None else 0)
            own_at = np.where(at >= 0, position[np.maximum(at, 0)], pivot_at)
            fresh = c != pivots
            fresh[1:] &= (c[1:] != c[:-1]) | new[1:]
            if not new[0] and c[0] == last:
                fresh[0] = False
            rows = np.flatnonzero(fresh)
            lists, firsts = np.unique(at[rows], return_index=True)
            own = rows[firsts]
            if met and len(lists) and lists[0] == -1:
                own = own[1:]
            cls = np.concatenate([c[rows], pivots[own]])
            with_ = np.concatenate([pivots[rows], pivots[own]])
            where = np.concatenate([position[rows], own_at[own]])
            met = bool((at[rows] == at[-1]).any()) or (met and at[-1] == -1)
            token, pivot, last, pivot_at = t[-1], pivots[-1], c[-1], own_at[-1]
            if len(cls):
                order = np.lexsort((with_, cls))
                cls, with_, where = cls[order], with_[order], where[order]
                edge = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | (with_[1:] != with_[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(cls[edge]), pa.array(with_[edge]), pa.array(np.diff(np.append(edge, len(cls)))), pa.array(np.minimum.reduceat(where, edge).astype(np.int32))], ["cls", "pivot", "shared", "first"])

    more = ["place"] if placed else []
    rows = prefixed.filter("prefix is not null").select("cls", "prefix", *more).mapInArrow(spread, "token long, position int, cls long" + ", place long" * placed)
    dealt = rows.repartition(common.partitions(prefixed.sparkSession), "token").sortWithinPartitions("token", *more, "cls")
    met = dealt.select("token", "position", "cls").mapInArrow(stream, "cls long, pivot long, shared long, first int")
    return met.groupBy("cls", "pivot").agg(F.sum("shared").alias("shared"), F.min("first").alias("first"))


def found_by(doc_id: Column, key: Column) -> Column:
    """Where a text is found again: by its doc_id, or without one by its key."""
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, key).alias("at")).alias("rep")


def whole_sets(docs: DataFrame, classes: DataFrame, orders: Orders) -> DataFrame:
    """cls, n, tokens and the second and third orders' prefixes (32 bits a token) of the classes (cls, rep)."""
    sent = docs.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole):
                tokens, begin = token_sets(*common.text_bytes(batch.column("text")))
                ranks = {k: sent.value.ranks(tokens, k) for k in (2, 3)}
                rows = []
                for cls, a, b in zip(batch.column("cls").to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                    own = tokens[a:b]
                    if b > a and xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63 == cls:
                        rows.append((cls, b - a, own.tobytes(), *(np.unique(sent.value.prefix(own, ranks[k][a:b]).astype(np.uint32)).tobytes() for k in (2, 3))))
                names = ("cls", "n", "tokens", "second", "third")
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names)
        common.released()

    texts = docs.select(found_by(F.col("doc_id").cast("long"), common.text_key()), F.col("text").cast("string").alias("text")).select("rep.*", "text")
    texts = texts.join(common.small(classes.select("cls", "rep.*")), ["none", "at"])
    return texts.select("cls", "text").mapInArrow(run, "cls long, n long, tokens binary, second binary, third binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with low and high bounds of their distance, and whether they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, links = [], [], []
            columns = [batch.column(c) for c in ("a_tokens", "b_tokens", "a_second", "b_second", "a_third", "b_third")]
            for row in range(batch.num_rows):
                a, b, *prefix = (np.frombuffer(c[row].as_buffer(), np.uint64 if i < 2 else np.uint32) for i, c in enumerate(columns))
                k = min(shared_prefix(len(a)), shared_prefix(len(b)))
                if any(_shared(x, y) < k for x, y in (prefix[:2], prefix[2:])):
                    low.append(1 - PERCENT / 100)
                    high.append(1.0)
                    links.append(False)
                    continue
                both = _shared(a, b)
                union = len(a) + len(b) - both
                low.append(1 - both / union)
                high.append(low[-1])
                links.append(100 * both >= PERCENT * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(links, pa.bool_())], ["a", "b", "low", "high", "linked"])

    def with_sets(rows: DataFrame, side: str) -> DataFrame:
        """The same exchange of sets serves both sides."""
        own = ("tokens", "second", "third")
        joined = rows.withColumn("cls", F.col(side)).join(sets.select("cls", *own), "cls")
        return joined.select(*rows.columns, *(F.col(c).alias(f"{side}_{c}") for c in own))

    return with_sets(with_sets(pairs.select("a", "b"), "a"), "b").mapInArrow(run, "a long, b long, low double, high double, linked boolean")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def may_link(a: Column, b: Column) -> Column:
    """Whether sizes and prefixes of two sets (n, last, alone, first) allow that they are linked and that the first token
    they share, of all in the order, is in a list of the pivot that `first` is about.

    Linked sets share at least `least` tokens, so the first of them is not farther in either set than n - least. All
    tokens of a prefix that ends before the other one's end are in that other prefix or not in that set at all; so a
    set shares at most its n tokens but for those of its prefix that are in no other prefix.
    """
    sizes = F.lit(100) * F.least(a["n"], b["n"]) >= F.lit(PERCENT) * F.greatest(a["n"], b["n"])
    least = F.ceil(F.lit(PERCENT) * (a["n"] + b["n"]) / F.lit(100 + PERCENT))
    most = F.when(a["last"] < b["last"], a["n"] - a["alone"]).when(a["last"] > b["last"], b["n"] - b["alone"]).otherwise(F.least(a["n"], b["n"]))
    return sizes & (most >= least) & (a["first"] <= a["n"] - least) & (b["first"] <= b["n"] - least)


def links(docs: DataFrame, made: DataFrame, orders: Orders) -> DataFrame:
    """Links (u, v) between classes whose components are those of all links. Discards `made`."""
    sizes = made.filter("cls is not null").groupBy("cls").agg(F.max("n").alias("n"), F.min(found_by(F.col("doc_id"), F.col("key"))).alias("rep"), F.max("p").alias("p"), F.max("last").alias("last"))
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * PERCENT / 100) / 20)

    def sharing(met: DataFrame, of: DataFrame) -> DataFrame:
        """Classes that share enough prefix tokens for a link, and how many they don't share with any other."""
        counted = met.groupBy("cls").agg(F.sum("shared").alias("shared")).join(of.select("cls", "n", "rep", "p", "last"), "cls")
        return counted.filter(F.col("shared") >= least).select("cls", "n", "rep", "p", "last", (F.col("p") - F.col("shared")).alias("alone"))

    # Twice: no class that cannot be linked is a pivot then, and of a list the one that shares most of its prefix is.
    first = common.materialise(sharing(meetings(made), sizes), "classes")
    place = common.small(first.select("cls", F.floor(F.col("alone") * 1000 / F.col("p")).cast("long").alias("place")))
    met = common.materialise(meetings(made.filter("prefix is not null").join(place, "cls")), "meetings")
    common.discard(made)
    alive = common.materialise(sharing(met, first), "classes")
    sets = common.materialise(whole_sets(docs, alive, orders), "sets")
    if sets.groupBy("cls").count().filter("count > 1").limit(1).count():  # rows that repeat a doc_id, or a text without one
        sets = common.materialise(sets.dropDuplicates(["cls"]), "sets")
    facts = ("n", "last", "alone")
    known = alive.select("cls", F.struct(*facts).alias("own"))
    members = met.select("cls", "pivot", "first").join(known, "cls").withColumn("own", F.col("own").withField("first", F.col("first"))).drop("first")
    pivots = members.filter("cls = pivot").select("pivot", F.col("own").alias("its"))
    members = members.join(pivots, "pivot", "left")
    stars = members.filter((F.col("cls") != F.col("pivot")) & may_link(F.col("own"), F.col("its")))
    tried = common.materialise(verified(stars.select(F.col("cls").alias("a"), F.col("pivot").alias("b")), sets), "stars")
    found = tried.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(found)
    # Members of one pivot that are in different components; a pivot itself has met all of them.
    measured = (
        members.filter(F.col("cls") != F.col("pivot"))
        .join(tried.select(F.col("a").alias("cls"), F.col("b").alias("pivot"), "low", "high"), ["cls", "pivot"], "left")
        .join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
        .select("pivot", "cls", "own", F.coalesce("root", "cls").alias("root"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))
    )
    measured = common.materialise(measured, "measured")
    several = measured.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("pivot")
    rest = measured.join(several, "pivot", "left_semi")
    a, b = (rest.select("pivot", *(F.col(c).alias(f"{s}_{c}") for c in ("cls", "own", "root", "low", "high"))) for s in "ab")
    reach = 1 - PERCENT / 100 + 1e-9
    near = (F.col("a_low") - F.col("b_high") <= reach) & (F.col("b_low") - F.col("a_high") <= reach)
    pairs = a.join(b, (a["pivot"] == b["pivot"]) & (F.col("a_root") < F.col("b_root")) & may_link(F.col("a_own"), F.col("b_own")) & near)
    pairs = pairs.select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b")).distinct()
    more = verified(pairs, sets).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = common.materialise(more, "links")
    common.discard(sets)
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)


def components_of(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, row, n, root) and components of more than one row (root, best: that row of it which stays)."""
    orders = Orders(*common_tokens(docs))
    made = common.materialise(prefixes(docs, orders, row), "prefixes")
    short = common.materialise(made.select("doc_id", "row", "n", "cls"), "documents")
    roots = common.materialise(components(links(docs, made, orders)).withColumnRenamed("node", "cls"), "roots")
    rows = common.materialise(short.join(common.small(roots), "cls", "left").withColumn("root", F.coalesce("root", "cls")).drop("cls"), "rows")
    common.discard(short)
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("best")
    groups = rows.filter("root is not null").groupBy("root").agg(best, F.count("*").alias("size")).filter("size > 1").drop("size")
    common.swept(docs.sparkSession)
    return rows, common.materialise(groups, "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, groups = components_of(docs)
    return rows.join(common.small(groups), "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one row, the one with the smallest doc_id (null last), with all its columns; rows without words stay.
    Decided row by row, whatever doc_ids repeat."""
    own, row = common.numbered(docs, "documents")
    rows, groups = components_of(own, row)
    gone = rows.join(common.small(groups), "root").filter(F.col("row") != F.col("best.row")).select(F.col("row").alias(row))
    return own.join(common.small(common.materialise(gone, "gone")), row, "left_anti").select(docs.columns)
