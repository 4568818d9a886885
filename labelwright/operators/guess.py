"""From observations to ranked candidates.

An observation (req_id, obs_no, text, source, conf, symbols) yields hypotheses: the code itself if it is known, known codes within
reach of the weighted distance, repairs, and the text as it stands. Each hypothesis has a weight; weights of a code add
up in a request; with a share for "none of these" they become probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.confusion import Confusion
from ..functions.grammar import Grammar
from ..functions.text import normalize_code
from . import answers
from .master import with_prior
from .reach import BROADCAST_CODES, within_reach
from .repair import RepairParams, repairs

SYMBOLS = "array<struct<ch:string,conf:double,choices:array<struct<ch:string,p:double>>>>"
OBSERVATION = f"req_id long, obs_no int, text string, source string, conf double, symbols {SYMBOLS}"


@dataclass(frozen=True)
class GuessParams:
    decay: float = 2.0
    most_distance: float = 0.45
    length_band: int = 3
    grammar_penalty: float = 0.35
    unknown_prior: float = 0.05
    unknown_distance: float = 1.2
    quality_weight: float = 0.6
    raw_weight: float = 0.4
    verified_probability: float = 0.60
    verified_margin: float = 0.25
    verified_distance: float = 0.9
    require_master: bool = True
    most_candidates: int = 10
    repairs: int = 3

    @property
    def unknown(self) -> float:
        return self.unknown_prior * math.exp(-self.decay * self.unknown_distance)


def source_weight(source: Column, params: GuessParams) -> Column:
    return F.when(source == "QualityField", params.quality_weight).when(source == "RawToken", params.raw_weight).otherwise(1.0)


def fuzzy(texts: DataFrame, master: DataFrame, params: GuessParams, model: Confusion | None = None) -> DataFrame:
    """observed, code, ord, distance: known codes within reach of each distinct text (column observed), but not the text itself."""
    return within_reach(texts, master, params.length_band, params.most_distance, model)


def ordered_master(master: DataFrame) -> DataFrame:
    """The list with its order (`ord`), by code where it has none."""
    if "ord" not in master.columns:
        return master.withColumn("ord", F.col("code"))
    return master if dict(master.dtypes)["ord"] == "string" else master.withColumn("ord", F.lpad(F.col("ord").cast("string"), 20, "0"))


def hypotheses(observations: DataFrame, master: DataFrame, grammar: Grammar, params: GuessParams, model: Confusion | None = None, repair: RepairParams | None = None, with_repair: bool = True, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of observations with code, method, note, factor, distance, and gen and hyp, which order them; one per code and observation.

    `keep` makes a table of the observations, which every kind of hypothesis reads.
    """
    master = ordered_master(master)
    seen = observations.withColumn("observed", normalize_code(F.col("text"))).filter("observed <> ''")
    known = master.select(F.col("code").alias("observed"), F.lit(True).alias("is_known"))
    seen = keep(seen) if keep else seen
    base = seen.join(known, "observed", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    keys = ["req_id", "obs_no", "observed", "source", "conf"]
    shape = lambda df, gen, hyp, method, note, factor, dist: df.select(*keys, "code", F.lit(gen).alias("gen"), hyp.alias("hyp"), method.alias("method"), note.alias("note"), factor.alias("factor"), dist.alias("distance"))
    none, one = F.lit(None).cast("string"), F.lit(1.0)
    exact = shape(base.filter("is_known").withColumn("code", F.col("observed")), 1, F.lit("0"), F.lit("Exact"), none, one, F.lit(0.0))
    near = fuzzy(base, master, params, model)
    reached = shape(base.select(*keys).join(near, "observed"), 2, F.col("ord").cast("string"), F.lit("MasterList"), none, one, F.col("distance"))
    raw = shape(base.withColumn("code", F.col("observed")), 4, F.lit("0"), F.when(grammar.valid_column(F.col("observed")), "GrammarOnly").otherwise("Unverified"), none, one, F.lit(0.0))
    every = exact.unionByName(reached)
    if with_repair:
        found = base.withColumn("repairs", repairs(F.col("observed"), F.col("symbols"), grammar, model, repair, params.repairs))
        spread = found.select(*keys, F.get("repairs", F.lit(0))["log_score"].alias("best"), F.posexplode("repairs").alias("nth", "r")).select(*keys, "best", "nth", F.col("r.code").alias("code"), F.col("r.log_score").alias("log_score"), F.col("r.valid").alias("valid"))
        listed = spread.join(master.select("code", F.lit(True).alias("listed")), "code", "left")
        is_listed = F.coalesce("listed", F.lit(False))
        method = F.when(is_listed, "MasterList").when(F.col("valid") & (F.col("code") == F.col("observed")), "GrammarOnly").when(F.col("valid"), "GrammarRepair").otherwise("Unverified")
        note = F.when(is_listed, "reached via grammar repair").when(~F.col("valid"), "does not fit the article pattern")
        factor = F.exp(F.greatest(F.lit(-6.0), F.col("log_score") - F.col("best")))
        every = every.unionByName(shape(listed, 3, F.col("nth").cast("string"), method, note, F.when(method == "GrammarRepair", factor).otherwise(1.0), metrics.weighted_distance(F.col("observed"), F.col("code"), model)))
    every = every.unionByName(raw)
    first = F.row_number().over(Window.partitionBy("req_id", "obs_no", "code").orderBy("gen", "hyp"))
    # Dealt by request once: what follows groups by request and more.
    kept = every.repartition("req_id").withColumn("_nth", first).filter("_nth = 1").drop("_nth")
    return kept


def weighed(hyps: DataFrame, master: DataFrame, grammar: Grammar, params: GuessParams) -> DataFrame:
    """Adds prior, matches_grammar and weight."""
    rows = with_prior(hyps, F.broadcast(master) if master.count() <= BROADCAST_CODES else master)
    fits = grammar.valid_column(F.col("code"))
    evidence = 0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf")))
    weight = F.col("prior") * F.exp(-params.decay * F.col("distance")) * evidence * source_weight(F.col("source"), params) * F.when(fits, 1.0).otherwise(params.grammar_penalty) * F.col("factor")
    return rows.withColumn("matches_grammar", fits).withColumn("weight", weight)


def candidates(hyps: DataFrame, params: GuessParams, with_jaro: bool = True) -> DataFrame:
    """The best candidates of each request, ranked. Weights add up in the order of observations."""
    order = F.struct("obs_no", "gen", "hyp")
    rows = hyps.withColumn("at", order)
    first = F.min_by(F.struct("observed", "note", "matches_grammar"), "at")
    grouped = rows.groupBy("req_id", "code").agg(
        F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("weights"), F.count("*").alias("votes"), F.min("distance").alias("distance"),
        F.min_by(F.struct("observed", "source", "method"), F.struct(F.round("distance", answers.DIGITS), "at")).alias("near"), F.max("conf").alias("ocr_conf"), first.alias("first"), F.min("at").alias("at"),
    )
    summed = grouped.withColumn("weight", F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["weight"]))
    request = Window.partitionBy("req_id")
    ranked = summed.withColumn("probability", F.col("weight") / (F.sum("weight").over(request) + F.lit(params.unknown)))
    ranked = ranked.withColumn("rank", F.row_number().over(request.orderBy(F.desc(F.round("probability", answers.DIGITS)), F.round("distance", answers.DIGITS), "at"))).filter(F.col("rank") <= params.most_candidates)
    out = ranked.select(
        "req_id", "rank", "code", F.col("near.observed").alias("observed"), F.col("near.source").alias("source"), F.col("near.method").alias("method"), "distance",
        F.col("first.observed").alias("_first"), "ocr_conf", F.col("first.matches_grammar").alias("matches_grammar"), "weight", "probability", "votes",
        F.when(F.col("first.note").isNull(), F.array().cast("array<string>")).otherwise(F.array("first.note")).alias("notes"),
    )
    if with_jaro:
        out = out.withColumn("jaro_winkler", metrics.jaro_winkler(F.col("_first"), F.col("code")))
    return out.drop("_first")


def guess(observations: DataFrame, master: DataFrame, grammar: Grammar | None = None, params: GuessParams | None = None, model: Confusion | None = None, repair: RepairParams | None = None, with_repair: bool = True, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best candidates of each request. Against a list of up to SENT_CODES codes a request is answered whole by one task; hypotheses
    of a longer one are shuffled."""
    params, grammar = params or GuessParams(), grammar or Grammar.learn(master)
    if master.count() <= answers.SENT_CODES:
        rows = _asked(observations, keep)
        ranked = answers.answered(rows.filter("own is not null").select("req_id", "own"), ordered_master(master), grammar, params, model, repair, with_repair)
        ranked = ranked.withColumn("jaro_winkler", metrics.jaro_winkler(F.col("_first"), F.col("code"))).drop("_first")
        return rows.select("req_id", "first").join(ranked.withColumnRenamed("req_id", "first"), "first").select(ranked.columns)
    asked, distinct = questions(observations, keep)
    hyps = hypotheses(distinct, master, grammar, params, model, repair, with_repair)
    ranked = candidates(weighed(hyps, master, grammar, params), params)
    return asked.join(ranked.withColumnRenamed("req_id", "first"), "first").select(ranked.columns)


def _asked(observations: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Requests (req_id) with the first one (`first`) that observed exactly the same, and of the first ones the observations in order (`own`)."""
    seen = observations.withColumn("observed", normalize_code(F.col("text"))).filter("observed <> ''")
    own = F.array_sort(F.collect_list(F.struct("obs_no", "observed", "source", "conf", "symbols"))).alias("own")
    asked = seen.groupBy("req_id").agg(own)
    first = asked.groupBy("own").agg(F.min("req_id").alias("first"))
    rows = asked.join(first, "own").select("req_id", "first", F.when(F.col("req_id") == F.col("first"), F.col("own")).alias("own"))
    return keep(rows) if keep else rows


def questions(observations: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests (req_id) with the first one (`first`) that observed exactly the same, and the observations of the first ones.

    Hypotheses of a request are many; those of equal requests are equal, so they are made and ranked once.
    """
    rows = _asked(observations, keep)
    distinct = rows.filter("own is not null").select("req_id", F.explode("own").alias("o"))
    return rows.select("req_id", "first"), distinct.select("req_id", "o.obs_no", F.col("o.observed").alias("text"), "o.source", "o.conf", "o.symbols")


def verified(ranked: DataFrame, master: DataFrame, params: GuessParams | None = None) -> DataFrame:
    """The top candidate of each request and whether it can be trusted."""
    params = params or GuessParams()
    margin = F.col("probability") - F.lead("probability", 1, 0.0).over(Window.partitionBy("req_id").orderBy("rank"))
    top = ranked.withColumn("margin", margin).filter("rank = 1")
    sure = (F.col("probability") >= params.verified_probability) & (F.col("method") != "Unverified") & (F.col("distance") <= params.verified_distance) & (F.col("margin") >= params.verified_margin)
    if params.require_master:
        top = top.join(master.select("code", F.lit(True).alias("_listed")), "code", "left")
        sure = sure & F.coalesce("_listed", F.lit(False))
    return top.withColumn("verified", sure).select("req_id", "code", "probability", "margin", "distance", "method", "source", "verified")
