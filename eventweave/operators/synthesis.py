"""Extractive, source-cited story summaries that leave out disputed figures.

Disputes are found by an equi join on content words that keeps one row per claim (a semi join),
never pairs. All members and whole texts are taken unless bounds are given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import policy
from ..functions.sentences import content_words, figures, same_point, sentences
from ..functions.text import collapse, event_time, exploded, first_chars, let, posexploded
from ..session import cut_lineage
from .skew import top_rows

MODEL_KEY = "extractive:lead-sentences@1"
KIND_ORDER = ["TITLE", "SUMMARY", "CONTEXT"]


def kind_order(kind="kind"):
    expr = F
    for i, name in enumerate(KIND_ORDER):
        expr = expr.when(F.col(kind) == name, i)
    return expr.otherwise(len(KIND_ORDER))


def synthesis_input(membership: DataFrame, articles: DataFrame, *,
                    max_articles: int | None = None, max_chars: int | None = None) -> DataFrame:
    """(story_id, article_id, at, title, text); `at` (event time, id) is the order of publication. All members and
    whole texts; with a bound the first members."""
    timed = articles.select("article_id", event_time().alias("event_time"))
    chosen = membership.select("story_id", "article_id").join(timed, "article_id")
    if max_articles is not None:
        chosen = top_rows(chosen, ["story_id"], ["event_time", "article_id"], max_articles)
    body = F.when(F.col("body_text") != "", F.col("body_text")).otherwise(F.col("description"))
    texts = articles.select("article_id", collapse("title").alias("title"),
                            first_chars(collapse(body), max_chars).alias("text"))
    return chosen.join(texts, "article_id").select(
        "story_id", "article_id", F.struct("event_time", "article_id").alias("at"), "title", "text")


def claims(inputs: DataFrame) -> DataFrame:
    """Titles (ord -1) and sentences with their figures and content words."""
    lines = posexploded(inputs, ["story_id", "article_id", "at"],
                        F.concat(F.array("title"), sentences(F.col("text"))), "p", "line")
    return lines.select(
        "story_id", "article_id", "at", (F.col("p") - 1).alias("ord"), "line",
        figures(F.col("line")).alias("figures"), content_words(F.col("line")).alias("words"))


def leading_claims(inputs: DataFrame, n: int) -> DataFrame:
    """The rows of `claims` that `lead_sentences` and `contested_claims` need for at most n lines of a story: titles, lines
    with figures, and of each member's other lines the first n different ones, with no words where there are no figures.

    Nothing is lost: lines without figures are never contested, and a line that follows n different ones of its own member
    follows n different ones of its story."""
    every = F.concat(F.array("title"), sentences(F.col("text")))

    def wanted(lines):
        marked = F.transform(lines, lambda x, i: F.struct((i - 1).alias("ord"), x.alias("line")))
        bound = F.filter(marked, lambda x: (x["ord"] < 0) | x["line"].rlike("\\p{Nd}"))
        body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        plain = F.slice(F.array_distinct(F.filter(body, lambda x: ~x.rlike("\\p{Nd}"))), 1, n)
        return F.concat(bound, F.transform(plain, lambda x: F.struct(
            (F.array_position(body, x) - 1).cast("int").alias("ord"), x.alias("line"))))

    rows = exploded(inputs, ["story_id", "article_id", "at"], let(every, wanted), "c").select(
        "story_id", "article_id", "at", "c.ord", "c.line", figures(F.col("c.line")).alias("figures"))
    return rows.withColumn("words", F.when(F.size("figures") > 0, content_words(F.col("line"))))


def contested_claims(all_claims: DataFrame) -> DataFrame:
    """(story_id, article_id, ord) of figure-bearing lines that another member's line on the
    same point contradicts.

    Lines on the same point share at least half of the smaller word set, so the smaller one
    needs only a prefix of its words (longest first, then by word) as join keys.
    """
    with_figures = all_claims.filter(F.size("figures") > 0).select(
        "story_id", "article_id", "ord", "figures",
        F.sort_array(F.transform("words", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
        .alias("_s"), "words")
    n = F.size("_s")
    prefix = n - F.greatest(F.ceil(n / 2).cast("int"), F.lit(2)) + 1
    tokens = posexploded(
        with_figures.filter(n >= 2),
        ["story_id", "article_id", "ord", "figures", "words", prefix.alias("_prefix")],
        F.col("_s"), "_i", "_t").select(
        "story_id", F.col("_t.w").alias("token"), "article_id", "ord", "figures", "words",
        (F.col("_i") < F.col("_prefix")).alias("early"))
    other = tokens.select(*[F.col(c).alias(c if c in ("story_id", "token") else f"b_{c}")
                            for c in tokens.columns])
    rule = (
        (tokens["story_id"] == other["story_id"]) & (tokens["token"] == other["token"])
        & (F.col("early") | F.col("b_early")) & (F.col("article_id") != F.col("b_article_id"))
        & (F.col("figures") != F.col("b_figures")) & same_point(F.col("words"), F.col("b_words"))
    )
    return tokens.join(other, rule, "left_semi").select("story_id", "article_id", "ord").distinct()


def lead_sentences(all_claims: DataFrame, contested: DataFrame, *,
                   max_summary: int = policy.MAX_SUMMARY,
                   max_context: int = policy.MAX_CONTEXT) -> DataFrame:
    """(story_id, kind, position, text): title, each member's lead, then other sentences."""
    usable = all_claims.select("story_id", "article_id", "at", "ord", "line").join(
        contested, ["story_id", "article_id", "ord"], "left_anti")
    order = F.struct("at", "ord")
    title = usable.filter("ord = -1 AND line <> ''").groupBy("story_id").agg(
        F.min_by("line", order).alias("text")).select(
        "story_id", F.lit("TITLE").alias("kind"), F.lit(0).alias("position"), "text")
    body = usable.filter("ord >= 0")
    first = body.groupBy("story_id", "article_id").agg(
        F.min_by(F.struct("at", "ord", "line"), order).alias("f")).select("story_id", "f.*")
    leads = top_rows(first.groupBy("story_id", "line").agg(F.min(order).alias("_first")),
                     ["story_id"], ["_first"], max_summary)
    others = body.groupBy("story_id", "line").agg(F.min(order).alias("_first")).join(
        leads.select("story_id", "line"), ["story_id", "line"], "left_anti")
    context = top_rows(others, ["story_id"], ["_first"], max_context)
    part = lambda df, kind: df.select(
        "story_id", F.lit(kind).alias("kind"), (F.col("rank") - 1).alias("position"),
        F.col("line").alias("text"))
    rows = title.unionByName(part(leads, "SUMMARY")).unionByName(part(context, "CONTEXT"))
    return rows.join(title.select("story_id"), "story_id", "left_semi")


def sentence_supporters(elements: DataFrame, inputs: DataFrame) -> DataFrame:
    """Adds `article_ids`: members, in order, whose title equals or text contains the element.

    A story's elements, a generation of them, go to its members: texts stay where the join that made the inputs has put
    them, while a join by story would move them all once more."""
    of_story = elements.groupBy("story_id").agg(F.collect_list(F.struct("kind", "position", "text")).alias("_e"))
    asked = inputs.select("story_id", "article_id").distinct().join(of_story, "story_id").select(
        F.col("story_id").alias("_story"), "article_id", "_e")
    # the story is compared inside the expression, so that article_id alone is the key of the join
    said = lambda e: (F.col("_story") == F.col("story_id")) & F.when(
        e["kind"] == "TITLE", F.col("title") == e["text"]).otherwise(F.contains(F.col("text"), e["text"]))
    cited = exploded(inputs.join(asked, "article_id"), ["story_id", F.struct(F.col("at").alias("_p"), F.col("article_id").alias("_a")).alias("_m")],
                     F.filter("_e", said), "e")
    gathered = cited.groupBy("story_id", "e.kind", "e.position", "e.text").agg(F.sort_array(F.collect_list("_m")).alias("_s"))
    return gathered.select("story_id", "kind", "position", "text", F.col("_s._a").alias("article_ids"))


def synthesize(membership: DataFrame, articles: DataFrame, *,
               max_articles: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Cited elements of every story that has an uncontested title.

    The lines that can be taken or disputed are read by several branches, so they are written once."""
    inputs = synthesis_input(membership, articles, max_articles=max_articles, max_chars=max_chars)
    lines = cut_lineage(leading_claims(inputs, policy.MAX_SUMMARY + policy.MAX_CONTEXT))
    return sentence_supporters(lead_sentences(lines, contested_claims(lines)), inputs)


LIMITS = {"TITLE": 1, "SUMMARY": policy.MAX_SUMMARY, "CONTEXT": policy.MAX_CONTEXT}


def synthesize_with(inputs: DataFrame, proposer: Callable[[pd.DataFrame], pd.DataFrame],
                    limits: dict[str, int] | None = None) -> DataFrame:
    """A user synthesizer, member by member: (story_id, kind, position, text, article_ids).

    `proposer` turns a frame of members (story_id, article_id, title, text) of any stories into the elements
    (story_id, article_id, kind, ord, text) that each member offers. It sees any slice of a story, so
    stories are not gathered. Equal elements of a story are one, cited from all members that offer
    it; of each kind the first ones in order of publication stay, up to `limits`."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(proposer, frames)

    offered = inputs.select("story_id", "article_id", "title", "text").mapInPandas(
        run, "story_id long, article_id long, kind string, ord int, text string")
    placed = offered.join(inputs.select("story_id", "article_id", "at"), ["story_id", "article_id"])
    elements = placed.groupBy("story_id", "kind", "text").agg(F.min(F.struct("at", "ord")).alias("_first"))
    caps = LIMITS if limits is None else limits
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("kind"))
    kept = top_rows(elements, ["story_id", "kind"], ["_first", "text"], max(caps.values())).filter(F.col("rank") <= wanted)
    cited = placed.select("story_id", "kind", "text", "at").distinct().join(
        kept.select("story_id", "kind", "text", (F.col("rank") - 1).alias("position")), ["story_id", "kind", "text"])
    return cited.groupBy("story_id", "kind", "position", "text").agg(F.sort_array(F.collect_list("at")).alias("_s")).select(
        "story_id", "kind", "position", "text", F.col("_s.article_id").alias("article_ids"))


def invalid_syntheses(elements: DataFrame, inputs: DataFrame, *,
                      max_elements: int = policy.MAX_ELEMENTS,
                      max_chars: int = policy.MAX_ELEMENT_CHARS) -> DataFrame:
    """(story_id, problem) of generations that may not be published."""
    shape = elements.groupBy("story_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "TITLE").alias("titles"),
        F.count_if(~F.col("kind").isin(KIND_ORDER) | (F.trim("text") == "")
                   | (F.length("text") > max_chars)).alias("malformed"),
        F.count_if((F.size("article_ids") == 0)
                   | (F.size(F.array_distinct("article_ids")) != F.size("article_ids"))).alias("citing"),
    ).select("story_id", F.expr(
        f"CASE WHEN n > {max_elements} THEN 'too_many_elements' WHEN titles <> 1 THEN 'titles' "
        "WHEN malformed > 0 THEN 'malformed' WHEN citing > 0 THEN 'supporters' END").alias("problem"))
    cited = elements.select("story_id", F.explode("article_ids").alias("article_id")).distinct()
    outside = cited.join(inputs.select("story_id", "article_id"), ["story_id", "article_id"], "left_anti")
    return shape.filter("problem IS NOT NULL").unionByName(
        outside.select("story_id").distinct().withColumn("problem", F.lit("cites_outside")))


def element_positions(elements: DataFrame) -> DataFrame:
    """Reading order: TITLE, SUMMARY, CONTEXT, zero-based position within each kind.

    `ord` is the order the elements were produced in; a generation has at most 20 of them.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("synthesis_id", "kind").orderBy("ord")
    return elements.withColumn("position", F.row_number().over(w) - 1).withColumn(
        "kind_order", kind_order())


def current_generation(syntheses: DataFrame) -> DataFrame:
    """All generations with `is_current` on the newest of each story."""
    newest = syntheses.groupBy("story_id").agg(
        F.max_by("synthesis_id", F.struct("generated_at", "synthesis_id")).alias("_cur"))
    return syntheses.join(newest, "story_id").withColumn(
        "is_current", F.col("synthesis_id") == F.col("_cur")).drop("_cur")
