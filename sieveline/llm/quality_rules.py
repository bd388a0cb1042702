"""Quality rules under weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

Each text is reduced to a few counts in its row; nothing of it is exploded or shuffled. The rules' votes form one of at most
3^rules patterns, so the whole corpus is summed up by a count for each pattern. Expectation-maximisation runs over that one
row as an expression, and every pattern gets the posterior probability of good quality that its documents share. Everything
is a DataFrame expression.

Repeated word windows: the hash of each 3-word window and its place are packed into one number, so that sorting plain numbers
brings equal windows together; neighbours are then compared word by word. A text in which different windows share a hash
is counted by sorting the windows themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.expr import let
from sieveline.llm.storage import written
from sieveline.llm.words import SPACE_GAP, leading, split_words, word_count

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
MIN_WORDS, MAX_REPEATED = 50, 50
#: Rounds of expectation-maximisation, and votes added to each rule's tally for and against it.
ROUNDS, PRIOR_RIGHT, PRIOR_WRONG = 40, 4.0, 1.0
#: Rules are written to be precise: each is held to vote against at most this share of good texts, whatever it finds. Without
#: this bound the two classes drift to the one kind of bad text that most rules agree on.
FALSE_ALARMS = 0.008


@dataclass(frozen=True)
class Vote:
    """A rule: ``measure`` up to ``good`` is a vote for the text, from ``bad`` on one against it, in between none. With
    ``falling`` it's the other way round. A null measure abstains."""

    name: str
    measure: str
    good: float
    bad: float
    falling: bool = False

    def column(self) -> Column:
        x = F.expr(self.measure)
        well, badly = (x >= self.good, x <= self.bad) if self.falling else (x <= self.good, x >= self.bad)
        return F.when(badly, 0).when(well, 1).otherwise(-1)


RULES = (
    Vote("symbols", "try_divide(n_symbols, n_words)", 0.02, 0.10),
    Vote("duplicate_lines", "try_divide(n_dup_lines, n_lines)", 0.05, 0.30),
    Vote("repeated_words", "try_divide(n_repeat_words, n_words)", 0.10, 0.30),
    # One rule for capitals and exclamations: rules that say the same would outvote the others.
    Vote("shouting", "greatest(try_divide(n_capitals, word_chars) / 0.3, try_divide(n_shouts, n_words) / 0.05)", 0.4, 1.0),
    Vote("long_words", "try_divide(word_chars, n_words)", 9.0, 14.0),
    Vote("short_words", "try_divide(word_chars, n_words)", 3.5, 2.5, True),
    Vote("length", "n_words", 100, 20, True),
)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per row of ``docs``; null and empty texts have none of anything.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and what the rules need besides.
    """
    text = F.coalesce(text_col, F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), split_words(text, SPACE_GAP).alias("_words"),
                       F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"))
    sized = base.select("*", leading(F.col("_words")).alias("_first"), word_count(F.col("_words")).alias("_n"))
    windows = F.greatest(F.lit(0), F.col("_n") - WINDOW + 1)
    # The low bits hold the window's place, the others its hash.
    low = sized.select("*", windows.alias("_windows")).select("*", F.expr("shiftleft(1L, length(bin(_windows)))").alias("_unit"))
    word = lambda i: F.get("_words", F.col("_first") + i)
    places = F.when(F.col("_windows") > 0, F.sequence(F.lit(0), F.col("_windows") - 1)).otherwise(F.array().cast("array<int>"))
    high = -F.col("_unit")
    packed = F.transform(places, lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)]).bitwiseAND(high).bitwiseOR(i.cast("long")))
    hashed = low.select("*", F.sort_array(packed).alias("_sorted"))
    place = lambda x: x.bitwiseAND(F.col("_unit") - 1).cast("int")

    def same_hash(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(y).bitwiseAND(high) == 0, F.lit(False))

    def same_words(x: Column, y: Column) -> Column:
        out = F.lit(True)
        for k in range(WINDOW):
            out = out & (word(place(x) + k) == word(place(y) + k))
        return F.coalesce(out, F.lit(False))

    # Neighbours with one hash, by the index of the later one; usually there are none.
    pairs = F.filter(F.transform("_sorted", lambda x, i: F.when(same_hash(x, F.get("_sorted", i - 1)), i)), lambda i: i.isNotNull())
    paired = hashed.select("*", pairs.alias("_pairs"))
    at = lambda i: F.get("_sorted", i)
    clash = F.exists("_pairs", lambda i: ~same_words(at(i), at(i - 1)))
    quick = F.array_distinct(F.flatten(F.transform("_pairs", lambda i: F.array(place(at(i - 1)), place(at(i))))))
    spelled = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[word(i + k) for k in range(WINDOW)]).alias("s"), i.alias("i"))))
    slow = let(spelled, lambda xs: F.transform(F.filter(F.transform(xs, lambda x, i: F.struct(x["i"].alias("i"), (
        F.coalesce(F.get(xs, i - 1)["s"] == x["s"], F.lit(False)) | F.coalesce(F.get(xs, i + 1)["s"] == x["s"], F.lit(False))).alias("r"))),
        lambda x: x["r"]), lambda x: x["i"]))
    found = paired.select("*", F.sort_array(F.when(clash, slow).otherwise(quick)).alias("_found"))
    covered = F.aggregate(F.transform("_found", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_found", i + 1) - x, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    return found.select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"), count("[A-Z]").alias("n_capitals"), count("!!").alias("n_shouts"))


def _posterior(votes: Column, state: Column) -> Column:
    """Probability of good quality for one pattern of votes, given the rules' present accuracies."""
    said = F.zip_with(votes, state["rules"], lambda v, r: F.when(v == 1, F.log(r["right_good"] / (1 - r["right_bad"]))).when(
        v == 0, F.log((1 - r["right_good"]) / r["right_bad"])).otherwise(0.0))
    odds = F.aggregate(said, F.log(state["prior"] / (1 - state["prior"])), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))


def _maximised(weighed: Column, rules: int) -> Column:
    """Accuracies from patterns weighed by their posterior: ``v`` votes, ``g`` good and ``b`` bad documents."""
    good, bad = _total(weighed, lambda x: x["g"]), _total(weighed, lambda x: x["b"])
    right = lambda j, side, vote: (_total(weighed, lambda x: F.when(F.get(x["v"], j) == vote, x[side]).otherwise(0.0)) + PRIOR_RIGHT) / (
        _total(weighed, lambda x: F.when(F.get(x["v"], j) >= 0, x[side]).otherwise(0.0)) + PRIOR_RIGHT + PRIOR_WRONG)
    each = F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), lambda j: F.struct(F.greatest(right(j, "g", 1), F.lit(1 - FALSE_ALARMS)).alias("right_good"), right(j, "b", 0).alias("right_bad")))
    return F.struct(((good + PRIOR_RIGHT) / (good + bad + PRIOR_RIGHT + PRIOR_WRONG)).alias("prior"), each.alias("rules"))


def pattern_posteriors(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """``votes, posterior`` for a table ``votes, n`` with one row per pattern, at most 3^rules.

    The first posteriors say that a text without a vote against it is good and one with two or more is not.
    """
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n")))).alias("all"))
    against = lambda v: F.size(F.filter(v, lambda x: x == 0))
    guess = lambda v: F.when(against(v) == 0, 0.95).when(against(v) == 1, 0.2).otherwise(0.05)
    weighed = lambda p: F.transform("all", lambda x: F.struct(x["v"].alias("v"), (x["n"] * p(x["v"])).alias("g"), (x["n"] * (1 - p(x["v"]))).alias("b")))
    start = let(weighed(guess), lambda w: _maximised(w, rules))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: let(weighed(lambda v: _posterior(v, s)), lambda w: _maximised(w, rules)))
    settled = one.select("all", state.alias("state"))
    return settled.select(F.inline(F.transform("all", lambda x: F.struct(x["v"].alias("votes"), _posterior(x["v"], F.col("state")).alias("posterior")))))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Vote, ...] = RULES,
                  least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: its counts, ``base_failed``, the rules' ``votes``, the ``posterior`` of good quality and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated windows. Such a text isn't kept; another is if
    its posterior reaches ``least``. Repeated rows count and come back as often as they are given; an empty table gives none.
    Other columns are not read.
    """
    counts = written(text_counts(docs, id_col, text_col).withColumn("votes", F.array(*[r.column() for r in rules])), "quality-counts")
    patterns = counts.groupBy("votes").agg(F.count("*").alias("n"))
    # 3^rules rows at most, whatever the size of the corpus.
    judged = counts.join(F.broadcast(pattern_posteriors(patterns, len(rules))), "votes")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return judged.select(id_col, *[c for c in counts.columns if c not in (id_col, "votes")], "votes", "posterior", failed.alias("base_failed"),
                         (~failed & (F.col("posterior") >= least)).alias("kept"))
