"""Document quality by weak supervision: rules vote, expectation-maximisation weighs them.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The rules are
conditionally independent given the document's hidden quality; the share of good
documents and, for each rule, how often its vote is right on good and on bad
documents are estimated by expectation-maximisation from the counts of vote
patterns (at most 3 to the number of rules, whatever the corpus). A document is
kept if its posterior probability of being good reaches the threshold and it
fails none of the base rules. Built-in functions only.

Edge cases. Null or empty text has no words: every count is 0 and the base rules
fail. Null ids and repeated rows are scored like any other row. An empty table
gives an empty result. Input columns of any name are allowed beside id and text.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import Scratch, small_or_not, text_of

THRESHOLD = 0.5
#: Change of any estimate at which expectation-maximisation has settled, and rounds after which it ends with a warning.
TOLERANCE, ROUNDS = 1e-7, 2_000
WINDOW = 8
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_distinct", "n_upper", "n_ends"]
_ROW, _VOTES = "_row", "_votes"


def _measured(rows: DataFrame) -> DataFrame:
    """_row with the counts that rules vote on, from columns _row and _text.

    Each step names what the next one uses several times, so that Spark
    computes it once.
    """
    blank = r"[\x20\x09-\x0D]+"
    rows = rows.select(_ROW, "_text", F.array_remove(F.split("_text", blank), "").alias("words"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select(
        _ROW,
        F.size("words").alias("n"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("_text", F.lit(r"[.!?](?=[\x20\x09-\x0D]|\z)")).alias("n_ends"),
    )
    starts = F.when(F.col("n") >= WINDOW, F.sequence(F.lit(1), F.col("n") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("n_distinct", F.size(F.array_distinct("hashes"))).withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW), F.size("hashes")))).drop("hashes")
    # few documents repeat a window; only these sort theirs with positions
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    order, last = F.col("ordered"), F.size("ordered") - 1
    same = lambda j: F.when(j > 0, order[j]["h"] == order[j - 1]["h"]).otherwise(False) | F.when(j < last, order[j]["h"] == order[j + 1]["h"]).otherwise(False)
    rows = rows.withColumn("places", F.when(order.isNotNull(), F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda j: order[j]["i"])))).drop("ordered")
    places = F.col("places")
    covered = F.aggregate(F.sequence(F.lit(1), F.size("places") - 1), F.lit(WINDOW), lambda a, k: a + F.least(F.lit(WINDOW), places[k] - places[k - 1]))
    rows = rows.withColumn("n_repeat_words", F.when(places.isNull(), 0).otherwise(covered))
    return rows.withColumn("n_words", F.col("n")).select(_ROW, *[F.col(c).cast("long").alias(c) for c in STATISTICS + _MORE])


def rules() -> list[tuple[str, Column, Column]]:
    """(name, condition of a good vote, condition of a bad vote); neither: abstain."""
    n, share = F.greatest(F.col("n_words"), F.lit(1)), lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    distinct, short = share("n_distinct"), F.col("n_words") < 1000
    return [
        ("length", F.col("n_words") >= 50, F.col("n_words") < 20),
        ("word length", mean.between(3, 9), (mean < 2.5) | (mean > 12)),
        ("symbols", share("n_symbols") < 0.02, share("n_symbols") > 0.1),
        ("repeated lines", lines < 0.1, lines > 0.3),
        ("repeated words", share("n_repeat_words") < 0.1, share("n_repeat_words") > 0.3),
        ("distinct words", short & (distinct > 0.5), short & (distinct < 0.25)),
        ("upper case", upper < 0.1, upper > 0.3),
        ("sentence ends", share("n_ends").between(0.02, 0.34), (F.col("n_words") >= 20) & ((share("n_ends") < 0.01) | (share("n_ends") > 0.5))),
    ]


def _weigh(vote: int, side: int, right: float) -> float:
    """Probability of a vote by a rule that votes for this side with probability `right`, given that it votes."""
    return right if vote == side else 1 - right if vote == -side else 1.0


def _weigh_column(vote: Column, side: int, right: float) -> Column:
    return F.when(vote == side, right).when(vote == -side, 1 - right).otherwise(1.0)


def _posterior(prior, right: list[tuple], votes, weigh=_weigh):
    """Probability of good for the votes of all rules."""
    good, bad = prior, 1 - prior
    for v, (on_good, on_bad) in zip(votes, right, strict=True):
        good, bad = good * weigh(v, 1, on_good), bad * weigh(v, -1, on_bad)
    return good / (good + bad)


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and each rule's accuracy on good and on bad ones, from vote patterns and their counts."""
    prior, right = 0.8, [(0.9, 0.5)] * n_rules
    total = sum(n for _, n in patterns)
    if not total:
        return prior, right
    for _ in range(ROUNDS):
        good = [n * _posterior(prior, right, votes) for votes, n in patterns]
        # one good and one bad document that nobody has seen keep all estimates inside (0, 1)
        sums = [[[1.0, 2.0], [1.0, 2.0]] for _ in range(n_rules)]
        for (votes, n), g in zip(patterns, good, strict=True):
            for j, v in enumerate(votes):
                if v:
                    for k, weight, agrees in ((0, g, 1), (1, n - g, -1)):
                        sums[j][k][0] += weight * (v == agrees)
                        sums[j][k][1] += weight
        before = [prior, *(x for pair in right for x in pair)]
        prior = (sum(good) + 1) / (total + 2)
        right = [tuple(r / n for r, n in pair) for pair in sums]
        if max(abs(a - b) for a, b in zip(before, [prior, *(x for pair in right for x in pair)], strict=True)) < TOLERANCE:
            return prior, right
    warnings.warn(f"expectation-maximisation has not settled after {ROUNDS} rounds", stacklevel=2)
    return prior, right


def score(docs: DataFrame, columns: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(_row: struct of columns, counts, base_failed, quality, kept) for each document."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(_ROW), text_of(text_col).alias("_text"))
    voted = rules()
    votes = F.array(*[F.when(good, 1).when(bad, -1).otherwise(0).cast("tinyint") for _, good, bad in voted])
    with Scratch(docs.sparkSession) as tmp:
        measured = tmp.result(_measured(rows).withColumn(_VOTES, votes), "quality")
    # at most 3 to the number of rules, whatever the corpus
    patterns = sorted((tuple(r[_VOTES]), r["count"]) for r in measured.groupBy(_VOTES).count().collect())
    prior, right = fit(patterns, len(voted))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = _posterior(F.lit(prior), right, [F.col(_VOTES)[j] for j in range(len(voted))], _weigh_column)
    return measured.withColumn("base_failed", failed).withColumn("quality", F.round(good, 6)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns unchanged, that are kept."""
    named = docs.select(F.col(id_col).cast("long").alias("_gone"), F.xxhash64(text_of(text_col)).alias("_gone_hash"), text_of(text_col).alias("_text"))
    scored = score(named, ["_gone", "_gone_hash"], "_text", threshold)
    with Scratch(docs.sparkSession) as tmp:
        gone = small_or_not(tmp.result(scored.where("not kept").select("_row.*").distinct(), "rejected"))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(text_of(text_col)) == gone["_gone_hash"]), "left_anti")
