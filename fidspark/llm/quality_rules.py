"""Quality rules as weak supervision.

Each rule looks at one statistic of a text and votes good (+1), bad (-1) or
abstains (0). Expectation-maximisation over the counts of vote patterns
estimates how often each rule is right on good and on bad documents, without
labels; a document's posterior probability of being good replaces a test that
all rules must pass. The statistics are one pass of column expressions; the
driver sees only pattern counts (at most 3 ** number of rules).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidspark.llm.common import let, stage, text_of, words_of

WINDOW = 5
#: Prior belief, worth PRIOR_ROWS rows at any size of the corpus: share of bad documents, rate of bad votes on bad documents, of good votes on good ones.
PRIOR_BAD, PRIOR_SENSITIVITY, PRIOR_SPECIFICITY, PRIOR_ROWS = 0.1, 0.3, 0.99, 20.0
ITERATIONS, TOLERANCE = 500, 1e-7


def _repeat_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their word hashes; within one
    text of a million words a collision has a chance of some 3e-8.
    """
    def covered(starts: Column) -> Column:
        step = F.aggregate(
            starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")))
        return step["n"]

    def repeated(s: Column) -> Column:
        def start(x: Column, k: Column) -> Column:
            same = F.coalesce(x["g"] == F.get(s, k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False))
            return F.when(same, x["p"]).otherwise(F.lit(-1))
        return covered(F.sort_array(F.array_remove(F.transform(s, start), -1)))

    def of_hashes(hw: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(hw) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hw, i, WINDOW)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(g, lambda x, p: F.struct(x.alias("g"), p.alias("p")))), repeated)))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus the column ``stats``, a struct of counts of the whole text (null: empty)."""
    def chars(pattern: str) -> Column:
        return (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")

    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = df.withColumn("_t", text_of(text))
    d = d.withColumns({"_w": words_of(F.col("_t")), "_l": lines})
    stats = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        chars(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", "\u0001")) - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbol_runs"),
        chars(r"\p{L}+").alias("n_letters"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        chars(r"\p{Lu}+").alias("n_upper"),
        chars(r"[0-9]+").alias("n_digits"),
        chars(r"!+").alias("n_bangs"),
        F.size(F.filter("_l", lambda x: x.rlike(r"[.!?:;)\"'…»”][\x20\x09-\x0D]*$"))).cast("long").alias("n_closed_lines"),
    )
    # a generator, so that no later filter or column draws these expressions in again, once for each use
    kept = [c for c in d.columns if c not in ("_t", "_w", "_l", "stats")]
    return d.select(*kept, F.explode(F.array(stats)).alias("stats"))


def votes(stats: str = "stats") -> dict[str, Column]:
    """The rules. A rule abstains (0) where its statistic says little."""
    s = lambda c: F.col(f"{stats}.{c}")
    words, chars = F.greatest(s("n_words"), F.lit(1)), F.greatest(s("word_chars"), F.lit(1))

    def vote(bad: Column, good: Column, able: Column | None = None) -> Column:
        v = F.when(bad, -1).when(good, 1).otherwise(0)
        return v if able is None else F.when(able, v).otherwise(0)

    per_word, some = s("word_chars") / words, s("n_words") >= 10
    return {
        "length": vote(s("n_words") < 10, s("n_words") >= 40),
        "repeats": vote(s("n_repeat_words") > 0.2 * words, s("n_repeat_words") <= 0.05 * words, some),
        "symbols": vote(s("n_symbols") > 0.1 * words, s("n_symbols") <= 0.02 * words, some),
        "symbol_words": vote(s("n_symbol_runs") > 0.25 * words, s("n_symbol_runs") <= 0.05 * words, some),
        "letters": vote(s("n_letters") < 0.7 * chars, s("n_letters") >= 0.85 * chars, some),
        "word_length": vote((per_word < 2.5) | (per_word > 12), per_word.between(3.0, 9.5), some),
        "dup_lines": vote(s("n_dup_lines") > 0.3 * s("n_lines"), s("n_dup_lines") <= 0.1 * s("n_lines"), s("n_lines") >= 3),
        "capitals": vote(s("n_upper") > 0.4 * chars, s("n_upper") <= 0.15 * chars, some),
        "shouting": vote(s("n_bangs") > 0.2 * words, s("n_bangs") <= 0.05 * words, some),
        "digits": vote(s("n_digits") > 0.3 * chars, s("n_digits") <= 0.1 * chars, some),
        "open_lines": vote(s("n_closed_lines") < 0.1 * s("n_lines"), s("n_closed_lines") >= 0.5 * s("n_lines"), s("n_lines") >= 3),
    }


def fit_votes(patterns: Sequence[tuple[Sequence[int], int]]) -> dict:
    """EM for two classes over (votes, count) patterns: prior of bad, and per rule the log-odds (bad over good) of each vote.

    Votes are independent given the class; abstaining says nothing. EM starts
    from the prior belief, which fixes which class is bad, and runs until no
    estimate moves by TOLERANCE; the prior counts as a fixed number of rows, so
    the votes decide as soon as there are more. A rule that is worse than
    chance in the data gets odds that say so.
    """
    rules = len(patterns[0][0]) if patterns else 0
    n = sum(c for _, c in patterns)
    bad, sens, spec = PRIOR_BAD, [PRIOR_SENSITIVITY] * rules, [PRIOR_SPECIFICITY] * rules

    def odds(j: int, v: int) -> float:
        if v == 0:
            return 0.0
        return math.log(sens[j] / (1 - spec[j])) if v < 0 else math.log((1 - sens[j]) / spec[j])

    for _ in range(ITERATIONS if n else 0):
        table = [[odds(j, v) for v in (0, 1, -1)] for j in range(rules)]
        start = math.log(bad / (1 - bad))
        post = [1 / (1 + math.exp(-max(-700.0, min(700.0, start + sum(table[j][v] for j, v in enumerate(p)))))) for p, _ in patterns]
        before = [bad, *sens, *spec]
        bad = (sum(q * c for q, (_, c) in zip(post, patterns)) + PRIOR_BAD * PRIOR_ROWS) / (n + PRIOR_ROWS)
        for j in range(rules):
            b_bad = sum(q * c for q, (p, c) in zip(post, patterns) if p[j] < 0)
            b_all = sum(q * c for q, (p, c) in zip(post, patterns) if p[j])
            g_good = sum((1 - q) * c for q, (p, c) in zip(post, patterns) if p[j] > 0)
            g_all = sum((1 - q) * c for q, (p, c) in zip(post, patterns) if p[j])
            sens[j] = (b_bad + PRIOR_SENSITIVITY * PRIOR_ROWS) / (b_all + PRIOR_ROWS)
            spec[j] = (g_good + PRIOR_SPECIFICITY * PRIOR_ROWS) / (g_all + PRIOR_ROWS)
        if max(abs(x - y) for x, y in zip(before, [bad, *sens, *spec])) < TOLERANCE:
            break
    return {"bad": bad, "sensitivity": sens, "specificity": spec, "odds": [{v: odds(j, v) for v in (-1, 1)} for j in range(rules)]}


def _fit(voted: DataFrame) -> dict:
    counts = voted.groupBy("votes").count().collect()
    return fit_votes([(tuple(r["votes"]), r["count"]) for r in sorted(counts, key=lambda r: tuple(r["votes"]))])


def _with_votes(df: DataFrame, text: str) -> DataFrame:
    return with_stats(df, text).withColumn("votes", F.array(*votes().values()))


def _verdicts(voted: DataFrame, model: dict) -> DataFrame:
    logit = F.lit(math.log(model["bad"] / (1 - model["bad"])))
    for j, odds in enumerate(model["odds"]):
        v = F.col("votes")[j]
        logit = logit + F.when(v < 0, odds[-1]).when(v > 0, odds[1]).otherwise(0.0)
    words, repeat = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    failed = (words < 10) | (100 * repeat > 20 * words)
    return (voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(logit)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)))


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """``df``, its text replaced by stats, votes, base_failed, posterior (probability of good) and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated
    five-word windows; such a document is not kept whatever the votes say.
    Empty and null texts fail the base test. Repeated rows get equal verdicts.
    An empty table stays empty. Other columns pass through; the added names
    replace equal ones. Texts are read once: what they give is staged.
    """
    voted = stage(_with_votes(df, text).drop(text), "votes")
    return _verdicts(voted, _fit(voted))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; same columns.

    The texts are read twice, to fit the rules and to apply them, so that they
    are neither shuffled nor staged.
    """
    packed = docs.select(F.struct("*").alias("_row"), text_of().alias("_text"))
    model = _fit(_with_votes(packed.select("_text"), "_text"))
    return _verdicts(_with_votes(packed, "_text"), model).filter("kept").select("_row.*")
