"""Quality rules by weak supervision.

Each rule looks at counts of a text and votes that it is sound (+1), that it
is junk (-1), or abstains (0); an abstention says nothing.  Expectation-
maximisation over the table of vote patterns estimates how often each rule
casts each vote on sound and on junk texts (so how far its votes can be
trusted) and how many texts are sound.  A text's posterior probability of
being sound, from all its votes, replaces the demand that every rule passes.

Only DataFrame functions touch the data.  What reaches the driver is one count
per vote pattern, at most 3 ** len(RULES) rows whatever the corpus; the
estimates go back into the plan as literals, so scoring needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, whole_text

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_SPACES = r"[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``measure`` (SQL over the counts) votes junk from ``bad`` on and sound
    up to ``good``, where these are given; otherwise, and where the measure is
    null, the rule abstains."""

    name: str
    measure: str
    bad: float | None = None
    good: float | None = None

    def vote(self) -> Column:
        m, vote = F.expr(self.measure), F.when(F.lit(False), 0)
        if self.bad is not None:
            vote = vote.when(m >= self.bad, -1)
        if self.good is not None:
            vote = vote.when(m <= self.good, 1)
        return vote.otherwise(0).cast("int")


def _share(a: str, b: str) -> str:
    return f"try_divide({a}, {b})"


# A few words or lines more below the line keep short texts from reaching a high share by one repetition.
_SYMBOL, _REPEAT = _share("n_symbols", "n_chars"), _share("n_repeat_words", "n_words + 20")
_LINES, _CAPITALS = _share("n_dup_lines", "n_word_lines + 5"), _share("n_capitals", "word_chars")
_EXCLAIM = _share("n_exclamations", "n_words")

# Signs of junk, each of one kind only, so their absence says little; and one
# rule for prose that shows no trace of any of them.
RULES = (
    Rule("symbols", _SYMBOL, bad=0.03),
    Rule("symbols_per_word", _share("n_symbols", "n_words"), bad=0.15),
    Rule("repeated_words", _REPEAT, bad=0.20),
    Rule("duplicate_lines", _LINES, bad=0.30),
    Rule("capitals", _CAPITALS, bad=0.50),
    Rule("exclamations", _EXCLAIM, bad=0.20),
    Rule("word_length", f"abs({_share('word_chars', 'n_words')} - 7.0)", bad=9.0),
    Rule("few_sentences", "n_words / (n_stops + 1)", bad=250.0),
    Rule("prose", f"greatest({_SYMBOL} / 0.01, {_REPEAT} / 0.05, {_LINES} / 0.05, {_CAPITALS} / 0.25, {_EXCLAIM} / 0.05)", good=1.0),
)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row of ``docs`` as the struct ``doc`` with the counts the rules
    use and a row number.  A null text counts as empty; all counts of an empty
    text are 0."""
    t = whole_text(f"doc.`{text}`")
    rows = docs.select(F.struct("*").alias("doc"))
    rows = rows.select("doc", t.alias("t"), F.expr(f"filter(split(coalesce(doc.`{text}`, ''), '{_SPACES}'), w -> w <> '')").alias("w"))
    # Hashes of all word windows: only a text in which some hash comes twice
    # can repeat a window, and only such a text is looked at word for word.
    window = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
    rows = rows.select(
        "doc", "t", "w",
        F.expr(f"if(size(w) < {WINDOW}, array(), transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({window})))").alias("h"))
    rows = rows.select(
        "doc", "t", "w",
        F.expr(f"""if(size(array_distinct(h)) = size(h), null,
                   array_sort(transform(sequence(0, size(h) - 1), i -> struct(concat_ws(' ', {window}) as s, i as i))))""").alias("s"))
    rows = rows.select(
        "doc", "t", "w",
        F.expr("""array_sort(transform(
                  filter(sequence(0, size(s) - 1), j -> (j > 0 and s[j].s = s[greatest(j - 1, 0)].s)
                      or (j < size(s) - 1 and s[j].s = s[least(j + 1, size(s) - 1)].s)),
                  j -> s[j].i))""").alias("p"),
        F.expr("filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"))
    # p: sorted starts of the windows found twice or more; a word is repeated
    # if one of them covers it.
    covered = f"""coalesce(if(size(p) = 0, 0, {WINDOW} + aggregate(sequence(0, size(p) - 1), 0,
                  (a, k) -> a + if(k = 0, 0, least({WINDOW}, p[k] - p[greatest(k - 1, 0)])))), 0)"""
    return rows.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.length("t").cast("long").alias("n_chars"),
        F.size("lines").cast("long").alias("n_word_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("!!")).cast("long").alias("n_exclamations"),
        F.regexp_count("t", F.lit(r"[.!?:;]")).cast("long").alias("n_stops"),
        F.monotonically_increasing_id().alias("row"))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


#: Starting values, also the prior: share of sound texts, and how often a
#: rule votes (sound, junk) on a sound and on a junk text.
START_SOUND, START_ON_SOUND, START_ON_JUNK = 0.9, (0.6, 0.02), (0.1, 0.3)


@dataclass(frozen=True)
class VoteModel:
    """``sound``: share of sound texts.  ``on_sound[j]`` and ``on_junk[j]``:
    how often rule j votes (sound, junk) on a sound and on a junk text."""

    sound: float
    on_sound: tuple[tuple[float, float], ...]
    on_junk: tuple[tuple[float, float], ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log odds that a vote for sound (0 or more) and a vote for junk (0
        or less) add: a rule never counts against its own meaning."""
        return [(max(0.0, math.log(s[0] / j[0])), min(0.0, math.log(s[1] / j[1]))) for s, j in zip(self.on_sound, self.on_junk)]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.sound / (1 - self.sound)) + sum(
            w[0] if v > 0 else w[1] for v, w in zip(votes, self.weights()) if v)


def estimate(patterns: dict[tuple[int, ...], int], rules: int = len(RULES), rounds: int = 100,
             prior_share: float = 0.02) -> VoteModel:
    """EM over counted vote patterns.

    The prior is worth ``prior_share`` of the rows (one row at least), so a
    rule that hardly votes keeps a sensible estimate and none becomes 0 or 1.
    An empty table gives the starting values.
    """
    total = sum(patterns.values())
    strength = max(1.0, prior_share * total)
    model = VoteModel(START_SOUND, (START_ON_SOUND,) * rules, (START_ON_JUNK,) * rules)
    rows = sorted(patterns.items())
    for _ in range(rounds if total else 0):
        sound_votes = [[x * strength for x in START_ON_SOUND] for _ in range(rules)]
        junk_votes = [[x * strength for x in START_ON_JUNK] for _ in range(rules)]
        mass = 0.0
        for votes, n in rows:
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(votes)))))
            mass += n * p
            for j, v in enumerate(votes):
                if v:
                    sound_votes[j][v < 0] += n * p
                    junk_votes[j][v < 0] += n * (1 - p)
        after = VoteModel(
            (START_SOUND * strength + mass) / (strength + total),
            tuple((a / (strength + mass), b / (strength + mass)) for a, b in sound_votes),
            tuple((a / (strength + total - mass), b / (strength + total - mass)) for a, b in junk_votes))
        if after == model:
            break
        model = after
    return model


def fit(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """The vote model of a table of ``counts``."""
    votes = [r.vote().alias(f"v{j}") for j, r in enumerate(rules)]
    rows = counted.select(*votes).groupBy(*(f"v{j}" for j in range(len(rules)))).count().collect()   # <= 3 ** rules rows
    return estimate({tuple(r[:-1]): r["count"] for r in rows}, len(rules))


def posterior(model: VoteModel, rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability that a row of ``counts`` is sound."""
    odds = F.lit(math.log(model.sound / (1 - model.sound)))
    for rule, (up, down) in zip(rules, model.weights()):
        v = rule.vote()
        odds = odds + F.when(v > 0, up).when(v < 0, down).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judged(counted: DataFrame, model: VoteModel, threshold: float = 0.5) -> DataFrame:
    """``counts`` with ``base_failed``, ``p_sound`` and ``kept``: no base
    failure and a posterior of at least ``threshold``."""
    out = counted.withColumn("base_failed", base_failed()).withColumn("p_sound", posterior(model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_sound") >= threshold))


def keep_sound(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    Defined results: a null text counts as empty and is dropped (no words);
    repeated rows share a verdict; an empty table gives no rows; columns of
    any name pass through, as the counts stand beside the row's struct.
    The rows are written once with their counts; the estimate and the filter
    read the counts alone.
    """
    counted = materialize(spark, counts(docs, text), "quality-counts")
    return judged(counted, fit(counted)).filter("kept").select("doc.*")
