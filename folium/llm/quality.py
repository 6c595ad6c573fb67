"""Quality rules as a short-circuit cascade, with built-in functions only.

`measures` counts what the rules need over whole texts. `order_rules` measures each rule on a
sample: the seconds it takes over those of no rule at all, on each row REPEATS times, so that the work and not the start of a job is
timed, and which rows it rejects. It then puts first the rule that
rejects most of the rows left over per second, given the rules before it. `cascade` evaluates
the rules in that order, each only on rows that no earlier one has rejected. A row is rejected
if any rule rejects it, so the order changes the time and the reason given, never the verdict.

Cases: null and empty texts have no words and fail the base rule; repeated rows are judged
each; a table without rows gives no rows; other columns are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged, words

#: Rows, about, on which costs and rejections are estimated.
SAMPLE_ROWS = 2000

#: How often each is judged when a rule is timed; seconds below which costs are not told apart.
REPEATS, LEAST_COST = 5, 0.002

#: Words of abuse, and endings that they take.
ABUSE = """airhead bastard blockhead bonehead buffoon clown coward creep cretin crook degenerate dimwit dirtbag disgusting dolt dumb dunce
    filthy freak garbage halfwit hypocrite idiot ignoramus imbecile jerk knucklehead liar loser lowlife maggot moron nitwit parasite pathetic pig
    repulsive scum scumbag simpleton sleazebag slob stupid swine traitor trash twit vermin vile weasel wimp worthless wretch""".split()
ENDINGS = ["s", "es", "ed", "ing", "ly", "ish", "ity"]
#: Abusive is a text of which one word in this many is abuse.
ABUSE_WORDS = 200


@dataclass(frozen=True)
class Rule:
    """rejects(get): true for a row that is rejected; get gives text and the counts of MEASURES by name."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def _count(get, pattern: str) -> Column:
    return F.regexp_count(get("text"), F.lit(pattern))


def _without(get, pattern: str) -> Column:
    return F.length(F.regexp_replace(get("text"), pattern, ""))


def rules() -> list[Rule]:
    abuse = f"(?i)(?<![A-Za-z])(?:{'|'.join(ABUSE)})(?:{'|'.join(ENDINGS)})?(?![A-Za-z])"
    return [
        Rule("symbols", lambda get: 10 * get("n_symbols") > 3 * get("n_words")),
        Rule("repeated_lines", lambda get: 10 * get("n_dup_lines") > 4 * get("n_lines")),
        Rule("word_length", lambda get: (get("word_chars") < 2 * get("n_words")) | (get("word_chars") > 14 * get("n_words"))),
        Rule("exclamation", lambda get: 10 * _count(get, "!") > 3 * get("n_words")),
        Rule("upper_case", lambda get: 10 * _without(get, r"[^\p{Lu}]+") > 4 * get("word_chars")),
        Rule("letters", lambda get: 2 * _without(get, r"[^\p{L}]+") < get("word_chars")),
        Rule("abuse", lambda get: ABUSE_WORDS * _count(get, abuse) >= F.greatest(get("n_words"), F.lit(1))),
    ]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once wherever Spark moves the expression to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _triples(h: Column) -> Column:
    """A hash for each three words in a row."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    return F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(some)


def _repeated_at(t: Column) -> Column:
    """Ascending places of triples that occur twice: equal ones stand together once sorted."""
    alike = lambda s, x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
    found = _let(F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: alike(s, x, i)), lambda x: x["i"])))
    #: Most texts have none and skip this.
    return F.when(F.size(F.array_distinct(t)) < F.size(t), found).otherwise(F.array().cast("array<int>"))


def _covered(p: Column) -> Column:
    """Words in three-word windows at places p."""
    return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)


def measures(text: Column) -> Column:
    """A struct of MEASURES."""

    def told(t: Column, w: Column, lines: Column) -> Column:
        repeats = _let(_let(F.transform(w, lambda x: F.xxhash64(x)), _triples), lambda t3: _let(_repeated_at(t3), _covered))
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeats,
        }
        made = F.struct(*(c.cast("bigint").alias(name) for name, c in counts.items()))
        failed = lambda m: (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return _let(made, lambda m: F.struct(*(m[c].alias(c) for c in counts), failed(m).alias("base_failed")))

    with_word = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(words(t), lambda w: _let(with_word(t), lambda lines: told(t, w, lines))))


def costs(sample: DataFrame, ruled: list[Rule]) -> dict[str, float]:
    """Seconds of each rule over the rows of a staged sample, REPEATS times."""
    again = sample.withColumn("_again", F.explode(F.array_repeat(F.lit(0), REPEATS)))

    def seconds(rejects: Column) -> float:
        began = time.perf_counter()
        again.agg(F.count_if(rejects), F.sum(F.length("text")), F.sum("n_words")).collect()
        return time.perf_counter() - began

    seconds(F.col("_again") > 0)
    runs = lambda rejects: min(seconds(rejects) for _ in range(2))
    none = runs(F.col("_again") > 0)
    return {r.name: max(runs(r.rejects(F.col)) - none, LEAST_COST) for r in ruled}


def order_rules(docs: DataFrame, ruled: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, each among the sampled rows that those before it let pass."""
    n = docs.count()
    sample = staged(docs.select(F.coalesce("text", F.lit("")).alias("text")).sample(min(1.0, sample_rows / max(n, 1)), seed=3).select("text", measures(F.col("text")).alias("m")).select("text", "m.*"), "quality-sample", rows=sample_rows).filter(~F.col("base_failed"))
    cost = costs(sample, ruled)
    #: One row for each set of rejecting rules that occurs, so at most 2 ** len(rules).
    sets = sample.groupBy(F.array_compact(F.array(*[F.when(r.rejects(F.col), F.lit(r.name)) for r in ruled])).alias("by")).count().collect()
    left, out, rest = list(ruled), [], [(set(x["by"]), x["count"]) for x in sets]
    while left:
        best = max(left, key=lambda r: sum(k for by, k in rest if r.name in by) / cost[r.name])
        out.append(best)
        left.remove(best)
        rest = [x for x in rest if best.name not in x[0]]
    return out


def cascade(docs: DataFrame, ruled: list[Rule]) -> DataFrame:
    """docs with MEASURES, failed_rule (null if kept) and kept, in place of columns of these names."""

    def reason(m: Column, t: Column) -> Column:
        get = lambda name: t if name == "text" else m[name]
        out = F.when(m["base_failed"], F.lit("base"))
        for r in ruled:
            out = out.when(r.rejects(get), F.lit(r.name))
        return F.struct(m.alias("m"), out.alias("failed_rule"))

    judged = _let(F.coalesce("text", F.lit("")), lambda t: _let(measures(t), lambda m: reason(m, t)))
    told = docs.select(F.struct("*").alias("_row"), judged.alias("_j"))
    made = [*MEASURES, "failed_rule", "kept"]
    rest = [F.col("_row")[c].alias(c) for c in docs.columns if c not in made]
    return told.select(*rest, *(F.col("_j")["m"][c].alias(c) for c in MEASURES), F.col("_j")["failed_rule"].alias("failed_rule"), F.col("_j")["failed_rule"].isNull().alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """The cascade with its rules in the order found on a sample of the same rows."""
    return cascade(docs, order_rules(docs, rules()))
