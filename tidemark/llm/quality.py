"""Quality rules: a table of thresholds compiled into one Spark projection. Native: no Python runs on the executors.

Defined results: a null text counts as an empty one (no words, base_failed); ties do not arise; repeated rows are
judged each for itself; an empty table gives an empty one; further columns pass through, whatever their names: all that
is added is one struct, `_quality`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import word_array

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with by at be this from or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de et un une est en du que dans pour qui sur au par pas avec ce "
    "el los las y por con para del se su al lo como más no o sus"
).split()
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Texts of fewer lines are held to the share of repeated lines as if they had this many: one or two short repeats are no junk.
LEAST_LINES = 10


@dataclass(frozen=True)
class Rule:
    """A document is kept only if `scale * over` compared by `op` with `limit * under` holds; integers only, so no rounding."""

    name: str
    over: str
    op: str
    limit: int
    under: str = "one"
    scale: int = 100


#: The table of thresholds, in per cent where two counts are compared.
RULES = (
    Rule("mean_word_length_low", "word_chars", ">=", 200, "n_words"),
    Rule("mean_word_length_high", "word_chars", "<=", 2000, "n_words"),
    Rule("symbols_to_words", "n_symbols", "<=", 10, "n_words"),
    Rule("exclamations_to_words", "n_exclaimed", "<=", 50, "n_words"),
    Rule("stop_words", "n_stop_words", ">=", 2, "n_words"),
    Rule("repeated_lines", "n_dup_lines", "<=", 30, "n_lines_from_ten"),
    Rule("repeated_line_chars", "dup_line_chars", "<=", 20, "line_chars"),
)


def verdict(measure, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition; measure(name) is the column of a measure."""
    found = F.lit(True)
    for r in rules:
        left, right = measure(r.over) * r.scale, (F.lit(1) if r.under == "one" else measure(r.under)) * r.limit
        found = found & (left >= right if r.op == ">=" else left <= right)
    return found


def measured(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, by default) and the measures of each text.

    Each step is a projection of its own, since its columns are used more than once in the next.
    Windows are compared by a 64-bit hash of their eight words' 64-bit hashes, within one document only.
    """
    kept = [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(keep if keep is not None else df.columns)]
    names = keep if keep is not None else df.columns
    held = [f"_in_{i}" for i in range(len(names))]
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    with_word = F.filter(F.split(raw, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = df.select(*kept, word_array(F.col(f"`{text}`")).alias("w"), with_word.alias("lines"))
    n = F.size("w").cast("long")
    step = step.select(
        *held,
        n.alias("n_words"),
        F.array_join("w", "").alias("letters"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.array_join("lines", "")).cast("long").alias("line_chars"),
        F.length(F.array_join(F.array_distinct("lines"), "")).cast("long").alias("own_line_chars"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n >= WINDOW, F.transform("w", lambda x: F.xxhash64(x))).alias("h"),
    )
    window = F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    measures = ["n_words", "n_lines", "n_dup_lines", "line_chars", "n_stop_words"]
    step = step.select(
        *held,
        *measures,
        F.length("letters").cast("long").alias("word_chars"),
        F.regexp_count("letters", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("letters", F.lit("!")).cast("long").alias("n_exclaimed"),
        F.greatest("n_lines", F.lit(LEAST_LINES).cast("long")).alias("n_lines_from_ten"),
        (F.col("line_chars") - F.col("own_line_chars")).alias("dup_line_chars"),
        F.when(F.col("h").isNotNull(), window).alias("wh"),
    )
    measures += ["word_chars", "n_symbols", "n_exclaimed", "n_lines_from_ten", "dup_line_chars"]
    # only texts with a repeated window pay for sorting (hash, position) pairs
    pairs = F.sort_array(F.transform("wh", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.select(*held, *measures, F.when(F.size(F.array_distinct("wh")) < F.size("wh"), pairs).alias("s"))
    same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
    again = F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)))
    step = step.select(*held, *measures, F.sort_array(F.transform(again, lambda x: x["i"])).alias("at"))
    reach = F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    # a plain struct keeps the names of the input's columns from clashing with the measures
    out = step.select(*held, *measures, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, names, strict=True)], F.struct(*measures, "n_repeat_words").alias("_quality"))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and `_quality`: the measures, base_failed and kept."""
    step = measured(df, text, keep)
    q = lambda c: F.col(f"_quality.{c}")
    failed = (q("n_words") < 20) | (q("n_repeat_words") * 100 > q("n_words") * 30)
    whole = F.struct("_quality.*", failed.alias("base_failed"), (~failed & verdict(q, rules)).alias("kept"))
    # the generator keeps a later filter on the verdict from being pushed into, and repeated over, every step above
    return step.select(*[c for c in step.columns if c != "_quality"], F.explode(F.array(whole)).alias("_quality"))
