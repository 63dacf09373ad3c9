"""Word-list tone of texts. All expressions stay in the JVM.

Defined cases: a null text scores like the empty text, without tokens; rates of a text
without tokens are 0; tokens are lower-cased and cut at white space, punctuation stays on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Word lists (fixed values; parameters of ``tone_scores``).
POSITIVE = [
    "strong", "growth", "record", "momentum", "expansion", "innovation", "robust",
    "improve", "improved", "improving", "outperform", "beat", "exceed", "exceeded",
    "raise", "raised", "guidance", "opportunity", "confident", "deliver", "delivered",
]
NEGATIVE = [
    "weak", "decline", "headwind", "pressure", "challenge", "restructuring", "uncertainty",
    "miss", "missed", "below", "lower", "reduced", "reduction", "loss", "impairment",
    "softness", "deteriorate", "deteriorated", "difficult", "risk", "risks",
]
UNCERTAINTY = ["uncertainty", "uncertain", "may", "might", "approximately", "expect", "believe", "could", "pending"]
LITIGATION = ["litigation", "lawsuit", "claim", "settlement", "investigation", "sec"]


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens between white space (Unicode), none for null or blank."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\x{1c}-\x{1f}]+"), lambda t: t != "")


def tone_scores(df: DataFrame, text: str, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds n_chars, n_tokens, one rate per word list, numerical_density and tone_net (positive less negative)."""
    lists = lists or {"pos_freq": POSITIVE, "neg_freq": NEGATIVE, "uncertainty_freq": UNCERTAINTY, "litigation_freq": LITIGATION}
    cut = df.withColumn("_t", tokens(text))
    n = F.greatest(F.lit(1), F.size("_t"))
    rate = lambda ok: F.size(F.filter("_t", ok)) / n
    among = lambda words: rate(lambda t: t.isin(*words))
    scored = cut.withColumns(
        {"n_chars": F.length(F.coalesce(text, F.lit(""))).cast("double"), "n_tokens": F.size("_t").cast("double"), "numerical_density": rate(lambda t: t.rlike(r"\p{Nd}"))} | {name: among(words) for name, words in lists.items()}
    )
    return scored.withColumn("tone_net", F.col("pos_freq") - F.col("neg_freq")).drop("_t")


def tone_changes(scored: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """Adds the key's previous tone and the change from it."""
    order = Window.partitionBy(key).orderBy(stamp, tie)
    return scored.withColumn("tone_net_prev", F.lag("tone_net").over(order)).withColumn("delta_tone", F.col("tone_net") - F.col("tone_net_prev"))
