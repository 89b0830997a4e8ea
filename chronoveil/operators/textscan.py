"""Pattern flags over a text table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of a noise-injection audit of training scripts.
NOISE_PATTERNS = {
    "torch.randn": r"(?i)torch\.randn",
    "np.random.normal": r"(?i)np\.random\.normal",
    "dp_sigma": r"(?i)\bdp_sigma\b",
    "clipping_norm": r"(?i)clipping_norm|clip_norm",
    "noise_injection": r"(?i)\bnoise\s*=\s*torch\.randn",
    "gradient_clipping": r"(?i)clip_grad|grad_norm|clip_factor",
    "dp_comment": r"#\s*DP:",
    "module_docstring": r'(?m)^"""[^"]*DP notes:',
}
NOISE_FORMULA = r"noise\s*=\s*torch\.randn[_a-z]*\([^)]+\)\s*\*\s*([^#\n]+)"


def flag_patterns(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """One boolean column per pattern, over the whole text."""
    return df.withColumns({name: F.col(text).rlike(p) for name, p in patterns.items()})


def classify_formula(df: DataFrame, text: str, formula: str, doubled: Sequence[str],
                     plain: Sequence[str]) -> DataFrame:
    """Extract a formula and classify it: ``doubled`` when it holds any of those texts, ``plain`` when it holds all
    of those, else ``unknown``; null without a formula."""
    found = F.trim(F.regexp_extract(F.col(text), formula, 1))
    has = F.col(text).rlike(formula)
    any_doubled, all_plain = F.lit(False), F.lit(True)
    for part in doubled:
        any_doubled = any_doubled | F.contains(found, F.lit(part))
    for part in plain:
        all_plain = all_plain & F.contains(found, F.lit(part))
    return df.withColumn("formula", F.when(has, found)).withColumn(
        "kind", F.when(has, F.when(any_doubled, "doubled").when(all_plain, "plain").otherwise("unknown")))


def summarise_flags(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col(f"`{n}`")).alias(n) for n in flags])
