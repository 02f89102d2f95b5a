"""Token estimates: seven named variants over the byte length of a text, all column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MODELS = ("claude", "gpt4o", "gpt4", "gemini", "llama")
#: Bytes per token of each variant, in the order of MODELS.
RATIOS = {
    "scan": (3.5, 4.0, 3.7, 3.8, 3.5), "estimate": (3.5, 4.0, 3.7, 3.8, 3.5), "quick": (3.5, 4.0, 3.7, 3.8, 3.5),
    "output": (4.0, 4.0, 4.0, 4.2, 3.8), "wasm": (4.0, 4.2, 4.0, 4.0, 3.5), "node": (3.5, 4.0, 4.0, 4.2, 3.8),
}
SPECIAL = "!\"#$%&'()*+,-./:;<=>@[]^`{|}~"
_SINGLE = {"scan"}  # computed in single precision


def of_size(size: Column, ratio: float, variant: str = "scan") -> Column:
    """Tokens of so many bytes: truncated for scan, output and node; rounded up for quick and wasm."""
    if variant in _SINGLE:
        return F.floor((size.cast("float") / F.lit(ratio).cast("float")).cast("float")).cast("long")
    if variant == "quick":
        n = F.ceil((size.cast("float") / F.lit(ratio).cast("float")).cast("float")).cast("long")
        return F.when(size == 0, F.lit(0).cast("long")).when(size > 0, F.greatest(F.lit(1).cast("long"), n))
    if variant == "wasm":
        return F.ceil(size / F.lit(ratio)).cast("long")
    return F.floor(size / F.lit(ratio)).cast("long")


_SIGNS = "[" + "".join("\\" + c for c in SPECIAL) + "]"


def _once(text: Column, make) -> Column:
    """``make`` of the counts that refined estimates need, each taken once: the lambda binds them."""
    some = F.struct(F.octet_length(text).alias("size"), F.regexp_count(text, F.lit("[ \t]")).alias("blanks"), F.regexp_count(text, F.lit("\n")).alias("ends"), F.regexp_count(text, F.lit(_SIGNS)).alias("signs"))
    return F.transform(F.array(some), make)[0]


def _estimate(c: Column, ratio: float, special: bool) -> Column:
    t = c["size"] / F.lit(ratio) - c["blanks"] * F.lit(0.3) + c["ends"] * F.lit(0.5)
    if special:
        t = t + c["signs"] * F.lit(0.3)
    return F.when(c["size"] == 0, F.lit(0).cast("long")).when(c["size"] > 0, F.ceil(F.greatest(F.lit(1.0), F.round(t, 9))).cast("long"))


def _ratio(model: str, variant: str) -> float:
    return 3.2 if model == "codellama" else RATIOS[variant][MODELS.index(model)]


def estimates(text: Column, models: tuple[str, ...] = MODELS) -> Column:
    """A struct with the refined estimate of every model: white space counts for less, line ends and (for
    some models) signs for more.  The text is gone through once for each count, whatever the models."""
    return _once(text, lambda c: F.struct(*(_estimate(c, _ratio(m, "estimate"), m in ("claude", "codellama")).alias(m) for m in models)))


def count(text: Column, model: str, variant: str = "scan") -> Column:
    """Tokens of a text under one model; null for a null text."""
    if variant == "estimate":
        return _once(text, lambda c: _estimate(c, _ratio(model, variant), model in ("claude", "codellama")))
    return of_size(F.octet_length(text), _ratio(model, variant), variant)


def count_all(text: Column, variant: str = "scan") -> Column:
    """A struct with the tokens of every model."""
    return estimates(text) if variant == "estimate" else F.struct(*(count(text, m, variant).alias(m) for m in MODELS))


def most_efficient(text: Column, variant: str = "estimate") -> Column:
    """The model with the fewest tokens; the first of gpt4o, claude, gpt4, gemini, llama on a tie."""
    order = ("gpt4o", "claude", "gpt4", "gemini", "llama")
    least = lambda of: F.array_min(F.array(*(F.struct(of(m).alias("n"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(order))))["m"]
    if variant == "estimate":
        return _once(text, lambda c: least(lambda m: _estimate(c, _ratio(m, variant), m == "claude")))
    return least(lambda m: count(text, m, variant))


def exceeds(text: Column, budget: int, model: str = "claude", variant: str = "estimate") -> Column:
    return count(text, model, variant) > budget


def _refined(s: str, ratio: float, special: bool) -> int:
    if not s:
        return 0
    t = len(s.encode()) / ratio - 0.3 * (s.count(" ") + s.count("\t")) + 0.5 * s.count("\n")
    if special:
        t += 0.3 * sum(c in SPECIAL for c in s)
    return max(1, -int(-round(t, 9) // 1))


def truncate_text(s: str | None, budget: int, ratio: float = 3.5, special: bool = True) -> str | None:
    """Longest character prefix within the budget by bisection, cut back to the end of a word."""
    if s is None or _refined(s, ratio, special) <= budget:
        return s
    lo, hi = 0, len(s)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if _refined(s[:mid], ratio, special) <= budget else (lo, mid - 1)
    at = max(s.rfind(" ", 0, lo), s.rfind("\n", 0, lo))
    return s[: at + 1] if at >= 0 else s[:lo]


def exact(text: Column, vocabulary: str) -> Column:
    """Tokens of a byte-pair encoding whose public vocabulary file (a tokenizer.json) stands at ``vocabulary``, a
    path that every executor can read.  Null for a null text."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if vocabulary not in _loaded:
            _loaded[vocabulary] = Tokenizer.from_file(vocabulary)
        live = s[s.notna()]
        got = [len(e.ids) for e in _loaded[vocabulary].encode_batch(live.tolist(), add_special_tokens=False)]
        return pd.Series(got, index=live.index, dtype="Int64").reindex(s.index)

    return run(text)


_loaded: dict = {}


def truncate(text: Column, budget: int, model: str = "claude") -> Column:
    """``truncate_text`` over a column, an Arrow batch at a time."""
    ratio, special = RATIOS["estimate"][MODELS.index(model)], model == "claude"

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: truncate_text(x, budget, ratio, special), na_action="ignore")

    return cut(text)
