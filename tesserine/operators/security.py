"""Secret scan over the lines of a corpus."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

_Q = "['\"]?"
_SET = _Q + r"\s*[:=]\s*" + _Q
#: (kind, severity, pattern): at most one finding of each on a line.
RULES: tuple[tuple[str, str, str], ...] = (
    ("aws_credential", "critical", "AKIA[0-9A-Z]{16}"),
    ("aws_credential", "critical", "(?i)aws[_-]?secret[_-]?access[_-]?key" + _SET + "[A-Za-z0-9/+=]{40}"),
    ("github_token", "critical", "ghp_[0-9A-Za-z]{36}"),
    ("github_token", "critical", "github_pat_[0-9A-Za-z]{22}_[0-9A-Za-z]{59}"),
    ("private_key", "critical", "-----BEGIN (?:(?:DSA|EC|OPENSSH|RSA) )?PRIVATE KEY-----"),
    ("api_key", "high", "(?i)api[_-]?key" + _SET + "[0-9A-Za-z_-]{20,}"),
    ("generic", "high", "(?i)(?:token|secret)" + _SET + "[0-9A-Za-z_-]{20,}"),
    ("password", "high", "(?i)password" + _SET + "[^'\"\\s]{8,}"),
    ("connection_string", "high", "(?i)(?:mongodb|mysql|postgres|redis)://[^\\s'\"]+"),
    ("access_token", "high", r"eyJ[\w-]*\.eyJ[\w-]*\.[\w-]*"),
    ("access_token", "high", "xox[abprs]-[0-9]{10,13}-[0-9]{10,13}-[0-9A-Za-z]{24}"),
    ("api_key", "critical", "(?:pk|sk)_(?:live|test)_[0-9A-Za-z]{24,}"),
)
_HINT = "(?i)akia|secret|ghp_|github_pat_|private key|key|token|password|://|eyj|xox|k_(live|test)_"


def findings(files: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(relative_path, line, kind, severity, pattern): each rule's first match on each line, redacted.

    Lines that begin as a comment or speak of an example are skipped.  A cheap test of the whole
    text leaves most files unsplit; texts are scanned whole.
    """
    lines = files.where(F.col("content").rlike(_HINT)).select("relative_path", F.posexplode(text.lines(F.col("content"))).alias("at", "text")).where(F.col("text").rlike(_HINT))
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    live = lines.where(~trimmed.rlike(r"^(//|#|\*)") & ~trimmed.rlike("example|placeholder|xxxxx"))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.regexp_extract("text", p, 0).alias("match")) for k, s, p in RULES))
    hits = F.filter(found, lambda f: f["match"] != "")
    if allowed:
        hits = F.filter(hits, lambda f: ~reduce(or_, (f["match"].contains(a) for a in allowed)))
    rows = live.select("relative_path", (F.col("at") + 1).cast("long").alias("line"), F.explode(hits).alias("f"))
    return rows.select("relative_path", "line", "f.kind", "f.severity", text.redact(F.col("f.match")).alias("pattern"))


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))


def safe(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files without a finding (every rule is high or critical)."""
    return files.join(found.select("relative_path"), "relative_path", "left_anti")


def refuse_critical(found: DataFrame) -> None:
    """Raise for the first file, by path, with a critical finding."""
    bad = found.where(F.col("severity") == "critical").agg(F.min("relative_path")).first()[0]
    if bad is not None:
        raise ValueError(f"a critical secret was found in {bad}")


def redact_content(content):
    """The text with every match of a rule replaced."""
    for _, _, p in RULES:
        content = F.regexp_replace(content, p, "[REDACTED]")
    return content
