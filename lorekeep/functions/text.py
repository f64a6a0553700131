"""Text functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import ENTROPY_BITS, ENTROPY_CHARS

# fixed values: what is redacted, in this order, and by what
REDACTIONS = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bsk[-_](?:live|test|proj)[-_][A-Za-z0-9_\-]{6,}\b", "[REDACTED_TOKEN]"),
    (r"\bsk-[A-Za-z0-9_\-]{16,}\b", "[REDACTED_TOKEN]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]{16,}=*", "Bearer [REDACTED]"),
    (r"(?i)\b([\w-]*(?:api[_-]?key|token|secret|password|passwd|authorization)[\w-]*)(\s*[:=]\s*)([^\s,;]+)", "$1$2[REDACTED]"),
]
#: The last rule is slow on long runs of words and hyphens; rows without any of its words skip it.
LABELS = r"(?i)api[_-]?key|token|secret|password|passwd|authorization"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalized(x: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def pattern_redacted(x: Column) -> Column:
    """Each rule in order. White space, words and their bounds are those of Unicode."""
    for pattern, by in REDACTIONS[:-1]:
        x = F.regexp_replace(x, "(?U)" + pattern, by)
    pattern, by = REDACTIONS[-1]
    return F.when(x.rlike(LABELS), F.regexp_replace(x, "(?U)" + pattern, by)).otherwise(x)


def entropy(x: Column) -> Column:
    """Shannon entropy in bits per character: log2(n) less the mean of log2 of each character's count. The characters are
    sorted, and each run of equal ones adds its share where it ends."""
    n = F.length(x)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def share(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run.cast("double"))).otherwise(0.0)

    def step(s: Column, c: Column) -> Column:
        same = F.struct(c.alias("last"), (s["run"] + 1).alias("run"), s["sum"].alias("sum"))
        other = F.struct(c.alias("last"), F.lit(1).alias("run"), (s["sum"] + share(s["run"])).alias("sum"))
        return F.when(s["last"] == c, same).otherwise(other)

    return F.aggregate(F.array_sort(F.split(x, "")), start, step, lambda s: F.log2(n.cast("double")) - (s["sum"] + share(s["run"])) / n)


def looks_secret(token: Column) -> Column:
    return (F.length(token) >= ENTROPY_CHARS) & ~token.rlike(r"[/\\]") & token.rlike(r"(?U)\p{Nd}") & token.rlike(r"(?U)\p{L}") & (entropy(token) > ENTROPY_BITS)


def entropy_redacted(x: Column) -> Column:
    tokens = F.regexp_extract_all(x, F.lit(r"(?U)\S+|\s+"), F.lit(0))
    swept = F.array_join(F.transform(tokens, lambda t: F.when(looks_secret(t), F.lit("[REDACTED_HIGH_ENTROPY]")).otherwise(t)), "")
    return F.when(x.rlike(rf"(?U)\S{{{ENTROPY_CHARS},}}"), swept).otherwise(x)


def redacted(x: Column) -> Column:
    return entropy_redacted(pattern_redacted(x))


def rendered(turns: Column) -> Column:
    """An array of (turn_idx, role, text) as lines `ROLE: text`, in order."""
    return F.array_join(F.transform(F.array_sort(turns), lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"])), "\n")


def tail(x: Column, chars: int) -> Column:
    """The last chars characters from a line's start on, if x is longer."""
    end = F.right(x, F.lit(chars))
    at = F.instr(end, "\n")
    return F.when(F.length(x) <= chars, x).when(at > 0, F.substr(end, at + 1)).otherwise(end)


def head(x: Column, chars: int) -> Column:
    return F.left(x, F.lit(chars))


def first_sentence(x: Column) -> Column:
    return F.rtrim(F.substring_index(x, ". ", 1), F.lit("."))


def remote(url: Column) -> Column:
    """A remote's URL without closing slashes and one .git."""
    return F.regexp_replace(F.rtrim(url, F.lit("/")), r"\.git$", "")


def remote_name(url: str) -> str:
    """remote() of one string on the driver."""
    return url.rstrip("/").removesuffix(".git")


def project_key(url: Column, root: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(remote(url), F.lit("")), F.nullif(root, F.lit("")), path)


def new_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))
