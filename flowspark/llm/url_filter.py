"""URL rules found by their rarest literal token.

A rule is a regular expression over a URL plus the literal tokens (runs of a-z and 0-9) every matching URL must
contain as whole tokens. Each rule is indexed under that one of its tokens that the fewest URLs contain, counted
over the table itself. The tokens of a URL fetch the rules filed under them, and only those rules' expressions run.

Two kinds of rules share the index. A *scope* rule (host, path prefix) fits its host and all subdomains; the longest
one that fits decides. Where none fits, *pattern* rules decide: an exception allows, else a match blocks, else the
URL is allowed.

Plan: one pass over the URLs, a join with the index (broadcast while the rule list is short enough to prove its
size, spread over salts beyond), and one aggregate per row whose map side already leaves a single row per URL.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no scope rule, and is allowed by
default; very long URLs are handled whole; repeated rows are judged one by one; among rules of equal length the
smaller rule text wins; an empty table gives an empty result. Other columns of the table are not carried along
unless named in ``keep``, whatever their names; of those called like a result column (host, path, rule, verdict) only
the result's stands.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_RULES = 20_000
SALTS = 16
_SEPARATOR = "\n"  # between host and path in the text that scope rules are matched against
_META = r"\.^$*+?{}[]|()"


@dataclass(frozen=True)
class Rule:
    """``scope`` rules match ``host \\n path``, others the whole URL; ``tokens`` are lower-case literals."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    length: int
    scope: bool


def literal_tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", text.translate(_LOWER))))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def scope_rule(verdict: str, text: str) -> Rule:
    """A rule like ``example.net/en/``: host and subdomains, path prefix.

    A prefix that stops inside a token (``/en``) still matches ``/english``, so its last token is not indexed.
    """
    host, slash, rest = text.partition("/")
    path = slash + rest
    host = host.translate(_LOWER)
    whole = path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path).group())]
    tokens = tuple(dict.fromkeys(literal_tokens(host) + literal_tokens(whole)))
    if not tokens:
        raise ValueError(f"rule {text!r} has no literal token")
    quoted = "".join("\\" + c if c in _META else c for c in host)
    prefix = "".join("\\" + c if c in _META else c for c in path)
    return Rule(text, verdict, rf"^(?:[^{_SEPARATOR}]*\.)?{quoted}{_SEPARATOR}{prefix}", tokens, len(text), True)


def pattern_rule(verdict: str, pattern: str, tokens: tuple[str, ...]) -> Rule:
    """A regular expression over the URL in lower case and the tokens that each of its matches holds whole."""
    if not tokens or any(literal_tokens(t) != (t,) for t in tokens):
        raise ValueError(f"pattern {pattern!r} needs literal tokens of a-z and 0-9")
    return Rule(pattern, verdict, pattern, tuple(tokens), len(pattern), False)


# The scope rules of the contract, and the patterns used where none of them fits.
SCOPE_RULES = [
    scope_rule("block", "net/"), scope_rule("allow", "example.net/en/"),
    scope_rule("block", "example.com/de/"), scope_rule("allow", "org/fr/"),
]
PATTERN_RULES = [
    pattern_rule("block", r"://[^/?#]*\bspam-farm\.", ("spam", "farm")),
    pattern_rule("block", r"://[^/?#]*\bcheap-pills\.", ("cheap", "pills")),
    pattern_rule("block", r"://[^/?#]*\bcasino\b", ("casino",)),
    pattern_rule("block", r"://(?:[^/?#]*\.)?ads\.", ("ads",)),
    pattern_rule("block", r"/wp-login\.php(?:\z|[?#])", ("wp", "login", "php")),
    pattern_rule("block", r"[?&]sessionid=", ("sessionid",)),
    pattern_rule("allow", r"/robots\.txt\z", ("robots", "txt")),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to ``?`` or ``#``; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return _lower(host), path


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(urls: DataFrame, url: str, rules: list[Rule]) -> DataFrame:
    """One row per rule, filed under its token that the fewest URLs hold (then the smallest token)."""
    spark = urls.sparkSession
    name_no = {name: i for i, name in enumerate(sorted({r.name for r in rules}))}
    rows = [(i, name_no[r.name], r.name, r.verdict, r.pattern, r.length, r.scope, list(r.tokens)) for i, r in enumerate(rules)]
    table = spark.createDataFrame(
        rows, "rule_no int, name_no int, name string, verdict string, pattern string, length int, scope boolean, "
        "tokens array<string>")
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(_tokens(F.col(f"`{url}`"))).alias("token"))
    counts = seen.join(_sized(wanted, rules), "token").groupBy("token").agg(F.count("*").alias("n"))
    options = table.withColumn("token", F.explode("tokens")).join(counts, "token", "left")
    first = Window.partitionBy("rule_no").orderBy(F.coalesce("n", F.lit(0)), "token")
    return options.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k", "n", "tokens")


def _sized(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df


def judge(urls: DataFrame, url: str, keep: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """``keep`` columns, host, path, the scope rule that fits (else null) and the verdict, for every row."""
    rules = SCOPE_RULES + PATTERN_RULES if rules is None else rules
    host, path = host_and_path(F.col(f"`{url}`"))
    kept = {f"__kept_{i}": c for i, c in enumerate(keep) if c.lower() not in ("host", "path", "rule", "verdict")}
    # The row number joins a row's candidates again; scans number their rows alike whenever they are repeated.
    base = urls.select(
        F.monotonically_increasing_id().alias("__row"), F.col(f"`{url}`").alias("__url"),
        *[F.col(f"`{c}`").alias(name) for name, c in kept.items()], host.alias("host"), path.alias("path"),
    ).withColumn("__text", F.concat("host", F.lit(_SEPARATOR), "path"))
    tokens = base.withColumn("token", F.explode_outer(_tokens(F.col("__url"))))
    index = rule_index(urls, url, rules)
    if len(rules) <= BROADCAST_RULES:
        found = tokens.join(F.broadcast(index), "token", "left")
    else:
        salted = index.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = tokens.withColumn("__salt", F.pmod(F.col("__row"), F.lit(SALTS)).cast("int")).join(
            salted, ["token", "__salt"], "left").drop("__salt")
    subject = F.when(F.col("scope"), F.col("__text")).otherwise(_lower(F.col("__url")))
    fits = F.col("name").isNotNull() & F.rlike(subject, F.col("pattern"))
    ranked = F.struct(F.col("length"), (-F.col("name_no")).alias("no"), F.col("name"), F.col("verdict"))
    best = found.groupBy("__row").agg(
        *[F.first(name).alias(name) for name in kept], F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(fits & F.col("scope"), ranked)).alias("__scope"),
        F.max(F.when(fits & ~F.col("scope"), F.col("verdict") == "allow").cast("int")).alias("__allow"),
    )
    by_pattern = F.when(F.col("__allow") == 0, F.lit("block")).otherwise(F.lit("allow"))
    return best.select(
        *[F.col(name).alias(c) for name, c in kept.items()], "host", "path", F.col("__scope")["name"].alias("rule"),
        F.coalesce(F.col("__scope")["verdict"], by_pattern).alias("verdict"),
    )
