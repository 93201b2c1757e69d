"""URL filtering: host rules, and pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression. The literal tokens that any match must
hold are read off the expression, and the rule is filed under that one of them
which the fewest URLs hold. A URL's own tokens fetch its candidate rules; only
those run. Rules can be loaded from a file.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule, and is judged by the patterns over its whole string (null: allowed).
Repeated rows each get a row; an empty table gives an empty result; other
columns are carried by name only where asked for. Very long URLs are judged
whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from re import _constants as C
from re._parser import parse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_TOKEN_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the URL with A-Z lower-cased."""

    name: str
    verdict: str
    pattern: str

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        """Runs of [a-z0-9] that every match holds and that end there: after each stands another character or the URL's end."""
        return tuple(t for t, _ in literal_tokens(self.pattern))

    @cached_property
    def ends(self) -> tuple[str, ...]:
        """Those of the tokens that a match may also hold as the end of a longer run."""
        return tuple(t for t, whole in literal_tokens(self.pattern) if not whole)


def _takes(node: tuple, code: int) -> bool:
    """Whether a node of one character takes the character; unknown kinds count as taking it."""
    op, arg = node
    if op is C.LITERAL:
        return arg == code
    if op is C.NOT_LITERAL:
        return arg != code
    if op is C.RANGE:
        return arg[0] <= code <= arg[1]
    if op is C.IN:
        negated = arg[0][0] is C.NEGATE
        return any(_takes(x, code) for x in arg[negated:]) != negated
    return True


def _bounded(nodes: list[tuple], last: bool, outside: bool) -> bool:
    """Whether every match of the sequence has, at its last (or first) place, no character of [a-z0-9].

    outside: whether what stands beyond the sequence is bounded, which counts
    where the sequence may be empty.
    """
    if not nodes:
        return outside
    (op, arg), rest = (nodes[-1], nodes[:-1]) if last else (nodes[0], nodes[1:])
    if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
        return not any(_takes((op, arg), ord(c)) for c in _TOKEN_CHARS)
    if op is C.AT:
        return arg in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING)
    beyond = _bounded(rest, last, outside)
    if op is C.SUBPATTERN:
        return _bounded(list(arg[-1]), last, beyond)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        return _bounded(list(arg[2]), last, beyond) and (arg[0] > 0 or beyond)
    if op is C.BRANCH:
        return all(_bounded(list(b), last, beyond) for b in arg[1])
    return False


def literal_tokens(pattern: str) -> list[tuple[str, bool]]:
    """Tokens that every match of the expression holds, and whether each is a whole run.

    Only runs of literal characters outside groups and repeats are taken, and of
    these only those after which no character of [a-z0-9] can stand.
    """
    nodes = list(parse(pattern))
    found, k = [], 0
    while k < len(nodes):
        z = k
        while z < len(nodes) and nodes[z][0] is C.LITERAL and chr(nodes[z][1]) in _TOKEN_CHARS:
            z += 1
        if z > k and _bounded(nodes[z:], False, False):
            found.append(("".join(chr(c) for _, c in nodes[k:z]), _bounded(nodes[:k], True, False)))
        k = max(z, k + 1)
    return found


def parse_rules(lines: Iterable[str]) -> tuple[PatternRule, ...]:
    """Rules from lines of a name, allow or block, and the expression; empty lines and those from # are passed over."""
    rules = []
    for line in lines:
        if line.strip() and not line.lstrip().startswith("#"):
            name, verdict, pattern = line.split(None, 2)
            if verdict not in ("allow", "block"):
                raise ValueError(f"rule {name}: neither allow nor block")
            re.compile(pattern := pattern.rstrip())
            rules.append(PatternRule(name, verdict, pattern))
    return tuple(rules)


def load_rules(spark: SparkSession, path: str) -> tuple[PatternRule, ...]:
    """The rules of a text file that Spark can read; a rule list is small and is held by the driver."""
    return parse_rules(spark.sparkContext.wholeTextFiles(path).first()[1].splitlines())


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
PATTERN_RULES = (
    PatternRule("ad-host", "block", r"://([^/?#]*[.-])?ads[.-]"),
    PatternRule("tracker", "block", r"[.-]track[.-][^/?#]*/"),
    PatternRule("casino", "block", r"[^a-z0-9]casino[^a-z0-9]"),
    PatternRule("adult", "block", r"[^a-z0-9]porn[^a-z0-9]"),
    PatternRule("login", "block", r"/login/?([?#]|$)"),
    PatternRule("session", "block", r"[?&;]phpsessid="),
    PatternRule("feed", "block", r"/feed/?\?[^#]*format=rss(&|#|$)"),
    PatternRule("academic", "allow", r"://[^/?#]*\.edu[/?#:]"),
)

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ASCII = str.maketrans(*_LOWER)


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with the columns host and path after its own; JVM side."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, *_LOWER), "path": path})


def rule_tokens(rules: Sequence[PatternRule]) -> list[str]:
    return sorted({t for r in rules for t in r.tokens})


def token_rarity(df: DataFrame, rules: Sequence[PatternRule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token of the rules: counts over all rows.

    Only tokens that rules name are counted, so the result has at most as many
    rows as the rules have tokens; they are looked up in one hash table a task, and
    summed before the shuffle.
    """
    known = rule_tokens(rules)
    if not known:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(url_col), F.lit("")), *_LOWER), F.lit("[a-z0-9]+"), F.lit(0)))
    # A rule list is small: the driver holds it.
    named = F.broadcast(df.sparkSession.createDataFrame([(t,) for t in known], "token string"))
    held = df.select(F.explode(tokens).alias("token")).join(named, "token", "left_semi")
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


class PatternIndex:
    """Rules under their rarest token; rules without a token are tried always.

    Where a match may also hold that token as the end of a longer run, a URL's run
    looks up its ends of the lengths that such tokens have, so the work follows the
    number of lengths, not that of rules.
    """

    def __init__(self, rules: Sequence[PatternRule], rarity: dict[str, int]):
        self.rules = [(r.name, r.verdict, re.compile(r.pattern)) for r in rules]
        self.by_token: dict[str, list[int]] = {}
        self.by_end: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, r in enumerate(rules):
            if r.tokens:
                rarest = min(r.tokens, key=lambda t: (rarity.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(k)
                if rarest in r.ends:
                    self.by_end.setdefault(rarest, []).append(k)
            else:
                self.always.append(k)
        self.lengths = sorted({len(t) for t in self.by_end})

    def judge(self, url: str | None) -> tuple[str | None, str, int]:
        """The first fitting rule in the order given, its verdict, and how many expressions ran."""
        if not url:
            return None, "allow", 0
        low = url.translate(_ASCII)
        found = set(self.always)
        for t in set(_TOKEN.findall(low)):
            found.update(self.by_token.get(t, ()))
            for n in self.lengths:
                if n >= len(t):
                    break
                found.update(self.by_end.get(t[-n:], ()))
        for n, k in enumerate(sorted(found), 1):
            name, verdict, pattern = self.rules[k]
            if pattern.search(low):
                return name, verdict, n
        return None, "allow", len(found)


def match_patterns(df: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES, url_col: str = "url", keep: Sequence[str] = ()) -> DataFrame:
    """url and keep columns, with pattern (rule name or null), pattern_verdict and tried."""
    rarity = token_rarity(df, rules, url_col)
    rules = tuple(rules)
    narrow = df.select(*[F.col(c) for c in keep], F.col(url_col).alias("_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PatternIndex(rules, rarity)
        for b in batches:
            got = [index.judge(u) for u in b.column("_url").to_pylist()]
            cols = [b.column(c) for c in keep] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "pattern", "pattern_verdict", "tried"])

    out = narrow.drop("_url").schema.add("pattern", "string").add("pattern_verdict", "string").add("tried", "long")
    return narrow.mapInArrow(run, out)


def host_rule(host, path, rules: Sequence[HostRule] = HOST_RULES):
    """The longest fitting host rule as a struct(rule, verdict), else null; JVM side."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", hosts: Sequence[HostRule] = HOST_RULES, patterns: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """id, host, path, rule, verdict, pattern, tried for every row.

    The host rule decides where one fits, else the pattern rules, else allow.
    """
    split = split_url(df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_u")), "_u")
    got = match_patterns(split, patterns, "_u", keep=["_id", "host", "path"])
    got = got.withColumn("_r", host_rule(F.col("host"), F.col("path"), hosts))
    return got.select(F.col("_id").alias(id_col), "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), F.col("pattern_verdict")).alias("verdict"), "pattern", "tried")
