"""URL filters: pattern rules indexed by their rarest literal token.

Each rule has literal tokens that every match contains. How often the rules'
tokens occur is counted over all URLs, and each rule is filed under its rarest
one. The tokens of a URL fetch the rules filed under them, and only the regular
expressions of those run. The index holds the rules that the caller passes, so
its size is theirs and does not depend on the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = r"[A-Za-z0-9]+"  # a literal token; anything else, letters beyond ASCII too, ends it
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)  # the only change of case: it makes no new tokens


@dataclass(frozen=True)
class Rule:
    """A rule: its name, verdict, patterns that the whole host and a head of the path fit, literal tokens (lower-case) and rank (the highest wins)."""

    name: str
    verdict: str
    host: str
    path: str
    tokens: tuple[str, ...]
    rank: int


def _tokens_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(_TOKEN, text.translate(_TO_LOWER)))


def host_rule(rule: str, verdict: str) -> Rule:
    """Rule for a host with all its subdomains and a path prefix, written ``example.org/es/``; the longest wins.

    The last token of the path may go on in the URL, so it is literal only if
    the prefix ends after it.
    """
    host, slash, path = rule.partition("/")
    path = slash + path
    host = host.translate(_TO_LOWER)
    whole = re.sub(_TOKEN + r"\Z", "", path)
    return Rule(rule, verdict, rf"(?:.*\.)?{re.escape(host)}", re.escape(path), _tokens_of(host) + _tokens_of(whole), 1000 + len(rule))


def path_rule(word: str) -> Rule:
    """Block any URL with the word as a whole token of its path, in just this case; ``word`` is one token."""
    if not re.fullmatch(_TOKEN, word):
        raise ValueError(f"not a token: {word}")
    return Rule(f"*{word}*", "block", ".*", rf".*(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])", _tokens_of(word), len(word))


#: Rules of the registered query (fixed values), host rules first.
HOST_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BLOCKED_WORDS = ("casino", "login", "porn", "signup", "viagra")


def with_host_and_path(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host`` (A-Z lowered) and ``path``; both are empty for a null URL or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    lowered = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return urls.withColumns({"host": lowered, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def _tokens() -> Column:
    return F.regexp_extract_all(F.translate(F.concat_ws(" ", "host", "path"), _UPPER, _LOWER), F.lit(f"({_TOKEN})"), F.lit(1))


def token_counts(parts: DataFrame, tokens: set[str]) -> dict[str, int]:
    """URLs in which each of ``tokens`` (of the rules) occurs."""
    used = F.array_intersect(_tokens(), F.array(*[F.lit(t) for t in sorted(tokens)]))
    return {r["t"]: r["n"] for r in parts.select(F.explode(used).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; those without tokens are under the empty one."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(rule)
    return index


def best_rule(host: str, path: str, index: dict[str, list[tuple[re.Pattern, re.Pattern, Rule]]]) -> Rule | None:
    """The rule of highest rank that fits; only rules filed under a token of the URL, or under none, are tried."""
    best = None
    for t in {"", *_tokens_of(f"{host} {path}")}:
        for on_host, on_path, rule in index.get(t, ()):
            if (best is None or (rule.rank, rule.name) > (best.rank, best.name)) and on_host.fullmatch(host) and on_path.match(path):
                best = rule
    return best


def compiled(index: dict[str, list[Rule]]) -> dict[str, list[tuple[re.Pattern, re.Pattern, Rule]]]:
    return {t: [(re.compile(r.host, re.DOTALL), re.compile(r.path, re.DOTALL), r) for r in rules] for t, rules in index.items()}


def _judge(batches, index):
    """mapInArrow body: (.., host, path) -> .., host, path, the name and the verdict of the best rule that fits."""
    ready = compiled(index)
    for batch in batches:
        best = [best_rule(h, p, ready) for h, p in zip(*(batch.column(batch.num_columns - i).to_pylist() for i in (2, 1)), strict=True)]
        names, verdicts = ([getattr(r, field) if r else None for r in best] for field in ("name", "verdict"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (name or null), verdict (of the rule of highest rank that fits, else ``default``).

    Null, empty and malformed URLs have an empty host and path and fit only rules
    that match those. Repeated rows and null ids each keep a row of their own.
    Columns other than the named ones are ignored.
    """
    parts = with_host_and_path(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url").select("id", "host", "path")
    tokens = {t for r in rules for t in r.tokens}
    index = rule_index(rules, token_counts(parts, tokens) if tokens else {})
    judged = parts.mapInArrow(lambda it: _judge(it, index), f"id {parts.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(r, v) for r, v in HOST_RULES] + [path_rule(w) for w in BLOCKED_WORDS]
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    # a word rule decides the verdict; only host rules are named
    return judged.withColumn("rule", F.when(~F.col("rule").startswith("*"), F.col("rule")))


OP8_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) t(rule, rh, rp, verdict)),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, CASE WHEN regexp_matches(path, '(^|[^A-Za-z0-9])(casino|login|porn|signup|viagra)($|[^A-Za-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id)
"""
