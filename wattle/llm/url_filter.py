"""URL filters: site rules first, then a weighted vocabulary counted by Aho-Corasick.

Strict and soft terms are found in one pass over the URL; a hit counts only when no letter
or digit (of any script) touches it on either side. One strict hit, or ``soft_limit`` different soft terms,
blocks the URL. A site rule that fits decides before the vocabulary.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
and is judged by the vocabulary alone (null: no hit, allowed). Rows are judged one by one,
so repeated rows get equal answers and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns

# The default vocabulary (parameters of the operator).
STRICT = ("adult", "casino", "escort", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "cash", "cheap", "deal", "free", "loan", "lotto", "pills",
        "poker", "prize", "sexy", "track", "win")
SOFT_LIMIT = 2
#: The vocabulary and the rules travel to every task; both must stay below this many entries.
MAX_ENTRIES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def vocabulary_counts(spark, strict, soft):
    """Arrow function: lower-cased URL -> (number of strict hits, of different soft terms).

    The terms are a broadcast; a task builds its automaton once, for all of its batches."""
    sent = spark.sparkContext.broadcast([(t, True) for t in strict] + [(t, False) for t in soft])
    built = []

    def automaton():
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t, is_strict in sent.value:
            machine.add_word(t, (t, is_strict))
        if len(machine):
            machine.make_automaton()
        return machine

    @F.arrow_udf("struct<strict:int,soft:int>")
    def count(urls):
        import pyarrow as pa

        if not built:
            built.append(automaton())
        machine = built[0]
        n_strict, n_soft = [], []
        for url in urls.to_pylist():
            hits, seen = 0, set()
            for end, (t, is_strict) in machine.iter(url) if url and len(machine) else ():
                before, after = end - len(t), end + 1
                if (before >= 0 and url[before].isalnum()) or (after < len(url) and url[after].isalnum()):
                    continue
                if is_strict:
                    hits += 1
                else:
                    seen.add(t)
            n_strict.append(hits)
            n_soft.append(len(seen))
        return pa.StructArray.from_arrays([pa.array(n_strict, pa.int32()), pa.array(n_soft, pa.int32())], ["strict", "soft"])

    return count


def rule_match(rules: tuple[Rule, ...]):
    """Arrow function: (host, path) -> the longest rule that fits and its verdict."""
    by_host: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name)):
        by_host.setdefault(r.host, []).append(r)

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def match(hosts, paths):
        import pyarrow as pa

        found = []
        for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
            parts = host.split(".")
            fits = [r for i in range(len(parts)) for r in by_host.get(".".join(parts[i:]), ()) if path.startswith(r.path)]
            best = min(fits, key=lambda r: (-len(r.name), r.verdict != "block", r.name), default=None)
            found.append({"rule": best and best.name, "verdict": best and best.verdict})
        return pa.array(found, pa.struct([("rule", pa.string()), ("verdict", pa.string())]))

    return match


def filter_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit=SOFT_LIMIT) -> DataFrame:
    """``page_id, url, host, path, rule, strict_hits, soft_hits, verdict`` of every page."""
    if len(rules) + len(strict) + len(soft) > MAX_ENTRIES:
        raise ValueError(f"rules and terms are sent to every task: at most {MAX_ENTRIES} together")
    strict, soft = tuple(dict.fromkeys(strict)), tuple(t for t in dict.fromkeys(soft) if t not in set(strict))
    p = columns(pages, "page_id", "url")
    p = p.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("r", rule_match(tuple(rules))("host", "path"))
    p = p.withColumn("v", vocabulary_counts(pages.sparkSession, strict, soft)(ascii_lower(F.col("url"))))
    bad = (F.col("v.strict") > 0) | (F.col("v.soft") >= soft_limit)
    return p.select(
        "page_id", "url", "host", "path", F.col("r.rule").alias("rule"),
        F.col("v.strict").alias("strict_hits"), F.col("v.soft").alias("soft_hits"),
        F.coalesce(F.col("r.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
    )
