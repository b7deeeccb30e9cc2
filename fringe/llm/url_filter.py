"""URL filtering: host and path rules first, a weighted vocabulary where no rule fits.

The vocabulary is an Aho-Corasick automaton over strict and soft terms. A hit counts only between
boundaries (no ASCII letter or digit on either side, upper case read as lower). One strict term, or
two or more soft terms whose distinct weights reach ``soft_limit``, reject the url.

A few rules are part of the plan; from ``PLAN_RULES`` on they are joined by hash on every parent domain of a
url's host and every length of path that rules have, with the same result. A large vocabulary is cut into automata of
bounded size, which a task runs in turn.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
STRICT = ("casino", "porn", "xxx", "viagra", "warez", "escort", "jackpot", "gambling")
SOFT = {"spam": 1.0, "farm": 1.0, "ads": 1.0, "track": 1.0, "win": 1.0, "bonus": 1.0, "free": 1.0, "adult": 1.5, "hack": 1.0, "pills": 1.5, "crack": 1.0, "torrent": 1.0}
SOFT_LIMIT = 2.0
#: Rules that the plan carries; more are joined.
PLAN_RULES = 64
#: Characters of the terms in one automaton.
AUTOMATON_CHARS = 4 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


@lru_cache(maxsize=2)
def _automaton(terms: tuple[tuple[str, bool, float], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, strict, weight in terms:
        found.add_word(term, (len(term), strict, weight, term))
    found.make_automaton()
    return found


_TO_LOWER = str.maketrans(UPPER, LOWER)
_WORD = frozenset(LOWER + "0123456789")


def vocabulary_hits(urls: Sequence[str | None], terms: tuple[tuple[str, bool, float], ...]) -> list[tuple[int, int, float]]:
    """Distinct strict terms, distinct soft terms and the soft terms' weight in each url, by one run over all of them."""
    parts = [(u or "").translate(_TO_LOWER) for u in urls]
    text = "\n".join(parts)
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    strict, soft = [set() for _ in parts], [{} for _ in parts]
    if terms and text:
        for end, (size, is_strict, weight, term) in _automaton(terms).iter(text):
            start = end - size + 1
            if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                row = bisect_right(starts, start) - 1
                if is_strict:
                    strict[row].add(term)
                else:
                    soft[row][term] = weight
    return [(len(a), len(b), float(sum(b.values()))) for a, b in zip(strict, soft, strict=True)]


def _cut(terms: Sequence[tuple[str, bool, float]], size: int) -> list[tuple[tuple[str, bool, float], ...]]:
    """The terms in runs of up to ``size`` characters, at least one term each."""
    out: list[list[tuple[str, bool, float]]] = []
    held = size
    for term in terms:
        if held + len(term[0]) > size:
            out.append([])
            held = 0
        out[-1].append(term)
        held += len(term[0])
    return [tuple(x) for x in out]


def _longest_first(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest rule first, then longest host; of equal ones a block, then by code point."""
    return sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block", r[1], r[2]))


def _by_plan(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in reversed(_longest_first(rules)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        choice = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return rows.withColumn("choice", choice)


def _by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of each distinct host and path, by the hash of parent domain and beginning of the path."""
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())  # a few, below the longest url
    labels = F.split("host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    begins = F.transform(F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    places = rows.select("host", "path").distinct()
    tried = places.withColumn("r_host", F.explode(parents)).withColumn("r_path", F.explode(begins))
    size, block_first = F.length("r_host") + F.length("r_path"), F.when(F.col("verdict") == "block", 0).otherwise(1)
    best = F.struct((-size).alias("a"), (-F.length("r_host")).alias("b"), block_first.alias("c"), "r_host", "r_path", "verdict")
    met = tried.join(rules, ["r_host", "r_path"]).groupBy("host", "path").agg(F.min(best).alias("best"))
    choice = F.struct(F.concat("best.r_host", "best.r_path").alias("rule"), F.col("best.verdict").alias("verdict"))
    return rows.join(met.select(F.col("host").alias("m_host"), F.col("path").alias("m_path"), choice.alias("choice")), (F.col("host") == F.col("m_host")) & (F.col("path") == F.col("m_path")), "left").drop("m_host", "m_path")


def terms_of(vocabulary: DataFrame) -> list[tuple[str, bool, float]]:
    """The terms of a table ``term, strict, weight``, in lower case; a term that is strict in any row is strict, a soft one has its largest weight. Null and empty terms drop out.

    They go to every task: as many as an operator of word lists has, whatever the size of the table of urls.
    """
    low = vocabulary.select(ascii_lower(F.col("term")).alias("term"), F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight")).where("term <> ''")
    rows = low.groupBy("term").agg(F.max("strict").alias("strict"), F.max("weight").alias("weight")).collect()
    return [(r.term, r.strict, 0.0 if r.strict else r.weight) for r in rows]


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
    strict: Sequence[str] = STRICT,
    soft: Mapping[str, float] = SOFT,
    soft_limit: float = SOFT_LIMIT,
    vocabulary: DataFrame | None = None,
    plan_rules: int = PLAN_RULES,
    automaton_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """Rows ``<id_col>, host, path, rule, verdict, strict_hits, soft_hits, soft_weight`` for every row.

    A rule fits its host and all subdomains if the path starts with the rule's; of several the longest
    (host and path together, then the longer host) decides; of two verdicts for one host and path, the block. ``rules`` are (verdict, host, path)
    or a table of these columns, ``vocabulary`` a table (``terms_of``) instead of ``strict`` and ``soft``. With rules of the plan there is no shuffle.
    Urls that a rule decides are not looked up: their hits are 0. A null url, or one without ``://``, has empty host and path and is judged
    by the vocabulary alone, which finds nothing in a null. Repeated rows give repeated results; other
    columns are ignored.
    """
    if vocabulary is None:
        terms = [(t, True, 0.0) for t in strict] + [(t, False, float(w)) for t, w in soft.items() if t not in set(strict)]
    else:
        terms = terms_of(vocabulary)
    automata = _cut(sorted(terms), automaton_chars)

    @F.pandas_udf("strict_hits int, soft_hits int, soft_weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            total = pd.DataFrame({"strict_hits": np.zeros(len(urls), "int32"), "soft_hits": np.zeros(len(urls), "int32"), "soft_weight": np.zeros(len(urls))})
            asked = np.flatnonzero(urls.notna())
            for own in automata if len(asked) else []:
                found = np.array(vocabulary_hits(urls.iloc[asked].tolist(), own))
                for k, name in enumerate(total.columns):
                    total.iloc[asked, k] += found[:, k].astype(total[name].dtype)
            yield total

    rows = pages.select(F.col(id_col), F.col(url_col).alias("judged"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame):
        some = rules.select("verdict", "host", "path").distinct().limit(plan_rules + 1).collect()
        few = len(some) <= plan_rules
    else:
        some, few = rules, len(rules) <= plan_rules
    if few:
        rows = _by_plan(rows, [tuple(r) for r in some])
    else:
        rows = _by_join(rows, rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string"))
    rows = rows.withColumn("hit", hits(F.when(F.col("choice").isNull(), F.col("judged"))))
    own = F.when((F.col("hit.strict_hits") > 0) | ((F.col("hit.soft_hits") > 1) & (F.col("hit.soft_weight") >= soft_limit)), "block").otherwise("allow")
    return rows.select(id_col, "host", "path", F.col("choice.rule").alias("rule"), F.coalesce("choice.verdict", own).alias("verdict"), "hit.strict_hits", "hit.soft_hits", "hit.soft_weight")


def oracle(rules=RULES, strict=STRICT, soft=SOFT, soft_limit: float = SOFT_LIMIT) -> str:
    """The same over ``pages`` as DuckDB SQL, with one regular expression per term."""
    cases = {"rule": "", "verdict": ""}
    for verdict, host, path in _longest_first(rules):
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
        cases["rule"] += f" when {fits} then '{host + path}'"
        cases["verdict"] += f" when {fits} then '{verdict}'"
    has = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    count = lambda ts: " + ".join(f"{has(t)}::int" for t in ts)
    weight = " + ".join(f"({has(t)}::int * {w}::double)" for t, w in soft.items())
    return f"""
    with a as (select page_id, coalesce(url, '') as url, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as low from pages),
    b as (select *, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from a),
    c as (select *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from b),
    d as (select *, case {cases["rule"]} else null end as rule, case {cases["verdict"]} else null end as ruled from c),
    e as (select *, case when rule is null then {count(strict)} else 0 end as strict_hits, case when rule is null then {count(soft)} else 0 end as soft_hits, case when rule is null then {weight} else 0.0::double end as soft_weight from d)
    select page_id, host, path, rule, coalesce(ruled, case when strict_hits > 0 or (soft_hits > 1 and soft_weight >= {soft_limit}::double) then 'block' else 'allow' end) as verdict,
      cast(strict_hits as int) as strict_hits, cast(soft_hits as int) as soft_hits, soft_weight from e"""
