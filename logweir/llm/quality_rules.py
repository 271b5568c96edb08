"""Host-level quality rules over documents, with DataFrame expressions only.

Per-text measures feed per-document rules; rule failures are summed by host, each host's failure rate is shrunk
with a beta prior that is fitted to all hosts by the method of moments, and the host's verdict, which compares its odds
of failure with those of the prior, is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

_WORDS = r"filter(split({t}, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
_LINES = r"filter(split({t}, '\n'), x -> btrim(x, ' \t\n\u000B\u000C\r') <> '')"
#: Documents that the prior weighs as at least.
LEAST_WEIGHT = 10.0
#: Bind: evaluates an expression once and names it.
_BIND = "element_at(transform(array({value}), {name} -> {body}), 1)"
#: Words covered by windows of five that occur twice: hashes of all windows, equal neighbours after a sort, union of their words.
_COVERED = (
    "aggregate(sort_array(transform(filter(s, (e, i) -> e.h = get(s, i - 1).h OR e.h = get(s, i + 1).h), e -> e.p)),"
    " named_struct('last', -5, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least(5, p - a.last)), a -> a.n)"
)
_SORTED = _BIND.format(value="sort_array(transform(h, (x, i) -> named_struct('h', x, 'p', i)))", name="s", body=_COVERED)
_REPEATS = "CASE WHEN size(w) < 6 THEN 0 ELSE " + _BIND.format(
    value="slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4))), 1, size(w) - 4)", name="h", body=f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {_SORTED} END"
) + " END"


def measures(text: str = "text") -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_upper of a text; null counts as empty."""
    t = f"coalesce({text}, '')"
    words = _BIND.format(value=_WORDS.format(t=t), name="w", body=f"named_struct('n_words', size(w), 'word_chars', length(array_join(w, '')), 'n_repeat_words', {_REPEATS})")
    lines = _BIND.format(value=_LINES.format(t=t), name="l", body="named_struct('n_lines', size(l), 'n_dup_lines', size(l) - size(array_distinct(l)))")
    symbols = f"length(regexp_replace({t}, '[^#*$%&|<>]+', ''))"
    upper = f"length(regexp_replace({t}, '[^A-Z]+', ''))"
    return F.expr(f"named_struct('w', {words}, 'l', {lines}, 'n_symbols', {symbols}, 'n_upper', {upper})")


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20, max_symbol_percent: int = 10, max_dup_line_percent: int = 30, max_upper_percent: int = 50, reject_odds: float = 6.0, distrust_odds: float = 1.1) -> DataFrame:
    """One row for each input row: id, measures, base_failed, failed, host_rate, host_distrusted, host_rejected and kept.

    Base rules: too few words, or too many of them in repeated five-word windows. Further rules: symbols against words,
    repeated lines against lines, capitals against characters of words. A host's rate is the share of its documents that
    fail any rule, shrunk to (failures + a) / (documents + a + b); the prior's mean is a / (a + b). A host is rejected, with
    all its documents, if the odds of its rate are reject_odds times those of the mean, or more; it is distrusted from
    distrust_odds times on: its documents that fail any rule go. Elsewhere further failures are forgiven and only base
    failures go. Where all hosts fail alike, none is worse than the mean.

    Null or empty hosts count as one host; null texts as empty ones, which fail. Repeated rows and ids are kept as they
    are, an empty table gives an empty table, and other columns of the input are ignored. Windows are compared by 64-bit
    hashes within one text.
    """
    m = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), measures(f"`{text_col}`").alias("m"))
    long = lambda c: F.col(c).cast("long")
    m = m.select("doc_id", "host", long("m.w.n_words").alias("n_words"), long("m.w.word_chars").alias("word_chars"), long("m.n_symbols").alias("n_symbols"), long("m.l.n_dup_lines").alias("n_dup_lines"), long("m.w.n_repeat_words").alias("n_repeat_words"), long("m.l.n_lines").alias("n_lines"), long("m.n_upper").alias("n_upper"))
    c = F.col
    base = (c("n_words") < min_words) | (100 * c("n_repeat_words") > max_repeat_percent * c("n_words"))
    more = (100 * c("n_symbols") > max_symbol_percent * c("word_chars")) | (100 * c("n_dup_lines") > max_dup_line_percent * c("n_lines")) | (100 * c("n_upper") > max_upper_percent * c("word_chars"))
    m = written(m.withColumn("base_failed", base).withColumn("failed", base | more), "rules")
    hosts = written(m.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k")), "hosts")
    a, b = beta_prior(hosts)
    mean = a / (a + b)
    rate = (c("k") + F.lit(a)) / (c("n") + F.lit(a + b))
    worse = lambda odds: (c("host_rate") > mean) & (c("host_rate") * (1 - mean) >= odds * mean * (1 - c("host_rate")))
    verdicts = hosts.select(c("host").alias("verdict_host"), rate.alias("host_rate")).select("*", worse(distrust_odds).alias("host_distrusted"), worse(reject_odds).alias("host_rejected"))
    out = m.join(verdicts, c("host") == c("verdict_host"), "left").drop("verdict_host")
    return out.withColumn("kept", ~c("base_failed") & ~c("host_rejected") & ~(c("failed") & c("host_distrusted")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """a and b of the beta distribution with the mean and variance of the hosts' rates (one row comes to the driver).

    The prior weighs as a + b documents: as LEAST_WEIGHT at least, however much hosts differ, so that a few documents don't
    condemn a host, and as a million without spread or with one host.
    """
    row = hosts.select((F.col("k") / F.col("n")).alias("r")).agg(F.avg("r").alias("m"), F.var_pop("r").alias("v")).first()
    m, v = (row["m"] or 0.0), (row["v"] or 0.0)
    weight = 1e6 if v <= 1e-9 else min(1e6, max(LEAST_WEIGHT, m * (1 - m) / v - 1))
    return m * weight, (1 - m) * weight


def op3_host_quality_rules(spark, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept", "host_distrusted", "host_rejected")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS d FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
  len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_upper > 50 * word_chars AS failed FROM b),
h AS (SELECT host, count(*) AS n, sum(CAST(failed AS BIGINT)) AS k FROM f GROUP BY host),
s AS (SELECT avg(k / n) AS mu, var_pop(k / n) AS v FROM h),
q AS (SELECT mu, CASE WHEN v <= 1e-9 THEN 1e6 ELSE least(1e6, greatest(10.0, mu * (1 - mu) / v - 1)) END AS weight FROM s),
z AS (SELECT host, mu, (k + mu * weight) / (n + weight) AS rate FROM h, q),
v AS (SELECT host, rate > mu AND rate * (1 - mu) >= 1.1 * mu * (1 - rate) AS host_distrusted, rate > mu AND rate * (1 - mu) >= 6.0 * mu * (1 - rate) AS host_rejected FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed,
  NOT base_failed AND NOT host_rejected AND NOT (failed AND host_distrusted) AS kept, host_distrusted, host_rejected
FROM f JOIN v ON f.host = v.host
"""
