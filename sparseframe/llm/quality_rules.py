"""Host-level quality rules, in DataFrame functions only.

Per document: counts of words, symbols, repeated lines and repeated three-word windows, and
the base rules on them. Per host: failures over documents, shrunk towards an empirical beta
prior (moments over all hosts), so that a host with few documents isn't judged by them
alone. A host whose shrunk rate reaches ``host_rate`` is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, clean_name, without

_SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"
#: A window's position takes so many bits beside its hash; texts of more words go by structs.
_POS_BITS = 21

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, none for null or empty; in memory all at once, however many."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _SPACE))


def _covered(starts: Column) -> Column:
    """Positions that 3-word windows at the ascending `starts` cover."""
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    return F.aggregate(starts, nothing, lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def _windows(words: Column, key) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 3), key)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with MEASURES, each a long. A null or blank text has no words, no lines and no symbols."""
    docs = without(docs, MEASURES)
    w, keys, hits, twins, exact = (clean_name(n, docs.columns) for n in ("_words", "_keys", "_hits", "_twins", "_exact"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(_TRIM)) != "")
    same = lambda p, q: F.forall(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: F.get(F.col(w), p + d) == F.get(F.col(w), q + d))
    mask = (1 << _POS_BITS) - 1
    pos = lambda k: k.bitwiseAND(F.lit(mask)).cast("int")

    def packed(i):
        h = F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))
        return F.shiftleft(h, _POS_BITS).bitwiseOR(i.cast("long"))

    n_keys = F.size(F.col(keys))
    # neighbours in hash order with one hash: positions of windows that may be found twice
    pairs = F.filter(F.sequence(F.lit(0), n_keys - 2), lambda j: F.shiftright(F.get(F.col(keys), j).bitwiseXOR(F.get(F.col(keys), j + 1)), _POS_BITS) == 0)
    found = F.filter(F.col(hits), lambda j: same(pos(F.get(F.col(keys), j)), pos(F.get(F.col(keys), j + 1))))
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(F.col(twins), lambda j: F.array(pos(F.get(F.col(keys), j)).cast("long"), pos(F.get(F.col(keys), j + 1)).cast("long"))))))

    # of very long texts, and where other words share a hash and may stand between twins: the windows themselves in order, with their positions
    windows = F.array_sort(_windows(F.col(w), lambda i: F.struct(F.slice(F.col(w), i + 1, 3).alias("w"), i.cast("long").alias("i"))))
    at = lambda j: F.get(F.col(exact), j)["w"]
    marked = F.transform(F.col(exact), lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(at(j - 1) == x["w"], F.lit(False)) | F.coalesce(at(j + 1) == x["w"], F.lit(False))).alias("two")))
    exact_starts = F.sort_array(F.transform(F.filter(marked, lambda x: x["two"]), lambda x: x["i"]))
    n = F.size(F.col(w))
    big = n > mask
    out = docs.withColumn(w, words_of(F.col(f"`{text_col}`").cast("string")))
    out = out.withColumn(keys, F.when((n >= 4) & ~big, F.sort_array(_windows(F.col(w), packed))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn(hits, F.when(n_keys >= 2, pairs).otherwise(F.array().cast("array<int>")))
    out = out.withColumn(twins, F.when(F.size(F.col(hits)) > 0, found).otherwise(F.array().cast("array<int>")))
    out = out.withColumn(exact, F.when(big | (F.size(F.col(twins)) < F.size(F.col(hits))), windows))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(text, _SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.col(exact).isNotNull(), _covered(exact_starts)).when(F.size(F.col(twins)) > 0, _covered(starts)).otherwise(F.lit(0).cast("long")),
    })
    return out.drop(w, keys, hits, twins, exact)


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_verdicts(rows: DataFrame, host_col: str, host_rate: float = 0.5, min_strength: float = 1.0) -> DataFrame:
    """rows (host, base_failed) -> (host, n_docs, n_failed, rate, rejected) per non-null host.

    The prior beta(a, b) has the moments of the hosts' raw rates: mean m, and strength
    a + b = m (1 - m) / v - 1 of their variance v, at least `min_strength` (which also stands
    in where one host, or no variance, leaves v undefined). rate = (failed + a) / (docs + a + b).
    """
    hosts = rows.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(raw), F.var_samp(raw)).first()  # two numbers
    m = 0.0 if m is None else m
    strength = m * (1 - m) / v - 1 if v else None
    strength = min_strength if strength is None else max(strength, min_strength)
    rate = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") >= host_rate)


def quality_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", keep_text: bool = True, min_words: int = 50, repeat_percent: int = 50, host_rate: float = 0.5, broadcast_hosts: int = 500_000
) -> DataFrame:
    """docs -> docs with MEASURES, base_failed, host_rate and kept; the text column is left out if not `keep_text`.

    A document with a null host is judged by the base rules alone (host_rate null). Rows are
    never merged: repeated rows each count and each come back. Input columns named like an
    output are dropped. The rows with their measures are written once to the shared folder;
    from there they are read for the hosts' sums and for the verdicts. Verdicts of up to
    `broadcast_hosts` hosts are broadcast; more are joined by shuffle, where adaptive
    execution splits the partitions of hosts with many documents.
    """
    bounded_batches(docs.sparkSession)
    out = ("base_failed", "host_rate", "kept")
    rows = measured(without(docs, out), text_col).withColumn("base_failed", base_failed(min_words, repeat_percent))
    if not keep_text:
        rows = rows.drop(text_col)
    tmp = Scratch(docs.sparkSession)
    rows = tmp.cut(rows, "measured")
    hosts = host_verdicts(rows, host_col, host_rate)
    h = clean_name("_host", rows.columns)
    r, bad = clean_name("_rate", rows.columns), clean_name("_rejected", rows.columns)
    hosts = tmp.cut(hosts, "hosts")
    verdicts = hosts.select(F.col("host").alias(h), F.col("rate").alias(r), F.col("rejected").alias(bad))
    if hosts.count() <= broadcast_hosts:
        # so documents stay where they are, and a host with a third of them too
        verdicts = F.broadcast(verdicts)
    joined = rows.join(verdicts, F.col(f"`{host_col}`") == F.col(h), "left")
    return joined.withColumn("host_rate", F.col(r)).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col(bad), F.lit(False))).drop(h, r, bad)


#: The rows of quality_rules with its defaults: doc_id, MEASURES, base_failed, kept.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY r),
m AS (
  SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT avg(x / n) AS mu, CASE WHEN var_samp(x / n) > 0 THEN greatest(avg(x / n) * (1 - avg(x / n)) / var_samp(x / n) - 1, 1.0) ELSE 1.0 END AS s FROM h),
v AS (SELECT source, (x + mu * s) / (n + s) >= 0.5 AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept
FROM f LEFT JOIN v USING (source)
"""
