"""Quality rules judged per host: documents fail rules, hosts fail documents.

Everything is a DataFrame expression. A document's measures come from one pass over its words. Failures are then
counted per host, each host's rate is shrunk towards the rate of all hosts with a beta prior whose two parameters
are estimated from the hosts themselves, and the verdict on the host is joined back to its documents.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import WORD_PATTERN, materialised, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Host tables up to this many rows and bytes are sent to every executor; larger ones are joined by salted keys.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4_000_000
SALTS = 16
#: The prior counts for at least so many documents of a host, however unlike the hosts are.
LEAST_STRENGTH = 10


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A document that breaks a base rule goes whatever its host's verdict is."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    min_mean_word: int = 2
    max_mean_word: int = 15
    window: int = 8
    max_host_rate: float = 0.5


def measure(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The input with the columns of ``MEASURES`` (longs); columns of those names are replaced.

    Null and empty texts measure 0 throughout. Repeated words are those inside a window of ``rules.window`` words
    that occurs at least twice in the text; windows are compared by a 64-bit hash within one text.
    """
    w = rules.window
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD_PATTERN))
    out = docs.withColumns({"__words": words(F.col(text)), "__lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__hashes": F.transform("__words", lambda x: F.xxhash64(x)),
        }
    ).drop("__words", "__lines")
    starts = F.sequence(F.lit(1), F.size("__hashes") - (w - 1))
    out = out.withColumn("__windows", F.when(F.size("__hashes") >= w, F.transform(starts, lambda i: F.xxhash64(F.slice("__hashes", i, w))))).drop("__hashes")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    # Equal windows stand side by side once sorted; the few texts that have some carry on, the others hold null.
    out = out.withColumn("__sorted", F.when(repeats, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    near = lambda x, j: F.when((x["h"] == F.get("__sorted", j - 1)["h"]) | (x["h"] == F.get("__sorted", j + 1)["h"]), x["i"])
    out = out.withColumn("__starts", F.array_sort(F.array_compact(F.transform("__sorted", lambda x, j: near(x, j))))).drop("__sorted")
    step = F.transform("__starts", lambda p, j: F.least(F.lit(w), F.coalesce(F.get("__starts", j + 1) - p, F.lit(w))).cast("long"))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__starts")
    # A filter on a measure must not move below its steps: it would repeat them for every time a step names another.
    # No filter passes an explode, even of one row.
    others = [c for c in out.columns if c not in MEASURES]
    row = F.explode(F.array(F.struct(*MEASURES))).alias("__m")
    return out.select(*others, row).select(*others, *[F.col(f"__m.{m}").alias(m) for m in MEASURES])


def base_failed(rules: Rules = Rules()) -> Column:
    """Over measured rows: too short, or too much of the text stands in repeated windows."""
    n = F.col("n_words")
    return (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)


def any_failed(rules: Rules = Rules()) -> Column:
    """Over measured rows: any rule, base or not, is broken."""
    n = F.col("n_words")
    return (
        base_failed(rules)
        | (100 * F.col("n_symbols") > rules.max_symbol_percent * n)
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
        | (F.col("word_chars") < rules.min_mean_word * n)
        | (F.col("word_chars") > rules.max_mean_word * n)
    )


def host_verdicts(measured: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per host (null is a host too): ``host, n_docs, n_failed, host_rate, host_rejected``.

    ``host_rate`` is the mean of the host's beta posterior. The prior's mean is the failure rate of all documents
    and its strength follows from how much the hosts' rates vary beyond chance, so that a host of few documents
    keeps near the common rate and only much evidence condemns a host: a rate over ``rules.max_host_rate`` that also
    lies nearer to 1 than to the common rate. Hosts are counted with partial sums before
    the shuffle, so one host may hold any share of the rows.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(any_failed(rules).cast("long")).alias("n_failed"))
    hosts = materialised(hosts)
    n, f = F.col("n_docs"), F.col("n_failed")
    k, docs, failed, squares, spread = hosts.agg(
        F.count(F.lit(1)), F.sum(n).cast("double"), F.sum(f).cast("double"), F.sum(n.cast("double") * n), F.sum(f.cast("double") * f / n)
    ).first()
    if not k:
        return hosts.withColumns({"host_rate": F.lit(0.0), "host_rejected": F.lit(False)})
    mean = failed / docs
    noise = mean * (1 - mean)
    scale = noise * (docs - squares / docs - (k - 1))
    share = (spread - mean * mean * docs - noise * (k - 1)) / scale if scale > 0 else 0.0
    strength = 1 / min(max(share, 1e-6), 1 / (1 + LEAST_STRENGTH)) - 1
    rate = (f + F.lit(mean * strength)) / (n + F.lit(strength))
    return hosts.withColumns({"host_rate": rate, "host_rejected": rate > max(rules.max_host_rate, (1 + mean) / 2)})


def judge(measured: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Measured rows with ``base_failed``, ``host_rate``, ``host_rejected`` and ``kept``; such columns are replaced.

    ``kept`` is false for documents that break a base rule and for all documents of a rejected host. The table of
    hosts is sent to all executors only if its counted rows and bytes are within a fixed bound. Else both sides of
    the join are salted, so that no task gets all documents of a large host.
    """
    verdicts = host_verdicts(measured, host, rules).select(F.col("host").alias("__host"), F.col("host_rate").alias("__rate"), F.col("host_rejected").alias("__bad"))
    rows, size = verdicts.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(F.col("__host").cast("string")), F.lit(0)))).first()
    if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        joined = measured.join(F.broadcast(verdicts), F.col(host).eqNullSafe(F.col("__host")), "left")
    else:
        spread = verdicts.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        salted = measured.withColumn("__own", F.pmod(F.xxhash64(*[F.col(c) for c in MEASURES]), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, F.col(host).eqNullSafe(F.col("__host")) & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
    failed = base_failed(rules)
    return joined.withColumns({"base_failed": failed, "host_rate": F.col("__rate"), "host_rejected": F.col("__bad"), "kept": ~failed & ~F.col("__bad")}).drop("__host", "__rate", "__bad")
