"""Quality rules by document and by host.

Each text gets its measures and rule failures; failures are summed by host (any column: here the source), each
host's failure rate is shrunk towards the overall rate by a beta prior fitted to the hosts' rates by moments, and the host is rejected if
the posterior leaves little doubt (5 %) that more than half of its documents fail. Its verdict is joined back to its documents.
A rate that is only above the mean rejects no host, as most of such a host's documents are good; but it counts for documents that fail a rule
that isn't one of the base: how far the worst of these rules is overstepped (the measure over its limit) is the evidence against the document, the host's shrunk rate the
prior, and the document goes if it is then more likely bad than good: rate * evidence > 1 - rate. So the same document may stay at a host that is
mostly good and go at one that isn't, while a document that fails no rule goes with its host only.

Cases: a null text has no words; an empty text neither; a very long text is measured whole; null hosts are one host; repeated rows count as often
as they stand there; an empty table gives an empty result; other columns are kept, unless an added column has their name.
Plan: the measures are made once for the sums by host (partial sums before the shuffle: one row for each
host and task) and once for the result, as writing rows with their texts in between would cost more than measuring
again; no text is shuffled. Host verdicts go to all executors if there are few hosts (counted), else they are joined.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lookup, small_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SPACE = b" \t\n\r\x0b\f"
#: Bytes that begin no character, and white space.
NO_WORD_CHAR = bytes(range(0x80, 0xC0)) + SPACE
SYMBOLS = b"#*$%&|<>"

MIN_WORDS, MAX_REPEAT_PCT, MAX_SYMBOL_PCT, MAX_DUP_LINE_PCT = 50, 50, 30, 60
#: A host is rejected if most of its documents fail, beyond doubt: if its shrunk rate, less so many posterior standard deviations, is above this.
MAX_HOST_RATE, DEVIATIONS = 0.5, 1.645


def measure(b: bytes) -> tuple[int, ...]:
    """MEASURES of a text in UTF-8."""
    words = b.split()  # at SPACE, as it is bytes
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    n, repeat = len(words), 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            twice = {w for w, k in Counter(windows).items() if k > 1}
            last = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeat += i + 3 - max(i, last)
                    last = i + 3
    return n, len(b.translate(None, NO_WORD_CHAR)), len(b) - len(b.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat


def measured(df: DataFrame, text: str = "text", to: str = "measures") -> DataFrame:
    """Add a struct of MEASURES."""

    small_batches(df.sparkSession)

    @F.arrow_udf("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    def of(texts: pa.Array) -> pa.Array:
        found = [measure(x.as_py() or b"") for x in texts.cast(pa.binary())]
        columns = list(zip(*found)) or [()] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    return df.withColumn(to, of(F.col(text)))


def failures() -> dict[str, F.Column]:
    """The rules by name, true where a document fails; on a struct named measures."""
    m = lambda name: F.col(f"measures.{name}")
    return {
        "few_words": m("n_words") < MIN_WORDS,
        "repeats": 100 * m("n_repeat_words") > MAX_REPEAT_PCT * m("n_words"),
        "symbols": 100 * m("n_symbols") > MAX_SYMBOL_PCT * m("n_words"),
        "dup_lines": 100 * m("n_dup_lines") > MAX_DUP_LINE_PCT * m("n_lines"),
    }


def evidence() -> F.Column:
    """How many times over its limit a document's worst measure is, of the rules that aren't the base; null if it keeps to them. Without words or lines there is none."""
    m = lambda name: F.col(f"measures.{name}")
    over = [(m("n_symbols"), MAX_SYMBOL_PCT * m("n_words")), (m("n_dup_lines"), MAX_DUP_LINE_PCT * m("n_lines"))]
    return F.greatest(*[F.when((limit > 0) & (100 * x > limit), 100 * x / limit) for x, limit in over])


def base_failed() -> F.Column:
    return failures()["few_words"] | failures()["repeats"]


def host_verdicts(df: DataFrame, host: str = "source") -> DataFrame:
    """A row for each host of a measured table: host, host_docs, host_failed, host_rate (shrunk), host_rejected.

    With rates p_h = failed/docs, mean m = sum(failed)/sum(docs) and variance v of p_h weighted by docs, the
    prior has strength m (1 - m) / v - 1, held within 1 and 1000 (1000 if v or m (1 - m) is 0)."""
    failed = F.lit(False)
    for x in failures().values():
        failed = failed | x
    by = df.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(failed).alias("host_failed"))
    whole = by.agg(F.sum("host_failed").alias("f"), F.sum("host_docs").alias("n"), F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")).alias("q"))
    m = F.col("f") / F.col("n")
    v = F.col("q") / F.col("n") - m * m
    whole = whole.select(m.alias("m"), F.when((v <= 1e-12) | (m * (1 - m) <= 1e-12), 1000.0).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).alias("strength"))
    rate = (F.col("host_failed") + F.col("m") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    deviation = F.sqrt(rate * (1 - rate) / (F.col("host_docs") + F.col("strength") + 1))
    return by.join(F.broadcast(whole)).select("host", "host_docs", "host_failed", rate.alias("host_rate"), (rate - DEVIATIONS * deviation > MAX_HOST_RATE).alias("host_rejected"))


def apply_rules(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Add measures (struct), base_failed, host_docs, host_rate, host_rejected, posterior (of a document that oversteps a rule; else null) and kept."""
    added = ("measures", "base_failed", "host_docs", "host_failed", "host_rate", "host_rejected", "posterior", "kept")
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    rows = measured(rows, text)
    hosts = host_verdicts(measured(df.select(F.col(f"`{text}`"), F.col(f"`{host}`").alias("__host")), text), "__host")
    out = lookup(rows.withColumn("__host", F.col(f"`{host}`")), hosts.withColumnRenamed("host", "__host"), "__host")
    for_, against = 1 - F.col("host_rate"), F.col("host_rate") * evidence()
    out = out.withColumns({"base_failed": base_failed(), "posterior": against / (against + for_), "__bad": F.coalesce(against > for_, F.lit(False))})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & ~F.col("__bad")).drop("__host", "__bad")


def good_documents(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that are kept, with their own columns, whatever their names are."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("host"))
    return apply_rules(whole, "text", "host").where("kept").select("__row.*")
