"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each
rule that fails. A policy is a versioned set of rules, that is a mask: applying one, comparing two and
the ablation of each rule are bitwise operations on the ledger, without another pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orderlens.llm.textstats import MEASURES, measure
from orderlens.llm.words import text_chunks

#: Rule name -> SQL condition over the measurements under which a document fails, in bit order. New
#: rules go at the end: a bit never changes its meaning.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "upper_case": "100 * n_upper > 60 * word_chars",
    "shouting": "100 * n_shouts > 40 * n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "word_runs": "100 * n_runs > 20 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "symbol_words": "100 * n_symbol_words > 30 * n_words",
    "digits": "100 * n_digits > 40 * word_chars",
}

BASE: tuple[str, ...] = ("too_few_words", "repeated_windows")
#: Version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "2026-01": (*BASE, "symbols", "upper_case", "shouting", "duplicate_lines"), "2026-02": tuple(RULES)}
CURRENT = "2026-02"


def mask_of(names: Sequence[str], rules: Mapping[str, str] = RULES) -> int:
    at = {name: bit for bit, name in enumerate(rules)}
    return sum(1 << at[name] for name in set(names))


def quality_ledger(docs: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements (see textstats.MEASURES) and ``failed``, a bit for each rule, for each row.

    Other columns of ``docs`` are ignored. A null text counts as empty, with all measurements 0; texts
    are read whole whatever their length; repeated rows have a ledger row each; null ids are kept; an
    empty table gives an empty ledger. There can be 63 rules.
    """
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                m = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[k]) for k in MEASURES)], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in MEASURES))
    bits = [F.when(F.expr(sql), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, sql in enumerate(rules.values())]
    failed = F.lit(0).cast("long")
    for b in bits:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def apply_policy(ledger: DataFrame, version: str = CURRENT, policies: Mapping[str, Sequence[str]] = POLICIES,
                 rules: Mapping[str, str] = RULES) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask_of(names, rules)).cast("long")) != 0
    return ledger.withColumn("base_failed", hit(policies["base"])).withColumn("kept", ~(hit(policies["base"]) | hit(policies[version])))


def ablations(ledger: DataFrame, version: str = CURRENT, policies: Mapping[str, Sequence[str]] = POLICIES,
              rules: Mapping[str, str] = RULES) -> DataFrame:
    """For each rule of a policy: version, rule, n_failed, n_only (documents that only this rule rejects,
    which dropping the rule would keep) and n_rejected by the whole policy.

    Documents are counted by failure mask first, so what is compared with the rules is a row for each
    mask that occurs."""
    names = [n for n in rules if n in set(policies[version])]
    masks = (ledger.withColumn("m", F.col("failed").bitwiseAND(F.lit(mask_of(names, rules)).cast("long")))
             .groupBy("m").agg(F.count("*").alias("n")))
    return masks.agg(*[F.struct(
        F.sum(F.when(F.col("m").bitwiseAND(F.lit(mask_of([name], rules)).cast("long")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == mask_of([name], rules), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("m") != 0, F.col("n")).otherwise(0)).alias("n_rejected")).alias(name) for name in names]).select(
        F.explode(F.array(*[F.struct(F.lit(version).alias("version"), F.lit(name).alias("rule"), *(F.coalesce(F.col(f"{name}.{c}"), F.lit(0)).alias(c)
                  for c in ("n_failed", "n_only", "n_rejected"))) for name in names])).alias("r")).select("r.*")
