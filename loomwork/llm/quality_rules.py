"""Quality rules as a ledger: every rule is evaluated once for a document and leaves a bit and its measurements.

Policies are named sets of rules with a version. Applying one, comparing two, or asking what each rule alone costs
reads the ledger's bits; no text is read again.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import map_texts, unused

_SPACE = b" \t\n\x0b\x0c\r"

#: Rules in bit order: name, and the SQL condition on the measurements under which a document fails.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE_RULES = ("few_words", "repeated_windows")
#: Versions of the policy: the rules that reject. A version once used is not changed; a change is a new one.
POLICIES = {"base-1": BASE_RULES, "web-1": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measurements(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 5 - max(i, reach)
                reach = i + 5
    return (len(words), len(text) - (len(data) - len(data.translate(None, _SPACE))), len(data) - len(data.translate(None, b"#*$%&|<>")), len(lines), len(lines) - len(set(lines)), repeated)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_FIELDS = ", ".join(f"{m} long" for m in MEASURES)


def fail_bits(rules: dict[str, str], prefix: str = "") -> Column:
    """Bit i is set if the i-th rule's condition holds of the measurements, fields of `prefix` if given."""
    name = "|".join(sorted(MEASURES, key=len, reverse=True))
    conditions = [re.sub(rf"\b({name})\b", rf"{prefix}\1", rule) for rule in rules.values()]
    return sum((F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0)).cast("long")


def ledger(docs: DataFrame, rules: dict[str, str] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, fail_bits long): bit i is set if the i-th rule fails.

    A null text is an empty one: no words, so it fails few_words alone. Repeated rows give repeated entries.
    """
    measured = map_texts(docs, id_col, text_col, _FIELDS, lambda: lambda text: [measurements(text)])
    return measured.withColumn("fail_bits", fail_bits(rules))


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """Adds kept: no rule of the policy's version failed."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def sole_rule(policy: str) -> Column:
    """The name of the rule that alone rejects an entry under the policy: without it the document would stay. Else null."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])))
    return F.coalesce(*[F.when(failed == mask((r,)), F.lit(r)) for r in POLICIES[policy]])


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """(rule, fails, only_this): documents that a rule of the policy fails, and those that it alone rejects.

    Counts by distinct bits first: two to the number of rules at most, whatever the number of documents.
    """
    by_bits = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("bits")).agg(F.count("*").alias("n"))
    one = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for r in POLICIES[policy]])
    rows = by_bits.withColumn("r", F.explode(one))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"),
    )


def with_ledger(docs: DataFrame, column: str, rules: dict[str, str] = RULES, text_col: str = "text") -> DataFrame:
    """docs with each row's own ledger entry, a struct of the measurements and fail_bits, in a further column."""

    @F.pandas_udf("struct<" + _FIELDS.replace(" long", ": long") + ">")
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measurements(t or "") for t in texts], columns=list(MEASURES), dtype="int64")

    rows = docs.withColumn(column, measure(F.col(f"`{text_col}`")))
    return rows.withColumn(column, F.col(f"`{column}`").withField("fail_bits", fail_bits(rules, f"`{column}`.")))


def kept_documents(docs: DataFrame, policy: str = "web-1", text_col: str = "text") -> DataFrame:
    """The rows of docs whose ledger entries have no bit of the policy, judged row by row: repeated ids are judged on their own texts.

    Null and empty texts have no words and go; an empty table stays empty; columns of any other names are kept as they are.
    """
    held = unused(docs.columns, "__ledger")
    rows = with_ledger(docs, held, RULES, text_col)
    kept = F.col(f"`{held}`.fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0
    return rows.where(kept).select([F.col(f"`{c}`") for c in docs.columns])
