"""Rule bitmask ledger: every rule is evaluated once per document, policies read only its bits.

``ledger`` stores the measurements and an integer whose bit k says that rule k failed. A policy is a mask of
rules that reject, kept under a version; ``apply_policy`` and ``ablation`` need the ledger alone. Everything
is built from DataFrame functions; texts are never exploded, so nothing is shuffled.

Repeated windows are found through one sorted array per text of (43 bits of a hash, 21 bits of position);
equal neighbours are compared word by word. Where a hash lies, or a text has over 2**21 words, the windows
themselves are sorted instead, so counts are exact.

Defined cases: a null or empty text has no words, all measurements 0, and fails the base; whole texts of any
length; equal rows give equal rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space between words, and symbols.
SPACES, SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"
#: Bit k of the ledger is rule k. A rule is true where a document fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "half_repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "third_repeated": "100 * n_repeat_words > 30 * n_words",
    "exclaiming": "10 * n_exclamations > n_words",
    "shouting": "2 * n_capitals > word_chars",
    "duplicate_lines": "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 12 * n_words",
}
BASE = ("few_words", "half_repeated")
#: Versioned policies: which rules reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "third_repeated", "exclaiming", "shouting", "long_words"),
    "v2_strict": tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum(bit(r) for r in rules)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambda variables are never copied into the places that use them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positions(starts: Column) -> Column:
    """Number of words in the windows that begin at ``starts`` (from 0)."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def _same(words: Column, i: Column, j: Column) -> Column:
    return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more; ``words`` is a lambda variable."""
    places = (1 << 21) - 1

    def pairs(sorted_: Column, equal) -> Column:
        """Neighbours of the sorted array that are equal, null elsewhere."""
        return F.array_compact(F.zip_with(sorted_, F.slice(sorted_, 2, F.greatest(F.size(sorted_) - 1, F.lit(0))), equal))

    def exact(w: Column) -> Column:
        def window(i: Column) -> Column:
            return F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))

        windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))
        return _let(windows, lambda s: _positions(F.flatten(pairs(s, lambda x, y: F.when((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.array(x.i, y.i))))))

    def hashed(w: Column) -> Column:
        def key(i: Column) -> Column:
            return F.shiftleft(F.shiftright(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 21), 21).bitwiseOR(i.cast("bigint"))

        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key))

        def at(k: Column) -> Column:
            return k.bitwiseAND(F.lit(places)).cast("int")

        def found(x: Column, y: Column) -> Column:
            return F.when(F.shiftright(x, 21) == F.shiftright(y, 21), F.array(at(x), at(y)))

        def result(p: Column) -> Column:
            lies = F.exists(p, lambda q: ~_same(w, F.get(q, F.lit(0)), F.get(q, F.lit(1))))
            return F.when(F.size(p) == 0, 0).when(lies, exact(w)).otherwise(_positions(F.array_distinct(F.flatten(p))))

        return _let(keys, lambda s: _let(pairs(s, found), result))

    return F.when(F.size(words) < 4, F.lit(0)).when(F.size(words) > places, exact(words)).otherwise(hashed(words)).cast("bigint")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the measurements that the rules read."""
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    plain = F.translate("_text", SPACES, " " * len(SPACES))
    words = F.array_remove(F.split(plain, " "), "")

    def without(chars: str) -> Column:
        return F.length("_text") - F.length(F.translate("_text", chars, ""))

    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    n_lines = _let(lines, lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("d")))
    measured = source.select(
        id_col,
        _let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("_words"),
        n_lines.alias("_lines"),
        F.length(F.translate("_text", SPACES, "")).cast("bigint").alias("word_chars"),
        without(SYMBOLS).cast("bigint").alias("n_symbols"),
        without("!").cast("bigint").alias("n_exclamations"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_capitals"),
    )
    return measured.select(
        id_col,
        F.col("_words.n").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("_lines.n") - F.col("_lines.d")).cast("bigint").alias("n_dup_lines"),
        F.col("_words.r").alias("n_repeat_words"),
        "n_exclamations",
        "n_capitals",
        F.col("_lines.n").cast("bigint").alias("n_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failed_bits, one row per document."""
    measured = measure(docs, id_col, text_col)
    bits = F.lit(0)
    for rule, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), bit(rule)).otherwise(0))
    return measured.withColumn("failed_bits", bits)


def apply_policy(ledgered: DataFrame, version: str = "v1") -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return ledgered.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablation(ledgered: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would be kept without it."""
    rejects = mask(POLICIES[version])
    by_bits = ledgered.select(F.col("failed_bits").bitwiseAND(F.lit(rejects)).alias("bits")).groupBy("bits").count()  # at most 2**len(RULES) rows
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in POLICIES[version]))
    each = by_bits.select("bits", "count", F.explode(rules).alias("r")).select("bits", "count", "r.*")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
        F.bit_or(F.when(fails, F.col("bits")).otherwise(0)).alias("failed_together"),
    )


def keep_good(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their columns. The rules are evaluated in the same pass, without a join."""
    names = docs.columns
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    kept = apply_policy(ledger(wrapped.select(F.col("_row").alias("_row"), F.col(f"_row.`{text_col}`").alias("_t")), "_row", "_t"), version)
    return kept.where("kept").select(*(F.col(f"_row.`{c}`").alias(c) for c in names))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    done = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


ORACLE_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), w as (
  select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d
), p as (
  select rid, w[i] as a, w[i + 1] as b, w[i + 2] as c, i
  from (select rid, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) > 3)
), r as (
  select rid, count(distinct i + k) as n
  from (select rid, i, count(*) over (partition by rid, a, b, c) as same from p), (values (0), (1), (2)) as o(k)
  where same > 1 group by rid
), m as (
  select doc_id, len(w)::bigint as n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
         length(t) - length(replace(t, '!', '')) as n_exclamations, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals, len(ls) as n_lines
  from w left join r using (rid)
), b as (
  select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > n_words then 4 else 0 end) + (case when 100 * n_repeat_words > 30 * n_words then 8 else 0 end)
    + (case when 10 * n_exclamations > n_words then 16 else 0 end) + (case when 2 * n_capitals > word_chars then 32 else 0 end)
    + (case when n_dup_lines >= 3 and 2 * n_dup_lines > n_lines then 64 else 0 end) + (case when word_chars > 12 * n_words then 128 else 0 end) as failed_bits from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed, (failed_bits & 191) = 0 as kept, failed_bits::int as failed_bits from b
"""
