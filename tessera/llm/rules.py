"""Quality rules by weak supervision, by DataFrame and SQL functions only.

Each rule votes good (1) or bad (-1) or abstains (0). How often a rule gives
each vote to good and to bad documents is unknown, and so is the class of each
document; expectation maximisation estimates both, and the share of good
documents, from the votes alone. The table of vote patterns, at most 3^rules rows, is aggregated
over all documents, and the iteration is one SQL expression over it. A
document's verdict is its posterior probability of being good; documents that
fail the base rule never pass.

Words in repeated three-word windows are counted in a row's own arrays: windows
are hashed, and only rows with equal windows sort them and add up covered
positions. Nothing is exploded, and text is never shuffled.

Defined cases: null and empty texts have no words, fail the base rule and are
not kept; repeated rows are scored each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._runtime import Scratch
from tessera.llm._words import BLANKS, word_array

#: (name, good if, bad if): SQL over the columns of ``statistics``. A null condition abstains.
RULES = [
    ("length", "n_words >= 80", "n_words < 40"),
    ("symbols", "100 * n_symbols <= n_words", "4 * n_symbols > n_words"),
    ("clean", "12 * (n_symbols + n_marks) <= word_chars", "6 * (n_symbols + n_marks) > word_chars"),
    ("capitals", "12 * n_upper <= word_chars", "3 * n_upper > word_chars"),
    ("ends", "n_ends * 40 >= n_words and n_ends * 3 <= n_words", "n_ends * 3 > 2 * n_words or (n_ends = 0 and n_words > 60)"),
    ("word_size", "word_chars between 3 * n_words and 7 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("dup_lines", "false", "5 * n_dup_lines > n_lines"),
    ("repeats", "false", "4 * n_repeat_words > n_words"),
    ("digits", "false", "5 * n_digits > word_chars"),
]
ROUNDS = 40


def _gone(text: str, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(F.col(text), chars, ""))).cast("long")


def _repeat_words() -> Column:
    """Positions covered by windows whose hash occurs twice or more in ``_win``."""
    return F.expr(
        """case when size(_win) = size(array_distinct(_win)) then 0L else
             aggregate(
               array_sort(transform(filter(
                 transform(array(array_sort(transform(_win, (h, i) -> named_struct('h', h, 'i', i)))), s ->
                   transform(s, (x, j) -> if((j > 0 and s[j - 1].h = x.h) or (j + 1 < size(s) and s[j + 1].h = x.h), x.i, null)))[0],
                 p -> p is not null), p -> p)),
               named_struct('n', 0L, 'end', 0),
               (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.end), 'end', p + 3),
               a -> a.n) end"""
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over each whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("_w", word_array("t")).withColumn("n_words", F.size("_w").cast("long"))
    rows = rows.withColumn("_win", F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    rows = rows.withColumn("_lines", F.expr("transform(filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]'), l -> xxhash64(l))"))
    return rows.select(
        "doc_id",
        "n_words",
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        _gone("t", "#*$%&|<>").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().cast("long").alias("n_repeat_words"),
        _gone("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _gone("t", "0123456789").alias("n_digits"),
        _gone("t", "!\"'()+,-/:;=?@[]^_`{}~\\.").alias("n_marks"),
        _gone("t", ".!?").alias("n_ends"),
    )


def votes() -> Column:
    """The rules' votes as an array of 1, -1 and 0."""
    return F.array(*[F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for _, good, bad in RULES])


_ODDS = "ln(m.prior / (1 - m.prior)) + aggregate(zip_with({v}, m.ratio, (x, r) -> ln(r[x + 1])), 0D, (x, y) -> x + y)"


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row m(prior, ratio) from (v, n), the counts of vote patterns.

    ``ratio[j]`` has, for the votes -1, 0 and 1 of rule j, how much likelier a
    good document is to get that vote than a bad one.
    """
    posterior = f"1 / (1 + exp(-({_ODDS.format(v='p.v')})))"
    share = "(aggregate(qs, 1D, (x, p) -> x + if(p.v[j] = k, {w}, 0D)) / aggregate(qs, 3D, (x, p) -> x + {w}))"
    step = f"""transform(array(transform(ps, p -> named_struct('v', p.v, 'n', p.n, 'q', {posterior}))), qs -> named_struct(
        'prior', least(0.999D, greatest(0.001D, coalesce(try_divide(aggregate(qs, 0D, (x, p) -> x + p.n * p.q), aggregate(qs, 0D, (x, p) -> x + p.n)), m.prior))),
        'ratio', transform(m.ratio, (r, j) -> transform(array(-1, 0, 1), k ->
            {share.format(w="p.n * p.q")} / {share.format(w="p.n * (1 - p.q)")}))))[0]"""
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("ps"))
    start = f"named_struct('prior', 0.85D, 'ratio', array_repeat(array(0.15D, 1D, 3D), {len(RULES)}))"
    return one.selectExpr(f"aggregate(sequence(1, {rounds}), {start}, (m, i) -> {step}) as m")


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics with base_failed, posterior and kept for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "rules")
    counted = scratch.save(statistics(docs, id_col, text_col).withColumn("v", votes()), "votes")
    model = scratch.save(estimate(counted.groupBy("v").agg(F.count("*").alias("n"))), "model")
    score = f"1 / (1 + exp(-({_ODDS.format(v='v')})))"
    out = counted.crossJoin(F.broadcast(model)).withColumn("posterior", F.expr(score))
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("v", "m")
