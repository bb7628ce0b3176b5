"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule;
policies are versioned bit masks applied to the ledger afterwards, and ablations are sums over bit patterns.
All of it is column expressions: one pass, no shuffle, no Python.

Defined cases: a null or empty text has no words, so all measurements are 0 and it fails ``few_words``; ties do
not arise; repeated rows give repeated ledger rows; an empty table gives an empty ledger; columns of the input
that bear a measurement's name are replaced in the ledger, all others pass through. Windows of eight words are
compared by a 64-bit hash within one document.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import free_name

# ASCII white space as the contract has it, and the characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")


def _measured(text: Column, df: DataFrame) -> DataFrame:
    """``df`` with its measurements. Helper columns are arrays that live only inside the pass."""
    whole = F.coalesce(text, F.lit(""))
    stripped = whole
    for symbol in SYMBOLS:
        stripped = F.replace(stripped, F.lit(symbol), F.lit(""))
    words, lines, windows = (free_name(df, name) for name in ("__words", "__lines", "__windows"))
    return (
        df.withColumn(words, F.array_remove(F.split(whole, SPACE + "+"), ""))
        .withColumn(lines, F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumn(windows, _windows(words))
        .withColumns({
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(stripped)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _covered(windows),
            "n_upper_words": _upper_words(whole),
        })
        .drop(words, lines, windows)
    )


def _windows(words: str) -> Column:
    """A hash for each run of eight words, in order of position."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: str) -> Column:
    """How many words lie in windows that occur twice or more.

    Most documents repeat nothing, which comparing the number of distinct hashes shows. For the others the
    (hash, position) pairs are sorted, pairs equal to a neighbour stay, and their positions, sorted again, each
    cover the words up to the next position, eight at most.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = F.filter(
        F.arrays_zip(
            placed.alias("at"),
            F.concat(F.array(F.lit(None).cast("bigint")), placed["h"]).alias("before"),
            F.slice(placed["h"], F.lit(2), F.size(windows)).alias("after"),
        ),
        lambda z: z["at"].isNotNull() & (
            F.coalesce(z["at"]["h"] == z["before"], F.lit(False)) | F.coalesce(z["at"]["h"] == z["after"], F.lit(False))
        ),
    )
    positions = F.sort_array(F.transform(marked, lambda z: z["at"]["i"]))
    total = F.aggregate(
        positions,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total).cast("long")


def _upper_words(whole: Column) -> Column:
    """Words of two or more capitals, with whatever marks surround them."""
    return F.regexp_count(whole, F.lit(r"(?<![\p{L}])\p{Lu}{2,}(?![\p{L}])")).cast("long")


def rules() -> dict[str, Column]:
    """Failure conditions over the measurements, in bit order. New rules are only ever appended.

    ``few_words`` and ``repeated_words`` are the base rules. The others are the usual heuristics: symbols per word,
    share of repeated lines, mean word length, share of words in capitals.
    """
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > 2 * n,
        "repeated_lines": (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "capitals": 100 * F.col("n_upper_words") > 40 * n,
    }


BITS = {name: i for i, name in enumerate(
    ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals"))}


def mask(*names: str) -> int:
    return sum(1 << BITS[name] for name in names)


BASE = mask("few_words", "repeated_words")
#: Policies by version; a version never changes once documents were filtered by it.
POLICIES = {"v1": BASE, "v2": mask(*BITS)}
CURRENT = "v2"


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements and ``fail_bits``: bit i is set when rule i fails."""
    measured = _measured(F.col(f"`{text}`"), df.drop(*MEASURES, "fail_bits"))
    bits = F.lit(0).cast("long")
    for name, failed in rules().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def kept(policy: str = CURRENT) -> Column:
    """True for ledger rows that a policy lets through."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def passing(df: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """Rows of ``df`` that a policy lets through, with the columns of ``df``.

    The bits go through a generator of one row each: a plain filter would be pushed into the measurements, and their
    expressions written out there once for every use.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    rows = ledger(packed, "__text").select("__row", F.explode(F.array("fail_bits")).alias("__bits"))
    return rows.where(F.col("__bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0).select("__row.*")


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: documents failing it, failing it alone, and kept if it were left out.

    The ledger is first summed by bit pattern (at most 2^rules rows), so all rules come from one aggregate.
    """
    wanted = POLICIES[policy]
    pattern = F.col("fail_bits").bitwiseAND(F.lit(wanted).cast("long")).alias("bits")
    patterns = rows.groupBy(pattern).agg(F.count("*").alias("n"))
    table = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit"))
        for name, bit in BITS.items() if wanted >> bit & 1
    ])
    each = patterns.select("bits", "n", F.explode(table).alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("long")))

    return each.groupBy("rule").agg(
        total(fails).alias("failed"), total(fails & others).alias("failed_alone"), total(others).alias("kept_without"),
    )
