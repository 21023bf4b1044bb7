"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a Column over one array of words, one of lines, or the text
itself, so a text is split once and no row leaves the JVM.  ``RULES`` is the
table; ``compile_rules`` turns it into one boolean.

Words in repeated 3-word windows are found by sorting one number for each
window (36 bits of its hash above its position).  Neighbours with equal hash
bits are candidates; only those are compared as texts, so the count is exact.

Defined cases: null and blank texts have no words and fail; ratios over no
words or no lines are 0; doc_id may be null or repeated, rows stand alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for on as with was he be by this are or from at an have not which we but "
    "der die das und in zu den ist von mit sich des auf für ein eine nicht als auch es an er so dass "
    "le la les de des et un une est que qui dans pour par sur pas au il en du ce se ne plus "
    "el los las y que del se por con una para es al lo como más pero sus su o no"
).split()

#: (name, numerator, denominator, lowest, highest); None: no bound.
RULES = (
    ("words", "n_words", None, 50, 100_000_000),
    ("mean_word_length", "word_chars", "n_words", 1.5, 20.0),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.005, None),
    ("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    ("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.5),
    ("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.9),
)
_POSITION_BITS = 28


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more."""
    low = (1 << _POSITION_BITS) - 1
    n = F.size(words)
    gram = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def repeated(s: Column) -> Column:
        high = lambda x: F.shiftright(x, _POSITION_BITS)
        same = lambda x, y: F.coalesce(high(x) == high(y), F.lit(False))
        return F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))

    def confirmed(c: Column) -> Column:
        same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
        kept = F.filter(c, lambda x, i: same(x, F.get(c, i + 1)) | same(x, F.get(c, i - 1)))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(*gram(i)), _POSITION_BITS).bitwiseOR(i.cast("long")))
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    texts = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(F.concat_ws(" ", *gram(at(x))).alias("g"), at(x).alias("p"))))
    exact = lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(_let(texts(c), lambda t: _let(confirmed(t), covered)))
    return F.when(n < 6, _few(words)).otherwise(_let(F.sort_array(keys), lambda s: _let(repeated(s), exact)))


def _few(words: Column) -> Column:
    """The same for fewer than six words, where windows can only overlap each other: compares each pair."""
    n = F.size(words)
    same = lambda i, j: F.when(n >= max(i, j) + 3, (F.get(words, F.lit(i)) == F.get(words, F.lit(j))) & (F.get(words, F.lit(i + 1)) == F.get(words, F.lit(j + 1))) & (F.get(words, F.lit(i + 2)) == F.get(words, F.lit(j + 2)))).otherwise(False)
    hit = {i: same(i, (i + 1) % 3) | same(i, (i + 2) % 3) for i in range(3)}
    in_word = lambda w: F.lit(False) if not (k := [hit[i] for i in range(3) if i <= w <= i + 2]) else k[0] if len(k) == 1 else k[0] | k[1] if len(k) == 2 else k[0] | k[1] | k[2]
    total = F.lit(0).cast("long")
    for w in range(5):
        total = total + F.when(in_word(w), 1).otherwise(0)
    return total


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    count = lambda a: F.size(a).cast("long")
    of_words = _let(words, lambda w: F.struct(
        count(w).alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        count(F.filter(w, lambda x: F.array_contains(stop, F.lower(x)))).alias("n_stop_words"),
        _repeat_words(w).alias("n_repeat_words"),
    ))
    of_lines = _let(lines, lambda x: F.struct(
        count(x).alias("n_lines"),
        (count(x) - count(F.array_distinct(x))).alias("n_dup_lines"),
        count(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).alias("n_ellipsis_lines"),
        count(F.filter(x, lambda y: F.ltrim(y).startswith("- ") | F.ltrim(y).startswith("* ") | F.ltrim(y).startswith("•"))).alias("n_bullet_lines"),
    ))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines")


def _count(m: str, name: str) -> Column:
    return F.col(f"{m}.{'l' if 'line' in name else 'w'}.{name}" if name != "n_symbols" else f"{m}.n_symbols")


def compile_rules(m: str, rules=RULES) -> Column:
    """Whether the measures in column ``m`` meet every rule."""
    met = F.lit(True)
    for _, top, below, least, most in rules:
        value = _count(m, top).cast("double")
        if below:
            value = F.when(_count(m, below) == 0, F.lit(0.0)).otherwise(value / _count(m, below))
        for bound in ([value >= least] if least is not None else []) + ([value <= most] if most is not None else []):
            met = met & bound
    return met


def base_failed(m: str) -> Column:
    return (_count(m, "n_words") < 50) | (100 * _count(m, "n_repeat_words") > 50 * _count(m, "n_words"))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    # the measures are one struct that the projection above refers to often: kept apart by a filter that Catalyst can't fold
    m = docs.select("doc_id", F.explode(F.array(measures(F.col("text")))).alias("m"))
    return m.select("doc_id", *[_count("m", c).alias(c) for c in COUNTS], base_failed("m").alias("base_failed"), (~base_failed("m") & compile_rules("m", rules)).alias("kept"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    m = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.explode(F.array(measures(docs["text"]))).alias("m"))
    return m.where(~base_failed("m") & compile_rules("m", rules)).select("row.*")


def _oracle() -> str:
    word, measured = r"'[^\x20\x09-\x0D]+'", {"n_symbols": "n_symbols"}
    trimmed = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for _, top, below, least, most in RULES:
        value = f"{top}::DOUBLE" if not below else f"CASE WHEN {below} = 0 THEN 0.0::DOUBLE ELSE {top}::DOUBLE / {below} END"
        tests += [f"{value} >= {least}::DOUBLE"] * (least is not None) + [f"{value} <= {most}::DOUBLE"] * (most is not None)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT *, regexp_extract_all(text, {word}) AS w,
         list_filter(string_split(text, chr(10)), lambda x: {trimmed} <> '') AS l
  FROM t),
g AS (SELECT r, i, list_slice(w, i::INT, i::INT + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([{stop}], lower(x))))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines,
         len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::BIGINT AS n_ellipsis_lines,
         len(list_filter(l, lambda x: ltrim(x, ' ') LIKE '- %' OR ltrim(x, ' ') LIKE '* %' OR ltrim(x, ' ') LIKE '•%'))::BIGINT AS n_bullet_lines
  FROM a LEFT JOIN covered c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
"""


ORACLE_SQL = _oracle()
