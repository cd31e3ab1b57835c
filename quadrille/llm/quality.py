"""Quality rules: a threshold table compiled into one projection, without user functions.

Each rule bounds one measure of a text. `compile_rules` turns the table into a single struct of
measures and a boolean for each rule; Spark evaluates it in one pass over the text, on the JVM.
`duckdb_sql` writes the table as SQL. The table is STRICT: RULES, with the rules in ANY_LENGTH at any length.

Measures: n_chars; n_words (pieces between white space); symbol_ratio (signs out of SYMBOLS, of all
characters); upper_ratio (capital letters, of all letters); stop_ratio (words that are stop words of one of
four languages); repeat_ratio (words equal to the word before); dup_line_ratio (lines that repeat another).

Nulls and empty texts: a null text has null measures and is rejected by the rule `min_words`, an empty
one has zeros and is rejected likewise. Ratios of nothing are 0. Repeated rows are judged one by one.
Very long texts are measured whole. Empty tables give empty results. Extra columns pass through, whatever
their names: measures are nested in one struct, whose name is checked against the columns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#$%&*|~^<>{}[]\\=_@+"
STOP_WORDS = tuple(sorted({*(
    "the of and to in is that for it was on are as with be this by at or from an not have "
    "der die das und ist von den mit auf ein eine des dem nicht im zu als auch "
    "le la les de et des un une est que qui dans pour sur du au par en avec "
    "el los las y que del un una es por con para se no su al lo"
).split()}))


@dataclass(frozen=True)
class Rule:
    """Reject a text of at least `min_words` words whose measure is below `low` or above `high`."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("min_words", "n_words", low=1),
    Rule("symbols", "symbol_ratio", high=0.05, min_words=20),
    Rule("capitals", "upper_ratio", high=0.3, min_words=20),
    Rule("stop_words", "stop_ratio", low=0.01, min_words=100),
    Rule("repeated_words", "repeat_ratio", high=0.2, min_words=20),
    Rule("repeated_lines", "dup_line_ratio", high=0.4, min_words=20),
)
#: RULES without the size switch on signs of junk that hold at any length; capitals and stop words still ask for enough words.
ANY_LENGTH = ("symbols", "repeated_words", "repeated_lines")
STRICT = tuple(replace(r, min_words=0) if r.name in ANY_LENGTH else r for r in RULES)
_NOT_SYMBOLS = "[^" + "".join("\\" + c for c in SYMBOLS) + "]+"
MEASURES = ("n_chars", "n_words", "symbol_ratio", "upper_ratio", "stop_ratio", "repeat_ratio", "dup_line_ratio")


def measures(text: Column, rules=STRICT) -> Column:
    """A struct of all measures of a text and of `rejected_by`; a variable of a lambda holds what is used twice."""

    def once(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def over(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole).otherwise(F.when(whole.isNotNull(), 0.0))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, ""))

    def of(words: Column) -> Column:
        n, chars, lines = F.size(words), F.length(text), F.split(text, "\n", -1)
        stops = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
        repeats = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
        return F.when(text.isNotNull(), F.struct(
            chars.cast("long").alias("n_chars"),
            n.cast("long").alias("n_words"),
            over(left(_NOT_SYMBOLS), chars).alias("symbol_ratio"),
            once(chars - left(r"\p{L}+"), lambda letters: over(left(r"\P{Lu}+"), letters)).alias("upper_ratio"),
            over(stops, n).alias("stop_ratio"),
            over(repeats, n).alias("repeat_ratio"),
            once(lines, lambda x: over(F.size(x) - F.size(F.array_distinct(x)), F.size(x))).alias("dup_line_ratio"),
        ))

    words = F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")
    return once(once(words, of), lambda m: F.struct(*(m[x].alias(x) for x in MEASURES), rejected_by(m, rules).alias("rejected_by")))


def rejected_by(m: Column, rules=STRICT) -> Column:
    """Names of the rules that reject a text with these measures, in the table's order."""
    hits = []
    for r in rules:
        value, bad = m[r.measure], F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        if r.name == "min_words":
            bad = bad | value.isNull()
        bad = F.coalesce(bad & (F.coalesce(m["n_words"], F.lit(0)) >= r.min_words), F.lit(False))
        hits.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*hits))


def score(docs: DataFrame, column: str = "text", rules=STRICT) -> DataFrame:
    """docs with `quality`, a struct of the measures and of `rejected_by`, the rules that reject the text."""
    if "quality" in docs.columns:
        raise ValueError("docs already has a column quality")
    # a generator, so that a filter on its output doesn't evaluate the measures a second time
    return docs.select("*", F.explode(F.array(measures(F.col(column), rules))).alias("quality"))


def keep(docs: DataFrame, column: str = "text", rules=STRICT) -> DataFrame:
    """The rows of docs that no rule rejects, with docs' columns."""
    return docs.where(F.size(measures(F.col(column), rules)["rejected_by"]) == 0)


def duckdb_sql(table: str = "documents", rules=STRICT, columns: str = "doc_id") -> str:
    """DuckDB SQL for the kept rows: `columns` and the measures."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)

    def over(a, b):
        return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) WHEN ({b}) IS NOT NULL THEN 0.0 END"

    signs = SYMBOLS.replace("'", "''")
    bad = []
    for r in rules:
        tests = ([f"{r.measure} < {r.low}"] if r.low is not None else []) + ([f"{r.measure} > {r.high}"] if r.high is not None else []) + ([f"{r.measure} IS NULL"] if r.name == "min_words" else [])
        bad.append(f"(({' OR '.join(tests)}) AND COALESCE(n_words, 0) >= {r.min_words})")
    return f"""
WITH w AS (
  SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS ws, string_split(text, chr(10)) AS ls,
    length(text) AS nc, length(regexp_replace(text, '\\P{{L}}+', '', 'g')) AS nl, length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS nu,
    length(text) - length(translate(text, '{signs}', '')) AS ns FROM {table}),
m AS (
  SELECT * EXCLUDE (n_chars), CAST(nc AS BIGINT) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words,
    {over('ns', 'nc')} AS symbol_ratio, {over('nu', 'nl')} AS upper_ratio,
    {over(f"len(list_filter(ws, lambda x: lower(x) IN ({stops})))", 'len(ws)')} AS stop_ratio,
    {over("len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]))", 'len(ws)')} AS repeat_ratio,
    {over('len(ls) - len(list_distinct(ls))', 'len(ls)')} AS dup_line_ratio FROM w)
SELECT {columns}, {', '.join(MEASURES)} FROM m WHERE NOT COALESCE({' OR '.join(bad)}, FALSE)"""
