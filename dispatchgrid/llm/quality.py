"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The first select holds a text's words, lines and hashed five-word windows; the second evaluates all metrics and rules of a
document in one projection. Nothing moves between rows. Words are runs of characters other than \\x20 and \\x09-\\x0D; lines
are divided at \\n and count if they hold a word. Windows of five words are compared by 64-bit hashes.

Nulls and empty texts: no words, so the base rule fails. Null doc_id: kept as null. Ties and repeated rows: each row on its
own. Very long texts: arrays of one row. An empty table gives no rows. Other columns are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he from are this or an which at but his they had "
    "le la les de des du et en un une que qui dans pour par sur au pas est il elle se ce avec "
    "der die das den dem und von zu mit ist im für auf ein eine nicht sich als auch es "
    "el los las y del una por con no para su al lo como más se"
).split()

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: metric, comparison that rejects, threshold, least words for the rule to apply.
RULES: tuple[tuple[str, str, float, int], ...] = (
    ("n_words", ">", 200_000, 0),
    ("mean_word_chars", "<", 2.0, 0),
    ("mean_word_chars", ">", 20.0, 0),
    ("symbol_ratio", ">", 0.1, 0),
    ("shout_ratio", ">", 0.5, 0),
    ("stop_ratio", "<", 0.03, 50),
    ("dup_line_ratio", ">", 0.5, 0),
)


def _characters(text: Column, which: str) -> Column:
    return F.length(text) - F.length(F.translate(text, which, ""))


def _prepared(docs: DataFrame, text: Column, *carry: str) -> DataFrame:
    text = F.coalesce(text, F.lit(""))
    inner = F.btrim(text, F.lit(BLANK))
    words = F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t\n\x0B\f\r]+"))
    out = docs.select(*carry, text.alias("text"), words.alias("words"))
    at = lambda i, j: F.get(F.col("words"), i + j)
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(at(i, j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    return out.select(*carry, "text", "words", lines.alias("lines"), windows.alias("windows"))


def _repeated_words() -> Column:
    """Words that lie in a window found twice or more: windows sorted by hash, those with an equal neighbour by place, and
    the stretch that each adds to the one before it."""
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    h = lambda p, j: F.get(p, j)["h"]
    twice = F.transform(
        F.array(pairs),
        lambda p: F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: (h(p, j) == h(p, j + 1)) | ((j > 0) & (h(p, j) == h(p, F.greatest(j - 1, F.lit(0)))))), lambda j: F.get(p, j)["i"])),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(F.get(twice, F.lit(0)), start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n")))["n"]
    return F.when(F.size(F.array_distinct("windows")) < F.size("windows"), covered).otherwise(0).cast("long")


def metrics() -> dict[str, Column]:
    n = F.size("words")
    per_word = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    chars = F.length(F.translate("text", BLANK, ""))
    dup = F.size("lines") - F.size(F.array_distinct("lines"))
    stop = list(dict.fromkeys(STOP_WORDS))
    return {
        "n_words": n.cast("long"),
        "word_chars": chars.cast("long"),
        "n_symbols": _characters(F.col("text"), SYMBOLS).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": _repeated_words(),
        "mean_word_chars": per_word(chars),
        "symbol_ratio": per_word(_characters(F.col("text"), SYMBOLS)),
        "shout_ratio": per_word(_characters(F.col("text"), "!")),
        "stop_ratio": per_word(F.size(F.filter("words", lambda w: w.isin(stop)))),
        "dup_line_ratio": F.when(F.size("lines") > 0, dup / F.size("lines")).otherwise(0.0),
    }


def compile_rules(rules: tuple = RULES) -> Column:
    """True where a rule of the table rejects."""
    out = F.lit(False)
    for metric, how, bound, least in rules:
        c = F.col(metric)
        out = out | ((c > bound if how == ">" else c < bound) & (F.col("n_words") >= least))
    return out


def quality(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """doc_id, metrics, base_failed and kept for every document."""
    m = _prepared(docs, F.col("text"), "doc_id").select("doc_id", *(c.alias(k) for k, c in metrics().items()))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.select("*", base.alias("base_failed"), (~base & ~compile_rules(rules)).alias("kept"))


def kept_rows(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The rows of docs that quality() keeps, with their own columns and texts, in one narrow pass."""
    names = [f"__{i}" for i in range(len(docs.columns))]  # so that no column clashes with those of the metrics
    own = docs.toDF(*names)
    m = _prepared(own, F.col(names[docs.columns.index("text")]), *names).select(*names, *(c.alias(k) for k, c in metrics().items()))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # The guard keeps the optimiser from moving the filter below the projections, where each metric would be evaluated anew.
    kept = m.select(*names, (~base & ~compile_rules(rules)).alias("kept"), F.monotonically_increasing_id().alias("guard"))
    return kept.where("kept and guard >= 0").select(*names).toDF(*docs.columns)


ORACLE = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as lines from t),
p as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
g as (select doc_id, pos, word, lead(word, 1) over d as w1, lead(word, 2) over d as w2, lead(word, 3) over d as w3, lead(word, 4) over d as w4
      from p window d as (partition by doc_id order by pos)),
r as (select doc_id, pos, count(*) over (partition by doc_id, word, w1, w2, w3, w4) as n from g where w4 is not null),
c as (select doc_id, count(distinct place) as n_repeat_words from (select doc_id, unnest([pos, pos + 1, pos + 2, pos + 3, pos + 4]) as place from r where n > 1) group by doc_id),
m as (select w.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))::bigint as word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      (length(text) - length(replace(text, '!', '')))::bigint as n_shouts,
      (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
      len(list_filter(words, lambda x: list_contains([{", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}], x)))::bigint as n_stop, len(lines)::bigint as n_lines
      from w left join c on w.doc_id = c.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (n_words > 200000 or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 10 * n_symbols > n_words or 2 * n_shouts > n_words or (n_words >= 50 and n_stop / n_words < 0.03) or 2 * n_dup_lines > n_lines) as kept
from m"""
