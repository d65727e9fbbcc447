"""Quality rules by the divergence of distributions.

Each document gets two histograms: the share of its characters in each character class, and the share of its words
that are each of a set of common words. They are compared with the reference of the document's language, the sum
of the histograms of all its documents that pass the base rules, by the Jensen-Shannon distance (base 2: 0 equal,
1 without overlap). Short documents have rough histograms, so the comparisons have minimum lengths.

The base rules are counts of the whole text; words are runs of other than ASCII white space.

Defined cases: a null text has no words; an empty or short text fails the base rules; a language without any
document that passes has no reference and its documents aren't judged by divergence; a null language is a language
of its own; repeated rows are judged alike; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlverdict.llm._spark import BLANKS, load, text_of, written

MIN_WORDS = 50
#: Words a text needs before its common words are compared.
MIN_COMMON = 100
MAX_CHARS = 0.30
MAX_COMMON = 0.34
#: Bound of both distances together.
MAX_SUM = 0.45
#: Common words of English, German, French and Spanish.
COMMON = (
    "the of and to in is that for it as with be by on at was are this from or"
    " der die und das von zu den mit sich des auf ist im dem nicht ein eine"
    " le la les et des de un une du que qui dans pour par au sur pas"
    " el los las y del se por con para su al una lo como más"
).split()
WORDS = tuple(dict.fromkeys(COMMON))
LETTERS = "".join(chr(0x4E00 + i) for i in range(len(WORDS)))
CLASSES = ("lower", "upper", "digit", "blank", "point", "symbol", "other")


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    """The words of a text."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated(words: Column) -> Column:
    """How many words lie in windows of three words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda a, i, x: F.coalesce(F.get(a, i)["h"] == x["h"], F.lit(False))
        twice = _let(at, lambda a: F.filter(F.transform(a, lambda x, i: F.when(near(a, i - 1, x) | near(a, i + 1, x), x["i"])), lambda i: i.isNotNull()))
        # each window adds the words that the one before doesn't cover
        added = lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(p, k - 1), F.lit(-3))))
        return _let(F.sort_array(twice), lambda p: F.aggregate(added(p), F.lit(0), lambda s, x: s + x))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    # most texts repeat no window, which a hash set tells sooner than a sort
    return F.when(F.size(words) >= 3, _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).otherwise(0)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and its two histograms."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text_of(text_col).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = lambda ws: F.array_join(F.transform(F.filter(F.transform(ws, F.lower), lambda w: w.isin(*WORDS)), lambda w: F.get(F.array(*map(F.lit, LETTERS)), F.array_position(F.array(*map(F.lit, WORDS)), w).cast("int") - 1)), "")
    by_words = _let(words_of(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated(ws).cast("long").alias("n_repeat_words"), common(ws).alias("common")))
    # what is left after the small letters is short, so that the other classes cost little
    rest = _let(_without(text, "[a-z]+"), lambda r1: _let(_without(r1, r"[\x20\x09-\x0D]+"), lambda r2: F.struct(
        F.length(r1).alias("r1"), F.length(r2).alias("r2"), F.length(_without(r2, "[A-Z]+")).alias("up"), F.length(_without(r2, "[0-9]+")).alias("dig"),
        F.length(_without(r2, r"""[.,;:!?'"()\-]+""")).alias("poi"), F.length(_without(r2, r"[#*$%&|<>@+=/\\_~^\[\]{}`]+")).alias("sym"),
        F.length(_without(r2, r"[#*$%&|<>]+")).alias("n_sym"),
    )))
    own = rows.select("id", "lang", F.length(text).alias("n"), by_words.alias("w"), rest.alias("c"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
    r2 = F.col("c.r2")
    sizes = [F.col("n") - F.col("c.r1"), r2 - F.col("c.up"), r2 - F.col("c.dig"), F.col("c.r1") - r2, r2 - F.col("c.poi"), r2 - F.col("c.sym")]
    sizes.append(F.col("n") - sum(sizes[1:], sizes[0]))
    number = lambda c: (F.length("w.common") - F.length(F.replace("w.common", F.lit(c), F.lit("")))).cast("double")
    counts = [number(c) for c in LETTERS]
    return own.select(
        "id", "lang", "w.n_words",
        (F.col("n") - (F.col("c.r1") - r2)).cast("long").alias("word_chars"),
        (r2 - F.col("c.n_sym")).cast("long").alias("n_symbols"),
        "n_dup_lines", "w.n_repeat_words",
        F.array(*[x.cast("double") for x in sizes]).alias("chars"),
        F.array(*counts, F.col("w.n_words") - F.length("w.common")).alias("words"),
    )


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance, base 2, of two histograms; 0 where one of them is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)

    def term(a: Column, b: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
        return part(a) + part(b)

    divergence = lambda n, m: F.aggregate(F.zip_with(p, q, lambda a, b: term(a / n, b / m)), F.lit(0.0), lambda s, x: s + x) / 2
    both = _let(F.struct(total(p).alias("n"), total(q).alias("m")), lambda t: F.when((t["n"] > 0) & (t["m"] > 0), F.sqrt(F.greatest(F.lit(0.0), divergence(t["n"], t["m"])))).otherwise(0.0))
    return both


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(found: DataFrame) -> DataFrame:
    """The summed histograms of each language: lang, ref_chars, ref_words. One row a language."""
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    return found.where(~base_failed()).groupBy("lang").agg(sums("chars", len(CLASSES)).alias("ref_chars"), sums("words", len(WORDS) + 1).alias("ref_words"))


def compared(found: DataFrame, refs: DataFrame) -> DataFrame:
    """found with js_chars and js_words, the distances to the language's reference (0 where there is none)."""
    # a language is a row, but a table may have any number of them: Spark broadcasts only below its own size limit
    rows = found.join(refs, "lang", "left")
    js_chars = F.when(F.col("ref_chars").isNotNull(), distance(F.col("chars"), F.col("ref_chars"))).otherwise(0.0)
    js_words = F.when(F.col("ref_words").isNotNull() & (F.col("n_words") >= MIN_COMMON), distance(F.col("words"), F.col("ref_words"))).otherwise(0.0)
    return rows.withColumn("js_chars", js_chars).withColumn("js_words", js_words).drop("ref_chars", "ref_words")


def near() -> Column:
    return (F.col("js_chars") <= MAX_CHARS) & (F.col("js_words") <= MAX_COMMON) & (F.col("js_chars") + F.col("js_words") <= MAX_SUM)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: its counts, base_failed, both distances, kept."""
    found = written(features(docs, id_col, text_col, lang_col), "quality")
    # odd documents blur the first reference; the second is made of those near the first
    first = written(references(found), "references")
    second = written(references(compared(found, first).where(near()).select(*found.columns)), "references")
    rows = compared(found, second).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & near()
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", kept.alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
