"""Distribution divergence: documents whose letters and words are unlike their language.

A document's histogram of character classes and its histogram of its language's function
words are compared with the language's own, the mean of the shares in the documents that
pass the base rules, by Jensen-Shannon distance (base 2, so from 0 to 1). Each document has
one vote, however long. A document goes when a
distance exceeds its limit. Short texts have noisy histograms: below `min_chars`
characters or `min_words` words the distance in question does not count.

Base rules: fewer than 50 words, or over half of the words in three-word windows found
twice or more in the text, and the document goes whatever its distances.

All of it is Spark expressions over one row at a time, and one aggregate per language.
A null text is empty and fails the base rules. A language whose primary subtag has a word
list is that language in any spelling ('EN', 'en-US'); all others compare as given, null is
one of them, and each has its own reference and is judged by its characters alone. Repeated
rows count and are judged each by itself; rows that tie need no order. An empty table gives
no rows. Columns besides doc_id, text and lang are not read, whatever their names. A text of
any length is one row of Spark expressions, read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import settle

# Fixed values.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"),
    "de": ("der", "die", "und", "das", "in", "den", "von", "zu", "mit", "ist", "ein", "eine", "des", "sich", "auf", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "une", "en", "du", "que", "est", "dans", "qui", "pour", "pas"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para"),
}
SYMBOLS = "#*$%&|<>"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Removed one after another; a class's count is what its step removes, the last is the rest.
CLASSES = (("lower", "[a-z]+"), ("space", SPACE_CLASS), ("upper", "[A-Z]+"), ("digit", "[0-9]+"),
           ("stop", r"""[.,;:!?'"()\-]+"""), ("mark", r"[\x21-\x7E]+"), ("letter", r"\p{L}+"))


def _word_lists(lang: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, listed in FUNCTION_WORDS.items():
        out = F.when(lang == name, F.array(*map(F.lit, listed))).otherwise(out)
    return out


def _language(lang: Column) -> Column:
    primary = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]+)(?:[-_].*)?\s*$", 1))
    return F.when(primary.isin(*FUNCTION_WORDS), primary).otherwise(lang)


def features(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, lang, the base counts and the two histograms of every row."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*carried, _language(F.col("lang").cast("string")).alias("lang"), text.alias("t"))
    df = df.select("*", F.array_remove(F.split("t", SPACE_CLASS), "").alias("w"),
                   F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
                   F.regexp_replace("t", CLASSES[0][1], "").alias("r0"))
    for i, (_, pattern) in enumerate(CLASSES[1:], 1):
        df = df.select("*", F.regexp_replace(f"r{i - 1}", pattern, "").alias(f"r{i}"))
    left = [F.length("t"), *(F.length(f"r{i}") for i in range(len(CLASSES)))]
    df = df.select(
        *carried, "lang", "w", F.size("w").cast("long").alias("n_words"),
        (F.length("t") - (F.length("r0") - F.length("r1"))).cast("long").alias("word_chars"),
        (F.length("r1") - F.length(F.translate("r1", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[(a - b).cast("double") for a, b in zip(left, left[1:])], left[-1].cast("double")).alias("classes"),
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))).alias("g"))
    # numbers of function words, then of all other words
    df = df.select("*", F.transform(_word_lists(F.col("lang")), lambda word: (F.size("w") - F.size(F.array_remove("w", word))).cast("double")).alias("f"))
    several = F.when((F.size("w") > 3) & (F.size(F.array_distinct("g")) < F.size("g")), F.sort_array(
        F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select("*", several.alias("s"))
    df = df.select("*", F.sort_array(F.transform(F.filter("s", lambda x, k: F.coalesce(
        (x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"]),
        x["h"] == F.get("s", k - 1)["h"], x["h"] == F.get("s", k + 1)["h"], F.lit(False))), lambda x: x["i"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get("p", k - 1)))),
                          F.lit(0), lambda total, n: total + n)
    return df.select(*carried, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "classes",
                     F.concat("f", F.array((F.size("w") - F.aggregate("f", F.lit(0.0), lambda a, b: a + b)).cast("double"))).alias("function_words"))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, in bits; null where one is empty."""
    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def share(x):
        return F.transform(x, lambda v: v / F.when(total(x) > 0, total(x)))

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    terms = F.zip_with(share(counts), share(reference), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    bits = F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0))
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(bits))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(found: DataFrame) -> DataFrame:
    """The mean histograms of each language, over its rows of `features` that pass the base rules."""
    n_words = max(map(len, FUNCTION_WORDS.values())) + 1
    whole = {c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b) for c in ("classes", "function_words")}
    voters = found.where(~base_failed()).select("lang", "classes", "function_words", *[F.when(x > 0, x).alias(f"n_{c}") for c, x in whole.items()])
    sums = voters.groupBy("lang").agg(
        *[F.avg(F.get("classes", i) / F.col("n_classes")).alias(f"c{i}") for i in range(len(CLASSES) + 1)],
        *[F.avg(F.get("function_words", i) / F.col("n_function_words")).alias(f"f{i}") for i in range(n_words)])
    return settle(sums.select("lang", F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("ref_c"),
                              F.filter(F.array(*[f"f{i}" for i in range(n_words)]), lambda x: x.isNotNull()).alias("ref_f")), "references")


def verdicts(found: DataFrame, known: DataFrame, max_class_distance: float = 0.28, max_word_distance: float = 0.29,
             min_chars: int = 200, min_words: int = 100) -> DataFrame:
    """`features` with base_failed, the distances and kept; `known` has a row per language."""
    known = known.withColumnRenamed("lang", "_lang")
    measured = found.join(known, found["lang"].eqNullSafe(known["_lang"]), "left").drop("_lang").withColumns({
        "base_failed": base_failed(), "class_distance": distance(F.col("classes"), F.col("ref_c")),
        "word_distance": F.when(F.size("function_words") > 1, distance(F.col("function_words"), F.col("ref_f")))})
    unlike = ((F.col("word_chars") >= min_chars) & (F.col("class_distance") > max_class_distance)) | (
        (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance))
    return measured.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(unlike, F.lit(False)))


def judge(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed, the distances and kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = settle(features(docs, "doc_id"), "quality")
    return verdicts(found, references(found), **limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
