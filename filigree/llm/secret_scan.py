"""Secrets in texts: candidates by shape, false positives removed by a random forest. DataFrame functions only.

Candidates. A word between white space is cut into parts, each from a name that is assigned (``token=``,
``"token":``) to the next one. A part gives (a) what is assigned in it, or the whole word if the word before ends
with ``=`` or ``:``, of any characters but quotes, brackets and ``,;&``, of ``ASSIGNED`` characters or more, and (b)
each longest run of ``LEAST`` letters, digits and ``+/_-`` or more, with up to two ``=`` that pad it, that is no plain
word: it has a digit, or a capital after a small letter; and the steps of a run that is a path. A value that stands several times in one part is one
candidate. What is neither assigned nor (b), such as a phrase of plain words, is none.

Features (``FEATURES``): length, transitions between small letters, capitals, digits and marks, the shares of those,
how many different characters, which share of its letters the corpus's own words cover (words of letters only,
counted over all documents, that occur ``COMMON`` times or more), how deep a path it stands in, whether it is
assigned, and what the words before it and its first four characters say: the highest and the lowest log odds of
those words, and the log odds of those characters, by the labelled findings.

Labels. ``fit`` takes any labelled findings. The given tables have none, so ``secret_samples`` writes lines with
keys, tokens and passwords, named and not, and with what is taken for them: identifiers, digests, paths, versions,
numbers, placeholders, and settings whose names only sound secret. Their number is the parameter ``lines``. The log
odds come from one half of the training lines and the forest from the other, so that it does not trust them too much.

Null and empty texts have no candidates. Each row gets its findings, repeated rows and rows with a null doc_id too;
pos, part and run say where one stands (word, part of the word, candidate of the part, each from 0). Other columns
are dropped by ``scan`` and kept by ``redact``, which masks by text and so needs no ids.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved
from .secret_samples import sample_lines

LEAST, ASSIGNED, COMMON, CONTEXT = 8, 4, 5, 120
#: Words of the corpus that the written lines use, chosen by hash.
VOCABULARY = 800
MASK = "[SECRET]"
#: A longest run; = at its end belongs to it unless it assigns what follows.
RUN = r"[A-Za-z0-9+/_\-]{8,}(?:={1,2}(?![\"'`]?[A-Za-z0-9+/_\-=]))?"
#: Where a part of a word begins: at a name that is assigned.
NAME = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z_][A-Za-z0-9_\-]*[\"'`]?[:=][\"'`]?[^\s\"'`:=/])"
#: An assigned value ends at a quote, a bracket, one of ,;& or the host that it opens.
VALUE = r"((?:(?!@[\w.\-]+\.[A-Za-z]{2,})[^\s\"'`,;&()\[\]{}<>])+)"
FEATURES = ["length", "transitions", "digits", "capitals", "marks", "different", "coverage", "depth", "assigned", "speaks_for", "speaks_against", "head"]
#: Rows, and characters in them, that may be broadcast; beyond, Spark joins by shuffles.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16_000_000
KEYS = ["k1", "k2"]


def words(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns, pos, word, all words): one row for each word between white space."""
    split = docs.select(*columns, F.split("text", r"\s+").alias("words"))
    # An outer explode: an inner one would have Spark split the texts twice.
    return split.select(*columns, "words", F.posexplode_outer("words").alias("pos", "word"))


def dictionary(docs: DataFrame) -> DataFrame:
    """Words of at least three letters that occur ``COMMON`` times or more in the corpus, in lower case."""
    bare = words(docs).select(F.lower(F.regexp_replace("word", r"^[\p{Punct}]+|[\p{Punct}]+$", "")).alias("run"))
    return bare.filter(F.col("run").rlike(r"^\p{L}{3,}$")).groupBy("run").agg(F.count("*").alias("_n")).filter(F.col("_n") >= COMMON).select("run")


def candidates(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns, pos, part, run, value, assigned, and what stands before it) for each candidate of docs (columns, text)."""
    odd = lambda c: c.rlike(r"[0-9]|[a-z][A-Z]")
    word, before = F.col("word"), F.get("words", F.col("pos") - 1)
    follows = F.coalesce(F.right(before, F.lit(1)).isin("=", ":") & before.rlike(r"^[=:]$|[A-Za-z][\"'`]?[=:]$"), F.lit(False))
    inside = word.contains("=") | word.contains(":")
    some = (F.length("word") >= ASSIGNED) & (follows | inside | (F.length("word") >= LEAST) & odd(word))
    ahead = F.right(F.concat_ws(" ", F.get("words", F.col("pos") - 3), F.get("words", F.col("pos") - 2), before), F.lit(CONTEXT))
    long = words(docs, *columns).filter(some).select(*columns, F.col("pos").cast("long").alias("pos"), ahead.alias("ahead"), follows.alias("follows"), F.split("word", NAME).alias("parts"))
    parts = long.select(*columns, "pos", "ahead", "follows", F.posexplode_outer("parts").alias("part", "piece"))
    named = F.regexp_extract("piece", r"^[A-Za-z_][A-Za-z0-9_\-]*[\"'`]?[:=][\"'`]?" + VALUE, 1)
    bare = F.when(F.col("follows") & (F.col("part") == 0) & (named == ""), F.regexp_extract("piece", r"^[\"'`(\[{<]*" + VALUE, 1))
    given = F.regexp_replace(F.coalesce(F.when(named != "", named), bare, F.lit("")), r"[.:]+$", "")
    given = F.when((F.length(given) >= ASSIGNED) & ~F.startswith(given, F.lit("//")), given)
    runs = F.filter(F.regexp_extract_all("piece", F.lit(RUN), F.lit(0)), odd)
    each = parts.select(*columns, "pos", "ahead", "part", "piece", given.alias("given"), runs.alias("runs"))
    steps = F.filter(F.split(F.array_join("runs", "/"), "/"), lambda c: (F.length(c) >= LEAST) & odd(c))
    each = each.withColumn("values", F.array_distinct(F.array_compact(F.concat(F.array("given"), "runs", steps))))
    each = each.select("*", F.posexplode("values").alias("run", "value"))
    # What stands before the value: the words ahead if the part begins the word, the part's beginning, its last characters.
    left = F.left("piece", F.instr(F.col("piece"), F.col("value")) - 1)
    context = F.concat_ws(" ", F.when(F.col("part") == 0, F.col("ahead")), F.left(left, F.lit(CONTEXT)), F.when(F.length(left) > CONTEXT, F.right(left, F.lit(CONTEXT))))
    depth = F.regexp_count(left, F.lit(r"[/\\]")) + F.regexp_count("value", F.lit(r"[/\\]"))
    return each.select(*columns, "pos", "part", "run", "value", (F.coalesce(F.col("value") == F.col("given"), F.lit(False))).alias("assigned"), depth.alias("depth"), context.alias("before"))


def spoken(before: Column, value: Column) -> Column:
    """What the labelled findings give odds of: the words before, in lower case, and after a ^ the value's first four characters."""
    low = F.lower(F.regexp_replace(before, r"([a-z])([A-Z])", "$1 $2"))
    return F.array_distinct(F.concat(F.filter(F.split(low, r"[^\p{L}]+"), lambda w: F.length(w) > 1), F.array(F.concat(F.lit("^"), F.left(value, F.lit(4))))))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates with all FEATURES, as doubles, but those of odds."""
    shape = F.col("value")
    for pattern, mark in ((r"[a-z]", "a"), (r"[A-Z]", "A"), (r"[0-9]", "0"), (r"[^aA0]", "-")):
        shape = F.regexp_replace(shape, pattern, mark)
    kinds = F.regexp_replace(shape, r"(.)\1*", "$1")
    runs = found.select("value").distinct().select("value", F.explode(F.filter(F.split(F.lower("value"), r"[^\p{L}]+"), lambda r: F.length(r) >= 3)).alias("run"))
    covered = runs.join(known, "run").groupBy("value").agg(F.sum(F.length("run")).alias("_covered"))
    double = lambda c, name: c.cast("double").alias(name)
    own = [c for c in found.columns if c not in ("assigned", "depth")]
    return found.join(covered, "value", "left").select(
        *own, double(F.length("value"), "length"), double(F.length(kinds) - 1, "transitions"), double(_share("[0-9]"), "digits"),
        double(_share("[A-Z]"), "capitals"), double(_share("[^A-Za-z0-9]"), "marks"),
        double(F.size(F.array_distinct(F.split("value", ""))) / F.length("value"), "different"),
        double(F.coalesce("_covered", F.lit(0)) / F.length("value"), "coverage"), double(F.col("depth"), "depth"), double(F.col("assigned"), "assigned"),
    )


def odds_of(findings: DataFrame) -> DataFrame:
    """(word, odds): log odds of each spoken word of labelled findings (before, value, real), by the findings that hold it."""
    each = findings.select("real", F.explode(spoken(F.col("before"), F.col("value"))).alias("word"))
    counted = each.groupBy("word").agg(F.sum("real").alias("p"), F.count("*").alias("n")).filter("n >= 3")
    whole = findings.agg(F.sum("real").alias("_p"), F.count("*").alias("_n"))
    odds = F.log((F.col("p") + 0.5) / (F.col("_p") + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (F.col("_n") - F.col("_p") + 1))
    return counted.join(F.broadcast(whole)).select("word", odds.alias("odds"))


def with_odds(findings: DataFrame, odds: DataFrame) -> DataFrame:
    """Adds the features of odds. ``odds`` is as small as the labelled findings are and becomes one map."""
    table = odds.agg(F.map_from_entries(F.collect_list(F.struct("word", "odds"))).alias("_odds"))
    got = F.transform(spoken(F.col("before"), F.col("value")), lambda w: F.struct(F.startswith(w, F.lit("^")).alias("head"), F.coalesce(F.try_element_at(F.col("_odds"), w), F.lit(0.0)).alias("odds")))
    rows = findings.join(F.broadcast(table)).withColumn("_got", got)
    of = lambda head: F.transform(F.filter("_got", lambda g: g["head"] == F.lit(head)), lambda g: g["odds"])
    zero = F.array(F.lit(0.0))
    return rows.withColumns({"speaks_for": F.array_max(F.concat(of(False), zero)), "speaks_against": F.array_min(F.concat(of(False), zero)), "head": F.array_max(of(True))}).drop("_odds", "_got")


def labelled_samples(spark, known: DataFrame, lines: int = 12_000) -> DataFrame:
    """Features and label (real) of the candidates of so many written lines: part 0 is held out, of the others a third gives the odds (odd).

    A candidate is real if it is the line's marked secret; a part of one, or one that holds it, has no label and is left out.
    """
    plain = known.filter(F.col("run").rlike("^[a-z]{2,12}$")).orderBy(F.xxhash64("run"), "run").limit(VOCABULARY)
    rows = spark.createDataFrame(sample_lines(lines, [r.run for r in plain.collect()]), "text string, secret string").coalesce(4)
    split = F.crc32(F.col("text").cast("binary"))
    found = described(candidates(rows, "text", "secret"), known)
    real = F.when(F.col("secret").isNull(), 0.0).when(F.col("value") == F.col("secret"), 1.0).when(~F.col("value").contains(F.col("secret")) & ~F.contains("secret", F.col("value")), 0.0)
    return saved(found.withColumns({"real": real, "part_of": (split % 5).cast("int"), "for_odds": (split / 5).cast("long") % 3 == 0}).filter("real is not null").drop("text", "secret"))


class Model:
    """Odds and forest, from labelled findings (FEATURES but those of odds, before, value, real, for_odds)."""

    def __init__(self, findings: DataFrame, trees: int = 40, depth: int = 8):
        self.odds = saved(odds_of(findings.filter("for_odds")))
        rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(saved(with_odds(findings.filter("not for_odds"), self.odds)).coalesce(1))
        self.forest = RandomForestClassifier(featuresCol="_features", labelCol="real", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_best", numTrees=trees, maxDepth=depth, seed=5, maxBins=64).fit(rows)

    def score(self, findings: DataFrame) -> DataFrame:
        """The findings with score (0 to 1) and is_secret (from 0.5)."""
        rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(with_odds(findings, self.odds))
        out = self.forest.transform(rows).withColumn("score", vector_to_array("_p")[1])
        return out.drop("_features", "_p", "_raw", "_best").withColumn("is_secret", F.col("score") >= 0.5)


def train(spark, known: DataFrame, lines: int = 12_000) -> Model:
    """Fit on the written lines that are not held out."""
    return Model(labelled_samples(spark, known, lines).filter("part_of <> 0"))


def scan(docs: DataFrame) -> DataFrame:
    """All candidates of docs (doc_id, text) with the keys of their text, features, score and is_secret."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"))
    known = saved(dictionary(docs))
    found = saved(described(candidates(rows, "doc_id", *KEYS), known))
    return train(docs.sparkSession, known).score(found)


def redact(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with each secret of a row's own text masked; all columns and rows stay."""
    own, values = [fresh(docs, f"_{k}") for k in KEYS], fresh(docs, "_secrets")
    held = saved(findings.filter("is_secret").groupBy(*[F.col(k).alias(o) for k, o in zip(KEYS, own, strict=True)]).agg(F.collect_set("value").alias(values)))
    size = held.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join(values, "  "))).alias("c")).first()
    if size.n <= BROADCAST_ROWS and (size.c or 0) <= BROADCAST_CHARS:
        held = F.broadcast(held)
    # Longer values first, so that none is masked in part.
    before = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    masked = F.aggregate(F.array_sort(values, before), docs["text"], lambda text, v: F.replace(text, v, F.lit(MASK)))
    rows = docs.withColumns(dict(zip(own, (F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))), strict=True)))
    joined = rows.join(held, own, "left")
    return joined.withColumn("text", F.when(F.col(values).isNotNull(), masked).otherwise(F.col("text"))).select(*docs.columns)
